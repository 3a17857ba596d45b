"""Plans of the engine; importing it registers all queries."""

from ledgerlark.plans import catalogue, documents  # noqa: F401
