"""From raw documents to token ids: language, near-duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read back as the next one's docs. All but
the last return the columns of documents: language_id drops what it rejects and sets lang, near_duplicates keeps one document of
a group (linked by 80 % of their five-word shingles), personal_data masks, source_mixing repeats and leaves out documents by their
sources' targets and writes them shard after shard, each shuffled.

Null, empty and letterless texts go with language_id; a table without a language to learn from goes whole. Rows with null ids are
kept by the later stages, of rows that repeat an id the least one; a null source is a source of its own. Very long texts are read
whole. Ties go to the smaller doc_id. An empty table gives an empty result. Columns beyond those of documents pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import bpe, langid, minhash, mixing, pii
from ledgerlark.llm.store import small_batches, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Callable[[DataFrame], DataFrame]) -> Stage:
    """The stage, its texts handed to Python a few megabytes at a time: five stages share an executor's memory."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(docs)

    return run


STAGES = [
    ("language_id", in_small_batches(langid.accepted)),
    ("near_duplicates", in_small_batches(lambda docs: minhash.kept_documents(docs, threshold=80, width=5))),
    ("personal_data", in_small_batches(pii.masked_documents)),
    ("source_mixing", in_small_batches(mixing.mixed_documents)),
    ("byte_pair_encoding", in_small_batches(bpe.encoded)),
]

#: Language identification, the field of personal data and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
