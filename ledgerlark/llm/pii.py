r"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

Base spans, leftmost and non-overlapping for each kind, over the whole text: email, ip, card (Luhn), phone. Around words
with a digit or @, words are the nodes of a graph: neighbours share chain potentials, and words of one document that
repeat or resemble each other (same letters and digits, or same last seven digits) share skip potentials, however far
apart. Loopy belief propagation, all messages at once, gives each word's marginals; words of an entity label whose
marginal reaches the kind's threshold and that no base span covers become added spans of that kind. The base spans always stay.
The field has a fifth label, secret: keys and tokens of credentials; digest() lists these apart from the four kinds.

What the base patterns find is no lesson for what they miss. So the field (hashed features of shape and context, and the
potentials) learns from documents in which some of the data found is written again in a form that no base pattern
matches (FORMS: no country code, dots for dashes, "at" for @ ...), and, for secrets, from values that follow a word like
token or password (SECRET; a pattern for labels only, it never makes spans). Words that repeat or resemble a labelled
word of their document are labelled like it. Every task trains on all its documents, batch
by batch, and the weights are averaged, each feature's by how often the task met it; then once more from there. One document in ten
(by a hash of its text) is left out and gives the thresholds: the least one at which `precision` of the added words of a kind are right; SURE for
a kind that the documents left out do not show.

Null and empty texts have no spans. Empty tables give an empty result. Null or repeated ids, repeated rows and ties change
nothing: no id is used. Very long texts are read whole, as one graph. Extra columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import byte_parts
from .gru import Adam
from .store import written

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
WEIGHTS, PRECISION, SURE, ROUNDS, NODES, STEPS = 1 << 14, 0.99, 0.9, 8, 20_000, (40, 20)
#: Credentials as training labels: the value after a telling word.
SECRET = re.compile(r"""(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b["']?\x20{0,3}[=:]\x20{0,3}["']?([A-Za-z0-9+/_-]{16,200})""")
#: Forms that base patterns miss: d are the digits, m the text itself.
FORMS = {
    "email": (lambda m, d: m.replace("@", " at "), lambda m, d: m.replace("@", "(at)"), lambda m, d: m.replace("@", " [at] ")),
    "ip": (lambda m, d: m.replace(".", "-"), lambda m, d: m.replace(".", "[.]"), lambda m, d: m.replace(".", " . ")),
    "card": (lambda m, d: ".".join(d[k : k + 4] for k in range(0, len(d), 4)), lambda m, d: "/".join(d[k : k + 4] for k in range(0, len(d), 4))),
    "phone": (lambda m, d: f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", lambda m, d: f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", lambda m, d: f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", lambda m, d: f"{d[-7:-4]}-{d[-4:]}"),
    "secret": (),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match can only start where a run of digits does, and runs are taken whole: linear on any text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT, _WORD, _DIGITS = re.compile("[0-9@]"), re.compile(r"[^\x20\x09-\x0D]+"), re.compile("[^0-9]")
#: A word from its beginning on, and at how many places of a text words are drawn to stand between data written again.
_BEGUN, PLACES = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]+"), 100
_HEX = re.compile("[0-9a-f]+")
_SHAPES = ((re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile("[^\x00-\x7f]+"), "w"), (re.compile("[0-9]"), "9"))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each @ the longest local part that no match has taken, and the longest domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, follow = at, at + 1
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = follow = m.end()
        at = text.find("@", follow)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in KINDS, then by start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def _shape(word: str) -> str:
    word = word[:48]
    for pattern, letter in _SHAPES:
        word = pattern.sub(letter, word)
    return word


class Graph:
    """Words around candidates: spans, feature rows, chain and skip edges, labels by the base spans."""

    def __init__(self, text: str, base: list[tuple[str, int, int]], plain: bool = False, alike_too: bool = False):
        words = [m.span() for m in _WORD.finditer(text)]
        hint = [bool(_HINT.search(text, a, b)) for a, b in words]
        near = [i for i in range(len(words)) if hint[i] or (i and hint[i - 1]) or (i + 1 < len(words) and hint[i + 1])]
        self.spans = [words[i] for i in near]
        self.hint = np.array([hint[i] for i in near], bool)
        self.label = np.zeros(len(near), np.int8)
        starts = np.array([a for a, _ in self.spans])
        ends = np.array([b for _, b in self.spans])
        for kind, a, b in base:
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
            self.label[lo:hi] = LABELS.index(kind) + 1
        if plain:  # labels only
            return
        self.chain = [(k, k + 1) for k in range(len(near) - 1) if near[k] + 1 == near[k + 1]]
        self.skip, alike = [], defaultdict(list)
        self.features = []
        shapes = [_shape(text[a:b]) for a, b in self.spans]
        for k, (a, b) in enumerate(self.spans):
            word = text[a:b]
            digits = _DIGITS.sub("", word)
            left = shapes[k - 1] if k and near[k - 1] + 1 == near[k] else "^"
            right = shapes[k + 1] if k + 1 < len(near) and near[k] + 1 == near[k + 1] else "$"
            plain = "".join(filter(str.isalnum, word.replace("(at)", "").replace("[at]", ""))).lower()
            before = text[slice(*words[near[k] - 1])].lower()[:24] if near[k] else "^"
            names = ["bias", f"s {shapes[k]}", f"d {min(len(digits), 20)}", f"f {word[0]}", f"e {word[-1]}", f"l {left}", f"r {right}", f"ls {left} {shapes[k]}", f"rs {shapes[k]} {right}", f"p {before}", f"at {'@' in word} {word.count('.')} {word.count('-')}", f"m {min(len(word), 64) // 8} {bool(digits)} {len(digits) == len(word)} {_HEX.search(plain) is not None and _HEX.search(plain)[0] == plain}"]
            self.features.append([zlib.crc32(x.encode()) % WEIGHTS for x in names])
            if hint[near[k]]:
                for key in {plain if len(plain) >= 5 else "", "#" + digits[-7:] if len(digits) >= 7 else ""} - {""}:
                    alike[key].append(k)
        for places in alike.values():
            known = [self.label[k] for k in places if self.label[k]]
            if alike_too and known:  # the same thing written again is the same thing
                self.label[[k for k in places if not self.label[k]]] = known[0]
            self.skip += zip(places, places[1:])


FEATURES = 12


def joined(graphs: list[tuple[np.ndarray, list, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (N, FEATURES), edges (E, 2) and their types (0 chain, 1 skip) of many documents as one graph."""
    features, edges, types, at = [], [], [], 0
    for f, chain, skip in graphs:
        features.append(np.array(f, np.int64).reshape(-1, FEATURES))
        for kind, pairs in enumerate((chain, skip)):
            if len(pairs):
                edges.append(np.array(pairs, np.int64) + at)
                types.append(np.full(len(pairs), kind))
        at += len(features[-1])
    return np.concatenate(features), np.concatenate(edges) if edges else np.zeros((0, 2), np.int64), np.concatenate(types) if types else np.zeros(0, np.int64)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def propagate(unary: np.ndarray, edges: np.ndarray, types: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes (N, L) and edges (E, L, L) by damped loopy belief propagation."""
    n = len(edges)
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pots = np.concatenate([pair[types], pair[types].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    message = np.zeros((2 * n, unary.shape[1]), np.float32)

    def beliefs() -> np.ndarray:
        b = unary.copy()
        np.add.at(b, dst, message)
        return b

    for _ in range(ROUNDS if n else 0):
        new = _log_sum((beliefs()[src] - message[back])[:, :, None] + pots, 1)
        message = 0.3 * message + 0.7 * (new - _log_sum(new, 1)[:, None])
    b = beliefs()
    cavity = b[src] - message[back]
    both = cavity[:n, :, None] + cavity[n:, None, :] + pots[:n]
    both = np.exp(both - both.max((1, 2), keepdims=True))
    p = np.exp(b - b.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), both / both.sum((1, 2), keepdims=True)


class Field:
    """Weights w of the features by label, pair potentials (chain, skip), and the threshold of each label but the first."""

    def __init__(self, params: dict[str, np.ndarray], sure: np.ndarray):
        self.p, self.sure = params, sure

    @classmethod
    def new(cls) -> Field:
        n = len(LABELS) + 1
        return cls({"w": np.zeros((WEIGHTS, n), np.float32), "pair": np.stack([np.zeros((n, n)), 0.5 * np.eye(n)]).astype(np.float32)}, np.ones(n - 1))

    def marginals(self, graphs: list) -> np.ndarray:
        features, edges, types = joined([(g.features, g.chain, g.skip) for g in graphs])
        return propagate(self.p["w"][features].sum(1), edges, types, self.p["pair"])[0]

    def train(self, graphs: list, steps: int) -> None:
        features, edges, types = joined([(g.features, g.chain, g.skip) for g in graphs])
        labels = np.concatenate([g.label for g in graphs])
        adam, n = Adam(self.p, 0.1), len(labels)
        truth = np.eye(len(LABELS) + 1, dtype=np.float32)[labels]
        used, place = np.unique(features, return_inverse=True)
        for _ in range(steps):
            node, edge = propagate(self.p["w"][features].sum(1), edges, types, self.p["pair"])
            gw, own = np.zeros_like(self.p["w"]), np.repeat((node - truth) / n, FEATURES, 0)
            for k in range(gw.shape[1]):
                gw[used, k] = np.bincount(place.ravel(), own[:, k], len(used))
            gw += 1e-4 * self.p["w"]
            gp = 1e-4 * self.p["pair"]
            for kind in (0, 1):
                some = types == kind
                if some.any():
                    gp[kind] += (edge[some].sum(0) - truth[edges[some, 0]].T @ truth[edges[some, 1]]) / n
            adam.update({"w": gw, "pair": gp})

    def taken(self, graph: Graph, marginals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest label of each word, and whether it is sure enough and the word is free."""
        best = marginals.argmax(1)
        sure = np.concatenate([[np.inf], self.sure])[best]
        return best, (marginals.max(1) >= sure) & (graph.label == 0) & graph.hint

    def added(self, text: str, graph: Graph, base: list, marginals: np.ndarray) -> list[tuple[str, int, int]]:
        best, take = self.taken(graph, marginals)
        taken = sorted((a, b) for _, a, b in base)
        out: list[list] = []
        follows = {b: a for a, b in graph.chain}
        last = -1
        for k in np.flatnonzero(take):
            a, b = graph.spans[k]
            while a < b and not (text[a].isalnum() or text[a] == "+"):
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            if a == b:
                continue
            if out and last == follows.get(k) and out[-1][0] == LABELS[best[k] - 1]:
                out[-1][2] = b
            else:
                out.append([LABELS[best[k] - 1], a, b])
            last = k
        return [tuple(x) for x in out if not any(a < x[2] and x[1] < b for a, b in taken)]


def _found(texts: list[str | None], field: Field) -> Iterator[tuple[list, list]]:
    """Base and added spans of each text; graphs are joined up to NODES nodes."""
    held: list = []
    size = 0

    def flush() -> Iterator[tuple[list, list]]:
        graphs = [g for _, _, g in held if g]
        marginals, at = field.marginals(graphs) if graphs else None, 0
        for text, base, graph in held:
            more = []
            if graph:
                more = field.added(text, graph, base, marginals[at : at + len(graph.spans)])
                at += len(graph.spans)
            yield base, more
        held.clear()

    for text in texts:
        some = text and _HINT.search(text)
        base = base_spans(text) if some else []
        graph = Graph(text, base) if some else None
        held.append((text, base, graph))
        size += len(graph.spans) if graph else 0
        if size > NODES or len(held) >= 2000:
            yield from flush()
            size = 0
    yield from flush()


def lesson(text: str) -> tuple[Graph, np.ndarray]:
    """A document to learn from: some of its data is written again at its end, in other forms. And marks of the words no base span covers."""
    rng = random.Random(zlib.crc32(text.encode()))
    base = base_spans(text)
    secrets = [("secret", *m.span(1)) for m in SECRET.finditer(text)]
    words = [m[0] for m in (_BEGUN.search(text, rng.randrange(len(text))) for _ in range(PLACES)) if m]
    words = [w for w in words if not _HINT.search(w)] or ["and"]
    parts, size, more = [text], len(text), []

    def put(x: str) -> None:
        nonlocal size
        parts.append(x)
        size += len(x)

    for kind, a, b in rng.sample(base, len(base)) if rng.random() < 0.7 else []:
        put(" " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + " ")
        form = rng.choice(FORMS[kind])(text[a:b], _DIGITS.sub("", text[a:b]))
        more.append((kind, size, size + len(form)))
        put(form + rng.choice(["", "", ".", ","]))
    for kind, a, b in secrets:
        if rng.random() < 0.5:
            put(" " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + " ")
            more.append((kind, size, size + b - a))
            put(text[a:b])
    put(" " + rng.choice(words))
    text = "".join(parts)
    base = base_spans(text)
    graph = Graph(text, base + [x for x in secrets + more if not any(a < x[2] and x[1] < b for _, a, b in base)], alike_too=True)
    return graph, Graph(text, base, plain=True).label == 0


def _left_out(text: str) -> bool:
    return zlib.crc32(b"left out" + text.encode()) % 10 == 0


def _lessons(batches: Iterator[pa.RecordBatch], left_out: bool) -> Iterator[list]:
    """Lists of lessons of about NODES nodes."""
    held, size = [], 0
    for batch in byte_parts(batches, 0):
        for text in (x.as_py() for x in batch.column(0)):
            if text and _HINT.search(text) and _left_out(text) == left_out:
                held.append(lesson(text))
                size += len(held[-1][0].spans)
                if size > NODES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def trained(docs: DataFrame, field: Field, steps: int) -> Field | None:
    """The field after every task has gone on from it over all its documents, averaged; None if there is nothing to learn from."""
    shape, pair = field.p["w"].shape, field.p["pair"].shape
    schema = "n double, counts binary, weights binary, pair binary"

    def row(n, counts, weights, pairs):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.float64()), *(pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (counts, weights, pairs))], ["n", "counts", "weights", "pair"])

    def part(batches):
        own, n, counts = Field({k: v.copy() for k, v in field.p.items()}, field.sure), 0, np.zeros(WEIGHTS)
        for held in _lessons(batches, False):
            graphs = [g for g, _ in held]
            own.train(graphs, steps)
            n += sum(len(g.spans) for g in graphs)
            counts += np.bincount(np.concatenate([np.ravel(g.features) for g in graphs]), minlength=WEIGHTS)
        if n:
            yield row(n, counts, counts[:, None] * own.p["w"], n * own.p["pair"])

    def total(batches):
        sums = None
        for batch in batches:
            for k in range(batch.num_rows):
                one = [batch["n"][k].as_py(), *(np.frombuffer(batch[c][k].as_py()) for c in ("counts", "weights", "pair"))]
                sums = one if sums is None else [x + y for x, y in zip(sums, one, strict=True)]
        if sums is not None:
            yield row(*sums)

    parts = written(docs.select("text").filter(F.col("text").rlike("[0-9@]")).mapInArrow(part, schema), "pii-parts")
    rows = parts.coalesce(8).mapInArrow(total, schema).collect()
    if not rows:
        return None
    n, counts, weights, pairs = (sum(f(r) for r in rows) for f in (lambda r: r["n"], *(lambda r, c=c: np.frombuffer(bytes(r[c])) for c in ("counts", "weights", "pair"))))
    met = counts[:, None] > 0
    w = np.where(met, weights.reshape(shape) / np.maximum(counts[:, None], 1), field.p["w"])
    return Field({"w": w.astype(np.float32), "pair": (pairs / n).reshape(pair).astype(np.float32)}, field.sure)


def fitted(docs: DataFrame, precision: float = PRECISION) -> Field:
    """The field and its thresholds; with nothing to learn from, one that adds nothing."""
    field = Field.new()
    for steps in STEPS:
        field = trained(docs, field, steps)
        if field is None:
            return Field.new()

    def judged(batches):
        for held in _lessons(batches, True):
            marginals, at = field.marginals([g for g, _ in held]), 0
            found = np.zeros((len(LABELS), 101, 2), np.int64)
            for g, free in held:
                p = marginals[at : at + len(g.spans)]
                at += len(g.spans)
                best = p.argmax(1)
                some = (best > 0) & free & g.hint
                np.add.at(found, (best[some] - 1, (p.max(1)[some] * 100).astype(int), (g.label[some] == best[some]).astype(int)), 1)
            kind, step, right = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (kind, step, right, found[kind, step, right])], ["kind", "step", "right", "n"])

    rows = docs.select("text").filter(F.col("text").rlike("[0-9@]")).mapInArrow(judged, "kind long, step long, right long, n long")
    counts = np.zeros((len(LABELS), 101, 2))
    for r in rows.groupBy("kind", "step", "right").agg(F.sum("n").alias("n")).collect():
        counts[r["kind"], r["step"], r["right"]] = r["n"]
    above = counts[:, ::-1].cumsum(1)[:, ::-1]  # words at or above each step
    good = (above[:, :, 1] >= precision * above.sum(2)) & (above[:, :, 1] > 0) & (np.arange(101) >= 50)
    field.sure = np.where(good.any(1), good.argmax(1) / 100, np.where(counts.sum((1, 2)) > 0, np.inf, SURE))
    return field


def _joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (LABELS.index(x[0]), x[1], x[2])))


def _digests(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans", "secrets"]
    for batch in byte_parts(batches, 1):
        rows = list(_found([x.as_py() for x in batch.column(1)], field))
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
        sha = pa.array([hashlib.sha256(_joined_spans(base).encode()).hexdigest() for base, _ in rows], pa.string())
        kinds = [(base, [x for x in more if x[0] in KINDS]) for base, more in rows]
        spans = pa.array([_joined_spans(base + more) for base, more in kinds], pa.string())
        sums = [pa.array(x, pa.int64()) for x in ([len(more) for _, more in kinds], [len(base) + len(more) for base, more in kinds])]
        secrets = pa.array([_joined_spans([x for x in more if x[0] not in KINDS]) for _, more in rows], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, spans, *sums, secrets], names)


def digest(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """One row a document: counts and digest of the base spans, all spans of the four kinds, and the credentials in a column of their own."""
    field = fitted(docs, precision)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _digests(it, field), "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long, n_spans long, secrets string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping spans, one mask for their union."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked_documents(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """docs with every span masked."""
    field, kinds = fitted(docs, precision), dict(docs.dtypes)
    j = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_parts(batches, j):
            texts = [x.as_py() for x in batch.column(j)]
            out = [masked(t, base + more) if base or more else t for t, (base, more) in zip(texts, _found(texts, field), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == j else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns))
