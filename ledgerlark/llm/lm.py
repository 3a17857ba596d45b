"""Scoring of whole documents by a gated recurrent language model with a class-factored softmax.

1. One pass cuts the documents into blocks of some megabytes; a block holds its documents as codes of its own dictionary.
   The dictionaries alone are shuffled, once by word for the counts over all training documents and once back to
   their blocks: a word moves once a block, however often it occurs.
2. Classes: the `WORDS` most frequent words by frequency, `PER_CLASS` to a class, with a softmax of their own inside;
   every other word belongs to the class of its shape (ending, letters, digits, length) and has there the probability
   (c + 0.1) / (N_class + 0.1 * (V_class + 1)) by the counts of all training documents, unseen words together counting as one;
   the end of a document is a class of its own.
3. The network is trained in numpy by truncated backpropagation through time, states carried from window to window, and
   on every training document, whole. It warms up on the driver on `sample_size` of them. Then all training documents go by a hash of
   id and content into parts of about PART_WORDS words, each part goes on from the warm weights over its documents in a fixed
   order, and the weights are averaged by words. Parts depend on the documents alone, not on files, partitions or tasks, and every size
   of table takes the same steps. What is counted (c, N, V, classes) covers all training documents too.
4. Scoring runs whole documents side by side in lanes, window after window, the state carried on: a score is the
   log10 probability of the whole text and its end.

Null texts are empty: only the end is scored. Without training documents the counts are 0 and the network is untrained.
Very long texts are read whole, in memory proportional to their words. Ties between
equally frequent words go to the lesser word. A null or repeated doc_id is scored like any other row; a null id counts as the empty text for the split. Empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import U64, doc_groups, give_back, hashed, mixed, slices, spans, text_buffer
from .gru import Adam, dealt, lanes_backward, lanes_forward, lanes_step, summed_rows
from .langid import remainder
from .store import small_batches, written

WORDS, PER_CLASS, SHAPES, HIDDEN = 2048, 64, 64, 24
SAMPLE, PART_WORDS, BLOCK_BYTES, LANES, STEPS = 1500, 2_000_000, 16 << 20, 512, 32
PIECE = 2048  # positions whose classes are scored at once, in the processor's cache
START = WORDS + SHAPES  # the input before the first word
GROUPS = WORDS // PER_CLASS
END = GROUPS + SHAPES  # the class of the end
_TAIL = np.zeros(256, np.int64)
_TAIL[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 45, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 3
_TAIL[[ord(c) for c in ".!?"]] = 1
_TAIL[[ord(c) for c in ",;:"]] = 2


def block_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words (A-Z lower-cased), starts and ends of one occurrence of each code, and the texts' bounds among the words.

    Frequent words get small codes. Each slice has its own codes first, so only the slices' dictionaries are ever sorted together.
    """
    kinds, codes, s, e, bounds, n = [np.zeros(0, U64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(off), np.int64), 0
    for lo, hi in slices(data, off):
        starts, ends = spans(data, off, lo, hi)
        found = pa.array(hashed(data, lo, hi, starts, ends, True)).dictionary_encode()
        kind, code = found.dictionary.to_numpy(), found.indices.to_numpy()
        first = np.empty(len(kind), np.int64)
        first[code] = np.arange(len(code))
        kinds.append(kind)
        codes.append(code + np.int32(n))
        s.append(starts[first] + lo)
        e.append(ends[first] + lo)
        n += len(kind)
        bounds += np.searchsorted(starts + lo, off)
    _, first, code = np.unique(np.concatenate(kinds), return_index=True, return_inverse=True)
    code = code.astype(np.int32)
    codes = [code[x] for x in codes]
    count = sum(np.bincount(x, minlength=len(first)) for x in codes)
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    first = first[order]
    return np.concatenate([place[x] for x in codes]), np.concatenate(s)[first], np.concatenate(e)[first], bounds


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The shape class, below SHAPES, of each word."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order = np.argsort(starts, kind="stable")  # so that the pieces between the words are no longer than the text
    pairs, wide, digit = np.stack([starts[order], ends[order]], 1).ravel(), np.empty(len(starts), bool), np.empty(len(starts), bool)
    wide[order] = np.logical_or.reduceat(np.append(data >= 128, False), pairs)[::2]
    digit[order] = np.logical_or.reduceat(np.append((data >= 48) & (data <= 57), False), pairs)[::2]
    size = np.searchsorted([4, 7, 11], ends - starts, "right")
    return ((_TAIL[data[ends - 1]] * 2 + wide) * 2 + digit) * 4 + size


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Per block one row: ids, held-out marks, word counts and codes of its documents; words, shapes and training counts of its dictionary."""
    number, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        data, off = text_buffer(batch.column(2))
        for a, b in doc_groups(off, limit):
            own, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
            code, starts, ends, bounds = block_words(own, at)
            held = batch.column(1).slice(a, b - a)
            train = np.repeat(~np.array(held.to_pylist(), bool), np.diff(bounds))
            counts = sum((np.bincount(code[k : k + 1_000_000][train[k : k + 1_000_000]], minlength=len(starts)) for k in range(0, len(code), 1_000_000)), np.zeros(len(starts), np.int64))
            words = [own[x:y].tobytes().lower() for x, y in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + number], pa.int64()), *(pa.array([x], t) for x, t in (
                    (batch.column(0).slice(a, b - a).to_pylist(), pa.list_(pa.int64())), (held.to_pylist(), pa.list_(pa.bool_())), (np.diff(bounds), pa.list_(pa.int64())), (code, pa.list_(pa.int32())),
                    (words, pa.list_(pa.binary())), (shapes(own, starts, ends).astype(np.int32), pa.list_(pa.int32())), (counts, pa.list_(pa.int64())),
                ))], ["block", "ids", "held", "sizes", "codes", "words", "shapes", "counts"])
            number += 1
            give_back()


def _exps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (classes, N) made, in place, exponentials less each column's largest; the largest and the sums of the columns."""
    most = x.max(0)
    x -= most
    np.exp(x, out=x)
    return most, x.sum(0)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the frequent words by their class, and the GROUPS + 1 bounds of the classes among these."""
    order = np.argsort(group.astype(np.int16), kind="stable")
    cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
    return order[: cuts[-1]], cuts


class Model:
    """Input tables x, recurrent u, class outputs (oc, bc), word outputs by class (ow, bw)."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def new(cls, counts: np.ndarray, class_counts: np.ndarray, seed: int = 9) -> Model:
        """Biases start at the logarithms of the counts."""
        rng, k = np.random.default_rng(seed), HIDDEN
        p = {"x": 0.3 * rng.standard_normal((START + 1, 3 * k)), "u": rng.standard_normal((k, 3 * k)) / np.sqrt(k), "oc": 0.05 * rng.standard_normal((k, END + 1)), "bc": np.log(class_counts + 0.1)[None], "ow": 0.05 * rng.standard_normal((GROUPS, k, PER_CLASS)), "bw": np.log(counts + 0.1).reshape(GROUPS, PER_CLASS)}
        return cls({a: b.astype(np.float32) for a, b in p.items()})

    def train(self, texts: list[np.ndarray], rounds: int = 4, lanes: int = 64) -> None:
        """texts: ids of whole documents. Lanes read documents one after another; a window's gradient stops at its start.

        The last lane is filled up with steps that have no target (-2), so no word is left out.
        """
        total = sum(len(t) + 1 for t in texts)
        lanes = max(1, min(lanes, total // STEPS))
        adam, k, rng = Adam(self.p, 0.01), HIDDEN, np.random.default_rng(1)
        for turn in range(rounds if texts else 0):
            x, y = [], []
            for i in rng.permutation(len(texts)):
                x += [[START], texts[i]]
                y += [texts[i], [-1]]
            x, y = np.concatenate(x).astype(np.int64), np.concatenate(y).astype(np.int64)
            long = -(-len(x) // lanes)
            fill = long * lanes - len(x)
            x = np.append(x, np.full(fill, START)).reshape(lanes, long).T
            y = np.append(y, np.full(fill, -2)).reshape(lanes, long).T
            h = np.zeros((k, lanes), np.float32)
            for at in range(0, long, STEPS):
                xs, ys = x[at : at + STEPS], y[at : at + STEPS].ravel()
                out, kept = lanes_forward(self.p["x"].T.take(xs, axis=1).swapaxes(0, 1), h, self.p["u"])  # across a border the state goes on; START tells it
                h = out[-1]
                flat, n = out.transpose(0, 2, 1).reshape(-1, k), np.float32(max(1, int((ys > -2).sum())))
                group = np.where(ys < 0, END, np.where(ys < WORDS, ys // PER_CLASS, ys - WORDS + GROUPS))
                grads = {name: np.zeros_like(self.p[name]) for name in ("oc", "bc", "ow", "bw")}
                back, real = np.empty_like(flat), (ys > -2) / n
                for a in range(0, len(ys), PIECE):
                    near, own, counts = flat[a : a + PIECE], group[a : a + PIECE], real[a : a + PIECE]
                    d = self.p["oc"].T @ near.T
                    d += self.p["bc"].T
                    _, sums = _exps(d)
                    d *= counts / sums
                    d[own, np.arange(len(own))] -= counts
                    grads["oc"] += near.T @ d.T
                    grads["bc"] += d.sum(1)
                    np.matmul(d.T, self.p["oc"].T, out=back[a : a + PIECE])
                some, cuts = _by_class(group)
                near, inner, added = flat[some], ys[some] % PER_CLASS, np.empty((len(some), k), np.float32)
                for c in np.flatnonzero(np.diff(cuts)):
                    a, b = cuts[c], cuts[c + 1]
                    e = self.p["ow"][c].T @ near[a:b].T
                    e += self.p["bw"][c][:, None]
                    _, sums = _exps(e)
                    e *= 1 / (n * sums)
                    e[inner[a:b], np.arange(b - a)] -= 1 / n
                    grads["ow"][c], grads["bw"][c] = near[a:b].T @ e.T, e.sum(1)
                    added[a:b] = e.T @ self.p["ow"][c].T
                back[some] += added
                dx, du = lanes_backward(back.reshape(len(xs), lanes, k).transpose(0, 2, 1), kept, self.p["u"])
                grads |= {"x": summed_rows(xs.ravel(), dx.transpose(0, 2, 1).reshape(-1, 3 * k), START + 1), "u": du}
                adam.update({a: b.astype(np.float32) for a, b in grads.items()}, 1.0 if turn < rounds - 1 else 0.3)

    def log10(self, states: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the class and, for the frequent words, of the word in it; target: id, or -1 for the end."""
        group = np.where(target < 0, END, np.where(target < WORDS, target // PER_CLASS, target - WORDS + GROUPS))
        out = np.empty(len(target))
        for at in range(0, len(target), PIECE):
            near, own = states[at : at + PIECE], group[at : at + PIECE]
            x = self.p["oc"].T @ near.T
            x += self.p["bc"].T
            hit = x[own, np.arange(len(own))]
            most, sums = _exps(x)
            out[at : at + PIECE] = hit - most - np.log(sums)
        order, cuts = _by_class(group)
        near, inner = states[order], target[order] % PER_CLASS
        for c in np.flatnonzero(np.diff(cuts)):
            for a in range(cuts[c], cuts[c + 1], PIECE):
                b = min(a + PIECE, cuts[c + 1])
                x = self.p["ow"][c].T @ near[a:b].T
                x += self.p["bw"][c][:, None]
                hit = x[inner[a:b], np.arange(b - a)]
                most, sums = _exps(x)
                out[order[a:b]] += hit - most - np.log(sums)
        return out / np.log(10)

    def documents(self, ids: np.ndarray, sizes: np.ndarray, lanes: int = LANES, window: int = 64) -> np.ndarray:
        """Sum of log10 for each document; ids are the documents' words end to end."""
        n = len(sizes)
        order, ends = dealt(sizes + 1, lanes)
        sizes_, first = sizes[order], (np.cumsum(sizes) - sizes)[order]
        begin = np.cumsum(sizes_ + 1) - sizes_ - 1  # of each document among all steps, lane after lane
        total = int(sizes_.sum()) + n
        starts, lasts = np.zeros(total, bool), np.zeros(total, bool)
        starts[begin], lasts[begin + sizes_] = True, True
        kind = np.int32 if total < 1 << 31 else np.int64
        words = np.repeat((first - (np.cumsum(sizes_) - sizes_)).astype(kind), sizes_)
        words += np.arange(total - n, dtype=kind)
        words = ids[words].astype(np.int32)
        x, y = np.full(total, START, np.int32), np.full(total, -1, np.int32)
        x[~starts], y[~lasts] = words, words
        doc = np.repeat(order.astype(np.int32), sizes_ + 1)
        lane, steps = np.cumsum(ends) - ends, int(ends[0])
        out, h, k = np.zeros(n), np.zeros((HIDDEN, len(ends)), np.float32), HIDDEN
        table, down = np.ascontiguousarray(self.p["x"].T), np.ascontiguousarray(self.p["u"].T)
        for at in range(0, steps, window):
            alive = int(np.searchsorted(-ends, -at))  # lanes that are not over
            h, rows = np.ascontiguousarray(h[:, :alive]), min(window, steps - at)
            place = np.arange(at, at + rows)[:, None] + lane[None, :alive]
            real = (np.arange(at, at + rows)[:, None] < ends[None, :alive]).ravel()
            now = x[np.minimum(place, total - 1)]
            states = np.empty((rows, alive, k), np.float32)
            gates, gn, after = np.empty((3 * k, alive), np.float32), np.empty((k, alive), np.float32), np.empty((k, alive), np.float32)
            for t in range(rows):
                h *= now[t] != START
                lanes_step(table.take(now[t], axis=1), h, down, gates, gn, after)
                h, after = after, h
                states[t] = h.T
            states, place = states.reshape(-1, k), place.ravel()
            if not real.all():
                states, place = states[real], place[real]
            out += np.bincount(doc[place], self.log10(states, y[place]), n)
        return out


def cut(source: DataFrame) -> DataFrame:
    """doc_id, held_out, text -> one row a block."""
    schema = "block long, ids array<long>, held array<boolean>, sizes array<long>, codes array<int>, words array<binary>, shapes array<int>, counts array<long>"
    small_batches(source.sparkSession, f"{BLOCK_BYTES >> 20}m")  # a batch of texts is a block, and a block a batch, whatever the table's size
    return written(source.mapInArrow(lambda it: _blocks(it, BLOCK_BYTES), schema), "lm-blocks", BLOCK_BYTES)


def training_texts(blocks: DataFrame, known: pa.Array) -> DataFrame:
    """place, doc_id, ids of every training document: ids as little-endian 16-bit integers, place a hash of doc_id and ids."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                names = batch["ids"][k].values
                mark = mixed(pc.fill_null(names, 0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) + U64(31))
                held = batch["held"][k].values.to_numpy(zero_copy_only=False).astype(bool)
                rank = pc.fill_null(pc.index_in(batch["words"][k].values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = np.where(rank < 0, np.asarray(batch["shapes"][k].values) + WORDS, rank).astype("<i2")
                sizes, codes = np.asarray(batch["sizes"][k].values), np.asarray(batch["codes"][k].values)
                ends = np.cumsum(sizes)
                some = np.flatnonzero(~held)
                for lot in np.array_split(some, max(1, int(sizes[some].sum()) // 1_000_000)):
                    texts = [ids[codes[ends[i] - sizes[i] : ends[i]]].tobytes() for i in lot]
                    content = np.array([zlib.crc32(t) for t in texts], U64)
                    place = (mixed(mark[lot] + content) >> U64(1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(place), names.take(pa.array(lot)), pa.array(texts, pa.binary())], ["place", "doc_id", "ids"])

    return blocks.select("ids", "held", "sizes", "codes", "words", "shapes").mapInArrow(run, "place long, doc_id long, ids binary")


def trained_in_parts(texts: DataFrame, model: Model, parts: int) -> tuple[Model, int]:
    """The model after every part's documents were learned from its weights, averaged; the words learned.

    A part that holds far more than PART_WORDS (one document many times) is learned piece by piece in the same order.
    """
    form = {name: x.shape for name, x in model.p.items()}
    flat = lambda m: np.concatenate([m.p[name].ravel() for name in form]).astype(np.float64)

    def learn(batches):
        total, learned, part, own, held, size, seen = 0.0, 0, None, None, [], 0, 0

        def piece():
            nonlocal held, size, seen
            if held:
                own.train(held, rounds=1, lanes=256)
                seen += size
                held, size = [], 0
                give_back()

        def close():
            nonlocal total, learned, seen
            piece()
            if seen:
                total, learned, seen = total + seen * flat(own), learned + seen, 0

        for batch in batches:
            for number, ids in zip(batch["part"].to_pylist(), batch["ids"], strict=True):
                if number != part:
                    close()
                    part, own = number, Model({name: x.copy() for name, x in model.p.items()})
                held.append(np.frombuffer(ids.as_buffer(), "<i2"))
                size += len(held[-1]) + 1
                if size > 2 * PART_WORDS:
                    piece()
        close()
        if learned:
            yield pa.RecordBatch.from_arrays([pa.array([learned], pa.int64()), pa.array([(total / learned).tobytes()])], ["n", "weights"])

    def mean(batches):
        total, learned = 0.0, 0
        for batch in batches:
            for n, weights in zip(batch["n"].to_pylist(), batch["weights"], strict=True):
                total, learned = total + n * np.frombuffer(weights.as_buffer(), np.float64), learned + n
        if learned:
            yield pa.RecordBatch.from_arrays([pa.array([learned], pa.int64()), pa.array([(total / learned).tobytes()])], ["n", "weights"])

    placed = texts.select((F.col("place") % parts).alias("part"), "place", "doc_id", "ids")
    made = written(placed.repartition("part").sortWithinPartitions("part", "place", "doc_id", "ids").select("part", "ids").mapInArrow(learn, "n long, weights binary"), "lm-parts")
    rows = made.coalesce(8).mapInArrow(mean, "n long, weights binary").collect()
    learned = sum(r["n"] for r in rows)
    if not learned:
        return model, 0
    weights, at, out = sum(r["n"] * np.frombuffer(bytes(r["weights"]), np.float64) for r in rows) / learned, 0, {}
    for name, shape in form.items():
        size = int(np.prod(shape))
        out[name], at = weights[at : at + size].reshape(shape).astype(np.float32), at + size
    return Model(out), learned


def scored(docs: DataFrame, sample_size: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (remainder(doc_id, 10) == 0).alias("held_out"), F.col(text).alias("text"))
    blocks = cut(source)
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "shapes", "counts")).alias("code", "d")).select("block", "code", F.col("d.words").alias("word"), F.col("d.shapes").alias("shape"), F.col("d.counts").alias("n"))
    # a word has one row a block at most, so no word's window is large
    same = Window.partitionBy("word")
    counted = listed.withColumn("c", F.sum("n").over(same)).withColumn("head", F.col("block") == F.min("block").over(same))
    counted = written(counted.select("block", "code", "word", "shape", "c", "head"), "lm-counts", BLOCK_BYTES)
    heads = counted.filter("head and c > 0")
    by_shape = {r["shape"]: (r["n"], r["v"]) for r in heads.groupBy("shape").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = source.filter(~F.col("held_out")).count()
    total = sum(n for n, _ in by_shape.values()) + ends
    kinds = sum(v for _, v in by_shape.values()) + (ends > 0)
    top = heads.orderBy(F.desc("c"), "word").limit(WORDS).select("word", "shape", "c").collect()
    rank = {bytes(r["word"]): i for i, r in enumerate(top)}
    rest = np.array([by_shape.get(s, (0, 0)) for s in range(SHAPES)], np.float64)
    for r in top:
        rest[r["shape"]] -= (r["c"], 1)
    often = np.array([r["c"] for r in top] + [0] * (WORDS - len(top)), np.float64)
    model = Model.new(often, np.concatenate([often.reshape(GROUPS, PER_CLASS).sum(1), rest[:, 0], [ends]]))
    known = pa.array([bytes(r["word"]) for r in top], pa.binary())
    texts = training_texts(blocks, known)
    warm = texts.orderBy("place", "doc_id", "ids").limit(sample_size).select("ids").collect()
    model.train([np.frombuffer(bytes(r["ids"]), "<i2") for r in warm])
    model, _ = trained_in_parts(texts, model, max(1, -(-total // PART_WORDS)))
    spark = docs.sparkSession
    ranked = spark.createDataFrame([(bytearray(w), i) for w, i in rank.items()], "word binary, rank int")
    back = counted.join(F.broadcast(ranked), "word", "left").select("block", "code", "c", F.coalesce("rank", F.col("shape") + WORDS).alias("id"))
    rest_total = rest[:, 0] + 0.1 * (rest[:, 1] + 1)
    base_total = total + 0.1 * (kinds + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        done = []
        size = right.num_rows
        code = right["code"].to_numpy()
        c, ids = np.empty(size + 1), np.empty(size + 1, np.int32)
        c[code], ids[code] = right["c"].to_numpy(), right["id"].to_numpy()
        inside = np.where(ids[:size] >= WORDS, np.log10((c[:size] + 0.1) / rest_total[np.maximum(ids[:size] - WORDS, 0)]), 0.0)
        base, known = np.log10((c[:size] + 0.1) / base_total), c[:size] > 0
        end = np.log10((ends + 0.1) / base_total)
        for k in range(left.num_rows):
            sizes = np.asarray(left["sizes"][k].values)
            codes = np.asarray(left["codes"][k].values)
            n = len(sizes)
            owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
            total_of = lambda v: np.bincount(owner, v[codes], n) if len(codes) else np.zeros(n)  # noqa: E731, B023
            result = model.documents(ids[codes], sizes) + total_of(inside)
            done.append(pa.table([left["ids"][k].values, left["held"][k].values, pa.array(sizes + 1), pa.array((total_of(known) + (ends > 0)).astype(np.int64)), pa.array(np.full(n, total, np.int64)), pa.array(total_of(base) + end), pa.array(result)], names))
        give_back()
        return pa.concat_tables(done) if done else pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names)

    documents = blocks.select("block", "ids", "held", "sizes", "codes")
    return documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
