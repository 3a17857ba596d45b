"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes, one cell forwards and one backwards, and labels every position; a document's
probabilities are the mean over all its positions, over the whole text. So that one long text is not one long chain of steps,
both cells start anew every `WINDOW` positions, but `LEAD` positions earlier, whose labels do not count: by then the
state is that of the running text but for what it would have forgotten (texts of two minds, in no language that was
learned, may be judged otherwise than by one long chain). It is trained in numpy by
backpropagation through time on a bounded sample: at most `per_lang` documents of each language (PER_LANG), of each a
few snippets, chosen by a hash of the id among the documents that have a language and are not held out.

Null texts and texts without a letter are `und` with score 0, as is every text if there is nothing to learn from. Null or
repeated ids only change which rows are sampled. Ties between languages go to the first by name. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import byte_parts, text_buffer
from .gru import Adam, backward, forward, lanes_step, summed_rows

HIDDEN, WINDOW, LEAD, PER_LANG, SNIPPET = 12, 512, 32, 1000, 256
PIECE = 16  # steps whose probabilities are made at once, in the processor's cache
_LETTER = re.compile(r"[^\W\d_]")
_PAD = 256


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> tuple[list, dict[str, int]]:
    """Rows lang, snippets for training, by language at most about per_lang documents, spread by a hash of the id; and all documents by language.

    Every non-null lang value is trained, however rare; what is gathered grows with their number.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 5) != 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return [], {}
    place = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text")), F.lit(1_000_000))
    share = docs.sparkSession.createDataFrame([(lang, int(1_000_000 * min(1.0, per_lang / n))) for lang, n in counts.items()], "lang string, share int")
    rows = rows.select("doc_id", "text", "lang").join(F.broadcast(share), "lang")
    at = lambda k: F.substring("text", (F.pmod(F.xxhash64(F.lit(k), F.col("doc_id")), F.greatest(F.char_length("text") - SNIPPET, F.lit(1))) + 1).cast("int"), F.lit(SNIPPET))
    return rows.filter(place < F.col("share")).select("lang", F.array(at(1), at(2), at(3)).alias("snippets")).orderBy("lang", "snippets").limit(2 * per_lang * len(counts)).collect(), counts


class Network:
    def __init__(self, langs: list[str], params: dict[str, np.ndarray]):
        self.langs, self.p = langs, params

    @classmethod
    def trained(cls, rows: list, counts: dict[str, int], steps: int = 700, batch: int = 160, width: int = 64, seed: int = 3) -> Network | None:
        by = {}
        for r in sorted(rows, key=lambda r: (r["lang"], r["snippets"])):
            by.setdefault(r["lang"], []).extend(x.encode() for x in r["snippets"] if x)
        by = {k: v for k, v in by.items() if v}
        if not by:
            return None
        langs, rng, k = sorted(by), np.random.default_rng(seed), HIDDEN
        n = len(langs)
        often = np.sqrt([counts[x] for x in langs])
        p = {"xf": 0.3 * rng.standard_normal((257, 3 * k)), "xb": 0.3 * rng.standard_normal((257, 3 * k)), "uf": rng.standard_normal((k, 3 * k)) / np.sqrt(k), "ub": rng.standard_normal((k, 3 * k)) / np.sqrt(k), "of": 0.3 * rng.standard_normal((k, n)), "ob": 0.3 * rng.standard_normal((k, n)), "c": np.zeros((1, n))}
        p = {a: b.astype(np.float32) for a, b in p.items()}
        adam = Adam(p, 0.02)
        for s in range(steps if n > 1 else 0):
            y = rng.choice(n, batch, p=often / often.sum())
            x = np.full((width, batch), _PAD, np.int64)
            for i, lang in enumerate(y):
                raw = by[langs[lang]][rng.integers(len(by[langs[lang]]))]
                cut = int(rng.integers(0, max(len(raw) - width, 0) + 1))
                part = np.frombuffer(raw[cut : cut + width], np.uint8)
                x[: len(part), i] = part
            real = (x != _PAD).astype(np.float32)
            zero = np.zeros((batch, k), np.float32)
            hf, kf = forward(p["xf"][x], zero, p["uf"])
            hb, kb = forward(p["xb"][x[::-1]], zero, p["ub"])
            logits = hf @ p["of"] + hb[::-1] @ p["ob"] + p["c"]
            prob = np.exp(logits - logits.max(-1, keepdims=True))
            prob /= prob.sum(-1, keepdims=True)
            d = prob
            d[:, np.arange(batch), y] -= 1
            d = (d * real[:, :, None] / real.sum()).astype(np.float32)
            dxf, duf = backward(d @ p["of"].T, kf, p["uf"])
            dxb, dub = backward((d @ p["ob"].T)[::-1], kb, p["ub"])
            flat = x.ravel()
            adam.update({"xf": summed_rows(flat, dxf.reshape(-1, 3 * k), 257), "xb": summed_rows(x[::-1].ravel(), dxb.reshape(-1, 3 * k), 257), "uf": duf, "ub": dub, "of": np.einsum("tbk,tbn->kn", hf, d), "ob": np.einsum("tbk,tbn->kn", hb[::-1], d), "c": d.sum((0, 1))[None]}, 1.0 if s < 0.7 * steps else 0.2)
        return cls(langs, p)

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Bytes (T, B), padded -> probabilities (T, languages, B) of every position."""
        p, k, lanes = self.p, HIDDEN, x.shape[1]
        out = np.empty((len(x), len(self.langs), lanes), np.float32)
        xg, gates, gn, h, after, one = (np.empty((rows, lanes), np.float32) for rows in (3 * k, 3 * k, k, k, k, len(self.langs)))
        for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            table, down, top = (np.ascontiguousarray(p[name + side].T) for name in "xuo")
            h[:] = 0
            for t in order:
                table.take(x[t], axis=1, out=xg, mode="clip")
                lanes_step(xg, h, down, gates, gn, after)
                h, after = after, h
                if side == "f":
                    np.matmul(top, h, out=out[t])
                else:
                    h *= x[t] != _PAD  # a text begins, from its end, with no state
                    out[t] += np.matmul(top, h, out=one)
        for t in range(0, len(x), PIECE):
            part = out[t : t + PIECE]
            part += p["c"].T
            part -= part.max(1, keepdims=True)
            np.exp(part, out=part)
            part /= part.sum(1, keepdims=True)
        return out

    def documents(self, data: np.ndarray, off: np.ndarray, window: int = 0, lead: int = LEAD) -> np.ndarray:
        """Mean probabilities over all positions of each text; zeros for the empty text."""
        window, sizes = window or WINDOW, np.diff(off)
        n = -(-sizes // window)
        owner = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = off[owner] + nth * window
        ends = np.minimum(starts + window, off[owner + 1])
        before, after = np.maximum(starts - lead, off[owner]), np.minimum(ends + lead, off[owner + 1])
        order = np.argsort(before - after, kind="stable")  # windows of one length together
        out = np.zeros((len(sizes), len(self.langs)))
        lanes = int(np.clip(4_000_000 // ((min(window, int(sizes.max(initial=1))) + 2 * lead) * len(self.langs)), 16, 2048))
        for some in (order[k : k + lanes] for k in range(0, len(order), lanes)):
            place = before[some][None] + np.arange(int((after[some] - before[some]).max()))[:, None]
            x = np.where(place < after[some][None], data[np.minimum(place, len(data) - 1)].astype(np.int64), _PAD)
            counts = (place >= starts[some][None]) & (place < ends[some][None])
            prob = np.einsum("tlb,tb->bl", self.positions(x), counts.astype(np.float32))
            np.add.at(out, owner[some], prob)
        return out / np.maximum(sizes, 1)[:, None]


def _has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def _labelled(batches: Iterator[pa.RecordBatch], network: Network | None, i: int = 1) -> Iterator[tuple[pa.RecordBatch, list, np.ndarray]]:
    """Parts of the batches (texts in column i), the language and the score of each row."""
    for batch in byte_parts(batches, i):
        texts = batch.column(i)
        langs = ["und"] * len(texts)
        scores = np.zeros(len(texts))
        if network and len(texts):
            data, off = text_buffer(texts)
            prob = network.documents(data, off)
            best = prob.argmax(1)
            for k in range(len(texts)):
                if _has_letter(texts[k].as_py()):
                    langs[k], scores[k] = network.langs[best[k]], min(1.0, float(prob[k, best[k]]))
        yield batch, langs, scores


def identified(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    network = Network.trained(*sample(docs, per_lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, scores in _labelled(batches, network):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def digest(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    return identified(docs, per_lang).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.4, per_lang: int = PER_LANG) -> DataFrame:
    """docs without those that are `und` or whose best language has a mean probability under `least`; lang is the language found."""
    network = Network.trained(*sample(docs, per_lang))
    kinds = dict(docs.dtypes)

    i, j = docs.columns.index("text"), docs.columns.index("lang")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, scores in _labelled(batches, network, i):
            keep = pa.array([a != "und" and s >= least for a, s in zip(langs, scores, strict=True)], pa.bool_())
            columns = [pa.array(langs, pa.string()) if k == j else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(keep)

    return docs.mapInArrow(judged, ", ".join(f"`{c}` {kinds[c]}" for c in docs.columns))
