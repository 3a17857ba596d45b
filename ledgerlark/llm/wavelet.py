"""Token ids in succinct shard files: one wavelet matrix a shard, compressed, with rank and select.

Documents are ranged by doc_id in Spark; a partition is a shard. Its task encodes the texts, appends the end id to each and
writes one file to the shared folder: bit-planes of the matrix, from the highest bit, in compressed chunks, the number of
ones before each chunk, and the documents' ids and starts. A file counts when the manifest, a table written by the same job, names
it: a task that is lost leaves at most a file that nothing names. `Shard` reads only the chunks that a question needs: the
token at a place, how often a token stands before a place, its j-th occurrence, all its occurrences; or all tokens, by undoing
the planes from the lowest bit.

Null and empty texts are the end id alone. Rows that repeat a doc_id stand in the order of the input; null ids stand first. A
very long text is read whole and stays in one shard, which grows with it. An empty table gives no shard and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import array
import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import BLOCK, blanks, byte_letters, safe_cut, vocabulary_path
from .bytescan import byte_parts
from .store import shared_folder, written

#: Bytes of text in a shard, about; bytes of a plane's chunk; known words of a worker; shards whose sizes are summed in one group.
SHARD, CHUNK, CACHE, GROUP = 32 << 20, 1 << 15, 800_000, 4096
#: Words that go to the library in one text.
JOINED = 512
#: Marks that end a word and are a piece of their own after letters.
MARKS = ".,;:!?"
END = 2
MAGIC = b"WMX1"
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)


class Tokens:
    """Ids of whole texts by the tokenizers library, which sees every distinct word once while it is known.

    A text is cut at spaces between two characters that are not blank; there every pre-tokenization has a border, and the
    space goes with what follows.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.levels = max(1, (self.library.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.code = "H" if self.levels <= 16 else "I"
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.sizes = np.zeros(1 << self.levels, np.int64)  # bytes of each token: a letter each
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.sizes[i] = len(token)
        # where a run of letters after a space is a piece of its own, written with a letter a byte
        spec = json.loads(self.library.to_str())
        cut = spec.get("pre_tokenizer") or {}
        self.plain = spec["model"].get("type") == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.letters = {b: c for c, b in byte_letters().items()}
        self.marks, self.line = dict(zip(MARKS, self._packed(list(MARKS)))), self._packed(["\n"])[0]
        self.heads: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def _packed(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.code, found.ids).tobytes() for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, known: dict[str, bytes], lead: str, words: set[str]) -> None:
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(words)
        if lead:
            new = self._lettered(known, new) if self.plain else new
            known.update(zip(new, self._together(new)))
        else:
            known.update(zip(new, self._packed(new)))

    def _lettered(self, known: dict[str, bytes], words: list[str]) -> list[str]:
        """Learns words of Latin letters, with a mark at the end or not, or two such with a line's end between them. The other words.

        Every run of letters is a piece of its own: the library's model takes it as it is.
        """
        tokenize, letters, marks, code, others = self.library.model.tokenize, self.letters, self.marks, self.code, []

        def piece(held: dict[str, bytes], lead: str, word: str) -> bytes | None:
            mark = marks.get(word[-1])
            stem = word[:-1] if mark else word
            if not stem.isalpha() or not (stem.isascii() or max(stem) < "\u0250"):
                return None
            ids = held.get(stem)
            if ids is None:
                raw = stem if stem.isascii() else stem.encode().decode("latin-1").translate(letters)
                ids = array.array(code, [t.id for t in tokenize(lead + raw)]).tobytes()
            return ids + mark if mark else ids

        for w in words:
            ids = piece(known, letters[32], w)
            if ids is None and "\n" in w:
                left, right = w.split("\n", 1)
                above, below = piece(known, letters[32], left), piece(self.heads, "", right)
                ids = above + self.line + below if above and below else None
            if ids is None:
                others.append(w)
            else:
                known[w] = ids
        return others

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space. Words go to the library many to a text, as there is a border before each space, and are told apart by their bytes."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            text = f" {' '.join(some)}"
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.code)
            sizes = map(len, some) if text.isascii() else [len(w.encode()) for w in some]
            upto, ends = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(some)) + 1)
            cuts = np.searchsorted(upto, ends)
            if len(upto) and cuts[-1] < len(upto) and (upto[cuts] == ends).all():
                data, width = ids.tobytes(), ids.itemsize
                cuts = [0, *((cuts + 1) * width).tolist()]
                out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
            else:  # a vocabulary whose tokens do not say their bytes
                out += self._packed([" " + w for w in some])
        return out

    def packed(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, packed as little-endian integers."""
        for text in texts:
            if any(s in text for s in self.special):
                yield self._packed([text])[0]
            else:
                yield b"".join(self._blocks(text))

    def _blocks(self, text: str) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            cut = safe_cut().search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = cut.start() if cut else len(text)
            inner = text[at + 1 : end] if at else text[:end]
            words = inner.split(" ")
            first, rest = ([], words) if at else (words[:1], words[1:])
            found = [*map(self.heads.get, first), *map(self.later.get, rest)]
            if not all(found):
                # what begins or ends with a blank is not kept: only at a text's ends is it a piece of its own
                blank, gaps = blanks(), [i for i, ids in enumerate(found) if not ids]
                edge = lambda w: not w or w[0] in blank or w[-1] in blank
                if any([edge(words[i]) for i in gaps]):
                    words = safe_cut().split(inner)
                    first, rest = ([], words) if at else (words[:1], words[1:])
                    edges = set(filter(edge, words))
                    self._learn(self.heads, "", set(first) - edges)
                    self._learn(self.later, " ", set(rest) - edges)
                    found = [self._packed([w])[0] if w in edges else self.heads[w] for w in first] + [self._packed([" " + w])[0] if w in edges else self.later[w] for w in rest]
                else:
                    if first and gaps[0] == 0:
                        self._learn(self.heads, "", {words[0]})
                        found[0] = self.heads[words[0]]
                        del gaps[0]
                    self._learn(self.later, " ", {words[i] for i in gaps})
                    for i in gaps:
                        found[i] = self.later[words[i]]
            yield b"".join(found)
            at = end


@functools.cache
def tokens(path: str) -> Tokens:
    """One for each worker and vocabulary."""
    return Tokens(path)


def matrix(ids: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """Planes of packed bits from the highest, and the number of zeros in each. Zeros go first, in order, then ones."""
    planes, zeros = [], []
    for level in range(levels - 1, -1, -1):
        bit = (ids & ids.dtype.type(1 << level)) != 0
        planes.append(np.packbits(bit))
        ones = np.flatnonzero(bit)
        later = np.empty_like(ids)
        z = len(ids) - len(ones)
        ids.take(ones, out=later[z:], mode="clip")
        del ones
        ids.take(np.flatnonzero(~bit), out=later[:z], mode="clip")
        zeros.append(z)
        ids = later
    return planes, zeros


def file_bytes(ids: np.ndarray, levels: int, names: list[int | None], starts: np.ndarray) -> bytes:
    """A shard's file: MAGIC, the header's length, the header as JSON, then the sections it names by place and size."""
    body: list[bytes] = []
    size = 0

    def section(data: bytes) -> list[int]:
        nonlocal size
        packed = pa.compress(data, codec="zstd", asbytes=True)
        body.append(packed)
        size += len(packed)
        return [size - len(packed), len(packed), len(data)]

    planes, zeros = matrix(ids, levels)
    layout = []
    for plane in planes:
        ones = np.add.reduceat(_ONES[plane], np.arange(0, len(plane), CHUNK), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        layout.append({"chunks": [section(plane[at : at + CHUNK].tobytes()) for at in range(0, len(plane), CHUNK)], "ones": np.cumsum(ones).tolist()})
    known = np.array([x is not None for x in names], bool)
    header = {
        "n": len(ids), "levels": levels, "zeros": zeros, "planes": layout, "docs": len(names), "ids": section(np.array([x or 0 for x in names], "<i8").tobytes()),
        "known": section(np.packbits(known).tobytes()), "starts": section(starts.astype("<i8").tobytes()),
    }
    head = json.dumps(header, separators=(",", ":")).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *body])


class Shard:
    """One file, of which only what is asked is read."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        begin = self.file.read_at(8, 0)
        if begin[:4] != MAGIC:
            raise ValueError(f"{path} is no shard")
        size = int.from_bytes(begin[4:8], "little")
        head = json.loads(self.file.read_at(size, 8))
        self.base, self.n, self.levels, self.zeros, self.planes = 8 + size, head["n"], head["levels"], head["zeros"], head["planes"]
        known = np.unpackbits(np.frombuffer(self._section(head["known"]), np.uint8), count=head["docs"])
        self.doc_ids = [x if ok else None for x, ok in zip(np.frombuffer(self._section(head["ids"]), "<i8").tolist(), known.tolist())]
        self.starts = np.frombuffer(self._section(head["starts"]), "<i8")
        self._bits = functools.lru_cache(maxsize=64)(self._read_bits)

    def close(self) -> None:
        self.file.close()

    def _section(self, place: list[int]) -> bytes:
        return pa.decompress(self.file.read_at(place[1], self.base + place[0]), decompressed_size=place[2], codec="zstd", asbytes=True) if place[2] else b""

    def _read_bits(self, level: int, chunk: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self._section(self.planes[level]["chunks"][chunk]), np.uint8))

    def _before(self, level: int, i: int) -> int:
        """Ones in the plane before place i."""
        chunk, rest = divmod(i, CHUNK * 8)
        ones = self.planes[level]["ones"]
        return (ones[chunk - 1] if chunk else 0) + (int(self._bits(level, chunk)[:rest].sum()) if rest else 0)

    def _places(self, level: int, bit: int, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted-th ones or zeros of a plane, counted from 0."""
        ones = np.array([0, *self.planes[level]["ones"]], np.int64)
        upto = ones if bit else np.minimum(np.arange(len(ones)) * CHUNK * 8, self.n) - ones
        chunks = np.searchsorted(upto, wanted, "right") - 1
        out = np.empty(len(wanted), np.int64)
        for chunk in np.unique(chunks).tolist():
            some = chunks == chunk
            out[some] = chunk * CHUNK * 8 + np.flatnonzero(self._bits(level, chunk) == bit)[wanted[some] - upto[chunk]]
        return out

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for level, z in enumerate(self.zeros):
            chunk, rest = divmod(i, CHUNK * 8)
            bit, ones = int(self._bits(level, chunk)[rest]), self._before(level, i)
            token, i = token << 1 | bit, z + ones if bit else i - ones
        return token

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences among places lo to hi stand below the last plane."""
        if token >> self.levels:
            return 0, 0
        for level, z in enumerate(self.zeros):
            a, b = self._before(level, lo), self._before(level, hi)
            lo, hi = (z + a, z + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the token stands at places lo to hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the token's occurrences number first to last, counted from 0."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a + first, b if last is None else min(b, a + last))
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._places(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, token: int, j: int) -> int | None:
        """The place of the token's occurrence number j, counted from 0."""
        found = self.occurrences(token, j, j + 1)
        return int(found[0]) if len(found) else None

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            packed = b"".join(self._section(c) for c in self.planes[level]["chunks"])
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n).view(bool)
            above, z = np.empty(self.n, kind), self.zeros[level]
            above[np.flatnonzero(~bit)] = ids[:z]
            above[np.flatnonzero(bit)] = ids[z:]
            ids = above
            ids |= bit.astype(kind) << kind(self.levels - 1 - level)
        return ids


def _shards(batches: Iterator[pa.RecordBatch], path: str, folder: str, end: int) -> Iterator[pa.RecordBatch]:
    coder = tokens(path)
    last, names, sizes, held = array.array(coder.code, [end]).tobytes(), [], [], []
    kind = np.dtype(f"<u{len(last)}")
    for batch in byte_parts(batches, 1):
        names += batch.column(0).to_pylist()
        packed = [ids + last for ids in coder.packed([x or "" for x in batch.column(1).to_pylist()])]
        sizes += [len(ids) // len(last) for ids in packed]
        held.append(b"".join(packed))
    if names:
        ids = np.frombuffer(b"".join(held), kind)
        held.clear()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        number = TaskContext.get().partitionId()
        name = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.wm"
        system, inner = fs.FileSystem.from_uri(name)
        with system.open_output_stream(inner) as out:
            out.write(file_bytes(ids, coder.levels, names, starts))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([name]), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])


def written_shards(docs: DataFrame, path: str | None = None, shard_bytes: int = SHARD, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The manifest: shard, path, n_docs, n_tokens and offset, the number of tokens in all shards before."""
    spark, where = docs.sparkSession, path or vocabulary_path()
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    folder = folder if ":/" in folder else f"file://{folder}"
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1])
    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = plain.withColumn("mid", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-size // shard_bytes)), "doc_id", "mid")
    shards = ranged.sortWithinPartitions("doc_id", "mid").select("doc_id", "text").mapInArrow(lambda it: _shards(it, where, folder, end), "shard long, path string, n_docs long, n_tokens long")
    shards = written(shards, "tokens-manifest").withColumn("group", F.floor(F.col("shard") / GROUP))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = shards.groupBy("group").agg(F.sum("n_tokens").alias("n_tokens"))
    groups = groups.select("group", before(Window.orderBy("group")).alias("earlier"))  # a row for 4,096 shards
    inside = shards.withColumn("inside", before(Window.partitionBy("group").orderBy("shard")))
    return inside.join(groups, "group").select("shard", "path", "n_docs", "n_tokens", (F.col("earlier") + F.col("inside")).alias("offset"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Shard]]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"])
            yield row, shard
            shard.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, shard in _opened(batches):
        ids, crcs = shard.tokens(), []
        for a, b in zip(shard.starts[:-1].tolist(), shard.starts[1:].tolist()):
            crcs.append(zlib.crc32(ids[a:b].astype("<u4").tobytes()))
        starts = pa.array(shard.starts[:-1] + row["offset"], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), starts, pa.array(np.diff(shard.starts), pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _found(batches: Iterator[pa.RecordBatch], wanted: list[int]) -> Iterator[pa.RecordBatch]:
    for row, shard in _opened(batches):
        for token in wanted:
            at = shard.occurrences(token)
            doc = np.searchsorted(shard.starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), token, np.int64)), pa.array([shard.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array(at - shard.starts[doc], pa.int64())], ["token", "doc_id", "place"])


def _dealt(manifest: DataFrame) -> DataFrame:
    """A shard a task, about: shards are equal in size."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "offset", "shard").repartition(parts, "shard")


def documents_of(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files."""
    return _dealt(manifest).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, wanted: list[int]) -> DataFrame:
    """token, doc_id, place of every occurrence of some tokens: read by rank and select, not by decoding the shards."""
    return _dealt(manifest).mapInArrow(lambda it: _found(it, wanted), "token long, doc_id long, place long")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    return documents_of(written_shards(docs, path))
