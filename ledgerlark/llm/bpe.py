"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a byte-to-text state machine.

Encoding. The text is cut into pre-tokens, which merges never cross. Inside one, the transducer holds a buffer of bytes.
A merge list has a sufficient lookahead: so many bytes after a token's end that nothing further right can change the
token. Once the buffer holds more than that, the tokens whose lookahead is already read are stable: they are
emitted and leave the buffer, which starts again at a token border (the merges on the two sides of a border of the
result are independent). So memory is constant however long a pre-token is.

The lookahead. Token v, at the time just before a merge of rank r, depends on what follows it in two ways: a merge of
(v, z) of rank below r would take it away, which depends on z in the same way before that merge's rank; or v's last part
could have been taken by a still earlier merge before v was formed. Ranks fall along each chain, so one pass over the
merges in order of rank, with the longest extension so far of every left part, gives the bound.

Decoding. The tokens' bytes run through UTF-8's incremental decoder, which keeps at most three bytes of state and gives
U+FFFD for each maximal ill-formed part.

Null is the empty text and has no tokens; the decoded text is then empty. Empty tables give an empty result, and extra
columns are ignored. Repeated rows are encoded as often as they occur. `added` strings (special tokens) are matched
before all else, leftmost first and longest first.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bytescan import byte_parts

#: The public pre-tokenizer pattern of the vocabulary file: a fixed value.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Anything that some definition takes for white space: cuts keep clear of it.
_BLANK = r"\s\x1c-\x1f\x85"
_UNSAFE = re.compile(rf"[{_BLANK}] | [{_BLANK}]|\A | \Z")
_CUT = re.compile(rf"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")
BLOCK, CACHE = 1 << 16, 400_000


def safe_cut() -> re.Pattern:
    """Where every pre-tokenization has a border: a space between two characters that are not blank."""
    return _CUT


@functools.cache
def blanks() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{_BLANK}]", c))


def byte_letters() -> dict[str, int]:
    """The letter by which the vocabulary file writes each byte -> the byte: visible Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """Tokens by id, merges as (left id, right id) -> (rank, id), and the sufficient lookahead in bytes."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[int, int, int]], added: dict[str, int]):
        self.bytes_of = {i: b for b, i in vocab.items()}
        self.single = [vocab.get(bytes([b])) for b in range(256)]
        self.rank = {(a, b): rank for rank, (a, b, _) in reversed(list(enumerate(merges)))}
        self.made = [c for _, _, c in merges]
        self.added = added
        self.table = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for i, b in self.bytes_of.items():
            self.table[i] = b
        for text, i in added.items():
            self.table[i] = text.encode()
        self.lookahead = self._lookahead(merges)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        raw = {t: bytes(letters[ch] for ch in t) for t in spec["model"]["vocab"]}
        vocab = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(vocab[raw[a]], vocab[raw[b]], vocab[raw[a] + raw[b]]) for a, b in pairs]
        return cls(vocab, merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    def _lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        taken: dict[int, int] = {}  # by left part: longest extension of its merges so far
        formed: dict[int, int] = {}  # by token: extension on which its forming depends
        most = 0
        for a, b, c in merges:
            beyond = max(taken.get(b, 0), formed.get(b, 0))
            formed[c] = max(formed.get(c, 0), beyond)
            taken[a] = max(taken.get(a, 0), len(self.bytes_of[b]) + beyond)
            most = max(most, taken[a], formed[c])
        return most

    def merged(self, ids: list[int]) -> list[int]:
        """ids with all merges made, least rank first, leftmost first."""
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), none)
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), none)
        return ids


class Encoder:
    """The transducer: push bytes of a pre-token, get the ids that became stable; finish gives the rest."""

    def __init__(self, vocabulary: Vocabulary, window: int = 512):
        self.v, self.buffer, self.window = vocabulary, b"", max(window, 2 * vocabulary.lookahead)

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.window):
            self.buffer += data[at : at + self.window]
            if len(self.buffer) > self.window:
                stable, end = [], 0
                for i in self.v.merged([self.v.single[b] for b in self.buffer]):
                    end += len(self.v.bytes_of[i])
                    if end + self.v.lookahead > len(self.buffer):
                        end -= len(self.v.bytes_of[i])
                        break
                    stable.append(i)
                out += stable
                self.buffer = self.buffer[end:]
        return out

    def finish(self) -> list[int]:
        ids = self.v.merged([self.v.single[b] for b in self.buffer])
        self.buffer = b""
        return ids

    def word(self, data: bytes) -> list[int]:
        return self.push(data) + self.finish()


class _Words(dict):
    """Ids, packed as little-endian 32 bits, of a space and the key; a full cache starts anew."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead, self.parts = encoder, lead, {}

    def __missing__(self, word: str) -> bytes:
        found = []
        for part in PATTERN.findall(self.lead + word):
            packed = self.parts.get(part)
            if packed is None:
                packed = np.array(self.encoder.word(part.encode()), "<u4").tobytes()
                if len(part) < 64:
                    if len(self.parts) >= CACHE:
                        self.parts.clear()
                    self.parts[part] = packed
            found.append(packed)
        out = b"".join(found)
        if len(word) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


class Codec:
    """Whole texts to packed ids, block by block, and back."""

    def __init__(self, path: str):
        self.v = Vocabulary.load(path)
        encoder = Encoder(self.v)
        self.first, self.later = _Words(encoder, ""), _Words(encoder, " ")
        special = sorted(self.v.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _blocks(self, text: str) -> Iterator[str]:
        """Parts that start where every pre-tokenization has a border: at a space between two other characters."""
        at = 0
        while len(text) - at > BLOCK:
            cut = _CUT.search(text, at + BLOCK)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        if at < len(text):
            yield text[at:] if at else text

    def _plain(self, text: str) -> Iterator[bytes]:
        for block in self._blocks(text):
            lead = block[0] == " " and block is not text
            inner = block[1:] if lead else block
            words = _CUT.split(inner) if _UNSAFE.search(inner) else inner.split(" ")
            yield (self.later if lead else self.first)[words[0]]
            later = self.later
            yield b"".join([later[w] for w in words[1:]])

    def encode(self, text: str) -> Iterator[bytes]:
        """Packed ids, a part at a time."""
        if not text:
            return
        if self.special and any(s in text for s in self.v.added):
            for k, part in enumerate(self.special.split(text)):
                if k % 2:
                    yield np.array([self.v.added[part]], "<u4").tobytes()
                elif part:
                    yield from self._plain(part)
        else:
            yield from self._plain(text)

    def decode(self, parts: Iterable[bytes]) -> Iterator[str]:
        machine, table = codecs.getincrementaldecoder("utf-8")("replace"), self.v.table
        for part in parts:
            yield machine.decode(b"".join([table[i] for i in np.frombuffer(part, "<u4").tolist()]))
        yield machine.decode(b"", True)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Passing:
    """Parts on their way from the encoder to the decoder: counted and hashed, none kept."""

    def __init__(self, parts: Iterable[bytes]):
        self.parts, self.sha, self.n = parts, hashlib.sha256(), 0

    def __iter__(self) -> Iterator[bytes]:
        for part in self.parts:
            self.sha.update(part)
            self.n += len(part) // 4
            yield part


def _digests(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in byte_parts(batches, 1):
        counts, first, second = [], [], []
        for text in batch.column(1):
            passing, back = _Passing(coder.encode(text.as_py() or "")), hashlib.sha256()
            for piece in coder.decode(passing):
                back.update(piece.encode())
            counts.append(passing.n)
            first.append(passing.sha.hexdigest())
            second.append(back.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = codec(path)
    for batch in byte_parts(batches, 1):
        ids, texts = [], []
        for text in batch.column(1):
            packed = b"".join(coder.encode(text.as_py() or ""))
            ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            texts.append("".join(coder.decode([packed])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encoded(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids array<int>, decoded: the real outputs."""
    where = path or vocabulary_path()
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(lambda it: _encoded(it, where), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, by the same transducer and state machine."""
    where = path or vocabulary_path()
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(lambda it: _digests(it, where), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
