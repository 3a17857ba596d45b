"""Turn reassembly, ranked search and token files against brute force on small fixtures with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerlark.llm import ranked, turns, wavelet
from ledgerlark.llm.bpe import vocabulary_path

TURNS = "conv_id long, turn long, role string, text string, batch string, first long, conv string, kind string"


def conversation_rows():
    rng = random.Random(11)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(-2, 0), rng.randint(1, 12)):
            if rng.random() < 0.9:
                rows.append((conv, turn, rng.choice(["user", "assistant", None, "a|b"]), rng.choice([None, "", f"text {conv} {turn} é😀", "b|c"])))
    rows += rows[::3]  # repeats
    rows += [(r[0], r[1], "assistant", f"another {r[0]}") for r in rows[::5]]
    rows += [(7, t, "user" if t % 3 else "assistant", f"long {t}") for t in range(-1500, 2600)]  # over several pieces
    rows += [(8, t, "user", "x" * 50_000) for t in (5, 7, 9000)]
    rows += [(None, 1, "user", "no conversation"), (None, 2, None, None), (3, None, "user", "no turn"), (9, 2**63 - 1, "user", "far"), (9, -(2**63), "user", "near")]
    return rows


def expected_events(rows):
    arriving, first = defaultdict(dict), {}
    for conv, turn, role, text in rows:
        if turn is None:
            continue
        role, text = role or "", text or ""
        first[conv] = min(first.get(conv, turn), turn)
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        for batch, r in [(h % 10, role)] + [((h + 5) % 10, "user")] * (h % 7 < 2):
            found = (f"{r}|{text}".encode(), r)
            arriving[batch][conv, turn] = min(arriving[batch].get((conv, turn), found), found)
    kept, open_, closed, seen, out = defaultdict(dict), set(), set(), {}, []
    released = defaultdict(set)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def close(conv, batch):
        closed.add(conv)
        open_.discard(conv)
        mine = kept[conv]
        rest = ",".join(str(t) for t in sorted(mine) if t not in released[conv])
        missing = max(mine) - first[conv] + 1 - len(mine)
        out.append(("close", conv, -1, batch, sha(rest.encode()), missing if missing < 2**63 else None, sum(t - 1 in mine and mine[t - 1][1] == mine[t][1] for t in mine)))

    for batch in range(10):
        for (conv, turn), (load, role) in arriving[batch].items():
            if conv in closed:
                out.append(("reject", conv, turn, batch, sha(load), None, None))
            else:
                open_.add(conv)
                seen[conv] = batch
                kept[conv].setdefault(turn, (load, role))
        for conv in open_:
            turn = first[conv]
            while turn in kept[conv]:
                if turn not in released[conv]:
                    released[conv].add(turn)
                    out.append(("release", conv, turn, batch, sha(kept[conv][turn][0]), None, None))
                turn += 1
        for conv in [c for c in open_ if seen[c] <= batch - 2]:
            close(conv, batch)
    for conv in list(open_):
        close(conv, 10)
    return sorted(out, key=repr)


def test_turns(spark):
    rows = conversation_rows()
    table = spark.createDataFrame([(*r, "b", 1, "c", "k") for r in rows], TURNS)
    df = turns.digest(table)
    assert dict(df.dtypes) == {"event": "string", "conv_id": "bigint", "turn": "bigint", "batch": "bigint", "sha256": "string", "n_missing": "bigint", "n_breaks": "bigint"}
    assert sorted(map(tuple, df.select("event", "conv_id", "turn", "batch", "sha256", "n_missing", "n_breaks").collect()), key=repr) == expected_events(rows)


def test_turns_of_nothing(spark):
    assert turns.digest(spark.createDataFrame([], TURNS)).count() == 0


def test_turns_keep_their_texts(spark):
    table = spark.createDataFrame([(1, 0, "user", "hello|there"), (1, 1, None, "x")], "conv_id long, turn long, role string, text string")
    found = {(r.turn, r.role, r.text) for r in turns.reassembled(table).filter("event = 'release'").collect()}
    assert found <= {(0, "user", "hello|there"), (1, "", "x"), (1, "user", "x")} and {t for t, *_ in found} == {0, 1}


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_ranks(docs, items, k):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i].update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, b in bags:
            m = 50 + (50 * sum(b.values()) * len(bags)) // total
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def ranked_rows():
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)] + ["É", "é", "naïve", "x9", "A", "a"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", "-B", "_"]) for _ in range(rng.randint(1, 120)))) for i in range(700)]
    docs += [(5, docs[6][1]), (6, docs[6][1]), (None, docs[8][1]), (900, None), (901, ""), (902, "?! --"), (903, "zebra " * 30_000 + "x" * 100_000), (904, "zebra"), (905, " nbsp zebra")]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(25)] + [(3, "zebra"), (3, "zebra"), (None, "ZEBRA w1"), (50, None), (51, "..."), (52, "nowhereatall"), (53, docs[6][1])]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_ranked(spark, k):
    docs, items = ranked_rows()
    table = spark.createDataFrame([(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, n long, score long, ids string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, item int")
    df = ranked.ranked(table, asked, k=k)
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, df.collect()), key=repr) == expected_ranks(docs, items, k)


def test_ranked_in_blocks_and_of_nothing(spark, monkeypatch):
    docs, items = ranked_rows()
    monkeypatch.setattr(ranked, "TERMS", 40)
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, ranked.ranked(table, asked, k=5).collect()), key=repr) == expected_ranks(docs, items, 5)
    assert ranked.ranked(table.limit(0), asked).count() == ranked.ranked(table, asked.limit(0)).count() == 0


def test_search_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    n, v = 4000, 60
    bags = [np.flatnonzero(rng.random(v) < 0.05 + 0.9 * (np.arange(v) / v) ** 3) for _ in range(n)]
    bounds, terms = np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.concatenate(bags)
    tfs = rng.integers(1, 4, len(terms))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in np.bincount(terms, minlength=v)], np.int64)
    index = ranked.Index(np.arange(n), rng.integers(5, 80, n), bounds, terms, tfs, weights, n, int(tfs.sum()))
    calls, plain = [], index.completed
    index.completed = lambda some, asked: calls.append(len(some)) or plain(some, asked)
    for _ in range(30):
        item = np.sort(rng.choice(v, 8, replace=False))
        asked = np.zeros(v, bool)
        asked[item] = True
        whole = plain(np.arange(n), asked)
        some, scores = index.best(item, asked, 10)
        least = np.sort(whole)[-10]
        assert set(np.flatnonzero((whole >= least) & (whole > 0))) <= set(some.tolist()) and (whole[some] == scores).all()
    assert calls and max(calls) < n / 4


def token_rows():
    texts = ["Hello world", "", None, " leading", "trailing ", "two  spaces\n\n and\tmore ", "it's we'll 123 4 !? ...", "é漢字 😀 naïve", "a<|endoftext|> b", "\x1c odd \x85 blanks here", "word " * 40_000 + "\n" + "y" * 70_000, "　ideographic 　 space", "x\n y \n z"]
    return [(i * 3, t) for i, t in enumerate(texts * 3)] + [(4, "again"), (4, "and again"), (None, "no id"), (12, "same"), (12, "same")]


def library_ids(texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(vocabulary_path())
    return [e.ids + [2] for e in coder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_files(spark):
    rows = token_rows()
    table = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, start long, path string").coalesce(1)
    manifest = wavelet.written_shards(table, shard_bytes=50_000)
    assert manifest.count() > 2
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))  # stable: repeated ids stay in order
    expected, start, every = [], 0, []
    for (i, _), ids in zip(ordered, library_ids([t for _, t in ordered])):
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    df = wavelet.documents_of(manifest)
    assert dict(df.dtypes) == {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == expected
    found = wavelet.occurrences(manifest, [2, 1573, 50_256, 60_000, 70_000]).groupBy("token").count().collect()
    assert {r[0]: r[1] for r in found} == {t: every.count(t) for t in (2, 1573, 50_256)}
    assert wavelet.digest(table.limit(0)).count() == 0


def test_rank_and_select(tmp_path):
    rng = np.random.default_rng(5)
    for n, levels in ((1, 16), (700, 3), (600_000, 16)):
        ids = (rng.zipf(1.2, n) % (1 << levels)).astype(np.uint16)
        path = tmp_path / f"{n}.wm"
        path.write_bytes(wavelet.file_bytes(ids, levels, [1, None], np.array([0, n // 2, n])))
        shard = wavelet.Shard(str(path))
        assert (shard.tokens() == ids).all() and shard.doc_ids == [1, None]
        for i in rng.integers(0, n, 20).tolist():
            assert shard.access(i) == ids[i]
            token, lo = int(ids[i]), i // 2
            places = np.flatnonzero(ids == token)
            assert shard.count(token, lo, i) == (ids[lo:i] == token).sum() and (shard.occurrences(token) == places).all()
            assert shard.select(token, len(places) - 1) == places[-1] and shard.select(token, len(places)) is None
