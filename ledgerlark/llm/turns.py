r"""Conversation turns put back in order by a stateful stream: hash buckets with a timing wheel.

One stateful query, started anew for each batch on its one checkpoint. Its state is keyed by hash buckets, whose number follows
the input, so that a bucket stays small. There are two kinds:

* *Turns.* A conversation's turns are dealt by pieces, ranges of `PIECE` numbers, so one that holds a third of all rows is
  spread over many buckets. A bucket keeps one bit a turn, which tells first arrivals from repeats. Texts pass through.
* *Conversations.* They get one short row a piece and batch, with the turns that came. A bucket holds its conversations' generation,
  the end of what is released and the turns ahead of it, and a timing wheel: a slot a batch. An arrival in batch b
  raises the generation and files the conversation in slot b + `quiet`; older entries stay where they are and are void, as their
  generation is. A tick visits the due slot alone and closes the conversations whose entry is valid. The final tick
  closes all others. A closed conversation leaves its name; what comes later is late. A conversation of t turns is
  t / PIECE rows here, of a bit a turn.

The query writes each turn as it came (kept or repeated), how far each batch released in a conversation, late batches and
closes: at most two rows a conversation and batch. `events` joins them.

Null turns are dropped. Null role and text are empty; a null conv_id is a conversation of its own. Of rows with one turn
in one batch the one with the smallest role|text arrives; of equal ones with different roles, the smaller role. Repeated rows
are repeats. Very long texts are passed on whole. An empty table gives no event; other columns are ignored. Numbers that
do not fit a long (missing turns of a conversation from -2^63 to 2^63) are null. The digest of a close is one string of all
unreleased turn numbers by the contract, so these numbers, and nothing else, meet in one row a conversation.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from .store import shared_folder, written

#: Turn numbers in a piece, as a power of two; conversations and rows in a bucket, and rows in a batch's file, about.
PIECE_BITS, CONVERSATIONS, ROWS, FILE = 10, 2048, 16_384, 2_000_000
PIECE = 1 << PIECE_BITS
#: The contract's batches, and those without an arrival that close a conversation.
BATCHES, QUIET = 10, 2

_FED = "kind string, bucket long, conv string, turn long, first long, role string, text string, turns array<bigint>, batch long"
_OUT = "kind string, conv string, turn long, upto long, first long, role string, text string, batch long, fresh boolean"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, quiet: int) -> Iterator[pd.DataFrame]:
    return _turns(frames, state) if key[0] < 0 else _conversations(frames, state, quiet)


def _turns(frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State of a bucket: (conversation, piece) -> bits of the turns that have come."""
    bits: dict[tuple[str, int], int] = pickle.loads(state.get[0]) if state.exists else {}
    for frame in frames:
        fresh = []
        for conv, turn in zip(frame.conv, frame.turn.tolist()):
            at, bit = (conv, turn >> PIECE_BITS), 1 << (turn & (PIECE - 1))
            known = bits.get(at, 0)
            fresh.append(not (known & bit))
            bits[at] = known | bit
        yield pd.DataFrame({"kind": "turn", "conv": frame.conv, "turn": frame.turn, "upto": 0, "first": frame["first"], "role": frame.role, "text": frame.text, "batch": frame.batch, "fresh": fresh})
    state.update((pickle.dumps(bits),))


class _Conversation:
    """Its generation, the first turn not released, and bits of the turns that came, by piece, from there on."""

    __slots__ = ("generation", "end", "ahead")

    def __init__(self, first: int):
        self.generation, self.end, self.ahead = 0, first, {}

    def add(self, turns: list[int]) -> None:
        piece, bits = turns[0] >> PIECE_BITS, 0
        for turn in turns:
            bits |= 1 << (turn & (PIECE - 1))
        if piece >= self.end >> PIECE_BITS:
            self.ahead[piece] = self.ahead.get(piece, 0) | bits

    def release(self) -> None:
        while (piece := self.end >> PIECE_BITS) in self.ahead:
            missing = ~(self.ahead[piece] >> (self.end & (PIECE - 1)))
            self.end += (missing & -missing).bit_length() - 1
            if self.end >> PIECE_BITS == piece:  # the piece has a gap
                break
            del self.ahead[piece]


def _conversations(frames: Iterator[pd.DataFrame], state: GroupState, quiet: int) -> Iterator[pd.DataFrame]:
    """State of a bucket: its conversations by name, None when closed, and the wheel."""
    held: dict[str, _Conversation | None]
    wheel: dict[int, list[tuple[str, int]]]
    held, wheel = pickle.loads(state.get[0]) if state.exists else ({}, {})
    now, final, ticked = 0, False, False
    arrived, out = {}, []
    for frame in frames:
        now = int(frame.batch.iloc[0])
        for kind, conv, first, turns in zip(frame.kind, frame.conv, frame["first"].tolist(), frame.turns):
            if kind != "piece":
                ticked, final = True, kind == "end"
            elif held.setdefault(conv, _Conversation(first)) is None:
                arrived[conv] = None
            else:
                arrived.setdefault(conv, held[conv].end)
                held[conv].add(turns.tolist())
    for conv, begin in arrived.items():
        if (one := held[conv]) is None:
            out.append(("late", conv, 0, 0))
            continue
        one.generation += 1
        wheel.setdefault(now + quiet, []).append((conv, one.generation))
        one.release()
        if one.end > begin:
            out.append(("run", conv, begin, one.end - 1))
    due = wheel.pop(now, []) if ticked else []
    if final:
        due = [(conv, one.generation) for conv, one in held.items() if one]
        wheel.clear()
    for conv, generation in due:
        if (one := held[conv]) and one.generation == generation:
            held[conv] = None
            out.append(("close", conv, 0, 0))
    if arrived or due:
        state.update((pickle.dumps((held, wheel)),))
    if out:
        kinds, convs, turns, ends = zip(*out)
        yield pd.DataFrame({"kind": kinds, "conv": convs, "turn": turns, "upto": ends, "first": 0, "role": "", "text": "", "batch": now, "fresh": False})


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """conv, turn, first, role, text, batch: what arrives in which batch by the contract's hash, a row a turn and batch."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    some = conversations.filter("turn is not null").select(conv.alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "conv", F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long")
    once = F.struct((h % batches).alias("batch"), F.col("role"))
    again = F.struct(((h + batches // 2) % batches).alias("batch"), F.lit("user").alias("role"))
    dealt = some.withColumn("go", F.explode(F.when(h % 7 < 2, F.array(once, again)).otherwise(F.array(once)))).select("conv", "turn", "go.batch", "go.role", "text")
    least = dealt.groupBy("conv", "turn", "batch").agg(F.min(F.struct(payload("role", "text").alias("payload"), "role")).alias("p"))
    firsts = some.groupBy("conv").agg(F.min("turn").alias("first"))
    # a conversation's rows meet its one row; AQE splits a large one's side of the join
    found = least.join(firsts, "conv")
    return found.select("conv", "turn", "first", "p.role", F.substring(F.col("p.payload"), F.length("p.role") + 2, F.length("p.payload")).alias("text"), "batch")


def payload(role: str, text: str) -> Column:
    return F.concat_ws("|", role, text)


def streamed(arriving: DataFrame, batches: int = BATCHES, quiet: int = QUIET) -> DataFrame:
    """Feeds batches 0, 1, ... and the end, each to a newly started query; returns what it wrote."""
    spark = arriving.sparkSession
    folder = f"{shared_folder(spark)}/turns-{uuid.uuid4().hex}"
    zero, no = F.lit(0).cast("long"), F.lit("")
    arriving = written(arriving, "turns")
    sizes = arriving.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("conv").alias("convs")).first()
    own, all_ = -(-sizes["rows"] // ROWS) or 1, -(-sizes["convs"] // CONVERSATIONS) or 1
    piece = F.shiftright("turn", PIECE_BITS)
    rows = arriving.select(F.lit("turn").alias("kind"), (-1 - F.pmod(F.xxhash64("conv", piece), F.lit(own))).alias("bucket"), "conv", "turn", "first", "role", "text", F.array().cast("array<bigint>").alias("turns"), "batch")
    short = arriving.groupBy("conv", "first", "batch", piece.alias("piece")).agg(F.collect_list("turn").alias("turns"))
    pieces = short.select(F.lit("piece").alias("kind"), F.pmod(F.xxhash64("conv"), F.lit(all_)).alias("bucket"), "conv", zero.alias("turn"), "first", no.alias("role"), no.alias("text"), "turns", "batch")
    files = F.pmod(F.xxhash64("conv", "turn"), F.lit(-(-sizes["rows"] // FILE) or 1))  # few files a batch, none small but the last
    rows.unionByName(pieces).repartition("batch", files).write.partitionBy("batch").parquet(f"{folder}/arriving")
    ready = spark.read.schema(_FED).parquet(f"{folder}/arriving")
    for batch in range(batches + 1):
        kind, now = F.lit("end" if batch == batches else "tick").alias("kind"), F.lit(batch).cast("long").alias("batch")
        ticks = spark.range(0, all_, 1, -(-all_ // ROWS)).select(kind, F.col("id").alias("bucket"), no.alias("conv"), zero.alias("turn"), zero.alias("first"), no.alias("role"), no.alias("text"), F.array().cast("array<bigint>").alias("turns"), now)
        ready.filter(F.col("batch") == batch).unionByName(ticks).write.mode("append").parquet(f"{folder}/fed")
        fed = spark.readStream.schema(_FED).parquet(f"{folder}/fed").groupBy("bucket")
        out = fed.applyInPandasWithState(lambda k, it, s: _step(k, it, s, quiet), _OUT, "held binary", "append", "NoTimeout")
        out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{folder}/out")


def events(out: DataFrame) -> DataFrame:
    """event, conv, turn, batch, role, text of every release and reject; closes have n_missing, n_breaks and the unreleased turns."""
    passed, said = out.filter("kind = 'turn'"), out.filter("kind <> 'turn'")
    run = F.when(F.col("kind") == "run", F.struct("upto", "batch"))
    # a conversation has a run a batch at most, so these arrays are short
    convs = said.groupBy("conv").agg(F.collect_list(run).alias("runs"), F.max(F.when(F.col("kind") == "close", F.col("batch"))).alias("closed"))
    reached = F.array_min(F.transform(F.filter("runs", lambda r: r["upto"] >= F.col("turn")), lambda r: r["batch"]))
    turns = passed.join(convs, "conv").select("conv", "turn", "first", "batch", "role", "text", "closed", (F.col("fresh") & (F.col("batch") <= F.col("closed"))).alias("kept"), reached.alias("released"))
    kept, no_text = turns.filter("kept"), F.lit(None).cast("string")
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("n_missing", "long"), ("n_breaks", "long"), ("unreleased", "array<bigint>"))]
    rejects = turns.filter(F.col("batch") > F.col("closed")).select(F.lit("reject").alias("event"), "conv", "turn", "batch", "role", "text", *none)
    releases = kept.filter("released is not null").select(F.lit("release").alias("event"), "conv", "turn", F.col("released").alias("batch"), "role", "text", *none)
    narrow = kept.select("conv", "turn", "role")
    before = narrow.select("conv", F.try_add("turn", F.lit(1)).alias("turn"), "role").filter("turn is not null")
    breaks = narrow.join(before, ["conv", "turn", "role"]).groupBy("conv").agg(F.count(F.lit(1)).alias("n_breaks"))
    wide = lambda c: c.cast("decimal(38,0)")
    missing = wide(F.max("turn")) - wide(F.min("first")) + 1 - F.count(F.lit(1))
    counted = kept.groupBy("conv").agg(F.max("closed").alias("batch"), missing.alias("missing"), F.sort_array(F.collect_list(F.when(F.col("released").isNull(), F.col("turn")))).alias("unreleased"))
    closes = counted.join(breaks, "conv", "left").select(F.lit("close").alias("event"), "conv", F.lit(-1).cast("long").alias("turn"), "batch", no_text.alias("role"), no_text.alias("text"), F.col("missing").try_cast("long").alias("n_missing"), F.coalesce("n_breaks", F.lit(0)).cast("long").alias("n_breaks"), "unreleased")
    return releases.unionByName(rejects).unionByName(closes)


def reassembled(conversations: DataFrame) -> DataFrame:
    """Every event with its texts."""
    return events(streamed(arrivals(conversations)))


def digest(conversations: DataFrame) -> DataFrame:
    """event, conv_id, turn, batch, sha256, n_missing, n_breaks."""
    said = F.when(F.col("event") == "close", F.array_join(F.col("unreleased").cast("array<string>"), ",")).otherwise(payload("role", "text"))
    return reassembled(conversations).select("event", F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), "turn", "batch", F.sha2(said, 256).alias("sha256"), "n_missing", "n_breaks")


ORACLE = """
WITH r AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS conv, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
x AS (SELECT *, ('0x' || substr(sha256(conv || ':' || turn::VARCHAR), 1, 8))::BIGINT AS h FROM r),
a AS (
  SELECT conv_id, conv, turn, h % 10 AS batch, role, role || '|' || text AS payload FROM x
  UNION ALL SELECT conv_id, conv, turn, (h + 5) % 10, 'user', 'user|' || text FROM x WHERE h % 7 < 2),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv, turn, batch ORDER BY payload, role) = 1),
g AS (SELECT conv, batch, lead(batch) OVER (PARTITION BY conv ORDER BY batch) AS later FROM (SELECT DISTINCT conv, batch FROM b)),
c AS (SELECT conv, min(CASE WHEN batch + 2 <= 9 THEN batch + 2 ELSE 10 END) AS closed FROM g WHERE later IS NULL OR later - batch >= 3 GROUP BY conv),
f AS (SELECT conv, min(turn) AS first FROM r GROUP BY conv),
k AS (SELECT b.*, closed FROM b JOIN c USING (conv) WHERE batch <= closed QUALIFY row_number() OVER (PARTITION BY conv, turn ORDER BY batch) = 1),
s AS (
  SELECT k.*, first, turn - first = row_number() OVER w - 1 AS run, max(batch) OVER w AS released, lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role AS breaks
  FROM k JOIN f USING (conv) WINDOW w AS (PARTITION BY conv ORDER BY turn))
SELECT 'release' AS event, conv_id, turn, released::BIGINT AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM s WHERE run
UNION ALL SELECT 'reject', conv_id, turn, batch::BIGINT, sha256(payload), NULL, NULL FROM b JOIN c USING (conv) WHERE batch > closed
UNION ALL SELECT 'close', max(conv_id), -1, max(closed)::BIGINT, sha256(coalesce(string_agg(CASE WHEN NOT run THEN turn::VARCHAR END, ',' ORDER BY turn), '')),
  (max(turn) - min(first) + 1 - count(*))::BIGINT, count(*) FILTER (WHERE breaks)::BIGINT FROM s GROUP BY conv
"""
