"""Mixing sources to target weights by proportionate fair scheduling.

Each source's documents, in a hashed order, form blocks of ``block_rows``. With weight ``w`` the source's block ``k`` (from 0) is
released at slot ``floor(k/w)`` and due by slot ``ceil((k+1)/w)``; in every slot the released block with the earliest deadline
goes next. As the weights add up to one, every deadline is met, so that after any number of slots each
source has had its share to within less than one block. Weights are taken as exact fractions. The schedule repeats after their common denominator's
slots, and at most one such period of a phase is simulated, on the driver (for ``TARGET`` 190 slots, whatever the number of
blocks). Where the denominator is larger than the phase, all the phase's slots are simulated; blocks are doubled until those are at most ``SLOTS``.

No document is dropped or repeated. When a source runs out, a new phase begins in which the others share its
weight in proportion. The first phase is exactly the target mix; ``phase`` tells a reader where it ends.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import numbered, table
from quillgraph.session import Kept

BLOCK_ROWS = 64
BUCKET_ROWS = 4096
#: The driver's plan has a row for each phase and source: half of this number squared at most. More sources raise.
MAX_SOURCES = 1024
#: Slots that the driver simulates for one phase.
SLOTS = 1 << 20
#: Stands for a null source.
NONE = "\x00none"


def exact(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Slots of each source in the shortest period that gives every source exactly its share."""
    parts = {s: w if isinstance(w, Fraction) else Fraction(w).limit_denominator(10**9) or Fraction(w) for s, w in weights.items()}
    total = sum(parts.values())
    period = lcm(*((x / total).denominator for x in parts.values()))
    return {s: int(x / total * period) for s, x in parts.items()}


def one_period(quota: dict[str, int], left: dict[str, int] | None = None, most: int | None = None) -> list[str]:
    """The source that each slot of a period goes to: earliest deadline first among released blocks.

    With ``left`` it ends early with the slot that takes some source's last block. Raises ``OverflowError`` beyond ``most`` slots.
    """
    period, order = sum(quota.values()), sorted(quota)
    done = dict.fromkeys(order, 0)
    waiting, ready, slots, t = [(0, s) for s in order], [], [], 0
    while t < period:
        if t == most:
            raise OverflowError(f"more than {most} slots")
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * period // quota[s]), s))
        _, s = heapq.heappop(ready)
        slots.append(s)
        done[s] += 1
        t += 1
        if left and done[s] == left[s]:
            break
        if done[s] < quota[s]:
            heapq.heappush(waiting, (done[s] * period // quota[s], s))
    return slots


def taken(phase: dict, s: str, slots: int | None = None) -> int:
    """How many blocks a source gets in the first ``slots`` of a phase (all of its length)."""
    whole, rest = divmod(phase["length"] if slots is None else slots, phase["period"])
    places = phase["places"].get(s, [])
    return whole * len(places) + bisect_left(places, rest)


def phases(weights: dict[str, float | Fraction], blocks: dict[str, int], most: int | None = None) -> list[dict]:
    """Each phase: its first block of each source, its period and each source's places in it, how many slots it lasts, its first slot, and the source that runs out.

    A phase ends with the slot that takes some source's last block; one that ends inside its first period has only those slots.
    """
    left, had, at, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        slots = one_period(exact({s: weights[s] for s in left}), left, most)
        period = len(slots)
        places: dict[str, list[int]] = {}
        for t, s in enumerate(slots):
            places.setdefault(s, []).append(t)
        length, last = min(((left[s] - 1) // len(x) * period + x[(left[s] - 1) % len(x)] + 1, s) for s, x in places.items())
        phase = {"first": dict(had), "places": places, "period": period, "length": length, "at": at, "last": last}
        out.append(phase)
        for s in places:
            got = taken(phase, s)
            had[s] += got
            left[s] -= got
            if not left[s]:
                del left[s]
        at += length
    return out


def planned(weights: dict[str, float | Fraction], counts: dict[str, int], block_rows: int) -> tuple[list[tuple], int]:
    """The schedule as rows, and the rows of a block: for each phase and source (source, phase, first block, block after the last, first
    slot, period, places, rows that are missing from the blocks before).
    """
    while True:
        try:
            plan = phases(weights, {s: -(-n // block_rows) for s, n in counts.items()}, SLOTS)
            break
        except OverflowError:
            block_rows *= 2
    rows, missing = [], 0
    for p, x in enumerate(plan):
        rows += [(s, p, x["first"][s], x["first"][s] + taken(x, s), x["at"], x["period"], places, missing) for s, places in x["places"].items()]
        # only a source's last block is short, and it is a phase's last one: positions after it move up
        missing += -counts[x["last"]] % block_rows
    return rows, block_rows


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, carry: bool = False) -> DataFrame:
    """Every row's ``doc_id``, ``source``, ``block`` (of its source), ``phase``, ``slot`` and ``position`` in the mix, from 0.

    ``weights``: target shares by source, positive; without them all sources weigh the same. Every source that is not listed, and the
    null source, has a schedule of its own with the mean weight of those listed. ``carry`` adds the documents' own columns as ``row``.
    A source's last block may be short. Repeated rows each have a position of their own; equal rows may swap. Null ids and
    texts are rows like any other. Other columns do no harm. An empty table gives an empty result. More than ``MAX_SOURCES`` sources raise.
    """
    kept = Kept(docs.sparkSession, "mixing")
    if weights is not None and any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    group = F.coalesce(F.col("source"), F.lit(NONE))
    rows = docs.select("doc_id", "source", group.alias("g"), F.xxhash64("doc_id", "source").alias("h"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    if not carry:
        rows = kept.keep(rows, "rows")
    counts = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    given = {s: Fraction(w).limit_denominator(10**9) or Fraction(w) for s, w in (weights or {}).items()}
    other = sum(given.values()) / len(given) if given else Fraction(1)
    table_rows, block_rows = planned({s: given.get(s, other) for s in counts}, counts, block_rows)
    rows = rows.withColumn("b", F.pmod(F.col("h"), F.lit(max(1, sum(counts.values()) // BUCKET_ROWS))))

    plan_df = docs.sparkSession.createDataFrame(table_rows, "g string, phase int, first long, until long, at long, period long, places array<int>, gap long")
    spans = F.broadcast(plan_df.withColumnRenamed("g", "_g"))
    rows = numbered(rows, ["g"], "b", ["h", "doc_id"], "n").drop("b", "h")
    rows = rows.withColumn("block", F.floor(F.col("n") / block_rows))
    rows = rows.join(spans, (F.col("g") == F.col("_g")) & (F.col("block") >= F.col("first")) & (F.col("block") < F.col("until")))
    k, q = F.col("block") - F.col("first"), F.size("places")
    slot = F.col("at") + F.floor(k / q) * F.col("period") + F.element_at("places", (k % q + 1).cast("int"))
    rows = rows.withColumn("slot", slot.cast("long"))
    rows = rows.withColumn("position", F.col("slot") * block_rows + F.col("n") % block_rows - F.col("gap"))
    return rows.select("doc_id", "source", F.col("block").cast("long").alias("block"), "phase", "slot", F.col("position").cast("long").alias("position"), *(["row"] if carry else []))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """All rows and columns of ``docs``, in the order of the mix: sorted within and across partitions. Nulls, repeated rows and empty tables: as ``schedule``."""
    names = docs.columns
    rows = schedule(docs, weights, carry=True)
    return rows.repartitionByRange(F.col("position")).sortWithinPartitions("position").select(*[F.col("row").getField(c).alias(c) for c in names])


#: Target shares of the query: the hot source is held to a tenth of the mix, the others share the rest.
TARGET = {"src0": 0.1} | {f"src{i}": 0.9 / 19 for i in range(1, 20)}


def op6_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """Every document's place in a mix of its sources at target weights. Null ids, texts and sources, repeated rows, clashing columns and
    empty tables: as ``schedule``.
    """
    return schedule(table(spark, sf_dir, "documents"), TARGET)
