"""Balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents with equal texts are linked, or with equal values of another column that is given. Linked documents are first dealt out over the shards in a hashed order. A link's
documents are alike, so the rounds move counts: how many of a link's documents each shard has. In a round each link
orders its shards by how many it has there (ties: first those with room, then by a hash) and wants to fill the first ones with what lies in the last. In odd
rounds it counts on the shards' free room, in even rounds on whole shards. Of those that want to go from one shard to another
as many are admitted as want to go back (a swap), and beyond that as the target's quota leaves room for. Every move
raises the number of linked pairs in one shard, so the rounds come to an end: when neither kind of round
admits a move. Documents without a link have no edge to cut: at the end they fill every shard up to its exact size.

Only ids, sizes and hashes move between machines; texts are read once. A link with a third of all rows is
tallied before any shuffle, and numbers are given inside small buckets, so no task holds a whole link or shard.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import joined, numbered, table
from quillgraph.session import Kept

BUCKET_ROWS = 4096
#: Propagation ends when it has settled; a table that takes more rounds raises.
MAX_ROUNDS = 500


def _bucket(rows: int, *cols):
    return F.pmod(F.xxhash64(*cols), F.lit(max(1, rows // BUCKET_ROWS)))


def _lookup(values: list[int], at):
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at.cast("int") + 1)


def _wishes(tally: DataFrame, free: list[int], whole: bool) -> DataFrame:
    """``link``, ``shard``, ``n`` and ``want``: what a link would have in each of its shards if it got its wish.

    ``free``: each shard's room or, with ``whole``, its size.
    """
    best = Window.partitionBy("link").orderBy(F.desc("n"), F.desc(_lookup(free, F.col("shard")) > 0), F.xxhash64("link", "shard"), "shard")
    most = F.greatest("n", _lookup(free, F.col("shard")) + (F.lit(0) if whole else F.col("n")))
    wish = tally.withColumn("all", F.sum("n").over(Window.partitionBy("link"))).withColumn("most", most).filter("n < all")
    before = F.coalesce(F.sum("most").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wish = wish.withColumn("want", F.greatest(F.lit(0), F.least("most", F.col("all") - before))).withColumn("rank", F.row_number().over(best))
    return wish.filter("want <> n").select("link", "shard", "n", "want", "rank")


def _moves(wish: DataFrame) -> DataFrame:
    """``link``, ``from``, ``to`` and ``m``: the last shards' documents go to the first shards that want some."""
    first, last = (Window.partitionBy("link").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("rank"), F.desc("rank")))
    asks = wish.filter("want > n").select("link", F.col("shard").alias("to"), (F.col("want") - F.col("n")).alias("k"), "rank").withColumn("end", F.sum("k").over(first))
    gives = wish.filter("want < n").select("link", F.col("shard").alias("from"), (F.col("n") - F.col("want")).alias("j"), "rank").withColumn("until", F.sum("j").over(last))
    m = F.least("end", "until") - F.greatest(F.col("end") - F.col("k"), F.col("until") - F.col("j"))
    return asks.drop("rank").join(gives.drop("rank"), "link").select("link", "from", "to", m.alias("m")).filter("m > 0")


def _admitted(moves: DataFrame, room: list[int], rows: int) -> DataFrame:
    """Those of ``moves`` that swaps and ``room`` allow."""
    asked = moves.groupBy("from", "to").agg(F.sum("m").alias("asked"))
    back = asked.select(F.col("from").alias("to"), F.col("to").alias("from"), F.col("asked").alias("back"))
    asked = asked.join(back, ["from", "to"], "left").withColumn("swap", F.least("asked", F.coalesce("back", F.lit(0)))).withColumn("more", F.col("asked") - F.col("swap"))
    ahead = F.coalesce(F.sum("more").over(Window.partitionBy("to").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least("more", _lookup(room, F.col("to")) - ahead))
    asked = asked.select("from", "to", (F.col("swap") + extra).alias("allowed")).filter("allowed > 0")
    moves = moves.withColumn("b", _bucket(rows, "link"))
    sums = moves.groupBy("from", "to", "b").agg(F.sum("m").alias("s"))
    before = Window.partitionBy("from", "to").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("from", "to", "b").orderBy("link").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("first", F.coalesce(F.sum("s").over(before), F.lit(0))).join(asked, ["from", "to"]).filter("first < allowed").drop("s")
    moves = moves.withColumn("upto", F.sum("m").over(inside)).join(sums, ["from", "to", "b"])
    m = F.least("m", F.col("allowed") - F.col("first") - F.col("upto") + F.col("m"))
    return moves.select("link", "from", "to", m.alias("m")).filter("m > 0")


def as_stored(docs: DataFrame) -> Column:
    """A long that grows in the order in which the rows of ``docs`` were written: by file, then by row; of what is no table of files, in its own order."""
    part = F.regexp_extract("_metadata.file_name", "^part-([0-9]+)", 1).cast("long")
    try:
        docs.select("_metadata.row_index", part)
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.coalesce(part, F.lit(0)) * F.lit(1 << 33) + F.col("_metadata.row_index")


def shards(docs: DataFrame, n_shards: int = 24, rounds: int = MAX_ROUNDS, link: Column | None = None, order: Column | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row, under the law ``rows``.

    ``n_shards`` is at most 4096. Shards' row counts are at most one apart; slots count from 0 in each shard, in a hashed order or in that
    of ``order``, a long (rows between two multiples of 65536 of it meet in one task for each shard). ``size``
    is the text's UTF-8 bytes (null: none) and 8. Rows with an equal ``link`` are linked (null: with nothing); without it, rows with equal texts: a null text has no link,
    empty ones are equal to one another. A null text has checksum 0. Null and repeated ids are rows like any other; rows equal in all columns may swap places. A link
    larger than a shard ends in several. Raises where propagation has not settled after ``rounds`` rounds. Other columns are ignored. An empty table gives an empty result.
    """
    if not 1 <= n_shards <= 4096:
        raise ValueError("n_shards must be between 1 and 4096")
    kept = Kept(docs.sparkSession, "sharding")
    text = F.col("text")
    same = F.when(text.isNotNull(), F.xxhash64(F.octet_length(text), F.crc32(text.cast("binary")), text))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        (same if link is None else link.cast("long")).alias("link"),
        (F.lit(None) if order is None else order).cast("long").alias("ord"),
    )
    base = kept.keep(base, "base")
    total = base.count()
    groups = kept.keep(base.filter("link is not null").groupBy("link").agg(F.count("*").alias("copies")).filter("copies > 1").select("link"), "groups", rows=total)
    linked = joined(base, groups, ["link"])
    linked = kept.keep(linked.withColumn("b", _bucket(total, "doc_id", "size", "text_crc32", "link")), "linked")
    n_linked = linked.count()
    linked = kept.keep(numbered(linked, [], "b", ["link", "doc_id", "size", "text_crc32"], "v").drop("b").withColumn("c", F.floor(F.col("v") / BUCKET_ROWS)), "numbered", rows=n_linked)

    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    tally = kept.keep(linked.groupBy("link", F.pmod("v", F.lit(n_shards)).cast("int").alias("shard")).agg(F.count("*").alias("n")), "tally0", rows=n_linked)

    def free() -> list[int]:
        have = {r["shard"]: r["n"] for r in tally.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # n_shards rows
        return [q - have.get(s, 0) for s, q in enumerate(quota)]

    room, idle, i = free(), 0, 0
    while n_linked and idle < 2:
        i += 1
        if i > rounds:
            raise RuntimeError(f"label propagation did not settle in {rounds} rounds")
        whole = i % 2 == 0
        wish = kept.keep(_wishes(tally, quota if whole else room, whole), f"wish{i}", rows=n_linked)
        moves = kept.keep(_moves(wish), f"moves{i}", rows=n_linked)
        admitted = kept.keep(_admitted(moves, room, n_linked), f"admitted{i}", rows=n_linked)
        if admitted.isEmpty():
            idle += 1
        else:
            idle = 0
            gone = admitted.select("link", F.col("from").alias("shard"), (-F.col("m")).alias("n"))
            come = admitted.select("link", F.col("to").alias("shard"), F.col("m").alias("n"))
            now = tally.unionByName(gone).unionByName(come).groupBy("link", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
            tally = kept.keep(now, f"tally{i}", rows=n_linked)
            room = free()
        for name in ("wish", "moves", "admitted"):
            kept.drop(f"{name}{i}")

    # which of a link's documents go where: numbers inside (link, c), and the shards that each (link, c) meets
    upto = F.sum("n").over(Window.partitionBy("link").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    spans = tally.withColumn("hi", upto).select("link", "shard", "hi", (F.col("hi") - F.col("n")).alias("lo"))
    cells = linked.groupBy("link", "c").agg(F.count("*").alias("k")).withColumn("end", F.sum("k").over(Window.partitionBy("link").orderBy("c").rowsBetween(Window.unboundedPreceding, 0)))
    cells = cells.join(spans, "link").filter("lo < end and hi > end - k").select("link", "c", "shard", (F.col("lo") - F.col("end") + F.col("k")).alias("lo"), (F.col("hi") - F.col("end") + F.col("k")).alias("hi"))
    placed = linked.withColumn("at", F.row_number().over(Window.partitionBy("link", "c").orderBy("v")) - 1).join(cells, ["link", "c"]).filter("at >= lo and at < hi")
    ends = [sum(room[: s + 1]) for s in range(n_shards)]
    columns = ["doc_id", "size", "text_crc32", "link", "ord"]
    single = joined(base, groups, ["link"], "left_anti")
    pool = single.select(*columns).withColumn("b", _bucket(total, "doc_id", "size", "text_crc32", "link"))
    pool = numbered(kept.keep(pool, "pool"), [], "b", ["doc_id", "size", "text_crc32", "link"], "at")
    filled = pool.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("at"))).cast("int"))
    done = kept.keep(filled.select(*columns, "shard").unionByName(placed.select(*columns, "shard")), "done", rows=total)
    if order is None:
        done = numbered(done.withColumn("b", _bucket(total, "doc_id", "size", "text_crc32", "link")), ["shard"], "b", ["doc_id", "size", "text_crc32", "link"], "slot")
    else:
        done = numbered(done.withColumn("b", F.shiftright("ord", 16)), ["shard"], "b", ["ord"], "slot")
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_balanced_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 with equal row counts, equal texts together. Null ids and texts, repeated rows, clashing columns and empty
    tables: as ``shards``.
    """
    return shards(table(spark, sf_dir, "documents"), 24)
