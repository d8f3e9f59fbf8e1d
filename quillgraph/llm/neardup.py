"""Similarity join of word-shingle sets: parity sketches, joined by pigeonhole in bands of set size.

A set's parity sketch flips one bit for each element. Bits that more than one element may flip can only
cancel, so two sketches differ in at most as many bits as the sets' symmetric difference has elements.
Sets whose Jaccard similarity is ``t`` or more differ in at most ``(1-t)/t`` times the smaller set's size.
All sets of a size band use one layout of more blocks of sketch bits than that, so that some block of
such a pair is untouched by the difference. If it is empty in both, it gives no key: a pair without a key has all non-empty
blocks touched, in both sets. A set with no more non-empty blocks than its difference may touch therefore also gives keys
of small subsets of its first elements in the layout's order, of which such a pair shares one (prefix filter). A layout's blocks are 2**32 bits wide; a block is held as the XOR of hashes
of its set bits, in which, too, a bit flipped twice cancels. Blocks that meet give candidate pairs, a
second, narrow sketch bounds each pair's difference, and the sets themselves decide.

Sets that are equal are one node from the start. Of the nodes that share a block, each is first compared
with the next one and with the first, which costs no more than there are nodes; what these links leave in
different components is then compared pair by pair, within the sketch's bound: of a block, those outside its largest component with all
others. Pairs inside a component need no comparison. A block that very many nodes share is dealt out, each part compared in itself and the parts' first
nodes with one another. Nothing is capped: components are those of all links.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import in_pieces, joined, table
from quillgraph.llm.tokens import batches, mix, shingle_sets
from quillgraph.operators.components import connected_components
from quillgraph.session import Kept

BAND_RATIO = 1.4
PREFIX_SUBSETS = 256
#: A key that about so many sets have is dealt out; such keys are found by the sets whose hash is divisible by ``SAMPLED``, which changes
#: only where rows go, not what is found.
HOT, SAMPLED = 4096, 256
_U = np.uint64


def bands(percent: int, largest: int) -> list[int]:
    """Lower bounds of the size bands, from the least size at which two different sets can be similar."""
    low = [next(n for n in range(1, 101) if (100 - percent) * n // percent >= 1)]
    while low[-1] <= largest:
        # no set of a band has a partner below the band before
        low.append(max(low[-1] + 1, int(low[-1] * BAND_RATIO), 100 * (low[-1] - 1) // percent + 1))
    return low


def subset_size(band: int, percent: int, low: list[int]) -> int:
    """How many elements a prefix key has in a band: up to three, as long as the largest set has few subsets."""
    largest = 100 * (low[band + 1] - 1) // percent
    spare, shared = largest - -(-percent * largest // 100), -(-percent * low[band] // 100)
    return max(k for k in (1, 2, 3) if k == 1 or k <= shared and math.comb(spare + k, k) <= PREFIX_SUBSETS)


def block_keys(s: np.ndarray, percent: int, low: list[int]) -> np.ndarray:
    """The keys of a set in its own band's layout and, if a smaller partner may be there, in the one below: of its
    non-empty blocks, and where these are too few, of its prefix.
    """
    n = len(s)
    own = int(np.searchsorted(low, n, "right")) - 1
    if own < 0:
        return np.zeros(0, np.int64)
    out = []
    for band in (own, own - 1):
        if band < 0 or band < own and -(-percent * n // 100) >= low[own]:
            continue
        most = (100 - percent) * (low[band + 1] - 1) // percent
        # some blocks to spare, as a few are empty
        blocks = most + 1 + most // 7
        h = mix(s + mix(np.array([band + 1], np.uint64)))
        block = (h >> _U(32)) % _U(blocks)
        order = np.argsort(block, kind="stable")
        at, first = np.unique(block[order], return_index=True)
        bit = mix((h[order] & _U(0xFFFFFFFF)) | (_U(1) << _U(40)))
        key = np.bitwise_xor.reduceat(bit, first)
        out.append(mix(key + mix(at + (_U(band) << _U(40)))))
        if len(at) <= min(most, (100 - percent) * n // percent):
            k = subset_size(band, percent, low)
            prefix = np.sort(h)[: n - -(-percent * n // 100) + k]
            each = np.array(list(itertools.combinations(prefix, k)), np.uint64)
            key = np.full(len(each), band + 1, np.uint64) | (_U(1) << _U(50))
            for j in range(k):
                key = mix(key + each[:, j])
            out.append(key)
    return np.concatenate(out).view(np.int64)


def narrow_sketch(s: np.ndarray) -> np.ndarray:
    """A parity sketch of the least power of two of 64-bit words that has two bits for each element."""
    words = 1
    while 32 * words < len(s):
        words *= 2
    h = mix(s ^ _U(0x165667B19E3779F9))
    out = np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((h >> _U(6)) & _U(words - 1)).astype(np.int64), _U(1) << (h & _U(63)))
    return out.view(np.int64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set: equal for equal sets."""
    both = np.array([len(s), 0], np.uint64)
    both[1] = np.bitwise_xor.reduce(s) if len(s) else 0
    return int(mix(mix(both[:1]) + both[1:] + mix(np.array([s.sum(dtype=np.uint64)], np.uint64))).view(np.int64)[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``doc``, ``t`` (a hash of the text), ``n`` (set size), ``node`` (the set's hash, null for an empty set), ``sketch``, ``keys``."""

    many = pa.list_(pa.int64())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = bands(percent, 1 << 16)
        for part in in_pieces(parts):
            rows = []
            for _, _, texts in batches(part.column("_t").to_pylist()):
                for s in shingle_sets(texts, words):
                    while len(s) >= low[-1]:
                        low = bands(percent, 2 * low[-1])
                    rows.append((len(s), set_id(s), narrow_sketch(s), block_keys(s, percent, low)) if len(s) else (0, None, None, None))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), many, many))]
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_h"), *columns], ["doc", "t", "n", "node", "sketch", "keys"])

    given = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_t"))
    return given.mapInArrow(run, "doc long, t long, n long, node long, sketch array<long>, keys array<long>")


def _differing_bits(x, y):
    """Bits in which two narrow sketches differ; the longer one is first folded to the other's length, which only cancels bits."""

    def folded(a, b):
        return F.when(F.size(a) > F.size(b), F.zip_with(F.slice(a, 1, F.size(b)), F.slice(a, F.size(b) + 1, F.size(b)), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)


def _may_link(a: str, b: str, percent: int):
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    near = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    # sizes within the threshold: the longer sketch is at most twice as long
    return near & (_differing_bits(F.col(f"{a}.sketch"), F.col(f"{b}.sketch")) * (100 + percent) <= (na + nb) * (100 - percent))


def _verified(kept: Kept, name: str, pairs: DataFrame, firsts: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) whose sets have the similarity."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    n = 2 * pairs.count()
    wanted = kept.keep(nodes.join(firsts.select("node", "first"), "node"), f"{name}-wanted", rows=n)

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(set_id(s), s.tobytes()) for _, _, t in batches(list(part["_t"])) for s in shingle_sets(t, words) if len(s)]
            yield pd.DataFrame(rows, columns=["node", "s"])

    given = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    read = joined(given, wanted.select(F.col("first").alias("_id")).distinct(), ["_id"], "left_semi").mapInPandas(sets, "node long, s binary")
    have = kept.keep(joined(read, wanted.select("node"), ["node"], "left_semi").dropDuplicates(["node"]), f"{name}-sets", rows=8 * n)

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            good = []
            for x, y in zip(part["sa"], part["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.loc[good, ["a", "b"]]

    sided = pairs.join(have.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(have.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return kept.keep(sided.mapInPandas(compare, "a long, b long"), f"{name}-links", rows=8 * n)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """Every row's ``id_col``, ``n_shingles`` and ``component_id``: the smallest id that links reach from it.

    A text's set holds its distinct ``words``-word shingles (of fewer words the whole sequence). Rows link when the
    sets' Jaccard similarity is ``percent`` per cent or more. Texts that are null or without words have empty sets,
    link with nothing and are components of their own. A row without an id has no component (null) and links nothing.
    Repeated rows give repeated rows; rows that share an id link by each one's own text. Ties do not arise.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = components(docs, id_col, text_col, words, percent)
    return rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Every row's ``doc``, ``t`` (a hash of its text), ``n``, ``node`` (null for an empty set) and ``component``."""
    kept = Kept(docs.sparkSession, "neardup")
    all_rows = kept.keep(signatures(docs, id_col, text_col, words, percent), "signatures")
    n = all_rows.count()
    rows = all_rows.filter(F.col("doc").isNotNull() & F.col("node").isNotNull())
    firsts = kept.keep(rows.groupBy("node").agg(F.min("doc").alias("first"), F.count("*").alias("rows"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "firsts", rows=n)

    # the first row of each set stands for it
    others = joined(rows.select("node", "doc"), firsts.filter("rows > 1").select("node", "first"), ["node"]).filter("doc > first").select("node", "doc").distinct()
    others = kept.keep(others, "others", rows=n)
    alone = joined(rows.select("node", "doc", "keys"), others, ["node", "doc"], "left_anti")
    keyed = alone.select("node", F.explode("keys").alias("key"))
    often = keyed.filter(F.pmod("node", F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") >= max(1, HOT // SAMPLED))
    often = kept.keep(often.select("key", F.ceil(F.col("k") * SAMPLED / HOT).cast("int").alias("deals")), "often", rows=n)
    hot = F.lit(False)
    met = keyed.withColumn("deal", F.lit(0))
    if not often.isEmpty():
        dealt = joined(keyed, often, ["key"], "left")
        met = dealt.withColumn("deal", F.when(F.col("deals").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), "deals"))).drop("deals")
        hot = F.col("deal") >= 0
    by_key = Window.partitionBy("key", "deal").orderBy("node")
    met = met.withColumn("next", F.lead("node").over(by_key)).withColumn("last", F.lag("node").over(by_key))
    met = met.filter(hot | (F.coalesce("next", "node") != F.col("node")) | (F.coalesce("last", "node") != F.col("node")))
    met = kept.keep(met.select("key", "deal", "node").distinct(), "met")
    cells = met.count()

    last = F.lag("node").over(by_key)
    start = F.first("node").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = met.select("node", F.array_distinct(F.array(last, start)).alias("to")).select(F.explode("to").alias("a"), F.col("node").alias("b"))
    heads = met.filter(hot).groupBy("key", "deal").agg(F.min("node").alias("b"))
    heads = heads.join(heads.groupBy("key").agg(F.min("b").alias("a")), "key").select("a", "b")
    near = near.unionByName(heads).filter("a < b").distinct()
    side = firsts.select("node", "n", "sketch")

    def bounded(pairs: DataFrame) -> DataFrame:
        x = side.select(F.col("node").alias("a"), F.struct("n", "sketch").alias("x"))
        y = side.select(F.col("node").alias("b"), F.struct("n", "sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").filter(_may_link("x", "y", percent)).select("a", "b")

    pairs = kept.keep(bounded(near), "near", rows=n)
    links = _verified(kept, "near", pairs, firsts, docs, id_col, text_col, words, percent)
    parts = kept.keep(connected_components(links, "a", "b"), "parts", rows=n)

    # blocks whose nodes are still in different components: the rest of their pairs, of which one is outside the block's largest part
    placed = kept.keep(met.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part")), "placed", rows=cells)
    held = placed.groupBy("key", "part").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "part")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("k"))
    split = held.filter("parts > 1 and k > 2").select("key", F.col("top.part").alias("largest"))
    rest = kept.keep(placed.join(split, "key").join(side, "node"), "rest", rows=cells)
    x = rest.select("key", "largest", F.col("node").alias("a"), F.col("part").alias("pa"), F.struct("n", "sketch").alias("x"))
    y = rest.filter("part <> largest").select("key", F.col("node").alias("b"), F.col("part").alias("pb"), F.struct("n", "sketch").alias("y"))
    more = x.join(y, "key").filter((F.col("pa") != F.col("pb")) & ((F.col("pa") == F.col("largest")) | (F.col("a") < F.col("b"))) & _may_link("x", "y", percent))
    more = more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = kept.keep(more.join(pairs, ["a", "b"], "left_anti"), "more", rows=cells)
    found = links
    if not more.isEmpty():
        found = links.unionByName(_verified(kept, "more", more, firsts, docs, id_col, text_col, words, percent))
        parts = connected_components(found, "a", "b")

    # components by their smallest id
    of_set = firsts.select("node", "first").join(parts, "node").withColumn("component_id", F.min("first").over(Window.partitionBy("component"))).select("node", F.col("component_id").alias("_c"))
    of_copies = firsts.filter("rows > 1").select("node", "first").join(of_set, "node", "left").select("node", F.coalesce("_c", "first").alias("_c"))
    linked = kept.keep(of_copies.unionByName(of_set.join(of_copies, "node", "left_anti")), "linked", rows=n)
    for name in ("met", "placed", "rest"):
        kept.drop(name)
    return joined(all_rows.select("doc", "t", "n", "node"), linked, ["node"], "left").select("doc", "t", "n", "node", F.when(F.col("doc").isNotNull(), F.coalesce("_c", "doc")).alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, but for those that a row with a smaller id represents.

    Rows without an id, and texts that are null or without words, stay. Rows of one id are judged each by its own text; of rows with
    one id and one set of shingles, or with one id in one component, the first text stays, once.
    """
    kept = Kept(docs.sparkSession, "one-of-each")
    rows = kept.keep(components(docs, "doc_id", "text", words, percent).filter("doc is not null and node is not null").select("doc", "t", "component"), "rows")
    n = rows.count()
    first = rows.groupBy("component").agg(F.min(F.struct("doc", "t")).alias("k")).select(F.col("k.doc").alias("doc"), F.col("k.t").alias("t"))
    texts = rows.groupBy("doc", "t").agg(F.count("*").alias("rows"))
    gone = kept.keep(texts.join(first, ["doc", "t"], "left_anti").select("doc", "t"), "gone", rows=n)
    twice = kept.keep(texts.filter("rows > 1").join(first, ["doc", "t"], "left_semi").select("doc", "t"), "twice", rows=n)
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("t"))
    left = joined(own, gone, ["doc", "t"], "left_anti")
    if not twice.isEmpty():
        left = joined(left, twice, ["doc", "t"], "left_anti").unionByName(joined(left, twice, ["doc", "t"], "left_semi").dropDuplicates(["doc", "t"]))
    return left.select("row.*")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose three-word shingle sets have a Jaccard similarity of 0.9 or more. Null ids and texts, texts without words, repeated
    rows, other columns and empty tables: as ``similar``.
    """
    return similar(table(spark, sf_dir, "documents"), words=3, percent=90)
