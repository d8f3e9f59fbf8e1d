"""Language-model scores from a weighted backoff automaton.

The model is a trigram model with Dirichlet priors: ``p(w|uv) = (c(uvw) + mu*p(w|v)) / (c(uv) + mu)``,
``p(w|v) = (c(vw) + mu*p(w)) / (c(v) + mu)`` and ``p(w) = (c(w)+1) / (N+V+1)``. As an automaton it has a state for each known
history of two words, of one word, and a root. A state has an arc for each word seen after it, with the whole smoothed
probability, to the state of the longest known history that the word completes; its failure arc, with ``mu/(c(h)+mu)``, leads to the state of the history
without its first word. The root has an arc for each word. A text is read from left to right: the
automaton takes its state's arc of the next word, failing as often as there is none, adds up the arcs' weights and carries the new state on.

No machine holds the whole model. Documents are dealt into chunks of known size, each chunk asks for the counts of
the n-grams that occur in it, and these requests meet in shards of a hash of the n-gram: a shard adds the
counts of all chunks, over all of the corpus, and answers every chunk. A chunk then has the part of the automaton that
its own documents can reach, exactly as the whole one has it, and runs them through, all texts in step. Requests and answers are
packed arrays, not rows. With more than ``cells`` pairs of a chunk and a shard, requests take two hops, over groups of chunks, so that the
number of rows grows with the power 1.5 of the corpus, not 2. No vocabulary is cut, and no n-gram is pruned. Words are known by 64-bit hashes,
longer n-grams by hashes with ``SPARE_BITS`` more than the corpus has bytes, 64 at most: fewer than one of 2**27 shares its hash with another.

Null texts count as empty and consist of the end token. A document without an id is scored and not learned from. Repeated
rows count each time. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_mod, table
from quillgraph.llm.tokens import batches, mix, word_hashes
from quillgraph.session import Kept

ORDER = 3
MU = 30.0
CHUNK_BYTES = 7 << 20
SHARD_BYTES = 8 << 20
CELLS = 1 << 25
SPARE_BITS = 28
#: Longer texts are walked in pieces of so many tokens, each entered over the two tokens before it.
PIECE = 256
_END = np.uint64(0x5851F42D4C957F2D)
_BEGIN = np.uint64(0x14057B7EF767814F)


def sequences(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, each text closed by the end token, and where each text begins (one entry more than texts)."""
    parts, sizes = [], []
    for _, _, run in batches(texts):
        h, at = word_hashes(run)
        n = np.diff(at)
        parts.append(np.insert(h, at[1:], _END))
        sizes.append(n + 1)
    begins = np.zeros(len(texts) + 1, np.int64)
    if sizes:
        np.cumsum(np.concatenate(sizes), out=begins[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), begins


def grams(tokens: np.ndarray, begins: np.ndarray, order: int, bits: int = 64) -> np.ndarray:
    """For each token the hash of the n-gram that it ends; a begin mark stands before a text. A text's first token ends no
    trigram: it has the hash of its bigram again, which is asked for and not used.
    """
    h = tokens
    for _ in range(order - 1):
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[begins[:-1]] = _BEGIN
        h = mix(before * np.uint64(0x9FB21C651E98DF25) + tokens)
    return h if order == 1 else h & np.uint64(((1 << bits) - 1) << (64 - bits))


def numbered(tokens: np.ndarray, begins: np.ndarray, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, sorted, and each token's number among them."""
    have, number = np.unique(grams(tokens, begins, order, bits), return_inverse=True)
    return have, number.astype(np.int32)


class Automaton:
    """The part of the backoff automaton that a chunk's texts can reach.

    ``word``, ``pair`` and ``triple`` give each token's n-grams a number, ``counts`` each n-gram's count. State 0 is the root, 1 the begin of a
    text, then come words and pairs that were seen. ``arcs`` (sorted: state * words + word) have ``weight`` and ``to``; ``root_weight`` and ``root_to`` are
    the root's, by word; ``fail`` and ``fail_weight`` are each state's failure arc.
    """

    def __init__(self, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, counts: list[np.ndarray], begins: np.ndarray, end: int, begun: int, total: int, types: int, mu: float):
        c1, c2, c3 = counts
        self.word, self.begins, self.words = word, begins, len(c1)
        first = np.zeros(len(word), bool)
        first[begins[:-1]] = True
        smooth = (c1 + 1.0) / (total + types + 1.0)
        self.root_weight = np.log10(smooth)

        # states
        known1 = c1 > 0
        known1[end] = False
        ones = int(known1.sum())
        state1 = np.zeros(len(c1), np.int32)
        state1[known1] = 2 + np.arange(ones, dtype=np.int32)
        some2 = np.empty(len(c2), np.int32)  # a token that ends each pair
        some2[pair[::-1]] = np.arange(len(pair), dtype=np.int32)[::-1]
        last = word[some2]
        known2 = (c2 > 0) & (last != end)
        state2 = np.zeros(len(c2), np.int32)
        state2[known2] = 2 + ones + np.arange(known2.sum(), dtype=np.int32)
        self.root_to = state1
        self.fail = np.concatenate((np.zeros(2 + ones, np.int32), state1[last[known2]]))
        self.fail_weight = np.log10(mu / (np.concatenate(([1.0, begun], c1[known1], c2[known2])) + mu))
        self.fail_weight[0] = 0.0
        del known2

        # arcs of one-word histories: pairs that were seen
        arc2 = np.flatnonzero(c2 > 0).astype(np.int32)
        at, last = some2[arc2], last[arc2]
        begin = first[at]
        h = np.where(begin, begun, c1[word[at - 1]])
        p2 = np.zeros(len(c2))
        p2[arc2] = (c2[arc2] + mu * smooth[last]) / (h + mu)
        key2 = np.where(begin, 1, state1[word[at - 1]]).astype(np.int64) * self.words + last
        del h, at, begin, some2, last
        # of two-word histories: triples that were seen; a text's first token ends none
        some3 = np.full(len(c3), -1, np.int32)
        inside = np.flatnonzero(~first).astype(np.int32)
        some3[triple[inside[::-1]]] = inside[::-1]
        arc3 = np.flatnonzero((c3 > 0) & (some3 >= 0)).astype(np.int32)
        at3 = some3[arc3]
        del some3, inside
        p3 = (c3[arc3] + mu * p2[pair[at3]]) / (c2[pair[at3 - 1]] + mu)
        keys = np.concatenate([key2, state2[pair[at3 - 1]].astype(np.int64) * self.words + word[at3]])
        del key2, arc3
        order = np.argsort(keys).astype(np.int32)
        self.arcs = keys[order]
        del keys
        self.weight = np.log10(np.concatenate([p2[arc2], p3])[order])
        del p2, p3
        self.to = np.concatenate([state2[arc2], state2[pair[at3]]])[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after ``word``, and the weights of all arcs taken."""
        to, weight = self.root_to[word], self.root_weight[word]
        live, now, paid = np.flatnonzero(state), state[state > 0], np.zeros(len(state))
        while len(live) and len(self.arcs):
            key = now.astype(np.int64) * self.words + word[live]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            has = self.arcs[at] == key
            to[live[has]], weight[live[has]] = self.to[at[has]], self.weight[at[has]]
            live, now = live[~has], now[~has]
            paid[live] += self.fail_weight[now]
            now = self.fail[now]
            live, now = live[now > 0], now[now > 0]
        if not len(self.arcs):
            while len(live):
                paid[live] += self.fail_weight[now]
                now = self.fail[now]
                live, now = live[now > 0], now[now > 0]
        return to, weight + paid

    def walk(self) -> np.ndarray:
        """Each text's log10 probability: all pieces of texts are read in step, each carrying its state."""
        size = np.diff(self.begins)
        many = -(-size // PIECE)
        text = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        at = self.begins[:-1][text] + nth * PIECE
        left = np.minimum(self.begins[1:][text] - at, PIECE)
        state = np.where(nth == 0, 1, 0).astype(np.int32)
        later = nth > 0
        for back in (2, 1):  # any two tokens put the automaton in the state that it has after the whole text before them
            state[later], _ = self.step(state[later], self.word[at[later] - back])
        order = np.argsort(-left, kind="stable")
        text, at, left, state = text[order], at[order], left[order], state[order]
        score, live = np.zeros(len(text)), len(text)
        for t in range(int(left[0]) if len(left) else 0):
            while left[live - 1] <= t:
                live -= 1
            state[:live], weight = self.step(state[:live], self.word[at[:live] + t])
            score[:live] += weight
        return np.bincount(text, score, minlength=len(size))


def packed_keys(keys: np.ndarray, counts: np.ndarray, bits: int = 64) -> bytes:
    """Sorted keys as differences, byte by byte, and their counts. Keys have zeros below their first ``bits`` bits."""
    planes = np.diff(keys >> np.uint64(64 - bits), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes + packed_counts(counts, press=False) + bytes([bits]))


def unpacked_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    wide, bits = raw[-2:]
    n = (len(raw) - 2) // (8 + wide)
    keys = np.cumsum(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T.copy().view(np.uint64).ravel()) << np.uint64(64 - bits)
    return keys, np.frombuffer(raw, f"u{wide}", n, 8 * n)


def packed_counts(counts: np.ndarray, press: bool = True) -> bytes:
    """Counts in the least width that holds them; the last byte is the width."""
    most = int(counts.max()) if len(counts) else 0
    wide = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    raw = counts.astype(f"u{wide}").tobytes() + bytes([wide])
    return zstandard.ZstdCompressor(level=1).compress(raw) if press else raw


def unpacked_counts(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, f"u{raw[-1]}", (len(raw) - 1) // raw[-1])


def _cuts(keys: np.ndarray, low: int, high: int, of: int) -> np.ndarray:
    """Where the shards ``low`` to ``high`` of ``of`` begin in sorted ``keys``; shards are equal ranges of the keys' upper half."""
    top = keys >> np.uint64(32)
    edges = [-((-s << 32) // of) for s in range(low, high + 1)]
    return np.searchsorted(top, np.array(edges, np.uint64))


def _packed(docs: DataFrame, id_col: str, text_col: str, chunks: int, held: int, modulus: int) -> DataFrame:
    """(chunk, pack): compressed lists of (id, learn, held out, text)."""
    rest = crc_mod(id_col, modulus)
    given = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.octet_length(text_col), text_col), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(rest != held, F.lit(False)).alias("learn"),
        F.coalesce(rest == held, F.lit(False)).alias("held"),
        F.col(text_col).alias("t"),
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for part in parts:
            bodies: dict[int, tuple[list, ...]] = {}
            for c, *row in zip(*(part.column(k).to_pylist() for k in ("chunk", "id", "learn", "held", "t")), strict=True):
                for column, x in zip(bodies.setdefault(c, ([], [], [], [])), row, strict=True):
                    column.append(x)
            packs = [press.compress(pickle.dumps(b, protocol=5)) for b in bodies.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(bodies), pa.int32()), pa.array(packs, pa.binary())], ["chunk", "pack"])

    return given.mapInArrow(run, "chunk int, pack binary")


def _unpacked(packs: pd.Series) -> tuple[list, np.ndarray, np.ndarray, list]:
    """Ids, learned, held out, texts, in one order however the packs arrive."""
    open_ = zstandard.ZstdDecompressor()
    rows = []
    for p in packs:
        rows += zip(*pickle.loads(open_.decompress(p)), strict=True)
    ids, learn, held, texts = ([r[k] for r in rows] for k in range(4))
    return ids, np.array(learn, bool), np.array(held, bool), texts


_NAMES = ["k1", "k2", "k3"]
_ASKED = "shard int, chunk int, k1 binary, k2 binary, k3 binary, texts long"
_ANSWERED = "chunk int, shard int, texts long, k1 binary, k2 binary, k3 binary, types long, tokens long"


def _gathered(blobs: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several packed key lists: the distinct keys, the sums of their counts, each list's keys' numbers, and where each list begins."""
    lists = [unpacked_keys(b) for b in blobs]
    cut = np.concatenate(([0], np.cumsum([len(k) for k, _ in lists]))).astype(np.int64)
    have, number = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
    total = np.bincount(number, np.concatenate([c for _, c in lists]), minlength=len(have)).astype(np.uint64)
    return have, total, number, cut


def _answered(asked: DataFrame) -> DataFrame:
    """Every (shard, chunk) that asked gets the sums of all chunks' counts, in the order of its keys."""

    def answer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk", ignore_index=True)
        out = {"chunk": part["chunk"], "shard": key[0], "texts": part["texts"]}
        for name in _NAMES:
            _, total, number, cut = _gathered(part[name])
            out[name] = [packed_counts(total[number[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            if name == "k1":
                first = np.arange(len(part)) == 0
                out["types"] = np.where(first, int((total > 0).sum()), 0)
                out["tokens"] = np.where(first, int(total.sum()), 0)
        return pd.DataFrame(out)[["chunk", "shard", "texts", *_NAMES, "types", "tokens"]]

    return asked.groupBy("shard").applyInPandas(answer, _ANSWERED)


def _two_hops(asked: DataFrame, near: int, shards: int, group: int, bits: int) -> DataFrame:
    """As ``_answered``, for chunks that asked ``near`` coarse shards: groups of chunks ask ``shards`` fine ones and hand the answers on."""
    dealt = asked.withColumn("g", F.floor(F.col("chunk") / group).cast("int"))

    def merge(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        g, s = (int(x) for x in key)
        low, high = s * shards // near, (s + 1) * shards // near
        blobs = []
        for name in _NAMES:
            have, total, _, _ = _gathered(part[name])
            cut = _cuts(have, low, high, shards)
            blobs.append([packed_keys(have[a:b], total[a:b], 64 if name == "k1" else bits) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        texts = int(part["texts"].sum())
        return pd.DataFrame([(low + j, g, *b, texts if j == 0 else 0) for j, b in enumerate(zip(*blobs, strict=True))], columns=["shard", "chunk", *_NAMES, "texts"])

    def split(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        part, told = part.sort_values("chunk", ignore_index=True), told.sort_values("shard")
        out = {"chunk": part["chunk"], "shard": key[1]}
        for name in _NAMES:
            _, _, number, cut = _gathered(part[name])
            total = np.concatenate([unpacked_counts(b) for b in told[name]])
            out[name] = [packed_counts(total[number[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for name in ("texts", "types", "tokens"):
            out[name] = np.where(np.arange(len(part)) == 0, int(told[name].sum()), 0)
        return pd.DataFrame(out)[["chunk", "shard", "texts", *_NAMES, "types", "tokens"]]

    fine = _answered(dealt.groupBy("g", "shard").applyInPandas(merge, _ASKED))
    # the coarse shard that a fine one lies in
    coarse = F.floor(((F.col("shard") + 1) * near - 1) / shards).cast("int")
    back = fine.withColumnRenamed("chunk", "g").withColumn("near", coarse)
    return dealt.groupBy("g", "shard").cogroup(back.groupBy("g", "near")).applyInPandas(split, _ANSWERED)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: int = 2, modulus: int = 7, mu: float = MU, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, cells: int = CELLS) -> DataFrame:
    """Every row's ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Learned from the rows whose crc32 of the id modulo ``modulus`` is not ``held``. Nulls, empty texts, repeated rows, clashing
    columns and empty tables: see the module's text.
    """
    kept = Kept(docs.sparkSession, "lm")
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + F.lit(16))).first()[0] or 0
    chunks, shards = max(1, -(-size // chunk_bytes)), max(1, -(-size // shard_bytes))
    two, bits = chunks * shards > cells, min(64, SPARE_BITS + int(size).bit_length())
    asks = max(1, isqrt(shards)) if two else shards
    packs = _packed(docs, id_col, text_col, chunks, held, modulus)

    def ask(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, learn, _, texts = _unpacked(part["pack"])
        tokens, begins = sequences(texts)
        taught = np.repeat(learn, np.diff(begins))
        blobs = []
        for order in range(1, ORDER + 1):
            have, number = numbered(tokens, begins, order, bits)
            count = np.bincount(number[taught], minlength=len(have))
            # equal ranges of shards, as many fine ones in each as there will be in the second hop
            cut = _cuts(have, 0, shards, shards)[[s * shards // asks for s in range(asks + 1)]]
            blobs.append([packed_keys(have[a:b], count[a:b], 64 if order == 1 else bits) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        rows = [(s, key[0], *b, int(learn.sum()) if s == 0 else 0) for s, b in enumerate(zip(*blobs, strict=True))]
        return pd.DataFrame(rows, columns=["shard", "chunk", *_NAMES, "texts"])

    asked = packs.groupBy("chunk").applyInPandas(ask, _ASKED)
    answered = kept.keep(_two_hops(asked, asks, shards, max(1, isqrt(chunks)), bits) if two else _answered(asked), "answers")
    sums = answered.agg(F.sum("types"), F.sum("tokens"), F.sum("texts")).first()
    types, total, begun = (int(x or 0) for x in sums)

    def run(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        ids, _, held_out, texts = _unpacked(part["pack"])
        del part
        tokens, begins = sequences(texts)
        del texts
        told = told.sort_values("shard")
        counts, numbers = [], []
        for order, name in enumerate(_NAMES, 1):
            have, number = numbered(tokens, begins, order, bits)
            counts.append(np.concatenate([unpacked_counts(b) for b in told[name]]).astype(np.float64))
            numbers.append(number)
            if order == 1:
                end = int(np.searchsorted(have, _END))
        automaton = Automaton(*numbers, counts, begins, end, begun, total, types, mu)
        sums = lambda x: np.add.reduceat(x, begins[:-1])  # noqa: E731  every text has a token
        return pd.DataFrame(
            {
                id_col: pd.array(ids, "Int64"),
                "held_out": held_out,
                "n_tokens": np.diff(begins),
                "n_known": sums((counts[0] > 0).astype(np.int64)[numbers[0]]),
                "train_tokens": total,
                "base_score": sums(automaton.root_weight[numbers[0]]),
                "score": automaton.walk(),
            }
        )

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(run, schema)


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents under a model of those that are not held out. Null texts are empty; a row with a null id is scored and
    not learned from; repeated rows count each time; columns beside ``doc_id`` and ``text`` are ignored; an empty table gives no rows.
    """
    return score(table(spark, sf_dir, "documents"))
