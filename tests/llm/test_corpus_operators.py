"""Operators over whole tables, against plain versions."""

import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann, mixing, neardup, queries, sharding
from tests.llm.test_text_operators import docs, empty, odd

# --- 10


def plain_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n=25):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 2, 3, 8, 12, 20, 60, 300]))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(900)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,words,percent,hot", [(1, 3, 90, 4096), (2, 5, 80, 4096), (3, 1, 80, 4096), (4, 3, 80, 3), (5, 2, 90, 2)])
def test_join_finds_all_links(spark, monkeypatch, seed, words, percent, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "SAMPLED", 256 if hot > 256 else 1)
    texts = families(seed) + ["", None, "One two THREE four", "one two three FOUR", "  one\ttwo\nthree four "]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.similar(docs(spark, texts), words=words, percent=percent).collect()}
    assert got == plain_components(list(enumerate(texts)), words, percent)


@pytest.mark.parametrize("percent", [50, 65, 80, 90])
def test_pairs_of_small_sets_share_a_key(percent):
    """Blocks that are empty in both sets give no key: such pairs meet by their prefixes."""
    rng, low = np.random.default_rng(percent), neardup.bands(percent, 1 << 10)
    for n in [*range(1, 41), 60, 75, 100, 300]:
        for m in range(n, 100 * n // percent + 1):
            both = -(-percent * (n + m) // (100 + percent))
            if both > n or n == m == both:  # equal sets are one node
                continue
            for _ in range((300 if n <= 20 else 20) if percent >= 80 else 10):
                x = rng.integers(0, 1 << 62, n + m - both, dtype=np.uint64)
                a, b = np.sort(x[:n]), np.sort(x[n - both :])
                assert len(np.intersect1d(a, b)) == both and len(b) == m
                assert len(np.intersect1d(neardup.block_keys(a, percent, low), neardup.block_keys(b, percent, low)))


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 80, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(20, 80)], rng.integers(0, 1 << 62, rng.integers(0, 30), dtype=np.uint64)]))
        x, y = neardup.narrow_sketch(a).view(np.uint64), neardup.narrow_sketch(b).view(np.uint64)
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert sum(int(v).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


def test_chain_of_near_copies_is_one_component(spark):
    """Ends that are not similar are joined by what lies between; a large group of exact copies is one node."""
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[: 100 - i] + [f"y{j}" for j in range(i)]) for i in range(0, 60, 2)] + [" ".join(words)] * 300
    got = neardup.similar(docs(spark, texts), words=3, percent=90).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [0]


def test_one_of_each_keeps_columns(spark):
    texts = ["a b c d e f g h"] * 3 + ["other words stand here all alone"]
    kept = neardup.one_of_each(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "kind", "score"] and sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_one_of_each_looks_at_the_text_of_an_id(spark):
    """Two texts of one id: the copy goes, the other stays; repeated rows and copies of one id leave one."""
    rows = [(1, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "some other text that nobody copied"), (7, "seven texts of one id and words"), (7, "seven texts of one id and words"), (8, "seven texts of one id and words"), (None, "a b c d e f g h"), (None, None), (9, "a b c d e f g H"), (9, "A b c d e f g h")]
    table = spark.createDataFrame([(i, t, "en", "k", "s") for i, t in rows], "doc_id long, text string, node string, row string, doc string")
    kept = neardup.one_of_each(table)
    assert kept.columns == table.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, rows[0][1]), (5, rows[2][1]), (7, rows[3][1]), (None, rows[0][1]), (None, None)], key=str)


def test_links_of_half_alike_sets(spark):
    """Thresholds below those of the pipeline need wider bands."""
    words = [f"w{i}" for i in range(400)]
    texts = [t for k in range(6) for t in (" ".join(words[60 * k : 60 * k + 50]), " ".join(words[60 * k : 60 * k + 25] + [f"x{k}y{j}" for j in range(25 * (k % 2))]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.similar(docs(spark, texts), words=1, percent=50).collect()}
    assert got == plain_components(list(enumerate(texts)), 1, 50)


def test_join_odd_rows(spark):
    got = neardup.similar(odd(spark)).collect()
    assert len(got) == 7 and {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"]} == {(1, 1), (2, 2), (3, 3), (4, 4), (6, 6)}
    assert neardup.similar(empty(spark)).count() == 0 and neardup.one_of_each(odd(spark)).count() == 6


# --- 8


@pytest.mark.parametrize("n", [3, 24])
def test_shards_are_even_and_keep_copies_together(spark, n):
    texts = [f"text {i}" for i in range(150)] + [f"copy {i % 12}" for i in range(60)] + ["huge"] * 100
    rows = sharding.shards(docs(spark, texts), n).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(texts) and len(sizes) == n and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(n):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    where = defaultdict(Counter)
    for r in rows:
        t = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 8, zlib.crc32(t.encode()), "rows", None)
        where[t][r["shard"]] += 1
    # neighbours together: far fewer cut pairs than hashing would leave
    same = sum(c * c for w in where.values() for c in w.values())
    hashed = sum(sum(w.values()) ** 2 for w in where.values()) / n
    assert same > 1.5 * hashed


def test_propagation_settles_with_large_groups(spark):
    """A third of all rows are one text: it fills whole shards, and pairs are not cut."""
    texts = ["huge"] * 200 + ["large"] * 100 + [f"pair {i // 2}" for i in range(60)] + [f"text {i}" for i in range(240)]
    where = defaultdict(Counter)
    for r in sharding.shards(docs(spark, texts), 24).collect():
        where[texts[r["doc_id"]]][r["shard"]] += 1
    assert len(where["huge"]) <= 14 and len(where["large"]) <= 8
    pairs = [w for t, w in where.items() if t.startswith("pair")]
    assert sum(len(w) == 1 for w in pairs) >= 0.8 * len(pairs)
    with pytest.raises(RuntimeError):
        sharding.shards(docs(spark, texts), 24, rounds=1)


def test_shards_odd_rows(spark):
    rows = sharding.shards(odd(spark), 4).collect()
    assert len(rows) == 7 and sorted(Counter(r["shard"] for r in rows).values()) == [1, 2, 2, 2]
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert sharding.shards(empty(spark), 4).count() == 0


def test_slots_in_a_given_order_and_links_of_another_column(spark, tmp_path):
    rows = [(i, f"text {i}", (i * 37) % 400, i // 40 if i < 200 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, rank long, kin long")
    got = sharding.shards(table, 5, link=F.col("kin"), order=F.col("rank")).collect()
    rank, kin = {r[0]: r[2] for r in rows}, {r[0]: r[3] for r in rows}
    for s in range(5):
        mine = sorted((r["slot"], rank[r["doc_id"]]) for r in got if r["shard"] == s)
        assert [t for t, _ in mine] == list(range(80)) and [x for _, x in mine] == sorted(x for _, x in mine)
    where = Counter((kin[r["doc_id"]], r["shard"]) for r in got if kin[r["doc_id"]] is not None)
    assert sum(n * n for n in where.values()) > 1.5 * 5 * 40 * 40 / 5
    # the order in which a table's rows were written, over files and rows
    table.repartitionByRange(7, "rank").sortWithinPartitions("rank").write.parquet(f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert [r["rank"] for r in back.select("rank", sharding.as_stored(back).alias("at")).orderBy("at").collect()] == list(range(400))
    assert table.select(sharding.as_stored(table)).distinct().count() == 400


# --- 6


def test_period_keeps_every_prefix_within_a_block():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 0.7, "b": 0.2, "c": 0.1}, {str(i): 1 + i for i in range(40)}, mixing.TARGET):
        quota = mixing.exact(weights)
        period, total = sum(quota.values()), sum(Fraction(w).limit_denominator(10**9) for w in weights.values())
        assert all(Fraction(q, period) == Fraction(weights[s]).limit_denominator(10**9) / total for s, q in quota.items())
        done = Counter()
        for t, s in enumerate(mixing.one_period(quota), 1):
            done[s] += 1
            assert all(abs(done[x] - Fraction(t * quota[x], period)) < 1 for x in quota)
        assert done == Counter(quota)


def test_millions_of_slots_keep_to_the_real_weights():
    weights = {s: Fraction(w).limit_denominator(1000) for s, w in mixing.TARGET.items()}
    assert sum(weights.values()) == 1
    first = mixing.phases(mixing.TARGET, dict.fromkeys(weights, 10**6))[0]
    assert first["period"] == 190
    for n in (4184, 6827, 70_000, 1_000_001, 5_000_003, first["length"]):
        for s, w in weights.items():
            assert abs(mixing.taken(first, s, n) - n * w) < 1
    # weights without a short period, and sources that run out
    blocks = {"a": 900, "b": 400, "c": 5}
    odd_weights = {"a": 0.6180339887, "b": 0.3141592653, "c": 0.0271828182}
    plan = mixing.phases(odd_weights, blocks)
    assert sum(x["length"] for x in plan) == sum(blocks.values())
    assert {s: sum(mixing.taken(x, s) for x in plan) for s in blocks} == blocks
    # a plan that would need too many slots has larger blocks
    rows, block = mixing.planned(odd_weights, {s: n * 64 * 4000 for s, n in blocks.items()}, 64)
    assert block > 64 and sum(r[3] - r[2] for r in rows) == sum(-(-n * 64 * 4000 // block) for n in blocks.values())


def test_many_sources_have_a_schedule_each():
    rng = random.Random(6)
    counts = {f"host{i}": rng.randrange(1, 900) for i in range(300)}
    rows, block = mixing.planned({s: Fraction(1) for s in counts}, counts, 4)
    assert block == 4 and {s: sum(r[3] - r[2] for r in rows if r[0] == s) for s in counts} == {s: -(-n // 4) for s, n in counts.items()}


def test_mix_is_whole_and_in_order(spark):
    rows = [(i, f"t{i}", f"s{i % 4}" if i % 10 else None, "k", "s") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, block string, position string")
    got = sorted(mixing.schedule(table, {"s0": 3, "s1": 1}, block_rows=8).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1500)) and len({r["doc_id"] for r in got}) == 1500
    # sources that are not listed, and the null one, weigh as much as the listed ones do on average
    share = {s: Fraction(w, 10) for s, w in {"s0": 3, "s1": 1, "s2": 2, "s3": 2, None: 2}.items()}
    slots = sorted({(r["slot"], r["source"], r["phase"]) for r in got}, key=lambda x: x[0])
    assert [t for t, _, _ in slots] == list(range(len(slots)))
    done = Counter()
    for t, s, phase in slots:
        if phase:
            break
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * share[x]) < 1 for x in share)
    assert sum(done.values()) > 40
    mixed = mixing.mixed(table, {"s0": 3, "s1": 1})
    assert mixed.columns == table.columns and mixed.count() == 1500


def test_mix_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (None, "x", "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert sorted(r["position"] for r in mixing.schedule(rows).collect()) == [0, 1, 2, 3]
    assert mixing.schedule(rows.limit(0)).count() == 0 and mixing.mixed(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(rows, {"a": 0})


# --- 1


def test_graph_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    graph, order = ann.build(ann._even(x), 1)
    v, q = x[order], rng.normal(size=(60, 24))
    found = graph.search(np.concatenate([q, np.zeros((60, 1))], 1).astype(np.float32), 160)
    score = np.take_along_axis(q @ v.T, found.astype(int), 1)
    best = np.take_along_axis(found, np.argsort(-score, 1)[:, :10], 1)
    truth = np.argsort(-(q @ v.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best, truth)]) > 0.9
    assert all(len(layer) >= len(upper) for layer, upper in zip(graph.layers, graph.layers[1:]))


def test_nearest_over_shards(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[50:150] = x[50]  # a hot vector
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=20, shard_rows=150).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for i in range(0, 400, 20):
        score = x @ x[i]
        want = sorted((j for j in range(400) if j != i), key=lambda j: (-round(float(score[j]), 10), j))[:20]
        rows = sorted(got[i])
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(abs(s - score[j]) < 1e-9 for _, j, s in rows)
        hit += len(set(want) & {j for _, j, _ in rows})
    assert hit >= 0.97 * 400


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0]), (20, [1.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, node int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=20).collect()]
    assert sorted(got) == [(0, 1, 7, 1.0), (0, 2, 20, 1.0), (0, 3, 6, 0.5), (20, 1, 0, 1.0), (20, 2, 7, 1.0), (20, 3, 6, 0.5)]
    assert ann.nearest(table.limit(0), table.limit(0)).count() == 0


def test_all_vectors_of_a_query_id_ask(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [2.0, 0.1]), (2, [0.1, 3.0]), (3, [-1.0, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, table.filter("vec_id = 0"), k=3).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 3.0), (2, 1, 2.0), (3, 3, -1.0)]


@pytest.mark.parametrize("name", ["op1_hnsw", "op6_pfair_mix", "op8_balanced_shards", "op10_ngram_jaccard_join"])
def test_registered_queries(spark, tmp_path, name):
    """The queries as the driver calls them, on tables with nulls, repeated rows and columns that bear the results' names."""
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)], 9, 9.0, "x") for i in range(60)] + [(None, [1.0, 1.0, 1.0], 1, 1.0, "x"), (3, None, 1, 1.0, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int, score double, node string").write.parquet(f"{tmp_path}/embeddings.parquet")
    texts = [f"words of text {i % 30} and more of them {i % 30}" for i in range(90)] + ["", None, "words of text 3 and more of them 3"]
    rows = [(i, t, "en", f"src{i % 3}", "a", "b", "c") for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None), (5, texts[5], "en", "src2", "a", "b", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, component_id string, shard string, position string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "op1_hnsw":
        best = defaultdict(list)
        for r in got:
            best[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        real = [(i, v) for i, v, *_ in vectors if i is not None and v]
        for i in (0, 20, 40):
            q = dict(real)[i]
            want = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in real if j != i))[:20]
            assert sorted(best[i]) == [(k, j, -s) for k, (s, j) in enumerate(want, 1)]
    elif name == "op10_ngram_jaccard_join":
        want = {i: c for i, (n, c) in plain_components([(i, t) for i, t, *_ in rows if i is not None], 3, 90).items()}
        assert len(got) == len(rows) and all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
        assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    elif name == "op8_balanced_shards":
        sizes = Counter(r["shard"] for r in got)
        assert len(got) == len(rows) and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
        assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, k) for s, n in sizes.items() for k in range(n))
    else:
        assert sorted(r["position"] for r in got) == list(range(len(rows))) and Counter(r["source"] for r in got) == Counter(r[3] for r in rows)
