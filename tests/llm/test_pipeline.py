"""The pipeline's stages, one after another, on a small table."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, mixing


@pytest.fixture
def folder(spark, tmp_path):
    words = "the and of to in that with for on was by this from are".split()
    rows = [(i, " ".join(f"{words[(i * 7 + j * j) % 14]}{'' if j % 3 else i * 13 + j}" for j in range(30 + i % 9)), "en" if i % 4 else "de", f"src{i % 5}", 1) for i in range(120)]
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(10)]
    rows += [(400, "Это довольно длинный текст на русском языке, который никто здесь не учил. " * 3, None, "src2", 9), (401, "qzxj wvkq jjxz qpwk vvzx kqjw xzqv pjkw zzqx jvwq kxzp " * 4, None, "src3", 9)]
    rows += [(300, None, None, None, None), (301, "12 34 !!", "en", "src0", 3), (302, "lead " + "benchmark passage of many words that nobody would write twice in a row today" + " tail", "en", "src1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "benchmark passage of many words that nobody would write twice in a row today")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "decontamination", "pfair_mix", "balanced_shards"]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(range(120))
    sizes = Counter(r["shard"] for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1


def test_all_but_the_last_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_the_mix_reaches_the_shards(spark, folder, monkeypatch):
    """Every shard is read in the order of the mix, and other weights give other rows."""
    run = lambda: {(r["doc_id"], r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, folder).collect()}
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    before = run()
    kept = spark.read.parquet(f"{folder}/documents.parquet").filter(F.col("doc_id").isin([i for i, _, _ in before]))
    place = {r["doc_id"]: r["position"] for r in mixing.schedule(kept, mixing.TARGET).collect()}
    for s in range(24):
        mine = [place[i] for _, i in sorted((slot, i) for i, shard, slot in before if shard == s)]
        assert mine == sorted(mine)
    monkeypatch.setattr(mixing, "TARGET", {"src4": 5.0, "src3": 1.0})
    after = run()
    assert {i for i, _, _ in after} == {i for i, _, _ in before} and after != before
    assert len(source) > len(before)


def test_the_language_told_decides(spark, folder, monkeypatch):
    """Machines that surely tell another language than a text's own reject it."""
    fit, docs = langid.fit, spark.read.parquet(f"{folder}/documents.parquet")
    stays = lambda: {r["doc_id"] for r in corpus_pipeline.language(spark, docs, folder).collect()}
    other = docs.filter("doc_id < 200").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("el los que del por una con para cuando entre desde hasta " * 4).alias("text"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("es").alias("lang"), "source", "n_chars")
    monkeypatch.setattr(langid, "fit", lambda _: fit(other))
    assert stays() >= set(range(120))

    def spanish(_):
        model = fit(other)
        model.biases = model.biases + np.array([-1000.0 if name[0] == "germanic" else 1000.0 for name in model.machines])
        return model

    monkeypatch.setattr(langid, "fit", spanish)
    assert not stays() & set(range(120))
