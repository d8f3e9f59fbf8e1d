"""A corpus pipeline over ``documents``: language, near copies, benchmark leaks, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of
``documents``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, langid, mixing, neardup, sharding
from quillgraph.llm.common import crc_mod
from quillgraph.session import Kept

#: Characters of a line that links documents in the last stage.
LONG_LINE = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, empty, without a letter, or not in the language that the family and pair machines tell (``langid.accepted``).

    Learned from the labelled documents that are not held out. Rows go by their text alone, whatever their other columns; an empty table stays empty.
    """
    model = langid.fit(docs.filter(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))))
    return langid.accepted(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts that are null or without words, and rows without an id, have no copies and stay. Of repeated rows one stays. An empty table stays empty.
    """
    return neardup.one_of_each(docs, words=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item occurs.

    Rows go by their text alone: null and empty texts stay, repeated rows and null ids stay or go with their text. Null items are skipped; empty tables do no harm.
    """
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order in which earliest-deadline-first interleaves the sources at the target weights.

    No row is dropped or repeated, whatever is null; the null source is one of its own. Equal rows may swap. An empty table stays empty.
    """
    return mixing.mixed(docs, mixing.TARGET)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's shard and slot: slots follow the order of the mix, so that every shard, read from its begin, is mixed as the whole is.

    Copies are gone by now: documents are linked that have the same smallest hash of their long lines. Texts that are null or without a long line have no
    link. Null and repeated ids are rows like any other. An empty table gives no rows.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= LONG_LINE)
    return sharding.shards(docs, 24, link=F.array_min(F.transform(lines, lambda x: F.xxhash64(x))), order=sharding.as_stored(docs))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("pfair_mix", mix),
    ("balanced_shards", shards),
]

#: SQL expresses neither the trained classifier nor label propagation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), Kept(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = kept.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
