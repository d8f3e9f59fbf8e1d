"""Line checks of delimited tables, and tables of translations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.sources.tables import ABSENT


def lint_table(spark: SparkSession, path: str, comment: str | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(``file``, ``line``, ``code``, ``cell``) of what is wrong with tab-separated files. Codes, as linters of such tables have them: E1 a carriage return,
    E2 and E3 a cell that begins or ends with white space, E4 another number of tabs than the header has, E5 an empty line, E6 an empty header cell,
    E8 a column without values (line 0), E10 a repeated header cell, W1 a character that is not printable ASCII. Lines that begin with ``comment`` are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\n$", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")
    if comment:
        lines = lines.filter(~F.col("text").startswith(comment))
    head = lines.groupBy("file").agg(F.min_by("text", "line").alias("head"), F.min("line").alias("first"))
    lines = lines.join(F.broadcast(head), "file")  # a row for each file
    cells = lines.filter("text <> ''").select("file", "line", "first", F.posexplode(F.split("text", "\t")).alias("at", "cell"))
    none = F.lit(None).cast("int")
    arms = {
        "E1": lines.filter(F.col("text").contains("\r")).select("file", "line", none),
        "E2": cells.filter(F.col("cell").rlike("^\\s")).select("file", "line", F.col("at") + 1),
        "E3": cells.filter(F.col("cell").rlike("[^\\S\\r]$")).select("file", "line", F.col("at") + 1),
        "E4": lines.filter((F.col("text") != "") & (F.size(F.split("text", "\t")) != F.size(F.split("head", "\t")))).select("file", "line", none),
        "E5": lines.filter("text = ''").select("file", "line", none),
        "E6": cells.filter("line = first and trim(cell) = ''").select("file", "line", F.col("at") + 1),
        "E8": cells.filter("line > first").groupBy("file", "at").agg(F.max(F.trim("cell") != "").alias("some")).filter("not some").select("file", F.lit(0), F.col("at") + 1),
        "E10": cells.filter("line = first").withColumn("n", F.count("*").over(Window.partitionBy("file", "cell"))).filter("n > 1 and trim(cell) <> ''").select("file", "line", F.col("at") + 1),
        "W1": lines.filter(F.col("text").rlike("[^\\t\\r\\x20-\\x7e]")).select("file", "line", none),
    }
    out = [df.toDF("file", "line", "cell").select("file", "line", F.lit(code).alias("code"), "cell") for code, df in arms.items() if code not in skip]
    return reduce(DataFrame.unionByName, out)


#: The columns of a table of translations.
TRANSLATION = "subject_id predicate_id source_value source_language translation_value translation_language source_version translation_type translator translator_expertise translation_date translation_confidence translation_precision translation_status source comment".split()


def merge_translations(tables: list[DataFrame], known_only: bool = False) -> DataFrame:
    """The rows of all tables, equal ones once, sorted by subject, predicate and source value; a column that a table lacks is empty, and columns stand in the
    order in which they are first seen. ``known_only`` drops columns that translations do not have. Of equal keys rows of earlier tables come first.
    """
    names = list(dict.fromkeys(c for t in tables for c in t.columns))
    names = [c for c in names if not known_only or c in TRANSLATION]
    rows = reduce(
        DataFrame.unionByName,
        [t.select(*[F.when(~F.col(f"`{c}`").isin(*ABSENT), F.col(f"`{c}`")).alias(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in names], F.lit(i).alias("_t")) for i, t in enumerate(tables)],
    )
    rows = rows.groupBy(*names).agg(F.min("_t").alias("_t"))
    return rows.orderBy(*[c for c in ("subject_id", "predicate_id", "source_value") if c in names], "_t", *names).select(*names)


def untranslated(statements: DataFrame, translations: DataFrame, language: str, predicates: tuple[str, ...] = ("rdfs:label", "IAO:0000115", "oio:hasExactSynonym")) -> DataFrame:
    """Rows for translators: labels, definitions and synonyms that have no translation into ``language`` yet, or one of another text."""
    source = statements.filter(F.col("predicate").isin(*predicates) & F.col("value").isNotNull() & ~F.col("subject").startswith("_:"))
    source = source.select(F.col("subject").alias("subject_id"), F.col("predicate").alias("predicate_id"), F.col("value").alias("source_value"), F.coalesce(F.nullif("language", F.lit("")), F.lit("en")).alias("source_language")).distinct()
    done = translations.filter(F.col("translation_language") == language).select("subject_id", "predicate_id", "source_value").distinct()
    rows = source.join(done, ["subject_id", "predicate_id", "source_value"], "left_anti")
    return rows.withColumns({"translation_value": F.lit(None).cast("string"), "translation_language": F.lit(language), "translation_status": F.lit("NOT_TRANSLATED")})


def translated(translations: DataFrame, status: tuple[str, ...] = ("OFFICIAL",)) -> DataFrame:
    """``statements`` of the translations whose status is one of ``status``."""
    rows = translations.filter(F.col("translation_status").isin(*status) & F.col("translation_value").isNotNull())
    null = F.lit(None).cast("string")
    return rows.select(F.col("subject_id").alias("stanza"), F.col("subject_id").alias("subject"), F.col("predicate_id").alias("predicate"), null.alias("object"), F.col("translation_value").alias("value"), null.alias("datatype"), F.col("translation_language").alias("language")).distinct()
