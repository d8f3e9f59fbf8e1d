"""Mapping sets as tables: one row a mapping, all columns strings, an absent cell null."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators.components import connected_components

KEY = ("subject_id", "predicate_id", "object_id")

#: Predicates and what they become when subject and object change places.
INVERSE = {
    "skos:closeMatch": "skos:closeMatch",
    "skos:relatedMatch": "skos:relatedMatch",
    "skos:exactMatch": "skos:exactMatch",
    "skos:narrowMatch": "skos:broadMatch",
    "skos:broadMatch": "skos:narrowMatch",
    "semapv:crossSpeciesExactMatch": "semapv:crossSpeciesExactMatch",
    "semapv:crossSpeciesNarrowMatch": "semapv:crossSpeciesBroadMatch",
    "semapv:crossSpeciesBroadMatch": "semapv:crossSpeciesNarrowMatch",
    "owl:equivalentClass": "owl:equivalentClass",
    "owl:sameAs": "owl:sameAs",
    "rdfs:subClassOf": "sssom:superClassOf",
    "sssom:superClassOf": "rdfs:subClassOf",
}
#: Slots that exist for either side.
SIDED = ("id", "label", "category", "match_field", "source", "preprocessing", "source_version", "type")
#: Slots that a set may state once for all its mappings.
PROPAGATABLE = ("mapping_date", "mapping_provider", "mapping_tool", "mapping_tool_version", "object_match_field", "object_preprocessing", "object_source", "object_source_version", "object_type", "subject_match_field", "subject_preprocessing", "subject_source", "subject_source_version", "subject_type", "predicate_type", "similarity_measure", "cardinality_scope")
NO_TERM = "sssom:NoTermFound"
LITERAL = "rdfs literal"


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def confidence(df: DataFrame) -> Column:
    return _column(df, "confidence").try_cast("double")


def select(df: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows that match every slot, with any of its values; ``*`` stands for anything. A missing slot matches nothing."""
    for slot, globs in wanted.items():
        pattern = "|".join(".*".join(re.escape(p) for p in g.split("*")) for g in globs)
        df = df.filter(F.coalesce(_column(df, slot).rlike(f"^(?:{pattern})$"), F.lit(False)))
    return df


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(*df.columns)


def dedupe(df: DataFrame) -> DataFrame:
    """Of the rows of one (subject, predicate, object) those of the highest confidence, and all without a readable one; then distinct rows."""
    best = F.max(confidence(df)).over(Window.partitionBy(*KEY))
    own = confidence(df)
    return df.withColumn("_best", best).filter(own.isNull() | (own >= F.col("_best"))).drop("_best").distinct()


def remove(df: DataFrame, other: DataFrame, key: tuple[str, ...] = (*KEY, "mapping_justification")) -> DataFrame:
    """Rows of ``df`` whose key is not in ``other``; absent cells are equal."""
    gone = other.select(*[_column(other, k).alias(f"_{k}") for k in key]).distinct()
    return df.join(gone, [_column(df, k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")


def merge(sets: list[DataFrame], sources: list[str] | None = None) -> DataFrame:
    """All rows of all sets with all their columns; ``sources`` stamps where rows without a ``mapping_source`` come from."""
    out = None
    for i, s in enumerate(sets):
        if sources:
            s = s.withColumn("mapping_source", F.coalesce(_column(s, "mapping_source"), F.lit(sources[i])))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out.distinct()


def diff(one: DataFrame, two: DataFrame) -> DataFrame:
    """The rows of both sets, with ``comment`` telling whether the unordered pair of ids is in one set or in both."""

    def paired(df: DataFrame) -> DataFrame:
        return df.withColumn("_a", F.least("subject_id", "object_id")).withColumn("_b", F.greatest("subject_id", "object_id"))

    x, y = paired(one), paired(two)
    px, py = x.select("_a", "_b").distinct(), y.select("_a", "_b").distinct()
    arms = [
        x.join(py, ["_a", "_b"], "left_anti").withColumn("comment", F.lit("UNIQUE_1")),
        y.join(px, ["_a", "_b"], "left_anti").withColumn("comment", F.lit("UNIQUE_2")),
        x.join(py, ["_a", "_b"], "left_semi").withColumn("comment", F.lit("COMMON_TO_BOTH")),
        y.join(px, ["_a", "_b"], "left_semi").withColumn("comment", F.lit("COMMON_TO_BOTH")),
    ]
    out = arms[0]
    for arm in arms[1:]:
        out = out.unionByName(arm, allowMissingColumns=True)
    return out.drop("_a", "_b").distinct()


def invert(df: DataFrame, merge_inverted: bool = False, inverse: dict[str, str] | None = None) -> DataFrame:
    """Subject and object change places and the predicate becomes its inverse; rows whose predicate has none are dropped."""
    table = inverse or INVERSE
    new = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("predicate_id"))
    names = {f"{a}_{s}": f"{b}_{s}" for a, b in (("subject", "object"), ("object", "subject")) for s in SIDED}
    turned = df.filter(F.col("predicate_id").isin(list(table)))
    out = turned.select(*[(new if c == "predicate_id" else F.col(c)).alias(names.get(c, c)) for c in df.columns])
    out = out.select(*df.columns) if set(out.columns) == set(df.columns) else out
    return df.unionByName(out, allowMissingColumns=True).distinct() if merge_inverted else out


def crosstab(df: DataFrame, rows: str = "subject_category", columns: str = "object_category", values: list[str] | None = None) -> DataFrame:
    """How often each pair of values occurs; pairs that never do have 0. ``values`` fixes the columns and spares a pass."""
    pivot = df.groupBy(rows).pivot(columns, values) if values else df.groupBy(rows).pivot(columns)
    return pivot.count().fillna(0)


def cardinality(df: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """``mapping_cardinality``: subjects of the object, a colon, objects of the subject, within equal ``scope`` slots.

    A side that no term was found for is 0, and its row counts for no other. A literal side is known by its label.
    """

    def side(s: str) -> Column:
        return F.when(_column(df, f"{s}_type").eqNullSafe(LITERAL), _column(df, f"{s}_label")).otherwise(F.col(f"{s}_id"))

    def none(s: str) -> Column:
        return F.coalesce((F.col(f"{s}_id") == NO_TERM) | F.col(f"{s}_id").endswith("#NoTermFound"), F.lit(False))

    keyed = df.withColumns({"_s": side("subject"), "_o": side("object"), "_ns": none("subject"), "_no": none("object")})
    counts = keyed.filter("not _ns and not _no and _s is not null and _o is not null").select(*[F.coalesce(c, F.lit("")).alias(f"_k{i}") for i, c in enumerate(map(F.col, scope))], "_s", "_o").distinct()
    ks = [f"_k{i}" for i in range(len(scope))]
    objects = counts.groupBy(*ks, "_s").agg(F.count("*").alias("_os"))
    subjects = counts.groupBy(*ks, "_o").agg(F.count("*").alias("_ss"))
    keyed = keyed.withColumns({k: F.coalesce(F.col(c), F.lit("")) for k, c in zip(ks, scope, strict=True)})
    joined = keyed.join(objects, [*ks, "_s"], "left").join(subjects, [*ks, "_o"], "left")
    many = lambda c: F.when(F.col(c) > 1, "n").otherwise("1")
    found = F.when(F.col("_ns") | F.col("_no"), F.concat_ws(":", F.when(F.col("_ns"), "0").otherwise("1"), F.when(F.col("_no"), "0").otherwise("1")))
    known = F.when(F.col("_s").isNotNull() & F.col("_o").isNotNull(), F.concat_ws(":", many("_ss"), many("_os")))
    old = _column(df, "mapping_cardinality")
    names = [c for c in df.columns if c != "mapping_cardinality"]
    return joined.withColumn("_card", F.coalesce(found, known, old)).select(*names, F.col("_card").alias("mapping_cardinality"))


def partition(df: DataFrame) -> DataFrame:
    """``df`` with ``component``: the smallest id that its mappings connect."""
    parts = connected_components(df, "subject_id", "object_id")
    alone = F.least("subject_id", "object_id")
    return df.join(parts, F.col("subject_id") == F.col("node"), "left").withColumn("component", F.coalesce("component", alone)).drop("node")


def clique_summary(df: DataFrame) -> DataFrame:
    """Each component's ``size`` and its ``members``, sorted and joined by a pipe."""
    parts = connected_components(df, "subject_id", "object_id")
    return parts.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_set("node")), "|").alias("members"))


def split_key(df: DataFrame) -> DataFrame:
    """``df`` with the ``key`` it is split by: subject prefix, predicate's local name and object prefix, in lower case."""
    prefix = lambda c: F.substring_index(c, ":", 1)
    return df.withColumn("key", F.lower(F.concat_ws("_", prefix("subject_id"), F.substring_index("predicate_id", ":", -1), prefix("object_id"))))


def condense(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The set without the propagatable slots that hold one value in every row, and those values."""
    slots = [c for c in df.columns if c in PROPAGATABLE]
    if not slots:
        return df, {}
    row = df.agg(F.count("*").alias("n"), *[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n")).alias(c) for c in slots]).first()
    same = {c: row[c]["lo"] for c in slots if row["n"] and row[c]["n"] == row["n"] and row[c]["lo"] == row[c]["hi"]}
    return df.drop(*same), same


def propagate(df: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """The inverse of ``condense``: the set's values in rows that have none."""
    return df.withColumns({k: F.coalesce(_column(df, k), F.lit(v)) for k, v in metadata.items() if k in PROPAGATABLE})


def reconcile_prefixes(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Ids with other prefixes, all at once."""
    table = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])

    def renamed(c: str) -> Column:
        prefix = F.substring_index(c, ":", 1)
        known = F.element_at(table, prefix)
        return F.when(known.isNotNull() & (F.instr(c, ":") > 0), F.concat(known, F.substr(F.col(c), F.length(prefix) + 1))).otherwise(F.col(c))

    return df.withColumns({c: renamed(c) for c in df.columns if c.endswith("_id")})


def rewire(edges: DataFrame, df: DataFrame, precedence: list[str] = (), predicates: tuple[str, ...] = ("owl:equivalentClass", "owl:equivalentProperty", "owl:sameAs")) -> DataFrame:
    """``edges`` (subject, predicate, object) with ids replaced by the ones that they are mapped to as equivalent.

    An id with several targets takes the one whose prefix comes first in ``precedence``; without one it is an error.
    """
    rank = F.lit(len(precedence))
    for i, p in reversed(list(enumerate(precedence))):
        rank = F.when(F.col("object_id").startswith(f"{p}:"), F.lit(i)).otherwise(rank)
    eq = df.filter(F.col("predicate_id").isin(*predicates)).select("subject_id", "object_id").distinct().withColumn("rank", rank)
    best = eq.withColumn("k", F.rank().over(Window.partitionBy("subject_id").orderBy("rank"))).filter("k = 1")
    if not best.groupBy("subject_id").count().filter("count > 1").isEmpty():
        raise ValueError("an id has several equivalent targets; give a precedence of prefixes")
    to = best.select("subject_id", "object_id")
    for c in ("subject", "object"):
        new = to.select(F.col("subject_id").alias(c), F.col("object_id").alias("_new"))
        edges = edges.join(new, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return edges.select("subject", "predicate", "object")


@dataclass(frozen=True)
class Rule:
    """``where`` selects rows as ``select`` does; ``action`` is ``include``, ``stop`` or ``invert``."""

    where: dict[str, list[str]]
    action: str
    negate: bool = False


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules in order. Without rules all rows pass; otherwise a row must be included before something stops it.

    ``invert`` turns matching rows around for the rules after it; those that cannot be inverted are dropped.
    """
    if not rules:
        return df
    now = df.withColumns({"_in": F.lit(False), "_stop": F.lit(False)})
    for r in rules:
        hit = F.lit(True)
        for slot, globs in r.where.items():
            pattern = "|".join(".*".join(re.escape(p) for p in g.split("*")) for g in globs)
            hit = hit & F.coalesce(_column(now, slot).rlike(f"^(?:{pattern})$"), F.lit(False))
        hit = (~hit if r.negate else hit) & ~F.col("_stop")
        if r.action == "include":
            now = now.withColumn("_in", F.col("_in") | hit)
        elif r.action == "stop":
            now = now.withColumn("_stop", F.col("_stop") | hit)
        elif r.action == "invert":
            flagged = now.withColumn("_hit", hit)
            now = flagged.filter(~F.col("_hit")).unionByName(invert(flagged.filter("_hit"))).drop("_hit")
        else:
            raise ValueError(f"unknown action {r.action!r}")
    return now.filter("_in").drop("_in", "_stop")


#: What a mapping needs, and the ranges of its numbers.
REQUIRED = ("subject_id", "predicate_id", "object_id", "mapping_justification")
RANGES = {"confidence": (0.0, 1.0), "similarity_score": (0.0, 1.0), "reviewer_agreement": (-1.0, 1.0)}
DATES = ("mapping_date", "publication_date", "review_date")
_CURIE = "^[A-Za-z_][A-Za-z0-9_.-]*:\\S*$"


def validate(df: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """(``category``, ``slot``, ``subject_id``, ``object_id``, ``value``) of every violation: required slots, ranges, dates, CURIEs, prefixes, reviewers."""
    arms = []

    def fails(category: str, slot: str, bad: Column) -> None:
        arms.append(df.filter(bad).select(F.lit(category).alias("category"), F.lit(slot).alias("slot"), "subject_id", "object_id", _column(df, slot).alias("value")))

    literal = {s: _column(df, f"{s}_type").eqNullSafe(LITERAL) for s in ("subject", "object")}
    for slot in REQUIRED:
        s = slot.split("_")[0]
        missing = F.coalesce(_column(df, slot), F.lit("")) == ""
        if s in literal:
            missing = F.when(literal[s], F.coalesce(_column(df, f"{s}_label"), F.lit("")) == "").otherwise(missing)
        fails("required", slot, missing)
    for slot, (low, high) in RANGES.items():
        n = _column(df, slot).try_cast("double")
        fails("datatype", slot, _column(df, slot).isNotNull() & (n.isNull() | (n < low) | (n > high)))
    for slot in DATES:
        fails("datatype", slot, _column(df, slot).isNotNull() & _column(df, slot).try_cast("date").isNull())
    for slot in ("subject_id", "predicate_id", "object_id"):
        fails("curie", slot, F.col(slot).isNotNull() & ~F.col(slot).rlike(_CURIE))
        if prefixes is not None:
            fails("prefix", slot, F.col(slot).rlike(_CURIE) & ~F.substring_index(slot, ":", 1).isin(prefixes))
    reviewer = _column(df, "reviewer_id").isNull() & _column(df, "reviewer_label").isNull()
    for slot in ("review_date", "reviewer_agreement"):
        fails("crossfield", slot, _column(df, slot).isNotNull() & reviewer)
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out


#: Slots that hold lists, floats of a row, and the order of columns that written sets have.
MULTIVALUED = ("creator_id", "creator_label", "author_id", "author_label", "reviewer_id", "reviewer_label", "mapping_source", "subject_match_field", "object_match_field", "subject_preprocessing", "object_preprocessing", "match_string", "curation_rule", "curation_rule_text", "see_also", "other", "subject_source", "object_source")
FLOATS = ("confidence", "similarity_score")
COLUMN_ORDER = (
    "record_id subject_id subject_label subject_category predicate_id predicate_label predicate_modifier object_id object_label object_category mapping_justification author_id author_label reviewer_id reviewer_label creator_id creator_label license "
    "subject_type subject_source subject_source_version object_type object_source object_source_version predicate_type mapping_provider mapping_source mapping_cardinality mapping_tool mapping_tool_id mapping_tool_version mapping_date publication_date review_date "
    "reviewer_agreement confidence curation_rule curation_rule_text subject_match_field object_match_field match_string subject_preprocessing object_preprocessing similarity_score similarity_measure see_also issue_tracker_item other comment"
).split()
#: Prefixes that need no declaration, and how an ontology's header wants its cross-references read.
BUILT_IN_PREFIXES = ("owl", "rdf", "rdfs", "semapv", "skos", "sssom", "xsd", "linkml")
TREATED = {"treat-xrefs-as-equivalent": "skos:exactMatch", "treat-xrefs-as-is_a": "skos:broadMatch", "treat-xrefs-as-has-subclass": "skos:narrowMatch", "treat-xrefs-as-genus-differentia": "semapv:crossSpeciesExactMatch", "treat-xrefs-as-reverse-genus-differentia": "semapv:crossSpeciesExactMatch"}


def annotate(metadata: dict, values: dict[str, list[str]], replace: bool = False) -> dict:
    """A set's metadata with ``values``: lists are appended to, or replaced on request; other slots take their last value."""
    out = dict(metadata)
    for slot, new in values.items():
        if slot not in MULTIVALUED:
            out[slot] = new[-1] if new else ""
            continue
        before = out.get(slot, [])
        before = before if isinstance(before, list) else [before]
        out[slot] = list(new) if replace else [*before, *new]
    return out


def rounded(df: DataFrame, places: int = 3) -> DataFrame:
    """Numbers in ``FLOATS`` with so many places at most, without zeros at their end; what is no number stays."""
    for c in FLOATS:
        if c in df.columns:
            x = F.regexp_replace(F.format_string(f"%.{places}f", F.col(c).try_cast("double")), "\\.?0+$", "")
            df = df.withColumn(c, F.when(F.col(c).try_cast("double").isNotNull(), x).otherwise(F.col(c)))
    return df


def canonicalize(df: DataFrame, metadata: dict) -> tuple[DataFrame, dict]:
    """A set as it is published: slots with one value for all rows stand in the metadata, numbers are rounded, only prefixes in use are declared, columns and rows are in order."""
    df, same = condense(df)
    names = [c for c in COLUMN_ORDER if c in df.columns] + sorted(c for c in df.columns if c not in COLUMN_ORDER)
    df = rounded(df).select(*names)
    out = dict(metadata) | same
    if isinstance(out.get("curie_map"), dict):
        ids = [c for c in names if c.endswith("_id") or c in ("mapping_justification", "subject_category", "object_category")]
        used = {r[0] for c in ids for r in df.select(F.substring_index(c, ":", 1)).filter(F.col(c).contains(":")).distinct().collect()}  # prefixes are few
        used |= {str(v).split(":", 1)[0] for k, v in out.items() if k != "curie_map" and isinstance(v, str)}
        out["curie_map"] = {p: iri for p, iri in out["curie_map"].items() if p in used and p not in BUILT_IN_PREFIXES}
    return df.orderBy(*names), out


def xref_extract(
    statements: DataFrame, predicates: dict[str, str] | None = None, every: bool = False, obsolete: bool = False, drop_duplicates: bool = False, ignore_header: bool = False
) -> DataFrame:
    """Mappings from the cross-references of declared classes.

    A reference's prefix gives the predicate: by the ontology's own header (``TREATED``, unless ``ignore_header``) and by ``predicates``, which comes first; other
    references are left out, or, with ``every``, are ``oio:hasDbXref``. Deprecated classes are left out unless ``obsolete``. ``drop_duplicates`` drops references that
    several classes have, after stating ``mapping_cardinality``.
    """
    classes = statements.filter("predicate = 'rdf:type' and object = 'owl:Class' and subject not like '\\\\_:%'").select("subject").distinct()
    if not obsolete:
        classes = classes.join(statements.filter("predicate = 'owl:deprecated' and value = 'true'").select("subject").distinct(), "subject", "left_anti")
    known = dict(predicates or {})
    if not ignore_header:
        told = F.substring_index("predicate", ":", -1)
        for r in statements.filter(F.col("predicate").startswith("oio:") & told.isin(*TREATED)).select(told.alias("how"), "value").distinct().orderBy("how", "value").collect():  # the header
            known.setdefault((r["value"] or "").split(" ")[0], TREATED[r["how"]])
    prefix = F.substring_index("value", ":", 1)
    predicate = F.lit("oio:hasDbXref") if every else F.lit(None).cast("string")
    for p, to in known.items():
        predicate = F.when(prefix == p, F.lit(to)).otherwise(predicate)
    labels = statements.filter("predicate = 'rdfs:label'").groupBy("subject").agg(F.min("value").alias("subject_label"))
    refs = statements.filter("predicate = 'oio:hasDbXref' and value like '%:%'").join(classes, "subject", "left_semi").withColumn("predicate_id", predicate).filter("predicate_id is not null")
    rows = refs.join(labels, "subject", "left").select(F.col("subject").alias("subject_id"), "subject_label", "predicate_id", F.col("value").alias("object_id"), F.lit("semapv:UnspecifiedMatching").alias("mapping_justification")).distinct()
    if not drop_duplicates:
        return rows
    rows = cardinality(rows)
    several = rows.groupBy("object_id").agg(F.count_distinct("subject_id").alias("n")).filter("n > 1").select("object_id")
    return rows.join(several, "object_id", "left_anti").select(*rows.columns)


def inject(df: DataFrame, rules: list[dict]) -> DataFrame:
    """``statements`` that a set's mappings make, by ``rules`` in order: ``where`` (slots and globs, as for ``select``) and an action: ``stop``, ``invert``, or ``make`` with
    ``subject``, ``predicate`` and ``object`` or ``value``, in which ``{slot}`` stands for the row's value. A row that a ``stop`` rule matches goes no further.
    """
    null, out = F.lit(None).cast("string"), None

    def said(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[F.lit(x) if i % 2 == 0 else F.coalesce(_column(df, x), F.lit("")) for i, x in enumerate(parts)])

    for r in rules:
        mine = select(df, r.get("where", {}))
        if r["do"] == "stop":
            df = df.exceptAll(mine)
        elif r["do"] == "invert":
            df = df.exceptAll(mine).unionByName(invert(mine).select(*df.columns))
        elif r["do"] == "make":
            s = said(r["subject"])
            made = mine.select(s.alias("stanza"), s.alias("subject"), said(r["predicate"]).alias("predicate"), (said(r["object"]) if "object" in r else null).alias("object"), (said(r["value"]) if "value" in r else null).alias("value"), (F.lit("xsd:string") if "value" in r else null).alias("datatype"), null.alias("language"))
            out = made if out is None else out.unionByName(made)
        else:
            raise ValueError(f"unknown action {r['do']!r}")
    if out is None:
        raise ValueError("no rule makes anything")
    return out.distinct()


def to_json(df: DataFrame, metadata: dict) -> DataFrame:
    """A set as JSON lines (``value``): one of the metadata, and one of each mapping, lists as lists and numbers as numbers."""
    import json

    def cell(c: str) -> Column:
        x = F.nullif(F.col(c), F.lit(""))
        if c in MULTIVALUED:
            return F.transform(F.split(x, r"(?<!\\)\|"), lambda v: F.replace(v, F.lit("\\|"), F.lit("|"))).alias(c)
        return (x.try_cast("double") if c in FLOATS else x).alias(c)

    rows = df.select(F.to_json(F.struct(*[cell(c) for c in df.columns])).alias("value"))
    return df.sparkSession.createDataFrame([(json.dumps(metadata, ensure_ascii=False),)], "value string").union(rows)


def dosql(query: str, **tables: DataFrame) -> DataFrame:
    """Any SQL over mapping sets bound by name; ``df`` is the last. Columns whose non-empty values are all numbers are numbers, as far as the query names them."""
    bound, words = {}, set(re.findall(r"\w+", query.lower()))
    for name, df in tables.items():
        names = [c for c, t in df.dtypes if t == "string" and ("*" in query or c.lower() in words)]
        if not names:
            bound[name] = df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
            continue
        row = df.agg(*[F.sum(((F.coalesce(F.col(c), F.lit("")) != "") & F.col(c).try_cast("double").isNull()).cast("int")).alias(c) for c in names], *[F.count(F.nullif(F.col(c), F.lit(""))).alias(f"_n_{c}") for c in names]).first() if names else {}
        typed = [F.nullif(F.col(c), F.lit("")).cast("double").alias(c) if c in names and row[f"_n_{c}"] and not row[c] else F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
        bound[name] = df.select(*typed)
    spark = next(iter(tables.values())).sparkSession
    last = list(bound.values())[-1]
    text = re.sub(r"(?i)\b(from|join)\s+(\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in bound or m[2] == "df" else m[0], query)
    return spark.sql(text, **(bound | {"df": last}))
