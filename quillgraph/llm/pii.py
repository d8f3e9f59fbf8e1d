"""Personal data replaced by surrogates: keyed, of the same type, gender, script and format.

Entities are found by patterns and checked by what their type demands (check digits, issuers, octets). An entity's surrogate
comes from a keyed hash of its normal form, so that the same entity gets the same surrogate in every document and spelling,
and a surname after a title alone has the one that it has in the full name. Before use, surrogates are checked against one another and
against all entities of the corpus: an entity whose surrogate is taken, or is someone's real value, draws again with the next
attempt, until all are distinct; from the ``GROWN``-th on, surrogates get longer, so that spaces which the corpus fills (all mailboxes of
one letter) do not run out. A person's surrogate does not depend on the title before the name: a first name's gender is what lists of names say, else
what all titles in the corpus say. Everything is DataFrame functions: no Python runs on the executors.

Types: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (with check digit), IBANs (with check digits), US social
security numbers, and names (after a title, or after a common first name).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.session import Kept

KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "name")
MAX_ATTEMPTS = 40
GROWN = 6
#: Entities that one task works on.
TASK_ROWS = 2000

#: Titles and common first names, by the gender they tell.
TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Sig|господин"
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|госпожа"
TITLES_N = "Dr|Prof"
MALE = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Hans|Jürgen|Wolfgang|Stefan|Pierre|Jacques|François|Antoine|José|Carlos|Miguel|Javier|Alejandro|Иван|Сергей|Дмитрий"
FEMALE = "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Emily|Ursula|Monika|Sabine|Claudia|Isabelle|Nathalie|Françoise|Catherine|María|Carmen|Lucía|Gabriela|Анна|Мария|Ольга"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_CAPITAL = "\\p{Lu}[\\p{L}'’-]+"
PATTERNS = {
    "email": "[\\p{L}\\p{N}._%+-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)*\\.\\p{L}{2,}",
    "phone": "(?:\\+?[0-9]{1,3}[ .-]?)?\\([0-9]{2,4}\\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])",
    "ip": f"{_OCTET}(?:\\.{_OCTET}){{3}}(?!\\.?[0-9])",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}(?![0-9])|[2-6][0-9]{12,18}(?![0-9])",
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": f"(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\\.? {_CAPITAL}(?: {_CAPITAL})?|(?:{MALE}|{FEMALE}) {_CAPITAL}",
}
#: No entity begins inside a word or number.
_START = "(?<![\\p{L}\\p{N}._%+@-])"
FINDER = _START + "(?:" + "|".join(f"(?:{p})" for p in (PATTERNS[k].replace("([ -])", "(?:[ -])").replace("\\1", "[ -]") for k in KINDS)) + ")"

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ACCENTED, _CYRILLIC = "àáâäçèéêëíîïñóôöùúûü", "абвгдежзиклмнопрстуфхцчшэюя"
_SYLLABLES = "ba be bri ca cla da de do el fa fe ga gre ha he ja jo ka ke la le lo ma me mi mo na ne no pa pe ra ro sa se si ta te to va ve wi za".split()
_SYLLABLES_CYRILLIC = "ба ве га де за ка ко ла ле ма ми на не по ра ро са се та ти".split()


def _digest(key: str, text: Column) -> Column:
    """128 hexadecimal digits that only the key's holder can tell from ``text``."""
    return F.sha2(F.concat(F.lit(key), F.lit("|"), F.sha2(F.concat(F.lit(key), F.lit("|"), text), 512)), 512)


def _value(digest: Column, i: Column) -> Column:
    """The ``i``-th of the digest's 64 bytes, counted from 0, over and over."""
    return F.conv(F.substr(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(text: str, at: Column) -> Column:
    return F.substr(F.lit(text), at % len(text) + 1, F.lit(1))


def _each(text: Column, to) -> Column:
    """``to(character, its position from 0)`` of all characters, joined."""
    spread = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: to(F.substr(text, i, F.lit(1)), i - 1))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(spread, ""))


def _redrawn(text: Column, digest: Column) -> Column:
    """Each letter and digit by another of its script and case; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        v = _value(digest, i)
        return (
            F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
            .when(c.rlike("[a-z]"), _pick(_LOWER, v))
            .when(c.rlike("[A-Z]"), _pick(_UPPER, v))
            .when(c.rlike("\\p{IsCyrillic}"), F.when(c.rlike("\\p{Lu}"), F.upper(_pick(_CYRILLIC, v))).otherwise(_pick(_CYRILLIC, v)))
            .when(c.rlike("\\p{L}"), F.when(c.rlike("\\p{Lu}"), F.upper(_pick(_ACCENTED, v))).otherwise(_pick(_ACCENTED, v)))
            .otherwise(c)
        )

    return _each(text, one)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The sum of check that a valid number has divisible by ten."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), step)


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN, given without blanks."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(rest: Column, i: Column) -> Column:
        c = F.substr(turned, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step)


def _kind(m: Column) -> Column:
    """A match's type, or null if it fails its type's check."""
    out = F.lit(None).cast("string")
    number = _digits(m)
    for kind in reversed(KINDS):
        fits = m.rlike(f"^(?:{PATTERNS[kind]})$")
        if kind == "card":
            fits = fits & F.length(number).between(13, 19) & number.rlike("^(?:[3-6]|2[2-7])") & (_luhn(number) % 10 == 0)
        if kind == "iban":
            fits = fits & (_mod97(F.regexp_replace(m, " ", "")) == 1)
        out = F.when(fits, kind).otherwise(out)
    return out


_TITLE = f"^(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\\.? "
_UNTITLED = f"^(?:(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\\.? )?"


def _words(m: Column) -> Column:
    """A name's words without its title."""
    return F.split(F.regexp_replace(m, _TITLE, ""), " ")


def _parts(m: Column, kind: Column) -> Column:
    """What of a match is looked up: (part kind, normal form, gender by list, gender by title). A name has one for each of its words but the title, all others one."""
    words = _words(m)
    listed = F.when(m.rlike(f"{_UNTITLED}(?:{MALE}) "), "m").when(m.rlike(f"{_UNTITLED}(?:{FEMALE}) "), "f")
    titled = F.when(m.rlike(f"^(?:{TITLES_M})\\.? "), "m").when(m.rlike(f"^(?:{TITLES_F})\\.? "), "f")
    script = lambda w: F.when(w.rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    none = F.lit(None).cast("string")
    name = F.transform(
        words,
        lambda w, i: F.struct(
            F.when((i == 0) & (F.size(words) > 1), F.concat_ws("_", F.lit("first"), script(w))).otherwise(F.concat_ws("_", F.lit("last"), script(w))).alias("part"),
            F.lower(w).alias("norm"),
            F.when((i == 0) & (F.size(words) > 1), listed).alias("listed"),
            F.when((i == 0) & (F.size(words) > 1), titled).alias("titled"),
        ),
    )
    code = F.when(m.startswith("+"), F.regexp_extract(m, "^\\+([0-9]*)", 1)).otherwise("")
    norm = (
        F.when(kind == "phone", F.concat(code, F.lit("|"), F.substr(_digits(m), F.length(code) + 1)))
        .when(kind.isin("card", "ssn"), _digits(m))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(F.lower(m))
    )
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("part"), norm.alias("norm"), none.alias("listed"), none.alias("titled"))))


def _gendered(parts: DataFrame) -> DataFrame:
    """(``part``, ``norm``, ``gender``) of all entities: of a first name, what the lists say, else what all its titles say, if they agree."""
    found = parts.groupBy("part", "norm").agg(F.min("listed").alias("listed"), F.min("titled").alias("low"), F.max("titled").alias("high"))
    gender = F.coalesce("listed", F.when(F.col("low") == F.col("high"), F.col("low")), F.lit("n"))
    return found.select("part", "norm", F.when(F.col("part").startswith("first"), gender).alias("gender"))


def _drawn(part: Column, norm: Column, gender: Column, key: str, attempt: int) -> Column:
    """The surrogate of a normal form, itself a normal form."""
    h = _digest(key, F.concat_ws("|", part, norm, F.lit(str(attempt))))
    more = max(0, attempt + 1 - GROWN)

    def longer(text: Column, like: str) -> Column:
        """The text with as many more characters like ``like`` as the attempt asks for."""
        return F.concat(text, F.lit(like * more)) if more else text

    domain = F.substring_index(norm, "@", -1)
    host = F.regexp_replace(domain, "\\.[^.]*$", "")
    email = F.concat(_redrawn(longer(F.substring_index(norm, "@", 1), "a"), h), F.lit("@"), _redrawn(host, _digest(key, F.concat(F.lit("host|"), domain))), F.substr(domain, F.length(host) + 1))
    code = F.substring_index(norm, "|", 1)
    phone = F.concat(code, F.lit("|"), _redrawn(longer(F.substr(norm, F.length(code) + 2), "0"), h))
    inner = F.substr(norm, F.lit(2), F.greatest(F.length(norm) - 2, F.lit(0)))
    body = F.concat(F.substr(norm, F.lit(1), F.lit(1)), _redrawn(longer(inner, "0"), h))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    account = _redrawn(longer(F.substr(norm, F.lit(5)), "0"), h)
    check = 98 - _mod97(F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lit("00"), account))
    iban = F.concat(F.substr(norm, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), account)
    # a private address stays in its network, then in the largest one, and then is any address that is not special
    private = F.regexp_extract(norm, "^(10\\.|192\\.168\\.|172\\.(?:1[6-9]|2[0-9]|3[01])\\.|127\\.)", 1)
    if more:
        private = F.when(private == "", "").otherwise("10." if more < GROWN else "")
    octets = [_value(h, F.lit(i)).cast("string") for i in range(3)]
    first = F.element_at(F.array(*[F.lit(x) for x in range(1, 224) if x not in (10, 127, 169, 172, 192)]), ((_value(h, F.lit(3)) * 256 + _value(h, F.lit(4))) % 218 + 1).cast("int"))
    fresh = F.concat_ws(".", first.cast("string"), *octets)
    kept = F.concat(private, F.when(private.rlike("\\..*\\."), F.concat_ws(".", *octets[:2])).otherwise(F.concat_ws(".", *octets)))
    ip = F.when(private == "", fresh).otherwise(kept)

    def word(syllables: list[str], endings: list[str]) -> Column:
        stem = F.concat(*[F.element_at(F.array(*[F.lit(x) for x in syllables]), (_value(h, F.lit(10 + i)) % len(syllables) + 1).cast("int")) for i in range(2 + attempt)])
        return F.concat(stem, F.element_at(F.array(*[F.lit(x) for x in endings]), (_value(h, F.lit(9)) % len(endings) + 1).cast("int")))

    out = F.when(part == "email", email).when(part == "phone", phone).when(part == "ssn", _redrawn(longer(norm, "0"), h)).when(part == "card", card).when(part == "iban", iban).when(part == "ip", ip)
    for of, latin, cyrillic in (("m", ["us", "ert", "o", "ard"], ["ан", "ир"]), ("f", ["a", "ina", "elle", "ia"], ["а", "ия"]), ("n", ["in", "y", "is"], ["ь"])):
        out = out.when((part == "first_latin") & (gender == of), word(_SYLLABLES, latin)).when((part == "first_cyrillic") & (gender == of), word(_SYLLABLES_CYRILLIC, cyrillic))
    return out.when(part == "last_latin", word(_SYLLABLES, ["son", "er", "ier", "ez", "mann", "ley"])).otherwise(word(_SYLLABLES_CYRILLIC, ["ов", "ин"]))


def _spread(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """As many partitions as there are ``TASK_ROWS``: a row costs much more to work on than to read."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *by)


def assign(entities: DataFrame, key: str, kept: Kept) -> DataFrame:
    """(``part``, ``norm``, ``surrogate``) of all ``entities`` (``part``, ``norm``, ``gender``), distinct and never the value of another entity, for each
    part kind; first and last names are one kind in this.
    """
    space = F.when(F.col("part").rlike("^(?:first|last)_"), "name").otherwise(F.col("part"))
    real = kept.keep(entities.distinct().withColumn("space", space), "real")
    done, pending = [], real
    for attempt in range(MAX_ATTEMPTS):
        drawn = _spread(pending, pending.count(), "part", "norm").withColumn("surrogate", _drawn(F.col("part"), F.col("norm"), F.col("gender"), key, attempt))
        taken = reduce(DataFrame.unionByName, [d.select("space", "surrogate") for d in done], real.select("space", F.col("norm").alias("surrogate")))
        free = drawn.join(taken, ["space", "surrogate"], "left_anti")
        first = free.groupBy("space", "surrogate").agg(F.min(F.struct("norm", "part")).alias("k")).select("space", "surrogate", "k.norm", "k.part")
        done.append(kept.keep(first, f"attempt{attempt}"))
        pending = kept.keep(pending.join(done[-1], ["part", "norm"], "left_anti"), f"pending{attempt}")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done).select("part", "norm", "surrogate")
    raise RuntimeError(f"no distinct surrogates after {MAX_ATTEMPTS} attempts")


def _laid_out(m: Column, kind: Column, surrogates: Column) -> Column:
    """Surrogates in the format of the match ``m``; what a longer one has more stands at its end."""
    one = F.element_at(surrogates, 1)
    number = F.regexp_replace(one, "\\|", "")
    # the n-th digit (for IBANs: character) of the match is the surrogate's n-th
    size = lambda text, rest: F.length(F.regexp_replace(text, rest, ""))
    nth = lambda i, rest: size(F.substr(m, F.lit(1), i + 1), rest)
    digits = F.concat(_each(m, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(number, nth(i, "[^0-9]"), F.lit(1))).otherwise(c)), F.substr(number, size(m, "[^0-9]") + 1))
    iban = F.concat(_each(m, lambda c, i: F.when(c != " ", F.substr(one, nth(i, " "), F.lit(1))).otherwise(c)), F.substr(one, size(m, " ") + 1))
    cased = F.zip_with(_words(m), surrogates, lambda w, s: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(s)).otherwise(F.initcap(s)))
    name = F.concat(F.regexp_extract(m, _TITLE, 0), F.array_join(cased, " "))
    email = F.when(m == F.upper(m), F.upper(one)).otherwise(one)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", iban).when(kind == "name", name).when(kind == "email", email).otherwise(one)


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, its ``text`` with surrogates, the number of entities of each type, and the ``surrogates`` in text order.

    Null and empty texts stay as they are. Rows without an id are treated like all others; repeated rows give repeated rows.
    The same entity has the same surrogate in all rows; ties for one surrogate go to the entity whose normal form comes first. Other
    columns are ignored. An empty table gives an empty result.
    """
    kept = Kept(docs.sparkSession, "pii")
    given = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    some = F.coalesce(F.col("_t").rlike(FINDER), F.lit(False))
    hits = given.filter(some).select("_id", F.split("_t", FINDER, -1).alias("gaps"), F.regexp_extract_all("_t", F.lit(FINDER), F.lit(0)).alias("found"), F.xxhash64("_id", "_t").alias("row"), F.hash("_t").alias("row2"))
    hits = kept.keep(hits, "hits")
    each = hits.dropDuplicates(["row", "row2"]).select("row", "row2", F.posexplode("found").alias("pos", "m"))
    kinds = kept.keep(each.select("m").distinct().withColumn("kind", _kind(F.col("m"))).filter("kind is not null"), "kinds")
    parts = kinds.select("m", "kind", F.posexplode(_parts(F.col("m"), F.col("kind"))).alias("k", "p")).select("m", "kind", "k", "p.*")
    parts = kept.keep(parts, "parts")
    given_to = assign(_gendered(parts), key, kept)
    new = parts.join(given_to, ["part", "norm"]).groupBy("m", "kind").agg(F.array_sort(F.collect_list(F.struct("k", "surrogate"))).alias("s"))
    new = kept.keep(_spread(new, kinds.count(), "m").select("m", "kind", _laid_out(F.col("m"), F.col("kind"), F.transform("s", lambda x: x["surrogate"])).alias("s")), "new")
    told = each.join(new, "m", "left").select("row", "row2", F.struct("pos", F.coalesce("s", "m").alias("s"), "kind").alias("x"))
    told = told.groupBy("row", "row2").agg(F.array_sort(F.collect_list("x")).alias("x"))
    full = hits.join(told, ["row", "row2"])
    text = F.array_join(F.zip_with("gaps", "x", lambda g, x: F.concat(g, F.coalesce(x["s"], F.lit("")))), "")
    is_new = F.filter("x", lambda x: x["kind"].isNotNull())

    def counts(of) -> list[Column]:
        return [of(k).cast("int").alias(f"n_{k}") for k in KINDS]

    changed = full.select(F.col("_id").alias(id_col), text.alias("text"), *counts(lambda k: F.size(F.filter("x", lambda x: x["kind"] == k))), F.transform(is_new, lambda x: x["s"]).alias("surrogates"))
    same = given.filter(~some).select(F.col("_id").alias(id_col), F.col("_t").alias("text"), *counts(lambda k: F.lit(0)), F.array().cast("array<string>").alias("surrogates"))
    return changed.unionByName(same)


#: The session's setting that holds the key of the query. Without it the query uses a key that is no secret: its surrogates can be recomputed.
KEY_SETTING = "spark.quillgraph.pii.key"
_NO_SECRET = "set spark.quillgraph.pii.key"


def op5_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced. Null and empty texts, null ids, repeated rows, clashing columns and empty tables: as ``replace``."""
    return replace(table(spark, sf_dir, "documents"), key=spark.conf.get(KEY_SETTING, None) or _NO_SECRET)
