"""Language identification in two steps: the language family first, then the languages within it.

The families are told apart by linear support vector machines, one against the rest; the languages of a
family by one linear machine for each pair, which vote. Features are relative frequencies of hashed byte
bigrams and trigrams of the whole lower-cased text, so that a text's decision values are sums over its bytes.

Machines only tell the learned languages from one another. Whether a text is in the language that they tell is a further test: the mean
log-probability of its n-grams in that language, against what the learned documents of that language show at that length. Where the machines hardly
decide, the other languages that they leave open are tested too; one that they rule out never counts.

Nulls, empty texts and texts without a letter are ``und`` with score 0, and so is every text where nothing
could be learned (an empty table, no ``lang``). With one language learned, that one has score 1. Repeated
rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import crc_mod, in_pieces, table
from quillgraph.llm.tokens import batches

#: Families of languages by ISO 639-1 code. Other codes are families of their own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indic": "hi ur bn mr pa gu ne si".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "uralic": "fi et hu se".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue wuu".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

BUCKETS = 4096  # for each n-gram order
ORDERS = (2, 3)
SCALE = 64.0
#: At most about so many labelled documents are learned from, an equal share for each language.
SAMPLE_DOCS = 1600
#: ``accepted`` rejects a text whose n-grams are less usual, in every language that the machines leave open, than the learned documents' by more than
#: so many standard deviations at its length, or than ``SLACK`` times what all but a few of the learned documents show, if that is more.
DEVIATIONS = 11.0
SLACK = 1.5
#: The machines leave a language open if they give it so much chance: its family's, times its own against the best of the family.
OPEN = 0.05

_FOLD = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def _runs(texts: list) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Bytes of runs of texts, each text between blanks, and where each begins."""
    low = [None if t is None else t.lower() for t in texts]
    for first, last, run in batches(low):
        raw = b"".join(b" " + b + b" " for b in run)
        begins = np.zeros(len(run) + 1, np.int64)
        np.cumsum([len(b) + 2 for b in run], out=begins[1:])
        yield first, last, np.frombuffer(raw.translate(_FOLD), np.uint8), begins


def _hashes(raw: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that begins at each byte."""
    x = raw.astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:]
    three = (two[:-1] << np.uint32(8)) | x[2:]
    shift = np.uint32(32 - 12)
    return [(two * np.uint32(2654435769)) >> shift, ((three * np.uint32(2246822519)) >> shift) + np.uint32(BUCKETS)]


def sums(texts: list, weights: np.ndarray) -> np.ndarray:
    """Decision values without bias: for each text the mean weight of its n-grams, for each column of ``weights``."""
    out = np.zeros((len(texts), weights.shape[1]))
    columns = [np.ascontiguousarray(weights[:, m], np.float32) for m in range(weights.shape[1])]
    for first, last, raw, begins in _runs(texts):
        if len(raw) < 4:
            continue
        for n, h in zip(ORDERS, _hashes(raw), strict=True):
            have = np.maximum(begins[1:] - begins[:-1] - (n - 1), 0)
            some = np.flatnonzero(have)
            cut = np.empty(2 * len(some), np.int64)
            cut[0::2], cut[1::2] = begins[:-1][some], begins[:-1][some] + have[some]
            cut = cut if not len(cut) or cut[-1] < len(h) else cut[:-1]
            for m, w in enumerate(columns):
                out[first + some, m] += np.add.reduceat(w[h], cut, dtype=np.float64)[0::2] / have[some]
    return out * (SCALE / len(ORDERS))


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty buckets of one text and their features."""
    total = np.zeros(BUCKETS * len(ORDERS))
    for _, _, raw, _ in _runs([text]):
        for h in _hashes(raw):
            if len(h):
                total += np.bincount(h, minlength=len(total)) * (SCALE / len(ORDERS) / len(h))
    at = np.flatnonzero(total)
    return at.astype(np.uint16), total[at].astype(np.float32)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps whose systems conjugate gradients solve."""
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * n * c / 100
    for _ in range(steps):
        gap = 1 - y * (x @ w + b)
        k = np.where(gap > 0, share, 0)  # rows that count; the matrix is not copied
        back = -2 * k * gap * y
        g, gb = w + back @ x, back.sum()
        if np.sqrt(g @ g + gb * gb) < 1e-3:
            break
        p, pb = np.zeros_like(w), 0.0
        r, rb = -g, -gb
        q, qb, rr = r.copy(), rb, r @ r + rb * rb
        for _ in range(40):
            z = 2 * k * (x @ q + qb)
            h, hb = q + z @ x, z.sum() + 1e-6 * qb
            a = rr / max(q @ h + qb * hb, 1e-12)
            p, pb, r, rb = p + a * q, pb + a * qb, r - a * h, rb - a * hb
            new = r @ r + rb * rb
            if new < 1e-4 * (g @ g + gb * gb):
                break
            q, qb, rr = r + new / rr * q, rb + new / rr * qb, new

        def loss(t: float) -> float:
            v = w + t * p
            gap = np.maximum(0, 1 - y * (x @ v + b + t * pb))
            return 0.5 * float(v @ v) + float(share @ (gap * gap))

        t, now = 1.0, loss(0.0)
        while t > 1e-3 and loss(t) > now:
            t /= 2
        w, b = (w + t * p).astype(np.float32), b + t * pb
    return w, float(b)


def _trimmed(x: np.ndarray) -> float:
    """The mean without the largest fiftieth."""
    return float(np.sort(x)[: len(x) - len(x) // 50].mean())


@dataclass
class Usual:
    """How usual n-grams are in each language: ``logs`` has a column for each of ``codes``. A text of ``n`` bytes has a mean near ``mean``, with the
    variance ``spread + noise / n``; ``limit`` is the largest deviation below it that is accepted.
    """

    codes: list[str]
    logs: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    noise: np.ndarray
    limit: float

    def below(self, texts: list, value: np.ndarray) -> np.ndarray:
        """How many standard deviations each text is less usual than each language's learned documents; ``value``: its sums of ``logs``."""
        size = np.array([1 if t is None else max(1, len(t.encode("utf-8", "surrogatepass"))) for t in texts])
        return np.stack([self._below(value[:, k], size, k) for k in range(len(self.codes))], 1)

    def _below(self, value: np.ndarray, size: np.ndarray, at) -> np.ndarray:
        return (self.mean[at] - value) / np.sqrt(self.spread[at] + self.noise[at] / size)

    @staticmethod
    def learned(codes: list[str], x: np.ndarray, lang: np.ndarray, size: np.ndarray) -> Usual:
        """From rows of features, their languages and sizes in bytes: whole documents and short pieces."""
        logs = np.empty((x.shape[1], len(codes)), np.float32)
        out = Usual(codes, logs, np.zeros(len(codes)), np.ones(len(codes)), np.ones(len(codes)), DEVIATIONS)
        at, values = np.array([codes.index(c) for c in lang]), np.zeros(len(lang))
        for k in range(len(codes)):
            total = x[at == k].sum(0, dtype=np.float64).reshape(len(ORDERS), BUCKETS)
            share = (total / np.maximum(total.sum(1, keepdims=True), 1e-9) + 0.05 / BUCKETS) / 1.05
            logs[:, k] = np.log2(share).ravel()
            value, n = x[at == k] @ logs[:, k], size[at == k]
            values[at == k] = value
            out.mean[k] = np.median(value)
            far, long = (value - out.mean[k]) ** 2, n >= np.median(n)
            # without the farthest fiftieth, so that a few texts with a wrong label do not widen what is usual
            out.spread[k] = max(1e-3, _trimmed(far[long]))
            out.noise[k] = max(1e-3, _trimmed(np.maximum(far[~long] - out.spread[k], 0) * n[~long])) if (~long).any() else 1e-3
        out.limit = max(DEVIATIONS, SLACK * float(np.quantile(out._below(values, size, at), 0.995)))
        return out


@dataclass
class Model:
    """``machines[m]`` is (what it decides for, against, family or None); ``weights`` has a column for each."""

    families: list[str]
    languages: dict[str, list[str]]
    machines: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    weights: np.ndarray | None = None
    biases: np.ndarray | None = None
    usual: Usual | None = None

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return ["und"] * len(texts), np.zeros(len(texts))
        return self.decide(sums(texts, self.weights) if self.machines else np.zeros((len(texts), 0)))[:2]

    def fits(self, texts: list) -> np.ndarray:
        """Whether each text is as usual as learned documents in the language that the machines tell, or in another that they leave open."""
        if not self.families or not texts:
            return np.zeros(len(texts), bool)
        m = len(self.machines)
        value = sums(texts, np.concatenate([self.weights, self.usual.logs], 1) if m else self.usual.logs)  # n-grams are hashed once for both
        return (self.decide(value[:, :m])[2] & (self.usual.below(texts, value[:, m:]) <= self.usual.limit)).any(1)

    def decide(self, value: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language and score, and whether it leaves each language open (a column for each, in order); ``value``: sums of ``weights``."""
        n = len(value)
        value = value + self.biases if self.machines else value
        place = {c: i for i, c in enumerate(sorted(c for codes in self.languages.values() for c in codes))}
        left_open = np.zeros((n, len(place)), bool)
        chance = 1 / (1 + np.exp(-np.clip(3 * value, -40, 40)))
        column = {m: i for i, m in enumerate(self.machines)}
        if len(self.families) > 1:
            each = np.stack([value[:, column[f, None, None]] for f in self.families], 1)
            family = each.argmax(1)
            soft = np.exp(3 * (each - each.max(1, keepdims=True)))
            soft /= soft.sum(1, keepdims=True)
        else:
            family, soft = np.zeros(n, np.int64), np.ones((n, 1))
        pred, score = np.empty(n, object), np.ones(n)
        for k, f in enumerate(self.families):
            mine, codes = np.flatnonzero((family == k) | (soft[:, k] >= OPEN)), self.languages[f]
            votes, trust = np.zeros((len(mine), len(codes))), np.zeros((len(mine), len(codes)))
            against = np.ones((len(mine), len(codes), len(codes)))  # the chance of one language against another
            for (i, a), (j, b) in itertools.combinations(enumerate(codes), 2):
                p = chance[mine, column[a, b, f]]
                votes[:, i] += p >= 0.5
                votes[:, j] += p < 0.5
                trust[:, i] += p
                trust[:, j] += 1 - p
                against[:, i, j], against[:, j, i] = p, 1 - p
            row, best = np.arange(len(mine)), (votes + trust / (len(codes) + 1)).argmax(1)
            left_open[np.ix_(mine, [place[c] for c in codes])] = soft[mine, k][:, None] * against[row, :, best] >= OPEN
            told = family[mine] == k
            mine, row, best = mine[told], row[told], best[told]
            pred[mine] = np.array(codes, object)[best]
            left_open[mine, np.array([place[c] for c in codes])[best]] = True
            if len(codes) > 1:
                score[mine] = trust[row, best] / (len(codes) - 1)
        return list(pred), np.clip(score * soft.max(1), 0, 1), left_open


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from ``text`` and ``lang`` of about ``sample_docs`` of the rows: an equal share for each language, by a hash of ``doc_id``."""
    known = docs.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    codes = sorted(counts)
    families = sorted({_FAMILY_OF.get(c, c) for c in codes})
    model = Model(families, {f: [c for c in codes if _FAMILY_OF.get(c, c) == f] for f in families})
    if not codes:
        return model
    share = F.lit(0.0)
    for c in codes:
        share = F.when(F.col("lang") == c, F.lit(sample_docs / len(codes) / counts[c])).otherwise(share)
    drawn = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20))

    def featured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for i, t, lang in zip(part["doc_id"], part["text"], part["lang"], strict=True):
                length = 40 + int(i) % 160
                at = int(i) * 7919 % max(1, len(t) - length)
                for piece in (t, t[at : at + length]):  # short pieces teach what short texts look like
                    where, what = frequencies(piece)
                    rows.append((i, lang, where.tobytes(), what.tobytes(), len(piece.encode("utf-8", "surrogatepass"))))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "at", "x", "size"])

    drawn = drawn.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text", "lang")
    rows = drawn.mapInPandas(featured, "doc_id long, lang string, at binary, x binary, size long").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], len(r["at"]), bytes(r["at"])))
    x = np.zeros((len(rows), BUCKETS * len(ORDERS)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["x"], np.float32)
    lang, size = np.array([r["lang"] for r in rows], object), np.array([max(1, r["size"]) for r in rows])
    del rows
    kin = np.array([_FAMILY_OF.get(c, c) for c in lang], object)
    found = []

    def learn(name: tuple, of: np.ndarray, plus: np.ndarray) -> None:
        found.append(fit_svm(x if of.all() else x[of], np.where(plus[of], 1, -1).astype(np.float32)))
        model.machines.append(name)

    if len(families) > 1:
        for f in families:
            learn((f, None, None), np.ones(len(lang), bool), kin == f)
    for f in families:
        for a, b in itertools.combinations(model.languages[f], 2):
            learn((a, b, f), (lang == a) | (lang == b), lang == a)
    if found:
        model.weights = np.stack([w for w, _ in found], 1)
        model.biases = np.array([b for _, b in found])
    model.usual = Usual.learned(codes, x, lang, size)
    return model


def identified(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, and ``lang_pred`` and ``score`` of its ``text``.

    The model's size is known: ``BUCKETS`` floats for each n-gram order and machine.
    """
    fields = [f for f in docs.schema.fields if f.name in keep]
    given = docs.select(*[F.col(f.name) for f in fields], F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_letters"), F.col("text").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(parts):
            pred, score = model.predict(part.column("_text").to_pylist())
            letters = part.column("_letters").to_pylist()
            told = [p if has else "und" for p, has in zip(pred, letters, strict=True)]
            sure = [float(s) if has else 0.0 for s, has in zip(score, letters, strict=True)]
            columns = [part.column(f.name) for f in fields] + [pa.array(told, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in fields], "lang_pred", "score"])

    return given.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns as they are, whose text has a letter and is in the learned language that the machines tell.

    Null and empty texts and those without a letter go, as do all where nothing could be learned; a text whose n-grams are too unusual (see
    ``DEVIATIONS``) in the language told, and in any other that the machines leave open (see ``OPEN``), goes. Rows are judged one by one, by ``text`` alone: repeated rows and null ids stay or go with their text.
    """
    letter = regex.compile(r"\p{L}")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_pieces(parts):
            texts = part.column("text").to_pylist()
            keep = [bool(f) and t is not None and letter.search(t) is not None for t, f in zip(texts, model.fits(texts), strict=True)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from those that are not held out. Texts that are null or have no letter
    are ``und`` with score 0; rows with a null id are not held out; repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(F.coalesce(crc_mod("doc_id", 3) != 1, F.lit(False))))
    held = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    return identified(held.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])
