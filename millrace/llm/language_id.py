"""Language by nearest centroid.

Letters, lower-cased, with runs of everything else as one space, give character n-grams of one to three, hashed into a
fixed number of columns. Vectors are log counts times inverse document frequency, of length one. Each language has
several centroids (spherical k-means); a text gets the language of the centroid of the largest cosine and is rejected
beyond a distance that depends on how many different n-grams it has, as short and repetitive texts are never near. The
distance is learned from held-out texts: each half of a language's training texts, whole and by their starts, is scored by
centroids of the other half, and a low quantile of these cosines is the least that is accepted.

Fit: on a bounded sample, the `per_language` different texts with a letter of the smallest hashes in each language. Prediction reads whole texts.
Defined results: null, empty and letterless texts are `und` with score 0 and are rejected; with nothing to learn from all
are `und`; a language learned from one text rejects nothing that has a letter, as there is nothing held out. Texts of a few
letters are near every language and mostly accepted. Equal texts get equal results. Extra columns pass through (of the same
name as a result: replaced).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, given_back, others, quoted

#: Columns of the hashed vectors.
WIDTH = 1 << 14
#: Texts of each language to learn from, at most.
PER_LANGUAGE = 300
#: Shares of a language that are ranked apart.
SALTS = 32
#: Centroids of each language.
CLUSTERS = 3
#: What letters() holds, as a pattern; characters that Java doesn't know yet may be letters.
LETTER = r"[\p{L}\p{Cn}]"
#: Code points handled at once.
STEP = 1 << 20
#: Quantile of held-out cosines that a text must reach, and how far below it, as a share of its distance from the median.
LEAST, SLACK = 0.005, 0.5
#: Characters of the starts of training texts that are scored besides the whole.
STARTS = tuple(1 << i for i in range(10))
#: Classes of texts by the number of different n-grams: from 2^i to below 2^(i + 1).
SIZES = WIDTH.bit_length()


@cache
def letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> np.ndarray:
    """How often each hashed n-gram occurs; all zero if there is no letter. Texts are read in steps, whose last two letters and
    kind of last character go on to the next."""
    total = np.zeros(WIDTH, np.int64)
    text, before, start, some = text or "", np.zeros(0, np.uint32), True, False
    for at in range(0, len(text), STEP):
        points = np.frombuffer(text[at : at + STEP].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        known = letters()[points]
        some = some or bool(known.any())
        new = np.where(known, points, 32).astype(np.uint32)[known | np.r_[start, known[:-1]]]
        start = bool(known[-1])
        points = np.r_[before, new]
        one = points * np.uint32(2654435761)
        two = (points[:-1] * np.uint32(2246822519) ^ one[1:]) * np.uint32(3266489917)
        three = (two[:-1] * np.uint32(668265263) ^ one[2:]) * np.uint32(374761393)
        for i, grams in enumerate((one, two, three)):  # those that end among the new characters
            total += np.bincount(grams[max(0, len(before) - i) :] >> np.uint32(18), minlength=WIDTH)
        before = points[-2:]
    return total if some else np.zeros(WIDTH, np.int64)


Sparse = tuple[np.ndarray, np.ndarray]


def sparse(found: np.ndarray) -> Sparse:
    """(columns, counts) of what occurs."""
    at = np.flatnonzero(found)
    return at, found[at]


def unit(found: Sparse, idf: np.ndarray) -> np.ndarray:
    """The vector of length one, at the columns of what occurs."""
    v = np.log1p(found[1]).astype(np.float32) * idf[found[0]]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass(frozen=True)
class Model:
    """languages of the columns of centroids (WIDTH x columns); floor: the least cosine that is accepted (columns x SIZES)."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, cosine, rejected)."""
        found = sparse(counts(text))
        if not len(found[0]) or not self.languages:
            return "und", 0.0, True
        cosines = unit(found, self.idf) @ self.centroids[found[0]]
        best = int(np.argmax(cosines))
        score = min(max(float(cosines[best]), 0.0), 1.0)
        least = np.interp(np.log2(len(found[0])), np.arange(SIZES) + 0.5, self.floor[best])
        return self.languages[best], score, bool(score < least)


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of length one of the rows, the first near all, each next one the row farthest from those before."""
    centers = [x.sum(0)]
    while len(centers) < min(k, len(x)):
        unit = np.array([c / max(np.linalg.norm(c), 1e-12) for c in centers])
        centers.append(x[int(np.argmin((x @ unit.T).max(1)))])
    centers = np.array(centers)
    for _ in range(rounds):
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        nearest = (x @ centers.T).argmax(1)
        centers = np.array([x[nearest == i].sum(0) if (nearest == i).any() else c for i, c in enumerate(centers)])
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)


def floors(sizes: np.ndarray, cosines: np.ndarray, least: float = LEAST, slack: float = SLACK) -> np.ndarray:
    """The least cosine accepted in each of SIZES classes, from held-out ones. A class without any has the floor of the next
    smaller one (0 if none); no class has a higher floor than a larger class that has some."""
    out = np.full(SIZES, np.nan)
    for i in np.unique(sizes):
        low, middle = np.quantile(cosines[sizes == i], [least, 0.5])
        out[i] = max(low - slack * (middle - low), 0.0)
    known = np.flatnonzero(~np.isnan(out))
    out[known] = np.minimum.accumulate(out[known][::-1])[::-1]
    last = 0.0
    for i in range(SIZES):
        last = out[i] = last if np.isnan(out[i]) else out[i]
    return out


def fitted(samples: list[tuple[str, list[Sparse]]], clusters: int = CLUSTERS, least: float = LEAST, slack: float = SLACK) -> Model:
    """samples: (language, counts of the whole text and of its starts)."""
    if not samples:
        return Model([], np.ones(WIDTH, np.float32), np.zeros((WIDTH, 0), np.float32), np.zeros((0, SIZES)))
    seen = np.zeros(WIDTH)
    for _, (whole, *_) in samples:
        seen[whole[0]] += 1
    idf = (np.log((1 + len(samples)) / (1 + seen)) + 1).astype(np.float32)
    languages, columns, floor = [], [], []
    for language in sorted({s[0] for s in samples}):
        own = [parts for name, parts in samples if name == language]
        x = np.zeros((len(own), WIDTH), np.float32)
        for row, (whole, *_) in zip(x, own):
            row[whole[0]] = unit(whole, idf)
        centers = clustered(x, clusters).astype(np.float32)
        sizes, cosines = [], []
        for half in (0, 1) if len(own) > 1 else ():
            other = clustered(x[1 - half :: 2], clusters).astype(np.float32).T.copy()
            for part in (p for parts in own[half::2] for p in parts):
                sizes.append(len(part[0]).bit_length() - 1)
                cosines.append(float((unit(part, idf) @ other[part[0]]).max()))
        languages += [language] * len(centers)
        columns += list(centers)
        floor += [floors(np.array(sizes, int), np.array(cosines), least, slack)] * len(centers)
    return Model(languages, idf, np.array(columns).T.copy(), np.array(floor))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, text: str = "text", lang: str = "lang", **more) -> Model:
    """A model from a bounded sample of the rows that have a language and a text with a letter."""
    rows = labelled.select(F.col(quoted(lang)).alias("lang"), F.col(quoted(text)).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER)).withColumn("h", F.xxhash64("text"))
    keys = rows.select("lang", "h").distinct().withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    for level in (["lang", "salt"], ["lang"]):  # the smallest of each share first, so that a language isn't one task's work
        rank = F.row_number().over(Window.partitionBy(*level).orderBy("h"))
        keys = keys.withColumn("r", rank).filter(F.col("r") <= per_language)
    limits = keys.groupBy("lang").agg(F.max("h").alias("most")).collect()
    if not limits:
        return fitted([])
    near = F.lit(False)
    for r in limits:
        near = near | ((F.col("lang") == r.lang) & (F.col("h") <= r.most))

    def vectors(batches):
        for b in batches:
            rows = []
            for lang, h, t in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "text"))):
                whole = counts(t)
                if whole.any():
                    parts = [whole, *(c for n in STARTS if n < len(t) and (c := counts(t[:n])).any())]
                    rows += [(lang, h, i, at.astype("<u2").tobytes(), n.astype("<u4").tobytes()) for i, (at, n) in enumerate(map(sparse, parts))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["lang", "h", "part", "at", "n"])

    once = rows.filter(near).groupBy("lang", "h").agg(F.first("text").alias("text"))
    samples = []
    for r in sorted(once.mapInArrow(vectors, "lang string, h long, part int, at binary, n binary").collect()):
        if r.part == 0:
            samples.append((r.lang, []))
        samples[-1][1].append((np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.n, "<u4")))
    return fitted(samples, **more)


def identified(df: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """`df` with the language, the cosine (0 to 1) and whether the text is rejected."""
    held = df.sparkSession.sparkContext.broadcast(model)  # WIDTH x (languages x CLUSTERS) numbers, whatever the input
    kept = others(df, names)
    (whole,) = fresh(df, "whole_text")

    def predict(batches):
        given_back()
        m = held.value
        for b in batches:
            found = [m.predict(t) for t in b.column(whole).to_pylist()]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], names=[*kept, *names])
        given_back()

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return df.select(*map(quoted, kept), F.col(quoted(text)).alias(whole)).mapInArrow(predict, schema)


def fold(doc_id: Column) -> Column:
    """0, 1 or 2 by the CRC-32 of the id as text; 1 is held out. Null ids are not held out and not learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))
