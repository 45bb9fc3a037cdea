"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3) of the letters of a text, with
blanks between words, weighted by TF-IDF and scaled to length 1. Document
frequencies are counted over all labelled training rows. The weights are
learned from a bounded sample of these rows (a number for each language) by follow-the-regularised-leader
with elastic-net penalties, then a temperature is fitted on rows of the sample
that were not learned from. Only the sample, the frequencies (one number for
each hash) and the weights pass through the driver; their sizes are parameters. The
penalties leave weights at 0; tasks hold those that are not, by feature. While they are learned
the driver holds two numbers for each language and each feature that the sample has.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
so is every text if no row is labelled; rows with a null language are not
learned from; very long texts are read whole; repeated rows are predicted
alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Hashed features, a power of two.
FEATURES = 1 << 15
#: Expected rows of the sample that the weights are learned from, and at least so many of each language.
SAMPLE_ROWS, SAMPLE_ROWS_A_LANGUAGE = 2000, 20
_BLANK = 32
_SYMBOLS: np.ndarray | None = None


def _symbols() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    global _SYMBOLS
    if _SYMBOLS is None:
        _SYMBOLS = np.fromiter((ord(c.lower()[0]) if c.isalpha() else _BLANK for c in map(chr, range(0x110000))), dtype=np.uint32, count=0x110000)
    return _SYMBOLS


def grams(text: str | None, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts) of a whole text; empty if it has no letter."""
    none = np.empty(0, np.int32), np.empty(0, np.int64)
    if not text:
        return none
    letters = _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    s = np.empty(len(letters) + 2, np.uint32)
    s[0] = s[-1] = _BLANK
    s[1:-1] = letters
    blank = s == _BLANK
    if blank.all():
        return none
    keep = np.ones(len(s), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    s = s[keep]
    bits = np.uint32(32 - (features.bit_length() - 1))
    one = s * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + s[1:] * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + s[2:] * np.uint32(0x9E3779B1)
    found = []
    for h in (one, two, three):
        h = h ^ (h >> np.uint32(15))
        found.append((h * np.uint32(0x2C1B3C6D)) >> bits)
    counts = np.bincount(np.concatenate(found), minlength=features)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


@dataclass
class SparseWeights:
    """The weights that are not 0: those of feature f are at first[f] up to first[f + 1]."""

    first: np.ndarray
    language: np.ndarray
    value: np.ndarray
    languages: int

    @staticmethod
    def of(features: int, at: np.ndarray, dense: np.ndarray) -> SparseWeights:
        """``dense`` has a row for each of the features ``at``, in ascending order."""
        row, language = np.nonzero(dense)
        first = np.concatenate([[0], np.cumsum(np.bincount(at[row], minlength=features))])
        return SparseWeights(first, language.astype(np.int32), dense[row, language].astype(np.float32), dense.shape[1])

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Of each language for a text's features and their values."""
        some = self.first[at + 1] - self.first[at]
        which = np.repeat(self.first[at] - np.cumsum(some) + some, some) + np.arange(some.sum())
        return np.bincount(self.language[which], self.value[which] * np.repeat(x, some), self.languages)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: SparseWeights | None = None
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1.0 + np.log(counts)) * self.idf[at]
        return x / max(1e-12, float(np.sqrt(x @ x)))

    def probabilities(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = self.weights.scores(at, self.vector(at, counts)) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text, len(self.idf)) if self.languages else ((), ())
        if not len(at):
            return UNKNOWN, 0.0
        p = self.probabilities(at, counts)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _document_frequencies(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = np.zeros(features, np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                frequency[grams(text, features)[0]] += 1
        at = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(frequency[at])], names=["feature", "n"])

    return run


def _sample_features(features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grams(text, features) for text in batch["text"].to_pylist()]
            columns = [batch["lang"], batch["order"], *[pa.array([x[i].astype("<i4").tobytes() for x in found], pa.binary()) for i in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "order", "at", "counts"])

    return run


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], features: int, classes: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """FTRL-proximal for softmax regression: rows are (feature numbers, values, class)."""
    z, n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights_at(at: np.ndarray) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = weights_at(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            g2 = g * g
            z[at] += g - (np.sqrt(n[at] + g2) - np.sqrt(n[at])) / alpha * w
            n[at] += g2
    return weights_at(np.arange(features))


def fit_temperature(scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss: a grid over powers, then a finer one."""

    def loss(t: float) -> float:
        z = scores / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), classes]).mean())

    best = min((10.0**k for k in np.linspace(-2, 2, 41)), key=loss)
    return float(min((best * 10.0**k for k in np.linspace(-0.1, 0.1, 21)), key=loss))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", features: int = FEATURES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    by_lang = rows.groupBy("lang").count().collect()  # a row for each language, all of which are learned
    languages = sorted(r["lang"] for r in by_lang)
    total = sum(r["count"] for r in by_lang)
    if not total:
        return Model()
    sample_rows = max(sample_rows, SAMPLE_ROWS_A_LANGUAGE * len(by_lang))
    counted = rows.select("text").mapInArrow(_document_frequencies(features), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(features)
    frequency[counted["feature"].to_numpy()] = counted["n"].to_numpy()
    model = Model(languages, np.log((1.0 + total) / (1.0 + frequency)) + 1.0)
    # the same number of rows is expected of each language: shares by hash of the row
    share = {r["lang"]: min(1.0, sample_rows / len(by_lang) / r["count"]) for r in by_lang}
    shares = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    order = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    picked = rows.withColumn("order", order).join(F.broadcast(shares), "lang").filter(F.col("order") < F.col("share") * float(1 << 40))
    sample = picked.select("text", "lang", "order").mapInArrow(_sample_features(features), "lang string, order long, at binary, counts binary").toArrow().sort_by([("order", "ascending"), ("lang", "ascending")])
    number = {x: i for i, x in enumerate(languages)}
    data = []
    for lang, at, counts in zip(sample["lang"].to_pylist(), sample["at"].to_pylist(), sample["counts"].to_pylist()):
        at = np.frombuffer(at, "<i4")
        if len(at):
            data.append((at, model.vector(at, np.frombuffer(counts, "<i4")), number[lang]))
    learned, apart = [x for i, x in enumerate(data) if i % 5], [x for i, x in enumerate(data) if not i % 5]
    # only features of the rows learned from can have weights
    learned = learned or data
    known = np.unique(np.concatenate([at for at, _, _ in learned])) if learned else np.empty(0, np.int64)
    model.weights = SparseWeights.of(features, known, follow_leader([(np.searchsorted(known, at), x, y) for at, x, y in learned], len(known), len(languages)))
    if apart:
        scores = np.array([model.weights.scores(at, x) for at, x, _ in apart])
        model.temperature = fit_temperature(scores, np.array([y for _, _, y in apart]))
    return model


def predicted(model: Model, text: Column) -> Column:
    """struct(lang, score) of a text column, in Arrow batches."""
    shared = [model]

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared[0].predict(x if isinstance(x, str) else None) for x in texts], columns=["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = model or fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), predicted(model, F.col(text_col)).alias("_p"))
    return rows.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.3, model: Model | None = None) -> DataFrame:
    """The documents, all columns, whose language is known with score ``least`` or more."""
    model = model or fit(docs, id_col, text_col, lang_col)
    p = predicted(model, docs[text_col])
    return docs.filter(F.when(p["lang"] == UNKNOWN, F.lit(-1.0)).otherwise(p["score"]) >= least)
