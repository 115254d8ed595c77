"""Toxicity by compression distance between two zstandard dictionaries.

A text is cut into windows of ``WINDOW`` words, and each window is compressed with a dictionary
of toxic and one of ordinary text. Both begin with the same part, trained by zstandard on windows
of ordinary text, so that common words cost the same in either. The other part is trained on one
class alone: its words with significantly more distinct contexts there than in the other class
(log-likelihood ratio; contexts, so that copies of a document count once), the strongest last,
where they are cheapest to refer to. What a window saves with the toxic dictionary is compared
with a series of thresholds, and a logistic calibration turns the shares of windows that reach
them, with their mean and largest savings, into a score.

The fit sees a bounded sample of labelled documents, the first by a hash of the id: up to
``DICTIONARY_DOCS`` of each class for the dictionaries, and ``CALIBRATION_DOCS`` of another third of
them for the calibration, all of at most ``FIT_CHARS`` characters. Scoring sees all documents and whole texts,
and moves nothing between tasks; the fitted model is as large as its two dictionaries.

Defined results: null and empty texts are one empty window; labels that are null are not used;
repeated labels each count; without labels of both classes the score is the share of toxic ones,
0 without any; repeated rows are scored alike. Columns that are not named are ignored.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEVEL = 5, 19
SHARED_BYTES, CLASS_BYTES = 32_768, 1024
DICTIONARY_DOCS, CALIBRATION_DOCS, FIT_CHARS, FIT_WINDOWS = 2000, 4000, 20_000, 60_000
LEAST_RATIO = 25.0
THRESHOLDS = (1, 2, 3, 4)
EDGES = b".,!?;:\"()"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)] or [b""]


def contexts(texts: list[str]) -> Counter:
    """How many distinct pairs of neighbours each word has."""
    seen = set()
    for text in texts:
        words = [b"", *(w.strip(EDGES) for w in words_of(text)), b""]
        seen.update(zip(words, words[1:], words[2:]))
    return Counter(w for _, w, _ in seen if w)


def class_part(own: Counter, other: Counter, size: int = CLASS_BYTES) -> bytes:
    """Words that tell the class of ``own`` from ``other``, the strongest at the end."""
    n, m = sum(own.values()), sum(other.values())
    rated = []
    for word, a in own.items():
        b = other[word]
        if a * m > 2 * b * n:
            mean = (a + b) / (n + m)
            ratio = 2 * (a * math.log(a / (mean * n)) + (b * math.log(b / (mean * m)) if b else 0.0))
            if ratio > LEAST_RATIO:
                rated.append((-ratio, word))
    part, used = [], 0
    for _, word in sorted(rated):
        used += len(word) + 1
        if used > size:
            break
        part.append(word)
    return b" ".join(reversed(part)) + b" "


def shared_part(samples: list[bytes], size: int = SHARED_BYTES) -> bytes:
    """A dictionary trained on windows; of too few of them, the windows themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].rjust(8)


class Distance:
    """Savings of windows with the toxic instead of the ordinary dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self.compressor(toxic), self.compressor(ordinary)

    @staticmethod
    def compressor(content: bytes):
        dictionary = zstandard.ZstdCompressionDict(content)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            dict_data=dictionary, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def features(self, text: str | None) -> np.ndarray:
        toxic, ordinary = self.toxic.compress, self.ordinary.compress
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], float)
        top = np.sort(saved)[-3:]
        reached = [(saved >= t).sum() for t in THRESHOLDS]
        return np.array(
            [saved.mean(), np.maximum(saved, 0).mean(), top[-1], top.mean(), math.log1p(len(saved)), *(r / len(saved) for r in reached), *np.log1p(reached)]
        )


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a ridge-penalised logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - 0.1 * w
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), grad)
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)


def bucket(doc: str):
    return F.crc32(F.col(doc).cast("string").cast("binary")) % 5


class Model(NamedTuple):
    """Dictionaries and calibration; without weights every score is ``prior``."""

    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] | None = None
    offset: float = 0.0

    def scores(self, texts: list) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        distance = Distance(self.toxic, self.ordinary)
        logit = np.array([distance.features(t) @ np.array(self.weights) for t in texts]) + self.offset
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the training labels, those whose crc32 of the id leaves no 0 by 5."""
    own = labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (bucket("id") != 0)).withColumn("o", F.xxhash64("id"))
    # A third of the labels is for calibration, in the classes' natural proportion.
    third = F.pmod("o", F.lit(3)) == 0
    first = [own.filter(~third & (F.col("y") == y)).orderBy("o", "id").limit(DICTIONARY_DOCS) for y in (0, 1)]
    chosen = first[0].union(first[1]).withColumn("use", F.lit("dictionary"))
    other = own.filter(third).orderBy("o", "id").limit(CALIBRATION_DOCS).withColumn("use", F.lit("calibration"))
    sample = chosen.union(other).select("id", "y", "use")
    sample = F.broadcast(sample)  # at most the documents of the three limits
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("t")).filter(F.length("t") <= FIT_CHARS).join(sample, "id").collect()
    rows.sort(key=lambda r: (r["id"], r["t"]))
    of = {y: [r["t"] for r in rows if r["use"] == "dictionary" and r["y"] == y] for y in (0, 1)}
    prior = own.agg(F.avg("y")).first()[0] or 0.0
    if not of[0] or not of[1]:
        return Model(prior)
    pool = [w for t in of[0] for w in windows(t, 8)]
    random.Random(0).shuffle(pool)
    shared = shared_part(pool[:FIT_WINDOWS])
    seen = {y: contexts(of[y]) for y in (0, 1)}
    parts = [class_part(seen[1], seen[0]), class_part(seen[0], seen[1])]
    # Of one length, so that the shared part is as far away in both.
    toxic, ordinary = (shared + p.rjust(max(map(len, parts))) for p in parts)
    test = [(r["t"], r["y"]) for r in rows if r["use"] == "calibration"]
    if len({y for _, y in test}) < 2:
        test += [(t, y) for y in (0, 1) for t in of[y]]
    spark = docs.sparkSession
    trial = spark.createDataFrame(test, "t string, y int").repartition(spark.sparkContext.defaultParallelism)

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        distance = Distance(toxic, ordinary)
        return pa.array([distance.features(t).tolist() for t in texts.to_pylist()], pa.list_(pa.float64()))

    got = trial.select(run("t").alias("x"), "y").collect()
    weights, offset = calibrate(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    return Model(prior, toxic, ordinary, weights.tolist(), offset)


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # two dictionaries of fixed size

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(Model(*shared.value).scores(texts.to_pylist()), pa.float64())

    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(bucket(doc) == 0, F.lit(False)).alias("held_out"), run(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
