"""Language identification by sparse multinomial logistic regression on TF-IDF of character n-grams.

A text is lower-cased, and each run of what is no letter becomes one blank; its n-grams of 1 to GRAM characters are hashed to 2**BITS
features, weighted by their number and their inverse document frequency, and scaled to length 1. Weights are fitted by follow-the-regularised-leader with
learning rates by coordinate and an elastic net (the first part makes most weights exactly 0), then the scores are divided by a temperature that fits a part of the sample kept
from the fit. The most probable language is the prediction, its probability the score.

Document frequencies and languages' sizes are counted over all documents to learn from. Only the fit is bounded: it takes at most `max_docs` documents with `max_features` features (8 bytes each), dealt evenly
over the languages as far as they have them (the first by a hash of their texts, one at least), and knows the `max_langs` most frequent languages. Equal texts of a language count once among them. The driver gets these documents' features, the frequencies (one
number a feature) and the languages. Predicting is a map over whole texts without a shuffle.

Nulls: a null text, or one without a letter, is `und` with score 0. Rows with a null language teach nothing. Ties go to the language that is first by code point. Without anything to learn from all
is `und`. Repeated rows are each predicted, alike. A very long text is one task's, of some 100 bytes a character for a short time. An empty table gives an empty result. Other columns than id, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.llm.common import table, text_key

GRAM, BITS, MAX_DOCS, MAX_LANGS, MAX_FEATURES = 3, 16, 6000, 256, 12_000_000
UNKNOWN = "und"
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[np.fromiter((not chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 32
    return out


def grams(text: str | None, bits: int = BITS, most: int = GRAM) -> np.ndarray:
    """The hashed n-grams of a text, repeats included; none without a letter."""
    if not text:
        return np.empty(0, np.int64)
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.r_[np.uint32(32), c, np.uint32(32)]
    keep = c != 32
    if not keep.any():
        return np.empty(0, np.int64)
    keep[1:] |= keep[:-1]
    keep[0] = True
    c = c[keep].astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, most + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] ^ c[n - 1 :]) * ODD[n % 4]
        h ^= h >> np.uint64(29)
        out.append((h * ODD[0]) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64)


def counts(text: str | None) -> np.ndarray:
    return np.bincount(grams(text), minlength=1 << BITS)


# ---- fit ----


class Model(NamedTuple):
    langs: list[str]
    features: np.ndarray  # those with a weight that is not 0
    weights: np.ndarray  # (features, langs), divided by the temperature
    bias: np.ndarray
    idf: np.ndarray  # of all features


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, langs: int, width: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (width, langs) and bias by follow-the-regularised-leader, a document at a time in a fixed mixed order. xs: (features, values) of each document. The last feature is the bias and has no first part of the net."""
    z, n = np.zeros((width + 1, langs)), np.zeros((width + 1, langs))
    net = np.full((width + 1, 1), l1)
    net[width] = 0

    def weights(f):
        zf = z[f]
        return np.where(np.abs(zf) <= net[f], 0, -(zf - np.sign(zf) * net[f]) / ((beta + np.sqrt(n[f])) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(xs)):
            f, v = np.append(xs[i][0], width), np.append(xs[i][1], 1.0)
            w = weights(f)
            p = softmax(v @ w)
            p[ys[i]] -= 1
            g = v[:, None] * p
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - s * w
            n[f] += g * g
    w = weights(np.arange(width + 1))
    return w[:width], w[width]


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The divisor of the scores that makes the true languages likeliest, between 1/20 and 20, by golden sections of its logarithm. As N documents can't tell that
    there are no errors, one in N + 2 is taken for another language."""
    n, langs = logits.shape
    if not n or langs < 2:
        return 1.0
    goal = np.full((n, langs), 1 / (n + 2) / (langs - 1))
    goal[np.arange(n), ys] = 1 - 1 / (n + 2)

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        top = x.max(1, keepdims=True)
        return float((np.log(np.exp(x - top).sum(1)) + top[:, 0] - (goal * x).sum(1)).mean())

    a, b, g = -np.log(20), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def weighted(f: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = n * idf[f]
    size = np.sqrt((v * v).sum())
    return f, v / size if size else v


# ---- on Spark ----


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, np.int64)
    for b in batches:
        for t in b.column(0):
            df += counts(t.as_py()) > 0
    f = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(df[f])], ["f", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fs, ns = [], []
        for t in b["text"]:
            n = counts(t.as_py())
            f = np.flatnonzero(n)
            fs.append(f.astype(np.int32).tobytes())
            ns.append(n[f].astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([b["lang"], b["r"], pa.array(fs, pa.binary()), pa.array(ns, pa.binary())], ["lang", "r", "f", "n"])


def learn(docs: DataFrame, max_docs: int = MAX_DOCS, max_langs: int = MAX_LANGS, max_features: int = MAX_FEATURES) -> Model | None:
    """A model from docs (text, lang); None: there is nothing to learn from."""
    d = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = d.groupBy("lang").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "lang").limit(max_langs)
    sizes = [(r["lang"], r["size"]) for r in sizes.collect()]
    if not sizes:
        return None
    seen = d.select("text").mapInArrow(_frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << BITS)
    frequency[seen["f"].to_numpy()] = seen["n"].to_numpy()
    n_docs = d.count()
    idf = np.log((1 + n_docs) / (1 + frequency)) + 1
    # Each language's quota; rows beyond twice the quota, as a hash sees it, are gone before any is sorted.
    quota = max(1, max_docs // len(sizes))
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, (2 * quota + 100) / n)) for k, n in sizes], "lang string, share double")
    h = text_key(F.col("text"))
    own = d.join(F.broadcast(share), "lang").where((F.shiftrightunsigned(h["a"], 11) / 2.0**53) < F.col("share"))
    own = own.select("lang", "text", h["a"].alias("a"), F.shiftrightunsigned(h["b"], 11).alias("r")).dropDuplicates(["lang", "a", "r"])
    own = own.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("a", "r"))).where(F.col("k") <= quota)
    x = own.mapInArrow(_sparse, "lang string, r long, f binary, n binary")
    by = W.partitionBy("lang").orderBy("r", "f", "n").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumns({"k": F.count("*").over(by), "size": F.sum(F.length("f") / 4).over(by)}).where((F.col("k") == 1) | (F.col("size") <= max_features // len(sizes)))
    rows = x.select("lang", "r", "f", "n").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["f"]), key=lambda r: (r["lang"], r["r"], r["f"], r["n"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    xs = [weighted(np.frombuffer(r["f"], np.int32).astype(np.int64), np.frombuffer(r["n"], np.int32), idf) for r in rows]
    ys = np.array([langs.index(r["lang"]) for r in rows])
    kept = np.array([r["r"] % 5 == 0 for r in rows])  # for the temperature
    if len(set(ys[~kept].tolist())) < len(langs):
        kept[:] = False
    w, bias = ftrl([x for x, k in zip(xs, kept) if not k], ys[~kept], len(langs), 1 << BITS)
    logits = np.array([v @ w[f] + bias for (f, v), k in zip(xs, kept) if k]).reshape(-1, len(langs))
    t = temperature(logits, ys[kept])
    features = np.flatnonzero(w.any(1))
    return Model(langs, features, w[features] / t, bias / t, idf)


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    for i, text in enumerate(texts):
        n = counts(text)
        if not n.any():
            continue
        v = n * model.idf
        p = softmax((v[model.features] / np.sqrt(v @ v)) @ model.weights + model.bias)
        k = int(np.argmax(p))
        langs[i], scores[i] = model.langs[k], float(p[k])
    return langs, scores


def predicted(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """docs' `keep` columns with lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for t in b.column(len(keep)):
                lang, score = predict([t.as_py()], model)
                langs += lang
                scores += score
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return own.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(docs.where(~held).select("text", "lang"))
    out = predicted(docs.select("doc_id", "text"), model, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
