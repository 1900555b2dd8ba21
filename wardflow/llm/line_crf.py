"""A linear-chain conditional random field that calls each line of a document good or bad.

A line's features are its own measures and those of the lines beside it; a document's lines form a chain of two labels. In training
every line takes its document's label. The score of a document is the mean of its lines' forward-backward marginals, weighted by
their lengths in bytes (an empty line weighs as 1).

Only the fit is bounded: it takes at most `max_docs` labelled documents of at most `max_lines` lines, the first by a hash of their
ids. Its rows are brought to the driver as numbers; scoring is a map over whole documents without a shuffle.

A very long text is one chain in one task, of some hundred bytes a line; such texts are scored a few at a time.

Nulls: a null or empty text is one empty line and is scored. Rows with a null id or quality teach nothing. Without labels of both kinds
all scores are 0.5. Repeated rows are each scored, alike. An empty table gives an empty result. Other columns than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import table

MAX_DOCS, MAX_LINES, GRAM = 4000, 200, 5
#: Byte classes: 0 others, 1 line feed, 2 capitals, 3 digits, 4 symbols, 5 other punctuation, 6 blanks, 7 small letters.
CLASS = np.zeros(256, np.uint8)
for _k, _bytes in ((7, b"abcdefghijklmnopqrstuvwxyz"), (2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, b"0123456789"), (4, b"#*$%&|<>"), (5, b"!?\"'()+,-./:;=@[]\\^_`{}~"), (6, b" \t\x0b\x0c\r"), (1, b"\n")):
    CLASS[np.frombuffer(_bytes, np.uint8)] = _k
N_OWN = 10


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A document's (lines, N_OWN) measures, each from 0 to about 1, and its lines' lengths in bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    lines = raw.split(b"\n")
    n = len(lines)
    cls = CLASS[np.frombuffer(raw, np.uint8)]
    at = np.zeros(len(cls), np.int64)
    at[1:] = np.cumsum(cls[:-1] == 1)
    c = np.bincount(at * 8 + cls, minlength=8 * n).reshape(n, 8).astype(float)
    split = [x.split() for x in lines]
    nw = np.array([len(x) for x in split], float)
    distinct = np.array([len(set(x)) for x in split], float)
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    again = np.array([seen[x] > 1 and x != b"" for x in lines], float)
    ids = np.fromiter((zlib.crc32(w) for x in split for w in x), np.uint64, int(nw.sum()))
    rep = np.zeros(n)
    if len(ids) > GRAM:
        h = np.zeros(len(ids) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(h)]
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = np.convolve((count > 1)[inverse], np.ones(GRAM)) > 0
        rep = np.bincount(np.repeat(np.arange(n), nw.astype(int)), twice, minlength=n)
    size = c.sum(1) - c[:, 1]
    one, letters = np.maximum(nw, 1), np.maximum(c[:, 2] + c[:, 7], 1)
    own = np.stack([np.ones(n), np.log1p(size) / 10, np.minimum(size / one / 20, 2), c[:, 2] / letters, np.minimum(c[:, 3] / one, 2) / 2, np.minimum(c[:, 4] / one, 3) / 3, np.minimum(c[:, 5] / one, 3) / 3, again, 1 - distinct / one, rep / one], 1)
    own[nw == 0, 8] = 0
    return own, size


def beside(own: np.ndarray) -> np.ndarray:
    """Measures of the line, the one before and the one after (zeros at the ends)."""
    zero = np.zeros((1, own.shape[1]))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero])])


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(emit: np.ndarray, length: np.ndarray, turn: np.ndarray, pairs: bool = False):
    """P(label) of each line; emit: (docs, lines, 2) scores, padded; turn: (2, 2). With pairs also the expected turns, summed over all."""
    n, t, _ = emit.shape
    fore = np.zeros_like(emit)
    fore[:, 0] = emit[:, 0]
    for k in range(1, t):
        fore[:, k] = _sum_exp(fore[:, k - 1, :, None] + turn, 1) + emit[:, k]
    back = np.zeros_like(emit)
    for k in range(t - 2, -1, -1):
        on = (k + 1 < length)[:, None]
        back[:, k] = np.where(on, _sum_exp(turn[None] + (emit[:, k + 1] + back[:, k + 1])[:, None, :], 2), 0)
    z = _sum_exp(fore[np.arange(n), length - 1], 1)
    p = np.exp(np.minimum(fore + back - z[:, None, None], 0))
    if not pairs:
        return p
    seen = np.zeros((2, 2))
    for k in range(1, t):
        on = k < length
        if on.any():
            seen += np.exp(fore[on, k - 1, :, None] + turn + (emit[on, k] + back[on, k])[:, None, :] - z[on, None, None]).sum(0)
    return p, seen, z


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in xs])
    out = np.zeros((len(xs), length.max(), xs[0].shape[1]))
    for i, x in enumerate(xs):
        out[i, : len(x)] = x
    return out, length


def fit(xs: list[np.ndarray], ys: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and turns (2, 2) by gradient ascent (Adam) on the mean log-likelihood of the documents' lines."""
    width = 3 * N_OWN
    theta = np.zeros(2 * width + 4)
    if not len(xs) or len(set(ys.tolist())) < 2:
        return theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2)
    order = np.argsort([len(x) for x in xs], kind="stable")
    parts = []
    for a in range(0, len(order), 500):  # alike in length, so little is padding
        x, length = padded([xs[i] for i in order[a : a + 500]])
        on = np.arange(x.shape[1]) < length[:, None]
        y = np.eye(2)[ys[order[a : a + 500]]]
        gold = np.einsum("dtf,dy->fy", x, y).ravel()
        turns = np.diag(((length - 1)[:, None] * y).sum(0)).ravel()
        parts.append((x, length, on, np.r_[gold, turns]))
    total = sum(p[1].sum() for p in parts)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w, turn = theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2)
        g = -decay * theta * total
        for x, length, on, gold in parts:
            p, seen, _ = marginals(x @ w, length, turn, True)
            g += gold - np.r_[np.einsum("dtf,dty->fy", x, p * on[:, :, None]).ravel(), seen.ravel()]
        g /= total
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4].reshape(width, 2), theta[-4:].reshape(2, 2)


def score(texts: list[str | None], w: np.ndarray, turn: np.ndarray) -> tuple[list[float], list[str]]:
    """Each document's score, and its lines' labels as a string of 0 and 1."""
    scores, labels = [0.5] * len(texts), [""] * len(texts)
    own = [line_features(t) for t in texts]
    order = sorted(range(len(own)), key=lambda i: len(own[i][1]))
    a = 0
    while a < len(order):
        longest, b = 0, a
        while b < len(order) and b - a < 512 and (b == a or len(own[order[b]][1]) * (b - a + 1) <= 200_000):
            longest, b = len(own[order[b]][1]), b + 1
        e, length = padded([beside(own[i][0]) @ w for i in order[a:b]])
        p = marginals(e, length, turn)[:, :, 1]
        for i, q, n in zip(order[a:b], p, length):
            weight = np.maximum(own[i][1], 1)
            scores[i] = float(min(1.0, max(0.0, (q[:n] * weight).sum() / weight.sum())))
            labels[i] = "".join("1" if x >= 0.5 else "0" for x in q[:n])
        a = b
    return scores, labels


def _training(max_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [line_features(t.as_py())[0] for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"], pa.array([x.ravel().tolist() if len(x) <= max_lines else None for x in xs], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights from labelled rows (doc_id, quality), at most max_docs ids of them, and 2 * max_docs documents where ids repeat; documents of over max_lines lines teach nothing.
    Which they are depends on the rows alone, so reruns agree."""
    some = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").mapInArrow(_training(max_lines), "doc_id long, quality int, x array<double>").where("x is not null")
    first = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(2 * max_docs)
    got = sorted(first.collect(), key=lambda r: (r["doc_id"], r["x"]))
    return fit([beside(np.array(r["x"]).reshape(-1, N_OWN)) for r in got], np.array([r["quality"] for r in got], int))


def scored(docs: DataFrame, w: np.ndarray, turn: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, line_labels) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, labels = score(b.column(1).to_pylist(), w, turn)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(labels)], ["key", "score", "line_labels"])

    return docs.select(key, text).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, score double, line_labels string").withColumnRenamed("key", key)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    w, turn = learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held))
    out = scored(docs, w, turn).withColumn("held_out", held)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "line_labels")
