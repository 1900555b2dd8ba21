"""Vectors as short codes: each part of a vector is named by the nearest entry of that part position's codebook.

A component x counts as the integer floor(256 * x), so all sums and distances are exact. The entries of a part position stand in a
vantage-point tree: an entry, and the others in an inner and an outer half by their distance from it, with the range of distances in each half. A
search goes down to the nearer half first; the triangle inequality gives the least distance that the other half can have, and it is
visited unless that is more than the best so far. Roots are rounded outwards (the ranges and the query's own distance), and a half that may
hold an equal distance is visited too, since the lower index wins a tie; what is visited is compared by exact integers.

Codebooks start as the parts of the first vectors by key; each round assigns all parts and moves each entry to the floored mean of its parts, whose
sums are made in the tasks and then added up: the driver holds the codebooks and a sum for each of their components, however many the vectors.

Nulls: a vector that is null or holds null or non-finite components is dropped. Rows without a key stand last among the first vectors. Equal keys: by the
vectors' components, then alike. A vector of another length than the first one's, or with a component beyond LIMIT, has a null code and error and no part in the codebooks.
Lengths that the parts don't divide are cut at floor(p * length / parts). Repeated rows are each coded. An empty table gives an empty result and empty codebooks.
Only key, vector and what `keep` names are read, and other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import lookup, stored, table

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 4
#: Scaled components up to this leave all distances and their roots within 64 bits.
LIMIT = 1 << 20
#: Bits of a squared distance's fraction: a root has half as many.
FINE = 8


def root(x: np.ndarray) -> np.ndarray:
    """floor(sqrt(x * 2**FINE)), exactly."""
    x = np.asarray(x, np.int64) << FINE
    r = np.sqrt(x.astype(float)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def root_up(x: np.ndarray) -> np.ndarray:
    """ceil(sqrt(x * 2**FINE)), exactly."""
    r = root(x)
    return r + (r * r < np.asarray(x, np.int64) << FINE)


def squared(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    d = x - e
    return np.einsum("...k,...k->...", d, d)


class Tree:
    """A vantage-point tree over entries (entries, components: long)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = self._node(np.arange(len(entries)))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        e = self.entries[rows]
        apart = squared(e[:, None], e[None])
        k = int(np.argmax(np.sqrt(apart.astype(float)).std(1)))  # the entry that tells the others best apart
        d, rest = np.delete(apart[k], k), np.delete(rows, k)
        order = np.argsort(d, kind="stable")
        d, rest, mid = d[order], rest[order], len(rest) // 2
        half = lambda a, b: (self._node(rest[a:b]), int(root(d[a])), int(root_up(d[b - 1])))
        return int(rows[k]), int(d[mid]), half(0, mid), half(mid, len(rest))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row of x (the lower index of equals), its squared distance, and how many distances were computed."""
        best = np.full(len(x), np.iinfo(np.int64).max >> FINE, np.int64)
        at = np.full(len(x), len(self.entries), np.int64)
        looked = 0

        def look(e: int, rows: np.ndarray) -> np.ndarray:
            nonlocal looked
            looked += len(rows)
            d = squared(x[rows], self.entries[e])
            better = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], e
            return d

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                for e in node.tolist():
                    look(e, rows)
                return
            vantage, split, inner, outer = node
            d = look(vantage, rows)
            near = d < split
            visit(inner[0], rows[near])
            visit(outer[0], rows[~near])
            for (child, low, high), others in ((outer, near), (inner, ~near)):
                left, o = rows[others], d[others]
                gap = np.maximum(np.maximum(low - root_up(o), root(o) - high), 0)
                visit(child, left[gap * gap <= best[left] << FINE])

        if len(self.entries):
            visit(self.top, np.arange(len(x)))
        return at, best, looked


def cuts(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def scaled(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of this length within the limit, and their integers (rows, length)."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(size == length)
    x = np.floor(column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(fit), length) * SCALE)
    within = (np.abs(x) <= LIMIT).all(1) if length else np.ones(len(fit), bool)
    return fit[within], x[within].astype(np.int64)


def finite(vectors: DataFrame, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad)


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> tuple[int, list[np.ndarray]]:
    """The vectors' length and each part position's entries: parts of the first vectors by key. vectors: key, v."""
    order = [F.col("key").asc_nulls_last(), F.col("v")]
    one = vectors.orderBy(*order).select("v").limit(1).collect()
    length = len(one[0]["v"]) if one else 0
    fits = (F.size("v") == length) & F.forall("v", lambda x: F.abs(F.floor(x.cast("double") * SCALE)) <= LIMIT)
    rows = vectors.where(fits).orderBy(*order).select("v").limit(entries).collect()
    x = np.floor(np.array([r["v"] for r in rows], float).reshape(len(rows), length) * SCALE).astype(np.int64)
    at = cuts(length, parts)
    return length, [x[:, a:b] for a, b in zip(at, at[1:])]


def _sums(length: int, books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, at = [Tree(b) for b in books], cuts(length, len(books))
        total, count = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            _, x = scaled(batch.column(0), length)
            for p, t in enumerate(trees):
                part = x[:, at[p] : at[p + 1]]
                e = t.nearest(part)[0]
                np.add.at(total[p], e, part)
                count[p] += np.bincount(e, minlength=len(t.entries))
        rows = [(p, e, total[p][e].tolist(), int(count[p][e])) for p in range(len(books)) for e in np.flatnonzero(count[p]).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64()))], ["part", "entry", "total", "n"])

    return run


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]]:
    """The vectors' length and the codebooks after `rounds` rounds over all vectors. vectors: key, v, as finite() leaves them."""
    length, books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        s = vectors.select("v").mapInArrow(_sums(length, books), "part int, entry int, total array<long>, n long")
        s = s.select("part", "entry", "n", F.posexplode_outer("total").alias("k", "x")).groupBy("part", "entry", "k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in s.where("k is not null").collect():
            books[r["part"]][r["entry"], r["k"]] = r["x"] // r["n"]
    return length, books


def coded(vectors: DataFrame, length: int, books: list[np.ndarray], keep: list[str]) -> DataFrame:
    """vectors' `keep` columns with code (the entries' numbers by part, two hex digits each) and error (the squared distances' sum)."""
    kinds = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, at = [Tree(b) for b in books], cuts(length, len(books))
        for batch in batches:
            fit, x = scaled(batch.column(len(keep)), length)
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, t in enumerate(trees):
                e, d, _ = t.nearest(x[:, at[p] : at[p + 1]])
                codes[:, p] = e
                error += d
            code, err = [None] * batch.num_rows, [None] * batch.num_rows
            for i, c, d in zip(fit.tolist(), codes, error.tolist()):
                code[i], err[i] = c.tobytes().hex(), d
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(code, pa.string()), pa.array(err, pa.int64())], [*keep, "code", "error"])

    return vectors.select(*[F.col(f"`{c}`") for c in keep], "v").mapInArrow(run, f"{kinds}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()


def compressed(vectors: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(key, label, code, error, label_error) of each vector, and the codebooks. label_error: the errors' sum over equal labels, nulls together (null where it passes 64 bits)."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    v = finite(vectors, vector).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    length, books = trained(v, parts, entries, rounds)
    name = F.concat(F.when(F.col("label").isNull(), "n").otherwise("v"), F.coalesce(F.col("label").cast("string"), F.lit(""))).alias("name")
    rows = stored(coded(v, length, books, ["key", "label"]).select("*", name), "codes")
    by = rows.groupBy("name").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    by = stored(by, "label-errors")
    return lookup(rows, by.select("name", "label_error"), "name", by.select("name", "n")).drop("name"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compressed(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return out.select(F.col("key").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Round k in SQL: every part's nearest entry of e{k-1}, and the entries e{k}."""
    return f"""
n{k} AS MATERIALIZED (SELECT rid, part, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i])))::BIGINT, entry := entry)) AS best
  FROM p JOIN e{k - 1} USING (part) GROUP BY rid, part),
m{k} AS (SELECT part, n{k}.best.entry AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS c FROM n{k} JOIN p USING (rid, part), unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL),
f{k} AS (SELECT part, entry, list((s - (((s % c) + c) % c)) // c ORDER BY i)::BIGINT[] AS z FROM m{k} GROUP BY part, entry),
e{k} AS MATERIALIZED (SELECT part, entry, coalesce(z, y) AS y FROM e{k - 1} LEFT JOIN f{k} USING (part, entry)),"""


OP13_SQL = rf"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS a FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, a[part * (len(a) // {PARTS}) + 1 : (part + 1) * (len(a) // {PARTS})] AS x FROM v, unnest(range({PARTS})) AS t(part)),
e0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS y FROM p WHERE rid <= {ENTRIES}),{"".join(_round(k) for k in range(1, ROUNDS + 2))}
c AS (SELECT rid, string_agg(printf('%02x', n{ROUNDS + 1}.best.entry), '' ORDER BY part) AS code, sum(n{ROUNDS + 1}.best.d)::BIGINT AS error FROM n{ROUNDS + 1} GROUP BY rid),
b AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), b
"""
