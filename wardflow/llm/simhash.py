"""Near duplicates by SimHash, compared bit-sliced.

A fingerprint has a bit for each bit of the shingles' hashes, set if it is set in over half of them. Equal fingerprints (with a similarity
bound: equal sets of shingles, each of which counts once) are made one row first. Rows that share a block key are compared: their fingerprints are stored as bit planes, bit b of 64 rows to a word, and
each plane, against itself shifted by d rows, adds one bit of the distances of 64 pairs to carry-save counters; words whose
pairs have all passed the radius are abandoned. A block gives a forest of its links, never its pairs. Connected components
of all forests are the groups.

With a small radius the block keys are pairs of fingerprint parts: of radius + 2 parts two are equal in any linked pair, so no link is lost. Keys of over MOST rows
are dealt on to tasks by further parts of the fingerprint, with the same guarantee.
With a similarity bound the keys are bands of minima of the shingles' hashes: 32 bands of 3, so that a pair at the similarity 0.8 shares
a band but for once in 1e9, and the fingerprint has 256 bits, with a radius SPREAD standard deviations over the distance expected of
that similarity. What is found so are candidates only: rows whose candidates hang together meet once more, with their sets of shingles,
and a pair enters the forest if the sets' Jaccard similarity reaches the bound.

No task holds a large block (`dealt`), be it a band's or one of candidates: its rows are dealt to chunks by hash, and each chunk gives its forest. A row for each tree of each
chunk then meets the other trees' rows. What is one component by then needs no more comparisons, so only rows outside their block's largest component are left to meet all others,
chunk by chunk. Near copies of one text mostly end as one component in the first two steps; a block of rows that hang together in no way costs a comparison for each two chunks of it, and loses no link.

Nulls: a null or wordless text has the zero fingerprint, and is linked like others. Rows that repeat are each returned. A null doc_id
is never a group's least one unless all are null. Very large blocks are split by the other bits of the fingerprint. A very long text is hashed by one task, some 16 bytes a word.
An empty table gives an empty result. Of columns named like the result's (uid, f0 and so on, component_id, chosen) the result's own are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import lookup, stored, table
from wardflow.llm.components import components

SEED, LARGE, BANDS, ROWS, SPREAD = 42, 8192, 32, 3, 4
#: A chunk's weight: rows, of which one with a text counts as one more for each PAGE characters.
CHUNK, PAGE = 8192, 4000
#: A link, and the block that it was found in.
LINK = "u long, v long, k long"
#: Large blocks of which something small may be broadcast; more are looked up.
HELD = 100_000
#: Rows of a block that one task may hold, where the bits can part them.
MOST = 1 << 16
#: Multipliers that give further hash words and minima from one hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

#: Whether rows i and j of a block are alike.
Alike = Callable[[int, int], bool]

PLUS = np.arange(1, 2 * BANDS * ROWS, 2, dtype=np.uint64) * ODD[3]
TIMES = ODD[0] + np.arange(0, 2 * BANDS * ROWS, 2, dtype=np.uint64)


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of the n-word shingles, repeats included; fewer words: of the whole sequence; none: empty. bytes.lower and bytes.split know ASCII only, as wanted."""
    import xxhash

    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.empty(0, np.uint64)
    line, at, ends, begins = b" ".join(ws), 0, [], []
    for w in ws:
        begins.append(at)
        ends.append(at := at + len(w))
        at += 1
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(line[a:b], SEED) for a, b in zip(begins, ends[n - 1 :] or ends[-1:])), np.uint64)


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of h for each k; k = 0: h."""
    if not k:
        return h
    x = (h ^ (h >> np.uint64(29))) * ODD[k % 4]
    x = (x + np.uint64(k)) * ODD[(k + 1) % 4]
    return x ^ (x >> np.uint64(32))


def fingerprint(h: np.ndarray, size: int) -> list[int]:
    """`size` words of 64 bits, as signed numbers."""
    out = []
    for k in range(size):
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 1 << 16):
            ones += np.unpackbits(mixed(h[a : a + (1 << 16)], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return out


def digest(u: np.ndarray) -> list[int]:
    """128 bits of a sorted set of hashes, as two signed numbers."""
    import xxhash

    return np.frombuffer(xxhash.xxh128_digest(u.tobytes(), SEED), np.int64).tolist()


def bands(h: np.ndarray) -> list[int]:
    """A key for each band: ROWS minima of the hashes, each minimum over the hashes mixed anew."""
    if not len(h):
        return [0] * BANDS
    u = np.unique(h)
    u = (u ^ (u >> np.uint64(31))) * ODD[2]
    low = np.empty(BANDS * ROWS, np.uint64)
    for j in range(BANDS * ROWS):
        low[j] = ((u + PLUS[j]) * TIMES[j]).min()
    keys = np.arange(BANDS, dtype=np.uint64) * ODD[1]
    for r in range(ROWS):
        keys = (keys ^ low[r::ROWS]) * ODD[0]
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64).tolist()


def _sign(n: int, size: int, with_bands: bool, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            fs, ks, ds = [], [], []
            for t in b.column(at):
                h = shingle_hashes(t.as_py(), n)
                if with_bands:
                    h = np.unique(h)
                    ks.append(bands(h))
                    ds.append(digest(h))
                fs.append(fingerprint(h, size))
            cols = [b.column(i) for i in range(b.num_columns) if i != at] + [pa.array([f[k] for f in fs], pa.int64()) for k in range(size)]
            names = [f.name for i, f in enumerate(b.schema) if i != at] + [f"f{k}" for k in range(size)]
            if with_bands:
                cols, names = [*cols, *(pa.array([d[k] for d in ds], pa.int64()) for k in range(2)), pa.array(ks, pa.list_(pa.int64()))], [*names, "s0", "s1", "bands"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def signed(docs: DataFrame, n: int, size: int, with_bands: bool = False, text: str = "text") -> DataFrame:
    """docs with f0, f1 and so on in place of the text, and, if asked for, the bands and the digest s0, s1 of the set of shingles, which then count once each."""
    new = [(f"f{k}", T.LongType()) for k in range(size)] + [("s0", T.LongType()), ("s1", T.LongType()), ("bands", T.ArrayType(T.LongType()))] * with_bands
    schema = T.StructType([f for f in docs.schema if f.name != text] + [T.StructField(k, t) for k, t in new])
    return docs.mapInArrow(_sign(n, size, with_bands, text), schema)


# ---- bit-sliced comparison ----


def planes(f: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows, words): (bits, words of 64 rows, and a spare word)."""
    n, size = f.shape
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little").T
    out = np.zeros((64 * size, (n + 63) // 64 + 1), np.uint64)
    packed = np.packbits(bits, axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def near_at(p: np.ndarray, d: int, alive: np.ndarray, radius: int) -> np.ndarray:
    """Rows i whose distance from row i + d is radius or less, of those set in alive (a word for 64 rows)."""
    skip, bit = d // 64, np.uint64(d % 64)
    at = np.flatnonzero(alive)
    live = alive[at]
    k = radius.bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    # Counters of k bits begin at 2^k - 1 - radius, so that they overflow at radius + 1.
    counters = [np.full(len(at), full if (2**k - 1 - radius) >> j & 1 else 0, np.uint64) for j in range(k)]
    last = p.shape[1] - 1
    for b in range(0, len(p), 8):
        if not len(at):
            break
        q = p[b : b + 8]
        x = q[:, np.minimum(at + skip, last)]
        if bit:
            x = (x >> bit) | (q[:, np.minimum(at + skip + 1, last)] << (np.uint64(64) - bit))
        x = x ^ q[:, at]
        for row in x:
            for j in range(k):
                row, counters[j] = counters[j] & row, counters[j] ^ row
            live = live & ~row  # what is carried out has passed the radius
        if not live.all():
            keep = live != 0
            at, live, counters = at[keep], live[keep], [c[keep] for c in counters]
    lanes = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64)
    word, lane = np.nonzero(lanes)
    return at[word] * 64 + lane


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Links i to j in a forest whose roots are its trees' least rows."""
    while len(i):
        for _ in range(64):
            a, b = root[root[i]], root[root[j]]
            if (root[i] == a).all() and (root[j] == b).all():
                break
            root[i], root[j] = a, b
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        i, j, low, high = i[open_], j[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)


def _link(root: np.ndarray, i: np.ndarray, j: np.ndarray, alike: Alike | None) -> None:
    """Joins pairs that are within the radius and, where that is asked for, alike."""
    if alike and len(i):
        for _ in range(64):
            if (root[root[i]] == root[i]).all() and (root[root[j]] == root[j]).all():
                break
            root[i], root[j] = root[root[i]], root[root[j]]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        same = np.fromiter((alike(a, b) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))
        i, j = i[same], j[same]
    if len(i):
        _join(root, i, j)


def jaccard(sets: pa.LargeListArray, similarity: float) -> Alike:
    """Whether the sets of rows i and j have this Jaccard similarity. No set has a value twice."""
    at = sets.offsets.to_numpy()
    values = sets.values.to_numpy()[at[0] : at[-1]]
    at = (at - at[0]).tolist()
    values = np.unique(values, return_inverse=True)[1]
    mark = np.zeros(len(values), bool)

    def alike(i: int, j: int) -> bool:
        a, b = values[at[i] : at[i + 1]], values[at[j] : at[j + 1]]
        if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
            return False
        mark[a] = True
        both = int(np.count_nonzero(mark[b]))
        mark[a] = False
        either = len(a) + len(b) - both
        return not either or both / either >= similarity

    return alike


def sets(texts: pa.ChunkedArray, n: int) -> pa.ListArray:
    """The texts' sets of n-word shingles' hashes, each sorted."""
    found = [np.unique(shingle_hashes(t.as_py(), n)).view(np.int64) for t in texts]
    at = np.cumsum([0, *map(len, found)])
    return pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(np.concatenate(found) if found else np.empty(0, np.int64)))


def forest(key: np.ndarray, f: np.ndarray, radius: int, alike: Alike | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, other row) that join what lies within the radius, and is alike, among rows of equal key. key is sorted. Rows of equal key and label are one tree to begin with."""
    n = len(key)
    root = np.arange(n)
    if label is not None and n:
        order = np.lexsort((root, label, key))
        first = np.r_[True, (key[order][1:] != key[order][:-1]) | (label[order][1:] != label[order][:-1])]
        root[order] = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.empty(0, int)
    count = np.diff(np.r_[new, n])
    for a, m in zip(new[count > LARGE], count[count > LARGE]):
        _split(root, np.arange(a, a + m), f[a : a + m], radius, alike)
    small = np.repeat((count > 1) & (count <= LARGE), count)
    rows = np.flatnonzero(small)
    if len(rows):
        sizes = count[(count > 1) & (count <= LARGE)]
        left = np.repeat(sizes, sizes) - (np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes))  # rows from here to the block's end
        p = planes(f[rows])
        for d in range(1, int(sizes.max())):
            # Rows that are linked already need no comparison.
            while (root != root[root]).any():
                root = root[root]
            apart = left > d
            apart[: len(rows) - d] &= root[rows[: len(rows) - d]] != root[rows[d:]]
            lanes = np.packbits(apart, bitorder="little")
            alive = np.zeros(p.shape[1], np.uint64)
            alive.view(np.uint8)[: len(lanes)] = lanes
            i = near_at(p, d, alive, radius)
            _link(root, rows[i], rows[i + d], alike)
    while (root != root[root]).any():
        root = root[root]
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _split(root: np.ndarray, rows: np.ndarray, f: np.ndarray, radius: int, alike: Alike | None = None) -> None:
    """A block of many rows: bits in which its rows differ are dealt to radius + 1 parts, of which a linked pair shares one; each part's value is a block of its own."""
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
    differ = np.flatnonzero(bits.any(0) & ~bits.all(0))
    for part in range(radius + 1):
        own = differ[part :: radius + 1]
        key = np.zeros(len(f), np.uint64)
        for b in own[:60]:
            key = (key << np.uint64(1)) | bits[:, b].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        for a, m in zip(new, np.diff(np.r_[new, len(k)])):
            if m < 2:
                continue
            own_rows = order[a : a + m]
            if m > LARGE and m < len(f):
                _split(root, rows[own_rows], f[own_rows], radius, alike)
                continue
            p, w = planes(f[own_rows]), (m + 63) // 64
            for d in range(1, m):
                lanes = np.packbits(np.arange(m) < m - d, bitorder="little")
                alive = np.zeros(w + 1, np.uint64)
                alive.view(np.uint8)[: len(lanes)] = lanes
                i = near_at(p, d, alive, radius)
                _link(root, rows[own_rows[i]], rows[own_rows[i + d]], alike)


def _linker(size: int, radius: int, similarity: float | None = None, n: int = 5, chunk: int = 100_000):
    def links(t: pa.Table) -> pa.RecordBatch:
        key = t["k"].to_numpy()
        f = np.stack([t[f"f{k}"].to_numpy().view(np.uint64) for k in range(size)], 1)
        node = t["node"].to_numpy()
        alike = jaccard(sets(t["text"], n), similarity) if similarity else None
        a, b = forest(key, f, radius, alike, t["label"].to_numpy() if "label" in t.column_names else None)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(key[a])], ["u", "v", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole blocks at a time: rows come sorted by key."""
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t["k"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield links(t.slice(0, cut).combine_chunks())
                    held = t.slice(cut).to_batches()
                    n -= cut
        if n:
            yield links(pa.Table.from_batches(held).combine_chunks())

    return run


def large_keys(blocks: DataFrame, rows: int, most: int, weight: Column | int = 1) -> DataFrame | None:
    """(k, n) of the keys whose rows weigh more than `most`; None: there are none. rows: what all weigh."""
    # A key of such weight makes a bucket of as much, and only rows of such buckets are counted by key.
    buckets = max(1 << 12, 8 * rows // most)
    own = blocks.select("k", F.pmod(F.col("k"), F.lit(buckets)).alias("bucket"), F.lit(weight).alias("w") if isinstance(weight, int) else weight.alias("w"))
    heavy = own.groupBy("bucket").agg(F.sum("w").alias("n")).where(F.col("n") > most).select("bucket")
    if heavy.isEmpty():
        return None
    large = stored(own.join(heavy, "bucket", "left_semi").groupBy("k").agg(F.sum("w").cast("long").alias("n")).where(F.col("n") > most), "large-blocks")
    return None if large.isEmpty() else large


def spread(blocks: DataFrame, rows: int, radius: int, most: int = MOST) -> DataFrame:
    """blocks (node, f0, k, rest: the bits that k says nothing of; rows in number) with keys under which at most `most` rows stand, as far as their bits allow: the rest of a larger
    block's bits is dealt to radius + 1 stripes, of which a linked pair shares one, and each stripe's value is a key of its own. Stripes of the next level cut across those before."""
    base, done = radius + 1, []
    for level in range(int(math.log(64, base))):
        large = large_keys(blocks, rows, most)
        if large is None:
            break
        done.append(blocks.join(large, "k", "left_anti"))
        masks = [sum(1 << b for b in range(64) if b // base**level % base == j) for j in range(base)]
        masks = [m - (1 << 64) if m >> 63 else m for m in masks]
        stripe = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(m).cast("long").alias("m")) for j, m in enumerate(masks)])).alias("s")
        hot = blocks.join(large, "k", "left_semi").select("node", "f0", "k", "rest", stripe)
        own = F.col("f0").bitwiseAND(F.col("rest")).bitwiseAND(F.col("s.m"))
        blocks = stored(hot.select("node", "f0", F.xxhash64("k", "s.j", own).alias("k"), F.col("rest").bitwiseAND(F.bitwise_not(F.col("s.m"))).alias("rest")), "blocks")
        rows = blocks.count()
    for x in reversed(done):
        blocks = blocks.unionByName(x)
    return blocks


def dealt(blocks: DataFrame, link, rows: int, most: int = CHUNK, texts: DataFrame | None = None) -> DataFrame:
    """(node, root) of what `link` links within blocks. blocks: k, node (once in a block), w (a row's weight) and what else `link` reads; rows: what all weigh; texts: (uid, text) of the nodes, if `link` reads
    them. A task holds a block of a weight up to `most`, or a chunk or two of a larger one."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in blocks.columns if c not in ("k", "w")] + ["text"] * (texts is not None)
    chunk = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))

    def with_texts(x: DataFrame) -> DataFrame:
        return x if texts is None else x.join(texts.withColumnRenamed("uid", "node"), "node")

    def met(x: DataFrame, *more: str) -> DataFrame:
        return x.select("k", *rest, *more).repartition(tasks, "k").sortWithinPartitions("k", "node").mapInArrow(link, LINK)

    def of_block(x: DataFrame, values: DataFrame, counts: DataFrame) -> DataFrame:
        """x with values by k, of which there are at most rows / most."""
        return x.join(F.broadcast(values), "k", "left") if values.count() <= HELD else lookup(x, values, "k", counts)

    large = large_keys(blocks, rows, most, F.col("w"))
    if large is None:
        return components(met(with_texts(blocks)))
    blocks = of_block(blocks, large.select("k", F.ceil(F.col("n") / most).alias("chunks")), large)
    links = stored(met(with_texts(blocks.where("chunks is null"))), "links")
    hot = stored(with_texts(blocks.where("chunks is not null")).withColumn("own", F.xxhash64("k", chunk("own", "chunks"))), "large-rows")
    # Forests of the chunks: a row's label is its tree's root there, so no more rows than a chunk's have one label.
    found = stored(met(hot.withColumn("k", F.col("own"))), "links")
    roots = found.select(F.col("k").alias("own"), F.col("u").alias("node"), "v")
    at = stored(hot.select(*[c for c in hot.columns if c != "text"]).join(roots, ["own", "node"], "left").withColumn("label", F.coalesce("v", "node")).drop("v"), "labelled")

    def whole(x: DataFrame) -> DataFrame:
        return x if texts is None else x.join(hot.select("k", "node", "text"), ["k", "node"])

    # The trees' roots meet each other.
    first = at.where("node = label")
    size = stored(first.groupBy("k").agg(F.ceil(F.sum("w") / most).alias("parts"), F.count("*").alias("n")), "sizes")
    first = of_block(first, size.select("k", "parts"), size.select("k", "n")).withColumn("tree", F.xxhash64("k", F.lit("trees"), chunk("trees", "parts")))
    joined = stored(met(whole(first).withColumn("k", F.col("tree"))), "links")
    roots = first.select("k", "tree", "node").join(joined.select(F.col("k").alias("tree"), F.col("u").alias("node"), "v"), ["tree", "node"]).select("k", F.col("node").alias("label"), "v")
    at = stored(at.join(roots, ["k", "label"], "left").withColumn("label", F.coalesce("v", "label")).drop("v"), "labelled")
    links = links.unionByName(found).unionByName(joined)
    # Rows outside their block's largest component meet all.
    size = at.groupBy("k", "label").agg(F.sum("w").alias("n")).groupBy("k").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("out"), F.sum("n").alias("n"))
    size = stored(size, "sizes").where("out > 0")
    if not size.isEmpty():
        at = of_block(at, size.select("k", "main", F.ceil(F.col("out") / most).alias("parts")), size.select("k", "n")).where("parts is not null")
        at = whole(at)
        every = at.select("*", chunk("own", "chunks").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("b"))
        out = at.where("label <> main").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("a"), chunk("out", "parts").alias("b"))
        # A row outside may stand in a task twice; its two rows have one label and are one tree.
        links = links.unionByName(stored(met(every.unionByName(out).withColumn("k", F.xxhash64("k", F.lit("pairs"), "a", "b")), "label"), "links"))
    return components(links)


def linked(rows: DataFrame, size: int, radius: int, by_bands: bool, most: int = MOST) -> DataFrame:
    """(node, root) of nodes that are linked. rows: node, f0 and so on, bands: each fingerprint, or set, once."""
    fs = [f"f{k}" for k in range(size)]
    if by_bands:
        blocks = rows.select("node", *fs, F.posexplode("bands").alias("t", "b")).select("node", *fs, F.xxhash64("t", "b").alias("k"))
    else:
        parts, width = radius + 2, 64 // (radius + 2)
        cuts = [(k * width, 64 if k + 1 == parts else (k + 1) * width) for k in range(parts)]
        bits = [F.shiftrightunsigned(F.shiftleft("f0", 64 - b), 64 - b + a) for a, b in cuts]
        pairs = [(i, j) for i in range(parts) for j in range(i)]
        signed_mask = lambda i, j: (m := ((1 << 64) - 1) & ~sum(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in (cuts[i], cuts[j]))) - ((m >> 63) << 64)
        keys = [F.struct(F.xxhash64(F.lit(i * parts + j), bits[i], bits[j]).alias("k"), F.lit(signed_mask(i, j)).cast("long").alias("rest")) for i, j in pairs]
        blocks = rows.select("node", *fs, F.explode(F.array(*keys)).alias("x")).select("node", *fs, "x.k", "x.rest")
        blocks = spread(blocks, rows.count() * len(pairs), radius, most).drop("rest")
        met = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k", "node")
        return components(met.mapInArrow(_linker(size, radius), LINK))
    return dealt(blocks.withColumn("w", F.lit(1).cast("long")), _linker(size, radius), rows.count() * BANDS, min(most, CHUNK))


def confirmed(docs: DataFrame, nodes: DataFrame, found: DataFrame, n: int, size: int, radius: int, similarity: float, most: int = CHUNK) -> DataFrame:
    """(node, root) of nodes that links of this Jaccard similarity join. found: of candidate links. docs: uid and text. nodes: node, fingerprints and w."""
    open_ = found.join(nodes, "node").select("node", F.col("root").alias("k"), *(f"f{k}" for k in range(size)), "w")
    rows = nodes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return dealt(open_, _linker(size, radius, similarity, n, 1000), rows, most, docs)


def grouped(docs: DataFrame, n: int, size: int, radius: int, by_bands: bool = False, text: str = "text", key: str = "doc_id", similarity: float | None = None, most: int = MOST) -> DataFrame:
    """A row for each of docs: its columns but the text, f0 and so on, uid, and component_id, the least key of its group, and chosen: it is the group's one to keep.

    With a similarity, links are confirmed by the sets of shingles; docs, read a second time for that, have a uid, and their text is named so."""
    ids = [f"f{k}" for k in range(size)] + ["s0", "s1"] * by_bands
    others = [c for c in docs.columns if c != text]
    weight = (1 + F.floor(F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0)) / PAGE)).cast("long").alias("w")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("d"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *(["uid", weight] if similarity else []))
    s = signed(own, n, size, by_bands)
    s = stored(s if similarity else s.withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "uid")).alias("first")
    also = [F.first("bands").alias("bands")] * by_bands + [F.max("w").alias("w")] * (similarity is not None)
    nodes = stored(s.groupBy(*ids).agg(F.min("uid").alias("node"), first, F.count("*").alias("n"), *also), "nodes")
    found = linked(nodes, size, radius, by_bands, most)
    if similarity:
        found = confirmed(docs.select("uid", "text"), nodes, found, n, size, radius, similarity, min(most, CHUNK))
    of = nodes.select("node", *ids, "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    of = stored(of.select(*ids, "root").join(least, "root").select(F.xxhash64(*ids).alias("h"), F.struct(*ids).alias("f"), "least"), "groups")
    counts = nodes.select(F.xxhash64(*ids).alias("h"), "n").groupBy("h").agg(F.sum("n").alias("n"))
    own = s.drop("bands").withColumn("h", F.xxhash64(*ids) if len(ids) > 1 else F.xxhash64("f0"))
    # h may join two fingerprints, though hardly ever: they are compared as well.
    right = of.groupBy("h").agg(F.collect_list(F.struct("f", "least")).alias("of"))
    out = lookup(own, right, "h", counts)
    hit = F.filter("of", lambda x: x["f"] == F.struct(*ids))[0]["least"]
    made = [f"f{k}" for k in range(size)] + ["uid", "component_id", "chosen"]
    out = out.withColumn("least", hit).select("d", *made[:-2], F.col("least.key").alias("component_id"), (F.col("least.uid") == F.col("uid")).alias("chosen"))
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in others if c not in made], *made)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, size=1, radius=3)
    return g.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def radius_at(similarity: float, bits: int) -> int:
    """The distance expected of two sets of this Jaccard similarity, and SPREAD standard deviations more."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, n: int = 5) -> DataFrame:
    """One of each group of documents that are linked by this Jaccard similarity of their n-word shingles, with the columns that they came with: the one with the least doc_id."""
    cols = docs.columns
    size = 4
    own = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("d"), F.monotonically_increasing_id().alias("at")), "near-docs")
    texts = own.select(F.col("at").alias("uid"), F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"))
    g = grouped(texts, n, size, radius_at(similarity, 64 * size), by_bands=True, similarity=similarity)
    return own.join(g.where("chosen").select(F.col("uid").alias("at")), "at", "left_semi").select(*[F.col(f"d.`{c}`").alias(c) for c in cols])
