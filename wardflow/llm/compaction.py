"""Small files packed into groups, and each group rewritten as one file.

write_files gives a folder a file for each value of some keys, sorted. pack lets the small files of a bin (here a day), largest first, each join
the earliest-opened group with room for it, or open one: the groups stand in a treap keyed by opening order whose nodes hold the most room in their
subtree, so that the leftmost group with room is found by one descent, and joining it changes the nodes on one path only. rewrite then has a task for each group
stream its sources' row groups into one writer, and switches: new files are moved to their place and their sources deleted.

What the driver sees are counts of rows; files, groups and places stay tables, and no task holds more than a bin's list of files, or a row group. Every step can be run again by
Spark: new files have names of their own until a table in the shared folder lists those that count, and moving and deleting what has been moved and deleted
does nothing. A reader of the folder sees a group's rows twice between the move and the deletion. Moves are renames; a store without them copies.

Nulls: keys may be null, and equal ones are one value; null order columns come first. Repeated rows each stay. Columns that may be sorted break ties, so reruns agree. A very long text is
written and copied with its row group. An empty table gives an empty folder and an empty result. The table's own columns may have any name: names of keys are changed where they clash.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import fresh_path, remove, stored, table
from wardflow.llm.warc import opened

ROW_GROUP = 1 << 17


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _exists(disk: fs.FileSystem, path: str) -> bool:
    return disk.get_file_info(path).type == fs.FileType.File


def _moved(disk: fs.FileSystem, source: str, to: str) -> None:
    """Moves a file that may have been moved before."""
    if _exists(disk, source):
        disk.move(source, to)
    elif not _exists(disk, to):
        raise FileNotFoundError(source)


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t)
    return _orderable(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, (T.MapType, T.VariantType))


# ---- files ----


def write_files(df: DataFrame, cols: list[str], at: str, keys: dict[str, Column], order: list[str]) -> DataFrame:
    """Writes df's columns `cols` into folder `at`, a file for each value of the keys, its rows sorted by `order`, and returns (the keys' names, path, n_rows), a row a file. Each file is one task's, streamed from its sorted rows."""
    spark = df.sparkSession
    taken = {c.lower() for c in cols}
    name = {k: next(n for n in (k, *(f"{k}_{i}" for i in range(len(cols) + 1))) if n.lower() not in taken) for k in keys}
    own = [F.col(f"`{c}`") for c in cols]
    written = [df.schema[c] for c in cols]
    ties = [F.col(f"`{f.name}`") for f in written if f.name not in order and _orderable(f.dataType)]
    dealt = df.select(*own, *[c.cast("long").alias(name[k]) for k, c in keys.items()]).repartition(_tasks(spark), *name.values())
    dealt = dealt.sortWithinPartitions(*name.values(), *[F.col(f"`{c}`") for c in order], *ties)
    staging, kind = f"{at}/_staging", "spark.sql.parquet.outputTimestampType"
    was = spark.conf.get(kind)
    spark.conf.set(kind, "TIMESTAMP_MICROS")  # what a rewritten file can hold as it is
    try:
        dealt.write.partitionBy(*name.values()).parquet(staging)
    finally:
        spark.conf.set(kind, was)
    schema = T.StructType([*written, *[T.StructField(n, T.LongType()) for n in name.values()]])
    rows = spark.read.schema(schema).parquet(staging).select(*[F.col(n).alias(k) for k, n in name.items()], F.col("_metadata.file_path").alias("path"))
    values = list(keys)
    files = rows.groupBy(*values, "path").agg(F.count("*").alias("n_rows")).repartition(_tasks(spark), "path")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = []
            for row in b.to_pylist():
                to.append(f"{at}/{'-'.join('null' if row[k] is None else str(row[k]) for k in values)}.parquet")
                disk, source = opened(row["path"])
                _moved(disk, source, opened(to[-1])[1])
            yield b.set_column(b.schema.get_field_index("path"), "path", pa.array(to, pa.string()))

    out = stored(files.mapInArrow(flat, files.schema), "files")
    remove(spark, staging)
    return out


# ---- packing ----


class Groups:
    """A treap of groups keyed by opening order, where each node knows the most room in its subtree."""

    def __init__(self):
        self.left: list[int] = []
        self.right: list[int] = []
        self.rank: list[int] = []
        self.room: list[int] = []
        self.most: list[int] = []
        self.top = -1

    def _set(self, k: int) -> None:
        m = self.room[k]
        for c in (self.left[k], self.right[k]):
            if c >= 0 and self.most[c] > m:
                m = self.most[c]
        self.most[k] = m

    def open(self, room: int) -> int:
        """A new last group. It goes down the right spine until its rank is the larger, and takes what lies below as its left subtree."""
        new = len(self.room)
        x = (new + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        rank, spine, k = x ^ x >> 27, [], self.top
        while k >= 0 and self.rank[k] >= rank:
            spine.append(k)
            k = self.right[k]
        self.left.append(k)
        self.right.append(-1)
        self.rank.append(rank)
        self.room.append(room)
        self.most.append(room)
        self._set(new)
        if spine:
            self.right[spine[-1]] = new
            for p in reversed(spine):
                self._set(p)
        else:
            self.top = new
        return new

    def join(self, size: int) -> int | None:
        """The earliest group with this much room, which it takes; None: no group has."""
        if self.top < 0 or self.most[self.top] < size:
            return None
        path, k = [], self.top
        while True:
            path.append(k)
            c = self.left[k]
            if c >= 0 and self.most[c] >= size:
                k = c
            elif self.room[k] >= size:
                break
            else:
                k = self.right[k]
        self.room[k] -= size
        for p in reversed(path):
            self._set(p)
        return k


def packed(sizes: list[int], full: int) -> list[int]:
    """The group of each size, taken as they come."""
    groups = Groups()
    return [g if (g := groups.join(s)) is not None else groups.open(full - s) for s in sizes]


def pack(files: DataFrame, by: str, then: list[str], small: int, full: int) -> DataFrame:
    """files with group (its number in the bin) and place (in joining order). Files of n_rows under `small` are packed within their bin, in order of falling n_rows and then of the columns
    `then`; a group holds at most `full` rows, but a file that alone has more, which is a group of its own. Others have null groups. A bin's list of files is one task's."""
    cols = files.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n_rows", "descending"), *[(c, "ascending") for c in then]])
        group = packed(t["n_rows"].to_pylist(), full)
        return t.append_column("group", pa.array(group, pa.int64())).append_column("place", pa.array(range(len(group)), pa.int64()))

    schema = T.StructType([*files.schema, T.StructField("group", T.LongType()), T.StructField("place", T.LongType())])
    few = files.where(F.col("n_rows") < small).groupBy(by).applyInArrow(run, schema)
    rest = files.where(F.col("n_rows") >= small).select(*cols, F.lit(None).cast("long").alias("group"), F.lit(None).cast("long").alias("place"))
    return few.unionByName(rest)


# ---- rewriting ----


def _joined(at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams each group's sources into a file of an own name."""
        for b in batches:
            made = []
            for sources in b["sources"].to_pylist():
                if len(sources) == 1:
                    made.append(None)
                    continue
                to = f"{at}/_compacting/{uuid.uuid4().hex}.parquet"
                disk, path = opened(to)
                disk.create_dir(posixpath.dirname(path), recursive=True)
                out = None
                with disk.open_output_stream(path) as stream:
                    for s in sources:
                        with disk.open_input_file(opened(s["path"])[1]) as source:
                            f = pq.ParquetFile(source)
                            out = out or pq.ParquetWriter(stream, f.schema_arrow, compression="snappy")
                            for k in range(f.num_row_groups):
                                for rows in f.iter_batches(ROW_GROUP, row_groups=[k]):
                                    out.write_batch(rows, row_group_size=ROW_GROUP)
                    out.close()
                made.append(to)
            yield b.append_column("made", pa.array(made, pa.string()))

    return run


def _switched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            if row["made"] is not None:
                disk, made = opened(row["made"])
                _moved(disk, made, opened(row["path"])[1])
                for s in row["sources"]:
                    if _exists(disk, old := opened(s["path"])[1]):
                        disk.delete_file(old)
        yield b.drop_columns(["made"])


def rewrite(files: DataFrame, at: str, by: str) -> DataFrame:
    """Rewrites each group of several files as one and returns (sources: the files' rows in joining order, path, rewritten), a row for each file that there is then. files: as pack gives them."""
    spark = files.sparkSession
    names = [c for c in files.columns if c not in ("group", "place")]
    key = F.when(F.col("group").isNull(), F.col("path")).otherwise(F.concat_ws("/", F.coalesce(F.col(by).cast("string"), F.lit("null")), F.col("group").cast("string")))
    source = F.struct("place", *names)
    g = files.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(source)).alias("sources"))
    several = F.size("sources") > 1
    path = F.when(several, F.concat(F.regexp_replace(F.col("sources")[0]["path"], r"\.parquet$", ""), F.lit("-and-"), F.size("sources") - 1, F.lit(".parquet"))).otherwise(F.col("sources")[0]["path"])
    g = g.select("sources", path.alias("path"), several.alias("rewritten")).repartition(_tasks(spark), "path")
    made = stored(g.mapInArrow(_joined(at), T.StructType([*g.schema, T.StructField("made", T.StringType())])), "made")
    done = stored(made.mapInArrow(_switched, g.schema), "final")
    remove(spark, f"{at}/_compacting")
    return done


# ---- the query ----

CLICKS = "n_rows long, min_click_id long, max_click_id long, cents long, ids_sha256 string, columns string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a file holds, read by row groups."""
    for b in batches:
        found = []
        for path in b["path"].to_pylist():
            disk, own = opened(path)
            n, low, high, cents, sha = 0, None, None, 0, hashlib.sha256()
            with disk.open_input_file(own) as source:
                f = pq.ParquetFile(source)
                for rows in f.iter_batches(ROW_GROUP, columns=["click_id", "value"]):
                    ids = rows["click_id"].to_pylist()
                    sha.update(("," * bool(n) + ",".join("" if i is None else str(i) for i in ids)).encode())
                    n += len(ids)
                    x = np.floor(100 * rows["value"].cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False) + 0.5)
                    cents += int(x[np.isfinite(x)].astype(np.int64).sum())
                    some = pc.min_max(rows["click_id"]).as_py()
                    if some["min"] is not None:
                        low, high = min(some["min"], low if low is not None else some["min"]), max(some["max"], high if high is not None else some["max"])
                found.append((n, low, high, cents, sha.hexdigest(), ",".join(f.schema_arrow.names)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        cols = [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "n_rows", "min_click_id", "max_click_id", "cents", "ids_sha256", "columns"])


def compacted_clicks(clicks: DataFrame) -> DataFrame:
    """clicks written by day, lot and piece into a new folder and compacted there. Non-finite values count as 0 cents, a row without an id as one whose id is the empty text, and a row without a time as one of a day of its own."""
    spark = clicks.sparkSession
    total = clicks.count()
    share = lambda x: 1 + total // x
    day = F.unix_date(F.col("arrived_at").cast("date")).cast("long")
    # Days with more than one lot have over a 200th of the rows each, so there are under 200 of them.
    large = clicks.groupBy(day.alias("_day")).agg((1 + F.floor(F.count("*") / share(200))).cast("long").alias("_lots")).where("_lots > 1")
    rows = clicks.select(F.struct(*[F.col(f"`{c}`") for c in clicks.columns]).alias("c"), day.alias("_day"))
    rows = rows.join(F.broadcast(large.withColumnRenamed("_day", "_of")), F.col("_day").eqNullSafe(F.col("_of")), "left")
    h = F.crc32(F.coalesce(F.col("c.click_id").cast("string"), F.lit("")))
    lot = F.floor(h / 16) % F.coalesce("_lots", F.lit(1))
    piece = F.least(h % 4, F.floor(h / 4) % 4)
    # The table's columns, whatever their names, beside one that none of them has.
    of = f"key-{uuid.uuid4().hex}"
    rows = rows.select("c.*", F.struct(F.col("_day").alias("day"), lot.alias("lot"), piece.alias("piece")).alias(of))
    at = fresh_path(spark, "clicks")
    files = write_files(rows, clicks.columns, at, {k: F.col(f"`{of}`.{k}") for k in ("day", "lot", "piece")}, ["arrived_at", "click_id"])
    final = rewrite(pack(files, "day", ["lot", "piece"], share(750), share(400)), at, "day")
    first = F.col("sources")[0]
    names = F.array_join(F.transform("sources", lambda s: F.concat_ws("-", s["lot"].cast("string"), s["piece"].cast("string"))), ",")
    final = final.select(first["day"].alias("day"), first["lot"].alias("lot"), first["piece"].alias("piece"), names.alias("sources"), "path", "rewritten").repartition(_tasks(spark), "path")
    return final.mapInArrow(_read_back, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in final.schema) + ", " + CLICKS)


def op12_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stored(compacted_clicks(table(spark, sf_dir, "clicks")), "compacted")
    return out.select("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "path", "rewritten")
