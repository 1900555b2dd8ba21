"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many keys can each hold a share of 1/HEAVY of the rows, which bounds what joins broadcast.
HEAVY = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets an own one; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wardflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class _Records(threading.local):
    """Lists that take the paths given out while they are open, by thread."""

    def __init__(self):
        self.open: list[list[str]] = []


_RECORDS = _Records()


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths given out meanwhile in this thread, for a caller that knows when they are no longer read."""
    _RECORDS.open.append(paths := [])
    try:
        yield paths
    finally:
        _RECORDS.open.remove(paths)


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for paths in _RECORDS.open:
        paths.append(path)
    return path


def stored(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut and survives the loss of executors."""
    path = fresh_path(df.sparkSession, tag)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of an earlier step through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is bound where an expression would be repeated."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() serves where no other character would change."""
    rest = F.regexp_replace(c, r"[\x00-\x7F]+", "")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).when(F.lower(rest) == rest, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_key(c: Column) -> Column:
    """128 bits of a text, as two longs."""
    t = F.coalesce(c, F.lit("\x00null"))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit("wardflow"), t).alias("b"))


def words(c: Column) -> Column:
    """The words of a text as an array; null: none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lookup(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """left with right's columns by key, of which right has a row each at most. counts: (key, n), the rows of left by key.

    Keys with over 1/HEAVY of left's rows, HEAVY at most, are broadcast, so a hot key's rows stay where they are."""
    most = F.broadcast(counts.agg((F.sum("n") / HEAVY).alias("most")))
    hot = F.broadcast(counts.join(most).where(F.col("n") > F.col("most")).select(key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return left.join(hot, key, "left_semi").join(few, key, "left").unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))
