"""Lines that many documents share are dropped, by levelled sorted runs of line hashes.

Every batch of documents gives a table (h1, h2, n): a line key's 128-bit hash and the number of the batch's documents that hold
it. A batch first loses, by a merge anti-join, the keys that the runs already know to be repeated; the others are added as a run
of level 0, bucketed and sorted by hash, so that later joins and merges need neither shuffle nor sort of the runs. `fanout` runs
of a level are compacted to one of the next. The keys whose counts reach `min_docs` over all runs are the repeated ones.

Nulls: a null text is one empty line. Keys that are empty after stripping are never dropped. Each row is a document, so rows that repeat, or share
an id, or have none, count each; those with equal id and text get equal results. A very long text is one row, its keys are sorted there. An empty table gives an empty result. Other columns pass through untouched;
columns of the input named like the result's (n_lines, n_dropped) are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import BLANKS, HEAVY, ascii_lower, fresh_path, let, remove, stored, table, text_key


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n)."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.at = fresh_path(spark, "line-runs")

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.at}/{name}").saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs as one, by merge joins: equal keys' counts are added. A run holds a key once, so no key is hot."""
        df = self.spark.table(names[0])
        for x in names[1:]:
            more = self.spark.table(x).withColumnRenamed("n", "m")
            df = df.join(more, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return df

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def repeated(self) -> DataFrame:
        """Keys found in min_docs documents or more so far."""
        return self._merged(self.names()).where(F.col("n") >= self.min_docs)

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n) of new documents."""
        if self.names():
            known = self.repeated().select("h1", "h2")
            batch = batch.join(known, ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(batch.repartition(self.buckets, "h1", "h2")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._merged(old).repartition(self.buckets, "h1", "h2")))
            self._drop(old)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for x in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {x}")
            remove(self.spark, f"{self.at}/{x}")

    def close(self) -> None:
        self._drop(self.names())
        self.levels = [[]]
        remove(self.spark, self.at)


def repeated_keys(lines: DataFrame, min_docs: int, batches: int) -> DataFrame:
    """(h1, h2, n) of keys in min_docs documents or more. lines: (batch, h1, h2, first), a row for each line of each document; first: it is its document's first with this key."""
    spark = lines.sparkSession
    counts = stored(lines.where("first").groupBy("batch", "h1", "h2").agg(F.count("*").alias("n")), "line-counts")
    runs = LineRuns(spark, min_docs)
    for k in range(batches):
        runs.add(counts.where(F.col("batch") == k).select("h1", "h2", "n"))
    found = stored(runs.repeated(), "repeated-lines")
    runs.close()
    return found


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """docs with the text less its repeated lines, and n_lines (before), n_dropped."""
    cols = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # A document's keys are sorted in its own row, where equal ones are neighbours: which documents hold a key needs no shuffle of lines.
    hashed = F.transform(split, lambda x, i: let(line_key(x), lambda k: F.when(F.char_length(k) >= max(1, min_chars), F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"), i.alias("pos")))))
    batch = F.pmod(F.monotonically_increasing_id(), F.lit(batches)).cast("int")
    rows = docs.select(F.col(key).alias("did"), text_key(F.col(text)).alias("th"), batch.alias("batch"), F.sort_array(F.filter(hashed, lambda x: x.isNotNull())).alias("ks"))

    def marked_first(ks: Column) -> Column:
        def own(x: Column, i: Column) -> Column:
            before = F.get(ks, i - 1)
            first = (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])
            return F.struct(x["pos"].alias("pos"), x["h1"].alias("h1"), x["h2"].alias("h2"), first.alias("first"))

        return F.transform(ks, own)

    lines = rows.select("did", "th", "batch", F.inline(marked_first(F.col("ks"))))
    lines = stored(lines, "lines")
    bad = repeated_keys(lines, min_docs, batches)
    # Keys with more than 1/HEAVY of all lines are at most HEAVY in number: they are broadcast, so that no join deals out a hot key.
    most = F.broadcast(lines.agg((F.count("*") / HEAVY).alias("most")))
    marked = bad.join(most)
    hot = marked.where(F.col("n") > F.col("most")).select("h1", "h2")
    rest = marked.where(F.col("n") <= F.col("most")).select("h1", "h2")
    at = lines.select("did", "th", "pos", "h1", "h2")
    gone = at.join(F.broadcast(hot), ["h1", "h2"], "left_semi").unionByName(at.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(rest, ["h1", "h2"], "left_semi"))
    gone = gone.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = gone.select(F.col("did").alias("_did"), F.col("th").alias("_th"), "gone")
    out = docs.select(F.struct(*cols).alias("d"), F.col(key).alias("did"), text_key(F.col(text)).alias("th"))
    out = out.join(gone, F.col("did").eqNullSafe(F.col("_did")) & (F.col("th") == F.col("_th")), "left")

    def cut(ls: Column) -> Column:
        """The lines between the dropped ones, slice by slice."""
        ends = F.concat(F.array(F.lit(-1)), "gone", F.array(F.size(ls)))
        return let(ends, lambda e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda k: F.slice(ls, e[k - 1] + 2, e[k] - e[k - 1] - 1))))

    split = F.split(F.coalesce(F.col(f"d.{text}"), F.lit("")), "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.coalesce(F.col(f"d.{text}"), F.lit(""))).otherwise(let(split, lambda ls: F.concat_ws("\n", cut(ls))))
    named = [kept.alias(c) if c == text else F.col(f"d.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*named, F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH l AS (SELECT uid, doc_id, u.pos, u.line, translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
           LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) AS u),
bad AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT uid) >= 10),
m AS (SELECT l.uid, l.doc_id, l.pos, l.line, bad.k IS NOT NULL AS gone FROM l LEFT JOIN bad ON l.k = bad.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY uid, doc_id
"""
