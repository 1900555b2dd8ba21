"""Sources mixed to target weights by weighted fair queueing.

Every source shuffles its documents by a hash of id and seed and queues them, `epochs` times over in the same order. A copy's
virtual finish time is the source's words up to and including it, divided by the source's target; the mix is all copies in order
of virtual finish time (then of id and epoch), truncated where their words reach the budget: of the copy that passes it the first words are taken, of those behind it none.
A source's taken words are thus its target's but for a document's.

Targets: sources in code-point order (null last) weigh `weights`, repeating, and share `share` of all words, which is the budget (rounded down); a target stops at
`epochs` times its source's words, and the excess goes to the others by weight until none is above.

A source may hold any share of the rows: its queue is cut by hash into chunks of about `chunk` documents, whose sums give each
chunk's start, so that no task holds more than a chunk. The cut is found the same way: equal stretches of virtual time hold about equally many words, so
words are summed by stretches (STRETCHES at most), and only the copies of the one stretch in which the budget is reached are put in order and summed up.

Nulls: a null text has size 0, a null source is a source of its own, a row without an id takes its place by
its text. Rows that repeat are each queued; which of equal rows comes first does not show in the result but where the budget ends between them, and rows that share an id share a chunk. A very long text is split into words in its own row.
mixed_documents gives all columns back, whatever their names; the others name their columns themselves. Sources without words have target
0, and their documents are not taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.llm.common import stored, table, text_key, words

WEIGHTS = (3, 1, 2)
#: Stretches of virtual time, whose sums one task holds.
STRETCHES = 100_000


def targets(sources: DataFrame, share: float = 1.5, epochs: int = 2, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) with w and target. Targets rise together with a common level, until each meets its cap; the sources are
    taken by the level at which they meet it. It handles one row a source, in a few tasks."""
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * epochs).withColumn("meets", F.col("cap") / F.col("w"))
    by = W.orderBy("meets", F.col("source").isNull(), "source")
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    s = s.withColumn("level", (total * share - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest))
    # The first source that its level doesn't fill: from there on all have that level.
    s = s.withColumn("final", F.min(F.when(F.col("level") <= F.col("meets"), F.struct("meets", F.col("source").isNull().alias("n"), "source", "level"))).over(W.partitionBy())["level"])
    return s.select("source", "source_size", "w", F.least(F.col("cap").cast("double"), F.col("final") * F.col("w")).alias("target"))


def queue(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: str = "mix", share: float = 1.5, epochs: int = 2, weights: tuple = WEIGHTS, chunk: int = 2000, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: its key, source and `keep` columns, size, source_size, target, uid (the row's own number), and start: its source's words before it in the queue."""
    keep = [] if keep is None else keep
    size = F.size(words(F.col(text))).cast("long")
    # Rows without an id are shuffled by their texts, lest all of them have one place.
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), text_key(F.col(text))["a"].cast("string")))
    d = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), *keep, size.alias("size"), F.md5(F.concat_ws(":", F.lit(seed), name)).alias("r"), text_key(F.col(text)).alias("th"))
    d = stored(d, "mix-sizes").withColumn("uid", F.monotonically_increasing_id())
    chunks = max(16, -(-d.count() // chunk))
    d = d.withColumn("part", F.floor(F.conv(F.substring("r", 1, 8), 16, 10).cast("double") / 2.0**32 * chunks).cast("long"))
    parts = d.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = stored(parts, "mix-parts")
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sources = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), share, epochs, weights)
    parts = _null_safe(parts, sources)
    d = _null_safe(d, parts.select("source", "part", "offset", "source_size", "target"), also=["part"])
    within = W.partitionBy("source", "part").orderBy("r", "key", "size", "th", "uid").rowsBetween(W.unboundedPreceding, -1)
    return d.select("key", "source", *keep, "size", "source_size", "target", "uid", (F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start"))


def _null_safe(left: DataFrame, right: DataFrame, also: list[str] = ()) -> DataFrame:
    r = right.withColumnsRenamed({c: f"_{c}" for c in ("source", *also)})
    on = F.col("source").eqNullSafe(F.col("_source"))
    for c in also:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return left.join(r, on).drop(*(f"_{c}" for c in ("source", *also)))


def finish(epoch: Column | int) -> Column:
    """The virtual finish time of a document's copy; null where the source has no words."""
    return F.when(F.col("target") > 0, (F.col("start") + F.col("source_size") * epoch + F.col("size")) / F.col("target"))


def place(epoch: Column | int) -> Column:
    """What copies are ordered by."""
    return F.struct(finish(epoch).alias("finish"), F.col("key").isNull().alias("none"), "key", (F.lit(epoch) if isinstance(epoch, int) else epoch).cast("int").alias("epoch"), "uid")


def truncated(q: DataFrame, share: float = 1.5, epochs: int = 2, chunk: int = 2000) -> DataFrame:
    """The queue with `taken`: for each epoch, the words that the mix takes of the copy, in an array. Written to the shared folder first, as it is read three times."""
    q = stored(q, "mix-queue")
    n, words_ = q.agg(F.count("*"), F.sum("size")).first()
    stretches = min(STRETCHES, max(16, -(-n * epochs // chunk)))
    e = q.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.select("size", place(F.col("epoch")).alias("at")).withColumn("stretch", F.least(F.floor(F.col("at.finish") * stretches), F.lit(4 * stretches)).cast("long"))
    budget = F.lit(int((words_ or 0) * min(share, epochs))).cast("long")
    upto = W.orderBy("stretch").rowsBetween(W.unboundedPreceding, W.currentRow)  # over stretches, not copies
    sums = e.groupBy("stretch").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    last = sums.where((F.col("upto") >= budget) & (F.col("upto") - F.col("words") < budget)).select(F.col("stretch").alias("of"), (F.col("upto") - F.col("words")).alias("before"))
    own = e.join(F.broadcast(last), F.col("stretch") == F.col("of"))
    within = W.partitionBy("stretch").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("left", budget - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))).where((F.col("left") > 0) & (F.col("left") <= F.col("size")))
    cut = own.agg(F.min(F.struct("at", "left")).alias("cut"))  # one row: the copy that the budget ends in; null: it is not reached
    at = F.col("cut.at")
    taken = lambda k: F.when(F.col("target") > 0, F.when(at.isNull() | (place(k) < at), F.col("size")).when(place(k) == at, F.col("cut.left")).otherwise(0)).otherwise(0).cast("long")
    return q.join(F.broadcast(cut)).withColumn("taken", F.array(*[taken(k) for k in range(epochs)])).drop("cut")


def mix(docs: DataFrame, share: float = 1.5, epochs: int = 2, chunk: int = 2000, ordered: bool = True, **options) -> DataFrame:
    """The mixed stream: a row for each taken copy, in order of virtual finish time (range-sorted over all partitions, unless the caller does)."""
    q = truncated(queue(docs, share=share, epochs=epochs, chunk=chunk, **options), share, epochs, chunk)
    q = q.select("*", F.posexplode("taken").alias("epoch", "words")).drop("taken").withColumnRenamed("words", "taken").where("taken > 0")
    q = q.withColumn("finish", finish(F.col("epoch")))
    return q.orderBy("finish", F.col("key").asc_nulls_last(), "epoch", "uid") if ordered else q


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    q = truncated(queue(docs))
    out = q.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("taken")[0] + F.col("taken")[1]).alias("taken"), finish(0).alias("finish"))
    return out.orderBy("finish", "doc_id")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix:' || doc_id::VARCHAR) AS r FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w FROM s0),
s2 AS (SELECT *, source_size * 2 AS cap, (source_size * 2) / w AS meets FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY meets, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
       / (sum(w) OVER (ORDER BY meets, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s2),
f AS (SELECT level FROM s3 WHERE level <= meets ORDER BY meets, source IS NULL, source LIMIT 1),
s4 AS (SELECT source, source_size, least(cap::DOUBLE, f.level * w) AS target FROM s3, f),
q AS (SELECT d.*, s4.source_size, s4.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY r, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
c AS (SELECT doc_id, size, (start + source_size * epoch + size)::DOUBLE / target AS finish, epoch FROM q, (VALUES (0), (1)) AS e(epoch) WHERE size > 0),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM c),
t AS (SELECT doc_id, sum(greatest(0, least(size, (SELECT (sum(size) * 3) // 2 FROM d) - (upto - size))))::BIGINT AS taken FROM r GROUP BY doc_id)
SELECT doc_id, q.size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, CASE WHEN target > 0 THEN (start + q.size)::DOUBLE / target END AS finish
FROM q LEFT JOIN t USING (doc_id)
"""


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix gives them out: a row for each copy of which it takes words (the whole document), in order of virtual finish time."""
    cols = docs.columns
    own = stored(docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{c}`") for c in cols]).alias("d")), "mix-docs")
    taken = mix(own.select("at", "d.doc_id", "d.text", "d.source"), keep=["at"], ordered=False, **options).select("at", "finish", "epoch")
    return own.join(taken, "at").orderBy("finish", F.col("d.doc_id").asc_nulls_last(), "epoch", "at").select(*[F.col(f"d.`{c}`").alias(c) for c in cols])
