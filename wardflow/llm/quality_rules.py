"""Quality rules whose cutoffs adapt to each language and source.

Documents that fail the base rules (under 20 words, or over 30 % of words in repeated 8-word windows) are rejected. The others'
measures are put into quantile sketches, one per language, source and measure: a sketch maps a value's bucket to a
count. A value keeps its leading 8 bits, so a bucket is at most 1/128 of its value wide; sketches merge by adding counts, whatever
the order, so the quantiles are the same however the rows are dealt out. A cutoff is a fence: it lies as many times as the rule says beyond an outer quantile
of the sketch as that quantile lies from the median, and `spread` beyond it at least, since a measure may be nearly constant. The rates, of which most values are 0, have a high quantile for
that, the word length has the quartiles. Groups with fewer than `min_rows` documents take the merged sketch of
their language, and languages with fewer that of all documents. The cutoffs are joined to the measures, and documents beyond
one are rejected.

All of it is DataFrame functions. Repeated windows are found by sorting the 64-bit hashes of a document's own windows.

A very long text's words and window hashes are arrays of its own row.

Nulls: a null text has no words and fails the base rule; null languages and sources form groups of their own. Repeated rows count
each. An empty table gives an empty result. Columns of the input named like a measure are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.llm.common import BLANKS, let, stored, table, words

WINDOW = 8
#: measure: percent of the lower and of the upper quantile, multiple, spread. Values are in thousandths. None: no such cutoff.
RULES = {
    "word_length": (25, 75, 6, 600),
    "symbol_rate": (None, 90, 3, 100),
    "dup_line_rate": (None, 98, 3, 100),
    "repeat_rate": (None, 98, 3, 100),
}
MIN_ROWS, BITS = 50, 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _repeat_words(w: Column) -> Column:
    """Number of words in windows that are found twice or more, first ones included."""

    def covered(s: Column) -> Column:
        """s: (hash, place) of the windows, sorted."""
        at = F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]))
        own = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return let(F.sort_array(F.filter(at, lambda x: x.isNotNull())), own)

    def found(h: Column) -> Column:
        sort = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(sort, covered))

    def hashes(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(v) - WINDOW), lambda i: F.xxhash64(*[F.get(v, i + k) for k in range(WINDOW)]))

    return F.when(F.size(w) > WINDOW, let(F.transform(w, lambda x: F.xxhash64(x)), lambda v: let(hashes(v), found))).otherwise(F.lit(0))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the MEASURES."""
    t = F.coalesce(F.col(text), F.lit(""))
    of_words = let(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), _repeat_words(w).alias("r")))
    full = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    of_lines = let(full, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    symbols = F.octet_length(t) - F.octet_length(F.regexp_replace(t, "[#*$%&|<>]+", ""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES]
    d = docs.select(*kept, of_words.alias("_w"), of_lines.alias("_l"), symbols.alias("_s"))
    long = {"n_words": "_w.n", "word_chars": "_w.c", "n_symbols": "_s", "n_dup_lines": "_l.d", "n_repeat_words": "_w.r", "n_lines": "_l.n"}
    return d.select(*kept, *[F.col(v).cast("long").alias(k) for k, v in long.items()])


def _rates() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.lit(1000) * F.col(a) / F.col(b))).otherwise(F.lit(0)).cast("long")
    return {"word_length": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(v: Column) -> Column:
    """A value without what follows its leading BITS bits."""
    low = F.greatest(F.lit(0), F.length(F.bin(v)) - BITS).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n) of the documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _rates().items()]))
    return measured.where(~base_failed()).select("lang", "source", rates.alias("x")).groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The quantiles that the rules ask for and the median, of the sketches merged by `by`, as bucket values; a sketch holds some thousand buckets at most."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by, "measure")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    pick = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("all") * q, F.col("bucket")))
    level = lambda at: F.coalesce(*[F.when(F.col("measure") == k, F.lit(r[at])) for k, r in RULES.items()])
    return run.groupBy(*by, "measure").agg(F.first("all").alias("rows"), pick(level(0)).alias("lo"), pick(F.lit(50)).alias("mid"), pick(level(1)).alias("hi"))


def cutoffs(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(lang, source) and, for each measure, its lowest and highest value that passes."""
    q = ("rows", "lo", "mid", "hi")
    own, by_lang, every = (_quantiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    by_lang = by_lang.select(F.col("lang").alias("lang2"), F.col("measure").alias("m2"), F.struct(*q).alias("b"))
    every = every.select(F.col("measure").alias("m3"), F.struct(*q).alias("c"))
    x = own.select("lang", "source", "measure", F.struct(*q).alias("a"))
    x = x.join(by_lang, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("m2"))).join(F.broadcast(every), F.col("measure") == F.col("m3"))
    one = F.when(F.col("a.rows") >= min_rows, F.col("a")).when(F.col("b.rows") >= min_rows, F.col("b")).otherwise(F.col("c"))
    x = x.select("lang", "source", "measure", one.alias("q"))
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (a, _, times, spread) in RULES.items():
        here = F.col("measure") == k
        low = F.when(here, F.col("q.lo") - F.greatest(F.lit(spread), times * (F.col("q.mid") - F.col("q.lo")))).otherwise(low) if a is not None else low
        high = F.when(here, F.col("q.hi") + F.greatest(F.lit(spread), times * (F.col("q.hi") - F.col("q.mid")))).otherwise(high)
    x = x.select("lang", "source", "measure", low.alias("low"), high.alias("high"))
    pick = lambda k: F.max(F.when(F.col("measure") == k, F.struct("low", "high"))).alias(k)
    return x.groupBy("lang", "source").agg(*[pick(k) for k in RULES])


def judged(measured: DataFrame, min_rows: int = MIN_ROWS, salts: int = 16, broadcast_rows: int = 20_000) -> DataFrame:
    """measured, which must be stored, with base_failed and kept."""
    cuts = stored(cutoffs(sketches(measured), min_rows), "cutoffs").withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    if cuts.count() <= broadcast_rows:
        x = measured.join(F.broadcast(cuts), on, "left")
    else:  # too many groups to broadcast: a hot group's documents are dealt out by a salt
        salted = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        x = measured.withColumn("_own", F.pmod(F.xxhash64("n_words", "word_chars", "n_lines"), F.lit(salts)))
        x = x.join(salted, on & (F.col("_own") == F.col("_salt")), "left").drop("_own", "_salt")
    good = ~base_failed()
    for k, v in _rates().items():
        good = good & F.coalesce(v >= F.col(f"{k}.low"), F.lit(True)) & F.coalesce(v <= F.col(f"{k}.high"), F.lit(True))
    return x.withColumn("base_failed", base_failed()).withColumn("kept", good).drop("_lang", "_source", *RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    m = stored(measures(docs).drop("text"), "measures")
    return judged(m).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns that they came with."""
    kept = [c for c in docs.columns]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), "text", "lang", "source")
    passed = judged(stored(measures(own).drop("text"), "measures")).where("kept")
    return passed.select(*[F.col(f"d.`{c}`").alias(c) for c in kept])


_B = "{v} - {v} % (1::BIGINT << greatest(0, length(bin({v})) - 8)::INT)"
#: Number of rows, and the quantiles of a group, whose rows have one measure.
_Q = """count(*) AS n, quantile_disc(b, 0.5) AS mid, quantile_disc(b, 0.25) AS lo,
       CASE measure WHEN 'word_length' THEN quantile_disc(b, 0.75) WHEN 'symbol_rate' THEN quantile_disc(b, 0.9) ELSE quantile_disc(b, 0.98) END AS hi"""
OP3_SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, u.w, u.i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) AS u),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(array_agg(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), ' ') AS g,
               count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k FROM w),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win WHERE k = 8) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM t)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM t LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
r AS (SELECT *, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbol_rate,
             CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_line_rate, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeat_rate FROM m),
x AS (SELECT doc_id, lang, source, measure, v, {_B.format(v="v")} AS b FROM (UNPIVOT (SELECT doc_id, lang, source, word_length, symbol_rate, dup_line_rate, repeat_rate FROM r)
      ON word_length, symbol_rate, dup_line_rate, repeat_rate INTO NAME measure VALUE v)),
fine AS (SELECT doc_id FROM m WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)),
y AS (SELECT x.* FROM x SEMI JOIN fine USING (doc_id)),
q1 AS (SELECT lang, source, measure, {_Q} FROM y GROUP BY lang, source, measure),
q2 AS (SELECT lang, measure, {_Q} FROM y GROUP BY lang, measure),
q3 AS (SELECT measure, {_Q} FROM y GROUP BY measure),
c AS (SELECT q1.lang, q1.source, q1.measure, CASE WHEN q1.n >= 50 THEN q1.lo WHEN q2.n >= 50 THEN q2.lo ELSE q3.lo END AS lo, CASE WHEN q1.n >= 50 THEN q1.mid WHEN q2.n >= 50 THEN q2.mid ELSE q3.mid END AS mid,
             CASE WHEN q1.n >= 50 THEN q1.hi WHEN q2.n >= 50 THEN q2.hi ELSE q3.hi END AS hi
      FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.measure = q2.measure JOIN q3 ON q1.measure = q3.measure),
f AS (SELECT lang, source, measure, CASE WHEN measure = 'word_length' THEN lo - greatest(600, 6 * (mid - lo)) ELSE -1 END AS low,
             CASE WHEN measure = 'word_length' THEN hi + greatest(600, 6 * (hi - mid)) ELSE hi + greatest(100, 3 * (hi - mid)) END AS high FROM c),
v AS (SELECT doc_id, bool_and(x.v BETWEEN f.low AND f.high) AS ok FROM x JOIN f ON x.lang IS NOT DISTINCT FROM f.lang AND x.source IS NOT DISTINCT FROM f.source AND x.measure = f.measure GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       coalesce(ok, false) AND NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS kept
FROM m LEFT JOIN v USING (doc_id)
"""
