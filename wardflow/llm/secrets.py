"""Secrets in texts: fixed patterns, and strings whose characters are too evenly spread to be language.

The entropy rule slides a window over candidate strings, one rule per character class. A step takes the leaving character out of
the window's counts and adds the entering one; the counts are a string with a place for every character of the class, and the sum
of n * log2(n) over them changes by two terms, kept in millionths, so that no step depends on the ones before but for the
state. Windows whose entropy reaches the class's bound are merged into spans. Candidates that are as a whole words, numbers or UUIDs are
allowed, and no window reaches into a counting string, wherever it stands.

All of it is DataFrame functions. A pattern's places are prefix sums of the lengths of its matches and of the gaps between them; sums and
windows are folded a block at a time, so that the time grows with the text's length and the number of matches, and a text may have any number of them.

Nulls: a null text is empty and has no spans. Rows that repeat give equal results. Spans count in code points, end exclusive. An empty
table gives an empty result. Columns of the input named like the result's are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import let, table

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Class: its characters, window, and least entropy in bits.
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 20, 3.0),
    "entropy_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 24, 4.0),
}
KINDS = ("assign", "access", "hex", *CLASSES)
#: Candidates that are no secrets: words, numbers, UUIDs.
ALLOWED = r"^[A-Z]?[a-z]+$|^[A-Z]+$|^[0-9]+$|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Counting strings, all of COUNTED characters, which no window reaches into.
COUNTING, COUNTED = r"(?i)0123456789|abcdefghij", 10
#: Numbers summed, and characters scanned, in one fold.
BLOCK = 256


def _before(xs: Column) -> Column:
    """The sum of what stands before each number, by sums within blocks and over blocks."""
    kind = "struct<at:int,out:array<int>>"
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)

    def sums(values: Column, size) -> Column:
        return F.aggregate(values, none, lambda a, x: F.struct((a["at"] + size(x)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")).cast(kind))

    def of(blocks: Column) -> Column:
        own = lambda first: F.flatten(F.transform(blocks, lambda x, k: F.transform(x["out"], lambda v: v + F.get(first, k))))
        return let(sums(blocks, lambda x: x["at"])["out"], own)

    def cut(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: sums(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)), lambda x: x))

    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(cut(F.size(xs)), of))


def _places(text: Column, pattern: str) -> Column:
    """(s, e, m): where the pattern's matches in text start and end, and they themselves."""

    def run(gaps: Column, ms: Column) -> Column:
        steps = F.transform(ms, lambda m, k: F.char_length(F.get(gaps, k)) + F.char_length(m))

        def at(before: Column) -> Column:
            start = lambda k: F.get(before, k) + F.char_length(F.get(gaps, k))
            return F.transform(ms, lambda m, k: F.struct(start(k).alias("s"), (start(k) + F.char_length(m)).alias("e"), m.alias("m")))

        return let(steps, lambda x: let(_before(x), at))

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda ms: F.when(F.size(ms) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda gaps: run(gaps, ms))))


SPANS = "array<struct<s:int,e:int>>"


def _windows(m: Column, chars: str, window: int, bits: float) -> Column:
    """Spans (s, e) of a short string's windows that reach the entropy."""
    weight = [round(1e6 * n * math.log2(n)) if n else 0 for n in range(window + 1)]
    most = math.floor(1e6 * window * (math.log2(window) - bits))
    f = F.array(*[F.lit(x) for x in weight])
    place = lambda k: F.call_function("instr", F.lit(chars), F.call_function("substring", m, k + 1, F.lit(1)))
    count = lambda c, p: F.ascii(F.call_function("substring", c, p, F.lit(1))) - 65

    def change(state: Column, p: Column, by: int) -> Column:
        """The counts (a letter each, A for 0) and the sum, with the character at place p `by` times more."""
        return let(count(state["c"], p), lambda n: F.struct(F.overlay(state["c"], F.char(n + 65 + by), p, F.lit(1)).alias("c"), (state["sum"] + F.get(f, n + by) - F.get(f, n)).alias("sum")))

    kind = f"struct<c:string,sum:int,out:{SPANS}>"
    start = F.struct(F.lit("A" * len(chars)).alias("c"), F.lit(0).alias("sum"), F.array().cast(SPANS).alias("out")).cast(kind)

    def step(a: Column, k: Column) -> Column:
        left = F.when(k >= window, change(a, place(k - window), -1)).otherwise(F.struct(a["c"].alias("c"), a["sum"].alias("sum")))
        now = let(left, lambda x: change(x, place(k), 1))

        def spans(x: Column) -> Column:
            last, s = F.element_at(a["out"], -1), k - window + 1
            grown = F.when(F.size(a["out"]) == 0, F.array(F.struct(s.alias("s"), (k + 1).alias("e"))))
            grown = grown.when(last["e"] >= s, F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(last["s"].alias("s"), (k + 1).alias("e")))))
            return F.when((k >= window - 1) & (x["sum"] <= most), grown.otherwise(F.concat(a["out"], F.array(F.struct(s.alias("s"), (k + 1).alias("e")))))).otherwise(a["out"])

        return let(now, lambda x: F.struct(x["c"].alias("c"), x["sum"].alias("sum"), spans(x).alias("out")).cast(kind))

    return F.aggregate(F.sequence(F.lit(0), F.char_length(m) - 1), start, step)["out"]


def _merged(spans: Column) -> Column:
    """Spans, in order of starts and of ends, that overlap or touch as one."""

    def of(x: Column) -> Column:
        firsts = F.filter(F.transform(x, lambda y, k: F.when((k == 0) | (y["s"] > F.get(x, k - 1)["e"]), y["s"])), lambda s: s.isNotNull())
        lasts = F.filter(F.transform(x, lambda y, k: F.when((k == F.size(x) - 1) | (F.get(x, k + 1)["s"] > y["e"]), y["e"])), lambda e: e.isNotNull())
        return F.zip_with(firsts, lasts, lambda s, e: F.struct(s.alias("s"), e.alias("e")))

    return let(spans, lambda x: F.when(F.size(x) == 0, x).otherwise(of(x)))


def _spread(m: Column, chars: str, window: int, bits: float) -> Column:
    """Spans (s, e) within a candidate whose windows reach the entropy and no counting string. Blocks of characters are scanned each with the window's length from the next."""

    def scanned(x: Column) -> Column:
        def joined(blocks: Column) -> Column:
            own = lambda b, k: F.concat(b, F.coalesce(F.call_function("substring", F.get(blocks, k + 1), F.lit(1), F.lit(window - 1)), F.lit("")))
            at = lambda b, k: F.transform(_windows(own(b, k), chars, window, bits), lambda y: F.struct((y["s"] + k * BLOCK).alias("s"), (y["e"] + k * BLOCK).alias("e")).cast("struct<s:int,e:int>"))
            return _merged(F.flatten(F.transform(blocks, at)))

        return F.when(F.char_length(x) < window, F.array().cast(SPANS)).otherwise(let(F.regexp_extract_all(x, F.lit(f".{{1,{BLOCK}}}"), F.lit(0)), joined))

    def of(parts: Column) -> Column:
        first = _before(F.transform(parts, lambda x: F.char_length(x) + COUNTED))
        moved = lambda b: F.flatten(F.transform(parts, lambda x, k: F.transform(scanned(x), lambda y: F.struct((y["s"] + F.get(b, k)).alias("s"), (y["e"] + F.get(b, k)).alias("e")))))
        return let(first, moved)

    return F.when(m.rlike(COUNTING), let(F.split(m, COUNTING, -1), of)).otherwise(scanned(m))


def scan(docs: DataFrame, text: str = "text", allowed: str = ALLOWED) -> DataFrame:
    """docs with `found`: an array of (start, kind, end), sorted, kind an index of KINDS."""
    t = F.coalesce(F.col(text), F.lit(""))
    span = lambda s, kind, e: F.struct(s.cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end"))
    # A match holds all that its value's match needs, so the value is found in it anew.
    value = lambda x: F.regexp_extract(x["m"], ASSIGN, 2)
    assigned = F.transform(F.filter(_places(t, ASSIGN), lambda x: F.char_length(value(x)) >= 6), lambda x: span(x["s"], 0, x["e"]))
    parts = [assigned]

    def fixed(k: int, pattern: str) -> Column:
        return F.transform(_places(t, pattern), lambda x: span(x["s"], k, x["e"]))

    def uneven(k: int, chars: str, window: int, bits: float) -> Column:
        pattern = f"[{chars.replace('-', '')}{'-' * ('-' in chars)}]{{{window},}}+"
        candidates = F.filter(_places(t, pattern), lambda x: ~x["m"].rlike(allowed))
        return F.flatten(F.transform(candidates, lambda x: F.transform(_spread(x["m"], chars, window, bits), lambda y: span(x["s"] + y["s"], k, x["s"] + y["e"]))))

    parts += [fixed(1, ACCESS), fixed(2, HEX)]
    parts += [uneven(k, *rule) for k, rule in enumerate(CLASSES.values(), 3)]
    return docs.drop("found").withColumn("found", F.sort_array(F.concat(*parts)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    name = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    number = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return d.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
