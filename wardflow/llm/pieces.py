"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into words that no piece crosses (a run of blanks with the letters or the signs that follow it; digits and line feeds by themselves); a blank stands
before the first, as the model wants it. Each word is encoded once for the whole corpus: its substrings up to the longest piece's length are
exploded, equi-joined to the piece table (of the model's size, so broadcast), grouped by word into the lattice's edges, and folded
by a higher-order aggregate. For a unigram model the fold is Viterbi's: the edges come in order of their ends, the state keeps
the last edge of the best path to each position, and an edge replaces the one to its end if its path scores more (ties: the longer last
piece); pieces that shorter ones always beat are not tried. A BPE model's scores are the ranks of its merges, and its encoding is not their best path; there the fold merges:
the state is the word's cuts, the edges come in order of their ranks (ties: the leftmost first), and an edge that spans two neighbouring parts takes
out the cut between them. Words of over LONG characters, of which the state would need more bits than a number has, are merged with a heap
instead, with the same result. Characters without a piece are byte pieces (in Viterbi at 10 less than the least score).

Words that are frequent in a small sample, of a bounded number, are encoded first and known to all tasks. A first pass over the documents numbers each task's
words as they appear and writes, to the shared folder, the documents as numbers and behind them the task's other distinct words, which go through the lattice once for
the whole corpus; their ids come back to a dictionary for each of the first pass's tasks. The second pass reads the numbers, of which a file holds those of one such task, and gathers the
ids. So neither pass depends on how the other's input is split, and executors may come or go between them. A dictionary is as large as a task's words at most.

Decoding joins the pieces' bytes and takes off the first blank; it gives back every text exactly.

Nulls: a null text is encoded as null pieces, an empty one as no pieces. Repeated rows are each returned. In a unigram model a word of many thousand
letters makes its fold slow, not wrong. An empty table gives an empty result. Other columns pass through; those named like the result's are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardflow.llm.common import fresh_path, let, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: What no piece crosses: Latin letters and other ASCII characters part, a digit and a line feed stand alone, and blanks go with what follows them. A run with any further
#: character goes to its end in one word.
WORDS = re.compile(r" *+(?:[A-Za-z\u00c0-\u024f]++(?![^\x00-\x7f])|[^A-Za-z0-9 \n\x80-\U0010ffff]++(?![^\x00-\x7f])|[^ \n0-9]++)|[\n0-9]| +")
UNKNOWN, LONG, HEAD = 10.0, 62, 3
#: Words that every task knows from a sample, at most, and how many documents a sample is expected to hold.
COMMON, SAMPLE = 1 << 18, 16_000
#: Tasks that write a split's dictionary.
SALTS = 4
#: Bits of an edge's start, length and id; NONE: the rank of what merges nothing.
S_BITS, N_BITS, ID_BITS = 6, 5, 21
NONE = (1 << ID_BITS) - 1


def pieces(path: str = MODEL) -> list[tuple[str, int, float]]:
    """(piece, id, score) of a model's ordinary pieces, blanks as blanks. No piece may cross words: any two characters that stand side by side in one do so within a word."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [(m.id_to_piece(i).replace("▁", " "), i, m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i) or m.is_unused(i))]
    if any(len(WORDS.findall(two)) > 1 for two in {p[k : k + 2] for p, _, _ in out for k in range(len(p) - 1)}):
        raise ValueError("the model has pieces that cross words")
    return out


def is_bpe(path: str = MODEL) -> bool:
    """Whether the model's kind (field 3 of its trainer's settings, field 2 of the file) is BPE; 1, unigram, is the default."""
    with open(path, "rb") as f:
        raw = f.read()

    def varint(i: int) -> tuple[int, int]:
        v = shift = 0
        while True:
            v |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return v, i

    def find(field: int, at: int, end: int) -> tuple[int, int] | None:
        while at < end:
            tag, at = varint(at)
            value = at
            if tag & 7 == 2:
                size, value = varint(at)
                at = value + size
            else:
                at = varint(at)[1] if tag & 7 == 0 else at + (4 if tag & 7 == 5 else 8)
            if tag >> 3 == field:
                return value, at
        return None

    spec = find(2, 0, len(raw))
    kind = find(3, *spec) if spec else None
    return kind is not None and varint(kind[0])[0] == 2


def byte_ids(path: str = MODEL) -> list[int]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def words_of(text: str) -> list[str]:
    return WORDS.findall(" " + text) if text else []


# ---- the lattice ----


def late_pieces(ranks: dict[str, int]) -> set[str]:
    """Pieces that some two parts make of which one comes later in the order of merges than the piece: only these can become due after their turn."""
    comes = lambda x: -1 if len(x) == 1 else ranks.get(x, -1)
    known = lambda x: len(x) == 1 or x in ranks
    return {p for p, r in ranks.items() if any(known(p[:k]) and known(p[k:]) and max(comes(p[:k]), comes(p[k:])) > r for k in range(1, len(p)))}


def on_best_paths(ps: list[tuple[str, int, float]]) -> list[tuple[str, int, float]]:
    """The pieces that a best path may hold: not those which shorter ones make up with a higher score (by more than what rounding takes from sums over words of up to some 100,000 characters)."""
    score, least = {p: s for p, _, s in ps}, 1e-6 * max(abs(s) for _, _, s in ps)

    def parts(p: str) -> float:
        best = [0.0]
        for e in range(1, len(p) + 1):
            best.append(max((best[s] + score[p[s:e]] for s in range(e) if e - s < len(p) and p[s:e] in score), default=-math.inf))
        return best[-1]

    return [x for x in ps if parts(x[0]) <= x[2] + least]


def encode_words(words: DataFrame, path: str = MODEL, short_only: bool = False, bpe: bool | None = None) -> DataFrame:
    """words (w, and other columns; each w once) with ids. short_only: there are no words of over LONG characters. bpe: whether to merge (else the best path is taken); None: as the model's kind asks."""
    spark = words.sparkSession
    ps, bpe = pieces(path), is_bpe(path) if bpe is None else bpe
    longest, least = max(len(p) for p, _, _ in ps), min(s for _, _, s in ps)
    ps = ps if bpe else on_best_paths(ps)
    ranks = {p: k for k, (p, _, _) in enumerate(sorted(ps, key=lambda x: (-x[2], x[1])))}
    late = late_pieces(ranks) if bpe else set()
    piece = F.broadcast(spark.createDataFrame([(*x, ranks[x[0]], int(x[0] in late)) for x in ps], "part string, id int, score double, rank int, late int"))
    others = [c for c in words.columns if c != "w"]
    n = F.char_length("w")
    short = words.where((n > 0) & (n <= LONG)) if bpe else words.where(n > 0)
    one = short.select("w", F.struct(*others).alias("o") if others else F.lit(True).alias("o"), F.explode(F.sequence(F.lit(1), n)).alias("s"))
    # Only lengths that some piece with the same first HEAD characters has are tried; what the word carries goes with its first position only.
    heads: dict[str, set[int]] = {}
    for text, _, _ in ps:
        if len(text) >= HEAD:
            heads.setdefault(text[:HEAD], set()).add(len(text))
    head = F.broadcast(spark.createDataFrame([(k, sorted(v)) for k, v in heads.items()], "head string, sizes array<int>"))
    one = one.select("w", F.when(F.col("s") == 1, F.col("o")).alias("o"), "s", F.substring("w", F.col("s"), F.lit(HEAD)).alias("head")).join(head, "head", "left")
    one = one.select("w", "o", "s", F.explode(F.concat(F.sequence(F.lit(1), F.lit(HEAD - 1)), F.coalesce("sizes", F.array().cast("array<int>")))).alias("n")).where(F.col("n") <= n - F.col("s") + 1)
    one = one.select("w", F.when(F.col("n") == 1, F.col("o")).alias("o"), "s", "n", F.substring("w", F.col("s"), F.col("n")).alias("part"))
    own = one.join(piece, "part", "left").where("id is not null or n = 1")
    o = F.first("o", ignorenulls=True).alias("o")
    carried = [F.col(f"o.`{c}`").alias(c) for c in others]
    if not bpe:
        # In order of ends, then starts. A character without a piece has its place, less than 0, for an id.
        edge = F.struct((F.col("s") + F.col("n") - 1).alias("e"), (F.col("s") - 1).alias("s"), F.coalesce("id", -F.col("s")).alias("id"), F.coalesce("score", F.lit(least - UNKNOWN)).alias("score"))
        edges = own.groupBy("w").agg(F.sort_array(F.collect_list(edge)).alias("edges"), o)
        return edges.select("w", *carried, best_path("edges", "w", path).alias("ids"))
    if longest >= 1 << N_BITS or len(ps) >= NONE or max(i for _, i, _ in ps) > NONE or min(i for _, i, _ in ps) < 1:
        raise ValueError("the model's pieces are too many or too long, or one has the id 0")
    # One number for an edge, in the order of merges: rank, start, length, id (0: a character without a piece), whether it may become due late. Single characters merge nothing and come last.
    rank = F.when(F.col("n") == 1, F.lit(NONE)).otherwise(F.col("rank")).cast("long")
    edge = ((rank * (1 << S_BITS) + F.col("s") - 1) * (1 << N_BITS) + F.col("n")) * (1 << ID_BITS) + F.coalesce("id", F.lit(0))
    edge = edge * 2 + F.when(F.col("n") == 1, 0).otherwise(F.col("late"))
    edges = own.groupBy("w").agg(F.sort_array(F.collect_list(edge)).alias("edges"), o)
    done = edges.select("w", *carried, merged("edges", "w", path).alias("ids"))
    kinds = "".join(f", `{c}` {words.schema[c].dataType.simpleString()}" for c in others)
    return done if short_only else done.unionByName(words.where(n > LONG).select("w", *others).mapInArrow(_long_words(path), f"w string{kinds}, ids array<int>"))


def _bytes(part: Column, path: str) -> Column:
    """The byte pieces of a character."""
    raw, ids = F.hex(part.cast("binary")), F.array(*[F.lit(i) for i in byte_ids(path)])
    return F.transform(F.sequence(F.lit(0), F.octet_length(part) - 1), lambda k: F.get(ids, F.conv(F.call_function("substring", raw, 2 * k + 1, F.lit(2)), 16, 10).cast("int")))


def merged(edges: str, word: str, path: str = MODEL) -> Column:
    """The ids of a BPE model. The state: the places between the word's parts as bits of a number.

    The edges are folded once in the order of merges: one that spans two neighbouring parts takes out the cut between them. That is all unless an edge becomes due
    after its turn, which only late pieces can. Each merge looks for one of these; where it finds one, the word is marked (by the number's
    highest bit) and merged step by step instead, each step looking for the first edge that is due."""
    shift = lambda x, by: F.call_function("shiftright", x, F.lit(by))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    mask = lambda x, bits: x.bitwiseAND(F.lit((1 << bits) - 1))
    again = F.lit(-(1 << 63)).cast("long")

    def spread(x: Column) -> Column:
        """An edge's ends and what lies between them as bits, its start with its id, and its turn."""
        s = mask(shift(x, 1 + ID_BITS + N_BITS), S_BITS).cast("int")
        k = mask(shift(x, 1 + ID_BITS), N_BITS).cast("int")
        at = lambda bits: F.call_function("shiftleft", bits, s)
        whole = s.cast("long") * (1 << ID_BITS) + mask(shift(x, 1), ID_BITS)
        return F.struct(at(bit(k) + 1).alias("ends"), at(bit(k) - 2).alias("mid"), whole.alias("whole"), x.alias("turn"))

    def due(x: Column, cuts: Column) -> Column:
        return (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["mid"])) == 1)

    n = F.char_length(word)

    def once(wide: Column, start: Column) -> Column:
        def fold(late: Column) -> Column:
            def merge(x: Column, cuts: Column) -> Column:
                return F.when(F.exists(late, lambda y: (y["turn"] < x["turn"]) & due(y, cuts)), cuts.bitwiseOR(again)).otherwise(cuts)

            return F.aggregate(wide, start, lambda c, x: F.when(due(x, c), let(c.bitwiseAND(F.bitwise_not(x["mid"])), lambda cuts: merge(x, cuts))).otherwise(c))

        return let(F.filter(wide, lambda x: mask(x["turn"], 1) == 1), fold)

    def by_steps(wide: Column, start: Column) -> Column:
        def step(cuts: Column) -> Column:
            return F.coalesce(cuts.bitwiseAND(F.bitwise_not(F.get(F.filter(wide, lambda x: due(x, cuts)), F.lit(0))["mid"])), cuts)

        return F.aggregate(F.sequence(F.lit(1), F.least(n - 1, F.size(wide))), start, lambda c, _: step(c))

    def of(every: Column) -> Column:
        start = bit(n + 1) - 1
        found = let(F.filter(every, lambda x: x["mid"] != 0), lambda wide: let(once(wide, start), lambda c: F.when(c < 0, by_steps(wide, start)).otherwise(c)))
        return let(found, lambda c: parts(every, c))

    def parts(every: Column, cuts: Column) -> Column:
        """The edges from cut to cut, in order of place."""
        own = F.filter(every, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (cuts.bitwiseAND(x["mid"]) == 0))
        return let(F.sort_array(F.transform(own, lambda x: x["whole"])), lambda x: F.when(F.exists(x, lambda v: mask(v, ID_BITS) == 0), with_bytes(x)).otherwise(F.transform(x, lambda v: mask(v, ID_BITS).cast("int"))))

    def with_bytes(x: Column) -> Column:
        part = lambda v: F.call_function("substring", F.col(word), (shift(v, ID_BITS) + 1).cast("int"), F.lit(1))
        return F.flatten(F.transform(x, lambda v: F.when(mask(v, ID_BITS) == 0, _bytes(part(v), path)).otherwise(F.array(mask(v, ID_BITS).cast("int")))))

    return let(F.transform(edges, spread), of)


def heap_merge(word: str, table: dict[str, tuple[int, float]], own_bytes: list[int]) -> list[int]:
    """A BPE model's ids of one word, in time n log n."""
    part, left, right = list(word), [i - 1 for i in range(len(word))], [i + 1 for i in range(len(word))]
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < len(word) and (got := table.get(both := part[i] + part[j])):
            heapq.heappush(heap, (-got[1], i, j, both))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if part[i] + part[j] != both or right[i] != j or not part[i] or not part[j]:
            continue
        part[i], part[j], right[i] = both, "", right[j]
        if right[j] < len(word):
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [i for p in part if p for i in ([table[p][0]] if p in table else [own_bytes[b] for b in p.encode("utf-8", "surrogatepass")])]


def _long_words(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = {p: (i, s) for p, i, s in pieces(path)}, byte_ids(path)
        for b in batches:
            ids = [heap_merge(w, table, own) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names, "ids"])

    return run


def best_path(edges: str, word: str, path: str = MODEL) -> Column:
    """The ids of the best path. The state: the last edge of the best path to where the edges have come, with that path's score, and the same of all positions before; from these the path is read backwards.

    Only the start is cast: a cast in the fold would copy all positions at each edge."""
    last = "struct<e:int,s:int,id:int,score:double>"
    none = F.struct(F.lit(0).alias("e"), F.lit(-1).alias("s"), F.lit(0).alias("id"), F.lit(0.0).alias("score"))
    start = F.struct(none.alias("best"), F.array().cast(f"array<{last}>").alias("before")).cast(f"struct<best:{last},before:array<{last}>>")

    def step(a: Column, x: Column) -> Column:
        best = a["best"]
        earlier = F.get(a["before"], x["s"])["score"] + x["score"]
        state = lambda score, before: F.struct(F.struct(x["e"].alias("e"), x["s"].alias("s"), x["id"].alias("id"), score.alias("score")).alias("best"), before.alias("before"))
        on = state(F.when(x["s"] == best["e"], best["score"] + x["score"]).otherwise(earlier), F.concat(a["before"], F.array(best)))
        return F.when(x["e"] > best["e"], on).when(earlier > best["score"], state(earlier, a["before"])).otherwise(a)

    def back(a: Column) -> Column:
        """The ids from the end on, each edge's start being the end of the one before."""
        own = F.struct(a["best"]["s"].alias("at"), F.array(a["best"]["id"]).alias("ids")).cast("struct<at:int,ids:array<int>>")
        return F.aggregate(F.reverse(a["before"]), own, lambda p, x: F.when((x["e"] == p["at"]) & (x["e"] > 0), F.struct(x["s"].alias("at"), F.concat(F.array(x["id"]), p["ids"]).alias("ids"))).otherwise(p))["ids"]

    def with_bytes(ids: Column) -> Column:
        own = F.flatten(F.transform(ids, lambda i: F.when(i < 0, _bytes(F.call_function("substring", F.col(word), -i, F.lit(1)), path)).otherwise(F.array(i))))
        return F.when(F.exists(ids, lambda i: i < 0), own).otherwise(ids)

    return let(let(F.aggregate(edges, start, step), back), with_bytes)


# ---- documents ----


def common_words(docs: DataFrame, text: str, most: int, path: str, bpe: bool) -> dict[str, bytes]:
    """Encoded words that are frequent in a sample of documents, COMMON at most, the most frequent first: these have the numbers whose upper bytes are zero, which compress to less. They spare what
    all splits would ask for; the result is the same whichever they are."""
    part = docs.sample(min(1.0, SAMPLE / max(1, docs.count())), seed=1).select(F.col(f"`{text}`").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                found = [w for w in WORDS.findall(" " + (t.as_py() or " ")) if len(w) <= most]
                for a in range(0, len(found), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(found[a : a + 50_000], pa.string())], ["w"])

    top = part.mapInArrow(each, "w string").groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(COMMON).repartition(16)
    found = [(-r["n"], r["w"], np.array(r["ids"], "<i4").tobytes()) for r in encode_words(top, path, short_only=bpe, bpe=bpe).toLocalIterator()]
    return {w: ids for _, w, ids in sorted(found)}


class _Numbers(dict):
    """Words and their numbers; a word that is new has the next one."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all their lowest bytes first, then the next ones: they compress to less."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _numbered(common):
    """Texts as their words' numbers, and at a task's end its words that aren't common with their numbers. common: the common words, which have the first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, known = TaskContext.get().partitionId(), _Numbers(common.value)
        shared = len(known)
        kind = None
        for b in batches:
            kind = b.schema.field("d").type
            a = 0
            while a < b.num_rows:  # some MB at a time
                said, held, z = [], 0, a
                while z < b.num_rows and held < 4 << 20:
                    t = b.column(0)[z].as_py()
                    said.append(None if t is None else _planes(np.fromiter(map(known.__getitem__, WORDS.findall(" " + t)), "<i4")) if t else b"")
                    held, z = held + len(said[-1] or b""), z + 1
                none = [pa.nulls(z - a, x) for x in (pa.list_(pa.string()), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([split] * (z - a), pa.int32()), *none, pa.array(said, pa.binary()), b.column(1).slice(a, z - a)], ["split", "new", "first", "words", "d"])
                a = z
        new = list(known)[shared:]
        for a in range(0, len(new), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([split], pa.int32()), pa.array([new[a : a + 10_000]], pa.list_(pa.string())), pa.array([shared + a], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, kind)], ["split", "new", "first", "words", "d"])

    return run


class _Dictionary:
    """The ids of words by number: the common ones', then those of a split."""

    def __init__(self, path: str, split: int, common: list[bytes], width: int):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyarrow import fs

        sizes, flats, ks = [np.array([len(x) // 4 for x in common], np.int64)], [np.frombuffer(b"".join(common), "<i4")], [np.arange(len(common))]
        disk, root = fs.FileSystem.from_uri(path)
        for f in disk.get_file_info(fs.FileSelector(f"{root}/split={split}", allow_not_found=True)):
            if f.base_name.endswith(".parquet"):
                with pq.ParquetFile(f.path, filesystem=disk) as p:
                    for b in p.iter_batches(100_000, columns=["k", "ids"]):
                        ks.append(b.column(0).to_numpy())
                        flats.append(np.frombuffer(b"".join(b.column(1).to_pylist()), f">u{width}").astype("<i4"))
                        sizes.append(pc.binary_length(b.column(1)).to_numpy().astype(np.int64) // width)
        k, size = np.concatenate(ks), np.concatenate(sizes)
        self.flat = np.concatenate(flats)
        self.begin, self.size = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        self.begin[k], self.size[k] = np.cumsum(size) - size, size

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids, one after the other, and each word's number of them."""
        n = self.size[numbers]
        return self.flat[np.arange(int(n.sum())) + np.repeat(self.begin[numbers] - (np.cumsum(n) - n), n)], n


def _packed(ids: str, width: int) -> Column:
    """ids as bytes, `width` for each, the highest first."""
    return F.unhex(F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 2 * width, "0")), ""))


def _looked_up(path: str, model: str, common, digests: bool, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, None
        own = decoder(model) if digests else None
        for b in batches:
            split, raw = b.column(0).to_numpy(), b.column(1)
            a = 0
            while a < b.num_rows:  # rows of one split, some MB at a time
                z, held, rows = a, 0, []
                while z < b.num_rows and split[z] == split[a] and held < 1 << 20:
                    rows.append(raw[z].as_py())
                    held, z = held + len(rows[-1] or b""), z + 1
                if split[a] != at:
                    known = None  # two need not be held at once
                    at, known = split[a], _Dictionary(path, int(split[a]), common.value, width)
                ids, n = known.ids(np.concatenate([_from_planes(x or b"") for x in rows]))
                words = np.cumsum([0, *(len(x or b"") // 4 for x in rows)])
                ends = np.r_[0, np.cumsum(n)][words]
                mask = pa.array([x is None for x in rows])
                out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids), mask=mask)
                more = []
                if own:
                    said = [_digest(own(ids[i:j])) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                    more = [pa.array(np.diff(ends), pa.int64()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(2).slice(a, z - a), out, *more], ["d", "ids", *["n_pieces", "decoded_sha256"][: len(more)]])
                a = z

    return run


def encode(docs: DataFrame, path: str = MODEL, text: str = "text", digests: bool = False, bpe: bool | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with ids, and with digests also n_pieces and decoded_sha256, of the text that the ids decode to (null: of an empty one). bpe: as in encode_words."""
    spark = docs.sparkSession
    bpe = is_bpe(path) if bpe is None else bpe
    others = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", *["n_pieces", "decoded_sha256"][: 2 * digests])]
    common = common_words(docs, text, LONG if bpe else 1 << 30, path, bpe)
    numbers, values = (spark.sparkContext.broadcast(x) for x in ({w: k for k, w in enumerate(common)}, list(common.values())))
    own = docs.select(F.col(f"`{text}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("d"))
    d = T.StructField("d", own.schema["d"].dataType)
    passed = own.mapInArrow(_numbered(numbers), T.StructType([T.StructField("split", T.IntegerType()), T.StructField("new", T.ArrayType(T.StringType())), T.StructField("first", T.IntegerType()), T.StructField("words", T.BinaryType()), d]))
    passed = stored(passed, "pieces-words", "zstd")
    asked = passed.where("first is not null").select("split", "first", F.posexplode("new").alias("pos", "w")).select("w", "split", (F.col("first") + F.col("pos")).alias("k"))
    # Many partitions, so that a word's edges are grouped in memory.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    long = F.char_length("w") > LONG
    words = (asked.where(~long) if bpe else asked).repartition(parts, "w").groupBy("w").agg(F.collect_list(F.struct("split", "k")).alias("to"))
    width = 2 if max(i for _, i, _ in pieces(path)) < 1 << 16 else 4
    found = encode_words(words, path, short_only=bpe, bpe=bpe).select(_packed("ids", width).alias("ids"), F.inline("to"))
    if bpe:
        found = found.unionByName(asked.where(long).mapInArrow(_long_words(path), "w string, split int, k int, ids array<int>").select(_packed("ids", width).alias("ids"), "split", "k"))
    at = fresh_path(spark, "pieces")
    found.repartition("split", F.pmod("k", F.lit(SALTS))).sortWithinPartitions("split").write.option("compression", "zstd").partitionBy("split").parquet(at)
    new = [("ids", T.ArrayType(T.IntegerType())), *[("n_pieces", T.LongType()), ("decoded_sha256", T.StringType())][: 2 * digests]]
    out = passed.where("first is null").select("split", "words", "d").mapInArrow(_looked_up(at, path, values, digests, width), T.StructType([d, *(T.StructField(k, t) for k, t in new)]))
    return out.select(*[F.col(f"d.`{c}`").alias(c) for c in others], *(k for k, _ in new))


def decoder(path: str = MODEL):
    """ids (an array) to UTF-8 bytes: pieces' bytes are gathered from one table."""
    got = {i: p.encode() for p, i, _ in pieces(path)} | {i: bytes([b]) for b, i in enumerate(byte_ids(path))}
    size = np.zeros(max(got) + 1, np.int64)
    size[list(got)] = [len(v) for v in got.values()]
    begin = np.zeros(len(size), np.int64)
    begin[list(got)] = np.cumsum([len(v) for v in got.values()]) - [len(v) for v in got.values()]
    table = np.frombuffer(b"".join(got.values()), np.uint8)

    def decode(ids: np.ndarray) -> bytes:
        n = size[ids]
        at = np.arange(int(n.sum())) + np.repeat(begin[ids] - (np.cumsum(n) - n), n)
        return table[at[1:]].tobytes()  # less the first blank

    return decode


def _digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with `decoded` in place of a column of that name."""
    others = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for b in batches:
            said = [own(x.values.to_numpy()).decode("utf-8", "surrogatepass") if x.is_valid else None for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.string())], [*b.schema.names, "decoded"])

    schema = T.StructType([*(encoded.schema[c] for c in others), T.StructField("decoded", T.StringType())])
    return encoded.select(*[F.col(f"`{c}`") for c in others]).mapInArrow(run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True, keep=["doc_id"])


def lattice_best_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents by the best path through the lattice, as if the model's scores were a unigram model's."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True, bpe=False, keep=["doc_id"])


def with_digests(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with n_pieces, and decoded_sha256 of the text that its ids decode to (null: of an empty one)."""
    names = [c for c in encoded.columns if c not in ("n_pieces", "decoded_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = decoder(path)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            n, digests = [], []
            for x in ids:
                got = x.values.to_numpy() if x.is_valid else np.empty(0, np.int32)
                n.append(len(got))
                digests.append(_digest(own(got)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(digests)], [*b.schema.names, "n_pieces", "decoded_sha256"])

    schema = T.StructType([*(encoded.schema[c] for c in names), T.StructField("n_pieces", T.LongType()), T.StructField("decoded_sha256", T.StringType())])
    return encoded.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
