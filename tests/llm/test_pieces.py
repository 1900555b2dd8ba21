import functools
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from wardflow.llm import pieces as P

LONGEST = 16


@functools.cache
def model():
    ps = P.pieces()
    return {p: (i, s) for p, i, s in ps}, min(s for _, _, s in ps), P.byte_ids()


def viterbi(word):
    table, least, own = model()
    best = [(0.0, [])] + [None] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - LONGEST), e):
            part = word[s:e]
            if part in table:
                i, score = table[part]
                ids = [i]
            elif e - s == 1:
                ids, score = [own[b] for b in part.encode()], least - P.UNKNOWN
            else:
                continue
            if best[e] is None or best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, best[s][1] + ids)
    return best[-1][1]


@functools.cache
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def brute(text):
    """The library's ids, but that a literal ▁ is bytes here and not a blank."""
    return [i for k, part in enumerate(text.split("▁")) for i in (P.byte_ids()[226], P.byte_ids()[150], P.byte_ids()[129])[: 3 * (k > 0)] + tuple(library().encode(part)[:] if not k else heap(part))]


def heap(part):
    table, _, own = model()
    return [i for w in P.WORDS.findall(part) for i in P.heap_merge(w, table, own)]


TEXTS = ["Hello  world\n\tx é😀 </s> <0x0A>", "", None, "   ", "\n\n", "a▁b", "thorreou " * 50, "Über die Größe\r\n  von", "x" * 700, "ab" * 3000 + " end", "ﬁ Å \x00 日本語テキスト", "Hello  world\n\tx é😀 </s> <0x0A>"]


def test_whole_texts_are_brute_force_and_round_trip(spark):
    rng = random.Random(6)
    extra = ["".join(rng.choices("the tion\n aeiou éüß.,;!? 0123XYZ", k=rng.randint(1, 200))) for _ in range(60)]
    rows = [(i, t, i) for i, t in enumerate(TEXTS + extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = P.decode(P.encode(df)).collect()
    assert len(got) == len(rows)
    by = dict((r[0], r[1]) for r in rows)
    for r in got:
        t = by[r["doc_id"]]
        assert r["ids"] == (None if t is None else brute(t)), t
        assert r["decoded"] == t


def fields(raw, at, end):
    """(number, place of the value, end) of a message's fields."""

    def varint(i):
        v = shift = 0
        while True:
            v |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return v, i

    while at < end:
        tag, at = varint(at)
        size = 4 if tag & 7 == 5 else 8
        if tag & 7 == 2:
            size, at = varint(at)
        yield tag >> 3, at, (stop := varint(at)[1] if tag & 7 == 0 else at + size)
        at = stop


def test_viterbi_is_the_library_s_for_such_scores(spark, tmp_path):
    """The model file, marked as one of the unigram kind, encodes words as the lattice does."""
    import sentencepiece

    raw = bytearray(open(P.MODEL, "rb").read())
    spec = next((a, b) for k, a, b in fields(raw, 0, len(raw)) if k == 2)
    kind = next(a for k, a, b in fields(raw, *spec) if k == 3)
    assert raw[kind] == 2  # BPE
    raw[kind] = 1
    (tmp_path / "m").write_bytes(raw)
    m = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    rng = random.Random(3)
    words = ["tokenization", "thorreou", "Größe", "international", "xyzzy", "aaaa", "日本語", "😀"] + ["".join(rng.choices(["th", "e", "ing", "ou", "r", "st", "a", "tion", "É"], k=5)) for _ in range(300)]
    score = lambda ids: sum(m.get_score(i) for i in ids)
    ours = [viterbi(" " + w) for w in words]
    assert sum(m.encode(w) == x for w, x in zip(words, ours)) > 0.98 * len(words)
    assert all(score(x) >= score(m.encode(w)) for w, x in zip(words, ours) if 0 not in m.encode(w))
    assert P.is_bpe() and not P.is_bpe(str(tmp_path / "m"))
    # The lattice of such a model is folded by Viterbi.
    got = P.encode_words(spark.createDataFrame([(" " + w,) for w in dict.fromkeys(words)], "w string"), str(tmp_path / "m"))
    assert {r["w"]: r["ids"] for r in got.collect()} == {" " + w: x for w, x in zip(words, ours)}


def test_words_are_merged_as_the_library_does(spark):
    rng = random.Random(8)
    syllables = ["th", "e", "ing", "ou", "r", "st", "a", "tion", "É", "ß", "  ", "***", "12", "日", "😀", ".", "'"]
    words = list(dict.fromkeys("".join(rng.choices(syllables, k=rng.randint(1, 12))).replace(" ", "") for _ in range(400)))
    got = P.encode_words(spark.createDataFrame([(" " + w, k) for k, w in enumerate(words) if w], "w string, k int")).collect()
    assert len(got) == len([w for w in words if w])
    table, _, own = model()
    for r in got:
        assert r["ids"] == library().encode(r["w"][1:]) == P.heap_merge(r["w"], table, own), r["w"]


def test_query_at_two_splits(spark):
    base = spark.conf.get("spark.checkpoint.dir") + "/pieces-in"
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.mode("overwrite").parquet(base + "/documents.parquet")
    got = P.op10_sentencepiece(spark, base).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r["doc_id"]]
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert r["n_pieces"] == len(brute(t) if t else [])


def test_empty(spark):
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert P.encode_words(spark.createDataFrame([], "w string")).select(F.count("*")).first()[0] == 0


def test_common_words_are_numbered_by_frequency(spark):
    """The most frequent words have the least numbers, of which documents are written in the fewest bytes."""
    words = ["".join("abcdefghij"[int(c)] for c in f"{k:03d}") for k in range(300)]
    rows = [(" ".join([w] * (302 - k)),) for k, w in enumerate(words)]
    got = P.common_words(spark.createDataFrame(rows, "text string").repartition(5), "text", P.LONG, P.MODEL, True)
    assert [w for w in got if w != " "] == [" " + w for w in words]
    assert got[" " + words[7]] == np.array(library().encode(words[7]), "<i4").tobytes()


def test_splits_may_change_between_the_passes(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, " ".join("".join(rng.choices("abcdeßé", k=rng.randint(2, 9))) for _ in range(300))) for i in range(400)]
    at = f"file://{tmp_path}/in"
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.option("parquet.block.size", 65536).parquet(at)
    key = "spark.sql.files.minPartitionNum"
    try:
        for first, then in ((4, 7), (7, 4), (1, 16)):
            spark.conf.set(key, first)
            out = P.encode(spark.read.parquet(at), digests=True)
            spark.conf.set(key, then)
            got = {r["doc_id"]: r for r in spark.read.parquet(at).select("doc_id").join(out, "doc_id").collect()}
            assert len(got) == len(rows)
            for i, t in rows:
                assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
                assert i % 40 or got[i]["ids"] == brute(t)
    finally:
        spark.conf.unset(key)


def test_best_path_of_whole_texts(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = P.decode(P.encode(df, bpe=False)).collect()
    assert len(got) == len(rows)
    for r in got:
        t = dict(rows)[r["doc_id"]]
        assert r["decoded"] == t
        assert r["ids"] == (None if t is None else [i for w in P.words_of(t) for i in viterbi(w)])


def test_pieces_off_all_best_paths_are_not_tried(spark):
    ps = P.pieces()
    kept = P.on_best_paths(ps)
    assert len(kept) < len(ps) / 2
    table, least, own = model()
    rng = random.Random(17)
    words = list(dict.fromkeys("".join(rng.choices(["th", "e", "ing", "ou", "r", "st", "a", "tion", "É", "  ", "日", "😀", "."], k=rng.randint(1, 9))) for _ in range(300)))
    on = {i for _, i, _ in kept} | set(own)
    assert all(set(viterbi(w)) <= on for w in words)
    got = P.encode_words(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "w string, k int"), bpe=False).collect()
    assert {r["w"]: r["ids"] for r in got} == {w: viterbi(w) for w in words} and all(words[r["k"]] == r["w"] for r in got)
    # Equal scores keep a piece, as ties go to the longer last one.
    own = [("a", 1, -1.0), ("b", 2, -1.0), ("ab", 3, -2.0), ("aba", 4, -4.0)]
    assert P.on_best_paths(own) == own[:3]


def test_a_very_long_word_of_a_unigram_model(spark):
    """One word of some thousand characters is folded over its whole lattice."""
    rows = [(1, "thorreouÉ" * 300), (2, "x"), (3, None)]
    got = {r["doc_id"]: r["ids"] for r in P.encode(spark.createDataFrame(rows, "doc_id long, text string"), bpe=False).collect()}
    assert got == {k: None if t is None else [i for w in P.words_of(t) for i in viterbi(w)] for k, t in rows}


def test_no_piece_crosses_words():
    table, _, _ = model()
    rng = random.Random(4)
    for p in table:
        for t in (p + "x", "x" + p if not p.startswith(" ") else p, p + "7", p + " "):
            at = t.index(p)
            ends = [0]
            for w in P.WORDS.findall(t):
                ends.append(ends[-1] + len(w))
            assert not any(at < e < at + len(p) for e in ends), (p, t)
    text = "".join(rng.choices("ab é”…»²,.'\"!0123\n  ×日", k=5000))
    assert "".join(P.WORDS.findall(text)) == text


def edge(rank, start, size, id, late):
    return ((((rank << P.S_BITS) + start << P.N_BITS) + size << P.ID_BITS) + id) * 2 + late


def test_pieces_that_become_due_after_their_turn(spark):
    """xyb comes before xy, of which it is made: the one pass is not enough, and the word is merged by steps."""
    singles = lambda w: [edge(P.NONE, k, 1, ord(c), 0) for k, c in enumerate(w)]
    words = [("xyb", [edge(1, 0, 3, 11, 1), edge(3, 0, 2, 13, 0)], [11]), ("xybc", [edge(1, 0, 3, 11, 1), edge(2, 2, 2, 12, 0), edge(3, 0, 2, 13, 0)], [13, 12]), ("xyby", [edge(1, 0, 3, 11, 1), edge(3, 0, 2, 13, 0), edge(4, 2, 2, 14, 0)], [11, ord("y")]), ("zx", [], [ord("z"), ord("x")])]
    words = [(w, e + singles(w), ids) for w, e, ids in words]
    df = spark.createDataFrame(words, "w string, edges array<long>, ids array<int>")
    assert all(r["got"] == r["ids"] for r in df.select("ids", P.merged("edges", "w").alias("got")).collect())


def test_clashing_columns(spark):
    names = ["f", "span", "w", "d", "_text", "a b", "n_pieces", "ids"]
    df = spark.createDataFrame([(1, "Hello 12, é", *range(8)), (2, None, *range(8))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = {r["doc_id"]: r.asDict() for r in P.encode(df, digests=True).collect()}
    assert got[1]["ids"] == brute("Hello 12, é") and got[1]["n_pieces"] == len(got[1]["ids"]) and got[2]["ids"] is None
    for r in got.values():
        assert [r[n] for n in names[:6]] == list(range(6)) and r["text"] in ("Hello 12, é", None)
    assert {r["doc_id"]: r["decoded"] for r in P.decode(P.encode(df)).collect()} == {1: "Hello 12, é", 2: None}
