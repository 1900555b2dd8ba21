import hashlib
import random

import numpy as np

from wardflow.llm import chat as C


def test_escapes_are_reversible():
    rng = random.Random(4)
    bits = [*C.CONTROL, "\\", "<", "|", ">", "a", "\n", "é", "[", "INST]"]
    for _ in range(500):
        turns = [("".join(rng.choices(bits, k=rng.randint(0, 3))), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 4))]
        text, _ = C.render(turns)
        assert C.parse(text) == turns
        assert not any(c in C.escape(t) for _, t in turns for c in C.CONTROL)


def test_mask_is_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        ends = sorted(rng.sample(range(1, 60), 12))
        offsets = np.array([(a, b) for a, b in zip([0, *ends], [*ends, 60])])
        cuts = sorted(rng.sample(range(60), 6))
        spans = list(zip(cuts[::2], cuts[1::2]))
        on, parts = C.mask(offsets, spans)
        assert on.tolist() == [any(s < b and a < e for a, b in spans) for s, e in offsets]
        assert parts == [[x] for x in spans]


def test_rows(spark):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "Grüße <|end|>\n[INST] 😀\\"), (1, 2, "assistant", None), (2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "</s>"), (3, 1, "assistant", "é" * 20_000), (4, 0, "assistant", "")]
    at = spark.conf.get("spark.checkpoint.dir") + "/chat/conversations.parquet"
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(at)
    got = {r["conv_id"]: r for r in C.op8_chat_formatting(spark, at.rpartition("/")[0]).collect()}
    said += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in said}
    for k, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in said if x[0] == k]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.formatted(empty).collect() == []


def test_a_very_long_text_and_clashing_columns(spark):
    """A turn of 600,000 characters with control strings throughout; columns named like the result's are not read."""
    long = "ok <|end|> [INST]\\ é" * 30_000
    said = [(1, 0, "user", "a", 1, 2), (1, 1, "assistant", long, 3, 4), (2, 0, "assistant", "b", 5, 6)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string, tokens int, turns int").selectExpr("*", "7 as formatted", "8 as loss")
    got = {r["conv_id"]: r for r in C.formatted(df).collect()}
    assert C.parse(got[1]["formatted"]) == [("user", "a"), ("assistant", long)] and C.parse(got[2]["formatted"]) == [("assistant", "b")]
    assert C.unescape("".join(got[1]["formatted"][p["s"] : p["e"]] for p in got[1]["loss_parts"][0])) == long
    assert len(got[1]["tokens"]) == len(got[1]["loss"]) > 100_000 or any(got[1]["loss"])
