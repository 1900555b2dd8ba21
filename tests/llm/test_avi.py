import hashlib
import random
import zlib

import numpy as np
import pytest

from wardflow.llm import avi as A


@pytest.mark.parametrize("frames", [1, 2, 37])
def test_round_trip_and_standard_decoding(frames):
    payload = random.Random(frames).randbytes(frames * A.FRAME) if frames < 30 else bytes([255, 0] * (frames * A.FRAME // 2))
    media = A.write_avi(payload)
    got, usec = A.read_avi(media)
    assert got.tobytes() == payload and usec == A.USEC
    assert int.from_bytes(media[4:8], "little") == len(media) - 8
    at, own = media.index(b"movi") + 4, []
    for _ in range(frames):  # frame by frame, by the general decoder
        n = int.from_bytes(media[at + 4 : at + 8], "little")
        own.append(A.decode_frame(media[at + 8 : at + 8 + n]).tobytes())
        at += 8 + n + (n & 1)
    assert b"".join(own) == payload


def test_without_index():
    payload = random.Random(1).randbytes(5 * A.FRAME)
    media = A.write_avi(payload)
    cut = media[: media.rindex(b"idx1")]
    assert A.read_avi(cut)[0].tobytes() == payload


def test_shots():
    rng = np.random.default_rng(1)
    dark, light = rng.integers(20, 60, (30, 12, 16)), rng.integers(180, 220, (25, 12, 16))
    assert A.shots(np.concatenate([dark, light]).astype(np.uint8)) == [(0, 29), (30, 54)]
    assert A.shots(np.zeros((1, 12, 16), np.uint8)) == [(0, 0)]
    assert A.shots(np.zeros((0, 12, 16), np.uint8)) == []


@pytest.mark.parametrize("cuts", [[30, 35, 40], [30, 38, 46], [30, 32, 37, 45], [1], [1, 2, 3], [2, 4, 12]])
def test_shots_of_few_frames(cuts):
    rng = np.random.default_rng(2)
    ends = [0, *cuts, 60]
    scenes = [rng.integers(low, low + 30, (b - a, 12, 16)) for a, b, low in zip(ends, ends[1:], [16, 160, 80, 208, 16, 112])]
    assert A.shots(np.concatenate(scenes).astype(np.uint8)) == [(a, b - 1) for a, b in zip(ends, ends[1:])]


def test_rows(spark):
    texts = [(1, None), (2, ""), (3, "a" * 192), (4, "é" * 97), (None, "x"), (3, "a" * 192), (7, "long " * 100_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.mode("overwrite").parquet(d := spark.conf.get("spark.checkpoint.dir") + "/avi/documents.parquet")
    got = A.op7_media_columns(spark, d.rpartition("/")[0]).collect()
    assert len(got) == len(texts)
    by = {r["doc_id"]: r for r in got}
    for k, t in texts:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r["media_bytes"] == len(A.write_avi(p)) and r["media_sha256"] == hashlib.sha256(A.write_avi(p)).hexdigest()
    clips = A.clips(A.stored_media(df.where("doc_id = 7"))).toPandas().sort_values("clip")
    assert clips.start_ms.iloc[0] == 0 and (clips.start_ms.iloc[1:].to_numpy() == clips.end_ms.iloc[:-1].to_numpy()).all()
    assert A.clips(A.stored_media(df.limit(0))).collect() == []


def test_a_very_long_text_is_stored_without_loss(spark):
    """Some ten thousand frames, packed and read in parts; other columns are not read."""
    import hashlib

    text = "".join(chr(32 + (k * k) % 90) for k in range(2_500_000)) + "é😀"
    df = spark.createDataFrame([(1, text, 5), (2, None, 6)], "doc_id long, text string, media int")
    got = {r["doc_id"]: r for r in A.stored_media(df).mapInArrow(A._features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()}
    for k, t in ((1, text), (2, None)):
        n, payload = A.padded(t)
        assert got[k]["n_bytes"] == n and got[k]["payload_sha256"] == hashlib.sha256(payload).hexdigest()


def _with_audio(media, absolute=False):
    """The file with an audio stream in front of the video's, an audio chunk before each frame, and an index of all of them."""
    import struct

    chunk = lambda k, x: k + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1)
    own = [media[a : a + n] for a, n in zip(*(x.tolist() for x in A._frame_places(media)[:2]))]
    strl = lambda kind: chunk(b"LIST", b"strl" + chunk(b"strh", kind + b"\0" * 52))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 50_000, *[0] * 13)) + strl(b"auds") + strl(b"vids"))
    movi, index, base = b"movi", b"", 12 + len(hdrl) + 8 if absolute else 0
    for f in own:
        for k, x in ((b"00wb", b"sound"), (b"01dc", f)):
            index += struct.pack("<4sIII", k, 16, base + len(movi), len(x))
            movi += chunk(k, x)
    body = b"AVI " + hdrl + chunk(b"LIST", movi) + chunk(b"idx1", index)
    return chunk(b"RIFF", body)


@pytest.mark.parametrize("absolute", [False, True])
def test_only_the_video_stream_is_read(absolute):
    payload = random.Random(3).randbytes(3 * A.FRAME)
    got, usec = A.read_avi(_with_audio(A.write_avi(payload), absolute))
    assert got.tobytes() == payload and usec == 50_000
    without = _with_audio(A.write_avi(payload))
    assert A.read_avi(without[: without.rindex(b"idx1")])[0].tobytes() == payload


def test_damaged_files_give_a_reason(spark):
    good = A.write_avi(random.Random(5).randbytes(4 * A.FRAME))
    at = good.index(b"\xff\xc3")
    baseline = good[: at + 1] + b"\xc0" + good[at + 2 :]
    bad = {"cut": good[:-100], "short": good[:10], "text": b"no film", "empty": b"", "baseline": baseline, "places": good[:-8] + (2**31).to_bytes(4, "little") + good[-4:]}
    for k, x in bad.items():
        with pytest.raises(A.MediaError):
            A.read_avi(x)
    rows = [(i, 7, x) for i, x in enumerate([good, None, *bad.values()])]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").selectExpr("*", "1 as clip", "2 as error")
    clips = A.clips(df).collect()
    assert {r["doc_id"] for r in clips} == {0, *range(2, 2 + len(bad))}
    assert all((r["error"] is None) == (r["doc_id"] == 0) and (r["clip"] is None) == (r["doc_id"] > 0) for r in clips)
    got = {r["doc_id"]: r for r in df.select("doc_id", "n_bytes", "media").mapInArrow(A._features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()}
    assert len(got) == len(rows) and got[1]["feature"] is None and got[0]["payload_bytes"] == 4 * A.FRAME
    assert all(got[k]["feature"].startswith("error: ") and got[k]["payload_sha256"] is None for k in range(2, len(rows)))
