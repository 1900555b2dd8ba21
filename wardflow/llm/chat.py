"""Conversations rendered by a template, with a token mask of what is to be learned.

A turn is rendered as START role TEXT text END; control strings inside roles and texts get a backslash after their first character,
and backslashes are doubled, so a rendering is read back without loss. The whole conversation is encoded once with offsets (code
points); the assistant turns' spans, sorted, are intersected with the tokens' spans by binary search, and a token that reaches
over a span's end counts with the part inside.

Nulls: a null text or role is empty; a null turn comes first; a null conv_id is a conversation of its own. Turns that tie are ordered by
role, then text; repeated rows are turns each. An empty table gives an empty result; other columns are not read. A conversation is
rendered by one task, as its digest needs it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm.common import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
START, TEXT, END = "<|start|>", "<|text|>", "<|end|>\n"
#: Strings that this or other common templates give a meaning.
CONTROL = (START, TEXT, "<|end|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(s: str) -> str:
    s = s.replace("\\", "\\\\")
    for c in CONTROL:
        s = s.replace(c, c[0] + "\\" + c[1:])
    return s


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + TEXT, escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(s: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    turns, at = [], 0
    while at < len(s):
        if not s.startswith(START, at):
            raise ValueError(f"no turn at {at}")
        mid = s.index(TEXT, at + len(START))
        end = s.index(END, mid + len(TEXT))
        turns.append((unescape(s[at + len(START) : mid]), unescape(s[mid + len(TEXT) : end])))
        at = end + len(END)
    return turns


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """For each token whether it meets a span; for each span the parts of it that tokens cover. offsets: (tokens, 2), sorted."""
    on = np.zeros(len(offsets), bool)
    begins, ends = (offsets[:, 0], np.maximum.accumulate(offsets[:, 1])) if len(offsets) else (np.empty(0, int),) * 2
    parts = []
    for a, b in spans:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left"))
        own: list[tuple[int, int]] = []
        for s, e in offsets[lo:hi]:
            s, e = max(int(s), a), min(int(e), b)
            if s >= e:
                continue
            if own and s <= own[-1][1]:
                own[-1] = (own[-1][0], max(own[-1][1], e))
            else:
                own.append((s, e))
        on[lo:hi] = (offsets[lo:hi, 0] < offsets[lo:hi, 1]) & (offsets[lo:hi, 1] > a)
        parts.append(own)
    return on, parts


def tokenizer(path: str):
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    t.post_processor = processors.ByteLevel(trim_offsets=False)  # else a token's offsets lose its blank
    return t


def _formatter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            for first in range(0, b.num_rows, 64):
                part = b.slice(first, 64)
                drawn = [render([(x["role"] or "", x["text"] or "") for x in turns]) for turns in part.column(1).to_pylist()]
                rows = []
                for (text, spans), enc in zip(drawn, tok.encode_batch([t for t, _ in drawn], add_special_tokens=False)):
                    on, parts = mask(np.array(enc.offsets, int).reshape(-1, 2), spans)
                    rows.append({"formatted": text, "tokens": enc.ids, "loss": on.tolist(), "loss_parts": [[{"s": s, "e": e} for s, e in own] for own in parts]})
                got = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("formatted", pa.string()), ("tokens", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("loss_parts", pa.list_(pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))))]))
                yield pa.RecordBatch.from_arrays([part.column(0), *got.columns], ["conv_id", *got.schema.names])

    return run


def formatted(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """conv_id, formatted, tokens, loss (for each token), loss_parts (for each assistant turn the spans under the mask)."""
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_formatter(path), f"conv_id {kind}, formatted string, tokens array<int>, loss array<boolean>, loss_parts array<array<struct<s:int,e:int>>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the output says: turns by parsing it, and the text under the mask."""
    hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        out = {"n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
        for text, parts in zip(b["formatted"].to_pylist(), b["loss_parts"].to_pylist()):
            turns = parse(text)
            loss = "".join(unescape("".join(text[p["s"] : p["e"]] for p in own)) for own in parts)
            for k, v in zip(out, (len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(text))):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([b["conv_id"], *map(pa.array, out.values())], ["conv_id", *out])


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return formatted(rows).select("conv_id", "formatted", "loss_parts").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sql_length(c: str) -> str:
    """Code points of the escaped column, in SQL."""
    x = f"replace({c}, chr(92), chr(92) || chr(92))"
    for s in CONTROL:
        x = f"replace({x}, '{s}', '{s[0]}' || chr(92) || '{s[1:]}')"
    return f"length({x})"


OP8_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum({len(START + TEXT + END)} + {_sql_length("role")} + {_sql_length("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
