"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing to target weights, and encoding.

Every stage gets what the one before kept, as documents read from Parquet, and all but the last return the columns of documents:
rejected documents and near copies are gone, repeated lines are cut out (n_chars follows), and the mix gives documents out once,
twice or not at all, in its order. The last adds the pieces' ids and digests.

A stage's result reads tables that the stage has stored. run() deletes them, and the documents that the stage has read, when it has written the result; what the last stage
stores stays, as run()'s own result reads it. Whoever calls the STAGES one after the other writes each result before the next stage is called: a stage deletes what the one before it stored
when it was last called. The first stage deletes nothing, and run() and the STAGES don't touch each other's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardflow.llm import line_dedup, mixing, pieces, quality_rules, simhash
from wardflow.llm.common import recorded, remove, stored

#: What each of STAGES has stored when it was last called.
_LEFT: dict[int, list[str]] = {}


def _clear(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        remove(spark, path)


def cleared(k: int, stage):
    """Stage k, which first deletes what the stage before it has stored."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark, _LEFT.pop(k - 1, []))
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _LEFT[k] = paths
        return out

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, similarity=0.8, n=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, digests=True)


_STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]
STAGES = [(name, cleared(k, stage)) for k, (name, stage) in enumerate(_STAGES)]

#: Fingerprints and pieces are beyond SQL; tests/llm/test_pipeline.py holds the run against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(_STAGES, 1):
        with recorded() as paths:
            docs = stage(spark, docs, sf_dir)
            if k < len(_STAGES):
                docs = stored(docs, f"stage-{k}")
        if k < len(_STAGES):
            _clear(spark, [*before, *paths[:-1]])
            before = paths[-1:]  # the stage's documents, which the next one reads
    return docs
