"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. Between stages the documents are written and read again.

Defined cases, in every stage: a row is a document of its own, also where it has
no doc_id or shares one; an empty table gives an empty one; columns beyond those
of documents pass through, whatever their names. A null or empty text is refused
by the quality rules; the other stages keep it (the last with no tokens).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigrid.llm import decontam, linededup, neardup, pieces, quality
from lumigrid.llm.store import cut, cut_counting, with_row_ids

#: numbers of rows to drop are broadcast up to this many, and joined by shuffle beyond
BROADCAST_IDS = 1_000_000
#: the similarity at which documents are copies of each other, in percent: the 0.8 of a
#: near-duplicate stage; the 85 of op8 is that query's own
COPY_PERCENT = 80
ROW = "row_of_the_stage"


def _without(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows whose number is not in ``gone`` (column doc_id)."""
    table, n = cut_counting(gone.select(F.col("doc_id").alias("gone")).distinct(), name)
    return rows.join(F.broadcast(table) if n <= BROADCAST_IDS else table, rows[ROW] == table.gone, "left_anti")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those without text go. Repeated rows stay or go together."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, trusted).where("kept").select(*_plain(docs))


def _plain(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def line_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those with nothing left go.

    Of repeated rows one keeps its lines. A null text stays."""
    out = linededup.dedup_lines(docs).where("kept")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*_plain(docs))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, rows
    without one of their own last. Texts without a word are nobody's copies."""
    rows = with_row_ids(docs, ROW)
    judged = neardup.near_duplicates(_numbered(rows), neardup.NearDup(percent=COPY_PERCENT))
    return _without(rows, judged.where("not kept"), "copies").select(*_plain(docs))


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage near a benchmark item."""
    rows = with_row_ids(docs, ROW)
    leaks = decontam.find_leaks(_numbered(rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, leaks, "leaks").select(*_plain(docs))


def encoding(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether decoding those gives the text. A null text has null ids."""
    return pieces.encode(docs, check=True)


STAGES = [
    ("quality", quality_rules),
    ("lines", line_dedup),
    ("copies", near_dedup),
    ("benchmark", decontamination),
    ("tokens", encoding),
]

#: SQL has no expression for the stages' models and hashes; tests/llm/test_pipeline.py checks them by brute force
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
