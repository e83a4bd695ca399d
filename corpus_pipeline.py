"""Corpus preparation as a chain of operators.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; ``run`` writes each stage's result as Parquet in the shared folder
and rereads it. All stages but the last keep the columns of ``documents``.

1. toxicity: documents judged toxic go.
2. n-gram Jaccard join: the document with the smallest doc_id of each group of
   near duplicates stays.
3. substring dedup: words of passages that an earlier document has go; a
   document that loses all its words stays, with an empty text.
4. personal data: every span becomes its kind in angle brackets.
5. packing: the pieces of the documents and their places in sequences.

Null and empty texts pass through all stages, as a sequence's end id in the
last. Rows with the same doc_id share their fate in stages 2 and 3.
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planlens.llm import jaccard_join, packing, pii, substring_dedup, toxicity
from planlens.llm.queries import vocabulary
from planlens.workspace import Scratch

#: Working tables of the stage that a run is in; a stage called by itself has none, and its tables stay.
_of_stage: ContextVar[list[Scratch] | None] = ContextVar("of_stage", default=None)


def _scratch(spark: SparkSession, label: str) -> Scratch:
    made = Scratch(spark, label)
    held = _of_stage.get()
    if held is not None:
        held.append(made)
    return made


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they now are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels, ~toxicity.held_out(F.col("doc_id")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(docs, scratch=_scratch(spark, "near"))
    return jaccard_join.near_duplicate_heads(docs, found)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.without_repeats(docs, scratch=_scratch(spark, "repeats")))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.masked(docs, scratch=_scratch(spark, "personal")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), scratch=_scratch(spark, "packing"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("pii", mask_personal_data),
    ("packing", pack_documents),
]

#: Learned models, removal by spans and packing aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        made: list[Scratch] = []
        token = _of_stage.set(made)
        try:
            docs = kept.save(stage(spark, docs, sf_dir), name)
        finally:
            _of_stage.reset(token)
        for scratch in made:  # its result is written
            scratch.drop()
    kept.drop_others(STAGES[-2][0])
    return STAGES[-1][1](spark, docs, sf_dir)
