"""The pipeline's stages on the small tables: what each decides takes effect."""

import zlib

import corpus_pipeline
import numpy as np
from planlens.llm import bpe_chunks, jaccard_join, pii, queries, toxicity
from planlens.workspace import Scratch
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept, scratch = {}, Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, data), name)
        kept[name] = (before, docs)
    for name, (before, after) in kept.items():
        assert name == "packing" or after.columns == COLUMNS and after.dtypes == before.dtypes
    labels = spark.read.parquet(f"{data}/labels.parquet")
    before, after = kept["toxicity"]
    bad = toxicity.score(before, labels, ~toxicity.held_out(F.col("doc_id"))).filter("predicted = 1")
    assert after.join(bad, "doc_id", "left_semi").count() == 0 and after.count() + bad.count() == before.count()
    before, after = kept["ngram_jaccard"]
    heads = jaccard_join.near_duplicates(before).filter("doc_id = component_id")
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in heads.collect())
    before, after = kept["substring_dedup"]
    assert after.count() == before.count() and after.filter("n_chars <> length(text)").count() == 0
    first = {}
    for r in sorted(before.collect(), key=lambda r: r["doc_id"]):
        w = r["text"].split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), r["doc_id"])
    gone = {r["doc_id"]: r["text"] for r in after.collect()}
    for r in before.collect():
        w = r["text"].split()
        repeats = any(first[tuple(w[k : k + 13])] < r["doc_id"] for k in range(len(w) - 12))
        assert repeats == (gone[r["doc_id"]] != r["text"])
    _, after = kept["pii"]
    assert pii.find(after).filter(F.exists("base", lambda s: s["kind"].isin("email", "phone", "ip"))).count() == 0
    before, after = kept["packing"]
    encode = bpe_chunks.load_tokenizer(queries.vocabulary("byte_bpe_50k.json")).encode
    ids = {r["doc_id"]: np.array([*encode(r["text"], add_special_tokens=False).ids, 0], "<u4") for r in before.collect()}
    for r in after.collect():
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert after.agg(F.sum("length")).first()[0] == sum(map(len, ids.values()))


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0 and corpus_pipeline.ORACLE_SQL is None
