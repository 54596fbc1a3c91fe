import hashlib
import re

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from codetrail.llm import bpe
from codetrail.llm.common import landed

from .helpers import SF, docs, odd_docs
from .test_dart_minhash import _classes


def test_stages_match_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in df.collect()}
    # language: every document of these has letters and a clear language
    own = landed(pipeline.language(spark, df, SF), "t")
    assert {r["doc_id"] for r in own.collect()} == set(rows) and own.columns == df.columns
    own = landed(pipeline.exact(spark, own, SF), "t")
    groups = {}
    for i, t in rows.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    rows = {min(g)[1]: rows[min(g)[1]] for g in groups.values()}
    assert {r["doc_id"]: r["text"] for r in own.collect()} == rows
    own = landed(pipeline.near(spark, own, SF), "t")
    rows = {min(g): rows[min(g)] for g in _classes(sorted(rows.items()))}
    assert {r["doc_id"] for r in own.collect()} == set(rows)
    own = landed(pipeline.decontaminated(spark, own, SF), "t")
    rows = {i: t for i, t in rows.items() if not any(b in t for b in bench)}
    assert {r["doc_id"] for r in own.collect()} == set(rows) and own.columns == df.columns
    library = Tokenizer.from_file(bpe.default_tokenizer())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in pipeline.tokens(spark, own, SF).collect()}
    for i, t in rows.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_run_applies_all_stages(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 150 < out.count() <= 200


def test_documents_without_a_language_go(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(40)
    more = texts.unionByName(docs(spark, [(10_001, "123 456"), (10_002, None), (10_003, "")]).select("doc_id", "text", "lang"))
    kept = {r["doc_id"] for r in pipeline.language(spark, more.withColumn("c1", F.lit(1)), SF).collect()}
    assert not kept & {10_001, 10_002, 10_003} and len(kept) == 40


def test_empty_documents_pass_every_stage(spark):
    own = docs(spark, [])
    for name, stage in pipeline.STAGES:
        own = landed(stage(spark, own, SF), name)
    assert own.collect() == []


def test_odd_and_repeated_rows_pass_every_stage(spark):
    own = odd_docs(spark)
    columns = own.columns
    kept = []
    for name, stage in pipeline.STAGES:
        own = landed(stage(spark, own, SF), name)
        kept.append(sorted((r["doc_id"] for r in own.collect()), key=lambda i: (i is None, i)))
        assert name == "bpe_tokens" or own.columns == columns
    # 6 and two rows without an id are repeated, 11 is 6 in capitals
    assert kept[0] == [4, 5, 6, 6, 7, 8, 11, None, None]
    assert kept[1] == [4, 5, 6, 7, 8, 11, None]
    assert kept[2] == kept[3] == kept[4] == [4, 5, 6, 7, 8, None]
