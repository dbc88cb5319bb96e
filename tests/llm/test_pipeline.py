"""The pipeline on a small table: each stage's decisions against its operator or a plain version."""

import os
import re

from pyspark.sql import functions as F

import corpus_pipeline as cp
from moundline.llm import common
from tests.llm.test_operators import plain_lines


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("score", F.lit("mine"))
    odd = spark.createDataFrame([(9000, None, None, None, None, "mine"), (9001, "", "en", "src1", 0, "mine"), (9002, "one line of words", "en", None, 17, "mine"), (9002, "one line of words", "en", None, 17, "mine")], source.schema)
    source.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = []
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        outs.append(docs.collect())
        if i < 4:
            assert docs.columns == first.columns and {r.score for r in outs[-1]} == {"mine"}
    assert 0 < len(outs[0]) <= first.count()
    assert sorted((r.doc_id, r.text or "") for r in outs[1]) == sorted((r[0], r[3] or "") for r in plain_lines([(r.doc_id, r.text) for r in outs[0]]))
    assert len(outs[1]) == len(outs[0]) and all(r.n_chars == len(r.text) for r in outs[1] if r.text is not None)
    assert sum(r.doc_id == 9002 for r in outs[1]) in (0, 2) and sum(r.doc_id == 9002 for r in outs[2]) <= 1
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r.doc_id for r in outs[1] if not words(r.text)} <= {r.doc_id for r in outs[2]}
    total = sum(words(r.text) for r in outs[2])
    assert abs(sum(words(r.text) for r in outs[3]) - 1.5 * total) < 0.1 * total
    assert len(outs[4]) == len(outs[3])
    whole = cp.run(spark, str(tmp_path))
    key = lambda rows: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows)
    assert key(whole.collect()) == key(outs[4])


def test_release(spark):
    table = common.written(spark.range(3), "kept")
    path = table.inputFiles()[0].removeprefix("file://")
    assert table.count() == 3 and os.path.exists(path)
    common.release(spark)
    assert not os.path.exists(path) and not common.LEFT
