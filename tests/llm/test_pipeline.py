"""The pipeline's stages against plain Python on the smallest documents."""

import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import SF  # noqa: E402
from test_operators import brute_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from offerloom.llm import mixing, packing, quality_rules  # noqa: E402


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept, rows = docs.columns, [docs], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = spark.createDataFrame(stage(spark, rows, SF).toPandas(), docs.schema)
        assert rows.columns == columns
        kept.append(rows)
    start, good, once, one, mixed = (k.toPandas() for k in kept)
    verdict = quality_rules.judge(docs).filter("kept").toPandas()
    assert sorted(good.doc_id) == sorted(verdict.doc_id)
    body = good.text.str.replace(r"[\x20\x09-\x0D]", "", regex=True)
    assert len(once) == body.nunique()
    parts = brute_components(list(zip(once.doc_id, once.text)))
    assert sorted(one.doc_id) == sorted(i for i, (_, c) in parts.items() if c == i)
    times = mixing.mix(spark.createDataFrame(one, docs.schema)).toPandas().set_index("doc_id").times
    assert mixed.doc_id.value_counts().to_dict() == {i: n for i, n in times.items() if n}
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept[-1], SF).toPandas()
    tokens = sum(len(packing.encoder().ids(t)) + 1 for t in mixed.text)
    assert pieces.length.sum() == tokens and np.all(pieces.length & (pieces.length - 1) == 0)


def test_run_equals_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
