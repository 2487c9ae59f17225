"""Each stage of the pipeline on its own input, and all of them."""

import pytest
import corpus_pipeline
from .test_operators import SCHEMA, TEXTS, _check_packed, _classes, _contaminated, _cut_runs, _row


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [_row(i, t) for i, t in enumerate(TEXTS)] + [_row(900, None), _row(901, ""), _row(902, "!!! 123"), _row(5, TEXTS[5]), _row(None, TEXTS[6])]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(TEXTS[2].split()[:25])), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def _pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = stages["language_id"](spark, docs, sf_dir)
    assert out.columns == docs.columns and _pairs(out) == sorted((x for x in rows if x[1] and x[1] != "!!! 123"), key=str)
    out = stages["line_dedup"](spark, docs.where("doc_id != 5 or doc_id is null"), sf_dir)
    want = _cut_runs(sorted([x for x in rows if x[0] != 5], key=lambda x: (x[0] is None, x[0] or 0)))
    assert out.columns == docs.columns and _pairs(out) == sorted(((i, t) for i, t, n, _ in want if not n or t.strip()), key=str)
    out = stages["near_dedup"](spark, docs, sf_dir)
    classes = {c for _, c, _ in _classes(rows)}
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(classes)
    out = stages["decontamination"](spark, docs, sf_dir)
    clean = [x for x in rows if not _contaminated(x[1], [(1, " ".join(TEXTS[2].split()[:25]))])[-1]]
    assert out.columns == docs.columns and _pairs(out) == sorted(clean, key=str) and len(clean) < len(rows)
    _check_packed(rows, stages["packing"](spark, docs, sf_dir).collect(), 2048)


def test_run_and_empty(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() > 20
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
