"""The pipeline's stages on their own input, against plain versions where rules decide."""

import __spark_entry__
import corpus_pipeline
from dialoom.llm import language_id, mixing, queries
from dialoom.session import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, sf))
        assert docs.columns == columns, name
        seen[name] = (before, docs)
    before, after = seen["language_id"]
    kept = {r.doc_id for r in language_id.digest(before).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in after.collect()} == kept
    before, after = seen["near_dedup"]
    assert 0 < after.count() < before.count()
    assert after.join(before, columns, "left_semi").count() == after.count()
    before, after = seen["decontamination"]
    gone = before.join(after, "doc_id", "left_anti")
    assert 0 < gone.count() < 0.2 * before.count()
    before, after = seen["mixing"]
    copies = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    for r in mixing.digest(before).collect():
        assert r.taken == copies.get(r.doc_id, 0) * r.size
    _, last = corpus_pipeline.STAGES[-1]
    out = last(spark, docs, sf)
    assert out.count() == docs.count()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf))
    assert docs.count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())
