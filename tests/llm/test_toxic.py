"""Toxic texts go, in the quality query and in the pipeline's stage; half of the labels fit, the other half is judged."""
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.1"


def test_toxic_recall_and_loss(spark):
    if not Path(SF).exists():
        pytest.skip("given tables not found")
    from pyspark.sql import functions as F
    from votelens.llm import quality
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    known = labels.where(~half).select("doc_id", "quality", F.col("toxic").alias("label"))
    rows = quality.judge(docs, labels.where(half)).join(known, "doc_id").where("NOT base_failed AND quality = 1").collect()
    toxic, clean = ([r for r in rows if r.label == i] for i in (1, 0))
    recall, loss = sum(r.toxic >= .5 for r in toxic) / len(toxic), sum(r.toxic >= .5 for r in clean) / len(clean)
    print(f"held-out toxic rows {len(toxic)}, recall {recall:.3f}; clean rows {len(clean)}, loss {loss:.4f}; "
          f"toxic kept {sum(r.kept for r in toxic)}, clean kept {sum(r.kept for r in clean)}")
    assert recall >= .9 and loss <= .01
    assert not any(r.kept for r in rows if r.toxic >= .5)


def test_stage_drops_toxic_rows(spark, tmp_path):
    import corpus_pipeline as P
    rows = []
    for i in range(400):
        words = [f"w{(i * 7 + j * 13) % 500}" for j in range(80)]
        if i % 4 == 0:
            words[i % 80] = "Scum," if i % 8 else "scum"
        rows.append((i, " ".join(words)))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows if i < 300], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in P.quality_rules(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(400) if i % 4}
