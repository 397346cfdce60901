"""Whole claim analysis: batch and stream agree, versions, replays."""

from pyspark.sql import functions as F

from claimlens.operators import analysis as AN
from claimlens.operators import models as M

COLUMNS = ["claim_id", "greenwashing_risk_gb", "greenwashing_risk_lr", "text_risk_score", "rag_risk_score", "overall_risk_score", "risk_level",
           "fraud_alert", "recommendations", "n_hits", "relevant_standards", "model_version"]


def claims(spark, n=48):
    words = ["solar forest water", "sustainable and committed to net zero", "carbon neutral 100%", "steel report"]
    rows = [(i, f"{words[i % 4]} claim text", ["energy", "waste"][i % 2], float(i % 7), float(i % 4 in (1, 2))) for i in range(n)]
    d = spark.createDataFrame([*rows, (900, None, None, None, 1.0), (901, "", "energy", 2.0, 0.0)], "claim_id long, t string, c string, v double, y double")
    return M.prepare(d, ["v"], ["c"], "y", None).withColumn("esg_claim_text", F.coalesce("t", F.lit(""))).withColumn("weight", F.lit(1.0))


def chunks(spark):
    return spark.createDataFrame([("a:0", "forest and water rules", "Standard A"), ("b:0", "net zero claims need proof", None), ("c:0", "nothing alike", "C")],
                                 "chunk_uid string, text string, title string")


def test_batch_stream_and_versions(spark, tmp_path):
    d = claims(spark)
    folder, out = str(tmp_path / "tables"), str(tmp_path / "out")
    assert AN.versions(spark, folder) == []
    stages = M.feature_stages("esg_claim_text", ["c"], ["v"], vocab_size=50)
    assert AN.publish(d, stages, chunks(spark), folder) == 1
    batch = AN.analyze(d, AN.latest(spark, folder))
    assert batch.columns == COLUMNS
    rows = {r["claim_id"]: r for r in batch.collect()}
    assert len(rows) == 50 and all(r["overall_risk_score"] is not None for r in rows.values())
    one = rows[1]
    blend = max(one["greenwashing_risk_gb"], one["greenwashing_risk_lr"]) * 0.5 + one["text_risk_score"] * 0.25 + one["rag_risk_score"] * 0.25
    assert abs(one["overall_risk_score"] - min(blend, 1)) < 2e-6 and one["relevant_standards"].split("|")[0] == "Unknown" and one["n_hits"] >= 1
    assert rows[901]["n_hits"] == 0 and rows[901]["rag_risk_score"] == 0.6
    # the stream gives the same rows, over several batches
    arriving = str(tmp_path / "arriving")
    d.repartition(5).write.parquet(arriving)
    source = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    AN.stream_analysis(source, folder, out, str(tmp_path / "ck")).awaitTermination()
    streamed = spark.read.parquet(out)
    assert {r["claim_id"]: tuple(r[c] for c in COLUMNS) for r in streamed.collect()} == {i: tuple(r) for i, r in rows.items()}
    assert streamed.select("batch").distinct().count() > 1
    # files that were read are not read again, a half-written version is not seen, a new one is
    AN.stream_analysis(source, folder, out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 50
    (tmp_path / "tables" / "v=2").mkdir()
    assert AN.versions(spark, folder) == [1]
    assert AN.publish(d, stages, chunks(spark), folder) == 2
    d.where("claim_id < 4").withColumn("claim_id", F.col("claim_id") + 5000).write.mode("append").parquet(arriving)
    AN.stream_analysis(source, folder, out, str(tmp_path / "ck")).awaitTermination()
    last = spark.read.parquet(out).where("claim_id >= 5000").collect()
    assert len(last) == 4 and {r["model_version"] for r in last} == {2}
