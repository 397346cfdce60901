"""Whole claim analysis (H14 with H3, and its tables for K1): model, text and retrieval risk of every claim.

``Published`` tables - the fitted features, the two classifiers and the chunked corpus - are kept under one folder in
numbered versions.  A version becomes readable when its marker is written last, so a reader never sees half of one, and a stream
may pick up a newer version between two batches.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators import models as M
from claimlens.operators import retrieval as RT
from claimlens.operators import risk as RK
from claimlens.session import written

K = 5


@dataclass
class Published:
    version: int
    features: PipelineModel
    gb: GBTClassificationModel
    lr: LogisticRegressionModel
    chunks: DataFrame


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions under ``folder``, oldest first."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{folder}/{n}/READY")[1]))


def publish(train: DataFrame, stages: list, chunks: DataFrame, folder: str) -> int:
    """Fit the features and both classifiers on ``train`` (label, weight), write them and the corpus as the next version.

    ``chunks`` holds (chunk_uid, text, title).
    """
    spark = train.sparkSession
    version = max(versions(spark, folder), default=0) + 1
    path = f"{folder}/v={version}"
    features = Pipeline(stages=stages).fit(train)
    learn = written(features.transform(train).select("features", "label", "weight"), "analysis-learn")
    kinds = M.classifiers()
    gb, lr = (kinds[n].fit(learn) for n in ("GradientBoosting", "LogisticRegression"))
    for name, model in (("features", features), ("gb", gb), ("lr", lr)):
        model.write().overwrite().save(f"{path}/{name}")
    chunks.select("chunk_uid", "text", "title").write.mode("overwrite").parquet(f"{path}/chunks")
    fs, marker = _fs(spark, f"{path}/READY")
    fs.create(marker, True).close()
    return version


def latest(spark: SparkSession, folder: str) -> Published:
    """The newest complete version."""
    known = versions(spark, folder)
    if not known:
        raise FileNotFoundError(f"no published version under {folder}")
    path = f"{folder}/v={known[-1]}"
    return Published(known[-1], PipelineModel.load(f"{path}/features"), GBTClassificationModel.load(f"{path}/gb"),
                     LogisticRegressionModel.load(f"{path}/lr"), spark.read.parquet(f"{path}/chunks"))


def model_risk(claims: DataFrame, tables: Published, id_col: str) -> DataFrame:
    """(id, gb, lr): the probabilities of both classifiers for every claim."""
    f = tables.features.transform(claims).select(id_col, "features")
    for name, model in (("gb", tables.gb), ("lr", tables.lr)):
        p = model.transform(f).withColumn(name, vector_to_array("probability")[1])
        f = p.select(*f.columns, name)
    return f.drop("features")


def retrieval_risk(claims: DataFrame, tables: Published, id_col: str, text: str, k: int = K) -> DataFrame:
    """(id, rag, n_hits, relevant_standards, sources): H3 over the k nearest chunks; a claim without a hit counts as without
    sources, and an absent text gets no risk.  The texts of the hits stand for the analysis whose tone is read."""
    c = claims.select(id_col, F.col(text).alias("_claim"))
    hits = written(RT.search_topk(c, id_col, "_claim", tables.chunks, k), "analysis-hits")
    h = hits.join(tables.chunks, "chunk_uid").groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_hits"), F.avg("score").alias("_mean"),
        F.array_sort(F.collect_list(F.struct("rank", "title", "text"))).alias("_h"))
    out = c.join(h, id_col, "left").withColumn("_context", F.array_join(F.transform("_h", lambda x: x["text"]), "\n"))
    risk = RK.rag_risk("_claim", "n_hits", "_mean", "_context")
    titles = F.transform("_h", lambda x: F.coalesce(x["title"], F.lit("Unknown")))
    return out.select(id_col, risk.alias("rag"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                      F.coalesce(F.slice(titles, 1, 3), F.array()).alias("relevant_standards"))


def analyze(claims: DataFrame, tables: Published, id_col: str = "claim_id", text: str = "esg_claim_text") -> DataFrame:
    """Every claim with its model, text and retrieval risk, their blend, level, alert and recommendations.

    Ids are unique; a null text is analysed as the text rules say (no text or retrieval risk, so no blend).  ``model_version`` names the
    tables used.
    """
    claims = written(claims, "analysis-claims")
    risk = model_risk(claims, tables, id_col).join(retrieval_risk(claims, tables, id_col, text), id_col)
    texts = RK.analyze_claims(claims.select(id_col, text).join(risk, id_col), text, gb="gb", lr="lr", rag="rag")
    six = ("greenwashing_risk_gb", "greenwashing_risk_lr", "text_risk_score", "rag_risk_score", "overall_risk_score")
    return texts.select(F.col(id_col).alias("claim_id"), *[F.round(c, 6).alias(c) for c in six], "risk_level", "fraud_alert",
                        F.concat_ws("|", "recommendations").alias("recommendations"), "n_hits",
                        F.concat_ws("|", "relevant_standards").alias("relevant_standards"), F.lit(tables.version).alias("model_version"))


def stream_analysis(source: DataFrame, folder: str, out: str, checkpoint: str, id_col: str = "claim_id", text: str = "esg_claim_text",
                    prepare=None, trigger: dict | None = None):
    """K1 over the whole analysis: every micro-batch is analysed with the newest published version and written to
    ``out/batch=N`` in overwrite mode, so a batch that runs again after a failure replaces its own rows.  ``prepare``
    turns a batch into the columns the features need.  Returns the started query.
    """
    spark = source.sparkSession

    def score(batch: DataFrame, number: int) -> None:
        tables = latest(spark, folder)
        analyze(prepare(batch) if prepare else batch, tables, id_col, text).write.mode("overwrite").parquet(os.path.join(out, f"batch={number}"))

    return source.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
