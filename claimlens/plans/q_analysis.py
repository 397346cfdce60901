"""Whole claim analysis as a batch and as a stream (H14, H3, K1): trained models and the retrieval corpus, so no SQL oracle."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from claimlens.operators import analysis as AN
from claimlens.operators import models as M
from claimlens.plans.q_models import CATS, NUMS, TEXT, _part, labelled, stages
from claimlens.plans.q_retrieval import corpus_chunks
from claimlens.plans.registry import register
from claimlens.session import checkpoint_dir
from claimlens.sources.claims import claims_txt


def _claims(spark, sf):
    return M.prepare(claims_txt(spark, sf), NUMS, CATS, "greenwashing_flag", TEXT).select("claim_id", TEXT, *CATS, *NUMS)


def _published(spark, sf) -> str:
    """A folder with one version, fitted on the training part of the labelled claims."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/analysis-{uuid.uuid4().hex}"
    AN.publish(_part(labelled(spark, sf), "train"), stages(), corpus_chunks(spark, sf), folder)
    return folder


def _batch(spark, sf):
    """Model, text and retrieval risk of every claim."""
    return AN.analyze(_claims(spark, sf), AN.latest(spark, _published(spark, sf)))


def _stream(spark, sf):
    """The same analysis over the claims as arriving files."""
    folder = _published(spark, sf)
    arriving, out = os.path.join(folder, "arriving"), os.path.join(folder, "out")
    claims = _claims(spark, sf)
    claims.repartition(4, "claim_id").write.parquet(arriving)
    source = spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    AN.stream_analysis(source, folder, out, os.path.join(folder, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("int"))


register("claim_analysis")(_batch)
register("stream_claim_analysis")(_stream)
