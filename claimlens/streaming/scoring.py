"""K1: stateless scoring of an arriving stream of claims (Structured Streaming).

The stream applies the same expression-only transform as the batch path, so no
state, watermark or shuffle is involved; every micro-batch is scored in place
and appended to a parquet sink (exactly-once through the sink's commit log and
the query checkpoint in the shared checkpoint folder).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.operators import risk as RK
from claimlens.session import checkpoint_dir


def score_claims(df: DataFrame, id_col: str, text: str, category: str | None = None,
                 v2_lexicon: dict | None = None) -> DataFrame:
    """The per-claim score projection shared by batch and stream."""
    a = RK.analyze_claims(df.select(id_col, text, *([category] if category else [])), text, v2_lexicon=v2_lexicon)
    return a.select(F.col(id_col).alias("claim_id"),
                    F.round("text_risk_score", 6).alias("text_risk_score"),
                    F.round("rag_risk_score", 6).alias("rag_risk_score"),
                    F.round("overall_risk_score", 6).alias("overall_risk_score"),
                    "risk_level", "fraud_alert",
                    F.concat_ws("|", "recommendations").alias("recommendations"))


def stream_score(spark: SparkSession, source_dir: str, schema, id_col: str, text: str,
                 out_dir: str | None = None, max_files: int = 100, v2_lexicon: dict | None = None,
                 file_glob: str | None = None) -> str:
    """Run the scoring stream over every file available now in ``source_dir`` (optionally only the
    files matching ``file_glob``); returns the output folder."""
    base = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    out_dir = out_dir or os.path.join(base, "out")
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    src = r.parquet(source_dir)
    q = (score_claims(src, id_col, text, v2_lexicon=v2_lexicon).writeStream.format("parquet")
         .option("checkpointLocation", os.path.join(base, "checkpoint")).outputMode("append")
         .trigger(availableNow=True).start(out_dir))
    q.awaitTermination()
    return out_dir
