"""Sources and sinks.

All readers take an explicit schema where one is known (no inference passes) and
all writers go through ``DataFrameWriter`` (atomic job commit, overwrite or
append), so outputs survive task retries.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.operators.quality import CLAIMS_SCHEMA

CLAIMS_CSV_SCHEMA = T.StructType([T.StructField(f.name, T.StringType() if f.name == "timestamp" else f.dataType)
                                  for f in CLAIMS_SCHEMA.fields])

CORPUS_SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("content", T.StringType()),
                              T.StructField("tags", T.ArrayType(T.StringType()))])
PROCESSED_CORPUS_SCHEMA = T.StructType([T.StructField("title", T.StringType()),
                                        T.StructField("chunks", T.ArrayType(T.StringType())),
                                        T.StructField("tags", T.ArrayType(T.StringType())),
                                        T.StructField("original_content", T.StringType())])


def load_claims(spark: SparkSession, path: str, schema: T.StructType | None = CLAIMS_CSV_SCHEMA, multi_line: bool = True) -> DataFrame:
    """A1: load a claims file by suffix: ``.csv`` (header, explicit schema) or ``.parquet``; else ValueError.

    Quoted texts may hold line breaks, so a CSV file is read whole by one task; ``multi_line=False`` says that none does
    and lets large files be split.
    """
    p = path.lower().rstrip("/")
    if p.endswith(".csv"):
        r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    if p.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format: {path}")


def require_text_column(df: DataFrame, column: str = "esg_claim_text") -> DataFrame:
    """A2: an uploaded batch must carry the claim-text column."""
    if column not in df.columns:
        raise ValueError(f"CSV must contain a '{column}' column. Available columns: {', '.join(df.columns)}")
    return df


def read_corpus(spark: SparkSession, path: str, processed: bool = False, array: bool = True) -> DataFrame:
    """A4: corpus JSON documents: a top-level array of objects (a file a task), or with ``array=False`` an object a line, whose
    files can be split."""
    schema = PROCESSED_CORPUS_SCHEMA if processed else CORPUS_SCHEMA
    return spark.read.option("multiLine", array).schema(schema).json(path)


def corpus_union(named: dict[str, DataFrame]) -> DataFrame:
    """A5 + D3: union corpora (bag union) with ``source`` and ``date_added`` metadata."""
    out = None
    for source, df in named.items():
        d = df.withColumns({"source": F.lit(source), "date_added": F.current_timestamp()})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """Write a table (parquet by default), optionally partitioned (e.g. by ``report_year``)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A (small) metrics record as JSON lines; one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Results with a header row; arrays are joined into text first."""
    cols = [F.concat_ws("|", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
            for f in df.schema.fields]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def export_workbook(results: DataFrame, summary: DataFrame, path: str) -> None:
    """A10 (re-aimed): the two workbook sheets as two datasets ``results/`` and ``summary/``."""
    export_csv(results, os.path.join(path, "results"))
    export_csv(summary, os.path.join(path, "summary"))


def medians_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table of exact medians, written at training and read at inference."""
    from claimlens.functions.stats import column_quantiles
    q = column_quantiles(df, cols, [0.5])
    return q.agg(*[F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in cols])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def vector_store(spark: SparkSession, path: str, build) -> DataFrame:
    """Reuse the chunk+vector table at ``path`` if present, else build it with ``build()`` and save.  A
    store that is there but cannot be read raises; it is never written over."""
    if not _exists(spark, path):
        write_table(build(), path, mode="errorifexists")
    return spark.read.parquet(path)


def append_documents(store_path: str, chunks: DataFrame) -> None:
    """Append the chunks the store does not hold yet; ids are content hashes, so a chunk appended
    again, or twice in one call, is stored once."""
    spark = chunks.sparkSession
    out = chunks.withColumn("chunk_uid", F.sha2(F.to_json(F.array("title", "text")), 256)).dropDuplicates(["chunk_uid"])
    if _exists(spark, store_path):
        out = out.join(spark.read.parquet(store_path).select("chunk_uid"), "chunk_uid", "left_anti")
    write_table(out, store_path, mode="append")
