"""Claim tables derived from the driver's star schema.

The claim schema has 18 columns (see ``claimlens.schema``).  Two derived views
feed every query:

* ``claims_txt`` - one claim per document: prose text, a language as category,
  order/customer/nation attributes as claimed value, location and metric type,
  and the measured value summed from the order's line items.
* ``claims_num`` - one claim per line item: short text, numeric scores and dates
  for numeric, temporal and group statistics.

Both are plain joins + projections; Catalyst prunes the unused columns, so a query
that needs three claim columns reads only the parquet columns behind them.  Queries
that score texts do so before the joins (``measure``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.sources.tables import Tables


#: claim columns that only the labels, or only the line items, can give
LABEL_COLUMNS = {"greenwashing_flag", "controversy_flag"}
MEASURED_COLUMNS = {"actual_measured_value", "value_deviation"}


def _measured_by_order(lineitem: DataFrame, keys: DataFrame) -> DataFrame:
    """Sum of discounted line prices per order, for the orders in ``keys`` only.

    The semi join shuffles line items by order key once; the aggregate and the
    later join to the documents reuse that partitioning.
    """
    li = lineitem.select("l_orderkey", "l_extendedprice", "l_discount")
    li = li.join(keys.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    return li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("actual_measured_value"))


def claims_txt(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None,
               measure: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The document claims: all their columns, or ``columns`` and only the joins these need.

    ``measure`` is applied to the documents before any join (their text is ``esg_claim_text``) and
    adds columns to the view, so that scores of a text travel through the joins and not the text;
    it may drop the text.  Order, customer and nation attributes are joined with each other first,
    without texts: a row of a document takes part in one join.
    """
    t = Tables(spark, sf_dir)
    ids = t.documents.select("doc_id")
    wanted = set(columns) if columns else None
    needs = lambda group: wanted is None or bool(wanted & group)
    side = (t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
            .join(ids.withColumnRenamed("doc_id", "o_orderkey"), "o_orderkey", "left_semi")
            .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")))
    if needs(LABEL_COLUMNS):
        side = side.join(t.labels.withColumnRenamed("doc_id", "_label_id"), F.col("o_orderkey") == F.col("_label_id"), "left")
    if needs(MEASURED_COLUMNS):
        side = side.join(_measured_by_order(t.lineitem, ids), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    d = t.documents.select("doc_id", "source", "lang", F.col("text").alias("esg_claim_text"))
    plain = set(d.columns)
    d = measure(d) if measure else d
    df = d.join(side, F.col("doc_id") == F.col("o_orderkey"))
    made = {
        "claim_id": F.col("doc_id"),
        "project_id": F.concat(F.lit("D"), F.col("doc_id").cast("string")),
        "organization_name": F.col("source"),
        "report_year": F.year("o_orderdate").cast("bigint"),
        "esg_claim_text": F.col("esg_claim_text") if "esg_claim_text" in d.columns else None,
        "claim_category": F.col("lang"),
        "claimed_metric_type": F.col("o_orderpriority"),
        "claimed_value": F.col("o_totalprice"),
        "measurement_unit": F.col("c_mktsegment"),
        "project_location": F.col("n_name"),
        "actual_measured_value": F.col("actual_measured_value") if needs(MEASURED_COLUMNS) else None,
        "value_deviation": F.col("actual_measured_value") - F.col("o_totalprice") if needs(MEASURED_COLUMNS) else None,
        "external_validation_score": F.col("c_acctbal"),
        "greenwashing_flag": (1 - F.col("quality")).cast("int") if needs(LABEL_COLUMNS) else None,
        "controversy_flag": F.col("toxic").cast("int") if needs(LABEL_COLUMNS) else None,
        "source_doc_link": F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")),
        "report_sentiment_score": F.lit(None).cast("double"),
        "llm_claim_consistency_score": F.lit(None).cast("double"),
        "timestamp": F.col("o_orderdate"),
    }
    out = [c.alias(n) for n, c in made.items() if c is not None and (wanted is None or n in wanted)]
    return df.select(*out, *[c for c in d.columns if c not in plain])


def claims_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    df = (t.lineitem
          .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
          .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
          .join(t.part, F.col("l_partkey") == F.col("p_partkey")))
    measured = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return df.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("project_id"),
        F.col("s_name").alias("organization_name"),
        F.year("l_shipdate").cast("bigint").alias("report_year"),
        F.col("p_name").alias("esg_claim_text"),
        F.col("l_returnflag").alias("claim_category"),
        F.col("p_type").alias("claimed_metric_type"),
        F.col("l_extendedprice").alias("claimed_value"),
        F.col("p_brand").alias("measurement_unit"),
        F.col("n_name").alias("project_location"),
        measured.alias("actual_measured_value"),
        (measured - F.col("l_extendedprice")).alias("value_deviation"),
        F.col("l_quantity").alias("external_validation_score"),
        (F.col("l_linestatus") == "F").cast("int").alias("greenwashing_flag"),
        (F.col("l_discount") >= 0.05).cast("int").alias("controversy_flag"),
        F.concat(F.lit("part://"), F.col("p_partkey").cast("string")).alias("source_doc_link"),
        F.col("l_tax").alias("report_sentiment_score"),
        F.col("l_discount").alias("llm_claim_consistency_score"),
        F.col("l_shipdate").alias("timestamp"),
    )


# DuckDB / ANSI SQL of the same two views, used by the oracle.
CLAIMS_TXT_SQL = """
SELECT d.doc_id AS claim_id, 'D' || CAST(d.doc_id AS VARCHAR) AS project_id,
       d.source AS organization_name, CAST(year(o.o_orderdate) AS BIGINT) AS report_year,
       d.text AS esg_claim_text, d.lang AS claim_category, o.o_orderpriority AS claimed_metric_type,
       o.o_totalprice AS claimed_value, c.c_mktsegment AS measurement_unit, n.n_name AS project_location,
       m.actual_measured_value, m.actual_measured_value - o.o_totalprice AS value_deviation,
       c.c_acctbal AS external_validation_score, CAST(1 - l.quality AS INTEGER) AS greenwashing_flag,
       CAST(l.toxic AS INTEGER) AS controversy_flag,
       'doc://' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS source_doc_link,
       CAST(NULL AS DOUBLE) AS report_sentiment_score, CAST(NULL AS DOUBLE) AS llm_claim_consistency_score,
       o.o_orderdate AS "timestamp"
FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id
JOIN orders o ON d.doc_id = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS actual_measured_value
           FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = d.doc_id
"""

CLAIMS_NUM_SQL = """
SELECT li.l_orderkey * 8 + li.l_linenumber AS claim_id,
       CAST(li.l_orderkey AS VARCHAR) || '-' || CAST(li.l_linenumber AS VARCHAR) AS project_id,
       s.s_name AS organization_name, CAST(year(li.l_shipdate) AS BIGINT) AS report_year,
       p.p_name AS esg_claim_text, li.l_returnflag AS claim_category, p.p_type AS claimed_metric_type,
       li.l_extendedprice AS claimed_value, p.p_brand AS measurement_unit, n.n_name AS project_location,
       li.l_extendedprice * (1 - li.l_discount) AS actual_measured_value,
       li.l_extendedprice * (1 - li.l_discount) - li.l_extendedprice AS value_deviation,
       li.l_quantity AS external_validation_score,
       CAST(li.l_linestatus = 'F' AS INTEGER) AS greenwashing_flag,
       CAST(li.l_discount >= 0.05 AS INTEGER) AS controversy_flag,
       'part://' || CAST(p.p_partkey AS VARCHAR) AS source_doc_link,
       li.l_tax AS report_sentiment_score, li.l_discount AS llm_claim_consistency_score,
       li.l_shipdate AS "timestamp"
FROM lineitem li
JOIN supplier s ON li.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN part p ON li.l_partkey = p.p_partkey
"""
