"""Data-quality profile and cleaning.

Profiles are computed in single scans (one ``agg`` with many expressions) and
reshaped to tall tables with ``stack``-style explode of a literal-sized array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.functions.stats import quantiles_wide
from claimlens.functions.text import py_strip, word_count
from claimlens.session import materialize, written

R = 6

# Expected claim columns and their types.
CLAIMS_SCHEMA = T.StructType([
    T.StructField("project_id", T.StringType()),
    T.StructField("organization_name", T.StringType()),
    T.StructField("report_year", T.LongType()),
    T.StructField("esg_claim_text", T.StringType()),
    T.StructField("claim_category", T.StringType()),
    T.StructField("claimed_metric_type", T.StringType()),
    T.StructField("claimed_value", T.DoubleType()),
    T.StructField("measurement_unit", T.StringType()),
    T.StructField("project_location", T.StringType()),
    T.StructField("actual_measured_value", T.DoubleType()),
    T.StructField("value_deviation", T.DoubleType()),
    T.StructField("external_validation_score", T.DoubleType()),
    T.StructField("greenwashing_flag", T.IntegerType()),
    T.StructField("controversy_flag", T.IntegerType()),
    T.StructField("source_doc_link", T.StringType()),
    T.StructField("report_sentiment_score", T.DoubleType()),
    T.StructField("llm_claim_consistency_score", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
])
NUMERIC_COERCE = ["claimed_value", "actual_measured_value", "value_deviation",
                  "external_validation_score", "llm_claim_consistency_score"]
FLAG_COLS = ["greenwashing_flag", "controversy_flag"]
EMPTY_TEXT = "No claim text provided"


def _is_missing(df: DataFrame, c: str):
    col = F.col(f"`{c}`")
    if dict(df.dtypes)[c] in ("double", "float"):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def schema_report(spark: SparkSession, df: DataFrame, expected: T.StructType = CLAIMS_SCHEMA) -> DataFrame:
    """B1 + B2: (column, status, expected_type, actual_type); status missing / extra / type_mismatch / ok.

    Works on the schema only (no data scan).
    """
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    exp = {f.name: f.dataType.simpleString() for f in expected.fields}
    rows = []
    for name, t in exp.items():
        if name not in actual:
            rows.append((name, "missing", t, None))
        else:
            rows.append((name, "ok" if actual[name] == t else "type_mismatch", t, actual[name]))
    rows += [(name, "extra", None, t) for name, t in actual.items() if name not in exp]
    schema = "column string, status string, expected_type string, actual_type string"
    return spark.createDataFrame(rows, schema)


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column missing count, missing %, completeness % (one scan, tall output)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(_is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    tall = row.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(cols)])).alias("e"))
    pct = F.round(F.col("e.missing_count") * 100.0 / F.col("_n"), R)
    return tall.select(F.col("e.column").alias("column"), F.col("e.missing_count").alias("missing_count"),
                       pct.alias("missing_pct"), F.round(100.0 - pct, R).alias("completeness_pct"))


DIGEST = "_row_digest"


def row_digest(df: DataFrame, cols: Sequence[str] | None = None) -> Column:
    """SHA-256 of the values of a row: rows that are equal in ``cols`` share it (NULLs are equal, as
    are 0.0 and -0.0), so whole texts need no shuffle to be compared."""
    types = dict(df.dtypes)

    def plain(c):
        x = F.col(f"`{c}`")
        if types[c] in ("double", "float"):
            return F.when(x == 0, F.lit("0.0")).otherwise(x.cast("string"))
        if types[c].startswith(("array", "struct", "map")):
            return F.to_json(F.struct(x))
        return F.hex(x) if types[c] == "binary" else x.cast("string")

    return F.sha2(F.to_json(F.array(*[plain(c) for c in cols or df.columns])), 256)


def duplicate_count(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Number of *extra* copies over all columns or over ``key`` (NULLs compare equal)."""
    g = df.select(row_digest(df, key).alias(DIGEST)).groupBy(DIGEST).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
                 F.count(F.lit(1)).alias("distinct_rows"))


def table_profile(df: DataFrame) -> DataFrame:
    """Rows, columns, total missing cells and full-row duplicates in one row, from one pass over
    the table; rows are compared by digest."""
    cols = df.columns
    missing = sum((F.when(_is_missing(df, c), 1).otherwise(0) for c in cols), F.lit(0))
    rows = df.select(row_digest(df).alias(DIGEST), missing.cast("bigint").alias("_missing"))
    g = rows.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("_c"), F.sum("_missing").alias("_m"))
    return g.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_cells"),
                 F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicate_rows")).select(
        "n_rows", F.lit(len(cols)).alias("n_columns"), "missing_cells", "duplicate_rows")


def dedupe(df: DataFrame) -> DataFrame:
    """Full-row duplicate removal; NULLs are equal, as are 0.0 and -0.0.  The rows are evaluated once and shuffled once, behind a
    task's own copies; rows with nested values are compared by digest."""
    types, at = dict(df.dtypes), {c: F.col(f"`{c}`") for c in df.columns}
    if any(t.startswith(("array", "struct", "map")) for t in types.values()):
        return df.withColumn(DIGEST, row_digest(df)).dropDuplicates([DIGEST]).drop(DIGEST)
    floats = {c: f"_float_{i}" for i, c in enumerate(df.columns) if types[c] in ("double", "float")}
    if not floats:
        return df.dropDuplicates()
    zero = lambda c: F.when(at[c] == 0, F.lit(0.0).cast(types[c])).otherwise(at[c])
    rows = df.select(*[zero(c).alias(c) if c in floats else at[c] for c in df.columns], *[at[c].alias(n) for c, n in floats.items()])
    one = rows.groupBy(*at.values()).agg(*[F.first(n).alias(n) for n in floats.values()])
    return one.select(*[F.col(floats[c]).alias(c) if c in floats else at[c] for c in df.columns])


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C4: count, mean, sample std, min, exact 25/50/75 % and max per column (tall)."""
    df = written(df.select(*cols), "describe")  # evaluated once
    aggs = []
    for c in cols:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        aggs += [F.count(x).alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"), F.stddev_samp(x).alias(f"{c}|std"),
                 F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
    moments = df.agg(*aggs)
    moments = moments.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"`{c}|count`").alias("count"), F.col(f"`{c}|mean`").alias("mean"),
        F.col(f"`{c}|std`").alias("std"), F.col(f"`{c}|min`").alias("min"), F.col(f"`{c}|max`").alias("max"))
        for c in cols])).alias("e")).select("e.*")
    qw = quantiles_wide(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    out = moments.join(qw, "column", "left")
    return out.select("column", "count", *[F.round(c, R).alias(c) for c in
                                           ["mean", "std", "min", "q25", "q50", "q75", "max"]])


def clean_claims(df: DataFrame, text: str = "esg_claim_text", strict: bool = True) -> DataFrame:
    """B3-B6 + D1: parse timestamp, coerce numerics, flags to int, strip text, dedupe.

    ``strict`` raises on a NULL flag (naming the column) and on a timestamp that cannot be read; otherwise both are NULL.
    """
    types, out = dict(df.dtypes), df
    if types.get("timestamp") == "string":
        out = out.withColumn("timestamp", F.to_timestamp("timestamp") if strict else F.try_to_timestamp("timestamp"))
    out = out.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in NUMERIC_COERCE if c in types})
    flags = [c for c in FLAG_COLS if c in types]
    if strict:
        out = out.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"NULL in flag column {c}")))
                               .otherwise(F.col(c).cast("int")) for c in flags})
    else:
        out = out.withColumns({c: F.col(c).cast("int") for c in flags})
    if text in types:
        out = out.withColumn(text, py_strip(text))
    return dedupe(out)


def cleaning_report(raw: DataFrame, text: str = "esg_claim_text") -> DataFrame:
    """What ``clean_claims`` does to a table, in one row and one pass: rows before and after, rows removed, NULLs per flag column, values of
    numeric columns that are no number, texts changed by stripping."""
    types = dict(raw.dtypes)
    clean = {c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in NUMERIC_COERCE if c in types}
    clean |= {c: F.col(c).cast("int") for c in FLAG_COLS if c in types}
    if text in types:
        clean[text] = py_strip(text)
    out = raw.select(*[clean.get(c, F.col(c)).alias(c) for c in raw.columns], *[F.col(c).alias(f"_raw_{c}") for c in clean])
    marks = {f"null_{c}": F.col(c).isNull() for c in FLAG_COLS if c in types}
    marks |= {f"bad_{c}": F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull() for c in NUMERIC_COERCE if c in types}
    if text in types:
        marks["stripped"] = F.col(text) != F.col(f"_raw_{text}")
    rows = out.select(row_digest(out, raw.columns).alias(DIGEST), *[m.alias(n) for n, m in marks.items()])
    g = rows.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("_c"), *[F.count_if(n).alias(n) for n in marks])
    n = F.coalesce(F.sum("_c"), F.lit(0))
    return g.agg(n.alias("rows_before"), F.count(F.lit(1)).alias("rows_after"), (n - F.count(F.lit(1))).alias("rows_removed"),
                 *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in marks])


def clean_text_quality(df: DataFrame, text: str = "esg_claim_text", min_len: int = 10) -> DataFrame:
    """Strip, NULL -> placeholder text, keep texts of at least ``min_len`` characters."""
    t = F.coalesce(py_strip(text), F.lit(EMPTY_TEXT))
    return df.withColumn(text, t).where(F.length(text) >= min_len)


def length_bands(df: DataFrame, text: str = "esg_claim_text", short: int = 50, long: int = 500) -> DataFrame:
    """Counts of texts shorter than ``short`` and longer than ``long`` characters."""
    n = F.length(text)
    return df.agg(F.count_if(n < short).alias("n_short"), F.count_if(n > long).alias("n_long"),
                  F.count(F.lit(1)).alias("n_rows"))


def length_band_samples(df: DataFrame, id_col: str, text: str = "esg_claim_text", short: int = 50, long: int = 500, k: int = 3) -> DataFrame:
    """The first ``k`` texts (by id) shorter than ``short`` and longer than ``long`` characters: (band, rank, id, length, text)."""
    n = F.length(text)
    band = F.when(n < short, F.lit("short")).when(n > long, F.lit("long"))
    # ids and lengths are ranked; texts are fetched for the k rows of a band only
    first = df.select(F.col(id_col), band.alias("band"), n.alias("length")).where("band is not null")
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy(id_col))).where(F.col("rank") <= k)
    return df.select(id_col, text).join(F.broadcast(first), id_col).select("band", "rank", id_col, "length", text)  # 2 k rows


def quality_record(raw: DataFrame, text: str = "esg_claim_text", flag: str = "greenwashing_flag") -> DataFrame:
    """The cleaning summary record (rows before/after, removed, missing, text stats,
    distinct organisations/locations, category distribution, flag rate)."""
    # one pass over the table: rows become their digest, the length of the cleaned text, missing cells
    # and the few columns that are counted; the rest reads this written table of distinct rows
    cols = raw.columns
    cells = lambda names: sum((F.when(_is_missing(raw, c), 1).otherwise(0) for c in names), F.lit(0)).cast("bigint")
    cleaned = F.coalesce(py_strip(text), F.lit(EMPTY_TEXT))
    counted = ["organization_name", "project_location", "claim_category", flag]
    narrow = raw.select(row_digest(raw).alias(DIGEST), F.length(cleaned).alias("_length"), cells(cols).alias("_missing"),
                        cells([c for c in cols if c != text]).alias("_missing_clean"), *counted)
    rows = materialize(narrow.groupBy(DIGEST).agg(F.count(F.lit(1)).alias("_c"), *[
        F.first(c).alias(c) for c in narrow.columns if c != DIGEST]))
    kept = F.col("_length") >= 10
    one = lambda c: F.when(kept, F.col(c))
    total = rows.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("original_rows"), F.count_if(kept).alias("cleaned_rows"),
        F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("duplicates_removed"),
        F.sum(F.col("_missing") * F.col("_c")).alias("missing_values_original"),
        F.sum(one("_missing_clean")).alias("missing_values_cleaned"),
        F.min(one("_length")).alias("text_length_min"), F.max(one("_length")).alias("text_length_max"),
        F.round(F.avg(one("_length")), R).alias("text_length_mean"), F.round(F.avg(one(flag)), R).alias("greenwashing_rate"))
    clean = rows.where(kept)
    distinct = lambda c, name: clean.select(c).distinct().agg(F.count(c).alias(name))
    cat = clean.where(F.col("claim_category").isNotNull()).groupBy("claim_category").agg(F.count(F.lit(1)).alias("n"))
    dist = cat.agg(F.concat_ws(",", F.array_sort(F.collect_list(
        F.concat(F.col("claim_category"), F.lit("="), F.col("n").cast("string"))))).alias("category_distribution"))
    return (total.crossJoin(distinct("organization_name", "unique_organizations"))
            .crossJoin(distinct("project_location", "unique_locations")).crossJoin(dist)
            .select("original_rows", "cleaned_rows",
                    (F.col("original_rows") - F.col("cleaned_rows")).alias("rows_removed"), "duplicates_removed",
                    "missing_values_original", "missing_values_cleaned", "text_length_min", "text_length_max",
                    "text_length_mean", "unique_organizations", "unique_locations", "category_distribution",
                    "greenwashing_rate"))


def text_stats(df: DataFrame, text: str = "esg_claim_text") -> DataFrame:
    """Text length and word count columns (quality-script form: NULL stays NULL)."""
    t = F.col(text)
    return df.withColumns({"text_length": F.length(t),
                           "word_count": F.when(t.isNotNull(), word_count(t))})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bad values become NULL (``try_cast``)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})

