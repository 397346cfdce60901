"""Engineered claim features (B8-B17, B21) as one projection over the claims table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.stats import prefix_sums
from claimlens.functions.text import char_count, word_count
from claimlens.session import materialize

# The feature contract, 17 numeric names in the reference's order.
FEATURE_CONTRACT = [
    "report_year", "claimed_value", "actual_measured_value", "value_deviation",
    "external_validation_score", "controversy_flag",
    "llm_claim_consistency_score", "text_length", "word_count",
    "deviation_abs", "deviation_pct", "avg_score", "year", "month",
    "claim_category_encoded", "claimed_metric_type_encoded", "project_location_encoded",
]
SCORE_COLS = ["external_validation_score", "report_sentiment_score", "llm_claim_consistency_score"]
CATEGORICAL_COLS = ["claim_category", "claimed_metric_type", "project_location"]


def deviation_pct(deviation: Column, claimed: Column) -> Column:
    """(deviation / claimed) * 100 with claimed = 0 or NULL -> 0 (never raises under ANSI)."""
    return F.coalesce(F.try_divide(deviation, F.nullif(claimed, F.lit(0.0))), F.lit(0.0)) * 100


def row_mean_present(cols: Sequence[str]) -> Column:
    """Mean of the non-null values among ``cols``; 0 when all are NULL."""
    present = F.filter(F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]),
                       lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(present) > 0, total / F.size(present)).otherwise(F.lit(0.0))


def text_features(df: DataFrame, text: str = "esg_claim_text") -> DataFrame:
    """B8 + B17: chars, whitespace words, average word length (chars without spaces / words)."""
    wc = word_count(text)
    return df.withColumns({
        "text_length": char_count(text),
        "word_count": wc,
        "avg_word_length": F.when(wc > 0, F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))) / wc)
                            .otherwise(F.lit(0.0)),
    })


def value_features(df: DataFrame) -> DataFrame:
    """B9 + B10: deviation magnitude and percentage; absolute/relative value gap."""
    gap = F.abs(F.col("claimed_value") - F.col("actual_measured_value"))
    return df.withColumns({
        "deviation_abs": F.coalesce(F.abs("value_deviation"), F.lit(0.0)),
        "deviation_pct": deviation_pct(F.col("value_deviation"), F.col("claimed_value")),
        "abs_value_deviation": gap,
        "rel_value_deviation": gap / (F.abs("claimed_value") + F.lit(1e-6)),
    })


#: Distinct values that one window may rank.
FEW_VALUES = 100_000


def code_table(df: DataFrame, col: str) -> DataFrame:
    """0-based code of each distinct value in ascending string order (NULL -> 'nan').

    Only the *distinct* values are ranked (a categorical's domain): in one window when a count proves them
    few, with distributed running counts otherwise.
    """
    v = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    d = materialize(df.select(v.alias("_value")).distinct())
    if d.count() > FEW_VALUES:
        ranked = prefix_sums(d.withColumn("_one", F.lit(1)), "_value", ["_one"])
        return ranked.select("_value", (F.col("cum__one") - 1).cast("int").alias(f"{col}_encoded"))
    return d.select("_value", (F.row_number().over(Window.orderBy("_value")) - 1).alias(f"{col}_encoded"))


def label_encode(df: DataFrame, cols: Sequence[str] = CATEGORICAL_COLS,
                 tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Join each categorical to its code table (fit on ``df`` unless ``tables`` are given).

    The code tables are joined without a hint: AQE broadcasts them when their
    measured size is under the broadcast threshold and shuffles otherwise.
    """
    out = df
    for c in cols:
        t = (tables or {}).get(c)
        if t is None:
            t = code_table(df, c)
        key = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        out = out.withColumn("_value", key).join(t, "_value", "left").drop("_value")
    return out


def engineer_features(df: DataFrame, text: str = "esg_claim_text",
                      code_tables: dict[str, DataFrame] | None = None,
                      defaults: dict[str, float] | None = None) -> DataFrame:
    """Full feature projection; absent contract columns are added as literals.

    ``defaults`` plays the role of the stored median table for single-claim scoring;
    it is an explicit argument, never chosen by counting rows.
    """
    out = text_features(df, text) if text in df.columns else df
    if "value_deviation" in out.columns and "claimed_value" in out.columns:
        out = out.withColumns({
            "deviation_abs": F.coalesce(F.abs("value_deviation"), F.lit(0.0)),
            "deviation_pct": deviation_pct(F.col("value_deviation"), F.col("claimed_value")),
        })
    present = [c for c in SCORE_COLS if c in out.columns]
    if present:
        out = out.withColumn("avg_score", row_mean_present(present))
    if "timestamp" in out.columns:
        ts = F.col("timestamp")
        if dict(out.dtypes)["timestamp"] == "string":
            ts = F.try_to_timestamp(ts)
        out = out.withColumns({"year": F.coalesce(F.year(ts), F.lit(0)),
                               "month": F.coalesce(F.month(ts), F.lit(0))})
    cats = [c for c in CATEGORICAL_COLS if c in out.columns]
    if cats:
        out = label_encode(out, cats, code_tables)
    defaults = defaults or {}
    missing = {c: F.lit(float(defaults.get(c, 0))) for c in FEATURE_CONTRACT if c not in out.columns}
    return out.withColumns(missing) if missing else out


def align_to_contract(df: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """B14 with a stored one-row median table: add each missing contract column from it."""
    missing = [c for c in FEATURE_CONTRACT if c not in df.columns]
    if not missing:
        return df
    if medians is None:
        return df.withColumns({c: F.lit(0.0) for c in missing})
    have = [c for c in missing if c in medians.columns]
    m = medians.select(*have)
    out = df.crossJoin(F.broadcast(m))  # one row: proven size bound
    rest = [c for c in missing if c not in have]
    return out.withColumns({c: F.lit(0.0) for c in rest}) if rest else out


def fill_by_kind(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                 target: str | None = None) -> DataFrame:
    """Add absent categorical columns as 'Unknown', numeric as 0.0; absent target raises."""
    if target and target not in df.columns:
        raise ValueError(f"target column {target!r} is missing")
    add = {c: F.lit("Unknown") for c in categorical if c not in df.columns}
    add.update({c: F.lit(0.0) for c in numeric if c not in df.columns})
    return df.withColumns(add) if add else df


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the rows in which every named feature and target has a value (NaN is none)."""
    return df.na.drop("any", subset=list(columns))


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
           medians: DataFrame) -> DataFrame:
    """Numeric NULL -> column median (from a one-row median table), string NULL -> 'unknown'."""
    m = medians.select(*[F.col(c).alias(f"_med_{c}") for c in numeric])
    out = df.crossJoin(F.broadcast(m))
    out = out.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")),
                                         F.col(f"_med_{c}")) for c in numeric})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in categorical})
    return out.drop(*[f"_med_{c}" for c in numeric])


def task_projection(df: DataFrame, task: str) -> DataFrame:
    """Drop identifiers and text; the target goes to the ``label`` column."""
    excluded = ["esg_claim_text", "project_id", "organization_name", "source_doc_link", "timestamp"]
    if task == "category":
        target = "claim_category"
    elif task == "greenwash":
        target = "greenwashing_flag"
    else:
        raise ValueError("Task must be either 'category' or 'greenwash'")
    keep = [c for c in df.columns if c not in excluded and c != target]
    return df.select(*keep, F.col(target).alias("label"))
