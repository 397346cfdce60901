"""Exploratory aggregates over a claims table (one pass each, partial+final agg).

Group keys that are NULL are dropped, as ``value_counts``/``groupby`` do.  Shares
use a one-row total joined by broadcast (a single row is a proven size bound).
Every non-integer output is rounded to 6 decimals so engines agree bit-for-bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.stats import pearson_table, quantiles_wide
from claimlens.session import small, written

R = 6
FLAG = "greenwashing_flag"
EDA_NUMERIC = ["claimed_value", "actual_measured_value", "value_deviation", "external_validation_score",
               "report_sentiment_score", "llm_claim_consistency_score", "text_length", "word_count"]


def r6(c):
    return F.round(c, R)


def frequency(df: DataFrame, key: str) -> DataFrame:
    """Count and share (%) per key value, NULL key dropped."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .select(key, "n", r6(F.col("n") * 100.0 / F.col("_total")).alias("share_pct")))


def flag_rate_by(df: DataFrame, key: str, flag: str = FLAG) -> DataFrame:
    """Flag rate (mean) and count of non-null flags per key."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg(r6(F.avg(flag)).alias("flag_rate"), F.count(flag).alias("n_claims")))


def means_by_flag(df: DataFrame, cols: Sequence[str], flag: str = FLAG) -> DataFrame:
    """Mean of each column per flag value."""
    return (df.where(F.col(flag).isNotNull()).groupBy(flag)
            .agg(*[r6(F.avg(c)).alias(f"mean_{c}") for c in cols]))


def top_by_count(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent key values (ties by key ascending)."""
    return (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(key)).limit(k))


def rate_having(df: DataFrame, key: str, min_count: int = 3, k: int = 10, flag: str = FLAG) -> DataFrame:
    """C11: flag rate per key with at least ``min_count`` claims, top k by rate."""
    g = (df.where(F.col(key).isNotNull()).groupBy(key)
         .agg(F.count(F.lit(1)).alias("n"), r6(F.avg(flag)).alias("flag_rate")))
    return g.where(F.col("n") >= min_count).orderBy(F.desc("flag_rate"), F.asc(key)).limit(k)


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlations, tall form (a, b, corr); the source is read once."""
    cols = list(cols)
    df = written(df.select(*cols), "corr")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    # two scans of plain sums: the pairwise correlations and the per-column spread together
    row = pearson_table(df, pairs, cols)
    entries = []
    for a, b in pairs:
        v = r6(F.col(f"`{a}|{b}`"))
        entries += [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), v.alias("corr")),
                    F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), v.alias("corr"))]
    # the diagonal is 1 where the column has variance; pandas gives NaN for a constant column
    for c in cols:
        one = F.when(F.col(f"`ss|{c}`") > 0, F.lit(1.0))
        entries.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), one.alias("corr")))
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def corr_with_flag(df: DataFrame, cols: Sequence[str], flag: str = FLAG) -> DataFrame:
    """Correlation of each column with the flag, ranked descending (signed)."""
    row = pearson_table(df, [(c, flag) for c in cols])
    tall = row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), r6(F.col(f"`{c}|{flag}`")).alias("corr")) for c in cols])).alias("e")).select("e.*")
    # tall has one row per column: a bounded window
    return tall.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("corr"), "feature")))


def overview(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """Rows, min/max year, distinct organisations/locations, flag rate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.min("report_year").alias("min_year"), F.max("report_year").alias("max_year"),
                  F.count_distinct("organization_name").alias("n_orgs"),
                  F.count_distinct("project_location").alias("n_locations"),
                  r6(F.avg(flag)).alias("flag_rate"))


def trend_peak(df: DataFrame, flag: str = FLAG) -> DataFrame:
    """C15: 'increasing' iff the last year's rate exceeds the first's; peak = argmax rate (earliest)."""
    y = flag_rate_by(df, "report_year", flag)
    return y.agg(
        F.when(F.max_by("flag_rate", "report_year") > F.min_by("flag_rate", "report_year"),
               F.lit("increasing")).otherwise(F.lit("decreasing")).alias("trend"),
        F.min_by("report_year", F.struct((-F.col("flag_rate")).alias("neg"), F.col("report_year"))).alias("peak_year"),
        F.max("flag_rate").alias("peak_rate"),
        F.count(F.lit(1)).alias("n_years"))


def insights(df: DataFrame, cols: Sequence[str] = EDA_NUMERIC, flag: str = FLAG) -> DataFrame:
    """C14: one insight row.  The source is read once, into a narrow table; one aggregation by grouping sets gives the totals and the
    counts by category and organisation, and the correlations read the narrow table."""
    keys = ["claim_category", "organization_name"]
    d = written(df.select(*dict.fromkeys([*keys, "report_year", flag, "text_length", *cols])), "insights")
    by = d.groupingSets([["claim_category"], ["organization_name"], []], *keys).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"), r6(F.avg(flag)).alias("rate"),
        F.min("report_year").alias("min_year"), F.max("report_year").alias("max_year"), r6(F.avg("text_length")).alias("avg_text_length"))
    total, category = F.col("_set") == 3, (F.col("_set") == 1) & F.col("claim_category").isNotNull()
    of = lambda c: F.max(F.when(total, F.col(c))).alias(c)
    first = lambda v: F.min_by("claim_category", F.when(category, F.struct((-F.col(v)).alias("k"), "claim_category")))
    base = by.agg(F.coalesce(F.max(F.when(total, F.col("n"))), F.lit(0)).alias("n_rows"), F.max(F.when(total, F.col("rate"))).alias("flag_rate"), of("min_year"), of("max_year"),
                  F.count_if((F.col("_set") == 2) & F.col("organization_name").isNotNull()).alias("organizations"),
                  first("n").alias("most_common_category"), first("rate").alias("highest_flag_category"), of("avg_text_length"))
    corr = corr_with_flag(d, cols, flag)
    strongest = corr.agg(F.min_by("feature", "rank").alias("strongest_feature"), F.min_by("corr", "rank").alias("strongest_corr"))
    return base.crossJoin(strongest)


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """C17: equal-width histogram over [min, max], per value of ``by`` on that value's own range; the last
    bin includes max, empty bins have ``n`` = 0.  Rows without a value, or without ``by``, are left out."""
    keys = [by] if by else []
    base = df.select(*keys, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    if by:
        base = base.where(F.col(by).isNotNull())
    rng = base.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where(F.col("_lo").isNotNull())
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    binned = base.join(small(rng), keys) if keys else base.crossJoin(F.broadcast(rng))
    filled = binned.withColumn("bin", b).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("_n"))
    every = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", r6(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_lo"),
        r6(F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_hi"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


def boxplot(df: DataFrame, col: str, by: str = FLAG) -> DataFrame:
    """Quartiles, IQR and 1.5 IQR whisker bounds per group (exact quartiles)."""
    q = quantiles_wide(df, [col], [0.25, 0.5, 0.75], ["q1", "median", "q3"], by)
    iqr = F.col("q3") - F.col("q1")
    return q.select(by, r6(F.col("q1")).alias("q1"), r6(F.col("median")).alias("median"),
                    r6(F.col("q3")).alias("q3"), r6(iqr).alias("iqr"),
                    r6(F.col("q1") - 1.5 * iqr).alias("whisker_lo"), r6(F.col("q3") + 1.5 * iqr).alias("whisker_hi"))


def class_distribution(df: DataFrame, label: str, split: str | None = None) -> DataFrame:
    """Count and rate of each label value, overall or per split."""
    keys = [split] if split else []
    c = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    j = c.join(tot, keys) if keys else c.crossJoin(F.broadcast(tot))
    return j.select(*keys, label, "n", r6(F.col("n") / F.col("_t")).alias("rate"))
