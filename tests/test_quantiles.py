"""Quantiles by distributed selection, and the cleaning operators, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.functions import stats
from claimlens.operators import explore, quality

RNG = np.random.default_rng(29)
SHAPES = {
    "normal": RNG.normal(size=2000), "wide": RNG.lognormal(0, 30, 1500) * RNG.choice([-1, 1], 1500), "few": RNG.integers(0, 4, 999).astype(float),
    "one": np.array([3.5]), "two": np.array([-1.0, 2.0]), "equal": np.full(500, -7.25), "zeros": np.array([0.0, -0.0, 0.0, -0.0]),
    "limits": np.array([1.7e308, -1.7e308, 5e-324, -5e-324, 0.0]), "skewed": np.r_[np.full(900, 1e9), RNG.normal(size=100)],
}
PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def linear(x, p):
    x = np.sort(x + 0.0)
    h = (len(x) - 1) * p
    low = int(np.floor(h))
    return x[low] + (h - low) * (x[min(low + 1, len(x) - 1)] - x[low])


def test_all_columns_in_one_walk(spark):
    n = max(map(len, SHAPES.values()))
    rows = [tuple(float(v[i]) if i < len(v) else (None if i % 2 else float("nan")) for v in SHAPES.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in SHAPES) + "").repartition(5).withColumn("nothing", F.lit(None).cast("double"))
    got = {(r["column"], r["q_index"]): r["value"] for r in stats.column_quantiles(df, [*SHAPES, "nothing"], PROBS).collect()}
    assert len(got) == len(SHAPES) * len(PROBS)
    with np.errstate(over="ignore"):
        for c, x in SHAPES.items():
            for i, p in enumerate(PROBS):
                assert got[c, i] == linear(x, p), (c, p)


@pytest.mark.parametrize("cells", [stats.CELLS, 1 << 12, 64])
def test_groups(spark, cells, monkeypatch):
    """Few counters give more passes; too many groups for any go another way: the values are the same."""
    monkeypatch.setattr(stats, "CELLS", cells)
    rows = [(int(RNG.integers(0, 6)) or None, float(RNG.normal()), i % 3) for i in range(800)]
    df = spark.createDataFrame(rows, "g int, x double, y int")
    got = {(r["g"], r["column"], r["q_index"]): r["value"] for r in stats.column_quantiles(df, ["x", "y"], [0.25, 0.5], "g").collect()}
    assert len(got) == 5 * 2 * 2
    for (g, c, q), v in got.items():
        x = np.array([r[1 if c == "x" else 2] for r in rows if r[0] == g], float)
        assert np.isclose(v, linear(x, [0.25, 0.5][q]), rtol=1e-12)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g int, x double")
    assert stats.column_quantiles(df, ["x"], [0.5]).count() == 0 and stats.column_quantiles(df, ["x"], [0.5], "g").count() == 0
    assert explore.insights(df.select(F.lit("a").alias("claim_category"), F.lit("b").alias("organization_name"), F.lit(1).alias("report_year"),
                                      F.lit(1).alias("greenwashing_flag"), F.lit(1).alias("text_length"), "x"), ["x"]).first()["n_rows"] == 0


def test_dedupe_keeps_one_of_each(spark):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, None, 0.0), (2, None, -0.0), (3, "b", None), (1, "a", 2.0), (None, None, None), (None, None, None)]
    got = quality.dedupe(spark.createDataFrame(rows, "i int, t string, v double").repartition(4)).collect()
    assert sorted(map(str, got)) == sorted(map(str, {str(r): r for r in got}.values())) and len(got) == 5


def test_cleaning(spark):
    rows = [("1", " a claim ", "12.5", "1", 0, "2024-01-02"), ("1", "a claim", "12.5", "1", 0, "2024-01-02"), ("2", "\tb", "oops", "0", 1, "not a day"), ("3", None, None, None, 1, None)]
    df = spark.createDataFrame(rows, "project_id string, esg_claim_text string, claimed_value string, greenwashing_flag string, controversy_flag int, timestamp string")
    r = quality.cleaning_report(df).first()
    assert (r["rows_before"], r["rows_after"], r["rows_removed"], r["null_greenwashing_flag"], r["bad_claimed_value"], r["stripped"]) == (4, 3, 1, 1, 1, 2)
    got = quality.clean_claims(df, strict=False).collect()
    assert len(got) == 3 and {r["esg_claim_text"] for r in got} == {"a claim", "b", None} and {r["claimed_value"] for r in got} == {12.5, None}
    assert {str(r["timestamp"]) for r in got} == {"2024-01-02 00:00:00", "None"}
    with pytest.raises(Exception, match="greenwashing_flag"):
        quality.clean_claims(df.where("project_id <> '2'")).collect()
    with pytest.raises(Exception, match="not a day"):
        quality.clean_claims(df.where("project_id = '2'")).collect()


def test_pairwise_complete_correlations(spark):
    x = RNG.normal(size=(300, 3)) * [1.0, 1e6, 1e-3] + [0, 1e9, 5]
    x[:, 1] += 1e6 * x[:, 0]
    rows = [tuple(None if RNG.random() < 0.2 else (float("nan") if RNG.random() < 0.1 else float(v)) for v in r) + (7.0, None) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, none double").repartition(4)
    got = stats.pearson_table(df, [("a", "b"), ("b", "c"), ("a", "same"), ("a", "none")], ["a", "same", "none"]).first()
    v = np.array([[np.nan if y is None else y for y in r[:3]] for r in rows])
    for i, j in ((0, 1), (1, 2)):
        both = ~np.isnan(v[:, i]) & ~np.isnan(v[:, j])
        assert np.isclose(got["abc"[i] + "|" + "abc"[j]], np.corrcoef(v[both, i], v[both, j])[0, 1], rtol=1e-9)
    assert got["a|same"] is None and got["a|none"] is None and got["ss|same"] == 0 and got["ss|none"] is None
    assert np.isclose(got["ss|a"], np.nansum((v[:, 0] - np.nanmean(v[:, 0])) ** 2))
    assert stats.pearson_table(df.limit(0), [("a", "b")], ["a"]).first()["a|b"] is None
