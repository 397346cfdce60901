"""Goldens for the lexicon/rule scores (H1-H11) on the fixture sentences."""

import pytest
from pyspark.sql import functions as F

from claimlens.functions.text import char_count, word_count
from claimlens.operators import risk as RK
from tests.fixtures import GOLDEN, SENTENCES


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(SENTENCES + [("O9", None)], "id string, text string")
    kc = RK.keyword_counts("text")
    issues = RK.keyword_issues("text")
    out = df.select(
        "id", char_count("text").alias("chars"), word_count("text").alias("words"),
        RK.keyword_risk_v1("text").alias("h1"), RK.keyword_risk_v2("text").alias("h2"),
        F.size(RK.text_indicators("text")).alias("n"), RK.text_risk("text").alias("h4"),
        kc.alias("kc"), F.size(issues).alias("issues"),
        RK.weighted_risk("text", F.lit(0), F.lit(None).cast("double"), kc["greenwashing_indicators"],
                         F.size(issues)).alias("h10a"),
        RK.weighted_risk("text", F.lit(3), F.lit(0.25), kc["greenwashing_indicators"],
                         F.size(issues)).alias("h10b"))
    return {r["id"]: r for r in out.collect()}


@pytest.mark.parametrize("sid", sorted(GOLDEN))
def test_goldens(scored, sid):
    r = scored[sid]
    chars, words, h1, h2, n, h4, esgw, issues, h10a, h10b = GOLDEN[sid]
    assert r["chars"] == chars and r["words"] == words
    assert r["h1"] == pytest.approx(h1) and r["h2"] == pytest.approx(h2)
    assert r["n"] == n and r["h4"] == pytest.approx(h4)
    kc = r["kc"]
    assert (kc["environmental"], kc["social"], kc["governance"], kc["greenwashing_indicators"]) == esgw
    assert r["issues"] == issues
    assert r["h10a"] == pytest.approx(h10a) and r["h10b"] == pytest.approx(h10b)


def test_null_text_is_never_scored(scored):
    r = scored["O9"]
    assert r["h1"] is None and r["h2"] is None and r["h4"] is None and r["h10a"] is None


def test_blend_and_alert_bounds(spark):
    rows = [(0.8, 0.4, 0.5, 0.6), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 1.4), (0.0, 0.0, 0.6, 0.6)]
    df = spark.createDataFrame(rows, "gb double, lr double, t double, r double")
    out = df.select(RK.overall_risk("gb", "lr", "t", "r", True).alias("with_rag"),
                    RK.overall_risk("gb", "lr", "t", "r", False).alias("no_rag")).collect()
    assert out[0]["with_rag"] == pytest.approx(0.675) and out[0]["no_rag"] == pytest.approx(0.701)
    assert out[1]["with_rag"] == 0.0
    lv = spark.createDataFrame([(0.6,), (0.3,), (0.61,), (0.0,)], "s double").select(
        RK.risk_level("s").alias("l")).collect()
    assert [x["l"] for x in lv] == ["MEDIUM", "LOW", "HIGH", "LOW"]


def test_v2_analysis_text(spark):
    df = spark.createDataFrame([("We achieved 100% carbon neutrality.",)], "t string")
    r = df.select(RK.v2_analysis(RK.keyword_risk_v2("t")).alias("a")).first()
    assert r["a"] == "Keyword-based analysis: Risk score 0.60. High risk indicators detected."


def test_recommendations(spark):
    df = spark.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "l string")
    out = [r["x"] for r in df.select(RK.agent_recommendations("l").alias("x")).collect()]
    assert len(out[0]) == 3 and len(out[1]) == 1
    assert out[2] == ["Claim appears to be well-structured and transparent."]
