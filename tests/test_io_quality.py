"""Sources/sinks (A1-A12, G3, G8) and the schema/contract helpers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from claimlens.operators import features as FE
from claimlens.operators import quality as Q
from claimlens.operators.chunking import processed_documents
from claimlens.sources import io as IO
from claimlens.sources.claims import claims_txt

SF = "/root/testdata/sf0.001"


def test_load_by_suffix_and_guard(spark, tmp_path):
    c = claims_txt(spark, SF).select(*[f.name for f in Q.CLAIMS_SCHEMA.fields])
    pq = str(tmp_path / "claims.parquet")
    IO.write_table(c, pq)
    assert IO.load_claims(spark, pq).count() == c.count()
    csv_dir = str(tmp_path / "claims.csv")
    c.withColumn("timestamp", F.col("timestamp").cast("string")).write.option("header", True).csv(csv_dir)
    back = IO.load_claims(spark, csv_dir)
    assert back.count() == c.count() and back.schema["claimed_value"].dataType.simpleString() == "double"
    with pytest.raises(ValueError):
        IO.load_claims(spark, str(tmp_path / "claims.xlsx"))
    with pytest.raises(ValueError, match="esg_claim_text"):
        IO.require_text_column(c.drop("esg_claim_text"))


def test_corpus_json_union_and_processing(spark, tmp_path):
    docs = [{"title": "Std A", "content": "First standard. " * 80, "tags": ["a"]},
            {"title": "Std B", "content": "Short guideline.", "tags": []}]
    p = tmp_path / "corpus.json"
    p.write_text(json.dumps(docs))
    a = IO.read_corpus(spark, str(p))
    u = IO.corpus_union({"standards": a, "guidelines": a})
    assert u.count() == 4 and {"source", "date_added"} <= set(u.columns)
    pr = processed_documents(a).collect()
    assert [len(r["chunks"]) > 1 for r in pr] == [True, False]


def test_sinks_and_store(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"], 0.5)], "claim_id long, recs array<string>, risk double")
    IO.export_workbook(df, df.select("risk"), str(tmp_path / "wb"))
    assert os.path.isdir(tmp_path / "wb" / "results") and os.path.isdir(tmp_path / "wb" / "summary")
    IO.write_metrics(df.select("risk"), str(tmp_path / "m"))
    store = str(tmp_path / "store")
    chunks = spark.createDataFrame([("T", "some text")], "title string, text string")
    IO.append_documents(store, chunks)
    IO.append_documents(store, chunks)
    s = spark.read.parquet(store)
    assert s.count() == 1  # a chunk appended again is stored once
    IO.append_documents(store, chunks.union(spark.createDataFrame([("T", "more"), ("T", "more")], chunks.schema)))
    again = IO.vector_store(spark, store, lambda: chunks)
    assert {r["text"] for r in again.collect()} == {"some text", "more"} and again.count() == 2
    broken = tmp_path / "broken"
    broken.mkdir()
    with pytest.raises(Exception):  # present but unreadable: never written over
        IO.vector_store(spark, str(broken), lambda: chunks)
    assert list(broken.iterdir()) == []


def test_incomplete_rows_bins_and_weighted_metrics(spark):
    from claimlens.operators import curves as CV
    from claimlens.operators import explore as X
    from claimlens.operators import features as FE
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "a"), (3, float("nan"), "b"), (4, 3.0, None)], "id int, x double, c string")
    assert [r["id"] for r in FE.drop_incomplete(df, ["x", "c"]).collect()] == [1]
    v = spark.createDataFrame([(0, 0.0), (0, 4.0), (1, 10.0), (1, 10.0), (None, 3.0), (1, None)], "f int, x double")
    got = {(r["f"], r["bin"]): (r["bin_lo"], r["n"]) for r in X.histogram(v, "x", 4, by="f").collect()}
    assert got == {(0, 0): (0.0, 1), (0, 1): (1.0, 0), (0, 2): (2.0, 0), (0, 3): (3.0, 1),
                   (1, 0): (10.0, 2), (1, 1): (10.0, 0), (1, 2): (10.0, 0), (1, 3): (10.0, 0)}
    assert X.histogram(v.where("x > 99"), "x", 4).collect() == []
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "c")], "label string, pred string")
    m = CV.multiclass_metrics(p).first()
    assert m["accuracy"] == 0.75 and m["recall"] == 0.75 and m["precision"] == 0.875 and abs(m["f1"] - 0.75) < 1e-6


def test_schema_report_and_contract(spark):
    c = claims_txt(spark, SF)
    rep = {r["column"]: r["status"] for r in Q.schema_report(spark, c.drop("measurement_unit")).collect()}
    assert rep["measurement_unit"] == "missing" and rep["claim_id"] == "extra"
    aligned = FE.align_to_contract(c.select("claim_id", "report_year"))
    assert set(FE.FEATURE_CONTRACT) <= set(aligned.columns)
    med = IO.medians_table(c, ["claimed_value"])
    one = FE.align_to_contract(c.select("claim_id"), med).first()
    assert one["claimed_value"] == pytest.approx(med.first()["claimed_value"])
    filled = FE.fill_by_kind(c.select("claim_id", "greenwashing_flag"), ["claim_category"], ["claimed_value"],
                             "greenwashing_flag").first()
    assert filled["claim_category"] == "Unknown" and filled["claimed_value"] == 0.0
    with pytest.raises(ValueError):
        FE.fill_by_kind(c.select("claim_id"), [], [], "greenwashing_flag")


def test_dedupe_evaluates_the_table_once(spark, tmp_path):
    rows = [(1, 0.0, "a", None), (1, -0.0, "a", None), (1, 0.0, "a", 2), (1, None, "a", None), (1, float("nan"), "a", None), (1, float("nan"), "a", None), (2, -0.0, None, 3)]
    spark.createDataFrame(rows, "id int, x double, t string, n int").write.parquet(str(tmp_path / "rows"))
    out = Q.dedupe(spark.read.parquet(str(tmp_path / "rows")))
    got = sorted((r["id"], str(None if r["x"] is None else abs(r["x"])), str(r["t"]), str(r["n"])) for r in out.collect())
    assert got == [(1, "0.0", "a", "2"), (1, "0.0", "a", "None"), (1, "None", "a", "None"), (1, "nan", "a", "None"), (2, "0.0", "None", "3")]
    assert out.columns == ["id", "x", "t", "n"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan
