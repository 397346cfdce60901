"""The scoring stream over a table of one file and over a table of several files."""

import os

import pytest

from claimlens.plans.catalog import QUERIES
from claimlens.streaming.scoring import score_claims
from claimlens.plans.q_stream import DATA_LEX


@pytest.mark.parametrize("files", [1, 3])
def test_stream_reads_a_file_or_a_folder(spark, tmp_path, files):
    texts = ["We are fully green and carbon neutral.", None, "A plain report of 12 tonnes.", "", "the best ever"]
    rows = [(i, texts[i % len(texts)]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(files)
    docs.write.parquet(str(tmp_path / "whole"))
    if files == 1:
        part = next(p for p in os.listdir(tmp_path / "whole") if p.endswith(".parquet"))
        os.link(tmp_path / "whole" / part, tmp_path / "documents.parquet")
    else:
        os.symlink(tmp_path / "whole", tmp_path / "documents.parquet")
    want = score_claims(docs, "doc_id", "text", v2_lexicon=DATA_LEX)
    got = QUERIES["stream_scoring"](spark, str(tmp_path))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
