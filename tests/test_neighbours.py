"""Exact neighbours against all pairs, and oversampling on scaled, unscaled and skewed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import neighbours as NB
from claimlens.operators.balance import smote

RNG = np.random.default_rng(17)
SHAPES = {
    "scaled": RNG.normal(size=(3000, 3)),
    "unscaled": RNG.normal(size=(1500, 3)) * [1e6, 1.0, 1e-3],
    "skewed": np.vstack([np.full((400, 4), 2.5), RNG.normal(2.5, 1e-4, (300, 4)), RNG.normal(0, 5, (500, 4))]),
    "long": RNG.normal(size=(500, 40)),
    "line": np.arange(700, dtype=float)[:, None] ** 2,
}


def exact(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)) if len(x) < 2000 else np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in x])
    np.fill_diagonal(d, np.inf)
    return np.sort(d, axis=1)[:, :k], d


@pytest.mark.parametrize("shape", SHAPES)
def test_neighbours_are_the_nearest(spark, shape):
    x = SHAPES[shape]
    rows = NB.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3), "id", "v")
    id_of = {r["uid"]: r["id"] for r in rows.select("uid", "id").collect()}
    got = np.full((len(x), 5), np.nan)
    want, d = exact(x, 5)
    for r in NB.neighbours(rows, 5, block_rows=64).collect():
        a, b = id_of[r["uid"]], id_of[r["other"]]
        got[a, r["rank"] - 1] = r["distance"]
        assert a != b and np.isclose(r["distance"], d[a, b], rtol=1e-12)
    assert np.allclose(got, want, rtol=1e-12, atol=0)


def test_few_blocks_are_asked(spark):
    x = SHAPES["scaled"]
    rows = NB.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v").select("uid", "vec")
    pivots = x[:55]
    placed = NB.place(rows, pivots, 2048)
    own = placed.groupBy("block").applyInArrow(NB._within(5, 3), NB._FOUND)
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"))
    asked = NB.ask(placed, own, pivots, 5).join(sizes, "block").agg(F.sum("n")).first()[0]
    inside = sizes.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert asked + inside < 0.25 * len(x) ** 2
    # a hot group of equal rows asks nobody
    x = SHAPES["skewed"]
    rows = NB.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), "id", "v").select("uid", "vec")
    pivots = np.unique(x[::40], axis=0)
    placed = NB.place(rows, pivots, 64)
    asks = NB.ask(placed, placed.groupBy("block").applyInArrow(NB._within(5, 4), NB._FOUND), pivots, 5)
    assert asks.where(F.col("vec") == F.array(*[F.lit(2.5)] * 4)).count() <= 64


def test_odd_tables(spark):
    schema = "id string, v array<double>"
    none = NB.usable(spark.createDataFrame([], schema), "id", "v")
    assert NB.neighbours(none, 5).count() == 0
    odd = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0, 2.0]), (None, [1.0]), ("n", None), ("x", [1.0, None]), ("y", [float("nan"), 1.0])], schema)
    rows = NB.usable(odd, "id", "v")
    got = sorted((r["rank"], r["distance"]) for r in NB.neighbours(rows, 5).collect())
    assert got == [(1, 0.0), (1, 0.0), (1, 2.0), (2, 2.0), (2, 2.0), (2, 2.0)]


@pytest.mark.parametrize("shape", ["scaled", "unscaled", "skewed"])
def test_smote_lies_between_true_neighbours(spark, shape):
    x = SHAPES[shape][-200:]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(1000 + i, [0.0] * x.shape[1], 0) for i in range(600)]
    out = smote(spark.createDataFrame(rows, "id long, v array<double>, y int"), "id", "v", "y", block_rows=32).collect()
    assert len(out) == 400 and len({(r["source_id"], r["synthetic_index"]) for r in out}) == 400
    _, d = exact(x, 5)
    scale = x.std(axis=0)
    for r in out:
        a, s = x[r["source_id"]], np.array(r["features"])
        ends = x[np.argsort(d[r["source_id"]])[:5]]
        u = [((s - a) / scale) @ ((e - a) / scale) / (((e - a) / scale) ** 2).sum() for e in ends]
        assert any(-1e-9 <= t <= 1 + 1e-9 and np.allclose(a + t * (e - a), s, rtol=1e-6, atol=1e-9 * np.abs(x).max()) for t, e in zip(u, ends, strict=True))
    assert sum(np.array_equal(x[r["source_id"]], r["features"]) for r in out) < 4


def test_smote_of_one_row_and_of_the_larger_class(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [0.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0)], "id long, v array<double>, y int")
    assert [(r["source_id"], r["features"]) for r in smote(df, "id", "v", "y").collect()] == [(1, [1.0, 2.0])] * 2
    assert smote(df, "id", "v", "y", minority=0).count() == 0


@pytest.mark.parametrize("shape", ["scaled", "skewed", "long"])
def test_search_with_cells(spark, shape):
    x = SHAPES[shape]
    q = np.vstack([x[::50], x[:3] + 0.01])
    rows = NB.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3), "id", "v")
    asks = NB.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, v array<double>"), "id", "v")
    cells = NB.index(rows, cells=20, sample=500, block_rows=64)
    assert cells.placed.count() == len(x)
    d = np.sqrt(((q[:, None] - x) ** 2).sum(axis=2))
    got = np.full((len(q), 4), np.nan)
    exact = NB.search(cells, asks, 4, 2, exact=True)
    for r in exact.collect():
        got[r["query_id"], r["rank"] - 1] = r["distance"]
        assert np.isclose(r["distance"], d[r["query_id"], r["id"]], rtol=1e-12, atol=0)
    assert np.allclose(got, np.sort(d, axis=1)[:, :4], rtol=1e-12, atol=0)
    few, many = (NB.recall(NB.search(cells, asks, 4, p), exact).first() for p in (1, 20))
    assert many["recall"] >= (0.9 if shape == "skewed" else 1.0) and few["recall"] <= 1.0 and many["queries"] == len(q)


def test_encoder_is_loaded_once_a_worker(spark, tmp_path):
    from claimlens.operators import encoder as EN
    mark = str(tmp_path / "loads")

    def loader():
        import os
        with open(mark, "a") as f:
            f.write(f"{os.getpid()} ")
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], float).reshape(len(texts), 2)

    df = spark.createDataFrame([("banana", 1), (None, 2), ("", 3)] * 40, "t string, embedding int").repartition(6)
    got = EN.encode(df, "t", "test-lengths", loader, 2, rows=7)
    assert got.columns == ["t", "embedding"] and {(r["t"], tuple(r["embedding"])) for r in got.collect()} == {("banana", (6.0, 3.0)), (None, (0.0, 0.0)), ("", (0.0, 0.0))}
    got.collect()
    workers = open(mark).read().split()
    assert workers and len(workers) == len(set(workers))
    with pytest.raises(Exception, match="shape"):
        EN.encode(df, "t", "test-shape", lambda: lambda texts: np.zeros((len(texts), 3)), 2).collect()
    assert EN.encode(df.limit(0), "t", "test-lengths", loader, 2).count() == 0
    v = EN.hashing_encoder(16)()(["one two", "Two one", "", "three"])
    assert np.allclose(v[0], v[1]) and not v[2].any() and np.isclose(np.linalg.norm(v[3]), 1)


def test_rows_travel_to_groups_not_to_blocks(spark):
    """In noise of many dimensions nearly every block is asked; a row is copied once a group, and the result stays exact."""
    x = np.random.default_rng(8).normal(size=(1500, 24))
    rows = NB.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3), "id", "v")
    pivots = x[:20]
    blocks = NB.grouped(NB.place(rows.select("uid", "vec"), pivots, 32), 24, 400 * 24 * 8)
    assert len(blocks.block) >= 47 and len(set(blocks.group.tolist())) <= 16
    ids = {r["uid"]: r["id"] for r in rows.collect()}
    got = {}
    for r in NB.neighbours(rows, 5, block_rows=32, group_bytes=400 * 24 * 8).collect():
        got.setdefault(ids[r["uid"]], {})[r["rank"]] = ids[r["other"]]
    d = ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :5]
    assert all([got[i][n] for n in range(1, 6)] == want[i].tolist() for i in range(len(x)))


def test_probes_are_sent_in_parts(spark):
    """The copies of a batch of queries leave in batches of bounded size, the same ones as all at once."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    x, centres = rng.normal(size=(300, 4)), rng.normal(size=(40, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(300)), pa.array(x.tolist())], names=["uid", "vec"])
    block, of = np.arange(200) + 7, np.repeat(np.arange(40), 5)
    sent = list(NB._probe(centres, block, of, 28)(iter([batch])))
    assert max(b.num_rows for b in sent) <= 1 << 14 and sum(b.num_rows for b in sent) == 300 * 28 * 5
    near = np.argsort(((x[:, None] - centres) ** 2).sum(axis=2), axis=1)[:, :28]
    want = {(b, u) for u in range(300) for b, c in zip(block.tolist(), of.tolist()) if c in near[u]}
    assert {(b, u) for s in sent for b, u in zip(s.column(0).to_pylist(), s.column(1).to_pylist())} == want
