"""Vector operators on odd rows against plain versions."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.llm import hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, score string, uid string, rank string"
RNG = np.random.default_rng(11)


def make_rows():
    centres = RNG.normal(0, 0.2, (4, 12))
    rows = [(i, (centres[i % 4] + RNG.normal(0, 0.05, 12)).astype(np.float32).tolist(), i % 3) for i in range(160)]
    rows += [(200, None, 1), (250, [0.1] * 12, None), (201, [0.1, None] + [0.2] * 10, 1), (202, [float("nan")] * 12, 1), (203, [float("inf")] * 12, 1),
             (300, [], 1), (350, [0.5, -0.25], 2), (None, [0.1] * 12, 1), (351, [0.0] * 12, 2), (400, [-0.3] * 12, 9)]
    rows += [rows[0], rows[50], rows[7], (50, rows[51][1], 2)]
    return [(*r, "c", "c", "c") for r in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def kept(scale):
    out = []
    for vec_id, v, label, *_ in ROWS:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((vec_id, label, [math.floor(scale * float(x)) for x in v] + [0] * (12 - len(v))))
    return out


def plain_negatives():
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in kept(256) if i is not None and lab is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = Counter()
    for i, label, v in rows:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, lab) for j, lab, w in rows)
        for s, p, _ in [x for x in scored if x[2] == label and x[1] != i][:5]:
            fits = [(n, -t) for t, n, lab in scored if lab != label and 50 * -s <= 100 * -t <= 95 * -s]
            out.update((i, p, r, n, -s, t) for r, (n, t) in enumerate(fits[:3], 1))
    return out


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_hard_negatives(vectors, block_rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0, label, block_rows=block_rows)
    want = plain_negatives()
    assert want and Counter(tuple(r) for r in got.collect()) == want
    assert hard_negatives.mine(vectors.limit(0), F.col("vec_id") % 50 == 0, label).count() == 0


@pytest.mark.parametrize("scale", [3, 200, 1 << 20, 1 << 29, 1 << 45])
def test_packed_products_are_exact(scale):
    rows, anchors = (RNG.integers(-scale, scale + 1, (n, 9)) for n in (70, 6))
    block = hard_negatives.PackedBlock(rows, anchors)
    for a in anchors:
        want = [max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a, r, strict=True)))) for r in rows]
        assert block.scores(a).tolist() == want
    same = hard_negatives.PackedBlock(np.full((5, 3), 7), anchors[:, :3])
    assert same.scores(anchors[0, :3]).tolist() == [7 * int(anchors[0, :3].sum())] * 5


def test_integers_floor_exactly():
    x = np.array([0.5, -0.5, -1e-9, 3e38, -3e38, 2.0 ** 60])
    assert [int(v) for v in hard_negatives.integers(x, 256)] == [128, -128, -1, 256 * int(3e38), -256 * int(3e38), 1 << 68]


def test_block_of_nothing():
    empty = pa.table({c: pa.array([], t) for c, t in (("c_id", pa.int64()), ("c_label", pa.int64()), ("c_vector", pa.list_(pa.float32())))})
    assert hard_negatives._positives(5, 256)(empty, empty).num_rows == 0


def floor_codes(rows, parts, entries, rounds):
    width = -(-max(len(v) for *_, v in rows) // parts)
    rows = [(i, lab, v + [0] * (parts * width - len(v))) for i, lab, v in rows]
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[list(cut(r[2], p)) for r in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v, p: min((square(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = defaultdict(list)
        for *_, v in rows:
            for p in range(parts):
                groups[p, place(v, p)[1]].append(cut(v, p))
        for (p, e), members in groups.items():
            books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by = [], Counter()
    for i, lab, v in rows:
        best = [place(v, p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        by[lab] += out[-1][3]
    text = ",".join(str(x) for part in books for entry in part for x in entry)
    return Counter((i, code, error, by[lab]) for i, lab, code, error in out), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("parts, entries", [(8, 16), (3, 5), (2, 300)])
def test_vector_codes(vectors, parts, entries):
    codes, books = vector_codes.compress(vectors, parts=parts, entries=min(entries, 256))
    want, sha = floor_codes([(i, lab, v) for i, lab, v in kept(4096)], parts, min(entries, 256), 6)
    got = vector_codes.with_label_error(codes).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want and vector_codes.digest(books) == sha
    assert len(vector_codes.decode(got[0]["code"], books)) == parts * books.shape[2]


def test_vector_codes_of_nothing(spark, vectors):
    codes, books = vector_codes.compress(vectors.limit(0))
    assert vector_codes.with_label_error(codes).count() == 0 and books.size == 0
    blank = spark.createDataFrame([(1, [], 1), (2, [], None)], "vec_id long, embedding array<double>, label int")
    assert sorted((r["code"], r["error"]) for r in vector_codes.compress(blank)[0].collect()) == [("00" * 8, 0)] * 2
    huge = spark.createDataFrame([(1, [3e38, 0.0], 1), (2, [-3e38, 1.0], None), (3, [3e38, 5.0], 1)], "vec_id long, embedding array<double>, label int")
    got = vector_codes.with_label_error(vector_codes.compress(huge, parts=2, entries=1)[0]).collect()
    assert {r["error"] for r in got} == {(1 << 63) - 1} and {r["label_error"] for r in got} == {(1 << 63) - 1}


@pytest.mark.parametrize("width, scale", [(1, 50), (5, 3), (8, 2500), (16, 1 << 40)])
def test_nearest_by_transform(width, scale):
    x, c = RNG.integers(-scale, scale + 1, (200, width)), RNG.integers(-scale, scale + 1, (16, width))
    c[9] = c[4]
    at, d = vector_codes.nearest(x, c)
    for i, row in enumerate(x.tolist()):
        want = min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), k) for k, e in enumerate(c.tolist()))
        assert (int(d[i]), int(at[i])) == want


def test_sequency_order():
    coefficients = vector_codes.transform(np.eye(8, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in coefficients] == list(range(8)) and (coefficients @ coefficients.T == 8 * np.eye(8)).all()
