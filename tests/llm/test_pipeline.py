"""The pipeline on a small folder of tables: each stage against a plain version on its own input."""

import re
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as C
    from claimlens.sources.tables import table
    docs = table(spark, SF, "documents")
    names, kept = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for _, stage in C.STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, SF), "test")
        assert docs.columns == names
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert all(set(b.items()) <= set(a.items()) for a, b in zip(kept, kept[1:]))
    lettered = {i for i, t in kept[0].items() if t and any(map(str.isalpha, t))}
    assert kept[1].keys() <= lettered and len(kept[1]) >= 0.98 * len(lettered)

    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in kept[2].items()}
    root = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert kept[3].keys() == {i for i in root if root[i] == i}
    packed = C.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == kept[4].keys()
    assert not C.STAGES[0][1](spark, docs.limit(0), SF).count()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages_keep_odd_rows_and_columns(spark):
    """Null ids, repeated rows, nulls in every column, a very long text, and columns that carry the
    operators' result names: each filtering stage returns a sub-multiset of its input, values unchanged."""
    from collections import Counter

    import corpus_pipeline as C
    from claimlens.sources.tables import table
    names = ["score", "predicted", "held_out", "component_id", "kept", "contamination", "n_words", "lang_pred", "sequence_id", "positive", "rank", "n"]
    docs = table(spark, SF, "documents").limit(60)
    first = docs.filter("text is not null").orderBy("doc_id").limit(1)
    nulls = spark.createDataFrame([tuple(None for _ in docs.columns)] * 2, docs.schema)
    from pyspark.sql import functions as F
    no_id = first.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    long = first.withColumn("doc_id", F.lit(10 ** 9).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.expr("repeat(concat(text, ' '), 300)"))
    odd = docs.unionByName(nulls).unionByName(first).unionByName(first).unionByName(no_id).unionByName(long)
    odd = C.materialise(odd.withColumns({c: F.concat(F.lit("own "), F.col("doc_id").cast("string")) for c in names}), "test-odd")

    def rows(df):
        return Counter(tuple(r) for r in df.collect())

    before = odd
    for name, stage in C.STAGES[:-1]:
        after = C.materialise(stage(spark, before, SF), "test-odd")
        assert after.columns == odd.columns, name
        assert not rows(after) - rows(before), name
        before = after
    kept = rows(before.select("doc_id"))
    own = first.first()["doc_id"]
    assert kept[(own,)] <= 1 and not kept[(None,)]
    packed = C.STAGES[-1][1](spark, before, SF)
    assert rows(packed.filter("piece = 0").select("doc_id")) == kept
    empty = odd.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_run_against_plain_versions(spark, tmp_path):
    """Everything after the trained stages, by plain code from their survivors: duplicates, benchmark passages, packing."""
    import bisect

    import corpus_pipeline as C
    import public_tokenizers
    from tokenizers import Tokenizer

    from claimlens.sources.tables import table
    sf = str(tmp_path)
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    docs = table(spark, SF, "documents").limit(150)
    planted = spark.createDataFrame([(10 ** 6 + i, "so here " + t) for i, t in enumerate(items[:3])], "doc_id long, text string")
    noise = spark.createDataFrame([(2 * 10 ** 6, "qxzjv kqwxz vjqzx " * 30)], "doc_id long, text string")
    docs.unionByName(planted, allowMissingColumns=True).unionByName(noise, allowMissingColumns=True).unionByName(docs.limit(2)).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{sf}/{name}.parquet")
    docs = table(spark, sf, "documents")
    for _, stage in C.STAGES[:2]:
        docs = C.materialise(stage(spark, docs, sf), "test")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert 2 * 10 ** 6 not in {i for i, _ in rows}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    left = {}
    for g, (i, t) in zip(group, rows, strict=True):
        if g not in left or i < left[g][0]:
            left[g] = (i, t)
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for t in items:
        w = rx.findall(lower(t or ""))
        k = min(13, len(w))
        windows.setdefault(k, set()).update(tuple(w[j:j + k]) for j in range(len(w) - k + 1) if k)
    clean = {}
    for i, t in left.values():
        w, hit = rx.findall(lower(t)), set()
        for k, known in windows.items():
            for j in range(len(w) - k + 1):
                if tuple(w[j:j + k]) in known:
                    hit.update(range(j, j + k))
        if not hit or 20 * len(hit) < len(w):
            clean[i] = t
    assert not any(i >= 10 ** 6 for i in clean)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in clean.items():
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        want += [(i, k, 2048 if k else (n - 1) % 2048 + 1) for k in range(-(-n // 2048))]
    packed = C.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in packed) == sorted(want)
    fill, plain = {}, []
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048
    gaps = []
    for n in sorted((w[2] for w in want), reverse=True):  # plain best fit, largest first
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else 2048
        plain.append(gap == 2048)
        bisect.insort(gaps, gap - n)
    assert len(fill) <= sum(plain) or len(fill) <= len(gaps)
