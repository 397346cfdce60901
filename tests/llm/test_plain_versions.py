"""Whole verdicts of trained or iterative operators against plain versions of their methods."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from claimlens.llm import language_id, quality, sharding

RNG = np.random.default_rng(41)
SYL = "ba ko mi ten ur sal vor ne".split()


def words(n, k=3):
    return ["".join(RNG.choice(SYL, RNG.integers(1, k + 1))) for _ in range(n)]


def quality_rows():
    rows = []
    for i in range(260):
        lang, source = ["en", "de", None][i % 3], ["web", "", None][i % 7 % 3]
        w = words(int(RNG.integers(12, 200)), 3 + 2 * (i % 29 == 0))
        t = " ".join(w)
        if i % 11 == 0:
            t += "\n" + "\n".join(["# $ %% menu | item"] * int(RNG.integers(1, 9)))
        if i % 13 == 0:
            t += " " + " ".join(w[:7] * 2)
        rows.append((i, t, lang, source, "c"))
    return rows + [(900, None, "en", "web", "c"), (901, "", None, None, "c"), (902, "# # #", "fr", "alone", "c"), (903, " ".join(words(50)), "fr", "alone", "c"), rows[4], rows[4]]


def low_rank(x, p):
    return np.sort(x)[max(0, int(np.ceil(p * len(x))) - 1)]


def test_quality_verdict(spark):
    rows = quality_rows()
    stats = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        at = defaultdict(list)
        for j in range(len(w) - 4):
            at[tuple(w[j:j + 5])].append(j)
        twice = {k for v in at.values() if len(v) > 1 for j in v for k in range(j, j + 5)}
        stats.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines), len(lines) - len(set(lines)), len(twice)))
    s = np.array(stats, float)
    n, chars = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    x = np.stack([np.log(n), np.log(chars / n), np.sqrt(s[:, 2] / chars), np.sqrt(s[:, 4] / np.maximum(s[:, 3], 1)), np.sqrt(s[:, 5] / n)], 1)
    failed = (s[:, 0] < 10) | (100 * s[:, 5] > 20 * s[:, 0])
    steady = np.ones_like(x)
    steady[:, 1] = np.sqrt(s[:, 0] / (s[:, 0] + quality.NOISY_WORDS))
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if not failed[i]:
            groups[r[2], r[3]].append(i)
    floor, par = np.array(quality.FLOOR), {}
    d2 = {g: (((x[at] - [low_rank(x[at][:, f], 0.5) for f in range(5)]) * steady[at] / quality.START) ** 2).sum(1) for g, at in groups.items()}

    def parts(g, at):
        mean, inverse, fixed, _ = par[g]
        d = (x[at] - mean) * steady[at]
        return np.einsum("ni,ij,nj->n", d, inverse, d), (fixed * d * d).sum(1)

    for _ in range(5):
        inner = {g: np.array(at)[d2[g] <= low_rank(d2[g], 0.75)] for g, at in groups.items()}
        every = np.concatenate(list(inner.values()))
        for g, at in inner.items():
            weight = 20.0 / len(every)
            total = len(at) + weight * len(every)
            mean = (x[at].sum(0) + weight * x[every].sum(0)) / total
            cov = (x[at].T @ x[at] + weight * x[every].T @ x[every]) / total - np.outer(mean, mean)
            ruled = np.diag(cov) > floor ** 2
            inverse = np.zeros((5, 5))
            v, u = np.linalg.eigh(cov[np.ix_(ruled, ruled)])
            inverse[np.ix_(ruled, ruled)] = u @ np.diag(1 / np.maximum(v, 1e-6)) @ u.T
            par[g] = mean, inverse, np.where(ruled, 0, 1 / floor ** 2), quality.CHI2_MEDIANS[int(ruled.sum())]
        d2 = {g: sum(parts(g, at)) for g, at in groups.items()}
    want = []
    for i, r in enumerate(rows):
        kept, distance = not failed[i], None
        g = (r[2], r[3])
        if g in groups:
            scale = max(low_rank(parts(g, groups[g])[0] / par[g][3], 0.5), quality.LEAST_SCALE)
            a, b = parts(g, [i])
            distance = float(a[0] / scale + b[0])
            kept = kept and distance <= quality.CHI2_CUTOFF
        want.append((r[0], bool(kept), None if distance is None else round(distance, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string").repartition(4)
    got = Counter((r["doc_id"], r["kept"], None if r["distance2"] is None else round(r["distance2"], 4)) for r in quality.judge(df).collect())
    assert {k[:2] for k in got} == {w[:2] for w in want} and sum(got.values()) == len(rows)
    assert sum(not w[1] for w in want) > failed.sum()  # the method rejects some that pass the base rules
    near = {(i, k): d for i, k, d in want}
    assert all((d is None) == (near[i, k] is None) and (d is None or abs(d - near[i, k]) <= 1e-3 * max(1, abs(d))) for i, k, d in got)


def plain_fits(items, capacity, shards):
    gaps = []
    for s in items:
        fits = [i for i, g in enumerate(gaps) if g >= s]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= s
        elif len(gaps) < shards and s <= capacity:
            gaps.append(capacity - s)
        else:
            return False
    return True


def test_balanced_shards_against_plain_best_fit():
    for trial in range(12):
        sizes = sorted((RNG.integers(1, 60, 80) if trial % 3 else RNG.choice([5, 9, 400], 60, p=[0.6, 0.38, 0.02])).tolist(), reverse=True)
        shards = int(RNG.integers(2, 9))
        runs = sharding.balanced(sorted(Counter(sizes).items(), reverse=True), shards)
        seen, load = Counter(), Counter()
        for size, low, high, shard in runs:
            seen[size] += high - low
            load[shard] += size * (high - low)
            assert 0 <= shard < shards
        assert seen == Counter(sizes)
        # items larger than an equal share of what is left stand alone, the rest is packed as plain best fit does
        left, total, rest = shards, sum(sizes), list(sizes)
        while left > 1 and rest and rest[0] * left >= total:
            left, total = left - 1, total - rest.pop(0)
        least = next(c for c in range(-(-total // left), total + 1) if plain_fits(rest, c, left))
        alone = max(sizes[:shards - left], default=0)
        assert max(load.values()) <= max(alone, least) * 1.02 + 1


def test_language_model_by_plain_sums(spark):
    """Training (one expectation step) and prediction, by sums over segmentations in plain Python."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    t = language_id.trie(path)
    base = {"en": "the river and the stone were here with them", "de": "der fluss und die steine waren hier bei ihnen"}
    rows = [(i, " ".join(RNG.choice(base[lang].split(), 9)), lang) for i, lang in enumerate(["en", "de"] * 12)]
    rows += [(100, "the stone waren", None), (101, None, "en"), (102, "42 !", None), (103, "der", None)]

    def matches(w, i):
        node = 0
        for j in range(i, len(w)):
            node = t.step[node, w[j]]
            if not node:
                return
            if t.piece[node] >= 0:
                yield j + 1, int(t.piece[node])

    cut = lambda x: [language_id.MARK + m.encode() for m in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())]
    counts, share = {"de": Counter(), "en": Counter()}, Counter()
    for _, text, lang in rows:
        if text and lang:
            share[lang] += 1
            for w in cut(text):
                a, b = [0.0] * len(w) + [0.0], [0.0] * len(w) + [1.0]
                a[0] = 1.0
                for i in range(len(w)):
                    for j, _ in matches(w, i):
                        a[j] += a[i] / t.size
                for i in reversed(range(len(w))):
                    for j, _ in matches(w, i):
                        b[i] += b[j] / t.size
                for i in range(len(w)):
                    for j, piece in matches(w, i):
                        counts[lang][piece] += a[i] / t.size * b[j] / a[-1]

    def log_probability(lang, text):
        total, p = np.log(share[lang] / sum(share.values())), counts[lang]
        mass = sum(p.values())
        for w in cut(text):
            a = [1.0] + [0.0] * len(w)
            for i in range(len(w)):
                for j, piece in matches(w, i):
                    a[j] += a[i] * ((1 - 1e-3) * p[piece] / mass + 1e-3 / t.size)
            total += np.log(a[-1])
        return total

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for r in language_id.identify(df, df.filter(F.col("lang").isNotNull()), path, evidence_column="evidence").collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"], r["evidence"]) == ("und", 0.0, None)
            continue
        total = {lang: log_probability(lang, text) for lang in ("de", "en")}
        best = max(total, key=total.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(np.exp(v - total[best]) for v in total.values())) < 1e-2
        bytes_ = sum(map(len, cut(text)))
        assert abs(r["evidence"] - (total[best] - np.log(share[best] / sum(share.values()))) / bytes_) < 1e-2
