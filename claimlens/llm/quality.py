"""Quality rules: robust multivariate outliers per language and source.

A text's statistics become a vector of five transformed features (logarithms of length and of word
length, square roots of shares, which even out their spread).  For every (language, source) the minimum-covariance-
determinant estimate is found by concentration steps: start from medians and absolute deviations, take
the three quarters of rows that are nearest by Mahalanobis distance, and estimate mean and covariance
anew from them.  A row is rejected when its squared distance, scaled so that the group's median fits
the chi-square median, exceeds ``cutoff``.  The estimate rules every feature whose standard deviation in
the subset is above its floor (``FLOOR``); the others, in most groups the shares that are zero in nearly
every text, are measured on the floor itself, because the estimate would call any other value an outlier.
The mean word length of a short text is noisy: its deviation is weighed by n / (n + ``NOISY_WORDS``).

Every step is two aggregations over the table of statistics (a quantile of distances, then sums), so a
source of any size is spread over all tasks; a group's estimate is one row.  Groups of few rows are
drawn towards the estimate over all rows by ``prior_rows`` pseudo-rows.

Defined results: null text has no words and fails the base rules; a null language or source is a group
of its own; rows that fail the base rules do not take part in the estimates; repeated rows count
each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.common import BLANK_SEPARATED, Words, gram_hashes, materialise, mix64, ready, release, slices

FEATURES = ("log_words", "log_word_chars", "symbol_share", "dup_line_share", "repeat_share")
#: Smallest standard deviation of each feature that is taken seriously: a lower bound, never added.
FLOOR = (0.1, 0.02, 0.05, 0.15, 0.15)
#: Scales of the first distances, before there is an estimate.
START = (1.0, 0.15, 0.05, 0.15, 0.15)
#: Words at which the noise of the mean of log word lengths (about 0.45 a word) is its spread between texts (0.045).
NOISY_WORDS = 100
#: Medians of chi-square with one to five degrees of freedom (one stands for none, where nothing is scaled),
#: its 0.99999 quantile with five (fixed values), and the smallest scale.
CHI2_MEDIANS, CHI2_CUTOFF, LEAST_SCALE = (1.0, 0.4549, 1.3863, 2.3660, 3.3567, 4.3515), 30.856, 0.5
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def repeated_words(words: Words, n: int = 5) -> np.ndarray:
    """Words of each text inside windows of ``n`` words that the text holds twice or more."""
    first, total = words.first, len(words)
    if total < n:
        return np.zeros(len(first) - 1, np.int64)
    g = gram_hashes(words.hashes(lower=False), n)
    doc = np.repeat(np.arange(len(first) - 1), words.counts())
    own = np.flatnonzero(doc[:total - n + 1] == doc[n - 1:])
    _, inverse, count = np.unique(mix64(g[own] + (doc[own].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = own[count[inverse] > 1]
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + n, -1)
    sums = np.r_[0, np.cumsum(np.cumsum(marks[:-1]) > 0)]
    return sums[first[1:]] - sums[first[:-1]]


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def text_statistics(docs: DataFrame, text: str, carry: list[Column]) -> DataFrame:
    """The columns in ``carry`` and the statistics of each text."""
    kept = docs.select(*carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in slices(batch, "__text"):
                words = Words(data, offs, BLANK_SEPARATED)
                by_doc = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][offs])
                lines = [duplicate_lines(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                cols = [words.counts(), by_doc(BLANK_SEPARATED[data] & ((data & 0xC0) != 0x80)), by_doc(SYMBOLS[data]),
                        [a for a, _ in lines], [b for _, b in lines], repeated_words(words)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)],
                                                 names=[*part.schema.names[:-1], *(c.split()[0] for c in STATS.split(", "))])

    schema = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", " + STATS
    return docs.select(*carry, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log(n), F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
            F.sqrt(F.col("n_repeat_words") / n)]


def _away(center: str) -> list[Column]:
    """Deviation of each feature from the columns ``center``0, ``center``1, ..."""
    steady = F.sqrt(F.col("n_words") / (F.col("n_words") + NOISY_WORDS))
    return [(F.col(f) - F.col(f"{center}{i}")) * (steady if f == "log_word_chars" else 1) for i, f in enumerate(FEATURES)]


def _distances() -> tuple[Column, Column]:
    """Squared distance in the features that the estimate rules, and in those measured on their floor."""
    d = _away("m")
    return (sum((F.col(f"w{i}{j}") * d[i] * d[j] * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0)),
            sum((F.col(f"f{i}") * x * x for i, x in enumerate(d)), F.lit(0.0)))


def estimate(mean: list[float], cov: list[float]) -> dict[str, float]:
    """Centre, inverse covariance of the ruled features (w), inverse squared floor of the others (f) and the
    chi-square median of as many degrees of freedom as features are ruled."""
    c = np.empty((len(FEATURES),) * 2)
    for (i, j), v in zip(_PAIRS, cov, strict=True):
        c[i, j] = c[j, i] = v
    ruled = np.diag(c) > np.square(FLOOR)
    at, inverse = np.ix_(ruled, ruled), np.zeros_like(c)
    values, vectors = np.linalg.eigh(c[at])
    inverse[at] = (vectors / np.maximum(values, 1e-6)) @ vectors.T  # features that move together
    fixed = np.where(ruled, 0.0, 1 / np.square(FLOOR))
    return {**{f"m{i}": float(m) for i, m in enumerate(mean)}, **{f"w{i}{j}": float(inverse[i, j]) for i, j in _PAIRS},
            **{f"f{i}": float(x) for i, x in enumerate(fixed)}, "typical": CHI2_MEDIANS[int(ruled.sum())]}


def _with_inverse(moments: DataFrame) -> DataFrame:
    """The estimate of each group from its mean and covariance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"lang": r["lang"], "source": r["source"], **estimate(r["mean"], r["cov"])} for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), *((c, pa.float64()) for c in numbers)]))

    numbers = [f"m{i}" for i in range(len(FEATURES))] + [f"w{i}{j}" for i, j in _PAIRS] + [f"f{i}" for i in range(len(FEATURES))] + ["typical"]
    return moments.mapInArrow(run, "lang string, source string, " + ", ".join(f"{c} double" for c in numbers))


def _moments(rows: DataFrame, prior_rows: float) -> DataFrame:
    """Mean and covariance of each group, drawn towards those of all rows by ``prior_rows`` pseudo-rows."""
    sums = [F.sum(F.lit(1.0)).alias("n"), *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i, j in _PAIRS]]
    by_group = rows.groupBy("lang", "source").agg(*sums)
    every = by_group.agg(*[F.sum(c).alias(f"all_{c}") for c in by_group.columns[2:]])
    both = by_group.crossJoin(F.broadcast(every))  # one row
    weight = F.lit(prior_rows) / F.greatest(F.col("all_n"), F.lit(1.0))
    total = F.col("n") + weight * F.col("all_n")
    mean = [(F.col(f"s{i}") + weight * F.col(f"all_s{i}")) / total for i in range(len(FEATURES))]
    cov = [(F.col(f"q{i}{j}") + weight * F.col(f"all_q{i}{j}")) / total - mean[i] * mean[j] for i, j in _PAIRS]
    return both.select("lang", "source", F.array(*mean).alias("mean"), F.array(*cov).alias("cov"))


def _attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(table) if table.count() <= 100_000 else table, ["lang", "source"])


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", subset: float = 0.75,
          steps: int = 4, cutoff: float = CHI2_CUTOFF, prior_rows: float = 20.0) -> DataFrame:
    """doc_id, the statistics, base_failed, the scaled squared distance and kept of every row."""
    ready(docs.sparkSession)
    carry = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
             F.col(lang).isNull().alias("no_lang"), F.col(source).isNull().alias("no_source")]
    stats = text_statistics(docs, text, carry).withColumns(dict(zip(FEATURES, _vector(), strict=True))).withColumn("base_failed", base_failed())
    # a null and an empty name stay different groups
    stats = stats.withColumn("lang", F.when(F.col("no_lang"), "-").otherwise(F.concat(F.lit("="), "lang"))) \
        .withColumn("source", F.when(F.col("no_source"), "-").otherwise(F.concat(F.lit("="), "source"))).drop("no_lang", "no_source")
    stats = materialise(stats, "quality-stats")
    fit = stats.filter("not base_failed").select("lang", "source", "n_words", *FEATURES)
    params = None
    for _ in range(steps + 1):
        if params is None:  # start: distance in absolute deviations from the medians
            medians = fit.groupBy("lang", "source").agg(*[F.percentile_approx(f, 0.5, 1000).alias(f"c{i}") for i, f in enumerate(FEATURES)])
            medians = materialise(medians, "quality-medians")
            placed = _attach(fit, medians)
            d2 = sum(((a / F.lit(s)) ** 2 for a, s in zip(_away("c"), START, strict=True)), F.lit(0.0))
        else:
            placed = _attach(fit, params)
            d2 = sum(_distances(), F.lit(0.0))
        placed = placed.withColumn("d2", d2).select("lang", "source", "d2", *FEATURES)
        edges = materialise(placed.groupBy("lang", "source").agg(F.percentile_approx("d2", subset, 1000).alias("edge")), "quality-edges")
        inner = _attach(placed, edges).filter("d2 <= edge")
        before, params = params, materialise(_with_inverse(_moments(inner, prior_rows)), "quality-params")
        release(edges)
        if before is not None:
            release(before)
    ruled, fixed = _distances()
    scale = materialise(_attach(fit, params).withColumn("d2", ruled / F.col("typical")).groupBy("lang", "source")
                        .agg(F.greatest(F.percentile_approx("d2", 0.5, 1000), F.lit(LEAST_SCALE)).alias("scale")), "quality-scale")
    table = materialise(params.join(scale, ["lang", "source"]), "quality-table")
    judged = stats.join(F.broadcast(table) if table.count() <= 100_000 else table, ["lang", "source"], "left").withColumn("distance2", ruled / F.col("scale") + fixed)
    return judged.select("doc_id", *[c.split()[0] for c in STATS.split(", ")], "base_failed", "distance2",
                         (~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))).alias("kept"))
