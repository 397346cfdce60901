"""Deterministic splits, folds and class weights.

Randomness is a hash: each row's position inside its label is its rank by
``md5(id || '-' || seed)``.  Ranks within a label are computed with the
distributed running count (``prefix_sums``), never with a window over a whole
class (one class can hold most of the rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.stats import prefix_sums
from claimlens.session import materialize, small


def hash_key(id_col: str, seed: int = 42):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def rank_within(df: DataFrame, id_col: str, by: str, seed: int = 42) -> DataFrame:
    """Adds ``_rank`` (1-based) of each row within its ``by`` value, in hash order, and ``_n`` (group size)."""
    k = F.concat(F.col(by).cast("string"), F.lit("\x00"), hash_key(id_col, seed), F.lit("\x00"),
                 F.col(id_col).cast("string"))
    base = df.withColumns({"_key": k, "_one": F.lit(1)})
    cum = prefix_sums(base, "_key", ["_one"])
    sizes = base.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    # offsets of each label: rows of smaller labels (one row per label value: a bounded window)
    offs = sizes.select(by, "_n", F.coalesce(F.sum("_n").over(
        Window.orderBy(F.col(by).cast("string")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = cum.join(small(offs), by)  # one row per label value
    return out.withColumn("_rank", F.col("cum__one") - F.col("_off")).drop("_key", "_one", "cum__one", "_off")


def stratified_split(df: DataFrame, id_col: str, label: str, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """``split`` = 'test' for the first ceil(pct% of n_label) rows of each label in hash order."""
    r = rank_within(df, id_col, label, seed)
    n_test = ((F.col("_n") * test_pct + 99) / 100).cast("long")
    return r.withColumn("split", F.when(F.col("_rank") <= n_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_rank", "_n")


def stratified_kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` = (rank within label - 1) mod k, so every fold gets each class evenly."""
    r = rank_within(df, id_col, label, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class (one row per class)."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    t = c.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(t)).select(label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (a join with the table of classes, broadcast when
    it is small)."""
    w = small(class_weights(df, label).select(label, F.col("weight").alias(out)))
    return df.join(w, label, "left")


#: Groups that are dealt in windows, several attempts a job.
FEW_GROUPS = 10_000


def group_folds(df: DataFrame, group: str, label: str, k: int = 4, seed: int = 42,
                max_attempts: int = 200) -> DataFrame:
    """Folds that keep groups whole and give every fold both classes.

    Groups are dealt round-robin in hash order (``md5(group, seed, attempt)``); an
    attempt is accepted when each of the k folds holds both label values.  The
    group table (one row per group) is ranked with the distributed running count.
    Raises after ``max_attempts`` failed attempts.
    """
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.sum((F.col(label) == 1).cast("int")).alias("pos"), F.sum((F.col(label) == 0).cast("int")).alias("neg"))
    groups = materialize(groups)  # the rows are read once, whatever the number of attempts
    balanced = (F.count(F.lit(1)) == k) & (F.min("p") > 0) & (F.min("q") > 0)
    if groups.count() <= FEW_GROUPS:
        # a small table: twenty attempts a job, ranked in a window each
        for first in range(0, max_attempts, 20):
            tries = F.explode(F.sequence(F.lit(first), F.lit(min(first + 20, max_attempts) - 1))).alias("attempt")
            g = groups.select("*", tries).withColumn("_gid", F.concat(F.col(group).cast("string"), F.lit("#"), F.col("attempt").cast("string")))
            place = F.row_number().over(Window.partitionBy("attempt").orderBy(F.concat(hash_key("_gid", seed), F.col("_gid"))))
            dealt = g.select("attempt", group, "pos", "neg", ((place - 1) % k).cast("int").alias("fold"))
            good = dealt.groupBy("attempt", "fold").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")) \
                .groupBy("attempt").agg(balanced.alias("ok")).where("ok").agg(F.min("attempt")).first()[0]
            if good is not None:
                return df.join(small(dealt.where(F.col("attempt") == good).select(group, "fold")), group, "left")
        raise ValueError(f"no balanced group folds after {max_attempts} attempts")
    for attempt in range(max_attempts):
        g = groups.withColumn("_gid", F.concat(F.col(group).cast("string"), F.lit(f"#{attempt}")))
        ranked = prefix_sums(g.withColumns({"_key": F.concat(hash_key("_gid", seed), F.col("_gid")),
                                            "_one": F.lit(1)}), "_key", ["_one"])
        assigned = ranked.select(group, "pos", "neg", ((F.col("cum__one") - 1) % k).cast("int").alias("fold"))
        if assigned.groupBy("fold").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).agg(balanced).first()[0]:
            return df.join(small(assigned.select(group, "fold")), group, "left")
    raise ValueError(f"no balanced group folds after {max_attempts} attempts")


def fold_filter(df: DataFrame, folds: DataFrame, key: str, fold_ids: Sequence[int], keep: bool = True) -> DataFrame:
    """Rows whose group belongs (semi join) / does not belong (anti join) to the given folds."""
    sel = folds.where(F.col("fold").isin(list(fold_ids))).select(key).distinct()
    return df.join(sel, key, "left_semi" if keep else "left_anti")
