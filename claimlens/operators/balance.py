"""SMOTE oversampling (I8) as a Spark job.

The k nearest minority rows of every minority row come from the exact join in ``neighbours``.  Each row then emits its
share of synthetic rows ``x + u (nn - x)``; the share of row i is
``need // n + [rank_i <= need % n]`` with ranks from the distributed running count,
and ``nn``/``u`` are drawn from ``md5(id, j, seed)`` - reproducible and order-free.  Neighbour lists carry
ids only; a synthetic row fetches its one neighbour's vector by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.functions.stats import prefix_sums
from claimlens.operators.folds import hash_key
from claimlens.operators.neighbours import neighbours, usable


def _unit(key: Column) -> Column:
    """A number from 0 to 1 (not 1) drawn from a text."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, minority=1, k: int = 5, seed: int = 42, block_rows: int = 2048) -> DataFrame:
    """Synthetic minority rows ``(source_id, synthetic_index, features array<double>)`` that bring the
    minority class up to the majority count (two-class case).

    Rows with a null vector or a null or non-finite component make no synthetic row and are nobody's neighbour, but count
    toward the class sizes; a class of one row is copied; nothing is made when the minority is not the smaller class.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), (F.col(label) == F.lit(minority)).alias("_min"))
    counts = base.agg((F.count_if(~F.col("_min")) - F.count_if("_min")).alias("need"))
    rows = usable(base.where("_min"), "id", "vec")
    counts = counts.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))
    ranked = prefix_sums(rows.select("uid", "id", F.concat(hash_key("id", seed), F.lit("-"), F.col("uid").cast("string")).alias("_key"), F.lit(1).alias("_one")), "_key", ["_one"])
    more = (F.col("cum__one") <= F.col("need") % F.col("n")).cast("long")
    share = F.when(F.col("need") <= 0, F.lit(0)).otherwise((F.col("need") / F.col("n")).cast("long") + more)
    shares = ranked.crossJoin(F.broadcast(counts)).select("uid", "id", share.cast("int").alias("share")).where(F.col("share") > 0)
    near = neighbours(rows, k, block_rows).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("near"))
    key = F.concat_ws("-", F.col("id").cast("string"), F.col("j").cast("string"), F.lit(str(seed)))
    drawn = shares.join(near, "uid", "left").select("uid", "id", F.explode(F.sequence(F.lit(0), F.col("share") - 1)).alias("j"), "near")
    at = F.floor(_unit(F.concat(F.lit("n"), key)) * F.size("near")).cast("int")
    drawn = drawn.select("uid", "id", "j", F.when(F.col("near").isNotNull(), F.element_at("near", at + 1)["other"]).alias("other"), _unit(F.concat(F.lit("u"), key)).alias("u"))
    x, nn = rows.select("uid", F.col("vec").alias("x")), rows.select(F.col("uid").alias("other"), F.col("vec").alias("nn"))
    made = drawn.join(x, "uid").join(nn, "other", "left")
    step = F.zip_with("x", "nn", lambda a, b: F.coalesce(a, F.lit(0.0)) + F.col("u") * (F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))))
    return made.select(F.col("id").alias("source_id"), F.col("j").alias("synthetic_index"), F.coalesce(step, "x").alias("features"))
