"""Sparse log-domain matrices as long tables: a missing row is -inf."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladelake.functions.numeric import logsumexp, softmax
from cladelake.operators.ranking import global_rank


def lse_matmul(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], a_value: str, b_value: str, out: str = "ll", deal: list[str] | None = None) -> DataFrame:
    """Log-semiring product: join on the inner index, log-sum-exp over it.

    Few inner indices lead to one cell, so the product's rows are shuffled
    once: by the cell, or by ``deal``, some of its keys, where what follows
    works by those and can stay in that partitioning.
    """
    joined = a.join(b, on).withColumn("x_", F.col(a_value) + F.col(b_value)).select(*keys, "x_")
    if deal:
        joined = joined.repartition(*deal)
    return logsumexp(joined, keys, "x_", out, small_groups=True)


def column_normalised_row_sum(df: DataFrame, row: str, col: str, value: str, out: str = "total") -> DataFrame:
    """Row sums after dividing each entry by its column's sum."""
    sums = df.groupBy(col).agg(F.sum(value).alias("col_sum_"))
    return df.join(sums, col).groupBy(row).agg(F.sum(F.col(value) / F.col("col_sum_")).alias(out))


def argmax_vote(df: DataFrame, item: list[str], choice: list[str], value: str) -> DataFrame:
    """Votes by choice: every choice that attains an item's maximum gets one; choices without votes are absent.

    A rank over each item's rows, cut off after the first place, is computed
    once and limited before the shuffle; ties all have rank one.
    """
    place = F.rank().over(Window.partitionBy(*item).orderBy(F.desc(value)))
    return df.withColumn("place_", place).where("place_ = 1").groupBy(*choice).agg(F.count("*").alias("votes"))


def correlation(df: DataFrame, item: list[str], choice: str, value: str) -> DataFrame:
    """Correlation of the choices' softmax shares over items.

    Shares missing for an item are zero, so moments divide by the number of
    items, not of rows. Pairs that share no item are not returned: with
    E[pp'] = 0 theirs is -x y / (sx sy) of the choices' means and deviations,
    and there are as many of them as choices squared.
    """
    p = df.select(*item, F.col(choice).alias("s"), softmax(F.col(value), item).alias("p"))
    n = df.select(*item).distinct().agg(F.count("*").alias("n"))
    one = p.groupBy("s").agg(F.sum("p").alias("sum_p"), F.sum(F.col("p") * F.col("p")).alias("sum_pp"))
    other = p.select(*item, F.col("s").alias("s2"), F.col("p").alias("p2"))
    both = p.join(other, item).where("s < s2").groupBy("s", "s2").agg(F.sum(F.col("p") * F.col("p2")).alias("sum_cross"))
    left = one.select(F.col("s"), F.col("sum_p").alias("x"), F.col("sum_pp").alias("xx"))
    right = one.select(F.col("s").alias("s2"), F.col("sum_p").alias("y"), F.col("sum_pp").alias("yy"))
    joined = both.join(left, "s").join(right, "s2").crossJoin(F.broadcast(n))
    cov = F.col("sum_cross") / F.col("n") - F.col("x") / F.col("n") * F.col("y") / F.col("n")
    sd = F.sqrt((F.col("xx") / F.col("n") - F.pow(F.col("x") / F.col("n"), 2)) * (F.col("yy") / F.col("n") - F.pow(F.col("y") / F.col("n"), 2)))
    corr = F.when((sd > 0) & ~F.isnan(sd), cov / sd).otherwise(0.0)
    return joined.select(F.col("s").alias("a"), F.col("s2").alias("b"), corr.alias("corr"))


def dense_index(df: DataFrame, key: str, order: str, out: str = "idx") -> DataFrame:
    """Number the distinct keys from 0 by first appearance, ties by key."""
    first = df.groupBy(key).agg(F.min(order).alias("first_"))
    return global_rank(first, ["first_", key], out).withColumn(out, F.col(out) - 1).drop("first_")


def point_lookup(df: DataFrame, keys: dict, value: str) -> float:
    """The one entry of a long matrix at the given indices; none and several raise."""
    found = df.where(functools.reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in keys.items()])).select(value).limit(2).collect()
    if len(found) != 1:
        raise KeyError(f"{'no' if not found else 'more than one'} entry at {keys}")
    return found[0][0]
