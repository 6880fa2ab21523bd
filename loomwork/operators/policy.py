"""Ordered rules that give a row its status, and guards for rules that users write."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds; a null condition does not."""
    out = F.lit(default).cast("string")
    for condition, name in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def safe_pattern(pattern: str, most: int = 256) -> bool:
    """A regular expression without look-around, back references and nested repeats, of bounded length, that compiles."""
    if len(pattern) > most or re.search(r"\(\?[=!<]|\\[1-9]|[+*}]\)?[+*{]|\([^()]*[+*][^()]*\)[+*{]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def allowed(value: Column, patterns: list[str]) -> Column:
    """Does value match any valid pattern? Without a valid one everything is allowed."""
    good = [p for p in patterns if safe_pattern(p)]
    if not good:
        return F.lit(True)
    out = F.lit(False)
    for p in good:
        out = out | value.rlike(p)
    return out


def best_match(left: DataFrame, right: DataFrame, on: Column, key: list[str], order: list[Column]) -> DataFrame:
    """left with its best row of right, or nulls: a lateral top-1 as a join and a ranked window. key identifies rows of left."""
    joined = left.join(right, on, "left").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return joined.where("_n = 1").drop("_n")


def firing_runs(df: DataFrame, by: list[str], at: str, firing: str, step: str, least: int) -> DataFrame:
    """(by, run_start, run_end, n) of runs of at least least firing rows that are step apart."""
    order = Window.partitionBy(*by).orderBy(at) if by else Window.orderBy(at)
    f = df.where(firing).withColumn("_new", F.when(F.lag(at).over(order) + F.expr(f"interval {step}") == F.col(at), 0).otherwise(1))
    f = f.withColumn("_k", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return f.groupBy(*by, "_k").agg(F.min(at).alias("run_start"), F.max(at).alias("run_end"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_k")
