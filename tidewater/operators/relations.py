"""Joins, sets and keyed helpers that are more than one DataFrame method."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """df, if it has all the columns; an error that names the missing ones otherwise."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], validate: str, how: str = "left") -> DataFrame:
    """A join whose sides have the cardinality told (many_to_one, one_to_one, one_to_many); an error
    otherwise. One short job probes each side that must be unique."""
    for side, df in (("one_to", left), ("to_one", right)):
        if side in validate and repeated_keys(df, keys).limit(1).count():
            raise ValueError(f"keys {keys} are not unique: {validate} was asked for")
    return left.join(right, keys, how)


def outer_sums(left: DataFrame, right: DataFrame, keys: list[str], left_value: str, right_value: str) -> DataFrame:
    """Both aggregates for each key that either has; 0 where there is none."""
    return left.join(right, keys, "full_outer").fillna(0, [left_value, right_value])


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the side's name; empty if both cover each other exactly."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))


def undominated(df: DataFrame, key: str, less: list[str], more: list[str]) -> DataFrame:
    """Rows that no other row beats: none is at least as good in all measures and better in one. Compared in
    pairs, so only for a list of candidates whose length is bounded."""
    other = df.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in less + more])
    as_good = reduce(Column.__and__, [F.col(f"_{c}") <= F.col(c) for c in less] + [F.col(f"_{c}") >= F.col(c) for c in more])
    better = reduce(Column.__or__, [F.col(f"_{c}") < F.col(c) for c in less] + [F.col(f"_{c}") > F.col(c) for c in more])
    return df.join(other, as_good & better, "left_anti")


def within(left: DataFrame, right: DataFrame, by: list[str], left_day: str, right_day: str, days: int, how: str = "inner") -> DataFrame:
    """A band join of dates at most `days` apart, as an equi-join: time is cut into buckets of `days` + 1, a
    left row goes to its own one and a right row to its own and both next to it."""
    width = days + 1
    number = lambda c: F.unix_date(F.col(c))
    l = left.withColumn("_bucket", F.floor(number(left_day) / width))
    r = right.withColumn("_bucket", F.explode(F.array(*[F.floor(number(right_day) / width) + k for k in (-1, 0, 1)])))
    near = F.abs(number(left_day) - number(right_day)) <= days
    return l.alias("l").join(r.alias("r"), [F.col(f"l.{c}") == F.col(f"r.{c}") for c in by] + [F.col("l._bucket") == F.col("r._bucket"), near], how)


def dense_codes(df: DataFrame, value: str, out: str) -> DataFrame:
    """Numbers from 0 for the values in ascending order. Only for a column with a bounded list of values."""
    from pyspark.sql import Window

    codes = df.select(value).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(value)) - 1)
    return df.join(codes, value)


def indicator(value: str, levels: list[str], prefix: str) -> list[Column]:
    """0 or 1 for each level but the first, which is the reference."""
    return [(F.col(value) == v).cast("double").alias(f"{prefix}_{v}") for v in sorted(levels)[1:]]
