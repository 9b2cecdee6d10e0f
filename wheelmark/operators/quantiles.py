"""Exact quantiles by rank, without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.tables import kept

#: The sketch's accuracy, and how far on either side of a quantile its brackets are taken: many times its error.
ACCURACY, MARGIN = 10_000, 0.002
#: Different values of a bracket that are ranked in one window, and parts that a larger bracket is cut into.
FITS, PARTS = 100_000, 64


def _bracketed(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """keys, name, at (the rank that is looked for), y, c: how often each value of a quantile's bracket occurs, and under
    the null y how many values lie below it.

    A mergeable sketch brackets each quantile, in one pass over the rows and without a shuffle of them; groups of up to
    ACCURACY values are bracketed as a whole.
    """
    kinds = sorted({column for column, _ in wanted.values()})
    ends = [min(max(q + side * MARGIN, 0.0), 1.0) for _, q in wanted.values() for side in (-1, 1)]
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("double").alias("x")) for c in kinds])).alias("v")).select(*keys, "v.*")
    known = long.where("x IS NOT NULL")
    sketch = known.groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", ends, ACCURACY).alias("p"))
    small = F.col("n") <= ACCURACY
    named = [
        F.when(F.col("kind") == column, F.struct(F.lit(name).alias("name"), F.when(small, F.col("low")).otherwise(F.col("p")[2 * i]).alias("a"), F.when(small, F.col("high")).otherwise(F.col("p")[2 * i + 1]).alias("b"), (F.lit(q) * (F.col("n") - 1)).alias("at")))
        for i, (name, (column, q)) in enumerate(wanted.items())
    ]
    brackets = sketch.select(*keys, "kind", F.explode(F.array_compact(F.array(*named))).alias("w")).select(*keys, "kind", "w.*")
    met = known.join(brackets, [*keys, "kind"]).where("x <= b")
    return met.groupBy(*keys, "name", "at", F.when(F.col("x") >= F.col("a"), F.col("x")).alias("y")).agg(F.count("*").alias("c"))


def narrowed(met: DataFrame, keys: list[str]) -> DataFrame:
    """``met`` (see ``_bracketed``) with at most FITS values in each bracket.

    A larger bracket is cut into PARTS at marks that a sketch of its different values gives; the parts are counted
    exactly, and the bracket becomes those that hold the ranks looked for. Each round leaves about a thirtieth of the
    values. A value that occurs very often is one row from the start, so that ties can't keep a bracket large.
    """
    group = [*keys, "name", "at"]
    met = kept(met, "quantiles")
    while (met.where("y IS NOT NULL").groupBy(*group).count().agg(F.max("count")).first()[0] or 0) > FITS:
        marks = met.where("y IS NOT NULL").groupBy(*group).agg(F.percentile_approx("y", [k / PARTS for k in range(1, PARTS)], ACCURACY).alias("marks"))
        part = F.when(F.col("y").isNull(), -1).otherwise(F.size(F.filter("marks", lambda m: m < F.col("y"))))
        cut = met.join(marks, group).withColumn("part", part).drop("marks")
        over = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        sizes = cut.groupBy(*group, "part").agg(F.sum("c").alias("c")).withColumn("end", F.sum("c").over(over)).withColumn("start", F.col("end") - F.col("c"))
        wanted = [(F.col("start") <= rank) & (rank < F.col("end")) for rank in (F.floor("at"), F.ceil("at"))]
        chosen = sizes.where((wanted[0] | wanted[1]) & (F.col("part") >= 0)).groupBy(*group).agg(F.min("part").alias("first"), F.max("part").alias("last"))
        inner = cut.join(chosen, group).where("part <= last")
        met = kept(inner.groupBy(*group, F.when(F.col("part") >= F.col("first"), F.col("y")).alias("y")).agg(F.sum("c").alias("c")), "quantiles")
    return met


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """``keys`` (without nulls) and for each name in ``wanted`` the quantile of a column: linear between neighbours in rank.

    Brackets around each quantile are narrowed until their values fit into a window, where they are ranked. Nulls have no
    part; a group without values has null quantiles; an empty table gives no rows.
    """
    met = narrowed(_bracketed(rows, keys, wanted), keys)
    over = Window.partitionBy(*keys, "name").orderBy(F.asc_nulls_first("y")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = met.withColumn("end", F.sum("c").over(over)).withColumn("start", F.col("end") - F.col("c"))
    value = lambda rank: F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), F.col("y")))
    found = ranked.groupBy(*keys, "name", "at").agg(value(F.floor("at")).alias("lower"), value(F.ceil("at")).alias("upper"))
    found = found.withColumn("value", F.col("lower") + (F.col("at") - F.floor("at")) * (F.col("upper") - F.col("lower")))
    out = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted])
    return rows.select(*keys).distinct().join(out, keys, "left")


def overall(rows: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with the quantiles over all rows; nulls where there is nothing."""
    found = quantiles(rows.select(F.lit(0).alias("one"), *[F.col(c) for c in sorted({c for c, _ in wanted.values()})]), ["one"], wanted)
    return found.agg(*[F.first(name).alias(name) for name in wanted])


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row each, as one row."""
    return one.withColumn("_one", F.lit(0)).join(other.withColumn("_one", F.lit(0)), "_one").drop("_one")
