"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, merging, stored, together

#: The marginals that are raked, in this order.
AXES = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Words between white space: the weight of a document."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic of what a text is made of, for tables that have none: symbols, capitals, lists, short, long, prose."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.regexp_count(text, F.lit("[#$%&*<>{}|=_~^]"))
    capitals = F.regexp_count(text, F.lit("[A-Z]{2,}"))
    lines = F.regexp_count(text, F.lit("\\n"))
    return (
        F.when(symbols * 5 > n_tokens, "symbols").when(capitals * 4 > n_tokens, "capitals").when(lines * 8 > n_tokens, "lists")
        .when(n_tokens < 60, "short").when(n_tokens > 2000, "long").otherwise("prose")
    )


def tempered(cells: DataFrame, axis: str, temperature: float) -> DataFrame:
    """Default targets of an axis: its token shares to a power below 1, which lifts what is rare; they sum to 1."""
    share = cells.groupBy(axis).agg(F.sum("n").alias("n")).withColumn("t", F.pow("n", F.lit(temperature)))
    return share.select(axis, (F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0)))).alias("target"))


def _filled(rows: DataFrame, by: Column, total: Column) -> DataFrame:
    """Scales u > 0 by one factor a group so that the sum of least(n, u) is total, or all of n where that is less.

    The sum grows with the factor and bends where a row reaches n; rows whose bend lies within total are whole."""
    group = Window.partitionBy(by)
    past = group.orderBy(F.desc("fill"))  # the frame takes in rows of equal fill
    rows = rows.withColumn("fill", F.col("u") / F.col("n")).withColumn("bend", F.sum("n").over(past) + (F.sum("u").over(group) - F.sum("u").over(past)) / F.col("fill"))
    whole = F.col("bend") <= total
    left = F.sum(F.when(whole, 0.0).otherwise(F.col("u"))).over(group)
    factor = F.when(left > 0, (total - F.sum(F.when(whole, F.col("n")).otherwise(0.0)).over(group)) / F.when(left > 0, left)).otherwise(1 / F.min("fill").over(group))
    return rows.withColumn("u", F.col("u") * factor).drop("fill", "bend")


def feasible(cells: DataFrame, axis: str, targets: DataFrame, budget: float) -> DataFrame:
    """(axis, goal): the share of all tokens to take of each value: budget split as the targets say, but no value beyond its own
    tokens; what such values cannot give is split over the others as their targets say."""
    held = cells.groupBy(axis).agg(F.sum("n").alias("n"))
    rows = held.join(targets.withColumnRenamed(axis, "value"), F.col(axis).eqNullSafe(F.col("value"))).where("target > 0").select(axis, "n", F.col("target").cast("double").alias("u"))
    return _filled(rows, F.lit(0), F.lit(budget)).select(F.col(axis).alias("value"), F.least("n", "u").alias(f"goal_{axis}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, tol: float = 1e-6, max_rounds: int = 200, rounds_a_check: int = 4, few: bool = False) -> DataFrame:
    """cells (one row per source, language and topic; n > 0 tokens) with p <= 1, the part to take, so that the marginals of what
    is taken are the targets' share of budget, or nearest to it where a value holds less (see feasible).

    Each round scales along each axis; a cell that would exceed its tokens is whole and the others make up for it. A round is a
    job, so plans stay small on the driver; after some of them the largest gap of a marginal is looked at (one number), until
    it is below tol. Marginals that contradict each other end at max_rounds. Gaps that remain are told in a warning. With few
    the cells stay in one partition, and a round is one task.
    """
    cells, targets = together(cells, few), {axis: merging(together(targets[axis], few), few) for axis in AXES}
    w = cells.withColumn("n", F.col("n") / F.lit(cells.agg(F.sum("n")).first()[0]).cast("double")).withColumn("u", F.col("n") * budget)
    for axis in AXES:  # stored each time: an axis reads the cells twice, so that three in one plan would read them eight times
        goals = together(feasible(w, axis, targets[axis], budget), few)
        w = together(stored(w.join(merging(goals, few), w[axis].eqNullSafe(goals["value"])).drop("value"), "mix-cells"), few)
    for _ in range(0, max_rounds, rounds_a_check):
        for _ in range(rounds_a_check):
            for axis in AXES:
                w = _filled(w, F.col(axis), F.col(f"goal_{axis}"))
            w = together(stored(w, "mix-round"), few)
        gaps = [w.groupBy(axis).agg(F.abs(F.sum(F.least("n", "u")) - F.first(f"goal_{axis}")).alias("gap")).select("gap") for axis in AXES]
        worst = reduce(DataFrame.unionAll, gaps).agg(F.max("gap")).first()[0]
        if worst is None or worst < tol * budget:
            break
    w = w.withColumn("p", F.least(F.lit(1.0), F.col("u") / F.col("n")))
    ends = reduce(DataFrame.unionAll, (shares(w.withColumn("taken", F.col("n") * F.col("p")), axis, targets[axis]).select("axis", "target", "share") for axis in AXES))
    missed = {r["axis"]: r["count"] for r in ends.where(F.abs(F.col("share") - F.col("target")) > 10 * tol).groupBy("axis").count().collect()}
    if missed:
        warnings.warn(f"mixing: values whose share is not the target at a budget of {budget:g}: {missed}; see gaps()", stacklevel=3)
    return w


def shares(taken: DataFrame, axis: str, targets: DataFrame) -> DataFrame:
    """(axis, value, target, share) of expected tokens taken; targets are scaled to sum to 1."""
    got = taken.groupBy(F.col(axis).alias("got")).agg(F.sum("taken").alias("taken"))
    both = targets.join(got, F.col(axis).eqNullSafe(F.col("got")), "full")
    part = lambda c: F.coalesce(F.try_divide(c, F.sum(c).over(Window.partitionBy(F.lit(0)))), F.lit(0.0)).cast("double").alias("share" if c == "taken" else c)
    return both.select(F.lit(axis).alias("axis"), F.coalesce(axis, "got").alias("value"), part("target"), part("taken"))


def gaps(mixed: DataFrame, targets: dict[str, DataFrame] | None = None, temperature: float = 0.7) -> DataFrame:
    """(axis, value, target, share): the targets and what mix_sources' rows are expected to hold of each value."""
    cells = mixed.where("n_tokens > 0").groupBy(*AXES).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("probability")).alias("taken"))
    return reduce(DataFrame.unionAll, (shares(cells, axis, targets[axis] if targets else tempered(cells, axis, temperature)) for axis in AXES))


def mix_sources(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = 0.5, temperature: float = 0.7, seed: int = 7, topic: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, selected.

    Token weights are raked to the marginals of source, language and topic; targets gives (axis value, target) tables, else
    tempered shares are used. A document of a cell is taken with probability budget * raked share / own share, by a hash of
    seed and id: the same on every run and executor. Where that exceeds 1 the cell is taken whole and the others are raked to
    what is left of each marginal, so that budget of all tokens is kept (see rake); gaps() compares shares with targets. Null
    sources, languages and topics are values of their own. Empty and null texts have no tokens and are never selected. Rows
    repeated with one id share their lot. An empty table gives no rows. topic names a column; else topic_of() is used.
    """
    words = tokens(F.col("text"))
    base = docs.select("doc_id", "source", "lang", words.alias("n_tokens"), (F.col(topic) if topic else topic_of(F.col("text"), words)).alias("topic"))
    base = stored(base, "mix-docs")
    cells = stored(base.where("n_tokens > 0").groupBy(*AXES).agg(F.sum("n_tokens").alias("n")), "mix-sums")
    few = cells.count() <= FEW_ROWS
    targets = targets or {axis: tempered(together(cells, few), axis, temperature) for axis in AXES}
    odds = rake(cells, targets, budget, few=few).select(*(F.col(a).alias(f"cell_{a}") for a in AXES), "p")
    same = reduce(Column.__and__, (F.col(a).eqNullSafe(F.col(f"cell_{a}")) for a in AXES))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / F.lit(float(1 << 52))
    chance = F.when(F.col("n_tokens") > 0, F.coalesce("p", F.lit(0.0))).otherwise(0.0)
    return base.join(odds, same, "left").select("doc_id", *AXES, "n_tokens", chance.alias("probability"), (draw < chance).alias("selected"))
