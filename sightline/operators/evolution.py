"""How panels change between periods: drift of source shares, owned shares, co-citation edges, communities, opportunities, concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.operators.panel import group_states, pair_divergence, sampled_change, shares
from sightline.operators.tables import full_outer


def portfolio_drift(rows: DataFrame, period: str, before: str, after: str, group: list[str], unit: list[str], item: str) -> DataFrame:
    """Per group, over the units with citations in both periods: divergence of the item shares per unit (mean, median) and of all events, and the items gained and lost.

    Divergences are in bits from 0 to 1. Groups without a matched unit are left out.
    """
    both = rows.where(F.col(period).isin(before, after)).groupBy(*group, *unit).agg(F.countDistinct(period).alias("_p")).where("_p = 2").drop("_p")
    matched = rows.where(F.col(period).isin(before, after)).join(both, [*group, *unit], "left_semi")
    each = pair_divergence(shares(matched, [*group, *unit, period], item), [*group, *unit], period, item)
    per_unit = each.groupBy(*group).agg(F.count("*").alias("units"), F.avg("divergence").alias("mean_divergence"), F.median("divergence").alias("median_divergence"))
    pooled = pair_divergence(shares(matched, [*group, period], item), group, period, item).select(*group, "shared", F.col("jaccard").alias("pooled_jaccard"), F.col("divergence").alias("pooled_divergence"))
    seen = matched.groupBy(*group, item).agg(F.max(F.col(period) == before).alias("b"), F.max(F.col(period) == after).alias("a"))
    turnover = seen.groupBy(*group).agg(F.count_if(F.col("a") & ~F.col("b")).alias("gained"), F.count_if(F.col("b") & ~F.col("a")).alias("lost"))
    return per_unit.join(pooled, group).join(turnover, group)


def owned_share_change(rows: DataFrame, owned: Column, period: str, before: str, after: str, group: list[str], unit: list[str]) -> DataFrame:
    """Per group: change of the owned share of a unit's citations over units in both periods: mean, its range when one unit is left out, rises, falls, sign test, tail of the falls."""
    per = rows.where(F.col(period).isin(before, after)).groupBy(*group, *unit).agg(
        *[F.sum(F.when(F.col(period) == p, owned.cast("double"))).alias(f"{n}_own") for p, n in ((before, "b"), (after, "a"))], *[F.count_if(F.col(period) == p).alias(f"{n}_all") for p, n in ((before, "b"), (after, "a"))]
    ).where("b_all > 0 AND a_all > 0")
    moved = per.withColumn("b", F.col("b_own") / F.col("b_all")).withColumn("a", F.col("a_own") / F.col("a_all")).withColumn("d", F.col("a") - F.col("b"))
    out = moved.groupBy(*group).agg(
        F.count("*").alias("units"), F.avg("b").alias("before_share"), F.avg("a").alias("after_share"), F.avg("d").alias("mean_change"), F.sum("d").alias("_s"), F.min("d").alias("_lo"), F.max("d").alias("_hi"),
        F.count_if(F.col("d") > 0).alias("rises"), F.count_if(F.col("d") < 0).alias("falls"),
    )
    less_one = lambda x: (F.col("_s") - F.col(x)) / F.nullif(F.col("units") - 1, F.lit(0))
    out = out.withColumn("without_one_lowest", less_one("_hi")).withColumn("without_one_highest", less_one("_lo"))
    return out.withColumn("p", stats.sign_test_p(F.col("rises"), F.col("falls"))).withColumn("fall_tail", stats.binomial_tail(F.col("falls"), F.col("rises") + F.col("falls"))).drop("_s", "_lo", "_hi")


def owned_share_gate(changes: DataFrame, drop: float = 0.05, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """(compared, violations, complete, passed) of owned_share_change: groups of `least` units whose mean share fell by more than `drop` with a sign test of at most `alpha`; fails closed."""
    ready = F.col("units") >= least
    bad = ready & (F.col("mean_change") < -drop) & (F.col("p") <= alpha)
    return changes.agg(F.count_if(ready).alias("compared"), F.count_if(bad).alias("violations")).withColumn("complete", F.col("compared") > 0).withColumn("passed", F.col("complete") & (F.col("violations") == 0))


def _edge_states(observations: DataFrame, rows: DataFrame, period: str, before: str, after: str, side: str, unit: list[str], item: str) -> tuple[DataFrame, DataFrame]:
    """(units, edges): units of a side with complete lists in both periods, and the pairs of items cited together in them, with flags e0, e1 by period."""
    states = group_states(observations.where(F.col(period).isin(before, after)), [side, *unit, period])
    units = states.groupBy(side, *unit).agg(F.count("*").alias("_p"), F.min("all_complete").alias("_c")).where("_p = 2 AND _c").select(side, *unit)
    cells = rows.where(F.col(period).isin(before, after)).join(units, [side, *unit], "left_semi").select(side, *unit, period, item).distinct()
    x, y = cells.withColumnRenamed(item, "left_item"), cells.withColumnRenamed(item, "right_item")
    pairs = x.join(y, [side, *unit, period]).where("left_item < right_item")
    flag = lambda p: F.max((F.col(period) == p).cast("int"))
    return units, pairs.groupBy(side, *unit, "left_item", "right_item").agg(flag(before).alias("e0"), flag(after).alias("e1"))


def edge_changes(observations: DataFrame, rows: DataFrame, period: str, before: str, after: str, side: str, unit: list[str], item: str) -> DataFrame:
    """Per side and pair of items: units where the pair was kept, gained and lost between periods, McNemar's p, and whether the network gained, lost or kept the edge."""
    _, edges = _edge_states(observations, rows, period, before, after, side, unit, item)
    n = lambda a, b: F.count_if((F.col("e0") == a) & (F.col("e1") == b))
    out = edges.groupBy(side, "left_item", "right_item").agg(n(1, 1).alias("kept"), n(0, 1).alias("gained"), n(1, 0).alias("lost"))
    state = F.when(F.col("kept") + F.col("lost") == 0, "gain").when(F.col("kept") + F.col("gained") == 0, "loss").otherwise("both")
    return out.withColumn("p", stats.mcnemar_p(F.col("gained"), F.col("lost"))).withColumn("state", state)


def edge_drift(observations: DataFrame, rows: DataFrame, period: str, before: str, after: str, side: str, unit: list[str], item: str, least_support: int = 2, least_units: int = 30) -> DataFrame:
    """Difference in differences of pairs of items between two sides: the change of the second side's share of units with the pair, less the first's.

    Over units that both sides have with complete lists in both periods; pairs that fewer than `least_support` of them show are
    left out. With `least_units` units and some variance there are a normal 95 % interval and p, else nulls. The range without
    one unit needs two units.
    """
    units, edges = _edge_states(observations, rows, period, before, after, side, unit, item)
    a, b = units.withColumnRenamed(side, "side_a"), units.withColumnRenamed(side, "side_b")
    shared = a.join(b, unit).where("side_a < side_b")
    n = shared.groupBy("side_a", "side_b").agg(F.count("*").alias("units"))
    first = shared.join(edges.withColumnRenamed(side, "side_a"), ["side_a", *unit]).select("side_a", "side_b", *unit, "left_item", "right_item", F.col("e0").alias("a0"), F.col("e1").alias("a1"), F.lit(0).alias("b0"), F.lit(0).alias("b1"))
    second = shared.join(edges.withColumnRenamed(side, "side_b"), ["side_b", *unit]).select("side_a", "side_b", *unit, "left_item", "right_item", F.lit(0).alias("a0"), F.lit(0).alias("a1"), F.col("e0").alias("b0"), F.col("e1").alias("b1"))
    key = ["side_a", "side_b", "left_item", "right_item"]
    cells = first.unionByName(second).groupBy(*key, *unit).agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")]).withColumn("d", F.col("b1") - F.col("a1") - (F.col("b0") - F.col("a0")))
    sums = cells.groupBy(*key).agg(F.count("*").alias("support"), *[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")], F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.min("d").alias("lo"), F.max("d").alias("hi")).where(F.col("support") >= least_support)
    rest = sums.join(F.broadcast(n), ["side_a", "side_b"])
    low, high = (F.when(F.col("support") < F.col("units"), f(F.lit(0), F.col(c))).otherwise(F.col(c)) for f, c in ((F.least, "lo"), (F.greatest, "hi")))
    m = F.col("units")
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s").cast("double") * F.col("s") / m) / (m - 1) / m)
    effect, known = F.col("s") / m, (m >= least_units) & (error > 0)
    return rest.select(
        *key, "units", "support", *["a0", "a1", "b0", "b1"], effect.alias("difference"), F.when(m > 1, (F.col("s") - high) / (m - 1)).alias("without_one_lowest"), F.when(m > 1, (F.col("s") - low) / (m - 1)).alias("without_one_highest"),
        F.when(known, effect - stats.Z95 * error).alias("lower"), F.when(known, effect + stats.Z95 * error).alias("upper"), F.when(known, stats.normal_p(effect / error)).alias("p"),
    )


def lineage(items: DataFrame, before: str, after: str) -> DataFrame:
    """(before, after, shared, before_size, after_size, change) of each two overlapping groups of two partitions of the same items.

    stable: the same members; split, merge, split-and-merge: the first group goes to several, the second comes from several; else reconfigured.
    """
    cells = items.where(F.col(before).isNotNull() & F.col(after).isNotNull()).groupBy(before, after).agg(F.count("*").alias("shared"))
    b = cells.groupBy(before).agg(F.sum("shared").alias("before_size"), F.count("*").alias("_t"))
    a = cells.groupBy(after).agg(F.sum("shared").alias("after_size"), F.count("*").alias("_f"))
    change = F.when((F.col("_t") == 1) & (F.col("_f") == 1), "stable").when((F.col("_t") > 1) & (F.col("_f") > 1), "split-and-merge").when(F.col("_t") > 1, "split").when(F.col("_f") > 1, "merge").otherwise("reconfigured")
    return cells.join(b, before).join(a, after).select(before, after, "shared", "before_size", "after_size", change.alias("change"))


def opportunity_months(observations: DataFrame, rows: DataFrame, keys: list[str], owned: Column, value: str, month: str) -> DataFrame:
    """(value, month, gap_groups, observations, previous_month, change, skipped_months): opportunities by month against the value's previous sampled month."""
    scope = [*keys, month]
    states = group_states(observations, scope)
    has_owned = rows.groupBy(*scope).agg(F.max(F.coalesce(owned, F.lit(False))).alias("has_owned"))
    gaps = states.where("all_complete").join(has_owned, scope).where("NOT has_owned").select(*scope)
    counted = rows.join(gaps, scope, "left_semi").where(F.col(value).isNotNull()).groupBy(value, month).agg(F.countDistinct(*scope).alias("gap_groups"), F.countDistinct("observation_id").alias("observations"))
    return sampled_change(counted, [value], month, "gap_groups")


def month_drift(rows: DataFrame, item: str, month: str) -> DataFrame:
    """(month, events, hhi, largest_share, previous_month, hhi_change, divergence) of item shares in each month, against the month sampled before it."""
    s = shares(rows.where(F.col(item).isNotNull() & F.col(month).isNotNull()), [month], item)
    months = s.groupBy(month).agg(F.sum("n").alias("events"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max("share").alias("largest_share"))
    # one row a month of the panel's history
    line = Window.partitionBy(F.lit(0)).orderBy(month)
    months = months.withColumn("previous_month", F.lag(month).over(line)).withColumn("hhi_change", F.col("hhi") - F.lag("hhi").over(line))
    sides = months.where("previous_month IS NOT NULL").select(month, F.explode(F.array(F.struct(F.col(month).alias("at"), F.lit("now").alias("side")), F.struct(F.col("previous_month").alias("at"), F.lit("then").alias("side")))).alias("x")).select(month, "x.at", "x.side")
    two = F.broadcast(sides).join(s.withColumnRenamed(month, "at"), "at").select(month, "side", item, "share")
    return months.join(pair_divergence(two, [month], "side", item).select(month, "divergence"), month, "left")


def concordance(answers: DataFrame, exported: DataFrame, key: str, names: tuple[str, str] = ("answers-only", "export-only")) -> DataFrame:
    """Both tables side by side by address, with `join_state` matched, or the name of the side that alone has it."""
    both = full_outer(answers, exported, [key], ("", ""))
    return both.withColumn("join_state", F.when(F.col("presence") == "both", "matched").when(F.col("presence") == "left-only", names[0]).otherwise(names[1])).drop("presence")


def transitions(before: DataFrame, after: DataFrame, key: str, state: str = "join_state") -> DataFrame:
    """(key, before, after, transition) of two concordances: matched-both, lost-match, newly-matched, appeared, disappeared, unchanged- or changed-unmatched."""
    both = full_outer(before.select(key, state), after.select(key, state), [key], ("_b", "_a"))
    b, a = F.col(f"{state}_b"), F.col(f"{state}_a")
    met = lambda c: F.coalesce(c == "matched", F.lit(False))
    kind = (
        F.when(met(b) & met(a), "matched-both").when(met(b), "lost-match").when(met(a), "newly-matched").when(b.isNull(), "appeared").when(a.isNull(), "disappeared").when(b == a, "unchanged-unmatched").otherwise("changed-unmatched")
    )
    return both.select(key, b.alias("before"), a.alias("after"), kind.alias("transition"))


def without_each(rows: DataFrame, group: list[str], unit: str, item: str) -> DataFrame:
    """(group, unit, events, hhi, hhi_without): the Herfindahl index of each group as it is and without each of its units; null if nothing is left."""
    cells = rows.groupBy(*group, unit, item).agg(F.count("*").alias("x"))
    items = cells.groupBy(*group, item).agg(F.sum("x").alias("n"))
    totals = items.groupBy(*group).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    per = cells.join(items, [*group, item]).groupBy(*group, unit).agg(F.sum("x").alias("events"), F.sum(F.col("x") * F.col("x") - 2 * F.col("n") * F.col("x")).alias("delta"))
    left = (F.col("total") - F.col("events")).cast("double")
    square = lambda c: c.cast("double") * c
    return per.join(totals, group).select(*group, unit, "events", (F.col("squares") / square(F.col("total"))).alias("hhi"), F.when(left > 0, (F.col("squares") + F.col("delta")) / (left * left)).alias("hhi_without"))


def detection(rows: DataFrame, unit: str, item: str, sizes: list[int]) -> DataFrame:
    """(item, units_with, units, k, chance): the chance that a random sample of k units holds at least one with the item."""
    per = rows.select(unit, item).distinct().groupBy(item).agg(F.count("*").alias("units_with"))
    n = rows.select(unit).distinct().agg(F.count("*").alias("units"))
    out = per.join(F.broadcast(n)).withColumn("k", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("k <= units")
    return out.withColumn("chance", 1 - stats.absent_share(F.col("units"), F.col("units") - F.col("units_with"), F.col("k")))
