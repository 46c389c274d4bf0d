"""Statistics over panels of cited domains: concentration, divergence, paired reach, opportunities, retention, rarefaction.

A panel is long: one row for every citation, with a group (whatever is compared), a unit (the prompt), an item (the
domain), the observation, its rank in the list, and whether the list is complete. Absence is known only in complete
lists: where a list is incomplete, "not cited" is null, never false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.operators.tables import with_totals


def citations(observations: DataFrame, domain: Column) -> DataFrame:
    """Explodes `cited_urls` to one row a citation with its rank; `domain` maps column url. Observations without a list give none.

    A domain that a list names again keeps its best rank only.
    """
    rest = [c for c in observations.columns if c != "cited_urls"]
    rows = observations.select(*rest, F.posexplode("cited_urls").alias("_pos", "url")).withColumn("domain", domain).where("domain IS NOT NULL")
    best = rows.groupBy("observation_id", "domain").agg(F.min(F.struct("_pos", "url", *[c for c in rest if c != "observation_id"])).alias("r"))
    return best.select("observation_id", "domain", (F.col("r._pos") + 1).alias("rank"), F.col("r.url").alias("url"), *[F.col("r")[c].alias(c) for c in rest if c != "observation_id"])


def concentration(rows: DataFrame, group: list[str], item: str, unit: str) -> DataFrame:
    """Per group: events, items, Herfindahl index, effective items, largest share, mean items a unit, and the index weighted by 1 / log2(rank + 1)."""
    counts = rows.groupBy(*group, item).agg(F.count("*").alias("n"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("w"))
    per_item = counts.groupBy(*group).agg(
        F.sum("n").alias("events"), F.count("*").alias("items"), (F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n").cast("double"), F.lit(2))).alias("hhi"),
        (F.max("n") / F.sum("n")).alias("largest_share"), (F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), F.lit(2))).alias("rank_weighted_hhi"),
    )
    units = rows.groupBy(*group, unit).agg(F.countDistinct(item).alias("k")).groupBy(*group).agg(F.avg("k").alias("mean_items_per_unit"), F.count("*").alias("units"))
    joined = per_item.withColumnsRenamed({g: f"_{g}" for g in group}).join(units, [F.col(f"_{g}").eqNullSafe(F.col(g)) for g in group]).drop(*[f"_{g}" for g in group])
    return joined.withColumn("effective_items", 1 / F.col("hhi"))


def leave_one_out_range(rows: DataFrame, group: list[str], item: str, unit: str) -> DataFrame:
    """Per group: least and greatest Herfindahl index when any one unit is left out, by updating sums instead of recounting."""
    cells = rows.groupBy(*group, unit, item).agg(F.count("*").alias("x"))
    by_item = with_totals(cells, [*group, item], n=F.sum("x"))
    marked = with_totals(with_totals(by_item, [*group, unit], own=F.sum("x")), group, total=F.sum("x"))
    squares = marked.groupBy(*group, unit).agg(F.sum(F.col("x") * F.col("x") - 2 * F.col("n") * F.col("x")).alias("delta"), F.max("total").alias("total"), F.max("own").alias("own"))
    totals = rows.groupBy(*group, item).agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum(F.col("n") * F.col("n")).alias("squares")).withColumnsRenamed({c: f"_{c}" for c in group})
    joined = squares.join(totals, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group])
    left = F.col("total") - F.col("own")
    return joined.where(left > 0).groupBy(*group).agg(F.min((F.col("squares") + F.col("delta")) / (left.cast("double") * left)).alias("hhi_min"), F.max((F.col("squares") + F.col("delta")) / (left.cast("double") * left)).alias("hhi_max"), F.count("*").alias("units"))


def shares(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, item, n, share): the share of each item in its group's events."""
    counts = rows.groupBy(*group, item).agg(F.count("*").alias("n"))
    return with_totals(counts, group, _t=F.sum("n")).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def _entropy_part(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def pair_divergence(share_rows: DataFrame, within: list[str], side: str, item: str) -> DataFrame:
    """Jensen-Shannon divergence (bits, 0 to 1) of the item shares of each two sides within a context, with shared items and Jaccard.

    Sums only over items, of the sides' shares, that both have; what one side has alone adds half of its share, so no full
    outer product is built.
    """
    a = share_rows.select(*within, F.col(side).alias("side_a"), F.col(item), F.col("share").alias("p"))
    b = share_rows.select(*within, F.col(side).alias("side_b"), F.col(item), F.col("share").alias("q"))
    # the sides of a context are few, and each pair of them is a row of the result
    sides = share_rows.groupBy(*within, side).agg(F.count("*").alias("k")).groupBy(*within).agg(F.array_sort(F.collect_list(F.struct(F.col(side).alias("s"), "k"))).alias("_s"))
    first = sides.select(*within, "_s", F.posexplode("_s").alias("_i", "x"))
    pairs = first.select(*within, F.col("x.s").alias("side_a"), F.col("x.k").alias("ka"), F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("y")).select(*within, "side_a", "ka", F.col("y.s").alias("side_b"), F.col("y.k").alias("kb"))
    m = (F.col("p") + F.col("q")) / 2
    common = a.join(b, [*within, item]).where("side_a < side_b").groupBy(*within, "side_a", "side_b").agg(
        F.count("*").alias("shared"), F.sum("p").alias("pa"), F.sum("q").alias("qb"), F.sum((_entropy_part(F.col("p"), m) + _entropy_part(F.col("q"), m)) / 2).alias("part")
    )
    out = pairs.join(common, [*within, "side_a", "side_b"], "left").fillna({"shared": 0, "pa": 0.0, "qb": 0.0, "part": 0.0})
    value = F.col("part") + (1 - F.col("pa")) / 2 + (1 - F.col("qb")) / 2
    return out.select(*within, "side_a", "side_b", "shared", (F.col("shared") / (F.col("ka") + F.col("kb") - F.col("shared"))).alias("jaccard"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("divergence"))


def balanced_divergence(rows: DataFrame, side: str, item: str, unit: str) -> DataFrame:
    """Divergence of each two sides: pooled over all events, and per unit that both sides have, averaged."""
    pooled = pair_divergence(shares(rows, [side], item), [], side, item).withColumnsRenamed({"divergence": "pooled_divergence", "jaccard": "pooled_jaccard", "shared": "shared_items"})
    each = pair_divergence(shares(rows, [unit, side], item), [unit], side, item).groupBy("side_a", "side_b").agg(
        F.count("*").alias("units"), F.avg("divergence").alias("mean_divergence"), F.median("divergence").alias("median_divergence"), F.avg("jaccard").alias("mean_jaccard")
    )
    return pooled.join(each, ["side_a", "side_b"], "left")


def portfolio_change(rows: DataFrame, period: str, before: str, after: str, keys: list[str], item: str) -> DataFrame:
    """Per item: mean share before and after over the key groups that both periods have, and the change (gain or loss)."""
    s = shares(rows.where(F.col(period).isin(before, after)), [period, *keys], item)
    groups = s.groupBy(*keys).agg(F.countDistinct(period).alias("_p")).where("_p = 2").drop("_p")
    matched = s.join(groups, keys)
    n = groups.agg(F.count("*").alias("groups"))
    sums = matched.groupBy(item).agg(F.coalesce(F.sum(F.when(F.col(period) == before, F.col("share"))), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(F.col(period) == after, F.col("share"))), F.lit(0.0)).alias("a"))
    out = sums.join(F.broadcast(n)).withColumn("before_share", F.col("b") / F.col("groups")).withColumn("after_share", F.col("a") / F.col("groups"))
    change = F.col("after_share") - F.col("before_share")
    return out.select(item, "groups", "before_share", "after_share", change.alias("share_change"), F.when(change > 0, "gain").when(change < 0, "loss").otherwise("same").alias("direction"))


def group_states(observations: DataFrame, keys: list[str], complete: str = "complete") -> DataFrame:
    """(keys, observations, all_complete): evidence groups and whether every list in them is complete."""
    return observations.groupBy(*keys).agg(F.count("*").alias("observations"), F.min(F.coalesce(complete, F.lit(False))).alias("all_complete"))


def paired_reach(observations: DataFrame, rows: DataFrame, period: str, before: str, after: str, keys: list[str], item: str) -> DataFrame:
    """Per item, over groups that occur in both periods: in how many it was gained, lost, kept, with McNemar and Holm-adjusted p.

    Present in any list of a group is present; absent is known only if all of the group's lists are complete, else the
    group is left out for that item (unknown). Items without a known comparable group are left out.
    """
    states = group_states(observations.where(F.col(period).isin(before, after)), [*keys, period])
    side = lambda p, n: states.where(F.col(period) == p).select(*keys, F.col("all_complete").alias(f"{n}_complete"))
    matched = side(before, "b").join(side(after, "a"), keys)
    totals = matched.agg(F.count_if(F.col("b_complete") & F.col("a_complete")).alias("closed"))
    seen = rows.where(F.col(period).isin(before, after)).groupBy(*keys, item).agg(F.max(F.col(period) == before).alias("in_b"), F.max(F.col(period) == after).alias("in_a"))
    cells = seen.join(matched, keys)
    known = (F.col("in_b") | F.col("b_complete")) & (F.col("in_a") | F.col("a_complete"))
    agg = cells.groupBy(item).agg(
        F.count_if(known & F.col("in_a") & ~F.col("in_b")).alias("gained"), F.count_if(known & F.col("in_b") & ~F.col("in_a")).alias("lost"), F.count_if(F.col("in_b") & F.col("in_a")).alias("kept"),
        F.count_if(~known).alias("unknown"), F.count_if(F.col("b_complete") & F.col("a_complete")).alias("_seen_closed"), F.count_if(known & ~(F.col("b_complete") & F.col("a_complete"))).alias("_known_open"),
    )
    out = agg.join(F.broadcast(totals)).withColumn("groups", F.col("closed") + F.col("_known_open")).where("gained + lost + kept > 0")
    out = out.withColumn("reach_change", (F.col("gained") - F.col("lost")) / F.col("groups")).withColumn("p", stats.mcnemar_p(F.col("gained"), F.col("lost")))
    return out.select(item, "groups", "gained", "lost", "kept", "unknown", "reach_change", "p")


def holm_adjust(df: DataFrame, p: str, tie: str, family: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Adds `holm_p`: Holm's step-down adjustment of `p` within each family, ties ordered by `tie`; rows with a null p are left out.

    Ranks are counted in ranges of p: each row's rank is its rank in its range plus the rows of lower ranges, and the running
    maximum is carried over ranges the same way, so a family is not sorted by one task.
    """
    family = family or []
    # a p of 1 is 1 after adjustment and counts only in the size of its family
    sized = with_totals(df, family, _m=F.count("*"))
    open_rows = sized.where(F.col(p) < 1).withColumn("_range", F.least(F.floor(F.col(p) * buckets), F.lit(buckets - 1)))
    inner = Window.partitionBy(*family, "_range").orderBy(p, tie)
    order = Window.partitionBy(*family).orderBy("_range")
    starts = open_rows.groupBy(*family, "_range").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    ranked = open_rows.join(starts, [*family, "_range"]).withColumn("_step", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - (F.col("_before") + F.row_number().over(inner)) + 1)))
    tops = ranked.groupBy(*family, "_range").agg(F.max("_step").alias("_top"))
    carried = tops.withColumn("_carry", F.coalesce(F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_top")
    out = ranked.withColumn("_run", F.max("_step").over(inner.rowsBetween(Window.unboundedPreceding, 0))).join(carried, [*family, "_range"])
    adjusted = out.withColumn("holm_p", F.greatest("_run", "_carry")).select(*df.columns, "holm_p")
    return adjusted.unionByName(sized.where(F.col(p) >= 1).withColumn("holm_p", F.lit(1.0)).select(*df.columns, "holm_p"))


def first_owned(rows: DataFrame, owned: Column, group: list[str]) -> DataFrame:
    """Per group: observations, those citing an owned domain, mean reciprocal rank of the first one, and its rank buckets."""
    first = rows.withColumn("_o", owned).groupBy(*group, "observation_id").agg(F.min(F.when(F.col("_o"), F.col("rank"))).alias("r"))
    bucket = [F.count_if(c).alias(n) for n, c in (("rank_1", F.col("r") == 1), ("rank_2", F.col("r") == 2), ("rank_3", F.col("r") == 3), ("rank_4_5", F.col("r").between(4, 5)), ("rank_6_10", F.col("r").between(6, 10)), ("rank_11_up", F.col("r") >= 11))]
    return first.groupBy(*group).agg(F.count("*").alias("observations"), F.count("r").alias("owned"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), *bucket)


def retention(observations: DataFrame, rows: DataFrame, keys: list[str], time: str, item: str) -> DataFrame:
    """Per item: of the captures citing it, how many were followed by a capture (next distinct time of the same keys) that cites it, or surely doesn't.

    Captures at one time count as one; the next capture's absence is known only if all of its lists are complete.
    """
    captures = group_states(observations.where(F.col(time).isNotNull()), [*keys, time])
    following = captures.withColumn("next_time", F.lead(time).over(Window.partitionBy(*keys).orderBy(time))).withColumn("next_complete", F.lead("all_complete").over(Window.partitionBy(*keys).orderBy(time)))
    cited = rows.where(F.col(time).isNotNull()).select(*keys, time, item).distinct()
    later = cited.select(*keys, F.col(time).alias("next_time"), item, F.lit(True).alias("again"))
    steps = cited.join(following.where("next_time IS NOT NULL"), [*keys, time]).join(later, [*keys, "next_time", item], "left")
    kept = F.coalesce("again", F.when(F.col("next_complete"), F.lit(False)))
    return steps.groupBy(item).agg(F.count("*").alias("followed"), F.count_if(kept).alias("retained"), F.count_if(~kept).alias("dropped"), F.count_if(kept.isNull()).alias("unknown"))


def repeatability(observations: DataFrame, keys: list[str], time: str, items: str, persistence: float = 0.9, depth: int = 3) -> DataFrame:
    """Adjacent captures of the same keys: Jaccard of the item sets, of the first `depth`, and rank-biased overlap.

    `items` is an array in rank order. Only captures alone at their time take part, and both lists must not be empty.
    """
    alone = observations.where(F.col(time).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, time))).withColumn("_i", F.array_distinct(items))
    line = Window.partitionBy(*keys).orderBy(time)
    # an ambiguous time breaks the chain: its rows stay in order but pair with none
    steps = alone.withColumn("_p", F.lag(F.struct("_i", "_n", F.col(time).alias("t"))).over(line)).where((F.col("_n") == 1) & (F.col("_p._n") == 1)).where((F.size("_i") > 0) & (F.size("_p._i") > 0))
    a, b = F.col("_p._i"), F.col("_i")
    jaccard = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    k = F.greatest(F.size(a), F.size(b))
    agree = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda s, d: s + F.pow(F.lit(persistence), d - 1) * F.size(F.array_intersect(F.slice(a, F.lit(1), d), F.slice(b, F.lit(1), d))) / d)
    norm = (1 - F.pow(F.lit(persistence), k)) / (1 - persistence)
    return steps.select(*keys, F.col("_p.t").alias("previous"), time, jaccard(a, b).alias("jaccard"), jaccard(F.slice(a, 1, depth), F.slice(b, 1, depth)).alias("top_jaccard"), (agree / norm).alias("rank_overlap"))


def rarefaction(rows: DataFrame, group: list[str], unit: str, item: str, sizes: list[int]) -> DataFrame:
    """Expected distinct items in a random sample of k of a group's units, for each k up to their number (hypergeometric)."""
    per_item = rows.select(*group, unit, item).distinct().groupBy(*group, item).agg(F.count("*").alias("n_d"))
    units = rows.select(*group, unit).distinct().groupBy(*group).agg(F.count("*").alias("n"))
    # items seen in as many units behave alike: one row for each count
    counts = per_item.groupBy(*group, "n_d").agg(F.count("*").alias("items"))
    sampled = counts.join(units, group).withColumn("k", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("k <= n")
    found = 1 - stats.absent_share(F.col("n"), F.col("n") - F.col("n_d"), F.col("k"))
    return sampled.groupBy(*group, "k").agg(F.max("n").alias("units"), F.sum("items").alias("items"), F.sum(F.col("items") * found).alias("expected_items"))


def opportunities(observations: DataFrame, rows: DataFrame, keys: list[str], owned: Column, page: str) -> DataFrame:
    """Third-party pages cited in groups where no owned domain was cited and every list is complete: page, groups, observations."""
    states = group_states(observations, keys)
    has_owned = rows.groupBy(*keys).agg(F.max(F.coalesce(owned, F.lit(False))).alias("has_owned"))
    gaps = states.where("all_complete").join(has_owned, keys).where("NOT has_owned").select(*keys)
    return rows.join(gaps, keys, "left_semi").where(F.col(page).isNotNull()).groupBy(page).agg(F.countDistinct(*keys).alias("gap_groups"), F.countDistinct("observation_id").alias("observations"))


def matched_association(observations: DataFrame, exposure: str, outcomes: list[str], strata: list[str]) -> DataFrame:
    """Mean outcomes with and without an exposure within strata that have both: strata, mean difference, sign test over strata."""
    arms = observations.where(F.col(exposure).isNotNull()).groupBy(*strata).agg(
        F.count_if(F.col(exposure)).alias("n1"), F.count_if(~F.col(exposure)).alias("n0"),
        *[F.avg(F.when(F.col(exposure), F.col(o).cast("double"))).alias(f"{o}_1") for o in outcomes], *[F.avg(F.when(~F.col(exposure), F.col(o).cast("double"))).alias(f"{o}_0") for o in outcomes],
    ).where("n1 > 0 AND n0 > 0")
    rows = arms.select(F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(f"{o}_1").alias("with_mean"), F.col(f"{o}_0").alias("without_mean")) for o in outcomes])).alias("r")).select("r.*")
    d = F.col("with_mean") - F.col("without_mean")
    out = rows.groupBy("outcome").agg(F.count("*").alias("strata"), F.avg("with_mean").alias("with_mean"), F.avg("without_mean").alias("without_mean"), F.avg(d).alias("mean_difference"), F.count_if(d > 0).alias("higher"), F.count_if(d < 0).alias("lower"))
    return out.withColumn("p", stats.sign_test_p(F.col("higher"), F.col("lower")))


def sampled_change(df: DataFrame, group: list[str], month: str, value: str) -> DataFrame:
    """Adds previous_month, change and skipped_months against the group's previous month that has data."""
    w = Window.partitionBy(*group).orderBy(month)
    out = df.withColumn("previous_month", F.lag(month).over(w)).withColumn("change", F.col(value) - F.lag(value).over(w))
    return out.withColumn("skipped_months", (F.months_between(F.col(month), F.col("previous_month")) - 1).cast("int"))


def suffix_category(rows: DataFrame, host: str, categories: DataFrame) -> DataFrame:
    """Adds category of the longest listed suffix (whole labels) of a host; null without one. `categories` (suffix, category) is a reference list."""
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host).where(F.col(host).isNotNull()).distinct()
    found = hosts.select(host, F.explode(suffixes).alias("suffix")).join(F.broadcast(categories), "suffix").groupBy(host).agg(F.max_by("category", F.length("suffix")).alias("category"))
    return rows.join(found, host, "left")


def mix_decomposition(df: DataFrame, period: str, before: str, after: str, stratum: str, value: str) -> DataFrame:
    """Change of a mean between periods, split into the effect of rates within strata and that of the mix of strata (Kitagawa)."""
    cells = df.where(F.col(period).isin(before, after) & F.col(value).isNotNull()).groupBy(stratum, period).agg(F.avg(F.col(value).cast("double")).alias("r"), F.count("*").alias("n"))
    weighed = cells.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy(period)))
    pick = lambda p, c: F.max(F.when(F.col(period) == p, F.col(c)))
    wide = weighed.groupBy(stratum).agg(pick(before, "r").alias("r0"), pick(after, "r").alias("r1"), F.coalesce(pick(before, "w"), F.lit(0.0)).alias("w0"), F.coalesce(pick(after, "w"), F.lit(0.0)).alias("w1"))
    r0, r1 = F.coalesce("r0", "r1"), F.coalesce("r1", "r0")
    return wide.agg(F.sum(F.col("w0") * r0).alias("before"), F.sum(F.col("w1") * r1).alias("after"), F.sum((r1 - r0) * (F.col("w0") + F.col("w1")) / 2).alias("rate_effect"), F.sum((F.col("w1") - F.col("w0")) * (r0 + r1) / 2).alias("mix_effect"))


def comparability(df: DataFrame, period: str, before: str, after: str, context: str) -> DataFrame:
    """How alike two periods' contexts are: total variation distance, Jaccard, effective sample sizes, coefficient of variation of counts."""
    counts = df.where(F.col(period).isin(before, after)).groupBy(context).agg(F.count_if(F.col(period) == before).alias("b"), F.count_if(F.col(period) == after).alias("a"))
    with_totals = counts.join(F.broadcast(counts.agg(F.sum("b").alias("tb"), F.sum("a").alias("ta"))))
    return with_totals.agg(
        (F.sum(F.abs(F.col("b") / F.col("tb") - F.col("a") / F.col("ta"))) / 2).alias("tv_distance"), (F.count_if((F.col("b") > 0) & (F.col("a") > 0)) / F.count("*")).alias("jaccard"),
        (F.pow(F.sum("b").cast("double"), F.lit(2)) / F.sum(F.col("b") * F.col("b"))).alias("before_effective"), (F.pow(F.sum("a").cast("double"), F.lit(2)) / F.sum(F.col("a") * F.col("a"))).alias("after_effective"),
        (F.stddev_pop(F.when(F.col("b") > 0, F.col("b"))) / F.avg(F.when(F.col("b") > 0, F.col("b")))).alias("before_cv"),
    )


def change_gate(df: DataFrame, violation: Column, ready: Column) -> DataFrame:
    """(compared, violations, complete, passed): fails closed, so without a comparable row the gate is incomplete and not passed."""
    return df.agg(F.count_if(ready).alias("compared"), F.count_if(ready & violation).alias("violations")).withColumn("complete", F.col("compared") > 0).withColumn("passed", F.col("complete") & (F.col("violations") == 0))
