"""Joins and comparisons of keyed tables: periods, matrices, ambiguous keys, multisets, competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def full_outer(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Rows of both tables side by side on null-safe keys; other columns get the suffix of their side, so clashing names don't matter."""
    a = left.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in left.columns if c not in keys], F.lit(True).alias("_in_a"))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(c + suffixes[1]) for c in right.columns if c not in keys], F.lit(True).alias("_in_b"))
    joined = a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "full")
    out = joined.withColumns({k: F.when(F.col("_in_a"), F.col(k)).otherwise(F.col(f"_{k}")) for k in keys})
    side = F.when(F.col("_in_a") & F.col("_in_b"), "both").when(F.col("_in_a"), "left-only").otherwise("right-only")
    return out.withColumn("presence", side).drop("_in_a", "_in_b", *[f"_{k}" for k in keys])


def with_totals(df: DataFrame, group: list[str], **totals: Column) -> DataFrame:
    """Adds group totals by an aggregation and a null-safe join, so that no group is gathered in one task as by a window."""
    if not group:
        return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in totals.items()])))
    sums = df.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()]).withColumnsRenamed({g: f"_t_{g}" for g in group})
    return df.join(sums, [F.col(g).eqNullSafe(F.col(f"_t_{g}")) for g in group]).drop(*[f"_t_{g}" for g in group])


def compare_metric(baseline: DataFrame, current: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """Sums of a metric in two periods by key: a key of one period only is current-only or baseline-only, never zero; sums without any value are null."""
    b, c = (d.groupBy(*keys).agg(F.sum(metric).alias("v")) for d in (baseline, current))
    out = full_outer(b, c, keys, ("_b", "_c")).withColumnsRenamed({"v_b": "baseline", "v_c": "current"})
    state = F.when(F.col("presence") == "right-only", "current-only").when(F.col("presence") == "left-only", "baseline-only").when(F.col("current") > F.col("baseline"), "increased").when(F.col("current") < F.col("baseline"), "decreased").when(F.col("current") == F.col("baseline"), "unchanged").otherwise("not-comparable")
    return out.withColumn("delta", F.col("current") - F.col("baseline")).withColumn("state", state).drop("presence")


def unique_match(rows: DataFrame, reference: DataFrame, key: str, fallback: str | None = None) -> DataFrame:
    """Adds the reference columns of the one row with the same key, else of the one whose `fallback` equals the key.

    `match` is exact, fallback, ambiguous (several rows qualify, none is taken) or none. Null keys match nothing. The
    reference's columns are prefixed with ref_.
    """
    named = reference.withColumnsRenamed({c: f"ref_{c}" for c in reference.columns})
    payload = F.struct(*named.columns)

    def side(column: str, tag: str) -> DataFrame:
        return named.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(F.count("*").alias(f"_{tag}_n"), F.min(payload).alias(f"_{tag}"))

    out = rows.join(side(f"ref_{key}", "x"), key, "left")
    if fallback:
        out = out.join(side(f"ref_{fallback}", "y"), key, "left")
    else:
        out = out.withColumn("_y_n", F.lit(None).cast("bigint")).withColumn("_y", F.lit(None).cast(out.schema["_x"].dataType))
    state = F.when(F.col("_x_n") == 1, "exact").when(F.col("_x_n") > 1, "ambiguous").when(F.col("_y_n") == 1, "fallback").when(F.col("_y_n") > 1, "ambiguous").otherwise("none")
    out = out.withColumn("match", state).withColumn("_r", F.when(F.col("match") == "exact", F.col("_x")).when(F.col("match") == "fallback", F.col("_y")))
    return out.select("*", "_r.*").drop("_x", "_y", "_r", "_x_n", "_y_n")


def multiset_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `left` beyond their number in `right`, by keys: counts are compared, so repeats need no numbering and no sort."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("n")), right.groupBy(*keys).agg(F.count("*").alias("m"))
    joined = full_outer(a, b, keys, ("", ""))
    extra = F.col("n") - F.coalesce("m", F.lit(0))
    return joined.where(extra > 0).select(*keys, extra.alias("surplus"))


def against_competitors(own: DataFrame, others: DataFrame, key: str, competitor: str) -> DataFrame:
    """Keys that competitors have and `own` lacks, with how many competitors have them."""
    return others.where(F.col(key).isNotNull()).join(own.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.countDistinct(competitor).alias("competitors"))


def herfindahl(rows: DataFrame, group: list[str], item: str, metric: str) -> DataFrame:
    """Per group: items, metric total, Herfindahl index, effective items and largest share of a metric; groups without a positive total have none."""
    sums = rows.where(F.col(metric).isNotNull()).groupBy(*group, item).agg(F.sum(metric).alias("v"))
    out = sums.groupBy(*group).agg(F.count("*").alias("items"), F.sum("v").alias("total"), F.sum(F.col("v").cast("double") * F.col("v")).alias("squares"), F.max("v").alias("top"))
    hhi = F.col("squares") / (F.col("total").cast("double") * F.col("total"))
    return out.where("total > 0").select(*group, "items", "total", hhi.alias("hhi"), (1 / hhi).alias("effective_items"), (F.col("top") / F.col("total")).alias("largest_share"))


def ends(rows: DataFrame, group: list[str], order: str, metric: str) -> DataFrame:
    """First and last value of a metric by `order` in each group, and the change between them."""
    known = rows.where(F.col(order).isNotNull() & F.col(metric).isNotNull()).groupBy(*group, order).agg(F.sum(metric).alias("v"))
    out = known.groupBy(*group).agg(F.count("*").alias("points"), F.min_by("v", order).alias("first_value"), F.max_by("v", order).alias("last_value"))
    return out.withColumn("change", F.col("last_value") - F.col("first_value"))


def downsample(rows: DataFrame, group: list[str], order: str, metric: str, buckets: int) -> DataFrame:
    """At most two rows a bucket of a series: its least and its greatest value, first of equals; buckets are equal spans of `order`."""
    x = F.col(order).cast("double")
    known = with_totals(rows.where(F.col(order).isNotNull() & F.col(metric).isNotNull()), group, _lo=F.min(x), _hi=F.max(x))
    bucket = F.least(F.floor((x - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    b = known.withColumn("bucket", F.coalesce(bucket, F.lit(0)))
    points = b.groupBy(*group, "bucket").agg(F.min(F.struct(metric, order)).alias("low"), F.max(F.struct(F.col(metric), (-F.col(order).cast("double")).alias("o"), F.col(order).alias("at"))).alias("high"))
    rows_out = points.select(*group, "bucket", F.explode(F.array_distinct(F.array(F.struct(F.col(f"low.{order}").alias(order), F.col(f"low.{metric}").alias(metric)), F.struct(F.col("high.at").alias(order), F.col(f"high.{metric}").alias(metric))))).alias("p"))
    return rows_out.select(*group, "bucket", f"p.{order}", f"p.{metric}")


def duplicates(rows: DataFrame, key: Column, item: str) -> DataFrame:
    """Keys that several rows share: key, rows, first item. Null and empty keys are no duplicates."""
    return rows.withColumn("key", key).where(F.col("key").isNotNull() & (F.col("key") != "")).groupBy("key").agg(F.count("*").alias("rows"), F.min(item).alias(f"first_{item}")).where("rows > 1")
