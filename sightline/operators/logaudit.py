"""Access logs between periods and against audited pages: path changes, timing, referrals, cache results, page and family matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.functions import logs
from sightline.functions.normalize import path_family, path_of, query_parameter
from sightline.operators.requests import compare_periods, latency_profile
from sightline.operators.tables import full_outer, with_totals

#: Requests with a time that a period needs for its bands to be compared.
LEAST_TIMED = 20


def _per_mille(part: Column, whole: Column) -> Column:
    """A share in tenths of a percent, rounded half up, in whole numbers."""
    return F.floor((2000 * part + whole) / (2 * whole)).cast("bigint")


def path_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(token, path, requests and failures of both periods, change): how each crawler's path changed, the first that holds.

    current-only, baseline-only, failure-emerged, failure-cleared, response-class-shift (shares to a tenth of a percent),
    status-code-set-shift, media-type-set-shift, request-share-shift (of the crawler's requests); null without a change.
    """
    kind = logs.status_class(F.col("status"))

    def side(rows: DataFrame) -> DataFrame:
        keys = ["token", "path"]
        rows = rows.where("token IS NOT NULL AND path IS NOT NULL").withColumn("path", path_of(F.col("path")))
        classes = [F.count_if(kind == k) for k in ("2xx", "3xx", "4xx", "5xx", "other")]
        per = rows.groupBy(*keys).agg(
            F.count("*").alias("requests"), F.count_if(kind.isin("4xx", "5xx")).alias("failures"), F.array(*classes).alias("_k"),
            F.array_sort(F.collect_set("status")).alias("codes"), F.array_sort(F.collect_set(logs.media_type(F.col("content_type")))).alias("media"),
        )
        shares = F.transform("_k", lambda n: _per_mille(n, F.col("requests")))
        return with_totals(per, ["token"], _all=F.sum("requests")).select(*keys, "requests", "failures", shares.alias("shares"), "codes", "media", _per_mille(F.col("requests"), F.col("_all")).alias("share"))

    both = full_outer(side(baseline), side(current), ["token", "path"], ("_b", "_c"))
    change = (
        F.when(F.col("presence") == "right-only", "current-only").when(F.col("presence") == "left-only", "baseline-only")
        .when((F.col("failures_b") == 0) & (F.col("failures_c") > 0), "failure-emerged").when((F.col("failures_b") > 0) & (F.col("failures_c") == 0), "failure-cleared")
        .when(F.col("shares_b") != F.col("shares_c"), "response-class-shift").when(F.col("codes_b") != F.col("codes_c"), "status-code-set-shift")
        .when(F.col("media_b") != F.col("media_c"), "media-type-set-shift").when(F.col("share_b") != F.col("share_c"), "request-share-shift")
    )
    return both.select("token", "path", "requests_b", "failures_b", "requests_c", "failures_c", change.alias("change"))


def timing_changes(baseline: DataFrame, current: DataFrame, millis: str = "duration_ms", least: int = LEAST_TIMED) -> DataFrame:
    """(token, samples and 95th percentile bands of both periods, change): slower, faster, same, or not-comparable below `least` samples on a side."""
    side = lambda d: latency_profile(d, millis).select("token", "sampled", "p95_band").distinct()
    both = full_outer(side(baseline), side(current), ["token"], ("_b", "_c"))
    place = lambda c: F.array_position(F.array(*[F.lit(n) for n, _ in logs.LATENCY_BANDS]), F.col(c))
    ready = F.coalesce((F.col("sampled_b") >= least) & (F.col("sampled_c") >= least), F.lit(False))
    change = F.when(~ready, "not-comparable").when(place("p95_band_c") > place("p95_band_b"), "slower").when(place("p95_band_c") < place("p95_band_b"), "faster").otherwise("same")
    return both.select("token", "sampled_b", "p95_band_b", "sampled_c", "p95_band_c", change.alias("change"))


def referrals(rows: DataFrame, parameter: str = "utm_source") -> DataFrame:
    """Requests that carry the parameter, with its `state` (single, conflicting, empty) and `source`, the value if it is single."""
    found = query_parameter(F.col("path"), parameter)
    return rows.withColumn("_q", found).where("_q.state <> 'none'").withColumn("state", F.col("_q.state")).withColumn("source", F.col("_q.value")).drop("_q")


def referral_profile(rows: DataFrame) -> DataFrame:
    """Per state and source of referrals(): requests by status class, distinct paths and days."""
    kind = logs.status_class(F.col("status"))
    counts = [F.count_if(kind == k).alias(n) for k, n in (("2xx", "successful"), ("3xx", "redirects"), ("4xx", "client_errors"), ("5xx", "server_errors"), ("other", "other_responses"))]
    return rows.groupBy("state", "source").agg(F.count("*").alias("requests"), *counts, F.countDistinct(path_of(F.col("path"))).alias("paths"), F.countDistinct(F.to_date("received_at")).alias("days"))


def referral_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """compare_periods of single referral sources."""
    single = lambda d: d.where("state = 'single'")
    return compare_periods(single(baseline), single(current), ["source"])


def cache_profile(rows: DataFrame, group: list[str], result: str, second: str | None = None) -> DataFrame:
    """(group, result, requests, share, differing): requests by normal cache result, their share, and of how many the `second` result column says otherwise."""
    named = rows.withColumn("_r", logs.cache_result(F.col(result))).where("_r IS NOT NULL")
    other = logs.cache_result(F.col(second)) if second else F.lit(None).cast("string")
    counts = named.groupBy(*group, F.col("_r").alias("result")).agg(F.count("*").alias("requests"), F.count_if(other != F.col("_r")).alias("differing"))
    return with_totals(counts, group, _all=F.sum("requests")).withColumn("share", F.col("requests") / F.col("_all")).drop("_all")


def cache_changes(baseline: DataFrame, current: DataFrame, group: list[str]) -> DataFrame:
    """cache_profile of two periods side by side with the change of the share; a result of one period only has share 0 in the other if the group has requests there."""
    both = full_outer(baseline, current, [*group, "result"], ("_b", "_c"))
    known = full_outer(baseline.select(*group).distinct(), current.select(*group).distinct(), group).withColumnRenamed("presence", "_g")
    joined = both.join(known.withColumnsRenamed({g: f"_{g}" for g in group}), [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]).drop(*[f"_{g}" for g in group])
    return joined.withColumn("share_change", F.when(F.col("_g") == "both", F.coalesce("share_c", F.lit(0.0)) - F.coalesce("share_b", F.lit(0.0)))).drop("_g", "presence")


def match_pages(rows: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """(path, requests, failures, successful, crawlers, state, url): requested paths against audited pages by path.

    matched: one page has the path and no audited address of that path carries a query; ambiguous: several pages have it, or one with a query;
    not-audited: none has it. A request's own query is dropped.
    """
    kind = logs.status_class(F.col("status"))
    asked = rows.where("path IS NOT NULL").groupBy(path_of(F.col("path")).alias("path")).agg(F.count("*").alias("requests"), F.count_if(kind.isin("4xx", "5xx")).alias("failures"), F.count_if(kind == "2xx").alias("successful"), F.countDistinct("token").alias("crawlers"))
    known = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().groupBy(path_of(F.col("url")).alias("path")).agg(F.count("*").alias("_n"), F.min("url").alias("url"), F.max(F.contains("url", F.lit("?"))).alias("_q"))
    state = F.when(F.col("_n").isNull(), "not-audited").when((F.col("_n") > 1) | F.col("_q"), "ambiguous").otherwise("matched")
    return asked.join(known, "path", "left").select("path", "requests", "failures", "successful", "crawlers", state.alias("state"), F.when(state == "matched", F.col("url")).alias("url"))


def match_families(rows: DataFrame, pages: DataFrame, url: str = "url", depth: int = 1) -> DataFrame:
    """(family, requests, failures, crawlers, pages, presence): path families of requests against those of audited pages."""
    kind = logs.status_class(F.col("status"))
    asked = rows.where("path IS NOT NULL").groupBy(path_family(F.col("path"), depth).alias("family")).agg(F.count("*").alias("requests"), F.count_if(kind.isin("4xx", "5xx")).alias("failures"), F.countDistinct("token").alias("crawlers"))
    known = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().groupBy(path_family(F.col("url"), depth).alias("family")).agg(F.count("*").alias("pages"))
    return full_outer(asked, known, ["family"], ("", ""))
