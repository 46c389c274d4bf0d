"""Access-log analytics over request rows: profiles, hotspots, disparities, period comparison, robots replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions import logs
from sightline.functions.normalize import path_family, path_of
from sightline.operators.loglines import valid_address

#: Crawler catalogs are reference lists; a larger one is refused.
MAX_CATALOG = 10_000


def latest_requests(rows: DataFrame, key: str = "request_id", order: str = "received_at") -> DataFrame:
    """Each key once, the delivery received last (of equals the greatest row); rows with a null key are left out."""
    rest = [c for c in rows.columns if c not in (key, order)]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r"))
    return kept.select(key, *[F.col("r")[c].alias(c) for c in rest], F.col("r")[order].alias(order))


def catalog_tokens(catalog: DataFrame) -> list[str]:
    """The catalog's tokens, a bounded reference list."""
    rows = catalog.where("token IS NOT NULL").select("token").distinct().limit(MAX_CATALOG + 1).collect()
    if len(rows) > MAX_CATALOG:
        raise ValueError(f"more than {MAX_CATALOG} crawler tokens")
    return [r.token for r in rows]


def classify(rows: DataFrame, catalog: DataFrame, agent: str = "user_agent") -> DataFrame:
    """Adds token, provider, activity of the longest catalog token in the agent as a whole word; null without one."""
    found = logs.crawler_token(F.col(agent), catalog_tokens(catalog))
    entries = catalog.where("token IS NOT NULL").groupBy(F.lower("token").alias("_t")).agg(F.min("token").alias("token"), F.min("provider").alias("provider"), F.min("activity").alias("activity"))
    return rows.withColumn("_t", found).join(F.broadcast(entries), "_t", "left").drop("_t")


def crawler_profile(rows: DataFrame) -> DataFrame:
    """One row a crawler: requests by status class, distinct paths and hosts, first and last day; unclassified rows are left out."""
    kind = logs.status_class(F.col("status"))
    counts = [F.count_if(kind == k).alias(n) for k, n in (("2xx", "successful"), ("3xx", "redirects"), ("4xx", "client_errors"), ("5xx", "server_errors"), ("other", "other_responses"))]
    day = F.to_date("received_at")
    return rows.where("token IS NOT NULL").groupBy("token", "provider", "activity").agg(
        F.count("*").alias("requests"), *counts, F.countDistinct(path_of(F.col("path"))).alias("paths"), F.countDistinct("site_host").alias("sites"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


def daily_activity(rows: DataFrame) -> DataFrame:
    """Requests and failures by crawler and day, with days before the crawler's last day."""
    kind = logs.status_class(F.col("status"))
    days = rows.where("token IS NOT NULL AND received_at IS NOT NULL").groupBy("token", F.to_date("received_at").alias("day")).agg(F.count("*").alias("requests"), F.count_if(kind.isin("4xx", "5xx")).alias("failures"))
    return days.withColumn("days_before_last", F.datediff(F.max("day").over(Window.partitionBy("token")), F.col("day")))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first `cap` rows of each group, with its number of rows and whether some were cut."""
    # the filter stands directly on the rank, so that each partition keeps only its first rows before the shuffle
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= cap)
    sizes = df.groupBy(*group).agg(F.count("*").alias("group_rows")).withColumnsRenamed({g: f"_{g}" for g in group})
    joined = first.join(sizes, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group]).drop(*[f"_{g}" for g in group])
    return joined.withColumn("truncated", F.col("group_rows") > cap)


def path_counts(rows: DataFrame) -> DataFrame:
    """Requests by crawler and path with failures."""
    kind = logs.status_class(F.col("status"))
    return rows.where("token IS NOT NULL AND path IS NOT NULL").groupBy("token", path_of(F.col("path")).alias("path")).agg(
        F.count("*").alias("requests"), F.count_if(kind == "2xx").alias("successful"), F.count_if(kind.isin("4xx", "5xx")).alias("failures")
    )


def failure_hotspots(rows: DataFrame, cap: int = 50) -> DataFrame:
    """The paths of each crawler with most failures, their share, first `cap`."""
    failing = path_counts(rows).where("failures > 0").withColumn("failure_share", F.col("failures") / F.col("requests"))
    return top_per_group(failing, ["token"], [F.desc("failures"), F.asc("path")], cap)


def latency_profile(rows: DataFrame, millis: str = "duration_ms") -> DataFrame:
    """Requests by crawler and latency band, with the bands that hold the median and the 95th percentile."""
    bands = rows.where("token IS NOT NULL").select("token", logs.latency_band(F.col(millis)).alias("band")).where("band IS NOT NULL").groupBy("token", "band").agg(F.count("*").alias("requests"))
    upto = Window.partitionBy("token").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("token")
    summed = bands.withColumn("cumulative", F.sum("requests").over(upto)).withColumn("sampled", F.sum("requests").over(whole))
    at = lambda q: F.min(F.when(F.col("cumulative") >= F.greatest(F.lit(1), F.ceil(F.col("sampled") * q)), F.col("band"))).over(whole)
    return summed.select("token", logs.band_name(F.col("band")).alias("band"), "requests", "sampled", logs.band_name(at(0.5)).alias("p50_band"), logs.band_name(at(0.95)).alias("p95_band"))


def path_disparities(rows: DataFrame) -> DataFrame:
    """Paths that at least two crawlers of one activity asked for, and whether their status classes, codes or media types differ."""
    kind = logs.status_class(F.col("status"))
    per = rows.where("token IS NOT NULL AND path IS NOT NULL").groupBy("activity", path_of(F.col("path")).alias("path"), "token").agg(
        F.array_sort(F.collect_set(kind)).alias("classes"), F.array_sort(F.collect_set("status")).alias("codes"), F.array_sort(F.collect_set(logs.media_type(F.col("content_type")))).alias("media"), F.count("*").alias("n")
    )
    return per.groupBy("activity", "path").agg(
        F.count("*").alias("crawlers"), F.sum("n").alias("requests"), (F.countDistinct("classes") > 1).alias("classes_differ"), (F.countDistinct("codes") > 1).alias("codes_differ"),
        (F.countDistinct("media") > 1).alias("media_differ"),
        (F.max(F.array_contains("classes", "2xx") & ~F.exists("classes", lambda c: c.isin("4xx", "5xx"))) & F.max(F.exists("classes", lambda c: c.isin("4xx", "5xx")) & ~F.array_contains("classes", "2xx"))).alias("success_failure_split"),
    ).where("crawlers > 1")


def compare_periods(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Requests and failure rates of two periods side by side: a key of one period only is new or gone, never zero."""
    kind = logs.status_class(F.col("status"))
    sums = lambda d, p: d.groupBy(*keys).agg(F.count("*").alias(f"{p}_requests"), F.count_if(kind.isin("4xx", "5xx")).alias(f"{p}_failures"))
    b, c = sums(baseline, "baseline"), sums(current, "current").withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    both = b.join(c, on, "full").select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], "baseline_requests", "baseline_failures", "current_requests", "current_failures")
    rate = lambda p: F.col(f"{p}_failures") / F.col(f"{p}_requests")
    state = F.when(F.col("baseline_requests").isNull(), "current-only").when(F.col("current_requests").isNull(), "baseline-only").when(F.col("current_requests") > F.col("baseline_requests"), "increased").when(F.col("current_requests") < F.col("baseline_requests"), "decreased").otherwise("unchanged")
    return both.withColumn("request_delta", F.col("current_requests") - F.col("baseline_requests")).withColumn("failure_rate_delta", rate("current") - rate("baseline")).withColumn("state", state)


def family_profile(rows: DataFrame, depth: int = 1) -> DataFrame:
    """Requests, crawlers and failures by path family."""
    kind = logs.status_class(F.col("status"))
    return rows.where("path IS NOT NULL").groupBy(path_family(F.col("path"), depth).alias("family")).agg(
        F.count("*").alias("requests"), F.countDistinct("token").alias("crawlers"), F.count_if(kind.isin("4xx", "5xx")).alias("failures")
    )


def family_failure_gate(comparison: DataFrame, rise: float = 0.05, least: int = 20) -> DataFrame:
    """(families_compared, violations, complete, passed): families with `least` requests on both sides whose failure rate rose by more than `rise`.

    The gate fails closed: without a comparable family it is incomplete and not passed.
    """
    ready = (F.col("baseline_requests") >= least) & (F.col("current_requests") >= least)
    return comparison.agg(F.count_if(ready).alias("families_compared"), F.count_if(ready & (F.col("failure_rate_delta") > rise)).alias("violations")).withColumn("complete", F.col("families_compared") > 0).withColumn("passed", F.col("complete") & (F.col("violations") == 0))


def ipv4_number(address: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(address, r"\.")
    valid = address.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    return F.when(valid, sum((parts[k].try_cast("bigint") * 256 ** (3 - k) for k in range(1, 4)), parts[0].try_cast("bigint") * 256**3))


def in_ranges(rows: DataFrame, ranges: DataFrame, address: str = "client_ip", out: str = "in_range") -> DataFrame:
    """Adds whether an IPv4 address lies in one of the ranges (lo, hi as numbers); null for other addresses. See in_networks for both kinds.

    Addresses and ranges meet in /16 blocks by an equi-join: a range is listed once for each block it touches, so ranges may overlap.
    """
    blocks = ranges.where("lo <= hi").select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode(F.sequence(F.floor(F.col("lo") / 65536), F.floor(F.col("hi") / 65536))).alias("_block"))
    numbered = rows.withColumn("_ip", ipv4_number(F.col(address))).withColumn("_block", F.floor(F.col("_ip") / 65536))
    per_block = blocks.groupBy("_block").agg(F.collect_set(F.struct("_lo", "_hi")).alias("_ranges"))
    joined = numbered.join(per_block, "_block", "left")
    hit = F.coalesce(F.exists("_ranges", lambda r: F.col("_ip").between(r["_lo"], r["_hi"])), F.lit(False))
    return joined.withColumn(out, F.when(F.col("_ip").isNotNull(), hit)).drop("_ip", "_block", "_ranges")


def address_key(address: Column) -> Column:
    """An address as text that sorts as its number: 4 and 8 hexadecimal digits, or 6 and 32; IPv4 addresses inside IPv6 are IPv4. Null for anything else."""
    low = F.lower(address)
    v4 = ipv4_number(F.regexp_replace(low, r"^(?:0{0,4}:)*:?ffff:(?=\d+\.)", ""))
    tail = ipv4_number(F.regexp_extract(low, r":([0-9.]+)$", 1))
    plain = F.when(tail.isNotNull(), F.concat(F.regexp_replace(low, r"[0-9.]+$", ""), F.lower(F.hex(F.floor(tail / 65536))), F.lit(":"), F.lower(F.hex(tail % 65536)))).otherwise(low)
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(plain, "::", 1)), F.when(F.contains(plain, F.lit("::")), groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    v6 = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
    mapped = v6.rlike("^0{20}f{4}")
    return F.when(v4.isNotNull(), F.concat(F.lit("4"), F.lpad(F.lower(F.hex(v4)), 8, "0"))).when(valid_address(low), F.when(mapped, F.concat(F.lit("4"), F.right(v6, F.lit(8)))).otherwise(F.concat(F.lit("6"), v6)))


def network_table(spark: SparkSession, networks: list[str]) -> DataFrame:
    """(block, lo, hi) of networks in CIDR form, a reference list: the ranges of address_key, joined where they touch, by the block (a /16, or a /32 of IPv6) they lie in, or by their kind if they are larger."""
    import ipaddress

    found = [ipaddress.ip_network(n.strip(), strict=False) for n in networks]
    found = [ipaddress.ip_network((int(n.network_address) & 0xFFFFFFFF, n.prefixlen - 96)) if n.version == 6 and n.network_address.ipv4_mapped and n.prefixlen >= 96 else n for n in found]
    rows = []
    for version, digits, fine in ((4, 8, 16), (6, 32, 32)):
        for n in ipaddress.collapse_addresses(x for x in found if x.version == version):
            lo, hi = (f"{version}{int(a):0{digits}x}" for a in (n.network_address, n.broadcast_address))
            rows.append((lo[: 1 + fine // 4] if n.prefixlen >= fine else str(version), lo, hi))
    return spark.createDataFrame(rows, "block STRING, lo STRING, hi STRING")


def in_networks(rows: DataFrame, networks: DataFrame, address: str = "client_ip", out: str = "in_range") -> DataFrame:
    """Adds whether an IPv4 or IPv6 address lies in one of the networks of network_table; null for texts that are no address."""
    listed = networks.groupBy("block").agg(F.collect_set(F.struct("lo", "hi")).alias("_n"))
    key = F.col("_key")
    keyed = rows.withColumn("_key", address_key(F.col(address))).withColumn("_fine", F.when(key.startswith("4"), F.left(key, F.lit(5))).otherwise(F.left(key, F.lit(9)))).withColumn("_kind", F.left(key, F.lit(1)))
    joined = keyed.join(listed.withColumnsRenamed({"block": "_fine", "_n": "_near"}), "_fine", "left").join(F.broadcast(listed.where(F.length("block") == 1).withColumnsRenamed({"block": "_kind", "_n": "_wide"})), "_kind", "left")
    inside = lambda c: F.coalesce(F.exists(c, lambda r: key.between(r["lo"], r["hi"])), F.lit(False))
    return joined.withColumn(out, F.when(key.isNotNull(), inside("_near") | inside("_wide"))).drop("_key", "_fine", "_kind", "_near", "_wide")


def cidr_range(cidr: Column) -> Column:
    """STRUCT<lo, hi> of an IPv4 network in CIDR form; null for anything else."""
    bits = F.split_part(cidr, F.lit("/"), F.lit(2)).try_cast("int")
    size = F.pow(F.lit(2), 32 - bits).cast("bigint")
    base = ipv4_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    lo = base - F.pmod(base, size)
    return F.when(bits.between(0, 32), F.struct(lo.alias("lo"), (lo + size - 1).alias("hi")))
