"""Access-log queries over crawler_requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import logs
from sightline.functions.normalize import path_family
from sightline.operators import requests, robots
from sightline.session import load

SPLIT = "2026-06-01"
_ROBOTS = {
    "before": "User-agent: *\nDisallow: /shop\nAllow: /shop/$\n\nUser-agent: quorvexbot\nDisallow: /help\n",
    "after": "User-agent: *\nDisallow: /shop/*page=\nDisallow: /blog\n\nUser-agent: quorvexbot\nUser-agent: halmirafetch\nDisallow: /\nAllow: /guides\n",
}
_RANGES = ["192.0.2.0/25", "198.51.100.64/26", "198.51.100.96/27", "203.0.113.0/28"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests once each, classified by the catalog."""
    return requests.classify(requests.latest_requests(load(spark, sf_dir, "crawler_requests")), load(spark, sf_dir, "crawler_catalog"))


def a4_crawler_profile(spark, sf_dir):
    return requests.crawler_profile(_rows(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


def w6_daily_activity(spark, sf_dir):
    return requests.daily_activity(_rows(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def w1_top_paths(spark, sf_dir):
    return requests.top_per_group(requests.path_counts(_rows(spark, sf_dir)), ["token"], [F.desc("requests"), F.asc("path")], 200)


def c_failure_hotspots(spark, sf_dir):
    return requests.failure_hotspots(_rows(spark, sf_dir)).withColumn("failure_share", F.round("failure_share", 9))


def a5_latency_bands(spark, sf_dir):
    return requests.latency_profile(_rows(spark, sf_dir))


def c_path_disparities(spark, sf_dir):
    return requests.path_disparities(_rows(spark, sf_dir))


def _periods(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    early = F.col("received_at") < F.lit(SPLIT).cast("timestamp_ntz")
    return rows.where(early), rows.where(~early)


def j1_crawler_periods(spark, sf_dir):
    before, after = _periods(spark, sf_dir)
    return requests.compare_periods(before.where("token IS NOT NULL"), after.where("token IS NOT NULL"), ["token"]).withColumn("failure_rate_delta", F.round("failure_rate_delta", 9))


def a13_path_families(spark, sf_dir):
    return requests.family_profile(_rows(spark, sf_dir))


def c_family_periods(spark, sf_dir):
    before, after = [d.where("path IS NOT NULL").withColumn("family", path_family(F.col("path"))) for d in _periods(spark, sf_dir)]
    return requests.compare_periods(before, after, ["family"]).withColumn("failure_rate_delta", F.round("failure_rate_delta", 9))


def g_family_failure_gate(spark, sf_dir):
    return requests.family_failure_gate(c_family_periods(spark, sf_dir))


def j9_address_ranges(spark, sf_dir):
    ranges = spark.createDataFrame([(r,) for r in _RANGES], "cidr STRING").select(requests.cidr_range(F.col("cidr")).alias("r")).select("r.lo", "r.hi")
    tagged = requests.in_ranges(_rows(spark, sf_dir), ranges)
    state = F.when(F.col("client_ip").isNull(), "no-address").when(F.col("in_range").isNull(), "no-ipv4").when(F.col("in_range"), "in-range").otherwise("outside")
    return tagged.groupBy(state.alias("state")).agg(F.count("*").alias("requests"))


def p_request_classes(spark, sf_dir):
    """Status class, latency band, media type and parameter state of all requests, counted."""
    rows = requests.latest_requests(load(spark, sf_dir, "crawler_requests"))
    return rows.groupBy(
        logs.status_class(F.col("status")).alias("status_class"), logs.band_name(logs.latency_band(F.col("duration_ms"))).alias("latency_band"), logs.media_type(F.col("content_type")).alias("media_type"),
        F.contains(F.col("path"), F.lit("?")).alias("has_query"),
    ).agg(F.count("*").alias("requests"))


def j11_robots_replay(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("token IS NOT NULL AND path IS NOT NULL").select("token", "path").distinct()
    replayed = robots.replay(rows, load(spark, sf_dir, "crawler_catalog"), robots.rule_table(spark, _ROBOTS))
    return replayed.groupBy("policy", "token").agg(F.count("*").alias("paths"), F.count_if(~F.col("allowed")).alias("blocked"))


def j12_robots_changes(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("token IS NOT NULL AND path IS NOT NULL").select("token", "path").distinct()
    replayed = robots.replay(rows, load(spark, sf_dir, "crawler_catalog"), robots.rule_table(spark, _ROBOTS))
    return robots.compare_replays(replayed, "before", "after").groupBy("token", "change").agg(F.count("*").alias("paths"))


def _path(column: str) -> str:
    return f"CASE WHEN regexp_replace({column}, '[?#].*$', '') = '' THEN '/' ELSE regexp_replace({column}, '[?#].*$', '') END"


_CTE = f"""
WITH r AS (SELECT request_id, any_value(site_host) site_host, any_value(client_ip) client_ip, any_value(path) path, any_value(status) status, any_value(content_type) content_type,
    any_value(duration_ms) duration_ms, any_value(user_agent) user_agent, max(received_at) received_at FROM crawler_requests WHERE request_id IS NOT NULL GROUP BY request_id),
 agents AS (SELECT DISTINCT user_agent FROM r WHERE user_agent IS NOT NULL),
 hit AS (SELECT user_agent, c.token, c.provider, c.activity, row_number() OVER (PARTITION BY user_agent ORDER BY length(c.token) DESC, c.token) k
    FROM agents JOIN crawler_catalog c ON regexp_matches(lower(user_agent), '(^|[^a-z0-9])' || lower(c.token) || '($|[^a-z0-9])')),
 q AS (SELECT r.*, h.token, h.provider, h.activity, {_path("r.path")} AS p, CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx' WHEN status BETWEEN 400 AND 499 THEN '4xx'
    WHEN status BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS sc FROM r LEFT JOIN (SELECT * FROM hit WHERE k = 1) h USING (user_agent))
"""
_FAMILY = "CASE WHEN p = '/' OR regexp_matches(p, '^/+$') THEN '/' ELSE '/' || CASE WHEN regexp_matches(list_filter(string_split(p, '/'), lambda x: x <> '')[1], '^([0-9]{5,}|[0-9a-fA-F]{16,})$') THEN ':id' ELSE list_filter(string_split(p, '/'), lambda x: x <> '')[1] END || CASE WHEN len(list_filter(string_split(p, '/'), lambda x: x <> '')) > 1 THEN '/*' ELSE '' END END"
_BAND = "CASE WHEN duration_ms < 0 OR duration_ms IS NULL THEN NULL " + " ".join(f"WHEN duration_ms <= {b} THEN {k}" for k, (_, b) in enumerate(logs.LATENCY_BANDS) if b) + f" ELSE {len(logs.LATENCY_BANDS) - 1} END"
_BAND_NAME = "CASE {0} " + " ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(logs.LATENCY_BANDS)) + " END"
_MEDIA = "CASE WHEN regexp_matches(lower(trim(split_part(content_type, ';', 1))), '^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$') THEN lower(trim(split_part(content_type, ';', 1))) END"


def _compare(key: str, extra: str = "TRUE") -> str:
    side = lambda p, op: f"SELECT {key} AS k, count(*) n, count(*) FILTER (sc IN ('4xx', '5xx')) f FROM q WHERE {extra} AND received_at {op} TIMESTAMP '{SPLIT}' GROUP BY 1"
    return f"""SELECT coalesce(b.k, c.k) AS k, b.n AS baseline_requests, b.f AS baseline_failures, c.n AS current_requests, c.f AS current_failures, c.n - b.n AS request_delta,
    round(c.f / c.n - b.f / b.n, 9) AS failure_rate_delta, CASE WHEN b.n IS NULL THEN 'current-only' WHEN c.n IS NULL THEN 'baseline-only' WHEN c.n > b.n THEN 'increased' WHEN c.n < b.n THEN 'decreased' ELSE 'unchanged' END AS state
    FROM ({side("b", "<")}) b FULL JOIN ({side("c", ">=")}) c ON b.k = c.k"""


QUERIES = {
    f.__name__: f
    for f in (a4_crawler_profile, w6_daily_activity, w1_top_paths, c_failure_hotspots, a5_latency_bands, c_path_disparities, j1_crawler_periods, a13_path_families, c_family_periods, g_family_failure_gate, j9_address_ranges, p_request_classes, j11_robots_replay, j12_robots_changes)
}
_PATHS = "SELECT token, p AS path, count(*) requests, count(*) FILTER (sc = '2xx') successful, count(*) FILTER (sc IN ('4xx', '5xx')) failures FROM q WHERE token IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2"
ORACLES = {
    "a4_crawler_profile": _CTE + """SELECT token, provider, activity, count(*) requests, count(*) FILTER (sc = '2xx') successful, count(*) FILTER (sc = '3xx') redirects, count(*) FILTER (sc = '4xx') client_errors,
        count(*) FILTER (sc = '5xx') server_errors, count(*) FILTER (sc = 'other') other_responses, count(DISTINCT p) paths, count(DISTINCT site_host) sites, CAST(min(received_at::DATE) AS VARCHAR) first_day, CAST(max(received_at::DATE) AS VARCHAR) last_day
        FROM q WHERE token IS NOT NULL GROUP BY 1, 2, 3""",
    "w6_daily_activity": _CTE + """SELECT token, CAST(day AS VARCHAR) AS day, requests, failures, CAST(date_diff('day', day, max(day) OVER (PARTITION BY token)) AS INTEGER) days_before_last
        FROM (SELECT token, received_at::DATE AS day, count(*) requests, count(*) FILTER (sc IN ('4xx', '5xx')) failures FROM q WHERE token IS NOT NULL AND received_at IS NOT NULL GROUP BY 1, 2)""",
    "w1_top_paths": _CTE + f"SELECT *, group_rows > 200 AS truncated FROM (SELECT *, CAST(row_number() OVER (PARTITION BY token ORDER BY requests DESC, path) AS INTEGER) AS rank, count(*) OVER (PARTITION BY token) AS group_rows FROM ({_PATHS})) WHERE rank <= 200",
    "c_failure_hotspots": _CTE + f"SELECT *, group_rows > 50 AS truncated FROM (SELECT *, round(failures / requests, 9) AS failure_share, CAST(row_number() OVER (PARTITION BY token ORDER BY failures DESC, path) AS INTEGER) AS rank, count(*) OVER (PARTITION BY token) AS group_rows FROM ({_PATHS}) WHERE failures > 0) WHERE rank <= 50",
    "a5_latency_bands": _CTE + f""", b AS (SELECT token, {_BAND} AS band, count(*) requests FROM q WHERE token IS NOT NULL GROUP BY 1, 2 HAVING band IS NOT NULL),
        s AS (SELECT *, sum(requests) OVER (PARTITION BY token ORDER BY band) cumulative, CAST(sum(requests) OVER (PARTITION BY token) AS BIGINT) sampled FROM b),
        e AS (SELECT token, min(band) FILTER (cumulative >= ceil(sampled * 0.5)) p50, min(band) FILTER (cumulative >= ceil(sampled * 0.95)) p95 FROM s GROUP BY 1)
        SELECT token, {_BAND_NAME.format("band")} AS band, requests, sampled, {_BAND_NAME.format("p50")} AS p50_band, {_BAND_NAME.format("p95")} AS p95_band FROM s JOIN e USING (token)""",
    "c_path_disparities": _CTE + f""", per AS (SELECT activity, p AS path, token, list_sort(list_distinct(list(sc))) classes, list_sort(list_distinct(list(status))) codes, list_sort(list_distinct(list({_MEDIA}))) media, count(*) n FROM q WHERE token IS NOT NULL AND path IS NOT NULL GROUP BY 1, 2, 3)
        SELECT activity, path, count(*) crawlers, CAST(sum(n) AS BIGINT) requests, count(DISTINCT classes) > 1 classes_differ, count(DISTINCT codes) > 1 codes_differ, count(DISTINCT coalesce(media, [])) > 1 media_differ,
        bool_or(list_contains(classes, '2xx') AND NOT list_contains(classes, '4xx') AND NOT list_contains(classes, '5xx')) AND bool_or(NOT list_contains(classes, '2xx') AND (list_contains(classes, '4xx') OR list_contains(classes, '5xx'))) success_failure_split
        FROM per GROUP BY 1, 2 HAVING count(*) > 1""",
    "j1_crawler_periods": _CTE + f"SELECT k AS token, * EXCLUDE (k) FROM ({_compare('token', 'token IS NOT NULL')})",
    "a13_path_families": _CTE + f"SELECT {_FAMILY} AS family, count(*) requests, count(DISTINCT token) crawlers, count(*) FILTER (sc IN ('4xx', '5xx')) failures FROM q WHERE path IS NOT NULL GROUP BY 1",
    "c_family_periods": _CTE + f"SELECT k AS family, * EXCLUDE (k) FROM ({_compare(_FAMILY, 'path IS NOT NULL')})",
    "g_family_failure_gate": _CTE + f"""SELECT count(*) FILTER (ready) families_compared, count(*) FILTER (ready AND failure_rate_delta > 0.05) violations, count(*) FILTER (ready) > 0 AS complete,
        count(*) FILTER (ready) > 0 AND count(*) FILTER (ready AND failure_rate_delta > 0.05) = 0 AS passed FROM (SELECT *, baseline_requests >= 20 AND current_requests >= 20 AS ready FROM ({_compare(_FAMILY, 'path IS NOT NULL')}))""",
    "j9_address_ranges": _CTE + """, n AS (SELECT client_ip, CASE WHEN regexp_matches(client_ip, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$') THEN list_transform(string_split(client_ip, '.'), lambda x: TRY_CAST(x AS BIGINT)) END AS o FROM q)
        SELECT CASE WHEN client_ip IS NULL THEN 'no-address' WHEN o IS NULL THEN 'no-ipv4' WHEN (o[1] = 192 AND o[2] = 0 AND o[3] = 2 AND o[4] < 128) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100 AND o[4] BETWEEN 64 AND 127)
        OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113 AND o[4] < 16) THEN 'in-range' ELSE 'outside' END AS state, count(*) requests FROM n GROUP BY 1""",
    "p_request_classes": _CTE + f"SELECT sc AS status_class, {_BAND_NAME.format(_BAND)} AS latency_band, {_MEDIA} AS media_type, contains(path, '?') AS has_query, count(*) requests FROM q GROUP BY 1, 2, 3, 4".replace("CASE CASE", "CASE (CASE").replace("END WHEN 0 THEN", "END) WHEN 0 THEN"),
}
#: The two policies spelled out: whether each blocks a path.
_REPLAY = _CTE + """, a AS (SELECT DISTINCT token, path FROM q WHERE token IS NOT NULL AND path IS NOT NULL), x AS (SELECT token, path,
    CASE WHEN contains(lower(token), 'quorvexbot') THEN path LIKE '/help%' ELSE path LIKE '/shop%' AND path <> '/shop/' END AS before,
    CASE WHEN contains(lower(token), 'quorvexbot') OR contains(lower(token), 'halmirafetch') THEN path NOT LIKE '/guides%' AND path <> '/robots.txt' ELSE path LIKE '/shop/%page=%' OR path LIKE '/blog%' END AS after,
    CASE WHEN contains(lower(token), 'quorvexbot') THEN CASE WHEN path LIKE '/help%' THEN '/help' END WHEN path = '/shop/' THEN '/shop/$' WHEN path LIKE '/shop%' THEN '/shop' END AS before_rule,
    CASE WHEN path = '/robots.txt' THEN NULL WHEN contains(lower(token), 'quorvexbot') OR contains(lower(token), 'halmirafetch') THEN CASE WHEN path LIKE '/guides%' THEN '/guides' ELSE '/' END WHEN path LIKE '/shop/%page=%' THEN '/shop/*page=' WHEN path LIKE '/blog%' THEN '/blog' END AS after_rule FROM a)
"""
ORACLES |= {
    "j11_robots_replay": _REPLAY + "SELECT 'before' AS policy, token, count(*) paths, count(*) FILTER (before) blocked FROM x GROUP BY 2 UNION ALL SELECT 'after', token, count(*), count(*) FILTER (after) FROM x GROUP BY 2",
    "j12_robots_changes": _REPLAY + "SELECT token, CASE WHEN after AND NOT before THEN 'newly-blocked' WHEN before AND NOT after THEN 'newly-allowed' WHEN before_rule IS DISTINCT FROM after_rule THEN 'rule-change' ELSE 'unchanged' END AS change, count(*) paths FROM x GROUP BY 1, 2",
}
