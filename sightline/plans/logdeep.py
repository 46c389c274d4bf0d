"""Queries on access logs between periods and against exported pages, on addresses of both kinds, and on dataset kinds of exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.operators import logaudit, requests, robots
from sightline.operators.requests import top_per_group
from sightline.plans.exports import _CTE as _EXPORTS
from sightline.plans.exports import _rows as _exported
from sightline.plans.logs import _BAND, _BAND_NAME, _CTE, _FAMILY, _MEDIA, SPLIT, _path, _periods, _rows
from sightline.plans.problems import _RECORDS
from sightline.session import load
from sightline.sources import exports

_NETWORKS = ["192.0.2.0/25", "198.51.100.64/26", "198.51.100.96/27", "203.0.113.0/28", "2001:db8:1::/48", "2001:db8:8::/45", "::ffff:203.0.113.128/121"]
#: The query parameter that the test data's addresses carry.
_PARAMETER = "page"


def c_path_changes(spark, sf_dir):
    """How each crawler's requests of each path changed between the periods."""
    return logaudit.path_changes(*_periods(spark, sf_dir))


def c_timing_changes(spark, sf_dir):
    return logaudit.timing_changes(*_periods(spark, sf_dir))


def c_referrals(spark, sf_dir):
    """Requests by the value of their query parameter."""
    return logaudit.referral_profile(logaudit.referrals(_rows(spark, sf_dir), _PARAMETER))


def c_referral_changes(spark, sf_dir):
    return logaudit.referral_changes(*[logaudit.referrals(d, _PARAMETER) for d in _periods(spark, sf_dir)]).withColumn("failure_rate_delta", F.round("failure_rate_delta", 9))


def _audit(spark, sf_dir):
    return _exported(spark, sf_dir).select(F.col("page").alias("url")).where("url IS NOT NULL").distinct()


def j7_log_pages(spark, sf_dir):
    """Requested paths by whether an exported page has them."""
    found = logaudit.match_pages(_rows(spark, sf_dir), _audit(spark, sf_dir))
    return found.groupBy("state").agg(F.count("*").alias("paths"), F.sum("requests").alias("requests"), F.sum("failures").alias("failures"))


def a14_family_pages(spark, sf_dir):
    """Path families of requests against those of exported pages."""
    return logaudit.match_families(_rows(spark, sf_dir), _audit(spark, sf_dir))


def t4_review_queue(spark, sf_dir):
    """Paths to look at first: most failures, then most crawlers, then most requests, then by name; the first 100 with the number of all."""
    found = logaudit.match_pages(_rows(spark, sf_dir), _audit(spark, sf_dir)).where("failures > 0").withColumn("queue", F.lit("all"))
    return top_per_group(found, ["queue"], [F.desc("failures"), F.desc("crawlers"), F.desc("requests"), F.asc("path")], 100).select("rank", "path", "state", "requests", "failures", "crawlers", "group_rows", "truncated")


def a7_networks(spark, sf_dir):
    """Requests by whether their address, IPv4 or IPv6, lies in the crawlers' published networks."""
    tagged = requests.in_networks(_rows(spark, sf_dir), requests.network_table(spark, _NETWORKS))
    state = F.when(F.col("client_ip").isNull(), "no-address").when(F.col("in_range").isNull(), "invalid").when(F.col("in_range"), "in-range").otherwise("outside")
    return tagged.groupBy(state.alias("state")).agg(F.count("*").alias("requests"), F.countDistinct("client_ip").alias("addresses"))


def k7_failure_rates(spark, sf_dir):
    """Failure rate of each crawler in both periods with Newcombe's interval of the change."""
    out = requests.compare_periods(*[d.where("token IS NOT NULL") for d in _periods(spark, sf_dir)], ["token"]).where("baseline_requests IS NOT NULL AND current_requests IS NOT NULL")
    ci = stats.newcombe(F.col("current_failures"), F.col("current_requests"), F.col("baseline_failures"), F.col("baseline_requests"))
    return out.select("token", "baseline_requests", "baseline_failures", "current_requests", "current_failures", F.round(ci["lower"], 9).alias("lower"), F.round(ci["upper"], 9).alias("upper"))


def c_page_replay(spark, sf_dir):
    """What two robots files say of the documents' addresses, query included, for two named crawlers and one that they don't name."""
    docs = load(spark, sf_dir, "documents").where("page_url IS NOT NULL").select(F.regexp_replace(F.regexp_replace("page_url", "^https?://[^/?#]*", ""), "#.*$", "").alias("path")).distinct()
    tokens = F.explode(F.array(*[F.lit(t) for t in ("quorvexbot", "halmirafetch", "otherbot")]))
    replayed = robots.replay(docs.select("path", tokens.alias("token")), spark.createDataFrame([("quorvexbot",), ("halmirafetch",), ("otherbot",)], "token STRING"), robots.rule_table(spark, _PAGE_ROBOTS))
    return robots.compare_replays(replayed, "before", "after").groupBy("token", "change").agg(F.count("*").alias("paths"))


_PAGE_ROBOTS = {"before": "User-agent: *\nDisallow: /guide\n\nUser-agent: quorvexbot\nDisallow: /answer\nAllow: /answer/1\n", "after": "User-agent: *\nDisallow: /guide\nDisallow: /changelog\n\nUser-agent: quorvexbot\nUser-agent: halmirafetch\nDisallow: /*page\n"}


def s15_dataset_kinds(spark, sf_dir):
    """What kind of dataset each export is by the fields of its header."""
    lines, terms = exports.distinct_lines(load(spark, sf_dir, "bing_export_lines")), load(spark, sf_dir, "export_header_terms")
    headers = exports.find_headers(lines, terms)
    return headers.groupBy(exports.dataset_kind(F.col("fields")).alias("kind")).agg(F.count("*").alias("exports"), F.sum(F.size("fields")).cast("bigint").alias("columns"))


QUERIES = {f.__name__: f for f in (c_path_changes, c_timing_changes, c_referrals, c_referral_changes, j7_log_pages, a14_family_pages, t4_review_queue, a7_networks, k7_failure_rates, c_page_replay, s15_dataset_kinds)}


def _side(op: str) -> str:
    mille = "(2000 * {0} + {1}) // (2 * {1})"
    shares = ", ".join(mille.format(f"count(*) FILTER (sc = '{k}')", "count(*)") for k in ("2xx", "3xx", "4xx", "5xx", "other"))
    return f"""SELECT token, p, n, f, k, codes, media, {mille.format('n', 'sum(n) OVER (PARTITION BY token)')} AS s FROM (SELECT token, p, count(*) n, count(*) FILTER (sc IN ('4xx', '5xx')) f, [{shares}] AS k, coalesce(list_sort(list_distinct(list(status))), []) AS codes, coalesce(list_sort(list_distinct(list({_MEDIA}))), []) AS media
        FROM q WHERE token IS NOT NULL AND path IS NOT NULL AND received_at {op} TIMESTAMP '{SPLIT}' GROUP BY 1, 2)"""


def _p95(op: str) -> str:
    return f"""SELECT token, any_value(sampled) sampled, min(band) FILTER (cum >= ceil(sampled * 0.95)) AS p95 FROM (SELECT token, band, sum(n) OVER (PARTITION BY token ORDER BY band) cum, CAST(sum(n) OVER (PARTITION BY token) AS BIGINT) sampled FROM (SELECT token, {_BAND} AS band, count(*) n FROM q WHERE token IS NOT NULL AND received_at {op} TIMESTAMP '{SPLIT}' GROUP BY 1, 2 HAVING band IS NOT NULL)) GROUP BY 1"""


_VALUE = rf"lower(trim(regexp_extract(path, '\?(?:[^#]*&)?{_PARAMETER}=([^&#]*)', 1)))"
_REF = _CTE + f", rf AS (SELECT *, CASE WHEN {_VALUE} = '' THEN 'empty' ELSE 'single' END AS st, nullif({_VALUE}, '') AS v FROM q WHERE regexp_matches(path, '\\?(?:[^#]*&)?{_PARAMETER}='))"
_MATCH = f"""{_CTE}, {_EXPORTS[5:].replace('r AS (SELECT row_id', 'ex AS (SELECT row_id', 1)}, pg AS (SELECT {_path("regexp_replace(page, '^https?://[^/?#]*', '')")} AS p, count(DISTINCT page) n, min(page) url, bool_or(contains(page, '?')) hq FROM ex WHERE page IS NOT NULL GROUP BY 1),
    lg AS (SELECT p, count(*) requests, count(*) FILTER (sc IN ('4xx', '5xx')) failures, count(DISTINCT token) crawlers FROM q WHERE path IS NOT NULL GROUP BY 1), mt AS (SELECT lg.*, CASE WHEN n IS NULL THEN 'not-audited' WHEN n > 1 OR hq THEN 'ambiguous' ELSE 'matched' END AS state FROM lg LEFT JOIN pg USING (p))
"""
_W = "({x} / {n} + 3.8414588206941236 / (2 * {n})) / (1 + 3.8414588206941236 / {n}) {s} 1.959963984540054 * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + 3.8414588206941236 / (4 * {n} * {n})) / (1 + 3.8414588206941236 / {n})"
_V6 = "regexp_matches(lower(client_ip), '^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:)*[0-9a-f]{1,4})?$')"
_V4 = "regexp_matches(client_ip, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"
ORACLES = {
    "c_path_changes": _CTE + f""", b AS ({_side('<')}), a AS ({_side('>=')}) SELECT coalesce(b.token, a.token) AS token, coalesce(b.p, a.p) AS path, b.n AS requests_b, b.f AS failures_b, a.n AS requests_c, a.f AS failures_c, CASE WHEN b.n IS NULL THEN 'current-only' WHEN a.n IS NULL THEN 'baseline-only'
        WHEN b.f = 0 AND a.f > 0 THEN 'failure-emerged' WHEN b.f > 0 AND a.f = 0 THEN 'failure-cleared' WHEN b.k <> a.k THEN 'response-class-shift' WHEN b.codes <> a.codes THEN 'status-code-set-shift' WHEN b.media <> a.media THEN 'media-type-set-shift' WHEN b.s <> a.s THEN 'request-share-shift' END AS change
        FROM b FULL JOIN a ON a.token = b.token AND a.p = b.p""",
    "c_timing_changes": _CTE + f", b AS ({_p95('<')}), a AS ({_p95('>=')}) SELECT coalesce(b.token, a.token) AS token, b.sampled AS sampled_b, {_BAND_NAME.format('b.p95')} AS p95_band_b, a.sampled AS sampled_c, {_BAND_NAME.format('a.p95')} AS p95_band_c, CASE WHEN coalesce(b.sampled < 20 OR a.sampled < 20, true) THEN 'not-comparable' WHEN a.p95 > b.p95 THEN 'slower' WHEN a.p95 < b.p95 THEN 'faster' ELSE 'same' END AS change FROM b FULL JOIN a ON a.token = b.token",
    "c_referrals": _REF + " SELECT st AS state, v AS source, count(*) requests, count(*) FILTER (sc = '2xx') successful, count(*) FILTER (sc = '3xx') redirects, count(*) FILTER (sc = '4xx') client_errors, count(*) FILTER (sc = '5xx') server_errors, count(*) FILTER (sc = 'other') other_responses, count(DISTINCT p) paths, count(DISTINCT received_at::DATE) AS days FROM rf GROUP BY 1, 2",
    "c_referral_changes": _REF + f""", sd AS (SELECT v AS source, count(*) FILTER (received_at < TIMESTAMP '{SPLIT}') bn, count(*) FILTER (received_at < TIMESTAMP '{SPLIT}' AND sc IN ('4xx', '5xx')) bf, count(*) FILTER (received_at >= TIMESTAMP '{SPLIT}') cn, count(*) FILTER (received_at >= TIMESTAMP '{SPLIT}' AND sc IN ('4xx', '5xx')) cf FROM rf WHERE st = 'single' GROUP BY 1),
        sx AS (SELECT source, nullif(bn, 0) AS bn, CASE WHEN bn > 0 THEN bf END AS bf, nullif(cn, 0) AS cn, CASE WHEN cn > 0 THEN cf END AS cf FROM sd WHERE bn + cn > 0) SELECT source, bn AS baseline_requests, bf AS baseline_failures, cn AS current_requests, cf AS current_failures, cn - bn AS request_delta, round(cf / cn - bf / bn, 9) AS failure_rate_delta,
        CASE WHEN bn IS NULL THEN 'current-only' WHEN cn IS NULL THEN 'baseline-only' WHEN cn > bn THEN 'increased' WHEN cn < bn THEN 'decreased' ELSE 'unchanged' END AS state FROM sx""",
    "j7_log_pages": _MATCH + "SELECT state, count(*) paths, CAST(sum(requests) AS BIGINT) requests, CAST(sum(failures) AS BIGINT) failures FROM mt GROUP BY 1",
    "t4_review_queue": _MATCH + ", rk AS (SELECT CAST(row_number() OVER (ORDER BY failures DESC, crawlers DESC, requests DESC, p) AS INTEGER) AS rank, p AS path, state, requests, failures, crawlers, count(*) OVER () AS group_rows FROM mt WHERE failures > 0) SELECT *, group_rows > 100 AS truncated FROM rk WHERE rank <= 100",
    "a14_family_pages": f"""{_CTE}, {_EXPORTS[5:].replace('r AS (SELECT row_id', 'ex AS (SELECT row_id', 1)}, l AS (SELECT {_FAMILY} AS family, count(*) requests, count(*) FILTER (sc IN ('4xx', '5xx')) failures, count(DISTINCT token) crawlers FROM q WHERE path IS NOT NULL GROUP BY 1),
        g AS (SELECT {_FAMILY} AS family, count(*) pages FROM (SELECT DISTINCT page, {_path("regexp_replace(page, '^https?://[^/?#]*', '')")} AS p FROM ex WHERE page IS NOT NULL) GROUP BY 1) SELECT coalesce(l.family, g.family) AS family, requests, failures, crawlers, pages, CASE WHEN requests IS NOT NULL AND pages IS NOT NULL THEN 'both' WHEN pages IS NULL THEN 'left-only' ELSE 'right-only' END AS presence FROM l FULL JOIN g ON l.family = g.family""",
    "a7_networks": _CTE + f""", n AS (SELECT client_ip, CASE WHEN {_V4} THEN list_transform(string_split(client_ip, '.'), lambda x: TRY_CAST(x AS BIGINT)) END AS o, CASE WHEN {_V6} AND len(list_filter(string_split(client_ip, ':'), lambda x: x <> '')) <= 8 THEN list_transform(string_split(split_part(lower(client_ip), '::', 1), ':'), lambda x: CAST(concat('0x', lpad(x, 4, '0')) AS BIGINT)) END AS h FROM q)
        SELECT CASE WHEN client_ip IS NULL THEN 'no-address' WHEN o IS NULL AND h IS NULL THEN 'invalid' WHEN (o[1] = 192 AND o[2] = 0 AND o[3] = 2 AND o[4] < 128) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100 AND o[4] BETWEEN 64 AND 127)
        OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113 AND (o[4] < 16 OR o[4] >= 128)) OR (h[1] = 8193 AND h[2] = 3512 AND (coalesce(h[3], 0) = 1 OR coalesce(h[3], 0) BETWEEN 8 AND 15)) THEN 'in-range' ELSE 'outside' END AS state, count(*) requests, count(DISTINCT client_ip) addresses FROM n GROUP BY 1""",
    "k7_failure_rates": _CTE + f""", g AS (SELECT token, count(*) FILTER (received_at < TIMESTAMP '{SPLIT}') n0, count(*) FILTER (received_at < TIMESTAMP '{SPLIT}' AND sc IN ('4xx', '5xx')) x0, count(*) FILTER (received_at >= TIMESTAMP '{SPLIT}') n1, count(*) FILTER (received_at >= TIMESTAMP '{SPLIT}' AND sc IN ('4xx', '5xx')) x1 FROM q WHERE token IS NOT NULL GROUP BY 1 HAVING n0 > 0 AND n1 > 0),
        w AS (SELECT *, greatest(0, {_W.format(x='x0', n='n0', s='-')}) l0, least(1, {_W.format(x='x0', n='n0', s='+')}) h0, greatest(0, {_W.format(x='x1', n='n1', s='-')}) l1, least(1, {_W.format(x='x1', n='n1', s='+')}) h1 FROM g)
        SELECT token, n0 AS baseline_requests, x0 AS baseline_failures, n1 AS current_requests, x1 AS current_failures, round(x1 / n1 - x0 / n0 - sqrt((x1 / n1 - l1) ^ 2 + (h0 - x0 / n0) ^ 2), 9) AS lower, round(x1 / n1 - x0 / n0 + sqrt((h1 - x1 / n1) ^ 2 + (x0 / n0 - l0) ^ 2), 9) AS upper FROM w""",
    "c_page_replay": """WITH d AS (SELECT DISTINCT regexp_replace(regexp_replace(page_url, '^https?://[^/?#]*', ''), '#.*$', '') AS path FROM documents WHERE page_url IS NOT NULL), t AS (SELECT path, unnest(['quorvexbot', 'halmirafetch', 'otherbot']) AS token FROM d),
        x AS (SELECT *, CASE WHEN token = 'quorvexbot' THEN path LIKE '/answer%' AND path NOT LIKE '/answer/1%' ELSE path LIKE '/guide%' END AS b, CASE WHEN token <> 'otherbot' THEN path LIKE '/%page%' ELSE path LIKE '/guide%' OR path LIKE '/changelog%' END AS a,
        CASE WHEN token = 'quorvexbot' THEN CASE WHEN path LIKE '/answer/1%' THEN '/answer/1' WHEN path LIKE '/answer%' THEN '/answer' END WHEN path LIKE '/guide%' THEN '/guide' END AS br, CASE WHEN token <> 'otherbot' THEN CASE WHEN path LIKE '/%page%' THEN '/*page' END WHEN path LIKE '/guide%' THEN '/guide' WHEN path LIKE '/changelog%' THEN '/changelog' END AS ar FROM t)
        SELECT token, CASE WHEN a AND NOT b THEN 'newly-blocked' WHEN b AND NOT a THEN 'newly-allowed' WHEN br IS DISTINCT FROM ar THEN 'rule-change' ELSE 'unchanged' END AS change, count(*) paths FROM x GROUP BY 1, 2""",
    "s15_dataset_kinds": _RECORDS + """SELECT CASE WHEN list_contains(fields, 'url') AND list_contains(fields, 'query') THEN 'query-page-mapping' WHEN list_contains(fields, 'url') THEN 'page-citations' WHEN list_contains(fields, 'query') THEN 'grounding-queries' WHEN list_contains(fields, 'date') THEN 'time-series'
        WHEN list_contains(fields, 'topic') AND list_contains(fields, 'intent') THEN 'topic-intent-summary' WHEN list_contains(fields, 'topic') THEN 'topic-summary' WHEN list_contains(fields, 'intent') THEN 'intent-summary' ELSE 'overview' END AS kind, count(*) exports, CAST(sum(len(fields)) AS BIGINT) AS columns FROM g GROUP BY 1""",
}
