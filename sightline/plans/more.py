"""Further queries: edge comparisons, sweeps, mentions, quotas, gaps, streams, resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sightline.functions import stats
from sightline.functions.normalize import host, owned
from sightline.operators import graph, panel, resampling, tables
from sightline.operators.ordered import last_before
from sightline.plans.exports import _TFIDF, _similar
from sightline.plans.panel import _CTE, _NAMED, _P_SIGN, OWNED, _citations, _mentions, _observations, _rounded
from sightline.session import load, materialize
from sightline.sources import files
from sightline.streaming import activity


def g7_rank_weighted_edges(spark, sf_dir):
    """Every pair of domains that a provider cites for the same prompt, with its rank-weighted strength."""
    return _rounded(graph.rank_weighted_edges(_citations(spark, sf_dir).where("provider IS NOT NULL"), ["provider"], "prompt_id", "domain", "rank"), "strength")


def g9_edge_comparison(spark, sf_dir):
    """Domain pairs cited together by one provider, by another, or by both, over the prompts both answered: McNemar, Holm, Newcombe."""
    rows = _citations(spark, sf_dir).where("provider IS NOT NULL").select("provider", "prompt_id", "domain").distinct()
    prompts = rows.select("provider", "prompt_id").distinct()
    edges = rows.withColumnRenamed("domain", "x").join(rows.withColumnRenamed("domain", "y"), ["provider", "prompt_id"]).where("x < y").select("provider", "prompt_id", F.concat_ws("|", "x", "y").alias("edge"))
    pa, pb = prompts.select(F.col("provider").alias("side_a"), "prompt_id"), prompts.select(F.col("provider").alias("side_b"), "prompt_id")
    both = materialize(pa.join(pb, "prompt_id").where("side_a < side_b"), "shared-prompts")
    n = both.groupBy("side_a", "side_b").agg(F.count("*").alias("prompts"))
    in_a = both.join(edges.select(F.col("provider").alias("side_a"), "prompt_id", "edge"), ["side_a", "prompt_id"]).select("side_a", "side_b", "prompt_id", "edge", F.lit(1).alias("a"), F.lit(0).alias("b"))
    in_b = both.join(edges.select(F.col("provider").alias("side_b"), "prompt_id", "edge"), ["side_b", "prompt_id"]).select("side_a", "side_b", "prompt_id", "edge", F.lit(0).alias("a"), F.lit(1).alias("b"))
    cells = in_a.unionByName(in_b).groupBy("side_a", "side_b", "edge", "prompt_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = cells.groupBy("side_a", "side_b", "edge").agg(F.sum("a").alias("prompts_a"), F.sum("b").alias("prompts_b"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b")).join(F.broadcast(n), ["side_a", "side_b"])
    ci = stats.newcombe(F.col("prompts_a"), F.col("prompts"), F.col("prompts_b"), F.col("prompts"))
    out = out.withColumn("p", stats.mcnemar_p(F.col("only_a"), F.col("only_b"))).withColumn("ci", ci).withColumn("lower", F.col("ci.lower")).withColumn("upper", F.col("ci.upper")).drop("ci")
    return _rounded(panel.holm_adjust(out, "p", "edge", ["side_a", "side_b"]), "p", "holm_p", "lower", "upper")


#: The thresholds of the sweep.
SWEEP = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def x5_threshold_sweep_all(spark, sf_dir):
    """Families of similar prompts at ten thresholds, over every pair of a cosine from the least of them on: members, families, largest."""
    levels = spark.createDataFrame([(t,) for t in SWEEP], "threshold DOUBLE")
    pairs = materialize(_similar(spark, sf_dir, least=SWEEP[0]), "similar")
    # one search for all thresholds: a node stands for a prompt at a threshold
    close = pairs.join(F.broadcast(levels), F.col("cosine") >= F.col("threshold"))
    node = lambda c: F.struct("threshold", c)
    found = graph.components(close.select(node(F.col("a").alias("id")).alias("a"), node(F.col("b").alias("id")).alias("b")), "a", "b")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).withColumn("threshold", F.col("component.threshold"))
    rows = sizes.groupBy("threshold").agg(F.sum("n").alias("members"), F.count("*").alias("families"), F.max("n").alias("largest"))
    return levels.join(rows, "threshold", "left").fillna(0, ["members", "families", "largest"])


def g10_bridging_prompts(spark, sf_dir):
    """Prompts that alone hold a family of similar prompts together."""
    return graph.bridging_nodes(_similar(spark, sf_dir).where("cosine >= 0.7"), "a", "b")


def p17_entity_mentions(spark, sf_dir):
    """Answers that mention each listed entity, and how often."""
    return _mentions(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("answers"), F.sum("n").alias("mentions"))


def a38_entity_comentions(spark, sf_dir):
    """How often listed entities are mentioned in the same answer."""
    rows = _mentions(spark, sf_dir).withColumn("scope", F.lit("all"))
    return _rounded(graph.cocitation(rows, ["scope"], "observation_id", "entity"), "jaccard", "lift", "given_left", "given_right")


def p18_answer_lengths(spark, sf_dir):
    """Answers by band of words (up to 10, 20, 40, more) and provider. The bands are ours."""
    words = F.size(F.split(F.trim("answer_text"), r"\s+"))
    band = F.when(words <= 10, "1-10").when(words <= 20, "11-20").when(words <= 40, "21-40").otherwise("41+")
    return _observations(spark, sf_dir).where("trim(answer_text) <> ''").groupBy("provider", band.alias("band")).agg(F.count("*").alias("answers"))


def a40_sampling_quotas(spark, sf_dir):
    """200 prompts dealt to topics in proportion to their prompts, by largest remainder, ties to the first topic."""
    sizes = _observations(spark, sf_dir).where("topic IS NOT NULL").groupBy("topic").agg(F.countDistinct("prompt_id").alias("prompts"))
    share = sizes.join(F.broadcast(sizes.agg(F.sum("prompts").alias("total")))).withColumn("exact", F.col("prompts") * 200 / F.col("total")).withColumn("base", F.floor("exact"))
    left = share.agg((200 - F.sum("base")).alias("left"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), F.asc("topic")))
    return share.join(F.broadcast(left)).withColumn("rank", rank).select("topic", "prompts", (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).alias("quota"))


def w9_capture_gaps(spark, sf_dir):
    """The longest time between captures of each panel, in seconds."""
    rows = _observations(spark, sf_dir).where("panel_id IS NOT NULL AND received_at IS NOT NULL").select("panel_id", "observation_id", "received_at", F.unix_seconds(F.col("received_at").cast("timestamp")).alias("at"))
    steps = last_before(rows, ["panel_id"], ["received_at", "observation_id"], F.date_trunc("month", "received_at"), F.col("at"), "previous")
    return steps.groupBy("panel_id").agg(F.max(F.col("at") - F.col("previous")).alias("largest_gap"), F.count("*").alias("captures"))


def w7_downsampled_series(spark, sf_dir):
    daily = _observations(spark, sf_dir).groupBy("provider", F.datediff(F.to_date("received_at"), F.lit("2026-01-01").cast("date")).alias("day")).agg(F.count("*").alias("captures"))
    return tables.downsample(daily.where("provider IS NOT NULL"), ["provider"], "day", "captures", 20)


def a30_owned_gap_pairs(spark, sf_dir):
    """How often external domains occur in groups that cite an owned domain against groups that surely don't."""
    obs = _observations(spark, sf_dir).where("provider IS NOT NULL")
    rows = panel.citations(obs, host(F.col("url")))
    keys = ["panel_id", "provider", "prompt_id"]
    states = panel.group_states(obs, keys).join(rows.groupBy(*keys).agg(F.max(owned(F.col("domain"), OWNED)).alias("has_owned")), keys)
    arms = states.where("has_owned OR all_complete").select(*keys, "has_owned")
    totals = arms.agg(F.count_if("has_owned").alias("owned_groups"), F.count_if(~F.col("has_owned")).alias("gap_groups"))
    external = rows.where(~owned(F.col("domain"), OWNED)).select(*keys, "domain").distinct().join(arms, keys)
    out = external.groupBy("domain").agg(F.count_if("has_owned").alias("with_owned"), F.count_if(~F.col("has_owned")).alias("in_gap")).join(F.broadcast(totals))
    return _rounded(out.withColumn("rate_difference", F.col("in_gap") / F.col("gap_groups") - F.col("with_owned") / F.col("owned_groups")), "rate_difference")


def k8_bootstrap_intervals(spark, sf_dir):
    units = _citations(spark, sf_dir).groupBy("panel_id", "prompt_id").agg(F.countDistinct("domain").alias("domains"))
    return resampling.bootstrap_means(units, "panel_id", "prompt_id", "domains")


def s5_sitemap_entries(spark, sf_dir):
    """Entries of sitemaps written from the documents' addresses, one sitemap a source."""
    docs = load(spark, sf_dir, "documents").where("page_url IS NOT NULL AND source IS NOT NULL")
    entry = F.concat(F.lit("<url><loc>"), F.replace("page_url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><!-- x --><lastmod>"), F.date_format("published_at", "yyyy-MM-dd"), F.lit("</lastmod></url>"))
    maps = docs.groupBy("source").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(entry), ""), F.lit("</urlset>")).alias("xml"))
    return files.sitemap_entries(maps, "xml")


def s_stream_days(spark, sf_dir):
    """Requests by day and status class, from a stream over the request files."""
    days = activity.run_complete(activity.daily_windows(activity.read_stream(spark, sf_dir, "crawler_requests").withColumn("received_at", F.col("received_at").cast("timestamp"))), "days")
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status_class", "requests")


def s_sessions(spark, sf_dir):
    """Visits by site: runs of requests without a pause of 30 minutes, counted and their longest."""
    rows = load(spark, sf_dir, "crawler_requests").withColumn("received_at", F.col("received_at").cast("timestamp"))
    return activity.sessions(rows, "site_host").groupBy("site_host").agg(F.count("*").alias("sessions"), F.max("requests").alias("longest"))


QUERIES = {f.__name__: f for f in (g7_rank_weighted_edges, g9_edge_comparison, x5_threshold_sweep_all, g10_bridging_prompts, p17_entity_mentions, a38_entity_comentions, p18_answer_lengths, a40_sampling_quotas, w9_capture_gaps, w7_downsampled_series, a30_owned_gap_pairs, k8_bootstrap_intervals, s5_sitemap_entries, s_stream_days, s_sessions)}
_KEYS = "panel_id, provider, prompt_id"
ORACLES = {
    "g7_rank_weighted_edges": _CTE + ", w AS (SELECT provider, prompt_id, domain, sum(1 / log2(rank + 1)) w FROM c WHERE provider IS NOT NULL GROUP BY ALL), s AS (SELECT *, w / sum(w) OVER (PARTITION BY provider, prompt_id) AS s FROM w) SELECT provider, a.domain left_item, b.domain right_item, round(sum(sqrt(a.s * b.s)), 9) strength FROM s a JOIN s b USING (provider, prompt_id) WHERE a.domain < b.domain GROUP BY 1, 2, 3",
    "p17_entity_mentions": _CTE + _NAMED + " SELECT entity, count(*) answers, CAST(sum(n) AS BIGINT) mentions FROM mn GROUP BY 1",
    "a38_entity_comentions": _CTE + _NAMED + ", k AS (SELECT entity e, count(*) n FROM mn GROUP BY 1), t AS (SELECT count(DISTINCT observation_id) n FROM mn), p AS (SELECT a.entity x, b.entity y, count(*) n FROM mn a JOIN mn b USING (observation_id) WHERE a.entity < b.entity GROUP BY 1, 2) SELECT 'all' AS scope, x AS left_item, y AS right_item, p.n AS \"both\", kx.n AS left_units, ky.n AS right_units, t.n AS units, round(p.n / (kx.n + ky.n - p.n), 9) jaccard, round(p.n * t.n / (kx.n * ky.n), 9) lift, round(p.n / kx.n, 9) given_left, round(p.n / ky.n, 9) given_right FROM p JOIN k kx ON kx.e = x JOIN k ky ON ky.e = y, t",
    "p18_answer_lengths": _CTE + r", w AS (SELECT provider, len(regexp_split_to_array(trim(answer_text), '[ \t\n\x0B\f\r]+')) n FROM o WHERE trim(answer_text) <> '') SELECT provider, CASE WHEN n <= 10 THEN '1-10' WHEN n <= 20 THEN '11-20' WHEN n <= 40 THEN '21-40' ELSE '41+' END AS band, count(*) answers FROM w GROUP BY 1, 2",
    "a40_sampling_quotas": _CTE + ", s AS (SELECT topic, count(DISTINCT prompt_id) prompts FROM o WHERE topic IS NOT NULL GROUP BY 1), e AS (SELECT *, prompts * 200 / (SELECT sum(prompts) FROM s) AS x FROM s), r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, topic) k, 200 - sum(floor(x)) OVER () AS rest FROM e) SELECT topic, prompts, CAST(floor(x) + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r",
    "w9_capture_gaps": _CTE + ", g AS (SELECT panel_id, CAST(floor(epoch(received_at)) AS BIGINT) - lag(CAST(floor(epoch(received_at)) AS BIGINT)) OVER (PARTITION BY panel_id ORDER BY received_at) AS gap FROM o WHERE panel_id IS NOT NULL) SELECT panel_id, max(gap) largest_gap, count(*) captures FROM g GROUP BY 1",
    "a30_owned_gap_pairs": _CTE + f", st AS (SELECT {_KEYS}, bool_and(complete) ac FROM o WHERE provider IS NOT NULL GROUP BY ALL), ow AS (SELECT {_KEYS}, bool_or(domain = 'test' OR domain LIKE '%.test') has_owned FROM c WHERE provider IS NOT NULL GROUP BY ALL), arms AS (SELECT {_KEYS}, has_owned FROM st JOIN ow USING ({_KEYS}) WHERE has_owned OR ac), x AS (SELECT DISTINCT {_KEYS}, domain FROM c WHERE provider IS NOT NULL AND NOT (domain = 'test' OR domain LIKE '%.test')), f AS (SELECT domain, count(*) FILTER (has_owned) with_owned, count(*) FILTER (NOT has_owned) in_gap, (SELECT count(*) FILTER (has_owned) FROM arms) owned_groups, (SELECT count(*) FILTER (NOT has_owned) FROM arms) gap_groups FROM x JOIN arms USING ({_KEYS}) GROUP BY 1) SELECT *, round(in_gap / gap_groups - with_owned / owned_groups, 9) AS rate_difference FROM f",
    "s5_sitemap_entries": "SELECT source, page_url AS loc, strftime(published_at, '%Y-%m-%d') AS lastmod FROM documents WHERE page_url IS NOT NULL AND source IS NOT NULL AND published_at IS NOT NULL",
    "s_stream_days": "SELECT strftime(received_at, '%Y-%m-%d') AS day, CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx' WHEN status BETWEEN 400 AND 499 THEN '4xx' WHEN status BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS status_class, count(*) requests FROM crawler_requests WHERE received_at IS NOT NULL GROUP BY 1, 2",
    "s_sessions": "WITH g AS (SELECT site_host, received_at, CASE WHEN received_at >= lag(received_at) OVER w + INTERVAL 30 MINUTE OR lag(received_at) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM crawler_requests WHERE site_host IS NOT NULL AND received_at IS NOT NULL WINDOW w AS (PARTITION BY site_host ORDER BY received_at)), s AS (SELECT site_host, sum(new) OVER (PARTITION BY site_host ORDER BY received_at ROWS UNBOUNDED PRECEDING) k FROM g), n AS (SELECT site_host, k, count(*) n FROM s GROUP BY 1, 2) SELECT site_host, count(*) sessions, max(n) longest FROM n GROUP BY 1",
    "x5_threshold_sweep_all": _TFIDF.replace("WITH p AS", "WITH RECURSIVE p AS", 1).replace(">= 0.65", ">= 0.5") + f""", h AS (SELECT CAST(unnest({SWEEP}) AS DOUBLE) AS t), z AS MATERIALIZED (SELECT t, a, b FROM s, h WHERE cosine >= t UNION ALL SELECT t, b, a FROM s, h WHERE cosine >= t),
        q AS (SELECT t, a, a AS b FROM z UNION SELECT q.t, q.a, z.b FROM q JOIN z ON z.t = q.t AND z.a = q.b), m AS (SELECT t, a, min(b) c FROM q GROUP BY 1, 2), g AS (SELECT t, c, count(*) n FROM m GROUP BY 1, 2)
        SELECT h.t AS threshold, CAST(coalesce(sum(n), 0) AS BIGINT) members, count(c) families, coalesce(max(n), 0) largest FROM h LEFT JOIN g ON g.t = h.t GROUP BY 1""",
    "w7_downsampled_series": _CTE + """, d AS (SELECT provider, date_diff('day', DATE '2026-01-01', received_at::DATE) AS day, count(*) captures FROM o WHERE provider IS NOT NULL GROUP BY 1, 2), e AS (SELECT provider, min(day) lo, max(day) hi FROM d GROUP BY 1),
        b AS (SELECT d.*, coalesce(CAST(least(floor((day - lo) / nullif(hi - lo, 0) * 20), 19) AS BIGINT), 0) AS bucket FROM d JOIN e USING (provider)), r AS (SELECT *, row_number() OVER (PARTITION BY provider, bucket ORDER BY captures, day) lo_k, row_number() OVER (PARTITION BY provider, bucket ORDER BY captures DESC, day) hi_k FROM b)
        SELECT provider, bucket, CAST(day AS INTEGER) AS day, captures FROM r WHERE lo_k = 1 OR hi_k = 1""",
}
_WILSON = "({x} / {n} + 3.8414588206941236 / (2 * {n})) / (1 + 3.8414588206941236 / {n}) {s} 1.959963984540054 * sqrt({x} / {n} * (1 - {x} / {n}) / {n} + 3.8414588206941236 / (4 * {n} * {n})) / (1 + 3.8414588206941236 / {n})"
ORACLES["g9_edge_comparison"] = _CTE + f""", r AS (SELECT DISTINCT provider, prompt_id, domain FROM c WHERE provider IS NOT NULL), pr AS (SELECT DISTINCT provider, prompt_id FROM r), e AS (SELECT a.provider, a.prompt_id, a.domain || '|' || b.domain AS edge FROM r a JOIN r b ON a.provider = b.provider AND a.prompt_id = b.prompt_id AND a.domain < b.domain),
    bo AS (SELECT a.provider AS side_a, b.provider AS side_b, a.prompt_id FROM pr a JOIN pr b ON a.prompt_id = b.prompt_id AND a.provider < b.provider), nn AS (SELECT side_a, side_b, count(*) prompts FROM bo GROUP BY 1, 2),
    ce AS (SELECT side_a, side_b, prompt_id, edge, max(a) a, max(b) b FROM (SELECT side_a, side_b, bo.prompt_id, edge, 1 AS a, 0 AS b FROM bo JOIN e ON e.provider = side_a AND e.prompt_id = bo.prompt_id UNION ALL SELECT side_a, side_b, bo.prompt_id, edge, 0, 1 FROM bo JOIN e ON e.provider = side_b AND e.prompt_id = bo.prompt_id) GROUP BY 1, 2, 3, 4),
    g AS (SELECT side_a, side_b, edge, CAST(sum(a) AS BIGINT) prompts_a, CAST(sum(b) AS BIGINT) prompts_b, count(*) FILTER (a = 1 AND b = 0) only_a, count(*) FILTER (a = 0 AND b = 1) only_b FROM ce GROUP BY 1, 2, 3),
    q AS (SELECT *, {_P_SIGN.format(g='only_a', l='only_b')} AS p FROM g JOIN nn USING (side_a, side_b)), s AS (SELECT *, least(1, p * (count(*) OVER (PARTITION BY side_a, side_b) - row_number() OVER w + 1)) AS step FROM q WINDOW w AS (PARTITION BY side_a, side_b ORDER BY round(p, 12), edge)),
    i AS (SELECT *, max(step) OVER (PARTITION BY side_a, side_b ORDER BY round(p, 12), edge ROWS UNBOUNDED PRECEDING) AS holm, greatest(0, {_WILSON.format(x='prompts_a', n='prompts', s='-')}) la, least(1, {_WILSON.format(x='prompts_a', n='prompts', s='+')}) ha, greatest(0, {_WILSON.format(x='prompts_b', n='prompts', s='-')}) lb, least(1, {_WILSON.format(x='prompts_b', n='prompts', s='+')}) hb FROM s)
    SELECT side_a, side_b, edge, prompts_a, prompts_b, only_a, only_b, prompts, round(p, 9) AS p, round(holm, 9) AS holm_p, round((prompts_a - prompts_b) / prompts - sqrt((prompts_a / prompts - la) ^ 2 + (hb - prompts_b / prompts) ^ 2), 9) AS lower, round((prompts_a - prompts_b) / prompts + sqrt((ha - prompts_a / prompts) ^ 2 + (prompts_b / prompts - lb) ^ 2), 9) AS upper FROM i"""
