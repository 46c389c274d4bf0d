"""Search-export queries over bing_rows, and text and page queries over documents and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions.normalize import host, label, page_url, path_family
from sightline.functions.text import formula_safe
from sightline.operators import pages, tables, textsim
from sightline.operators.requests import latest_requests, top_per_group
from sightline.session import load, materialize


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported rows once each, with normal labels and page; ISO days only have a month."""
    rows = load(spark, sf_dir, "bing_rows").where("row_id IS NOT NULL").dropDuplicates(["row_id"])
    day = F.when(F.col("export_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col("export_date"))
    return rows.select("row_id", "export_id", "property_id", page_url(F.col("url")).alias("page"), label(F.col("query_text")).alias("query"), day.alias("day"), "citations", "cited_pages", "citation_share", label(F.col("intent")).alias("intent"), label(F.col("topic")).alias("topic"))


def _halves(rows):
    return rows.where("day < '2026-06-01'"), rows.where("day >= '2026-06-01'")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def a9_export_summary(spark, sf_dir):
    """Sums and mean share by property; a metric without any value stays null."""
    return _rounded(_rows(spark, sf_dir).groupBy("property_id").agg(
        F.count("*").alias("row_count"), F.sum("citations").alias("citations"), F.sum("cited_pages").alias("cited_pages"), F.avg("citation_share").alias("mean_share"),
        F.countDistinct("page").alias("pages"), F.countDistinct("query").alias("queries"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    ), "mean_share")


def a9_top_queries(spark, sf_dir):
    sums = _rows(spark, sf_dir).where("query IS NOT NULL").groupBy("property_id", "query").agg(F.sum("citations").alias("citations")).where("citations IS NOT NULL")
    return top_per_group(sums, ["property_id"], [F.desc("citations"), F.asc("query")], 20)


def a9_first_to_last(spark, sf_dir):
    return tables.ends(_rows(spark, sf_dir), ["property_id"], "day", "citations")


def a10_query_concentration(spark, sf_dir):
    return _rounded(tables.herfindahl(_rows(spark, sf_dir).where("query IS NOT NULL AND page IS NOT NULL"), ["query"], "page", "citations"), "hhi", "effective_items", "largest_share")


def a12_topic_intent(spark, sf_dir):
    return _rows(spark, sf_dir).where("topic IS NOT NULL AND intent IS NOT NULL").groupBy("topic", "intent").agg(F.count("*").alias("row_count"), F.sum("citations").alias("citations"), F.countDistinct("query").alias("queries"))


def a12_query_turnover(spark, sf_dir):
    """Queries gained, lost and kept by topic and intent between two periods."""
    rows = _rows(spark, sf_dir).where("query IS NOT NULL AND topic IS NOT NULL AND intent IS NOT NULL")
    b, c = (h.select("topic", "intent", "query").distinct() for h in _halves(rows))
    both = tables.full_outer(b, c, ["topic", "intent", "query"])
    return both.groupBy("topic", "intent").agg(F.count_if(F.col("presence") == "right-only").alias("gained"), F.count_if(F.col("presence") == "left-only").alias("lost"), F.count_if(F.col("presence") == "both").alias("kept"))


def j1_page_periods(spark, sf_dir):
    b, c = _halves(_rows(spark, sf_dir).where("page IS NOT NULL"))
    return tables.compare_metric(b, c, ["page"], "citations")


def j2_dimension_periods(spark, sf_dir):
    """Null-safe: rows without a topic or intent are compared with such rows."""
    b, c = _halves(_rows(spark, sf_dir))
    return tables.compare_metric(b, c, ["property_id", "topic", "intent"], "citations")


def a11_mapping_periods(spark, sf_dir):
    b, c = _halves(_rows(spark, sf_dir).where("query IS NOT NULL AND page IS NOT NULL"))
    return tables.compare_metric(b, c, ["query", "page"], "citations")


def j3_platform_matrix(spark, sf_dir):
    """Hosts cited in answers against hosts in exports, with shares of each platform's total."""
    rows = _rows(spark, sf_dir)
    exported = rows.where("citations IS NOT NULL").groupBy(host(F.col("page")).alias("host")).agg(F.sum("citations").alias("citations")).where("host IS NOT NULL")
    obs = latest_requests(load(spark, sf_dir, "answer_observations"), "observation_id")
    cited = obs.select(F.explode("cited_urls").alias("u")).groupBy(host(F.col("u")).alias("host")).agg(F.count("*").alias("citations")).where("host IS NOT NULL")
    share = lambda d: d.join(F.broadcast(d.agg(F.sum("citations").alias("_t")))).withColumn("share", F.round(F.col("citations") / F.col("_t"), 9)).drop("_t")
    return tables.full_outer(share(exported), share(cited), ["host"], ("_exported", "_answered"))


def j6_page_correlation(spark, sf_dir):
    """Exported pages against documents by page address: exact, ambiguous where several documents share it, or none."""
    rows = _rows(spark, sf_dir).where("page IS NOT NULL").groupBy("page").agg(F.sum("citations").alias("citations"))
    docs = load(spark, sf_dir, "documents").select(page_url(F.col("page_url")).alias("page"), F.col("doc_id").alias("id"))
    return tables.unique_match(rows, docs, "page").groupBy("match").agg(F.count("*").alias("pages"), F.sum("citations").alias("citations"))


def j15_multiset(spark, sf_dir):
    """Labels that the later period has more often than the earlier."""
    b, c = _halves(_rows(spark, sf_dir))
    return tables.multiset_difference(c, b, ["topic", "intent"])


def j16_competitors(spark, sf_dir):
    """Queries that other properties have and the first property lacks, with how many of them have it."""
    rows = _rows(spark, sf_dir).where("query IS NOT NULL")
    first = rows.agg(F.min("property_id").alias("p"))
    marked = rows.join(F.broadcast(first)).withColumn("own", F.col("property_id") == F.col("p"))
    return tables.against_competitors(marked.where("own"), marked.where("NOT own"), "query", "property_id")


def a13_page_families(spark, sf_dir):
    rows = _rows(spark, sf_dir).where("page IS NOT NULL")
    return rows.groupBy(F.concat(F.lit("https://"), host(F.col("page"))).alias("origin"), path_family(F.col("page"), 1).alias("family")).agg(F.sum("citations").alias("citations"), F.countDistinct("page").alias("pages"))


def s21_safe_cells(spark, sf_dir):
    return _rows(spark, sf_dir).select("row_id", formula_safe(F.concat(F.when(F.col("row_id") % 3 == 0, "=").otherwise(""), F.coalesce("query", F.lit("")))).alias("cell"))


def a17_duplicate_texts(spark, sf_dir):
    return tables.duplicates(load(spark, sf_dir, "documents"), textsim.fingerprint(F.col("text")), "doc_id")


def a15_language_coverage(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("language", F.regexp_replace(F.lower(F.trim("lang")), "_", "-"))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.count("language").alias("with_language"), F.countDistinct("language").alias("languages"), F.count_if(F.length("text") >= 1000).alias("long_documents"))


def x1_similar_prompts(spark, sf_dir):
    return _rounded(_similar(spark, sf_dir), "cosine")


def _similar(spark, sf_dir, least=0.65):
    prompts = load(spark, sf_dir, "answer_observations").where("prompt_id IS NOT NULL").groupBy("prompt_id").agg(F.min("prompt").alias("prompt"))
    return textsim.similar_texts(prompts, "prompt_id", "prompt", least)


def x3_prompt_families(spark, sf_dir):
    return _rounded(textsim.families(materialize(_similar(spark, sf_dir), "similar-prompts"), 0.85), "density", "min_cosine", "mean_cosine", "max_cosine")


def x9_shingle_coverage(spark, sf_dir):
    """How much of each document's wording the document with the next id repeats, by source."""
    docs = load(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "source", "text")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("following"))
    return _rounded(textsim.shingle_coverage(docs.join(following, "doc_id"), "text", "following").groupBy("source").agg(F.sum("shingles").alias("shingles"), F.sum("shared").alias("shared"), F.avg("coverage").alias("coverage")), "coverage")


def a1_page_scores(spark, sf_dir):
    """Severity-weighted score of each page by the address and text rules that documents can be held to."""
    docs = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.col("page_url").alias("url"), "text")
    return pages.scores(pages.check_addresses(docs, "doc_id"), ["doc_id"])


def a2_failing_rules(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.col("page_url").alias("url"), "text")
    return pages.check_addresses(docs, "doc_id").groupBy("category", "rule").agg(F.count("*").alias("pages"), F.count_if(~F.col("passed")).alias("failed"))


_LABEL = r"nullif(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '')"
_PAGE = r"""CASE WHEN regexp_matches(trim({0}), '^(?i)https?://[^/?#@]+([/?#]|$)') THEN lower(regexp_extract(trim({0}), '^(?i)(https?)://', 1)) || '://' || regexp_replace(lower(regexp_extract(trim({0}), '^(?i)https?://([^/?#]+)', 1)),
    CASE WHEN lower(trim({0})) LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') || CASE WHEN regexp_extract(trim({0}), '^(?i)https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(trim({0}), '^(?i)https?://[^/?#]+([^?#]*)', 1) END || regexp_extract(trim({0}), '^[^?#]*(\?[^#]*)', 1) END"""
_HOST = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim({0})), '^https?://(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)', 1), '\.$', ''), '^www\.', ''), '')"
_CTE = f"""WITH r AS (SELECT row_id, any_value(export_id) export_id, any_value(property_id) property_id, any_value({_PAGE.format("url")}) page, any_value({_LABEL.format("query_text")}) AS query, any_value(CASE WHEN regexp_matches(export_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN export_date END) AS day,
    any_value(citations) citations, any_value(cited_pages) cited_pages, any_value(citation_share) citation_share, any_value({_LABEL.format("intent")}) intent, any_value({_LABEL.format("topic")}) topic FROM bing_rows WHERE row_id IS NOT NULL GROUP BY row_id)
"""


def _periods(keys: list[str], where: str = "TRUE") -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"b.{x} IS NOT DISTINCT FROM c.{x}" for x in keys)
    pick = ", ".join(f"coalesce(b.{x}, c.{x}) AS {x}" for x in keys)
    half = lambda op: f"(SELECT {k}, CAST(sum(citations) AS BIGINT) v, true AS here FROM r WHERE {where} AND day {op} '2026-06-01' GROUP BY ALL)"
    return _CTE + f"""SELECT {pick}, b.v AS baseline, c.v AS current, c.v - b.v AS delta, CASE WHEN b.here IS NULL THEN 'current-only' WHEN c.here IS NULL THEN 'baseline-only' WHEN c.v > b.v THEN 'increased' WHEN c.v < b.v THEN 'decreased' WHEN c.v = b.v THEN 'unchanged'
        ELSE 'not-comparable' END AS state FROM {half("<")} b FULL JOIN {half(">=")} c ON {on}"""


QUERIES = {
    f.__name__: f
    for f in (a9_export_summary, a9_top_queries, a9_first_to_last, a10_query_concentration, a12_topic_intent, a12_query_turnover, j1_page_periods, j2_dimension_periods, a11_mapping_periods, j3_platform_matrix, j6_page_correlation, j15_multiset, j16_competitors, a13_page_families, s21_safe_cells,
              a17_duplicate_texts, a15_language_coverage, x1_similar_prompts, x3_prompt_families, x9_shingle_coverage, a1_page_scores, a2_failing_rules)
}
_SEG = "list_filter(string_split(regexp_replace(regexp_replace(page, '^https?://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"
_TFIDF = r"""WITH p AS (SELECT prompt_id, min(prompt) AS prompt FROM answer_observations WHERE prompt_id IS NOT NULL GROUP BY 1), w AS (SELECT prompt_id, term, count(*) tf FROM (SELECT prompt_id, unnest(regexp_extract_all(lower(prompt), '[\p{L}\p{N}]{2,}')) AS term FROM p) GROUP BY 1, 2),
    d AS (SELECT term, count(*) df FROM w GROUP BY 1), x AS (SELECT prompt_id, term, (1 + ln(tf)) * ln(1 + (SELECT count(DISTINCT prompt_id) FROM w) / df) AS v FROM w JOIN d USING (term)), y AS (SELECT prompt_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY prompt_id)) AS u FROM x),
    s AS (SELECT a.prompt_id AS a, b.prompt_id AS b, sum(a.u * b.u) AS cosine FROM y a JOIN y b USING (term) WHERE a.prompt_id < b.prompt_id GROUP BY 1, 2 HAVING sum(a.u * b.u) >= 0.65)"""
ORACLES = {
    "a9_export_summary": _CTE + "SELECT property_id, count(*) row_count, CAST(sum(citations) AS BIGINT) citations, CAST(sum(cited_pages) AS BIGINT) cited_pages, round(avg(citation_share), 9) mean_share, count(DISTINCT page) pages, count(DISTINCT query) queries, min(day) first_day, max(day) last_day FROM r GROUP BY 1",
    "a9_top_queries": _CTE + "SELECT *, group_rows > 20 AS truncated FROM (SELECT *, CAST(row_number() OVER (PARTITION BY property_id ORDER BY citations DESC, query) AS INTEGER) AS rank, count(*) OVER (PARTITION BY property_id) AS group_rows FROM (SELECT property_id, query, CAST(sum(citations) AS BIGINT) citations FROM r WHERE query IS NOT NULL GROUP BY 1, 2 HAVING sum(citations) IS NOT NULL)) WHERE rank <= 20",
    "a9_first_to_last": _CTE + ", d AS (SELECT property_id, day, CAST(sum(citations) AS BIGINT) v FROM r WHERE day IS NOT NULL AND citations IS NOT NULL GROUP BY 1, 2) SELECT property_id, count(*) points, arg_min(v, day) first_value, arg_max(v, day) last_value, arg_max(v, day) - arg_min(v, day) AS change FROM d GROUP BY 1",
    "a10_query_concentration": _CTE + ", s AS (SELECT query, page, sum(citations) v FROM r WHERE query IS NOT NULL AND page IS NOT NULL AND citations IS NOT NULL GROUP BY 1, 2) SELECT query, count(*) items, CAST(sum(v) AS BIGINT) total, round(sum(v * v) / sum(v) ^ 2, 9) hhi, round(1 / (sum(v * v) / sum(v) ^ 2), 9) effective_items, round(max(v) / sum(v), 9) largest_share FROM s GROUP BY 1 HAVING sum(v) > 0",
    "a12_topic_intent": _CTE + "SELECT topic, intent, count(*) row_count, CAST(sum(citations) AS BIGINT) citations, count(DISTINCT query) queries FROM r WHERE topic IS NOT NULL AND intent IS NOT NULL GROUP BY 1, 2",
    "a12_query_turnover": _CTE + ", h AS (SELECT topic, intent, query, bool_or(day < '2026-06-01') b, bool_or(day >= '2026-06-01') c FROM r WHERE query IS NOT NULL AND topic IS NOT NULL AND intent IS NOT NULL AND day IS NOT NULL GROUP BY ALL) SELECT topic, intent, count(*) FILTER (c AND NOT b) gained, count(*) FILTER (b AND NOT c) lost, count(*) FILTER (b AND c) kept FROM h GROUP BY 1, 2",
    "j1_page_periods": _periods(["page"], "page IS NOT NULL"),
    "j2_dimension_periods": _periods(["property_id", "topic", "intent"]),
    "a11_mapping_periods": _periods(["query", "page"], "query IS NOT NULL AND page IS NOT NULL"),
    "j3_platform_matrix": _CTE + f""", e AS (SELECT {_HOST.format("page")} AS host, CAST(sum(citations) AS BIGINT) n FROM r WHERE citations IS NOT NULL GROUP BY 1 HAVING host IS NOT NULL), o AS (SELECT observation_id, any_value(cited_urls) u FROM answer_observations WHERE observation_id IS NOT NULL GROUP BY 1), a AS (SELECT {_HOST.format("x")} AS host, count(*) n FROM (SELECT unnest(u) AS x FROM o) GROUP BY 1 HAVING host IS NOT NULL)
        SELECT coalesce(e.host, a.host) AS host, e.n AS citations_exported, round(e.n / (SELECT sum(n) FROM e), 9) AS share_exported, a.n AS citations_answered, round(a.n / (SELECT sum(n) FROM a), 9) AS share_answered, CASE WHEN e.host IS NOT NULL AND a.host IS NOT NULL THEN 'both' WHEN e.host IS NOT NULL THEN 'left-only' ELSE 'right-only' END AS presence FROM e FULL JOIN a ON e.host = a.host""",
    "j6_page_correlation": _CTE + f", d AS (SELECT {_PAGE.format('page_url')} AS page, count(*) n FROM documents GROUP BY 1), x AS (SELECT page, CAST(sum(citations) AS BIGINT) c FROM r WHERE page IS NOT NULL GROUP BY 1) SELECT CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS match, count(*) pages, CAST(sum(c) AS BIGINT) citations FROM x LEFT JOIN d USING (page) GROUP BY 1",
    "j15_multiset": _CTE + "SELECT topic, intent, count(*) FILTER (day >= '2026-06-01') - count(*) FILTER (day < '2026-06-01') AS surplus FROM r WHERE day IS NOT NULL GROUP BY 1, 2 HAVING surplus > 0",
    "j16_competitors": _CTE + "SELECT query, count(DISTINCT property_id) competitors FROM r WHERE query IS NOT NULL AND property_id <> (SELECT min(property_id) FROM r WHERE query IS NOT NULL) AND query NOT IN (SELECT query FROM r WHERE query IS NOT NULL AND property_id = (SELECT min(property_id) FROM r WHERE query IS NOT NULL)) GROUP BY 1",
    "a13_page_families": _CTE + f", f AS (SELECT *, 'https://' || {_HOST.format('page')} AS origin, {_SEG} AS s FROM r WHERE page IS NOT NULL) SELECT origin, CASE WHEN len(s) = 0 THEN '/' ELSE '/' || CASE WHEN regexp_matches(s[1], '^([0-9]{{5,}}|[0-9a-fA-F]{{16,}})$') THEN ':id' ELSE s[1] END || CASE WHEN len(s) > 1 THEN '/*' ELSE '' END END AS family, CAST(sum(citations) AS BIGINT) citations, count(DISTINCT page) pages FROM f GROUP BY 1, 2",
    "s21_safe_cells": _CTE + ", c AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN '=' ELSE '' END || coalesce(query, '') AS x FROM r) SELECT row_id, CASE WHEN regexp_matches(x, '^\\s*[=+@-]') THEN '''' || x ELSE x END AS cell FROM c",
    "a17_duplicate_texts": "SELECT sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS key, count(*) AS rows, min(doc_id) first_doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "a15_language_coverage": "SELECT source, count(*) documents, count(lang) with_language, count(DISTINCT replace(lower(trim(lang)), '_', '-')) languages, count(*) FILTER (length(text) >= 1000) long_documents FROM documents GROUP BY 1",
    "x1_similar_prompts": _TFIDF + " SELECT a, b, round(cosine, 9) AS cosine FROM s",
    "x3_prompt_families": _TFIDF.replace("WITH p AS", "WITH RECURSIVE p AS", 1) + """, e AS (SELECT * FROM s WHERE cosine >= 0.85), z AS (SELECT a, b FROM e UNION SELECT b, a FROM e), q AS (SELECT a, a AS b FROM z UNION SELECT q.a, z.b FROM q JOIN z ON z.a = q.b), m AS (SELECT a AS node, min(b) AS family FROM q GROUP BY 1)
        SELECT family, any_value(members) members, count(*) pairs, round(min(cosine), 9) min_cosine, round(avg(cosine), 9) mean_cosine, round(max(cosine), 9) max_cosine, round(count(*) / (any_value(members) * (any_value(members) - 1) / 2), 9) density FROM e JOIN m ON e.a = m.node JOIN (SELECT family, count(*) members FROM m GROUP BY 1) USING (family) GROUP BY family""",
    "x9_shingle_coverage": r"""WITH w AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}''_-]*') AS w FROM documents WHERE length(text) > 0), s AS (SELECT doc_id, source, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w),
        p AS (SELECT a.source, len(a.s) AS shingles, len(list_intersect(a.s, b.s)) AS shared FROM s a JOIN s b ON b.doc_id = a.doc_id + 1) SELECT source, CAST(sum(shingles) AS BIGINT) shingles, CAST(sum(shared) AS BIGINT) shared, round(avg(CASE WHEN shingles > 0 THEN shared / shingles END), 9) AS coverage FROM p GROUP BY 1""",
    "a1_page_scores": pages.oracle() + " SELECT doc_id, count(passed) rules, count(*) FILTER (NOT passed) failed, CAST(floor(100 * sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight) FILTER (passed IS NOT NULL) + 0.5) AS BIGINT) score FROM checks GROUP BY 1",
    "a2_failing_rules": pages.oracle() + " SELECT category, rule, count(*) pages, count(*) FILTER (NOT passed) failed FROM checks GROUP BY 1, 2",
}
