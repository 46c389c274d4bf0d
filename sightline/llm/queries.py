"""Queries of the training-data problems and the SQL they are compared with."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import canonical, canonmap, cooccurrence, leakage, lookalikes, packing, setjoin
from sightline.session import load, materialize, work_path


def _pair_store(spark: SparkSession, sf_dir: str) -> cooccurrence.PairStore:
    """Pair counts and scores of all observations: first deliveries as one batch, then the re-deliveries that came later as changes."""
    rows = load(spark, sf_dir, "answer_observations").select("observation_id", "panel_id", "cited_urls", "received_at")
    items = F.transform("cited_urls", cooccurrence.domain)
    delivery = F.struct("panel_id", "cited_urls")
    by_id = rows.groupBy("observation_id").agg(F.min_by(delivery, "received_at").alias("first"), F.max_by(delivery, "received_at").alias("last"), F.count("*").alias("n"))
    by_id = materialize(by_id, "deliveries")
    store = cooccurrence.PairStore(spark, work_path(spark, "pairs"))
    baskets = lambda which: by_id.select(F.col("observation_id").alias("basket_id"), F.col(f"{which}.panel_id").alias("grp"), F.col(f"{which}.cited_urls").alias("cited_urls")).withColumn("items", items)
    store.apply(baskets("first"))
    store.refresh()
    store.apply(baskets("last").join(by_id.where("n > 1").select(F.col("observation_id").alias("basket_id")), "basket_id", "left_semi"))
    return store


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain pairs cited together three times as often as chance, and published weights that differ from the count."""
    store = _pair_store(spark, sf_dir)
    lift = store.scores(5).where(F.col("n") * F.col("n_all") >= 3 * F.col("n_left") * F.col("n_right")).select(F.col("grp").alias("panel_id"), F.col("left_item").alias("left_domain"), F.col("right_item").alias("right_domain"), F.lit("lift").alias("finding"))
    edges = load(spark, sf_dir, "source_edges").where("panel_id IS NOT NULL AND weight IS NOT NULL").select("panel_id", cooccurrence.bare_domain(F.col("left_domain")).alias("x"), cooccurrence.bare_domain(F.col("right_domain")).alias("y"), "weight")
    edges = edges.where("x <> y").select("panel_id", F.least("x", "y").alias("left_domain"), F.greatest("x", "y").alias("right_domain"), "weight").distinct()
    pairs = store.table("pairs").select(F.col("grp").alias("panel_id"), F.col("left_item").alias("left_domain"), F.col("right_item").alias("right_domain"), "n")
    keys = ["panel_id", "left_domain", "right_domain"]
    wrong = edges.join(pairs, keys, "left").where(F.col("weight") != F.coalesce("n", F.lit(0))).select(*keys, F.lit("weight").alias("finding")).distinct()
    return lift.unionByName(wrong)


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every domain pair of every panel with its counts and association scores."""
    return _pair_store(spark, sf_dir).scores().withColumns({c: F.round(c, 9) for c in ("lift", "jaccard")})


def _prompt_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = load(spark, sf_dir, "answer_observations").where("prompt_id IS NOT NULL").groupBy("prompt_id").agg(F.min("prompt").alias("prompt"))
    return prompts.select(F.col("prompt_id").alias("id"), setjoin.word_set("prompt").alias("tokens"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of prompts whose word sets have a Jaccard similarity of 0.7 or more."""
    pairs, members = setjoin.similar_classes(_prompt_sets(spark, sf_dir), 7, 10)
    return setjoin.expand(pairs, members).select(F.col("id_a").alias("prompt_id_a"), F.col("id_b").alias("prompt_id_b"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose agent means a catalog entry that it doesn't spell."""
    return canonmap.map_rows(load(spark, sf_dir, "crawler_requests"), "request_id", "user_agent", load(spark, sf_dir, "crawler_catalog"), "token")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of three lengths, in steps of about equal size."""
    return packing.pack(load(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the sequences of each length are."""
    return packing.fill_rates(p8_packed(spark, sf_dir))


def _leak_index(spark: SparkSession, sf_dir: str) -> tuple[leakage.PositionalIndex, DataFrame, DataFrame]:
    """An index of all documents over the words of the evaluation items, the items, and their words."""
    items = load(spark, sf_dir, "eval_items")
    item_terms = materialize(leakage.terms(items, "item_id", "text", "item_id"), "item-terms")
    index = leakage.PositionalIndex(spark, work_path(spark, "postings"), item_terms)
    index.add(load(spark, sf_dir, "documents"))
    return index, items, item_terms


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of an evaluation item."""
    index, items, item_terms = _leak_index(spark, sf_dir)
    return leakage.exact_passages(index, items, item_terms=item_terms).select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where ten different words of an evaluation item lie within sixteen consecutive words, in any order."""
    index, items, item_terms = _leak_index(spark, sf_dir)
    return leakage.proximity_matches(index, items, item_terms=item_terms)


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text in its one form."""
    return canonical.canonicalize(load(spark, sf_dir, "documents"), "text", "form").select("doc_id", "form")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same but differ in code points."""
    _, members = canonical.equal_looking(load(spark, sf_dir, "documents"), "doc_id", "text")
    return canonical.equal_looking_pairs(members).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


QUERIES = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p3_found": p3_found, "p7_found": p7_found, "p8_packed": p8_packed, "p8_summary": p8_summary, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found, "p10_forms": p10_forms}
_HOST = r"nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(u)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)', 1), '\.$', ''), '^www\.', ''), '')"
_PAIRS = f"""WITH o AS (SELECT observation_id, arg_max(panel_id, received_at) AS panel_id, arg_max(cited_urls, received_at) AS urls FROM answer_observations WHERE observation_id IS NOT NULL GROUP BY 1), u AS (SELECT observation_id, panel_id, unnest(urls) AS u FROM o WHERE panel_id IS NOT NULL),
    d AS (SELECT DISTINCT observation_id, panel_id, {_HOST} AS d FROM u WHERE {_HOST} IS NOT NULL), n AS (SELECT panel_id, count(*) n FROM o WHERE panel_id IS NOT NULL GROUP BY 1), m AS (SELECT panel_id, d, count(*) n FROM d GROUP BY 1, 2),
    p AS (SELECT a.panel_id, a.d AS x, b.d AS y, count(*) c FROM d a JOIN d b ON a.observation_id = b.observation_id AND a.d < b.d GROUP BY 1, 2, 3)
"""
ORACLES: dict[str, str] = {
    "p1_found": _PAIRS + """, e AS (SELECT DISTINCT panel_id, least(left_domain, right_domain) x, greatest(left_domain, right_domain) y, weight FROM source_edges WHERE weight IS NOT NULL AND left_domain <> right_domain AND panel_id IS NOT NULL)
        SELECT p.panel_id, x AS left_domain, y AS right_domain, 'lift' AS finding FROM p JOIN n USING (panel_id) JOIN m a ON a.panel_id = p.panel_id AND a.d = x JOIN m b ON b.panel_id = p.panel_id AND b.d = y WHERE c >= 5 AND c * n.n >= 3 * a.n * b.n
        UNION ALL SELECT DISTINCT e.panel_id, e.x, e.y, 'weight' FROM e LEFT JOIN p ON p.panel_id = e.panel_id AND p.x = e.x AND p.y = e.y WHERE weight <> coalesce(c, 0)""",
    "p1_pairs": _PAIRS + """SELECT p.panel_id AS grp, x AS left_item, y AS right_item, c AS n, a.n AS n_left, b.n AS n_right, n.n AS n_all, round(c * n.n / (a.n * b.n), 9) AS lift, round(c / (a.n + b.n - c), 9) AS jaccard
        FROM p JOIN n USING (panel_id) JOIN m a ON a.panel_id = p.panel_id AND a.d = x JOIN m b ON b.panel_id = p.panel_id AND b.d = y""",
}




def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _folds() -> tuple[str, str, str]:
    """For the SQL side: letters and signs of another width or script, what they are read as, and the pattern of what is never seen."""
    pairs = {c: r for c, r in lookalikes._SEEN.items() if len(r) == 1 and ord(c) < 0xFFFF and unicodedata.category(c) != "Cn"} | lookalikes._FOLD
    # letters with an accent of their own, over a letter that has a look-alike
    for c in map(chr, range(0x370, 0x530)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0] in lookalikes._FOLD and len(whole := unicodedata.normalize("NFC", lookalikes._FOLD[parts[0]] + parts[1])) == 1:
            pairs[c] = whole
    invisible = "[" + "".join("-".join(f"\\x{{{end}}}" for end in span.split("-")) for span in lookalikes.INVISIBLE.split()) + "]"
    return "".join(pairs), "".join(pairs.values()), invisible


def _plain(text: str) -> str:
    """A text's skeleton in SQL, as far as single characters and the usual ligatures go."""
    source, target, invisible = _folds()
    joined = f"regexp_replace({text}, '{invisible}', '', 'g')"
    for c in "ﬁﬂﬀﬃﬄ":
        joined = f"replace({joined}, '{c}', '{unicodedata.normalize('NFKC', c)}')"
    return f"nfc_normalize(translate({joined}, {_literal(source)}, {_literal(target)}))"


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}\p{{M}}]+')"
ORACLES |= {
    "p3_found": rf"""WITH p AS (SELECT prompt_id, {"lower(nfc_normalize(translate(min(prompt), " + _literal("".join(chr(0xFF01 + i) for i in range(94))) + ", " + _literal("".join(chr(0x21 + i) for i in range(94))) + ")))"} AS t FROM answer_observations WHERE prompt_id IS NOT NULL GROUP BY 1),
        w AS MATERIALIZED (SELECT prompt_id, list_sort(list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}]{{2,}}'))) AS s FROM p WHERE t IS NOT NULL), x AS (SELECT prompt_id, len(s) AS n, unnest(s) AS term FROM w WHERE len(s) > 0),
        c AS (SELECT a.prompt_id AS prompt_id_a, b.prompt_id AS prompt_id_b, any_value(a.n) + any_value(b.n) - count(*) AS u, count(*) AS o FROM x a JOIN x b ON a.term = b.term AND a.prompt_id < b.prompt_id GROUP BY 1, 2) SELECT prompt_id_a, prompt_id_b FROM c WHERE o * 10 >= u * 7""",
    "p9_found": f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_plain("text"))} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(_plain("text"))} AS w FROM eval_items WHERE text IS NOT NULL),
        g AS MATERIALIZED (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS h FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)), e AS (SELECT doc_id, hash(w[k:k + 11]) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)) SELECT DISTINCT doc_id, item_id FROM e JOIN g USING (h)""",
    "p10_found": f"""WITH d AS MATERIALIZED (SELECT doc_id, text, md5({_plain("text")}) AS f FROM documents WHERE text IS NOT NULL) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM d a JOIN d b ON a.f = b.f AND a.doc_id < b.doc_id AND a.text <> b.text""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
