"""Operators of the core on small tables with known answers, nulls, ties and empty input."""

import io
import math
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sightline.functions import logs, normalize, stats
from sightline.operators import graph, pages, panel, requests, resampling, robots, tables, textsim
from sightline.sources import files
from sightline.sources.html import parse_page


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_exact_tests(spark):
    def p(g, n):
        tail = sum(math.comb(g + n, i) for i in range(min(g, n) + 1)) / 2 ** (g + n)
        return min(1.0, 2 * tail) if g + n else 1.0

    cases = [(0, 0), (0, 5), (3, 9), (9, 3), (7, 7), (120, 80), (260, 240), (1, 499)]
    df = spark.createDataFrame(cases, "g BIGINT, n BIGINT")
    for r in df.select("g", "n", stats.sign_test_p(F.col("g"), F.col("n")).alias("p"), stats.mcnemar_p(F.col("g"), F.col("n"), 100).alias("m")).collect():
        assert r.p == pytest.approx(p(r.g, r.n), rel=1e-9)
        assert r.m == pytest.approx(p(r.g, r.n), rel=0.05 if r.g + r.n > 100 else 1e-9, abs=1e-6)


def test_intervals(spark):
    r = one(spark, w=stats.wilson(F.lit(5), F.lit(10)), z=stats.wilson(F.lit(0), F.lit(0)), d=stats.newcombe(F.lit(56), F.lit(70), F.lit(48), F.lit(80)), lf=stats.log_factorial(F.lit(171)), r=stats.round_half_up(F.lit(-2.5)))
    assert r.w.lower == pytest.approx(0.236593, abs=1e-6) and r.w.upper == pytest.approx(0.763407, abs=1e-6) and r.z is None
    assert (r.d.lower, r.d.upper) == (pytest.approx(0.0524, abs=1e-4), pytest.approx(0.3339, abs=1e-4))
    assert r.lf == pytest.approx(math.lgamma(172), rel=1e-14) and r.r == -2.0


def test_holm(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, 1.0, 0.03]
    df = spark.createDataFrame([(f"k{i}", p) for i, p in enumerate(ps)], "k STRING, p DOUBLE")
    order = sorted(range(len(ps)), key=lambda i: (ps[i], f"k{i}"))
    want, top = {}, 0.0
    for rank, i in enumerate(order):
        top = max(top, min(1.0, ps[i] * (len(ps) - rank)))
        want[f"k{i}"] = top
    for buckets in (1, 3, 64):
        assert {r.k: r.holm_p for r in panel.holm_adjust(df, "p", "k", buckets=buckets).collect()} == pytest.approx(want)


def test_normal_forms(spark):
    urls = {"HTTPS://A.b:443?x=1#y": "https://a.b/?x=1", "http://a.b:8080/P/": "http://a.b:8080/P/", "ftp://a/b": None, "http://u@a/": None, "": None, None: None}
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    assert {r.u: r.p for r in df.select("u", normalize.page_url(F.col("u")).alias("p")).collect()} == urls
    families = {"/": "/", "/a": "/a", "/a/b?x": "/a/*", "/12345/x": "/:id/*", "/123e4567-e89b-12d3-a456-426614174000": "/:uuid", "//a//b": "/a/*", "https://h/x/y": "/x/*", None: None}
    df = spark.createDataFrame([(u,) for u in families], "u STRING")
    assert {r.u: r.p for r in df.select("u", normalize.path_family(F.col("u")).alias("p")).collect()} == families
    numbers = {"1.234,5": 1234.5, "1,234.5": 1234.5, "1,234": 1234.0, "12,5": 12.5, "12.345.678": 12345678.0, "5 %": 5.0, "-1": None, "": None, "x": None, None: None}
    df = spark.createDataFrame([(u,) for u in numbers], "u STRING")
    assert {r.u: r.p for r in df.select("u", normalize.count_metric(F.col("u")).alias("p")).collect()} == numbers
    shares = {"12,345%": 12.345, "100": 100.0, "100.5": None, None: None}
    df = spark.createDataFrame([(u,) for u in shares], "u STRING")
    assert {r.u: r.p for r in df.select("u", normalize.share_metric(F.col("u")).alias("p")).collect()} == shares
    assert one(spark, x=normalize.compat_label(F.lit("  Ｆｏｏ\tBar "))).x == "foo bar"
    q = lambda t: normalize.query_parameter(F.lit(t), "utm_source")
    got = one(spark, a=q("/x?utm_source=A%20b"), b=q("/x?utm_source=a&UTM_SOURCE=b"), c=q("/x?utm_source="), d=q("/x"))
    assert [(v.state, v.value) for v in got] == [("single", "a b"), ("conflicting", None), ("empty", None), ("none", None)]


def test_request_classes(spark):
    r = one(spark, a=logs.security_action(F.lit("Managed_Challenge")), b=logs.security_action(F.lit("-")), c=logs.cache_result(F.lit("refreshhit")), d=logs.cache_result(F.lit("x")), e=logs.media_type(F.lit("Text/HTML; charset=x")), f=logs.bot_score_group(F.lit(1)),
            g=logs.duration_ms(F.lit(" 1.5 "), 1000), h=logs.duration_ms(F.lit("1e3")), i=logs.crawler_token(F.lit("x FOO-bar/2, foo"), ["foo", "foo-bar"]), j=logs.crawler_token(F.lit("xfoo"), ["foo"]), k=logs.band_name(logs.latency_band(F.lit(50.0))), l=logs.band_name(logs.latency_band(F.lit(9e9))), m=logs.status_class(F.lit(None).cast("int")))
    assert tuple(r) == ("challenge", None, "RefreshHit", "Other", "text/html", "automated", 1500.0, None, "foo-bar", None, "<=50ms", ">5000ms", "other")


def test_address_ranges(spark):
    cidrs = ["10.0.0.0/8", "10.1.0.0/16", "192.0.2.128/25", "0.0.0.0/33", "x", None]
    ranges = spark.createDataFrame([(c,) for c in cidrs], "cidr STRING").select(requests.cidr_range(F.col("cidr")).alias("r")).where("r IS NOT NULL").select("r.lo", "r.hi")
    want = {"10.255.0.1": True, "11.0.0.0": False, "192.0.2.127": False, "192.0.2.128": True, "::1": None, "999.1.1.1": None, None: None}
    got = requests.in_ranges(spark.createDataFrame([(a, 1) for a in want], "client_ip STRING, lo INT"), ranges)
    assert {r.client_ip: r.in_range for r in got.collect()} == want
    assert requests.in_ranges(got.drop("in_range"), ranges.limit(0)).where("in_range").count() == 0


def test_robots(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b$\nDisallow: /*.pdf\n\nUser-agent: fox # comment\nUser-agent: owl\nDisallow:\n\nuser-agent: cat\nDisallow: /\nAllow: /\n"
    rows = [("Fox-Bot", "/a"), ("Dog", "/a/b"), ("Dog", "/a/bc"), ("Dog", "/x.pdf"), ("Dog", "/robots.txt"), ("Dog", "/z"), ("Cat", "/q"), (None, "/a"), ("Dog", None)]
    paths = spark.createDataFrame(rows, "token STRING, path STRING")
    got = {(r.token, r.path): r.allowed for r in robots.replay(paths, paths.where("token IS NOT NULL"), robots.rule_table(spark, {"p": text})).collect()}
    assert got == {("Fox-Bot", "/a"): True, ("Dog", "/a/b"): True, ("Dog", "/a/bc"): False, ("Dog", "/x.pdf"): False, ("Dog", "/robots.txt"): True, ("Dog", "/z"): True, ("Cat", "/q"): True}


def test_comparisons(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", None), (None, 3), ("z", 4)], "k STRING, v INT")
    b = spark.createDataFrame([("x", 3), ("y", 1), (None, 1), ("w", 2)], "k STRING, v INT")
    got = {r.k: (r.baseline, r.current, r.state) for r in tables.compare_metric(a, b, ["k"], "v").collect()}
    assert got == {"x": (3, 3, "unchanged"), "y": (None, 1, "not-comparable"), None: (3, 1, "decreased"), "z": (4, None, "baseline-only"), "w": (None, 2, "current-only")}
    assert {(r.k, r.surplus) for r in tables.multiset_difference(a.select("k"), b.select("k"), ["k"]).collect()} == {("x", 1), ("z", 1)}
    ref = spark.createDataFrame([("x", "q", 1), ("y", "z", 2), ("y", "z", 3), ("v", "w", 4)], "k STRING, alias STRING, v INT")
    rows = spark.createDataFrame([("x", 0), ("y", 0), ("z", 0), ("w", 0), ("n", 0), (None, 0)], "k STRING, v INT")
    assert {(r.k, r.match, r.ref_v) for r in tables.unique_match(rows, ref, "k", "alias").collect()} == {("x", "exact", 1), ("y", "ambiguous", None), ("z", "ambiguous", None), ("w", "fallback", 4), ("n", "none", None), (None, "none", None)}
    assert tables.compare_metric(a.limit(0), b.limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("task", [0, 500_000])
def test_components(spark, task):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (200, 200), (None, 3), (5, None), (300, 301), (301, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT"), "a", "b", task).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a BIGINT, b BIGINT"), "a", "b", task).count() == 0


def test_ranks_agree_however_computed(spark):
    edges = spark.createDataFrame([("g", a, b, w) for a, b, w in (("a", "b", 1.0), ("b", "c", 2.0), ("c", "d", 1.0), ("d", "a", 3.0), ("a", "c", 1.0))] + [("h", "x", "y", 1.0)], "g STRING, a STRING, b STRING, w DOUBLE")
    alone = {(r.g, r.item): r.pagerank for r in graph.pagerank(edges, ["g"], "a", "b", "w").collect()}
    joined = {(r.g, r.item): r.pagerank for r in graph.pagerank(edges, ["g"], "a", "b", "w", tolerance=1e-9, iterations=60, task_edges=0).collect()}
    assert alone == pytest.approx(joined, abs=1e-6) and sum(v for (g, _), v in alone.items() if g == "g") == pytest.approx(1)


def test_communities_and_agreement(spark):
    ring = lambda n: [(f"{n}{i}", f"{n}{j}", 2.0) for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([("g", *e) for e in [*ring("a"), *ring("b"), ("a0", "b0", 0.1)]], "g STRING, x STRING, y STRING, w DOUBLE")
    rows = graph.communities(edges, ["g"], "x", "y", "w").collect()
    assert len({r.community for r in rows}) == 2 and all(r.modularity == pytest.approx(0.4958, abs=1e-3) for r in rows)
    same = spark.createDataFrame([(r.item, r.community, r.item[0]) for r in rows], "item STRING, p STRING, q STRING")
    assert graph.adjusted_rand_index(same, "p", "q").first().adjusted_rand_index == pytest.approx(1.0)


def _observation_table(spark, folder, rows):
    columns = "observation_id STRING, panel_id STRING, prompt_id STRING, prompt STRING, provider STRING, cited_urls ARRAY<STRING>, received_at TIMESTAMP_NTZ, topic STRING, intent STRING, answer_text STRING, citation_list_complete BOOLEAN"
    full = [(f"o{n}", *r, datetime(2026, 2, 1), None, None, None, True) for n, r in enumerate(rows)]
    spark.createDataFrame(full, columns).write.parquet(f"{folder}/answer_observations.parquet")
    return str(folder)


def test_networks_hold_every_edge(spark, tmp_path):
    from sightline.plans import registry

    urls = lambda *hosts: [f"https://{h}.test/" for h in hosts]
    # a and b share one prompt, at such ranks that the edge's strength is under 0.5
    data = _observation_table(spark, tmp_path, [("p", "q1", "x", "m", urls("a", "w", "v", "u", "b")), ("p", "q2", "x", "m", urls("c", "d"))])
    queries, nodes = registry.queries(), {f"{n}.test" for n in "abuvwcd"}
    assert {r.item for r in queries["g2_centrality"](spark, data).collect()} == nodes
    assert {r.item for r in queries["g4_communities"](spark, data).collect()} == nodes
    assert {r.node: r.component for r in queries["g3_components_all"](spark, data).collect()} == {f"p|{n}": "p|a.test" if n[0] in "abuvw" else "p|c.test" for n in nodes}
    for name in ("g1_cocitation", "g7_rank_weighted_edges"):
        edges = {(r.left_item, r.right_item) for r in queries[name](spark, data).collect()}
        assert len(edges) == 11 and {("a.test", "b.test"), ("c.test", "d.test")} < edges


def test_sweep_holds_every_threshold(spark, tmp_path):
    from sightline.plans import registry

    texts = ["alpha beta gamma delta", "alpha beta gamma omega", "alpha beta sigma omega", "kappa lamda", "kappa lamda", "solo words only"]
    data = _observation_table(spark, tmp_path, [("p", f"q{n}", t, "m", None) for n, t in enumerate(texts)])
    df = {w: sum(w in t.split() for t in texts) for t in texts for w in t.split()}
    weigh = lambda t: {w: math.log(1 + len(texts) / df[w]) for w in t.split()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cosine = lambda s, t: sum(x * t.get(w, 0) for w, x in s.items()) / size(s) / size(t)
    want = {}
    for level in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95):
        family = list(range(len(texts)))
        for i in range(len(texts)):
            for j in range(i):
                if cosine(weigh(texts[i]), weigh(texts[j])) >= level:
                    family = [family[j] if f == family[i] else f for f in family]
        sizes = [n for n in (family.count(f) for f in set(family)) if n > 1]
        want[level] = (sum(sizes), len(sizes), max(sizes))
    assert want[0.5] != want[0.65]
    assert {r.threshold: (r.members, r.families, r.largest) for r in registry.queries()["x5_threshold_sweep_all"](spark, data).collect()} == want


def test_bridging_nodes(spark):
    import random

    rng = random.Random(4)
    edges = {(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(38)} | {("x", "y"), ("y", "z")}

    def parts(pairs, gone=None):
        near, seen, count = {}, set(), 0
        for a, b in pairs:
            if a != b and gone not in (a, b):
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        nodes = {n for e in pairs for n in e if n != gone and any(n in f and f[0] != f[1] for f in pairs)}
        for n in nodes:
            if n not in seen:
                count += 1
                todo = [n]
                while todo:
                    m = todo.pop()
                    if m not in seen:
                        seen.add(m)
                        todo += near.get(m, ())
        return count

    proper = [e for e in edges if e[0] != e[1]]
    want = {n for n in {n for e in proper for n in e} if parts(proper, n) > parts(proper)}
    got = graph.bridging_nodes(spark.createDataFrame([*edges, *edges, ("x", None)], "a STRING, b STRING"), "a", "b")
    assert {r.node for r in got.collect()} == want and "y" in want
    assert graph.bridging_nodes(spark.createDataFrame([], "a STRING, b STRING"), "a", "b").count() == 0


def test_canonical_chains(spark):
    pages_ = [("a", "b"), ("b", "c"), ("c", "c"), ("d", None), ("e", "f"), ("f", "e"), ("g", "e"), ("h", "outside"), (None, "a")]
    got = {r.page: (r.final, r.hops, r.state) for r in graph.canonical_targets(spark.createDataFrame(pages_, "p STRING, t STRING"), "p", "t").collect()}
    assert got == {"a": ("c", 2, "chain"), "b": ("c", 1, "chain"), "c": ("c", 0, "self"), "d": ("d", 0, "self"), "e": (None, None, "loop"), "f": (None, None, "loop"), "g": (None, None, "loop"), "h": ("outside", 1, "chain")}


def test_absence_is_unknown_in_incomplete_lists(spark):
    obs = spark.createDataFrame([(1, "g1", "before", True), (2, "g1", "after", True), (3, "g2", "before", True), (4, "g2", "after", False), (5, "g3", "before", True)], "observation_id INT, k STRING, period STRING, complete BOOLEAN")
    rows = spark.createDataFrame([(1, "g1", "before", "x"), (3, "g2", "before", "x"), (2, "g1", "after", "y"), (4, "g2", "after", "y")], "observation_id INT, k STRING, period STRING, domain STRING")
    got = {r.domain: (r.groups, r.gained, r.lost, r.kept, r.unknown) for r in panel.paired_reach(obs, rows, "period", "before", "after", ["k"], "domain").collect()}
    assert got == {"x": (1, 0, 1, 0, 1), "y": (2, 2, 0, 0, 0)}


def test_divergence_against_definition(spark):
    counts = {"p": {"a": 3, "b": 1}, "q": {"b": 2, "c": 2}, "r": {"z": 1}}
    rows = spark.createDataFrame([(s, i, "u", k) for s, c in counts.items() for i, n in c.items() for k in range(n)], "side STRING, item STRING, unit STRING, k INT")

    def js(x, y):
        p, q = ({i: n / sum(c.values()) for i, n in c.items()} for c in (x, y))
        return sum((p.get(i, 0) * math.log2(2 * p[i] / (p[i] + q.get(i, 0))) if i in p else 0) + (q.get(i, 0) * math.log2(2 * q[i] / (q[i] + p.get(i, 0))) if i in q else 0) for i in {*p, *q}) / 2

    for r in panel.balanced_divergence(rows, "side", "item", "unit").collect():
        assert r.pooled_divergence == pytest.approx(js(counts[r.side_a], counts[r.side_b])) == pytest.approx(r.mean_divergence)


def test_rarefaction(spark):
    rows = spark.createDataFrame([("g", u, d) for u, ds in enumerate(["ab", "a", "bc", "a", "d"]) for d in ds], "g STRING, unit INT, item STRING")
    got = {r.k: r.expected_items for r in panel.rarefaction(rows, ["g"], "unit", "item", [1, 2, 5, 9]).collect()}
    want = {k: sum(1 - math.comb(5 - n, k) / math.comb(5, k) for n in (3, 2, 1, 1)) for k in (1, 2, 5)}
    assert got == pytest.approx(want)


def test_bootstrap_is_reproducible(spark):
    state, want = resampling.seed_of("x"), []
    for _ in range(1000):
        state = (state * 1664525 + 1013904223) % 2**32
        want.append(state / 2**32)
    assert resampling.draws(resampling.seed_of("x"), 1000).tolist() == want
    rows = spark.createDataFrame([("g", f"u{k:03}", float(k % 7)) for k in range(50)] + [("g", "n", None), ("e", "n", None), (None, "u", 1.0)], "g STRING, u STRING, v DOUBLE")
    a, b = (resampling.bootstrap_means(d, "g", "u", "v").collect() for d in (rows, rows.repartition(3)))
    assert a == b and len(a) == 1 and a[0].units == 50 and a[0].lower < a[0]["mean"] < a[0].upper


def test_similar_texts_lose_no_pair(spark):
    texts = [f"common words {w} {x} about the net" for w in ("red", "blue", "green") for x in ("fox", "fox dog", "owl")] + ["", None, "the", "the"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, t STRING")
    w = {}
    for r in textsim.tfidf(df, "id", "t").collect():
        w.setdefault(r.id, {})[r.term] = r.weight
    want = {(a, b) for a in w for b in w if a < b and sum(v * w[b].get(t, 0) for t, v in w[a].items()) >= 0.7}
    assert {(r.a, r.b) for r in textsim.similar_texts(df, "id", "t", 0.7).collect()} == want and want


def test_mentions_and_reading_ease(spark):
    r = one(spark, a=textsim.mentions(F.lit("Site map, sitemaps and SITEMAP."), ["sitemap", "site map"]), b=textsim.reading_ease(F.lit("")), c=textsim.reading_ease(F.lit("The cat sat on the mat.")))
    assert r.a == 2 and r.b is None and r.c > 100


HTML = """<!doctype html><html lang="en"><head><title>A title that is long enough to pass ok</title><meta name="viewport" content="width=device-width, initial-scale=1"><meta name="Description" content="x">
<link rel="canonical" href="https://a.test/p"><script type="application/ld+json">{"@type": "Article"}</script><script>var s = "</p> eval(1)";</script></head>
<body><h1>One</h1><h3>Jump</h3><p>First<p>Second <a href="/x#y">link</a><a href="https://b.test/" target="_blank"></a><img src="http://c.test/i.png"><img src="j.png" alt="ok"></body>"""


def test_page_parts():
    page = parse_page(HTML)
    assert page["title"].startswith("A title") and page["lang"] == "en" and page["meta"]["description"] == "x" and page["headings"] == [(1, "One"), (3, "Jump")]
    assert page["paragraphs"] == ["First", "Second link ok"] and [a[0] for a in page["links"]] == ["/x#y", "https://b.test/"] and page["images"] == [("http://c.test/i.png", None), ("j.png", "ok")]
    assert "eval(1)" in page["scripts"] and "eval" not in page["text"] and page["jsonld"] == ['{"@type": "Article"}']
    assert parse_page("")["title"] is None and parse_page("<p>" * 20_000)["html_length"] == 60_000


def test_page_rules_and_scores(spark):
    df = spark.createDataFrame([("https://a.test/p", HTML, 1), ("https://a.test/q", None, 2), (None, "<p>x", 3)], "url STRING, html STRING, rule INT")
    checks = pages.check_pages(df, ["url"])
    got = {r.rule: r.passed for r in checks.where("url = 'https://a.test/p'").collect()}
    assert got["title-length-valid"] and got["canonical-url-exists"] and got["h1-count-valid"] and got["mobile-viewport-configured"] and got["https-enabled"] and got["json-ld-present"]
    assert not any(got[r] for r in ("heading-hierarchy-valid", "images-have-alt", "mixed-content-check", "meta-description-length-valid", "suspicious-scripts-absent", "external-links-secure", "link-structure-valid"))
    assert {r.url for r in checks.collect()} == {"https://a.test/p", None}
    score = {r.url: r.score for r in pages.scores(checks, ["url"]).collect()}
    assert 0 < score["https://a.test/p"] < 100
    off = spark.createDataFrame([("images-have-alt", False, None), ("h1-count-valid", True, "info")], "rule STRING, enabled BOOLEAN, severity STRING")
    tuned = {r.rule: r.severity for r in pages.check_pages(df, ["url"], off).where("url = 'https://a.test/p'").collect()}
    assert "images-have-alt" not in tuned and tuned["h1-count-valid"] == "info"
    lifts = pages.score_lifts(checks, ["url"]).where("url = 'https://a.test/p'").collect()
    assert {r.rule for r in lifts} == {k for k, v in got.items() if v is False} and all(r.lift >= 0 for r in lifts)
    assert pages.compare_runs(checks, checks, ["url"]).count() == 0
    assert {tuple(r) for r in pages.page_links(df).collect()} == {("https://a.test/p", "https://a.test/x"), ("https://a.test/p", "https://b.test/")}
    assert len(files.junit_cases(checks).collect()) > 20 and '"ruleId":"headings/heading-hierarchy-valid"' in "".join(r.value for r in files.sarif_results(checks).collect())


def test_sitemaps(spark):
    xml = "<urlset><!-- <url><loc>no</loc></url> --><url><loc> https://a.test/?a=1&amp;b=2 </loc><lastmod>2026-01-02</lastmod></url><url><loc><![CDATA[https://a.test/x]]></loc></url></urlset>"
    df = spark.createDataFrame([("m", xml), ("n", None), ("o", "")], "loc STRING, xml STRING")
    entries = files.sitemap_entries(df, "xml")
    assert {(r.loc, r.lastmod) for r in entries.collect()} == {("https://a.test/?a=1&b=2", "2026-01-02"), ("https://a.test/x", None)}
    crawls = spark.createDataFrame([("https://a.test/?a=1&b=2", datetime(2026, 1, 1, 12))], "loc STRING, crawled TIMESTAMP")
    assert {(r.loc, r.state) for r in files.recrawl_coverage(entries, crawls).collect()} == {("https://a.test/?a=1&b=2", "not-crawled-since"), ("https://a.test/x", "never-crawled")}


def test_workbooks_history_csv(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>1.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"no zip")
    rows = {r.file.rpartition("/")[2]: (r.sheet, r.row_no, r.cells, r.error is not None) for r in files.read_workbooks(spark, f"file://{tmp_path}").collect()}
    assert rows == {"a.xlsx": ("S", 2, ["head", None, "1.5"], False), "b.xlsx": (None, None, None, True)}
    runs = spark.createDataFrame([("u", datetime(2026, 1, 1), 90, 10, 1)], "url STRING, run_at TIMESTAMP, score INT, rules INT, failed INT")
    for _ in range(2):
        files.append_history(runs, f"file://{tmp_path}/history")
    assert files.read_history(spark, f"file://{tmp_path}/history").count() == 2
    files.write_safe_csv(spark.createDataFrame([("=1+1", 2), (None, -3)], "a STRING, b INT").coalesce(1), f"file://{tmp_path}/csv")
    assert {tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/csv").collect()} == {("'=1+1", "2"), (None, "-3")}


def test_streams_match_batches(spark, data):
    from sightline.streaming import activity

    stream = activity.read_stream(spark, data, "crawler_requests").withColumn("received_at", F.col("received_at").cast("timestamp"))
    got = activity.run_complete(activity.daily_windows(stream), "test-days")
    batch = spark.read.parquet(f"{data}/crawler_requests.parquet").withColumn("received_at", F.col("received_at").cast("timestamp"))
    want = activity.daily_windows(batch)
    assert {(r.w.start, r.status_class, r.requests) for r in got.collect()} == {(r.w.start, r.status_class, r.requests) for r in want.collect()}
