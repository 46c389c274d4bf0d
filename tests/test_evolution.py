"""Period comparisons, site analyses, crawling and resampling on small tables with known answers."""

import ipaddress
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.functions import logs, stats
from sightline.operators import crawl, evolution, logaudit, requests, resampling, robots, site, textsim
from sightline.sources import exports


def test_binomial_tail(spark):
    cases = [(0, 0), (0, 5), (5, 5), (3, 9), (6, 9), (1, 400), (390, 400), (200, 400), (-1, 5), (6, 5)]
    for r in spark.createDataFrame(cases, "k BIGINT, n BIGINT").select("k", "n", stats.binomial_tail(F.col("k"), F.col("n")).alias("p")).collect():
        want = sum(math.comb(r.n, i) for i in range(r.k, r.n + 1)) / 2**r.n if 0 <= r.k <= r.n and r.n else 1.0
        assert r.p == pytest.approx(want, rel=1e-8, abs=1e-300), r


CITED = [  # provider, unit, period, observation, domain
    ("x", "p1", "before", 1, "a"), ("x", "p1", "before", 1, "b"), ("x", "p1", "after", 2, "a"), ("x", "p2", "before", 3, "a"), ("x", "p2", "after", 4, "c"), ("x", "p3", "before", 5, "z"),
    ("y", "p1", "before", 6, "a"), ("y", "p1", "before", 6, "b"), ("y", "p1", "after", 7, "a"), ("y", "p1", "after", 7, "b"), ("y", "p2", "before", 8, "c"), ("y", "p2", "after", 9, "b"), ("y", "p2", "after", 9, "c"),
]


def _cited(spark):
    return spark.createDataFrame(CITED, "provider STRING, unit STRING, period STRING, observation_id INT, domain STRING")


def test_drift_over_matched_units(spark):
    got = {r.provider: r for r in evolution.portfolio_drift(_cited(spark), "period", "before", "after", ["provider"], ["unit"], "domain").collect()}
    x = got["x"]
    assert x.units == 2 and x.gained == 1 and x.lost == 1 and x.mean_divergence == pytest.approx((0.5 * (0.5 * math.log2(0.5 / 0.75) + 0.5 + math.log2(1 / 0.75)) + 1) / 2)
    assert evolution.portfolio_drift(_cited(spark).limit(0), "period", "before", "after", ["provider"], ["unit"], "domain").count() == 0
    own = {r.provider: r for r in evolution.owned_share_change(_cited(spark), F.col("domain") == "a", "period", "before", "after", ["provider"], ["unit"]).collect()}
    assert own["x"].units == 2 and own["x"].mean_change == pytest.approx((0.5 - 1) / 2) and own["x"].without_one_lowest == pytest.approx(-1) and own["x"].without_one_highest == pytest.approx(0.5) and own["x"].rises == own["x"].falls == 1
    gate = evolution.owned_share_gate(evolution.owned_share_change(_cited(spark), F.col("domain") == "a", "period", "before", "after", ["provider"], ["unit"])).first()
    assert tuple(gate) == (0, 0, False, False)


def _states(spark, incomplete=()):
    seen = sorted({c[:4] for c in CITED})
    return spark.createDataFrame([(*c, c[3] not in incomplete) for c in seen], "provider STRING, unit STRING, period STRING, observation_id INT, complete BOOLEAN")


def _edges(side, unit, period):
    own = sorted({c[4] for c in CITED if c[:3] == (side, unit, period)})
    return set(combinations(own, 2))


def test_edges_between_periods_and_sides(spark):
    args = ("period", "before", "after", "provider", ["unit"], "domain")
    changes = {(r.provider, r.left_item, r.right_item): (r.kept, r.gained, r.lost, r.state) for r in evolution.edge_changes(_states(spark), _cited(spark), *args).collect()}
    assert changes == {("x", "a", "b"): (0, 0, 1, "loss"), ("y", "a", "b"): (1, 0, 0, "both"), ("y", "b", "c"): (0, 1, 0, "gain")}
    drift = {(r.left_item, r.right_item): r for r in evolution.edge_drift(_states(spark), _cited(spark), *args, least_support=1, least_units=2).collect()}
    for edge, r in drift.items():
        d = [sum(s * (edge in _edges(p, u, t)) for p, t, s in (("y", "after", 1), ("x", "after", -1), ("y", "before", -1), ("x", "before", 1))) for u in ("p1", "p2")]
        error = math.sqrt(np.var(d, ddof=1) / 2)
        assert r.units == 2 and r.difference == pytest.approx(np.mean(d)) and r.without_one_lowest == min(d) and r.without_one_highest == max(d)
        assert r.lower == pytest.approx(np.mean(d) - stats.Z95 * error) and r.upper == pytest.approx(np.mean(d) + stats.Z95 * error)
    assert set(drift) == {("a", "b"), ("b", "c")}
    # an incomplete list makes its unit unknown on that side
    assert evolution.edge_drift(_states(spark, {1, 4}), _cited(spark), *args, least_support=1).count() == 0


def test_lineage_and_transitions(spark):
    rows = [("a", 1, 1), ("b", 1, 1), ("c", 2, 5), ("d", 2, 6), ("e", 3, 7), ("f", 4, 7), ("g", 8, 8), ("h", 8, 9), ("i", 9, 9), ("j", None, 1)]
    got = {(r.before, r.after): (r.shared, r.change) for r in evolution.lineage(spark.createDataFrame(rows, "k STRING, before INT, after INT"), "before", "after").collect()}
    assert got == {(1, 1): (2, "stable"), (2, 5): (1, "split"), (2, 6): (1, "split"), (3, 7): (1, "merge"), (4, 7): (1, "merge"), (8, 8): (1, "split"), (8, 9): (1, "split-and-merge"), (9, 9): (1, "merge")}
    b = spark.createDataFrame([("m", "matched"), ("l", "matched"), ("u", "a"), ("n", "a"), ("c", "a"), ("d", "b")], "k STRING, join_state STRING")
    a = spark.createDataFrame([("m", "matched"), ("l", "b"), ("u", "a"), ("n", "matched"), ("c", "b"), ("w", "a"), ("v", "matched")], "k STRING, join_state STRING")
    assert {r.k: r.transition for r in evolution.transitions(b, a, "k").collect()} == {"m": "matched-both", "l": "lost-match", "u": "unchanged-unmatched", "n": "newly-matched", "c": "changed-unmatched", "d": "disappeared", "w": "appeared", "v": "newly-matched"}


def test_without_each_and_detection(spark):
    rows = _cited(spark).where("provider = 'y'")
    for r in evolution.without_each(rows, ["provider"], "unit", "domain").collect():
        left = [c[4] for c in CITED if c[0] == "y" and c[1] != r.unit]
        assert r.hhi_without == pytest.approx(sum((left.count(d) / len(left)) ** 2 for d in set(left)))
    got = {(r.domain, r.k): r.chance for r in evolution.detection(_cited(spark), "unit", "domain", [1, 2, 9]).collect()}
    assert got["a", 1] == pytest.approx(2 / 3) and got["a", 2] == pytest.approx(1) and got["z", 2] == pytest.approx(2 / 3) and ("a", 9) not in got


LOG = "token STRING, path STRING, status INT, content_type STRING, duration_ms DOUBLE, received_at TIMESTAMP, client_ip STRING"


def _log(spark, rows):
    return spark.createDataFrame([(t, p, s, "text/html", 10.0, None, None) for t, p, s in rows], LOG)


def test_path_changes(spark):
    before = [("t", "/gone", 200), ("t", "/bad", 200), ("t", "/ok", 404), ("t", "/mix", 200), ("t", "/mix", 301), ("t", "/code", 200), ("t", "/same", 200), (None, "/x", 200), ("t", None, 200)]
    after = [("t", "/new?x=1", 200), ("t", "/bad", 500), ("t", "/ok", 200), ("t", "/mix", 200), ("t", "/code", 204), ("t", "/same", 200), ("t", "/same", 200)]
    got = {r.path: r.change for r in logaudit.path_changes(_log(spark, before), _log(spark, after)).collect()}
    assert got == {"/gone": "baseline-only", "/new": "current-only", "/bad": "failure-emerged", "/ok": "failure-cleared", "/mix": "response-class-shift", "/code": "status-code-set-shift", "/same": "request-share-shift"}


def test_timing_cache_and_pages(spark):
    slow, fast = _log(spark, [("t", "/a", 200)] * 20).withColumn("duration_ms", F.lit(900.0)), _log(spark, [("t", "/a", 200)] * 20 + [("u", "/a", 200)])
    assert {r.token: r.change for r in logaudit.timing_changes(fast, slow).collect()} == {"t": "slower", "u": "not-comparable"}
    rows = spark.createDataFrame([("t", "Hit", "Hit"), ("t", "miss", "Hit"), ("t", "Redirect", None), ("t", "-", "Hit"), ("t", None, None)], "token STRING, a STRING, b STRING")
    profile = logaudit.cache_profile(rows, ["token"], "a", "b")
    assert {(r.result, r.requests, r.differing) for r in profile.collect()} == {("Hit", 1, 0), ("Miss", 1, 1), ("Other", 1, 0)}
    later = logaudit.cache_profile(rows.where("a = 'Hit'"), ["token"], "a", "b")
    assert {r.result: round(r.share_change, 6) for r in logaudit.cache_changes(profile, later, ["token"]).collect()} == {"Hit": 0.666667, "Miss": -0.333333, "Other": -0.333333}
    pages = spark.createDataFrame([("https://a.test/one",), ("https://a.test/two",), ("https://b.test/two",), ("https://a.test/q?x=1",), (None,)], "url STRING")
    found = logaudit.match_pages(_log(spark, [("t", "/one?y=2", 200), ("u", "/one", 404), ("t", "/two", 200), ("t", "/q", 200), ("t", "/none", 200)]), pages)
    assert {r.path: (r.state, r.requests, r.url) for r in found.collect()} == {"/one": ("matched", 2, "https://a.test/one"), "/two": ("ambiguous", 1, None), "/q": ("ambiguous", 1, None), "/none": ("not-audited", 1, None)}
    assert {r.family: r.presence for r in logaudit.match_families(_log(spark, [("t", "/one", 200), ("t", "/z/1", 200)]), pages).collect()} == {"/one": "both", "/two": "right-only", "/q": "right-only", "/z/*": "left-only"}
    named = logaudit.referrals(_log(spark, [("t", "/a?utm_source=X", 200), ("t", "/a?utm_source=x&utm_source=y", 404), ("t", "/a?utm_source=", 200), ("t", "/a", 200)]))
    assert {(r.state, r.source, r.requests) for r in logaudit.referral_profile(named).collect()} == {("single", "x", 1), ("conflicting", None, 1), ("empty", None, 1)}


def test_networks_of_both_kinds(spark):
    addresses = ["192.0.2.1", "192.0.2.200", "::ffff:203.0.113.200", "2001:db8::1", "2001:DB8:1:0:0:0:0:2", "2001:db8:9::", "::", "::1", "1::", "fe80::1%eth0", "999.1.1.1", "x", "", None, "::1.2.3.4", "1:2:3:4:5:6:7:8", "10.0.0.1"]
    networks = ["192.0.2.0/25", "::ffff:203.0.113.128/121", "2001:db8:1::/48", "2001:db8:8::/45", "10.0.0.0/7", "::/127"]
    df = spark.createDataFrame([(a, "clash") for a in addresses], "client_ip STRING, block STRING")
    parsed = [ipaddress.ip_network(n) for n in networks]
    for r in requests.in_networks(df.withColumn("key", requests.address_key(F.col("client_ip"))), requests.network_table(spark, networks)).collect():
        try:
            a = ipaddress.ip_address(r.client_ip or "")
        except ValueError:
            a = None
        if a is None or "%" in r.client_ip:
            assert r.in_range is None and r.key is None, r
            continue
        a = getattr(a, "ipv4_mapped", None) or a
        assert r.key == (f"4{int(a):08x}" if a.version == 4 else f"6{int(a):032x}"), r
        assert r.in_range == (any(a in n for n in parsed if n.version == a.version) or a in ipaddress.ip_network("203.0.113.128/25")), r


PAGES = [
    ("https://a.test/x/one", '<title>One  page</title><link rel="canonical" href="/x/one#f"><link rel=alternate hreflang=DE href="two"><a href="two#t">t</a><a href="//b.test/">b</a><a href="mailto:a@b">m</a><a href="">e</a>'),
    ("https://a.test/x/two", "<title>one page</title><meta name=description content='D'><link rel=canonical href=/x/one><link rel=canonical href=/x/three><link rel=alternate hreflang=en href=/x/one>"),
    ("https://a.test/x/three", "<meta name=description content=d><link rel=alternate hreflang=en href=/x/one><a href=one>1</a><a href=one>1</a>"),
    ("https://a.test/x/four", "<link rel=canonical href=https://else.test/>"), (None, "<title>x</title>"), ("https://a.test/empty", None), ("https://a.test/blank", ""),
]


def test_site_heads(spark):
    heads = site.head_parts(spark.createDataFrame(PAGES, "url STRING, html STRING"))
    assert {(r.kind, r.value, r.pages) for r in site.duplicate_heads(heads).collect()} == {("title", "one page", 2), ("description", "d", 2)}
    states = site.canonical_states(heads)
    assert {r.url[14:]: r.state for r in states.collect()} == {"/x/one": "self", "/x/two": "multiple", "/x/three": "missing", "/x/four": "outside", "/blank": "missing"}
    assert {r.url[14:]: (r.links_out, r.links_in, r.orphan) for r in site.link_profile(heads).collect()}["/x/one"] == (1, 1, False)
    assert {r.url[14:]: (r.links, r.in_batch) for r in site.batch_links(heads).collect()} == {"/x/one": (2, 1), "/x/three": (1, 1), "/x/two": (0, 0), "/x/four": (0, 0), "/blank": (0, 0)}
    assert {(r.url[14:], r.target[14:]) for r in site.one_way_languages(heads).collect()} == {("/x/three", "/x/one")}
    assert site.duplicate_heads(heads.limit(0)).count() == 0 and site.link_profile(heads.limit(0)).count() == 0


def test_crawling(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("a", "b"), (None, "x"), ("d", None), ("q", "r")], "source STRING, target STRING")
    seeds = spark.createDataFrame([("a",), (None,), ("a",)], "url STRING")
    assert {r.url: r.depth for r in crawl.reachable(links, seeds).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.url for r in crawl.reachable(links, seeds, depth=1).collect()} == {"a", "b"} and crawl.reachable(links, seeds.limit(0)).count() == 0
    maps = [
        ("https://a.test/i.xml", "<sitemapindex><sitemap><loc>https://a.test/1.xml</loc></sitemap><!-- <sitemap><loc>https://a.test/no.xml</loc></sitemap> --><sitemap><loc>https://a.test/i2.xml</loc></sitemap><sitemap><loc>https://other.test/2.xml</loc></sitemap></sitemapindex>"),
        ("https://a.test/i2.xml", "<sitemapindex><sitemap><loc>https://a.test/i.xml</loc></sitemap><sitemap><loc>https://a.test/3.xml</loc></sitemap></sitemapindex>"),
        ("https://a.test/1.xml", "<urlset><url><loc><![CDATA[https://a.test/p?a=1&amp;b=2]]></loc><lastmod>2026-01-02</lastmod></url></urlset>"), ("https://a.test/3.xml", "<urlset><url><loc>https://a.test/q</loc></url><url><loc></loc></url></urlset>"),
        ("https://other.test/2.xml", "<urlset><url><loc>https://other.test/z</loc></url></urlset>"), ("https://a.test/bad.xml", None),
    ]
    got = crawl.nested_sitemaps(spark.createDataFrame(maps, "url STRING, xml STRING"), spark.createDataFrame([("https://a.test/i.xml",)], "url STRING"))
    assert {(r.loc, r.lastmod) for r in got.collect()} == {("https://a.test/p?a=1&b=2", "2026-01-02"), ("https://a.test/q", None)}
    urls = spark.createDataFrame([("https://a.test/shop/x", 1), ("https://a.test/ok", 2), (None, 3), ("https://a.test", 4)], "u STRING, path INT")
    assert {r.path for r in crawl.allowed_urls(urls, "u", "bot", robots.rule_table(spark, {"p": "User-agent: *\nDisallow: /shop\n"})).collect()} == {2, 4}


def test_resampling_kinds(spark):
    dense = resampling.mean_interval(np.array([0.5, -0.25, 1.0] + [0.0] * 7), "n", 400)
    assert resampling.sparse_interval(np.array([0.5, -0.25, 1.0]), 10, "n", 400) == pytest.approx(dense)
    assert resampling.sparse_interval(np.array([1.0]), 1, "n") is None and resampling.sparse_interval(np.array([1.0]), 9, "n", 100) is None

    def mulberry(seed, n):
        out, value, m32 = [], seed, 0xFFFFFFFF
        for _ in range(n):
            value = (value + 0x6D2B79F5) & m32
            m = value
            m = ((m ^ (m >> 15)) * (m | 1)) & m32
            m ^= (m + (((m ^ (m >> 7)) * (m | 61)) & m32)) & m32
            out.append(((m ^ (m >> 14)) & m32) / 2**32)
        return out

    assert resampling.mixed_draws(77, 50).tolist() == pytest.approx(mulberry(77, 50))
    assert resampling.nearest_rank(np.array([1.0, 2.0, 3.0, 4.0]), 0.5) == 2.0 and resampling.nearest_rank(np.array([]), 0.5) is None
    rows = _cited(spark)
    for r in resampling.bootstrap_concentration(rows, "provider", "unit", "domain", resamples=60).collect():
        own = [c[4] for c in CITED if c[0] == r.provider]
        assert r.value == pytest.approx(sum((own.count(d) / len(own)) ** 2 for d in set(own))) and r.lower <= r.value <= r.upper
    paired = {r.provider: r for r in resampling.bootstrap_concentration(rows, "provider", "unit", "domain", "period", resamples=60).collect()}
    assert paired["x"].units == 2 and paired["x"].value == pytest.approx(0.5 - (4 + 1) / 9)
    assert resampling.bootstrap_concentration(rows.limit(0), "provider", "unit", "domain").count() == 0 and resampling.bootstrap_strata(spark.createDataFrame([("g", "a", None)], "g STRING, s STRING, v DOUBLE"), "g", "s", "v").count() == 0


def test_mention_rows(spark):
    aliases = spark.createDataFrame([("map", "site map"), ("map", "Sitemap"), ("map", "sitemap"), ("rule", "robots-rule"), ("x", None), (None, "y"), ("z", "--")], "entity STRING, alias STRING")
    texts = spark.createDataFrame([(1, "A site  map, a SITEMAP; sitemaps"), (2, "Robots Rule robots rule!"), (3, ""), (4, None), (5, "map"), (6, "w " * 50_000)], "id INT, t STRING")
    assert {tuple(r) for r in textsim.mention_rows(texts, "id", "t", aliases).collect()} == {(1, "map", 2), (2, "rule", 2)}
    assert textsim.mention_rows(texts, "id", "t", aliases.limit(0)).count() == 0


def test_kinds_of_exports(spark):
    cases = {("url", "query"): "query-page-mapping", ("query",): "grounding-queries", ("citations",): "overview", ("topic", "intent"): "topic-intent-summary", ("intent",): "intent-summary", ("date", "topic"): "time-series"}
    df = spark.createDataFrame([(list(f), k) for f, k in cases.items()] + [(None, None)], "fields ARRAY<STRING>, k STRING")
    assert all(r.k == r.got for r in df.withColumn("got", exports.dataset_kind(F.col("fields"))).collect())
    assert logs.CACHE_RESULTS == ["Hit", "RefreshHit", "Miss", "LimitExceeded", "CapacityExceeded", "Error"]
