"""Training-data operators against brute force and on awkward input."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import canonical, canonmap, cooccurrence, leakage, lookalikes, packing, setjoin
from sightline.session import work_path

# pairs


def _brute_pairs(baskets):
    pairs, items, groups = Counter(), Counter(), Counter()
    for g, content in baskets.values():
        groups[g] += 1
        own = sorted({x for x in content or [] if x is not None})
        items.update((g, x) for x in own)
        pairs.update((g, a, b) for a, b in combinations(own, 2))
    return pairs, items, groups


def test_pair_counts_follow_changes(spark):
    rng = random.Random(5)
    store = cooccurrence.PairStore(spark, work_path(spark, "test-pairs"), buckets=3)
    state: dict = {}
    for size in (40, 12, 5):
        batch = {f"b{rng.randrange(50)}": (rng.choice("gh"), rng.choice([None, [], [rng.choice("abcdef") for _ in range(rng.randrange(6))] + [None]])) for _ in range(size)}
        rows = [(k, g, c, "clash") for k, (g, c) in batch.items()]
        store.apply(spark.createDataFrame(rows + rows[:2] + [(None, "g", ["a"], "x"), ("z", None, ["a"], "x")], "basket_id STRING, grp STRING, items ARRAY<STRING>, n STRING"))
        state |= batch
    pairs, items, groups = _brute_pairs(state)
    assert {(r.grp, r.left_item, r.right_item): r.n for r in store.table("pairs").collect()} == dict(pairs)
    assert {(r.grp, r.item): r.n for r in store.table("items").collect()} == dict(items)
    assert {r.grp: r.n for r in store.table("groups").collect()} == dict(groups)
    for r in store.scores(2).collect():
        assert r.lift == pytest.approx(r.n * groups[r.grp] / (items[r.grp, r.left_item] * items[r.grp, r.right_item])) and r.n >= 2
    store.apply(spark.createDataFrame([], "basket_id STRING, grp STRING, items ARRAY<STRING>"))
    assert store.table("pairs").count() == len(pairs)


def test_pair_store_survives_failures_and_other_bucket_numbers(spark, monkeypatch):
    path, schema = work_path(spark, "test-pairs"), "basket_id STRING, grp STRING, items ARRAY<STRING>"
    store = cooccurrence.PairStore(spark, path, buckets=3)
    store.apply(spark.createDataFrame([(f"b{k}", "g", ["a", "b", f"x{k}"]) for k in range(20)], schema))
    monkeypatch.setattr(store, "_publish", lambda manifest: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.apply(spark.createDataFrame([("b0", "g", ["a"])], schema))
    again = cooccurrence.PairStore(spark, path, buckets=7)
    assert again.buckets == 3 and {r.n for r in again.table("pairs").where("left_item = 'a' AND right_item = 'b'").collect()} == {20}
    before = {tuple(r)[:4]: r.lift for r in again.scores().collect()}
    again.apply(spark.createDataFrame([(f"b{k}", "g", ["a", "c"]) for k in range(5)], schema))
    assert {(r.left_item, r.right_item): r.n for r in again.table("pairs").collect() if not r.right_item.startswith("x")} == {("a", "b"): 15, ("a", "c"): 5}
    fresh = cooccurrence.PairStore(spark, work_path(spark, "test-pairs"))
    fresh.apply(again.table("baskets"))
    assert sorted(map(tuple, again.scores().collect())) == sorted(map(tuple, fresh.scores().collect())) and len(before) == 41
    again.compact()
    again.vacuum()
    assert sorted(map(tuple, again.scores().collect())) == sorted(map(tuple, fresh.scores().collect()))


def test_large_baskets(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "PIECE", 3)
    store = cooccurrence.PairStore(spark, work_path(spark, "test-pairs"), buckets=2, compact_after=1)
    baskets = {"a": ("g", [f"i{k}" for k in range(11)]), "b": ("g", ["i1", "i9", "i5", "i2"]), "c": ("h", ["z"])}
    for part in (["a", "b"], ["c"]):
        store.apply(spark.createDataFrame([(k, *baskets[k]) for k in part], "basket_id STRING, grp STRING, items ARRAY<STRING>"))
    assert {(r.grp, r.left_item, r.right_item): r.n for r in store.table("pairs").collect()} == dict(_brute_pairs(baskets)[0])


def test_basket_of_many_items(spark):
    store = cooccurrence.PairStore(spark, work_path(spark, "test-pairs"))
    store.apply(spark.createDataFrame([("a", "g", [f"{k:05}" for k in range(1500)])], "basket_id STRING, grp STRING, items ARRAY<STRING>"))
    assert store.table("pairs").agg(F.count("*"), F.sum("n")).first() == (1500 * 1499 // 2, 1500 * 1499 // 2)


def test_empty_pair_store(spark):
    store = cooccurrence.PairStore(spark, work_path(spark, "test-pairs"), buckets=2)
    store.apply(spark.createDataFrame([], "basket_id STRING, grp STRING, items ARRAY<STRING>"))
    assert store.scores().count() == 0


def test_domains(spark):
    urls = {"https://www.A.Test.:443/x": "a.test", "http://u:p@b.test?x": "b.test", "HTTPS://WWW.c.test#f": "c.test", "x": None, "": None, None: None, "https://www.www.d.test/": "www.d.test", "//e.test/x": "e.test"}
    df = spark.createDataFrame([(u,) for u in urls], "u STRING")
    assert {r.u: r.d for r in df.select("u", cooccurrence.domain(F.col("u")).alias("d")).collect()} == urls


# set joins


@pytest.mark.parametrize(("small", "num", "den"), [(8, 7, 10), (3, 7, 10), (0, 1, 2), (20, 4, 5)])
def test_similar_sets(spark, small, num, den):
    rng = random.Random(small)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 13))] for _ in range(60)]
    sets = {k: s for k, s in enumerate(base + [s + ["hot"] for s in base[:20]] + base[:10] + [[], None, ["hot"], ["hot"]])}
    df = spark.createDataFrame([(k, s, "clash") for k, s in sets.items()] + [(None, ["a"], "x")], "id BIGINT, tokens ARRAY<STRING>, rep STRING")
    pairs, members = setjoin.similar_classes(df, num, den, small)
    got = {(r.id_a, r.id_b) for r in setjoin.expand(pairs, members).collect()}
    plain = {k: set(s) for k, s in sets.items() if s}
    assert got == {(a, b) for a, b in combinations(sorted(plain), 2) if len(plain[a] & plain[b]) * den >= len(plain[a] | plain[b]) * num}


def test_no_sets(spark):
    pairs, members = setjoin.similar_classes(spark.createDataFrame([], "id BIGINT, tokens ARRAY<STRING>"))
    assert setjoin.expand(pairs, members).count() == 0


# canonical lists


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abcd", max_size=12))
def test_edit_distance(a, b):
    assert canonmap.edit_distance(a, b) == _distance(a, b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=8), min_size=1, max_size=20, unique=True), st.text("abc", max_size=8), st.integers(0, 3))
def test_tree_finds_all_within(entries, text, radius):
    assert sorted(canonmap.BkTree(entries).within(text, radius)) == sorted((d, e) for e in entries if (d := _distance(e, text)) <= radius)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=6, unique=True), st.text("abcd", max_size=20), st.integers(0, 2))
def test_parts_reach_the_nearest_entry(entries, text, radius):
    want = min(((d, e) for e in entries for i in range(len(text) + 1) for j in range(i, len(text) + 1) if (d := _distance(e, text[i:j])) <= radius), default=None)
    tree = canonmap.BkTree(entries)
    assert min((hit for part in canonmap.PartFinder(entries, radius).parts(text) for hit in tree.within(part, radius)), default=None) == want


AGENTS = ["Halmirafetch/1", "Halm-irafetch 2", "HALMIRRAFETCH", "Ｈａｌｍｉｒａｆｅｔｃｈ", "x (see https://halmirafetsh.test/) y", "Mozilla/5.0 Halmyrafetsch/2.1", "Halxxxfetch", "", None, "Hаlmirafetch", "a" * 100_000 + "halmirafetc"]


@pytest.mark.parametrize("shard", [20_000, 1])
def test_map_rows(spark, monkeypatch, shard):
    monkeypatch.setattr(canonmap, "SHARD_ENTRIES", shard)
    rows = spark.createDataFrame([(k, a, "clash") for k, a in enumerate(AGENTS)] + [(1, AGENTS[1], "again"), (None, "Halmirafetcx", "x")], "id BIGINT, agent STRING, token STRING")
    catalog = spark.createDataFrame([("Halmirafetch", 1), ("Quorvexbot", 2), (None, 3), ("Halmirafetch", 1), ("--", 1)], "token STRING, n INT")
    got = {r.id: r.token for r in canonmap.map_rows(rows, "id", "agent", catalog, "token").collect()}
    assert got == dict.fromkeys((1, 2, 3, 5, 9, 10, None), "Halmirafetch")
    assert canonmap.map_rows(rows.limit(0), "id", "agent", catalog, "token").count() == 0
    assert canonmap.map_rows(rows, "id", "agent", catalog.limit(0), "token").count() == 0


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_items(lengths):
    packed = packing.pack_items(lengths, (8, 16, 64))
    assert sorted(i for _, content in packed for i in content) == list(range(len(lengths)))
    for capacity, content in packed:
        assert 0 < sum(lengths[i] for i in content) <= capacity
    for capacity, content in packed:  # no item sits in a shorter sequence while a longer one's gap could take it
        for longer, other in packed:
            if longer > capacity:
                gap = longer - sum(lengths[i] for i in other)
                assert all(lengths[i] > gap for i in content)


def test_step_groups_are_even():
    used = [random.Random(1).randrange(1, 100) for _ in range(64)]
    steps = defaultdict(int)
    for u, s in zip(used, packing.step_groups(used, 8)):
        steps[s] += u
    assert len(steps) == 8 and max(steps.values()) - min(steps.values()) <= 2 * 100


def test_pack_documents(spark):
    texts = ["", None, "word " * 70, "one", "two words", "x" * 5, "long " * 500, "one", "žluťoučký 漢字 \x00"]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id BIGINT, text STRING, shard INT")
    rows = packing.pack(docs, "doc_id", "text", tiers=(16, 64, 128), group=2, shard_items=4).collect()
    lengths = {r.doc_id: r.n for r in docs.select("doc_id", packing.token_counter()(F.col("text")).alias("n")).collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {k for k, n in lengths.items() if n}
    for k, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert sum(r.n_tokens for r in pieces) == lengths[k] and len(pieces) == -(-lengths[k] // 128)
        assert [r.piece_start for r in pieces] == [128 * i for i in range(len(pieces))]
    for content in by_sequence.values():
        content.sort(key=lambda r: r.sequence_offset)
        offset = 0
        for r in content:
            assert r.sequence_offset == offset
            offset += r.n_tokens
        assert offset <= content[0].capacity
    assert packing.pack(docs.limit(0), "doc_id", "text").count() == 0


# leakage


def _brute_leaks(docs, items, n):
    runs = defaultdict(set)
    for i, t in items.items():
        w = lookalikes.words(t or "")
        for k in range(len(w) - n + 1):
            runs[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs.items():
        w = lookalikes.words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + n]), ())}
    return out


def test_exact_passages(spark):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "the", "of"]
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 14))) for k in range(12)} | {90: None, 91: "", 92: "the the the the the the"}
    docs = {k: " ".join(rng.choice(vocabulary) for _ in range(60)) for k in range(25)}
    docs |= {100: "x, " + items[0].upper().replace(" ", " -\n ") + "!", 101: items[1].replace("a", "а"), 102: None, 103: "", 104: items[2].replace("e", "e​"), 105: "the " * 3000, 106: "".join(chr(0xFEE0 + ord(c)) if c != " " else "　" for c in items[3])}
    index = leakage.PositionalIndex(spark, work_path(spark, "test-index"))
    frame = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id BIGINT, text STRING, term INT")
    index.add(frame.where("doc_id < 50"))
    index.add(frame.where("doc_id >= 50"))
    found = leakage.exact_passages(index, spark.createDataFrame([(k, t, "s") for k, t in items.items()], "item_id BIGINT, text STRING, pos STRING"), 5).collect()
    assert {(r.doc_id, r.item_id) for r in found} == _brute_leaks(docs, items, 5)
    for r in found:
        d, i = lookalikes.words(docs[r.doc_id]), lookalikes.words(items[r.item_id])
        assert d[r.doc_pos : r.doc_pos + r.longest] == i[r.item_pos : r.item_pos + r.longest] and r.longest >= 5
    assert leakage.exact_passages(index, spark.createDataFrame([], "item_id BIGINT, text STRING")).count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = {1: "x y one two zzz three five four six seven eight nine ten end", 2: "one two three", 3: None}
    index = leakage.PositionalIndex(spark, work_path(spark, "test-index"))
    index.add(spark.createDataFrame(list(docs.items()), "doc_id BIGINT, text STRING"))
    got = leakage.proximity_matches(index, spark.createDataFrame([(7, item)], "item_id BIGINT, text STRING"), 24, 10).collect()
    assert [(r.doc_id, r.item_id, r.terms_met) for r in got] == [(1, 7, 10)]


def test_proximity_passes_over_unseen_words(spark):
    known = "one two three four five six seven eight nine ten"
    items = {7: "one two three four five unseen six seven eight nine ten", 8: "absent nowhere missing lacking gone none nil void blank bare", 9: "one two three"}
    index = leakage.PositionalIndex(spark, work_path(spark, "test-index"))
    index.add(spark.createDataFrame([(1, f"x y {known} end"), (2, "one two three other")], "doc_id BIGINT, text STRING"))
    got = leakage.proximity_matches(index, spark.createDataFrame(list(items.items()), "item_id BIGINT, text STRING"), 24, 10).collect()
    assert [(r.doc_id, r.item_id, r.terms_met) for r in got] == [(1, 7, 10)]


@pytest.mark.parametrize("hits, words", [(20_000, 2_000_000), (7, 60)])
def test_proximity_finds_every_place(spark, monkeypatch, hits, words):
    monkeypatch.setattr(leakage, "_HITS", hits)
    monkeypatch.setattr(leakage, "BLOCK_WORDS", words)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)] + ["the", "of"] * 6
    items = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(4, 25))) for k in range(15)} | {70: None, 71: ""}
    docs = {k: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 150))) for k in range(40)} | {80: None, 81: "the " * 2000}
    for k in range(8):
        mixed = items[k].split()
        rng.shuffle(mixed)
        docs[100 + k] = "a b " + " ".join(mixed[:-1]) + " c"
    index = leakage.PositionalIndex(spark, work_path(spark, "test-index"))
    index.add(spark.createDataFrame(list(docs.items()), "doc_id BIGINT, text STRING"))
    got = leakage.proximity_matches(index, spark.createDataFrame(list(items.items()), "item_id BIGINT, text STRING"), 9, 5).collect()
    want = {}
    for d, t in docs.items():
        w = lookalikes.words(t or "")
        for i, text in items.items():
            own = set(lookalikes.words(text or ""))
            best = max(((len(own & set(w[p : p + 9])), -p) for p in range(len(w)) if w[p] in own), default=(0, 0))
            if best[0] >= 5:
                want[d, i] = (best[0], -best[1])
    assert {(r.doc_id, r.item_id): (r.terms_met, r.doc_pos) for r in got} == want and len(want) > 8


# look-alikes


SAME = [("Apple pie", "Аррlе pie"), ("ﬁne", "fine"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("café", "café"), ("a​b­c﻿", "abc"), ("non break", "non break"), ("on‑line", "on-line"), ("Привет", "Пpивeт"), ("ν ο", "v o"), ("ё", "ë")]
DIFFERENT = [("x²", "x2"), ("a b", "a  b"), ("a b", "a\nb"), ("cafe", "café"), ("Case", "case"), ("½", "1/2"), ("l", "1"), ("ı", "i"), ("-", "—")]


def test_skeletons():
    for a, b in SAME:
        assert lookalikes.skeleton(a) == lookalikes.skeleton(b), (a, b)
    for a, b in DIFFERENT:
        assert lookalikes.skeleton(a) != lookalikes.skeleton(b), (a, b)


def test_canonical_form_keeps_scripts_and_classes(spark):
    texts = ["Привет всем, это обычный текст про сети", "plain english text about the network", "Καλημέρα κόσμε νέος"] * 5
    rows = [(k, t) for k, t in enumerate(texts + [x for p in SAME + DIFFERENT for x in p])]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows] + [(900, None, "x"), (901, "", "x"), (902, "о" * 100_000, "x")], "doc_id BIGINT, text STRING, form STRING")
    form = {r.doc_id: r.c for r in canonical.canonicalize(df, "text", "c").collect()}
    assert form[0] == texts[0] and form[1] == texts[1] and form[2] == texts[2] and form[900] is None and form[901] == "" and len(form[902]) == 100_000
    for (k, a), (j, b) in combinations(rows, 2):
        assert (form[k] == form[j]) == (lookalikes.skeleton(a) == lookalikes.skeleton(b))


def test_equal_looking_pairs(spark):
    rows = [(1, "abc"), (2, "аbс"), (3, "abc"), (4, "ab​c"), (5, "other"), (6, None), (None, "abc"), (7, "other"), (4, "ab​c")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    _, members = canonical.equal_looking(df, "doc_id", "text")
    assert {tuple(r) for r in canonical.equal_looking_pairs(members).collect()} == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert canonical.equal_looking(df.limit(0), "doc_id", "text")[1].count() == 0


# queries


def test_found_queries_against_brute_force(spark, data):
    from sightline.llm.queries import QUERIES

    prompts = {r.prompt_id: r.prompt for r in spark.read.parquet(f"{data}/answer_observations.parquet").collect() if r.prompt}
    sets = {k: {w for w in re.findall(r"[^\W_]{2,}", unicodedata.normalize("NFKC", p).lower())} for k, p in prompts.items()}
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) * 10 >= 7 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in QUERIES["p3_found"](spark, data).collect()} == want
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()}
    assert {tuple(r) for r in QUERIES["p9_found"](spark, data).collect()} == _brute_leaks(docs, items, 12)
    looks = defaultdict(set)
    for d, t in docs.items():
        looks[lookalikes.skeleton(t)].add(d)
    want = {(a, b) for ids in looks.values() for a, b in combinations(sorted(ids), 2) if docs[a] != docs[b]}
    assert {tuple(r) for r in QUERIES["p10_found"](spark, data).collect()} == want
