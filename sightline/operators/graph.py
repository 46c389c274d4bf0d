"""Graphs of items: co-citation networks, centrality, components, communities, canonical chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.operators.tables import with_totals
from sightline.session import delete_path, materialize, work_path


def over(*keys: str):
    return Window.partitionBy(*keys)


def cocitation(rows: DataFrame, group: list[str], unit: str, item: str) -> DataFrame:
    """Items that share units within a group: group, left_item < right_item, both, left_units, right_units, units, jaccard, lift, given_left, given_right.

    Rows with a null unit or item are left out; null groups too.
    """
    cells = rows.where(F.col(unit).isNotNull() & F.col(item).isNotNull()).select(*group, unit, item).distinct()
    # a join by unit, which spills and splits where a unit has many items
    left, right = cells.withColumnRenamed(item, "left_item"), cells.withColumnRenamed(item, "right_item")
    pairs = left.join(right, [*group, unit]).where("left_item < right_item").groupBy(*group, "left_item", "right_item").agg(F.count("*").alias("both"))
    sizes = cells.groupBy(*group, item).agg(F.count("*").alias("n"))
    totals = cells.select(*group, unit).distinct().groupBy(*group).agg(F.count("*").alias("units"))
    side = lambda s: sizes.select(*group, F.col(item).alias(f"{s}_item"), F.col("n").alias(f"{s}_units"))
    joined = pairs.join(side("left"), [*group, "left_item"]).join(side("right"), [*group, "right_item"]).join(totals, group)
    b, x, y, n = F.col("both"), F.col("left_units"), F.col("right_units"), F.col("units")
    return joined.select(*group, "left_item", "right_item", "both", "left_units", "right_units", "units", (b / (x + y - b)).alias("jaccard"), (b.cast("double") * n / (x * y)).alias("lift"), (b / x).alias("given_left"), (b / y).alias("given_right"))


def rank_weighted_edges(rows: DataFrame, group: list[str], unit: str, item: str, rank: str) -> DataFrame:
    """Edges whose strength is the sum over units of the root of the product of both items' rank-weighted shares."""
    w = rows.groupBy(*group, unit, item).agg(F.sum(1 / F.log2(F.col(rank) + 1.0)).alias("w"))
    s = w.withColumn("s", F.col("w") / F.sum("w").over(Window.partitionBy(*group, unit)))
    a = s.select(*group, unit, F.col(item).alias("left_item"), F.col("s").alias("sa"))
    b = s.select(*group, unit, F.col(item).alias("right_item"), F.col("s").alias("sb"))
    return a.join(b, [*group, unit]).where("left_item < right_item").groupBy(*group, "left_item", "right_item").agg(F.sum(F.sqrt(F.col("sa") * F.col("sb"))).alias("strength"))


def _rank_group(a, b, w, damping: float, tolerance: float, iterations: int):
    """Ranks of one group's nodes from edge arrays, by power iteration."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    src, dst = np.concatenate([at[: len(a)], at[len(a) :]]), np.concatenate([at[len(a) :], at[: len(a)]])
    weight = np.concatenate([w, w])
    share = weight / np.bincount(src, weights=weight, minlength=len(nodes))[src]
    rank = np.full(len(nodes), 1 / len(nodes))
    for _ in range(iterations):
        new = (1 - damping) / len(nodes) + damping * np.bincount(dst, weights=rank[src] * share, minlength=len(nodes))
        moved, rank = np.abs(new - rank).sum(), new
        if moved < tolerance:
            break
    return nodes, rank


def pagerank(edges: DataFrame, group: list[str], left: str, right: str, weight: str, damping: float = 0.85, tolerance: float = 1e-12, iterations: int = 100, task_edges: int = 500_000) -> DataFrame:
    """(group, item, pagerank) of undirected weighted edges.

    Groups of up to `task_edges` edges are ranked by one task each, larger ones by joins over the cluster, with the same
    rounds and the same end: when a group's ranks move less than `tolerance` in sum, or after `iterations`. Every item has an
    edge, so no rank dangles.
    """
    plain = edges.select(*group, F.col(left).alias("a"), F.col(right).alias("b"), F.col(weight).cast("double").alias("w")).where("w > 0 AND a <> b")
    plain = materialize(plain, "rank-input")
    sizes = plain.groupBy(*group).agg(F.count("*").alias("_n"))
    large = materialize(sizes.where(F.col("_n") > task_edges).drop("_n"), "large-groups")
    schema = ", ".join(f"{g} {dict(edges.dtypes)[g]}" for g in group) + f", item {dict(edges.dtypes)[left]}, pagerank DOUBLE"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes, rank = _rank_group(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["w"].to_numpy(), damping, tolerance, iterations)
        out = pd.DataFrame({"item": nodes, "pagerank": rank})
        for g, k in zip(group, key):
            out[g] = k
        return out[[*group, "item", "pagerank"]]

    if large.isEmpty():
        return plain.groupBy(*group).applyInPandas(run, schema)
    alone = plain.join(large, group, "left_anti").groupBy(*group).applyInPandas(run, schema)
    return alone.unionByName(_pagerank_joins(plain.join(large, group, "left_semi"), group, "a", "b", "w", damping, tolerance, iterations))


def _pagerank_joins(edges: DataFrame, group: list[str], left: str, right: str, weight: str, damping: float, tolerance: float, iterations: int) -> DataFrame:
    """pagerank() by joins: each round joins ranks to edges and sums; every fifth is written to the shared folder."""
    spark = edges.sparkSession
    both = edges.select(*group, F.col(left).alias("src"), F.col(right).alias("dst"), F.col(weight).cast("double").alias("w")).where("w > 0 AND src <> dst")
    both = both.unionByName(both.select(*group, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    out = with_totals(both, [*group, "src"], _t=F.sum("w")).withColumn("share", F.col("w") / F.col("_t")).drop("w", "_t")
    out = materialize(out, "rank-edges")
    nodes = materialize(with_totals(out.select(*group, F.col("src").alias("item")).distinct(), group, n=F.count("*")), "rank-nodes")
    ranks, path = nodes.withColumn("r", 1.0 / F.col("n")), None
    for step in range(1, iterations + 1):
        inflow = out.join(ranks.select(*group, F.col("item").alias("src"), "r"), [*group, "src"]).groupBy(*group, F.col("dst").alias("item")).agg(F.sum(F.col("r") * F.col("share")).alias("i"))
        ranks = ranks.join(inflow, [*group, "item"]).select(*group, "item", "n", ((1 - damping) / F.col("n") + damping * F.col("i")).alias("r"), F.abs((1 - damping) / F.col("n") + damping * F.col("i") - F.col("r")).alias("d"))
        if step % 5 == 0 or step == iterations:
            written = work_path(spark, "ranks")
            ranks.write.parquet(written)
            ranks = spark.read.parquet(written)
            if path:
                delete_path(spark, path)
            path = written
            moved = ranks.groupBy(*group).agg(F.sum("d").alias("d")).agg(F.max("d")).first()[0]
            if moved is None or moved < tolerance:
                break
    return ranks.select(*group, "item", F.col("r").alias("pagerank"))


def _least_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, component) of all edges (u, v) of a task, by a union-find whose roots are the least members."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch["u"], batch["v"]):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        yield pd.DataFrame({"node": list(parent), "component": [root(x) for x in parent]})


def components(edges: DataFrame, left: str, right: str, task_edges: int = 500_000) -> DataFrame:
    """(node, component): connected components named by their least node; by alternating large-star and small-star steps.

    Each step links nodes to the least neighbour they know, so chains shrink fast and no component is gathered in a task.
    Edges are written to the shared folder each round. Null ends are left out; an end joined to itself is a component. Up to
    `task_edges` edges between texts or whole numbers, counted first, are joined in one task, which gives the same.
    """
    spark = edges.sparkSession
    clean = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    clean = materialize(clean, "edges")
    kind = clean.schema["u"].dataType.simpleString()
    if kind in ("string", "bigint", "int") and clean.limit(task_edges + 1).count() <= task_edges:
        return clean.coalesce(1).mapInPandas(_least_members, f"node {kind}, component {kind}")
    nodes = clean.select(F.col("u").alias("node")).union(clean.select("v")).distinct()
    now, path, before = clean.where("u <> v"), None, None
    while True:
        # large star: every neighbour above a node goes to the node's least neighbour
        sym = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        written = work_path(spark, "stars")
        small.write.parquet(written)
        now = spark.read.schema(small.schema).parquet(written)
        if path:
            delete_path(spark, path)
        path = written
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _label_nodes(edges: pd.DataFrame, iterations: int, tie: float) -> dict[str, str]:
    near: dict[str, dict[str, float]] = {}
    for a, b, w in zip(edges["a"], edges["b"], edges["w"]):
        if a != b and w > 0:
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
    labels = {n: n for n in near}
    for _ in range(iterations):
        changed = False
        for node in sorted(near):
            scores: dict[str, float] = {}
            for other in sorted(near[node]):
                scores[labels[other]] = scores.get(labels[other], 0.0) + near[node][other]
            own = labels[node]
            top = max(scores.values())
            if top > scores.get(own, 0.0) + tie:
                labels[node] = min(x for x, s in scores.items() if s >= top - tie)
                changed = True
        if not changed:
            break
    return labels


def communities(edges: DataFrame, group: list[str], left: str, right: str, weight: str, iterations: int = 50, tie: float = 1e-12, most_edges: int = 1_000_000, nodes: DataFrame | None = None) -> DataFrame:
    """(group, item, community, modularity): weighted label propagation, nodes visited in order, each seeing the labels set before it.

    The visiting order is part of the definition, so a group is labelled by one task; groups are report-sized networks,
    and a group of more than `most_edges` edges is refused, not cut. The community is the label, modularity the group's. Of `nodes`
    (group, item), if given, those without an edge are communities of their own.
    """
    edges = materialize(edges.select(*group, left, right, weight), "community-edges")
    sized = edges.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if sized > most_edges:
        raise ValueError(f"a group has {sized} edges; label propagation takes up to {most_edges}")
    schema = ", ".join(f"{g} {dict(edges.dtypes)[g]}" for g in group) + ", item STRING, community STRING, modularity DOUBLE"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        labels = _label_nodes(rows, iterations, tie)
        total = rows["w"].sum()
        inside: dict[str, float] = {}
        degree: dict[str, float] = {}
        for a, b, w in zip(rows["a"], rows["b"], rows["w"]):
            if a in labels and b in labels:
                if labels[a] == labels[b]:
                    inside[labels[a]] = inside.get(labels[a], 0.0) + w
                for n in (a, b):
                    degree[labels[n]] = degree.get(labels[n], 0.0) + w
        value = sum(inside.get(c, 0.0) / total - (d / (2 * total)) ** 2 for c, d in degree.items()) if total else None
        out = pd.DataFrame({"item": list(labels), "community": list(labels.values())}).assign(modularity=value)
        for g, k in zip(group, key):
            out.insert(0, g, k)
        return out[[*group, "item", "community", "modularity"]]

    plain = edges.select(*group, F.col(left).alias("a"), F.col(right).alias("b"), F.col(weight).cast("double").alias("w"))
    found = plain.groupBy(*group).applyInPandas(run, schema)
    if nodes is None:
        return found
    labelled = materialize(found, "communities")
    alone = nodes.select(*group, "item").where("item IS NOT NULL").distinct().join(labelled, [*group, "item"], "left_anti")
    values = labelled.groupBy(*group).agg(F.max("modularity").alias("modularity"))
    return labelled.unionByName(alone.join(values, group, "left").select(*group, "item", F.col("item").alias("community"), "modularity"))


def _cut_nodes(pairs: list[tuple[str, str]]) -> set[str]:
    """Nodes whose removal splits their component, by depth-first low points without recursion."""
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    cuts: set[str] = set()
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, branches = [(root, "", iter(sorted(near[root])))], 0
        while stack:
            node, parent, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if stack:
                    above = stack[-1][0]
                    low[above] = min(low[above], low[node])
                    if above != root and low[node] >= seen[above]:
                        cuts.add(above)
            elif step not in seen:
                branches += node == root
                seen[step] = low[step] = len(seen)
                stack.append((step, node, iter(sorted(near[step]))))
            elif step != parent:
                low[node] = min(low[node], seen[step])
        if branches > 1:
            cuts.add(root)
    return cuts


def bridging_nodes(edges: DataFrame, left: str, right: str, most_edges: int = 1_000_000) -> DataFrame:
    """(component, node): articulation points, the nodes whose removal splits their component.

    Components are found over the cluster, each is searched by one task; one of more than `most_edges` edges is refused.
    Null ends are left out, repeated edges count once.
    """
    clean = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).select(F.least(left, right).cast("string").alias("a"), F.greatest(left, right).cast("string").alias("b")).distinct()
    clean = materialize(clean, "bridge-edges")
    member = components(clean, "a", "b").select(F.col("node").alias("a"), "component")
    placed = materialize(clean.join(member, "a"), "placed-edges")
    largest = placed.groupBy("component").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > most_edges:
        raise ValueError(f"a component has {largest} edges; the search takes up to {most_edges}")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cuts = sorted(_cut_nodes(list(zip(rows["a"], rows["b"]))))
        return pd.DataFrame({"component": [key[0]] * len(cuts), "node": cuts}, dtype=object)

    return placed.groupBy("component").applyInPandas(run, "component STRING, node STRING")


def adjusted_rand_index(items: DataFrame, first: str, second: str) -> DataFrame:
    """(items, adjusted_rand_index) of two partitions of the same items; null where chance alone would agree fully."""
    cells = items.groupBy(first, second).agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    total = cells.agg(F.sum("n").alias("items"), F.sum(pairs(F.col("n"))).alias("ij"))
    rows = cells.groupBy(first).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"))
    columns = cells.groupBy(second).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"))
    chance = F.col("i") * F.col("j") / pairs(F.col("items"))
    index = (F.col("ij") - chance) / F.nullif((F.col("i") + F.col("j")) / 2 - chance, F.lit(0.0))
    return total.join(F.broadcast(rows)).join(F.broadcast(columns)).select("items", index.alias("adjusted_rand_index"))


def canonical_targets(pages: DataFrame, page: str, target: str, rounds: int = 40) -> DataFrame:
    """(page, final, hops, state): where each page's chain of canonical addresses ends: self, chain, or loop.

    Pointer doubling: each round doubles the hops followed, so chains of 2 ^ rounds end. A page without a target, or whose
    target is itself, ends its chain; targets that are no page end it too.
    """
    links = pages.where(F.col(page).isNotNull()).groupBy(F.col(page).alias("page")).agg(F.min(target).alias("t"))
    ends = links.select("page", F.coalesce("t", "page").alias("at"), F.when(F.col("t").isNull() | (F.col("t") == F.col("page")), 0).otherwise(1).cast("bigint").alias("hops"))
    now = materialize(ends, "pointers")
    for _ in range(rounds):
        onward = now.select(F.col("page").alias("at"), F.col("at").alias("next"), F.col("hops").alias("more"))
        now = materialize(now.join(onward, "at", "left").select("page", F.coalesce("next", "at").alias("at"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "pointers")
        open_rows = now.join(now.select(F.col("page").alias("at"), F.col("hops").alias("more")), "at", "left").where("more > 0")
        unfinished = open_rows.agg(F.count("*"), F.min("hops")).first()
        # a chain longer than there are pages can only be a loop
        if not unfinished[0] or unfinished[1] > now.count():
            break
    left = now.join(now.select(F.col("page").alias("at"), F.col("hops").alias("more")), "at", "left")
    looped = F.coalesce(F.col("more"), F.lit(0)) > 0
    return left.select("page", F.when(~looped, F.col("at")).alias("final"), F.when(~looped, F.col("hops")).alias("hops"), F.when(looped, "loop").when(F.col("hops") == 0, "self").otherwise("chain").alias("state"))


def degrees(edges: DataFrame, source: str, target: str, nodes: DataFrame, node: str) -> DataFrame:
    """(node, links_out, links_in, orphan): distinct links of each listed node to and from other nodes; orphans have none in."""
    distinct = edges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target))).select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    outs, ins = distinct.groupBy(F.col("s").alias(node)).agg(F.count("*").alias("links_out")), distinct.groupBy(F.col("t").alias(node)).agg(F.count("*").alias("links_in"))
    return nodes.select(node).distinct().join(outs, node, "left").join(ins, node, "left").fillna(0, ["links_out", "links_in"]).withColumn("orphan", F.col("links_in") == 0)


def unreciprocated(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Directed links without the link back."""
    distinct = edges.select(source, target).where(F.col(source) != F.col(target)).distinct()
    back = distinct.select(F.col(target).alias(source), F.col(source).alias(target))
    return distinct.join(back, [source, target], "left_anti")

