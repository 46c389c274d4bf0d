"""All similar pairs between set-valued records: token subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.session import materialize

_WORD = regex.compile(r"[\p{L}\p{N}]{2,}")


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_set(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct runs of letters and digits of two or more characters, after NFKC and lower-casing; null for null."""
    import unicodedata

    for batch in texts:
        yield batch.map(lambda t: sorted(set(_WORD.findall(unicodedata.normalize("NFKC", t).lower()))) if isinstance(t, str) else None)


def overlap_needed(s: int, t: int, num: int, den: int) -> int:
    """The least overlap of sets of s and t tokens with Jaccard similarity num / den or more, in whole numbers."""
    return -(-num * (s + t) // (num + den))


def subset_keys(tokens: list[int], small: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(size of the smaller, size of the larger, hash of a subset) for each size a small partner may have.

    Two small sets are similar if and only if they share such a key: subsets have as many tokens as the pair must share.
    """
    s, keys = len(tokens), []
    for t in range(1, small + 1):
        c = overlap_needed(s, t, num, den)
        if c <= min(s, t):
            keys += [(min(s, t), max(s, t), hash(x)) for x in combinations(tokens, c)]
    return keys


def enumeration_cost(s: int, small: int, num: int, den: int) -> int:
    """Subsets that a set of s tokens emits if sets of up to `small` tokens count as small."""
    return sum(comb(s, overlap_needed(s, t, num, den)) for t in range(1, small + 1) if overlap_needed(s, t, num, den) <= min(s, t))


def size_boundary(sizes: dict[int, int], num: int, den: int, per_token: int = 2, most: int = 16) -> int:
    """The largest size of small sets whose subsets stay within `per_token` for each token of all sets; `sizes` counts sets by size.

    Subsets cost more than they save beyond that; any boundary gives the same pairs.
    """
    budget = per_token * sum(s * n for s, n in sizes.items())
    fits = [b for b in range(most + 1) if sum(n * enumeration_cost(s, b, num, den) for s, n in sizes.items() if s <= b) <= budget]
    return max(fits, default=0)


def _ranked(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): distinct sets with their tokens as hashes, rarest first, and the class of each record."""
    hashed = F.array_sort(F.array_distinct(F.transform(F.array_compact("tokens"), lambda t: F.xxhash64(t))))
    rows = materialize(sets.where("id IS NOT NULL").select("id", hashed.alias("h")).where(F.size("h") > 0).distinct(), "sets")
    reps = materialize(rows.groupBy("h").agg(F.min("id").alias("rep")), "set-classes")
    # records join their class, so that one set's records are never gathered in a row
    members = rows.join(reps, "h").select("rep", "id")
    tokens = reps.select("rep", F.explode("h").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(df, "token").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("tokens"))
    return materialize(ranked.withColumn("size", F.size("tokens")), "ranked-sets"), members


def similar_classes(sets: DataFrame, numerator: int = 7, denominator: int = 10, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of different sets with Jaccard similarity of numerator / denominator or more, and the class of each record.

    `sets` has id and tokens (ARRAY<STRING>). Returns (pairs, members): members (rep, id) name each record's class of
    equal sets by its least id; pairs (rep_a, rep_b, overlap, similarity), rep_a < rep_b, hold each pair of classes once.
    Records with a null id, or a null or empty set, are similar to none; null tokens are dropped, repeated ones count once.
    Sets of at most `small` tokens pair by shared token subsets of the size such a pair must share; pairs with a larger set
    come from the inverted lists of the rarest tokens of each set, as many as a similar set must meet. No cap applies. Without
    `small` the boundary is taken from the sizes of all sets, see size_boundary.
    """
    num, den = numerator, denominator
    ranked, members = _ranked(sets)
    if small is None:
        small = size_boundary({r["size"]: r["count"] for r in ranked.groupBy("size").count().collect()}, num, den)

    @F.pandas_udf("array<struct<lo:int,hi:int,subset:bigint>>")
    def subsets(sets: pd.Series) -> pd.Series:
        return sets.map(lambda s: [dict(zip(("lo", "hi", "subset"), k)) for k in subset_keys(sorted(int(x) for x in s), small, num, den)])

    keyed = ranked.where(F.col("size") <= small).select("rep", "size", F.explode(subsets("tokens")).alias("k")).select("rep", "size", "k.*")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("lo", "hi", "subset")] + [F.col("a.size") == F.col("a.lo"), F.col("b.size") == F.col("b.hi")]
    from_small = a.join(b, [*same, (F.col("a.lo") < F.col("b.hi")) | (F.col("a.rep") < F.col("b.rep"))]).select(F.least("a.rep", "b.rep").alias("rep_a"), F.greatest("a.rep", "b.rep").alias("rep_b"))

    # a set of s tokens shares at least ceil(s * num / den) of them with any similar one, so one is among its rarest s - that + 1
    prefix = F.expr(f"size - CAST(ceil(size * {num} / {den}D - 1e-9) AS INT) + 1")
    lists = ranked.select("rep", "size", F.explode(F.slice("tokens", F.lit(1), prefix)).alias("token"))
    x, y = lists.where(F.col("size") > small).alias("x"), lists.alias("y")
    near = (F.col("y.size") * den >= F.col("x.size") * num) & (F.col("y.size") * num <= F.col("x.size") * den)
    once = (F.col("y.size") < F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.rep") < F.col("x.rep")))
    from_large = x.join(y, (F.col("x.token") == F.col("y.token")) & near & once).select(F.least("x.rep", "y.rep").alias("rep_a"), F.greatest("x.rep", "y.rep").alias("rep_b"))

    candidates = from_small.unionByName(from_large).distinct()
    ta, tb = ranked.select(F.col("rep").alias("rep_a"), F.col("tokens").alias("ta")), ranked.select(F.col("rep").alias("rep_b"), F.col("tokens").alias("tb"))
    checked = candidates.join(ta, "rep_a").join(tb, "rep_b").withColumn("overlap", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("overlap")
    pairs = checked.where(F.col("overlap") * den >= union * num).select("rep_a", "rep_b", "overlap", (F.col("overlap") / union).alias("similarity"))
    return pairs, members


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all similar pairs of records, those of equal sets included."""
    a, b = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    across = pairs.select("rep_a", "rep_b").join(a, "rep_a").join(b, "rep_b").select("x", "y")
    within = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
