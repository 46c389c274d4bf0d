"""Similar texts by weighted words: TF-IDF cosine, families of similar texts, shingle coverage, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.session import materialize, small

from sightline.functions.normalize import running_words, shingles
from sightline.operators.graph import components


def tfidf(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight, df, n): unit-length weights (1 + ln tf) * ln(1 + N / df) of each text's words of two or more characters.

    Texts without such words, and null texts, have no rows and don't count in N.
    """
    words = texts.where(F.col(key).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{2,})"), F.lit(1))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    n = words.agg(F.countDistinct(key).alias("n"))
    raw = words.join(df, "term").join(F.broadcast(n)).withColumn("w", (1 + F.ln("tf")) * F.ln(1 + F.col("n") / F.col("df")))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"), "df", "n")


def similar_texts(texts: DataFrame, key: str, text: str, least: float = 0.65) -> DataFrame:
    """(a, b, cosine): pairs of texts with TF-IDF cosine of `least` or more, a < b.

    Words are ordered rarest first, and only those of a text that weigh more than what the rest may add up to (the square root
    of its squared weights stays below `least`) propose partners; all shared words then count. So frequent words are never
    pair-joined, yet no pair is lost.
    """
    from pyspark.sql import Window

    w = tfidf(texts, key, text)
    order = Window.partitionBy(key).orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    marked = w.withColumn("tail", F.sum(F.col("weight") * F.col("weight")).over(order))
    heads = marked.where(F.sqrt("tail") >= least - 1e-9).select(key, "term")
    a, b = heads.select(F.col(key).alias("a"), "term"), heads.select(F.col(key).alias("b"), "term")
    proposed = a.join(b, "term").where("a < b").select("a", "b").distinct()
    left, right = w.select(F.col(key).alias("a"), "term", F.col("weight").alias("wa")), w.select(F.col(key).alias("b"), "term", F.col("weight").alias("wb"))
    return proposed.join(left, "a").join(right, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)


def families(pairs: DataFrame, least: float) -> DataFrame:
    """(family, members, pairs, density, min_cosine, mean_cosine, max_cosine) of the components that pairs of at least `least` form."""
    close = pairs.where(F.col("cosine") >= least)
    member = components(close, "a", "b")
    sizes = member.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("members"))
    edges = close.join(member, F.col("a") == F.col("node")).groupBy(F.col("component").alias("family")).agg(F.count("*").alias("pairs"), F.min("cosine").alias("min_cosine"), F.avg("cosine").alias("mean_cosine"), F.max("cosine").alias("max_cosine"))
    return sizes.join(edges, "family").withColumn("density", F.col("pairs") / (F.col("members") * (F.col("members") - 1) / 2))


def shingle_coverage(pairs: DataFrame, source: str, copy: str, size: int = 5) -> DataFrame:
    """Adds shingles, shared and coverage: how many of the source's word runs its copy has; null coverage for texts of fewer words."""
    words = pairs.withColumn("_s", running_words(F.col(source))).withColumn("_c", running_words(F.col(copy)))
    out = words.withColumn("_s", shingles(F.col("_s"), size)).withColumn("_c", shingles(F.col("_c"), size))
    out = out.withColumn("shingles", F.size("_s")).withColumn("shared", F.size(F.array_intersect("_s", "_c")))
    return out.withColumn("coverage", F.when(F.col("shingles") > 0, F.col("shared") / F.col("shingles"))).drop("_s", "_c")


def mention_rows(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """(key, entity, n): how often each text mentions each entity by one of its aliases, as whole words, without case.

    `aliases` (entity, alias) may be of any size: runs of words as long as the longest alias are joined with it, so texts are read once whatever
    the number of entities. An alias inside a longer alias of the same entity counts in both. Words are runs of letters, digits and
    underscores, and runs of blanks and punctuation between them don't matter. Null texts, entities and aliases have none.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    known = aliases.where("entity IS NOT NULL AND alias IS NOT NULL").select("entity", words(F.col("alias")).alias("w")).where(F.size("w") > 0).select("entity", F.array_join("w", " ").alias("term"), F.size("w").alias("size")).distinct()
    known = materialize(known, "aliases")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    if not sizes:
        return texts.select(key, F.lit("").alias("entity"), F.lit(0).cast("bigint").alias("n")).where(F.lit(False))
    listed = texts.where(F.col(text).isNotNull()).select(key, words(F.col(text)).alias("w"))
    starts = lambda n: F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    joined = lambda n: F.transform(starts(n), lambda i: F.array_join(F.slice("w", i, n), " "))
    runs = None
    for n in sizes:
        part = listed.select(key, F.explode("w" if n == 1 else joined(n)).alias("term"))
        runs = part if runs is None else runs.unionByName(part)
    side = F.broadcast(known.drop("size")) if small(known, 200) else known.drop("size")
    return runs.join(side, "term").groupBy(key, "entity").agg(F.count("*").alias("n"))


def mentions(text: Column, aliases: list[str]) -> Column:
    """How often any of the aliases occurs as whole words, longer ones first, ignoring case."""
    import re

    words = "|".join(re.escape(a).replace(r"\ ", r"\s+") for a in sorted(aliases, key=lambda a: (-len(a), a)))
    return F.regexp_count(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{words})(?![\p{{L}}\p{{N}}_])"))


def fingerprint(text: Column) -> Column:
    """SHA-256 of a text in lower case with single blanks."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def reading_ease(text: Column) -> Column:
    """Flesch reading ease from sentences, words and vowel groups; null for texts without words."""
    words = F.regexp_count(text, F.lit(r"[A-Za-z]+"))
    sentences = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+(?:\s|$)")), F.lit(1))
    syllables = F.regexp_count(F.lower(F.regexp_replace(text, r"(?i)([a-z]{3,}?)(?:es|ed|(?<!l)e)\b", "$1")), F.lit(r"[aeiouy]{1,2}"))
    return F.when(words > 0, 206.835 - 1.015 * words / sentences - 84.6 * syllables / words)
