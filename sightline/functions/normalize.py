"""Normal forms of labels, addresses, paths and numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label(text: Column) -> Column:
    """A label without case and spacing differences; '' becomes null, as does null. See compat_label for NFKC."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(plain != "", plain)


@F.pandas_udf(T.StringType())
def compat_label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """label() after NFKC, which Spark has no built-in for."""
    import unicodedata

    for batch in batches:
        yield batch.map(lambda t: (" ".join(unicodedata.normalize("NFKC", t).split()).lower() or None) if isinstance(t, str) else None)


def host(url: Column) -> Column:
    """Host of an absolute http(s) address in lower case, without user, port, final dot or leading `www.`; else null."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^https?://(?:[^/?#@\\]*@)?(\[[^\]]*\]|[^/?#:\\]+)", 1)
    plain = F.regexp_replace(F.regexp_replace(found, r"\.$", ""), r"^www\.", "")
    return F.when(plain != "", plain)


def page_url(url: Column, keep_query: bool = True) -> Column:
    """An absolute http(s) address in one spelling: lower scheme and host, no default port, user info refused, no fragment, path at least `/`.

    Null for anything else. With keep_query false the query is dropped too.
    """
    t = F.trim(url)
    scheme = F.lower(F.regexp_extract(t, r"^(?i)(https?)://", 1))
    where = F.lower(F.regexp_extract(t, r"^(?i)https?://([^/?#]+)", 1))
    where = F.when(scheme == "http", F.regexp_replace(where, r":80$", "")).otherwise(F.regexp_replace(where, r":443$", ""))
    path = F.regexp_extract(t, r"^(?i)https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(t, r"^[^?#]*(\?[^#]*)", 1)
    out = F.concat(scheme, F.lit("://"), where, F.when(path == "", "/").otherwise(path), query if keep_query else F.lit(""))
    return F.when((scheme != "") & (where != "") & ~F.contains(where, F.lit("@")), out)


def path_of(target: Column) -> Column:
    """The path of a request target or address, without query and fragment; '/' if empty, null for null."""
    path = F.regexp_replace(F.regexp_replace(target, r"^(?i)https?://[^/?#]*", ""), r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(path)


def path_family(target: Column, depth: int = 1) -> Column:
    """The first `depth` path segments, identifiers as :uuid or :id, with /* if there are more; '/' for the root."""
    segments = F.filter(F.split(path_of(target), "/"), lambda s: s != "")
    short = F.transform(F.slice(segments, 1, depth), lambda s: F.when(s.rlike(r"^(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"), ":uuid").when(s.rlike(r"^\d{5,}$|^(?i)[0-9a-f]{16,}$"), ":id").otherwise(s))
    more = F.when(F.size(segments) > depth, "/*").otherwise("")
    return F.when(F.size(segments) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(short, "/"), more))


def query_parameter(target: Column, name: str) -> Column:
    """Struct (state, value) of a query parameter that should occur once: none, empty, single or conflicting."""
    query = F.regexp_extract(target, r"\?([^#]*)", 1)
    values = F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: F.lower(p).startswith(f"{name}=")), lambda p: F.lower(F.trim(F.try_url_decode(F.substring_index(p, "=", -1))))))
    filled = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    state = F.when(F.size(filled) == 1, "single").when(F.size(filled) > 1, "conflicting").when(F.size(values) > 0, "empty").otherwise("none")
    return F.struct(state.alias("state"), F.when(F.size(filled) == 1, filled[0]).alias("value"))


def count_metric(text: Column) -> Column:
    """A non-negative count in any usual spelling: groups of three digits are thousands, one separator else a decimal mark, % ignored."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\s\x{A0}]", ""), r"%$", "")
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    comma_last = F.length(F.substring_index(t, ",", -1)) < F.length(F.substring_index(t, ".", -1))
    plain = (
        F.when(both & comma_last, F.regexp_replace(F.replace(t, F.lit("."), F.lit("")), ",", "."))
        .when(both, F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^\d{1,3}(?:[,.]\d{3})+$"), F.regexp_replace(t, "[,.]", ""))
        .otherwise(F.regexp_replace(t, ",", "."))
    )
    return F.when(plain.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))


def share_metric(text: Column) -> Column:
    """A share from 0 to 100; a single comma or point is its decimal mark, even before three digits."""
    t = F.regexp_replace(F.regexp_replace(text, r"[\s\x{A0}]", ""), r"%$", "")
    both = F.contains(t, F.lit(",")) & F.contains(t, F.lit("."))
    plain = F.regexp_replace(t, ",", ".")
    value = F.when(both, count_metric(text)).when(plain.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
    return F.when(value <= 100, value)


def word_tokens(text: Column, least: int = 2) -> Column:
    """Distinct runs of letters and digits of at least `least` characters in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"([\p{{L}}\p{{N}}]{{{least},}})"), F.lit(1))))


def running_words(text: Column) -> Column:
    """The words of a text in order, in lower case; apostrophes, hyphens and underscores inside words belong to them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'_-]*)"), F.lit(1))


def shingles(words: Column, size: int = 5) -> Column:
    """Runs of `size` consecutive words, joined by blanks, each once; none for fewer words.

    `words` should be a column of its own, from running_words, as an expression would be evaluated for each run.
    """
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " ")))


def owned(url_host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one; null for null."""
    tests = [(url_host == d) | url_host.endswith("." + d) for d in domains]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.when(url_host.isNotNull(), out)
