"""Visually identical text: one consistent form by a search over look-alike letters."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.lookalikes import MARKS, MEMBERS, SOFT, decomposed_skeleton, visible
from sightline.session import materialize

_TOKEN = re.compile(rf"[^\W\d_]+(?:{MARKS}+[^\W\d_]*)*")
_MARK = re.compile(MARKS)
#: Cost, in nats, of a change of script between neighbouring letters of a token.
SWITCH = 12.0
_SOFT = {c: group for group in SOFT for c in group}
#: Letters that the search may choose between; the others of a script count as one letter of it.
_CHOICES = {c for group in [*MEMBERS.values(), *SOFT] for c in group}
_OTHERS = {"latin": "1", "cyrillic": "2", "greek": "3", "other": "4"}


def _is_mark(ch: str) -> bool:
    return MARKS[1] <= ch <= MARKS[3]


@lru_cache(maxsize=1 << 12)
def script(ch: str) -> str:
    """Latin, Cyrillic, Greek or other, by code block."""
    c = ord(ch)
    if c < 0x2B0 or 0x1E00 <= c < 0x1F00:
        return "latin"
    return "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "cyrillic" if 0x400 <= c < 0x530 else "other"


@lru_cache(maxsize=1 << 12)
def _letter(ch: str) -> str:
    return ch if ch in _CHOICES else _OTHERS[script(ch)]


def _grams(token: str) -> Iterator[str]:
    """The runs of three letters of one script in a token, with ^ before and $ behind it."""
    row = "^^" + token + "$"
    scripts = [None if c in "^$" else script(c) for c in row]
    kinds = ["^", "^", *map(_letter, token), "$"]
    for i in range(len(row) - 2):
        if len({s for s in scripts[i : i + 3] if s}) < 2:
            yield kinds[i] + kinds[i + 1] + kinds[i + 2]


def count_grams(texts: DataFrame, column: str) -> DataFrame:
    """(gram, n): runs of three letters of one script, accents aside, in all tokens of all texts, with ^ and $ at their ends, counted for a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        tokens: Counter[str] = Counter()

        def spread() -> None:
            for token, n in tokens.items():
                for gram in _grams(_MARK.sub("", token)):
                    counts[gram] += n
            tokens.clear()

        for batch in batches:
            for text in batch[column]:
                if text:
                    seen = visible(text)
                    tokens.update(_TOKEN.findall(seen if seen.isascii() else unicodedata.normalize("NFD", seen)))
                if len(tokens) > 500_000:
                    spread()
        spread()
        yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())})

    return texts.select(column).mapInPandas(run, "gram STRING, n BIGINT").groupBy("gram").agg(F.sum("n").alias("n"))


class Lattice:
    """The most likely spelling of a skeleton token under runs of three letters: in one script if one can spell it, else with script changes costed.

    Each letter of a look-alike class may become any letter of the class. A letter that looks like another only in some
    typefaces (SOFT) is read as that one if the token has a letter that only the other's script has, and none that only its
    own script has: the к of `breaк` is a k, that of `как` stays. The choice depends on the skeleton alone.
    """

    def __init__(self, grams: dict[str, int]) -> None:
        self.grams = grams
        self.starts: Counter[str] = Counter()
        for g, n in grams.items():
            self.starts[g[:2]] += n
        self.costs: dict[tuple[str, str, str], float] = {}
        # tokens spelled as they are, and the spellings of the others
        self.same: set[str] = set()
        self.other: dict[str, str] = {}

    def _cost(self, a: str, b: str, c: str) -> float:
        found = self.costs.get((a, b, c))
        if found is None:
            found = self.costs[a, b, c] = self._new_cost(a, b, c)
        return found

    def _new_cost(self, a: str, b: str, c: str) -> float:
        switch = SWITCH if b != "^" and c != "$" and script(b) != script(c) else 0.0
        left, here, right = (x if x in "^$" else _letter(x) for x in (a, b, c))
        return switch - log((self.grams.get(left + here + right, 0) + 0.1) / (self.starts.get(left + here, 0) + 100.0))

    def _options(self, text: str) -> list[list[str]]:
        hard = {script(c) for c in text if c not in _CHOICES and not _is_mark(c)}
        out = []
        for ch in text:
            if ch in _SOFT:
                own = script(ch)
                read = [c for c in _SOFT[ch] if script(c) in hard] if own not in hard else []
                out.append(read[:1] or [ch])
            else:
                out.append(sorted(MEMBERS.get(ch, ch)))
        return out

    def _best(self, options: list[list[str]]) -> tuple[float, str]:
        """The cheapest path through the options of each place, of equal ones the first."""
        paths = {("^", "^"): (0.0, "")}
        for row in options:
            if _is_mark(row[0]):
                paths = {k: (c, p + row[0]) for k, (c, p) in paths.items()}
                continue
            ahead: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (cost, path) in paths.items():
                for o in row:
                    step = (cost + self._cost(a, b, o), path + o)
                    if (b, o) not in ahead or step < ahead[b, o]:
                        ahead[b, o] = step
            paths = ahead
        return min((c + self._cost(a, b, "$"), p) for (a, b), (c, p) in paths.items())

    def token(self, text: str) -> str:
        """The spelling of one skeleton token; of equally likely ones the first by code point."""
        if text in self.same:
            return text
        found = self.other.get(text)
        if found is None:
            options = self._options(text)
            # spellings in one script come first; only a token that no script can spell alone is searched over all
            alone = [[[o for o in row if _is_mark(o) or script(o) == one] for row in options] for one in ("latin", "cyrillic", "greek")]
            whole = [rows for rows in alone if all(rows)] or [options]
            found = min(self._best(rows) for rows in whole)[1]
            for kept in (self.same, self.other, self.costs):
                if len(kept) > 500_000:
                    kept.clear()
            if found == text:
                self.same.add(text)
            else:
                self.other[text] = found
        return found

    def form(self, text: str) -> str:
        plain = decomposed_skeleton(text)
        # most tokens are spelled as their skeleton; only a text with another token is rewritten
        if any(self.token(t) != t for t in set(_TOKEN.findall(plain)) - self.same):
            plain = _TOKEN.sub(lambda m: self.token(m[0]), plain)
        return plain if plain.isascii() else unicodedata.normalize("NFC", plain)


def train(texts: DataFrame, column: str) -> dict[str, int]:
    """Counts of three-letter runs over all texts.

    A run is of one script, whose letters outside the look-alike classes count as one, so there are at most
    some 60 symbols a script and 600,000 runs, however many texts there are.
    """
    return {r.gram: r.n for r in count_grams(texts, column).collect()}


def canonical_text(model: dict[str, int]):
    """Arrow function: each text in its one form; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(model)
        for batch in batches:
            yield batch.map(lambda t: lattice.form(t) if isinstance(t, str) else None)

    return run


def canonicalize(texts: DataFrame, column: str, out: str) -> DataFrame:
    """Adds `out`, the text in its one form, from a model trained on all of `texts`; null stays null, '' stays ''."""
    return texts.withColumn(out, canonical_text(train(texts, column))(F.col(column)))


def equal_looking(texts: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(spellings, members) of texts that look the same but differ in code points.

    spellings (form, spelling) holds each distinct spelling, as a digest, of every form that has several; members (form,
    spelling, id) names the texts of each. Rows with a null key or text are left out.
    """
    rows = texts.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).alias("_t"))
    digests = canonicalize(rows, "_t", "_c").select("id", F.sha2("_c", 256).alias("form"), F.sha2("_t", 256).alias("spelling"))
    digests = materialize(digests, "forms")
    several = digests.groupBy("form").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("form")
    members = digests.join(several, "form", "left_semi").distinct()
    return members.select("form", "spelling").distinct(), members


def equal_looking_pairs(members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of texts of one form in different spellings.

    Spellings of a form are paired first and their texts joined to them, so copies of one spelling never meet each other.
    """
    spellings = members.select("form", "spelling").distinct()
    both = spellings.withColumnRenamed("spelling", "sp_a").join(spellings.withColumnRenamed("spelling", "sp_b"), "form").where("sp_a < sp_b")
    a = members.select("form", F.col("spelling").alias("sp_a"), F.col("id").alias("x"))
    b = members.select("form", F.col("spelling").alias("sp_b"), F.col("id").alias("y"))
    return both.join(a, ["form", "sp_a"]).join(b, ["form", "sp_b"]).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
