"""Mapping freely entered values to a reference list: a BK-tree over the entries under edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.lookalikes import plain_letters
from sightline.session import materialize, small

#: Entries of one shard of the reference list; each shard is a tree sent to the executors.
SHARD_ENTRIES = 20_000
#: Distinct texts that meet a shard in one task.
SHARD_TEXTS = 100_000
_ADDRESS = re.compile(r"(?i)\bhttps?:[^\s;,)\"'>\]]*")


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements of single characters between two texts, bit-parallel (Myers 1999)."""
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    return _scan(peq, len(a), b, False)[-1]


def _scan(peq: dict[str, int], m: int, text: str, anywhere: bool) -> list[int]:
    """The distance of the pattern to text[:j] for each j from 0, or with `anywhere` to the nearest ending at j."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, [m]
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 if anywhere else ph << 1 | 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
        out.append(score)
    return out


class BkTree:
    """Entries by edit distance: a child's key is its distance to the parent, so the triangle inequality prunes the search."""

    def __init__(self, entries: list[str]) -> None:
        self.root: list | None = None
        for e in entries:
            self._add(e)

    def _add(self, entry: str) -> None:
        if self.root is None:
            self.root = [entry, {}]
            return
        node = self.root
        while (d := edit_distance(entry, node[0])) != 0:
            if d not in node[1]:
                node[1][d] = [entry, {}]
                return
            node = node[1][d]

    def within(self, text: str, radius: int) -> list[tuple[int, str]]:
        """(distance, entry) of every entry within radius of the text."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            entry, children = open_nodes.pop()
            d = edit_distance(entry, text)
            if d <= radius:
                found.append((d, entry))
            open_nodes += [child for key, child in children.items() if d - radius <= key <= d + radius]
        return found


class PartFinder:
    """Parts of a text that lie within `radius` edits of some entry.

    An entry cut into radius + 1 pieces keeps one piece unchanged in any such part, so an automaton over the pieces
    proposes the places; aligning the entry around them gives its nearest part. Entries shorter than radius + 1 characters
    can't be cut and are aligned everywhere.
    """

    def __init__(self, entries: list[str], radius: int) -> None:
        import ahocorasick

        self.entries, self.radius = entries, radius
        self.peq = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.always = []
        for k, e in enumerate(entries):
            peq: dict[str, int] = {}
            for i, c in enumerate(e):
                peq[c] = peq.get(c, 0) | 1 << i
            self.peq.append(peq)
            if len(e) <= radius:
                self.always.append(k)
                continue
            cuts = [len(e) * j // (radius + 1) for j in range(radius + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                pieces.setdefault(e[lo:hi], []).append((k, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def parts(self, text: str) -> set[str]:
        spans: dict[int, list[tuple[int, int]]] = {}
        if len(self.automaton):
            for end, (n, at) in self.automaton.iter(text):
                for k, lo in at:
                    begin = end - n + 1 - lo
                    spans.setdefault(k, []).append((max(0, begin - self.radius), begin + len(self.entries[k]) + self.radius))
        for k in self.always:
            spans[k] = [(0, len(text))]
        found = set()
        for k, places in spans.items():
            m = len(self.entries[k])
            if not m:
                continue
            for lo, hi in set(places):
                area = text[lo:hi]
                scores = _scan(self.peq[k], m, area, True)
                best = min(scores)
                if best > self.radius:
                    continue
                for end, score in enumerate(scores):
                    if score == best:
                        starts = range(max(0, end - m - best), max(0, end - m + best) + 1)
                        found.add(next((area[s:end] for s in starts if s <= end and edit_distance(self.entries[k], area[s:end]) == best), ""))
        return found


class _Matcher:
    """The nearest entry of each text by tree search over the parts that may hold one."""

    def __init__(self, reference: list[tuple[str, str]], radius: int) -> None:
        import ahocorasick

        self.by_form: dict[str, str] = {}
        self.exact = ahocorasick.Automaton()
        for token, form in sorted(reference, reverse=True):
            self.by_form[form] = token
            self.exact.add_word(token.lower(), 1)
        self.exact.make_automaton()
        forms = sorted(self.by_form)
        self.tree, self.finder, self.radius = BkTree(forms), PartFinder(forms, radius), radius
        self.seen: dict[str, tuple[int, str] | None] = {}

    def nearest(self, text: str) -> tuple[str, str, int] | None:
        """(token, form, distance) of the nearest entry; distance -1 if the text holds an entry letter for letter, None without any."""
        if next(self.exact.iter(text.lower()), None) is not None:
            return "", "", -1
        best = None
        for part in self.finder.parts(plain_letters(_ADDRESS.sub(" ", text))):
            if part not in self.seen:
                if len(self.seen) > 200_000:
                    self.seen.clear()
                self.seen[part] = min(self.tree.within(part, self.radius), default=None)
            if self.seen[part] and (best is None or self.seen[part] < best):
                best = self.seen[part]
        return None if best is None else (self.by_form[best[1]], best[1], best[0])


_FOUND = "text STRING, token STRING, form STRING, distance INT"


def _matches(matcher: _Matcher, texts: pd.Series) -> pd.DataFrame:
    rows = [(t, *found) for t in texts if (found := matcher.nearest(t))]
    return pd.DataFrame(rows, columns=["text", "token", "form", "distance"])


def _forms(tokens: list[str]) -> list[tuple[str, str]]:
    return [(t, form) for t in tokens if (form := plain_letters(t))]


def nearest_entries(texts: DataFrame, column: str, reference: DataFrame, token: str, radius: int = 2) -> DataFrame:
    """(text, token, distance): distinct texts that hold no entry letter for letter, ignoring case, but a part within `radius` edits of one.

    Both are compared without case, spaces, punctuation and accents, look-alike and full-width letters read as plain ones,
    and addresses (http...) left out of the text. The nearest entry is taken, of equally near ones the first in that
    form. Null texts and entries are left out, as are entries without letters and digits. A reference list of up to
    SHARD_ENTRIES goes to the executors as one tree; a longer one is cut into shards by hash, each of which meets the texts in blocks
    of SHARD_TEXTS on the executors, and the shards' winners are merged; a text with an exact entry in any shard is no case.
    """
    entries = materialize(reference.where(F.col(token).isNotNull()).select(F.col(token).alias("token")).distinct(), "entries")
    shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
    if shards == 1:
        listed = _forms([r.token for r in entries.collect()])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _Matcher(listed, radius)
            for batch in batches:
                yield _matches(matcher, batch["text"])

        if not listed:
            return distinct.select("text", F.lit("").alias("token"), F.lit(0).alias("distance")).where(F.lit(False))
        return distinct.mapInPandas(run, _FOUND).where("distance >= 0").drop("form")

    distinct = materialize(distinct, "texts")
    blocks = max(1, -(-distinct.count() // SHARD_TEXTS))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = distinct.select("text", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("block"), every(shards, "shard"))
    right = entries.select("token", F.pmod(F.xxhash64("token"), F.lit(shards)).cast("int").alias("shard"), every(blocks, "block"))

    def meet(some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        listed = _forms(part["token"].tolist())
        return _matches(_Matcher(listed, radius), some["text"]) if listed else some.head(0).assign(token="", form="", distance=0)[["text", "token", "form", "distance"]]

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, _FOUND)
    best = found.groupBy("text").agg(F.min(F.struct("distance", "form", "token")).alias("b")).where("b.distance >= 0")
    return best.select("text", "b.token", "b.distance")


def map_rows(rows: DataFrame, key: str, column: str, reference: DataFrame, token: str, radius: int = 2) -> DataFrame:
    """(key, token): the rows whose text maps to an entry, each key once (of differing texts the nearest entry, then the first)."""
    found = materialize(nearest_entries(rows, column, reference, token, radius), "nearest")
    found = F.broadcast(found) if small(found, 400) else found
    joined = rows.select(F.col(key), F.col(column).alias("text")).join(found, "text")
    return joined.groupBy(key).agg(F.min(F.struct("distance", "token")).alias("b")).select(key, "b.token")
