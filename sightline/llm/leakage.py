"""Evaluation texts leaking into training text: a positional inverted index, intersected from the rarest terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.lookalikes import words
from sightline.session import materialize, small

#: Consecutive words of an item that make a leak.
PASSAGE = 12


#: Rarest words of a passage that must stand at their places before its other words are looked at.
RAREST = 4
#: Texts handed back at once by a Python worker, which bounds the words it holds.
_CHUNK = 256


class _Terms(dict):
    """Words to 64-bit hashes, each computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        code = xxhash.xxh64_intdigest(word)
        self[word] = code = code - (1 << 64) if code >> 63 else code
        return code


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos, term): the words of each text in order, without case and differences that can't be seen."""
    codes = _Terms()
    for batch in batches:
        for start in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(start, _CHUNK)
            lists = [words(t) for t in part.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            total = int(sizes.sum())
            terms = np.fromiter((codes[w] for one in lists for w in one), np.int64, total)
            pos = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(pos.astype(np.int32)), pa.array(terms)], names=["id", "pos", "term"])


def terms(texts: DataFrame, key: str, text: str, id_name: str) -> DataFrame:
    """(id_name, pos, term) of every word, the term as a 64-bit hash. Rows with a null key or text have none."""
    plain = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
    return plain.mapInArrow(_term_rows, "id BIGINT, pos INT, term BIGINT").withColumnRenamed("id", id_name)


class PositionalIndex:
    """Postings (term, doc_id, pos) in segments: each written partition of documents is a segment, sorted by term.

    Segments need no shuffle to build and add() appends further ones; a lookup reads the row groups whose term range
    meets the terms asked for. An index with a vocabulary (a table of terms) keeps the postings of these terms only: what
    a fixed set of items can ask for.
    """

    def __init__(self, spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> None:
        self.spark, self.path = spark, path
        self.vocabulary = None if vocabulary is None else _hint(materialize(vocabulary.select("term").distinct(), "vocabulary"), 40)

    def add(self, documents: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Indexes documents; null texts have no postings. Keys already in the index are not checked."""
        rows = terms(documents, key, text, "doc_id").select("term", "doc_id", "pos")
        if self.vocabulary is not None:
            rows = rows.join(self.vocabulary, "term", "left_semi")
        rows.sortWithinPartitions("term", "doc_id", "pos").write.mode("append").parquet(self.path)

    def postings(self) -> DataFrame:
        return self.spark.read.schema("term BIGINT, doc_id BIGINT, pos INT").parquet(self.path)


def _hint(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, a written table, with a broadcast hint if a count shows it small."""
    return F.broadcast(df) if small(df, row_bytes) else df


def anchors(items: DataFrame, frequency: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(item_id, pos, term, others): the rarest word of each passage of each item, and the next rarest ones as (pos, term).

    `items` has item_id, pos, term; `frequency` term, df. Passages with a word that no document has are left out.
    """
    known = items.join(frequency, "term", "left")
    ahead = Window.partitionBy("item_id").orderBy("pos").rowsBetween(0, passage - 1)
    windows = known.withColumn("found", F.count("df").over(ahead)).withColumn("r", F.array_sort(F.collect_list(F.struct("df", "pos", "term")).over(ahead)))
    rare = windows.where((F.col("found") == passage) & (F.size("r") == passage))
    others = F.transform(F.slice("r", 2, RAREST - 1), lambda x: F.struct(x["pos"].alias("pos"), x["term"].alias("term")))
    return rare.select("item_id", F.col("r")[0]["pos"].alias("pos"), F.col("r")[0]["term"].alias("term"), others.alias("others")).distinct()


def exact_passages(index: PositionalIndex, item_texts: DataFrame, passage: int = PASSAGE, item_terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, longest, doc_pos, item_pos): documents that hold `passage` or more consecutive words of an item.

    `item_texts` has item_id and text; `item_terms`, if given, is its written terms(). The postings of each passage's rarest word propose an alignment of item and
    document; the lists of its next rarest words, moved by their offsets, must hold the place too; the alignments left are
    intersected with the lists of all words of the item, read for their documents only, and runs of `passage` consecutive hits are
    leaks. One row a document and item with its longest run, the first of equals. Items of fewer words have none; null texts have no words.
    """
    item_terms = materialize(terms(item_texts, "item_id", "text", "item_id"), "item-terms") if item_terms is None else item_terms
    wanted = _hint(materialize(item_terms.select("term").distinct(), "wanted"), 40)
    frequency = index.postings().join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = materialize(anchors(item_terms, frequency, passage), "anchors")

    starts = _hint(rare.select("item_id", F.col("pos").alias("item_pos"), "term", "others"), 160)
    hits = index.postings().join(starts, "term").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift"), "others")
    places = hits.select("doc_id", "item_id", "shift", F.xxhash64("others").alias("anchor"), F.size("others").alias("needed"), F.explode("others").alias("o"))
    places = places.select("doc_id", "item_id", "shift", "anchor", "needed", (F.col("shift") + F.col("o.pos")).alias("pos"), F.col("o.term").alias("term"))
    other_terms = _hint(materialize(rare.select(F.explode("others").alias("o")).select("o.term").distinct(), "other-terms"), 40)
    held = places.join(index.postings().join(other_terms, "term", "left_semi"), ["doc_id", "pos", "term"])
    full = held.groupBy("doc_id", "item_id", "shift", "anchor", "needed").agg(F.count("*").alias("n")).where("n >= needed") if passage > 1 else hits
    aligned = materialize(full.select("doc_id", "item_id", "shift").distinct(), "alignments")

    expected = aligned.join(_hint(item_terms.withColumnRenamed("pos", "item_pos"), 64), "item_id").withColumn("pos", F.col("shift") + F.col("item_pos")).where("pos >= 0")
    documents = _hint(materialize(aligned.select("doc_id").distinct(), "aligned-documents"), 40)
    lists = index.postings().join(documents, "doc_id", "left_semi")
    met = expected.join(lists, ["doc_id", "pos", "term"]).select("doc_id", "item_id", "shift", "item_pos").distinct()
    line = Window.partitionBy("doc_id", "item_id", "shift").orderBy("item_pos")
    runs = met.withColumn("run", F.col("item_pos") - F.row_number().over(line)).groupBy("doc_id", "item_id", "shift", "run").agg(F.count("*").alias("n"), F.min("item_pos").alias("first"))
    best = runs.where(F.col("n") >= passage).groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("back"), (-F.col("shift")).alias("unshift"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("longest"), (-F.col("b.unshift") - F.col("b.back")).cast("int").alias("doc_pos"), (-F.col("b.back")).cast("int").alias("item_pos"))


def _widest(pos: list[int], term: list[int], window: int) -> tuple[int, int]:
    """(most different terms within `window` consecutive places, the first start of so many) of a list of hits in order."""
    held: dict[int, int] = {}
    best, at, end = 0, -1, 0
    for start, term_out in enumerate(term):
        while end < len(pos) and pos[end] - pos[start] < window:
            held[term[end]] = held.get(term[end], 0) + 1
            end += 1
        if len(held) > best:
            best, at = len(held), pos[start]
        held[term_out] -= 1
        if not held[term_out]:
            del held[term_out]
    return best, at


def _near_items(items: list[tuple[int, int]], window: int, least: int):
    """mapInArrow function: postings in order of documents to (doc_id, item_id, terms_met, doc_pos); `items` lists (term, item_id)."""
    listed = np.array(sorted(items), dtype=np.int64).reshape(-1, 2)
    known, first = np.unique(listed[:, 0], return_index=True)
    starts, owners = np.append(first, len(listed)), listed[:, 1]

    def search(doc: np.ndarray, pos: np.ndarray, term: np.ndarray) -> list[tuple[int, int, int, int]]:
        at = np.searchsorted(known, term)
        keep = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == term)
        doc, pos, at = doc[keep], pos[keep], at[keep]
        # each hit once for every item that has its word
        n = starts[at + 1] - starts[at]
        hit = np.repeat(np.arange(len(at)), n)
        item = owners[np.repeat(starts[at], n) + np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((pos[hit], item, doc[hit]))
        d, i, p, t = doc[hit][order], item[order], pos[hit][order], at[hit][order]
        k = least - 1
        close = np.flatnonzero((d[k:] == d[: len(d) - k]) & (i[k:] == i[: len(i) - k]) & (p[k:] - p[: len(p) - k] < window)) if len(d) > k else np.array([], int)
        if not len(close):
            return []
        # stretches of hits in which windows of enough hits overlap; only these are slid over
        apart = np.flatnonzero((close[1:] > close[:-1] + k) | (d[close[1:]] != d[close[:-1]]) | (i[close[1:]] != i[close[:-1]])) + 1
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b in zip(close[np.append(0, apart)].tolist(), (close[np.append(apart, len(close)) - 1] + k + 1).tolist()):
            # later hits may still lie in the last window
            while b < len(d) and d[b] == d[a] and i[b] == i[a] and p[b] - p[b - 1] < window:
                b += 1
            n, at = _widest(p[a:b].tolist(), t[a:b].tolist(), window)
            if n >= least:
                key = (int(d[a]), int(i[a]))
                best[key] = max(best.get(key, (n, -at)), (n, -at))
        return [(*key, n, -back) for key, (n, back) in best.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            part = [batch.column(k).to_numpy() for k in range(3)]
            rest = part if rest is None else [np.concatenate(two) for two in zip(rest, part)]
            while rest is not None and len(rest[0]) > _HITS:
                # whole documents only: cut where a document ends, at or after so many hits
                cut = int(np.searchsorted(rest[0], rest[0][_HITS], side="left")) or int(np.searchsorted(rest[0], rest[0][0], side="right"))
                if cut >= len(rest[0]):
                    break
                yield _found_batch(search(*[x[:cut] for x in rest]))
                rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield _found_batch(search(*rest))

    return run


#: Hits of whole documents that are looked at together.
_HITS = 20_000
#: Words of items that are sent to the executors at once; more items are looked for in blocks of so many.
BLOCK_WORDS = 2_000_000


def _found_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "terms_met", "doc_pos"])


def proximity_matches(index: PositionalIndex, item_texts: DataFrame, window: int = 16, least: int = 10, item_terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, terms_met, doc_pos): documents where `least` different words of an item lie within `window` consecutive words, in any order.

    Finds passages with words inserted, left out, replaced or moved, which exact_passages cuts short, and finds all of them. The lists of the
    items' words are brought into the order of documents and places; each place counts for every item that has its word, and where `least`
    places of an item lie close together the window slides over the item's places in that document. One row a document and item: the
    most words met and the first place of so many. Items of fewer words have none. Items are sent out in blocks of
    BLOCK_WORDS words, each of which passes over the lists once.
    """
    item_terms = materialize(terms(item_texts, "item_id", "text", "item_id"), "item-terms") if item_terms is None else item_terms
    pairs = materialize(item_terms.select("term", "item_id").distinct(), "item-words")
    wanted = _hint(materialize(pairs.select("term").distinct(), "wanted"), 40)
    lists = index.postings().join(wanted, "term", "left_semi").select("doc_id", "pos", "term").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    blocks = max(1, -(-pairs.count() // BLOCK_WORDS))
    if blocks > 1:
        lists = materialize(lists, "document-lists").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    out = None
    for k in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        part = lists.mapInArrow(_near_items([(r.term, r.item_id) for r in own], window, least), "doc_id BIGINT, item_id BIGINT, terms_met INT, doc_pos INT") if own else None
        out = part if out is None else out if part is None else out.unionByName(part)
    return index.spark.createDataFrame([], "doc_id BIGINT, item_id BIGINT, terms_met INT, doc_pos INT") if out is None else out
