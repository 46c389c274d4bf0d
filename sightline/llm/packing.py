"""Filling fixed-capacity sequences with texts: several context sizes, gaps of long ones filled with short texts, balanced steps."""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import materialize

#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Largest vocabulary file that is sent along with a function.
MOST_VOCABULARY = 16 << 20
#: Context sizes in tokens; the last is the sequence length that longer texts are cut to.
TIERS = (1024, 4096, 16384)
#: Items of one shard; a shard is packed by one task.
SHARD_ITEMS = 20_000


def token_counter(vocabulary: str = VOCABULARY):
    """Arrow function: the number of tokens of each text under a byte-level vocabulary file; null for null.

    The file is read where the query is planned and goes to the executors with the function, about a megabyte, so they need no copy of it.
    """
    with open(vocabulary, "rb") as f:
        content = f.read()
    if len(content) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes is no tokenizer's")

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield batch.map(lambda t: len(encoding.encode_ordinary(t)) if isinstance(t, str) else None).astype("Int64")

    return count


def pack_items(lengths: list[int], tiers: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """(capacity, item numbers in order) of each sequence: every item once, none cut.

    From the largest tier down, a tier's own items (those too long for the next smaller tier) are placed best fit, longest
    first; then each sequence's gap takes, again and again, the longest shorter item that fits.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    rest = [(lengths[i], i) for i in order]  # ascending; shrinks as items are placed
    out = []
    for k in range(len(tiers) - 1, -1, -1):
        capacity, below = tiers[k], tiers[k - 1] if k else 0
        cut = bisect_right(rest, (below, float("inf")))
        own, rest = rest[cut:], rest[:cut]
        bins: list[list[int]] = []
        gaps: list[tuple[int, int]] = []  # (gap, bin), ascending
        for length, i in reversed(own):
            at = bisect_left(gaps, (length, -1))
            if at < len(gaps):
                gap, b = gaps.pop(at)
            else:
                gap, b = capacity, len(bins)
                bins.append([])
            bins[b].append(i)
            if gap > length:
                insort(gaps, (gap - length, b))
        taken = [False] * len(rest)
        # next free item at or below each place, with path halving
        free = list(range(len(rest) + 1))

        def find(p: int, free: list[int] = free) -> int:
            while free[p] != p:
                free[p] = free[free[p]]
                p = free[p]
            return p

        for gap, b in reversed(gaps):
            while rest and gap >= rest[0][0]:
                p = find(bisect_right(rest, (gap, float("inf"))))
                if p == 0:
                    break
                length, i = rest[p - 1]
                taken[p - 1] = True
                free[p] = p - 1
                bins[b].append(i)
                gap -= length
        rest = [x for x, t in zip(rest, taken) if not t]
        out += [(capacity, b) for b in bins]
    return out


def step_groups(used: list[int], group: int) -> list[int]:
    """The step of each sequence: dealt to and fro by falling fill, so that steps of `group` sequences hold about as many tokens."""
    steps = max(1, -(-len(used) // group))
    out = [0] * len(used)
    for rank, i in enumerate(sorted(range(len(used)), key=lambda i: (-used[i], i))):
        lap, place = divmod(rank, steps)
        out[i] = place if lap % 2 == 0 else steps - 1 - place
    return out


_PACKED = "id BIGINT, piece INT, piece_start BIGINT, n_tokens BIGINT, capacity INT, sequence_id STRING, sequence_offset BIGINT, step_id STRING"


def _shard_packer(tiers: tuple[int, ...], group: int):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["id", "piece"], ignore_index=True)
        lengths = items["n_tokens"].tolist()
        packed = pack_items(lengths, tiers)
        rows = []
        for capacity in tiers:
            own = [content for c, content in packed if c == capacity]
            steps = step_groups([sum(lengths[i] for i in content) for content in own], group)
            for n, content in enumerate(own):
                offset = 0
                for i in content:
                    rows.append((i, capacity, f"{capacity}-{key[0]}-{n}", offset, f"{capacity}-{key[0]}-{steps[n]}"))
                    offset += lengths[i]
        placed = pd.DataFrame(rows, columns=["i", "capacity", "sequence_id", "sequence_offset", "step_id"])
        return items.loc[placed["i"], ["id", "piece", "piece_start", "n_tokens"]].reset_index(drop=True).join(placed.drop(columns="i"))

    return run


def pack(documents: DataFrame, key: str, text: str, tiers: tuple[int, ...] = TIERS, group: int = 8, vocabulary: str = VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Packs texts into sequences of the tiers' capacities: one row a piece, with its sequence and step.

    Columns: id, piece, piece_start, n_tokens, capacity, sequence_id, sequence_offset, step_id. A text is one piece
    unless it is longer than the largest capacity, then it is cut every so many tokens. Null and empty texts take no
    space and have no row; rows are packed each by itself, so a repeated id comes back as often. Items are dealt by
    hash to shards of about `shard_items`, so no task grows with the corpus or with a frequent length.
    """
    top = tiers[-1]
    sized = documents.select(F.col(key).alias("id"), token_counter(vocabulary)(F.col(text)).alias("n")).where("n > 0")
    pieces = sized.select("id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(top).cast("bigint"))).alias("piece", "piece_start"), "n")
    items = materialize(pieces.select("id", "piece", "piece_start", F.least(F.lit(top).cast("bigint"), F.col("n") - F.col("piece_start")).alias("n_tokens")), "pieces")
    shards = max(1, -(-items.count() // shard_items))
    salted = items.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)))
    return salted.groupBy("shard").applyInPandas(_shard_packer(tiers, group), _PACKED)


def fill_rates(packed: DataFrame) -> DataFrame:
    """(capacity, sequences, pieces, tokens, fill): how full the sequences of each tier are."""
    return packed.groupBy("capacity").agg(F.countDistinct("sequence_id").alias("sequences"), F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens")).withColumn("fill", F.col("tokens") / (F.col("sequences") * F.col("capacity")))
