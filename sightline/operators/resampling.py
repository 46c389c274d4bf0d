"""Bootstrap intervals with seeds that depend on the group's name alone, so that a rerun gives the same numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_M = 1 << 32


def seed_of(name: str) -> int:
    """FNV-1a over the code points of a name in 32 bits; never 0."""
    h = 2166136261
    for c in name:
        h = (h ^ ord(c)) * 16777619 % _M
    return h or 0x6D2B79F5


def draws(seed: int, count: int) -> np.ndarray:
    """`count` numbers in [0, 1) of the congruential generator s' = 1664525 s + 1013904223 mod 2^32, computed in jumps of doubling length."""
    a, c = 1664525, 1013904223
    out = np.empty(count, np.uint64)
    if count:
        out[0] = (seed * a + c) % _M
    filled, ja, jc = 1, a, c
    while filled < count:
        take = min(filled, count - filled)
        out[filled : filled + take] = (out[:take] * np.uint64(ja) + np.uint64(jc)) % np.uint64(_M)
        filled += take
        ja, jc = ja * ja % _M, (ja * jc + jc) % _M
    return out / _M


def mean_interval(values: np.ndarray, name: str, resamples: int = 1000) -> tuple[float, float]:
    """95 % percentile interval of the mean over resamples, at the floor and ceiling places of the ends."""
    n = len(values)
    picks = (draws(seed_of(name), resamples * n) * n).astype(np.int64).reshape(resamples, n)
    means = np.sort(values[picks].sum(axis=1) / n)
    return float(means[int((resamples - 1) * 0.025)]), float(means[-int(-((resamples - 1) * 0.975) // 1)])


def bootstrap_means(units: DataFrame, group: str, unit: str, value: str, resamples: int = 1000, most_units: int = 2_000_000) -> DataFrame:
    """(group, units, mean, lower, upper): mean of a value over a group's units with its bootstrap interval.

    A resample draws as many units as the group has, in the order of their names, so a group's units go to one task; a group
    of more than `most_units` is refused (its interval would be narrower than rounding). Null values are left out.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["v"]).sort_values("u")
        v = rows["v"].to_numpy(float)
        if len(v) > most_units:
            raise ValueError(f"a group has {len(v)} units; resampling takes up to {most_units}")
        if not len(v):
            return pd.DataFrame(columns=["g", "units", "mean", "lower", "upper"])
        # long groups are drawn in slices of resamples, which gives the same numbers
        lower, upper = mean_interval(v, str(key[0]), resamples) if len(v) * resamples <= 20_000_000 else _sliced(v, str(key[0]), resamples)
        return pd.DataFrame([(str(key[0]), len(v), v.sum() / len(v), lower, upper)], columns=["g", "units", "mean", "lower", "upper"])

    plain = units.where(f"{group} IS NOT NULL").selectExpr(f"CAST({group} AS STRING) AS g", f"CAST({unit} AS STRING) AS u", f"CAST({value} AS DOUBLE) AS v")
    return plain.groupBy("g").applyInPandas(run, "g STRING, units BIGINT, mean DOUBLE, lower DOUBLE, upper DOUBLE").withColumnRenamed("g", group)


def _sliced(values: np.ndarray, name: str, resamples: int) -> tuple[float, float]:
    n, state, means = len(values), seed_of(name), np.empty(resamples)
    for k in range(resamples):
        u = draws(state, n)
        state = int(round(u[-1] * _M))
        means[k] = values[(u * n).astype(np.int64)].sum() / n
    means.sort()
    return float(means[int((resamples - 1) * 0.025)]), float(means[-int(-((resamples - 1) * 0.975) // 1)])


def sparse_interval(changes: np.ndarray, total: int, name: str, resamples: int = 1000) -> tuple[float, float] | None:
    """95 % interval of the mean of `total` units of which only the first have a value and the others 0; null below 2 units or 250 resamples."""
    if total < 2 or len(changes) > total or resamples < 250:
        return None
    state, means = seed_of(name), np.empty(resamples)
    for k in range(resamples):
        u = draws(state, total)
        state = int(round(u[-1] * _M))
        at = (u * total).astype(np.int64)
        means[k] = changes[at[at < len(changes)]].sum() / total
    means.sort()
    return float(means[int((resamples - 1) * 0.025)]), float(means[-int(-((resamples - 1) * 0.975) // 1)])


def bootstrap_sparse(changes: DataFrame, group: str, unit: str, value: str, total: int, resamples: int = 1000) -> DataFrame:
    """(group, units, mean, lower, upper) of a change over `total` units of which only those listed for a group have one other than 0.

    The listed units, in the order of their names, are the first of the `total`. A group goes to one task, which holds its listed changes.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.dropna(subset=["v"]).sort_values("u")["v"].to_numpy(float)
        lower, upper = sparse_interval(v, total, str(key[0]), resamples) or (None, None)
        return pd.DataFrame([(str(key[0]), len(v), v.sum() / total if total else None, lower, upper)], columns=["g", "units", "mean", "lower", "upper"])

    plain = changes.where(f"{group} IS NOT NULL").selectExpr(f"CAST({group} AS STRING) AS g", f"CAST({unit} AS STRING) AS u", f"CAST({value} AS DOUBLE) AS v")
    return plain.groupBy("g").applyInPandas(run, "g STRING, units BIGINT, mean DOUBLE, lower DOUBLE, upper DOUBLE").withColumnRenamed("g", group)


def _herfindahl(weights: np.ndarray, unit: np.ndarray, item: np.ndarray, count: np.ndarray, items: int) -> float:
    totals = np.bincount(item, weights=weights[unit] * count, minlength=items)
    whole = totals.sum()
    return float((totals * totals).sum() / (whole * whole)) if whole else np.nan


def bootstrap_concentration(rows: DataFrame, group: str, unit: str, item: str, side: str | None = None, sides: tuple[str, str] = ("before", "after"), resamples: int = 1000) -> DataFrame:
    """(group, units, value, lower, upper): the Herfindahl index of a group's items with its interval over resampled units.

    With `side` the value is the change of the index from the first of `sides` to the second, over the units that both have, and a
    resample takes the same units on both. Resamples without any event are left out; null values and units are too. A group goes to one task.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if side:
            both = part.groupby("u")["s"].nunique()
            part = part[part["u"].isin(both[both == 2].index)]
        names, unit_no = np.unique(part["u"].to_numpy(str), return_inverse=True)
        found, item_no = np.unique(part["i"].to_numpy(str), return_inverse=True)
        n, count, where = len(names), part["n"].to_numpy(float), part["s"].to_numpy(str)

        def value(weights: np.ndarray) -> float:
            each = [_herfindahl(weights, unit_no[m], item_no[m], count[m], len(found)) for m in ((where == s for s in sides) if side else [np.ones(len(part), bool)])]
            return each[1] - each[0] if side else each[0]

        if not n:
            return pd.DataFrame(columns=["g", "units", "value", "lower", "upper"])
        state, values = seed_of(str(key[0])), np.empty(resamples)
        for k in range(resamples):
            u = draws(state, n)
            state = int(round(u[-1] * _M))
            values[k] = value(np.bincount((u * n).astype(np.int64), minlength=n).astype(float))
        values = np.sort(values[~np.isnan(values)])
        lower, upper = (values[int((len(values) - 1) * 0.025)], values[-int(-((len(values) - 1) * 0.975) // 1)]) if len(values) else (None, None)
        return pd.DataFrame([(str(key[0]), n, value(np.ones(n)), lower, upper)], columns=["g", "units", "value", "lower", "upper"])

    counts = rows.where(f"{group} IS NOT NULL AND {unit} IS NOT NULL AND {item} IS NOT NULL").selectExpr(f"CAST({group} AS STRING) AS g", f"CAST({unit} AS STRING) AS u", f"CAST({item} AS STRING) AS i", f"CAST({side or repr('')} AS STRING) AS s").groupBy("g", "u", "i", "s").count().withColumnRenamed("count", "n")
    return counts.groupBy("g").applyInPandas(run, "g STRING, units BIGINT, value DOUBLE, lower DOUBLE, upper DOUBLE").withColumnRenamed("g", group)


def mixed_draws(seed: int, count: int) -> np.ndarray:
    """`count` numbers in [0, 1) of the mulberry generator: a counter in steps of 0x6D2B79F5, mixed by two multiplications mod 2^32."""
    v = (np.uint64(seed % _M) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5)).astype(np.uint32)
    with np.errstate(over="ignore"):
        m = (v ^ (v >> np.uint32(15))) * (v | np.uint32(1))
        m = m ^ (m + (m ^ (m >> np.uint32(7))) * (m | np.uint32(61)))
    return (m ^ (m >> np.uint32(14))) / _M


def nearest_rank(ordered: np.ndarray, probability: float) -> float | None:
    """The value at the nearest rank of sorted values; null without any."""
    n = len(ordered)
    return float(ordered[min(n - 1, max(0, -int(-(probability * n) // 1) - 1))]) if n else None


def bootstrap_strata(strata: DataFrame, group: str, stratum: str, value: str, seed: int = 1, resamples: int = 1000) -> DataFrame:
    """(group, strata, mean, lower, upper): mean of a difference over strata, with nearest-rank 95 % interval of resampled strata by mixed_draws."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.dropna(subset=["v"]).sort_values("u")["v"].to_numpy(float)
        if not len(v):
            return pd.DataFrame(columns=["g", "strata", "mean", "lower", "upper"])
        picks = (mixed_draws(seed, resamples * len(v)) * len(v)).astype(np.int64).reshape(resamples, len(v))
        means = np.sort(v[picks].mean(axis=1))
        return pd.DataFrame([(str(key[0]), len(v), v.mean(), nearest_rank(means, 0.025), nearest_rank(means, 0.975))], columns=["g", "strata", "mean", "lower", "upper"])

    plain = strata.where(f"{group} IS NOT NULL").selectExpr(f"CAST({group} AS STRING) AS g", f"CAST({stratum} AS STRING) AS u", f"CAST({value} AS DOUBLE) AS v")
    return plain.groupBy("g").applyInPandas(run, "g STRING, strata BIGINT, mean DOUBLE, lower DOUBLE, upper DOUBLE").withColumnRenamed("g", group)
