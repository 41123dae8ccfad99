"""Greedy groups over documents of any length: ordered folds whose next start follows from the start alone, worked out by blocks.

A group that begins at a unit ends before a unit that its start and the lengths after it decide. So each unit points to the next start,
were it one, which is at most `reach` units on. A document's units are dealt into blocks, each with the `reach` units after it.
Pointer doubling inside a block gives, for every unit where a group may enter it, where the chain leaves it and how many groups
begin on the way: a short row for each block. The rows of a document are followed from its first unit, one step a block, and then
every block marks its own starts. No task holds more of a document than a block of numbers, or one short row for each of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16


@dataclass(frozen=True)
class Fold:
    """next_start(lengths, alone): for each unit the first one after a group that begins there; at most reach units on."""

    next_start: Callable[[np.ndarray, np.ndarray], np.ndarray]
    reach: int


def short_units(least: int) -> Fold:
    """A group takes the next unit while it is shorter than least (units are joined by one character)."""

    def next_start(n: np.ndarray, alone: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(n + 1)])
        return np.maximum(np.searchsorted(ends, ends[:-1] + least + 1), np.arange(1, len(n) + 1))

    return Fold(next_start, least + 2)


def packed(longest: int) -> Fold:
    """A group takes the next unit while both are no longer than longest together; a longer unit is a group of its own. No unit is empty."""

    def next_start(n: np.ndarray, alone: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(n)])
        return np.maximum(np.searchsorted(ends, ends[:-1] + longest, "right") - 1, np.arange(1, len(n) + 1))

    return Fold(next_start, longest + 1)


def short_lines(short: int) -> Fold:
    """A group takes the next unit while both are shorter than short; units marked alone are groups of their own. No unit is empty."""

    def next_start(n: np.ndarray, alone: np.ndarray) -> np.ndarray:
        ends, at = np.concatenate([[0], np.cumsum(n)]), np.arange(1, len(n) + 1)
        stops = np.append(np.flatnonzero(alone | (n >= short)), len(n))
        full = np.searchsorted(ends, ends[:-1] + short)
        return np.where(alone, at, np.maximum(np.minimum(full, stops[np.searchsorted(stops, at)]), at))

    return Fold(next_start, short + 1)


def grouped(units: DataFrame, keys: list[str], fold: Fold, order: str = "i", length: str = "n", alone: str | None = None, block: int = BLOCK) -> DataFrame:
    """keys, order and group (from 0): of each unit of the documents named by keys, in the order of `order`, 0, 1, 2 and so on without gaps.

    Lengths must not be null. Other columns are not read.
    """
    reach, next_start = fold.reach, fold.next_start
    if block < reach:
        raise ValueError("a block must be no shorter than the fold reaches")
    own = F.floor(F.col(order) / block)
    marked = F.lit(False) if alone is None else F.coalesce(F.col(alone), F.lit(False))
    # the first units of a block are the reach of the block before
    blocks = F.when((F.col(order) >= block) & (F.col(order) % block < reach), F.array(own, own - 1)).otherwise(F.array(own))
    rows = units.select(*keys, F.col(order).cast("long").alias("_i"), F.col(length).cast("long").alias("_n"), marked.alias("_alone"), F.explode(blocks).alias("_b"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)

    def pointers(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, int]:
        part = part.sort_values("_i")
        mine = int((part["_i"] < (part["_b"].iloc[0] + 1) * block).sum())
        return part, next_start(part["_n"].to_numpy(np.int64), part["_alone"].to_numpy(bool)), mine

    def through(part: pd.DataFrame) -> pd.DataFrame:
        part, to, mine = pointers(part)
        count = np.ones(mine, np.int64)
        to = to[:mine].copy()
        while (inside := to < mine).any():
            count[inside], to[inside] = count[inside] + count[to[inside]], to[to[inside]]
        entries = min(mine, reach + 1 if part["_b"].iloc[0] else 1)
        return pd.DataFrame({**{k: part[k].iloc[:1] for k in keys}, "_b": part["_b"].iloc[:1], "_exits": [(to[:entries] - mine).tolist()], "_counts": [count[:entries].tolist()]})

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        entry, base, out = 0, 0, []
        for b, exits, counts in part.sort_values("_b")[["_b", "_exits", "_counts"]].itertuples(index=False):
            out.append((b, entry, base))
            if entry < len(exits):
                base, entry = base + int(counts[entry]), int(exits[entry])
        found = pd.DataFrame(out, columns=["_b", "_entry", "_base"])
        for k in reversed(keys):
            found.insert(0, k, part[k].iloc[0])
        return found

    def mark(part: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if part.empty:
            return pd.DataFrame({**{k: [] for k in keys}, order: [], "group": []})
        part, to, mine = pointers(part)
        starts, at = np.zeros(mine, np.int64), int(entry["_entry"].iloc[0])
        while at < mine:
            starts[at], at = 1, to[at]
        part = part.iloc[:mine]
        return pd.DataFrame({**{k: part[k] for k in keys}, order: part["_i"], "group": int(entry["_base"].iloc[0]) + np.cumsum(starts) - 1})

    passed = rows.groupBy(*keys, "_b").applyInPandas(through, f"{named}, _b bigint, _exits array<bigint>, _counts array<bigint>")
    entries = passed.groupBy(*keys).applyInPandas(follow, f"{named}, _b bigint, _entry bigint, _base bigint")
    by = [*keys, "_b"]
    return rows.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(mark, f"{named}, `{order}` bigint, group bigint")
