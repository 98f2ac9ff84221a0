"""Filling fixed-capacity containers: minimum bin slack over the histogram of sizes.

Only sizes matter for packing, so the corpus is reduced to a histogram (at most ``capacity`` sizes) that is
packed on the driver whatever the number of documents; each filling pattern found there is repeated as often
as the remaining counts allow. The documents then look up their container by (size, rank within size).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: items of one size are ranked in so many independent groups, so that a hot size is no single task
RANK_GROUPS = 16


def fill_window(left: int, sizes: list[int], counts: dict[int, int]) -> dict[int, int]:
    """Counts of sizes that sum as close to ``left`` as possible without passing it.

    Bitset subset-sum over the remaining multiset, large sizes first: bit j of ``reach`` says that j can be
    filled. Counts are split in powers of two; the bitset before each step is kept to backtrack.
    """
    full = (1 << (left + 1)) - 1
    goal, reach = 1 << left, 1
    steps: list[tuple[int, int, int]] = []
    for s in sizes:
        if s > left:
            continue
        n, k = min(counts[s], left // s), 1
        while n > 0:
            k = min(k, n)
            grown = (reach | reach << (s * k)) & full
            if grown != reach:
                steps.append((s, k, reach))
                reach = grown
            n -= k
            k *= 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    out: dict[int, int] = {}
    for s, k, before in reversed(steps):
        if not before >> at & 1:
            out[s] = out.get(s, 0) + k
            at -= s * k
    return out


def fill_largest(left: int, sizes: list[int], counts: dict[int, int]) -> dict[int, int]:
    """Counts of sizes that first fit decreasing puts into a window: always the largest that still fits."""
    out = {}
    for s in sizes:
        if k := min(counts[s], left // s):
            out[s] = k
            left -= s * k
    return out


def _packed(counts: dict[int, int], capacity: int, fill: Callable) -> list[tuple[int, dict[int, int]]]:
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left, reverse=True)
    out = []
    while sizes:
        first = sizes[0]
        left[first] -= 1
        pattern = fill(capacity - first, sizes, left)
        left[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(left[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= times * k
        out.append((times, pattern))
        sizes = [s for s in sizes if left[s]]
    return out


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(repetitions, {size: count}) of containers that hold each item of the histogram exactly once.

    The largest remaining size opens a window and minimum slack fills it. Every pattern is repeated until
    one of its sizes runs out, so there are no more patterns than twice the number of sizes. Where small sizes are so
    few that spending them early costs containers, first fit decreasing needs fewer, and is taken.
    """
    if any(n > 0 and not 0 < s <= capacity for s, n in counts.items()):
        raise ValueError("sizes must lie between 1 and the capacity")
    best = _packed(counts, capacity, fill_window)
    plain = _packed(counts, capacity, fill_largest)
    used = lambda x: sum(n for n, _ in x)
    return plain if used(plain) < used(best) else best


def items(counts: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(target_id, capacity, key, piece, size): documents per target, cut only if they exceed the capacity.

    A document over the capacity gives full pieces and one rest, numbered from 0. ``counts`` holds positive
    sizes; texts without any token count as one.
    """
    n, cap = F.greatest(F.col(size), F.lit(1)), F.col("capacity_tokens")
    pieces = F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / cap).cast("int"))
    return (
        counts.select(key, n.alias("_n"))
        .join(F.broadcast(targets.select("target_id", "capacity_tokens")))  # one row per target: a handful
        .select("target_id", "capacity_tokens", key, "_n", F.explode(pieces).alias("piece"))
        .select("target_id", "capacity_tokens", key, "piece", F.least(cap, F.col("_n") - F.col("piece") * cap).cast("int").alias("size"))
    )


def pack(counts: DataFrame, targets: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Containers of all documents for each target.

    ``counts`` has one row per document (key, size in tokens); ``targets`` has target_id, capacity_tokens (> 0).
    Returns (target_id, container, place, key, piece, size): containers and places count from 0 within a
    target. Documents without target, or an empty table, give no rows. Equal sizes are ranked by key.
    """
    it = items(counts, targets, key, size).withColumn("g", F.pmod(F.xxhash64(key, "piece"), F.lit(RANK_GROUPS)).cast("int"))
    caps = {r[0]: r[1] for r in targets.select("target_id", "capacity_tokens").distinct().collect()}
    if any(c is None or c <= 0 for c in caps.values()):
        raise ValueError("capacity_tokens must be positive")
    # at most RANK_GROUPS x capacity rows a target reach the driver
    hist = it.groupBy("target_id", "size", "g").agg(F.count(F.lit(1)).alias("n")).toPandas()
    place = _Placement(hist, caps)
    schema = T.StructType([
        T.StructField("target_id", targets.schema["target_id"].dataType), T.StructField("container", T.LongType()),
        T.StructField("place", T.IntegerType()), counts.schema[key], T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()),
    ])
    shared = it.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            container, where = shared.value(b["target_id"].to_numpy(), b["size"].to_numpy(), b["g"].to_numpy(), b["r"].to_numpy())
            yield pd.DataFrame({"target_id": b["target_id"], "container": container, "place": where, key: b[key], "piece": b["piece"], "size": b["size"]})

    ranked = it.withColumn("r", F.row_number().over(W.partitionBy("target_id", "size", "g").orderBy(key, "piece")) - 1)
    return ranked.select("target_id", "size", "g", "r", key, "piece").mapInPandas(run, schema)


class _Placement:
    """Container and place of an item from its target, size, rank group and rank in the group.

    Holds one row per (target, pattern, size): bounded by the capacities, not by the documents.
    """

    def __init__(self, hist: pd.DataFrame, caps: dict[int, int]) -> None:
        self.ids = np.array(sorted(caps), dtype=np.int64)
        self.width = max(caps.values(), default=1) + 1
        offset = np.zeros((len(self.ids) * self.width, RANK_GROUPS), np.int64)
        starts, first, each, base = [], [], [], []
        for t, target in enumerate(self.ids):
            h = hist[hist.target_id == target]
            offset[t * self.width + h["size"].to_numpy(), h["g"].to_numpy()] = h["n"].to_numpy()
            used: dict[int, int] = {}
            container = 0
            for times, pattern in pack_histogram(h.groupby("size")["n"].sum().to_dict(), caps[target]):
                at = 0
                for s, k in sorted(pattern.items(), reverse=True):
                    starts.append((t * self.width + s, used.get(s, 0)))
                    first.append(container), each.append(k), base.append(at)
                    used[s] = used.get(s, 0) + times * k
                    at += k
                container += times
        self.offset = np.cumsum(offset, axis=1) - offset
        order = sorted(range(len(starts)), key=starts.__getitem__)
        self.code = np.array([(starts[i][0] << 40) + starts[i][1] for i in order], np.int64)
        self.first, self.each, self.base = (np.array([x[i] for i in order], np.int64) for x in (first, each, base))

    def __call__(self, target, size, group, rank):
        row = np.searchsorted(self.ids, target) * self.width + size.astype(np.int64)
        code = (row << 40) + self.offset[row, group] + rank
        i = np.searchsorted(self.code, code, side="right") - 1
        past = code - self.code[i]
        return self.first[i] + past // self.each[i], (self.base[i] + past % self.each[i]).astype(np.int32)
