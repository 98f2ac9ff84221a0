"""Capping the records of dominant contributors (water-filling over contributor counts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: hit ids are ranked exactly within blocks of this many consecutive key values
KEY_BLOCK_BITS = 14


def host_of(value: Column) -> Column:
    """Host that a domain or URL spelling names; null if it names none.

    Case, blanks, scheme, user info, port, path, query, trailing dots and a leading ``www.`` make
    no difference.
    """
    s = F.lower(F.regexp_replace(value, r"\s+", ""))
    s = F.regexp_replace(s, r"^[a-z][a-z0-9+.\-]*://|^//", "")
    s = F.regexp_replace(s, r"[/?#\\].*$", "")
    s = F.regexp_replace(s, r"^[^@]*@", "")
    s = F.regexp_replace(s, r":[0-9]*$", "")
    s = F.regexp_replace(s, r"\.+$", "")
    s = F.regexp_replace(s, r"^www\.(?=.)", "")
    return F.when(s != "", s)


def water_level(histogram: list[tuple[int, int]], share: float, basis: str = "output", base: int | None = None) -> int:
    """Largest count one contributor may keep.

    ``histogram`` holds (count, number of contributors with that count). With ``basis='input'``
    the share is taken of ``base`` records (all by default). With ``basis='output'`` it is taken
    of what is kept: the level L must satisfy L <= share * sum(min(c, L)); the sorted counts are
    filled from the smallest up until that holds. At least 1; no contributor is ever emptied.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be in (0, 1]")
    counts = sorted((int(c), int(k)) for c, k in histogram if c > 0 and k > 0)
    total = sum(c * k for c, k in counts)
    if not counts:
        return 1
    if basis == "input":
        # the epsilon keeps floor(n * share) exact for shares such as 1/50 that binary floats miss
        return max(1, int((total if base is None else base) * share + 1e-9))
    if basis != "output":
        raise ValueError("basis must be 'input' or 'output'")
    above = sum(k for _, k in counts)
    below, level = 0, 0
    for c, k in counts:
        # between two counts the kept total is below + above * L, so L <= share * (below + above * L)
        if share * above >= 1:
            level = c
        else:
            fit = int(share * below / (1 - share * above) + 1e-9)
            if fit < c:
                level = max(level, fit)
                break
            level = c
        below += c * k
        above -= k
    return max(1, level)


def contributor_counts(records: DataFrame, contributor: str) -> DataFrame:
    """(contributor, n) with partial aggregation before the shuffle."""
    return records.groupBy(contributor).agg(F.count(F.lit(1)).alias("n"))


def split_by_cap(
    records: DataFrame,
    contributor: str,
    quality: str,
    key: str,
    share: float,
    basis: str = "output",
) -> DataFrame:
    """Records of contributors over the cap, with ``_keep`` telling which survive.

    ``records`` has one row per ``key`` (BIGINT). Each contributor keeps its ``level`` best rows by
    ``quality`` descending (null lowest), ties by smaller ``key``. Null contributors form one group.
    An empty input gives an empty result.

    No group is sorted in one task: a histogram over (contributor, quality) finds the quality at
    which the cap falls, a second one over key blocks finds the block, and only the rows of that
    one block (at most 2**14 keys) are ranked. At most 1/share contributors lie over an input
    cap, so the tables joined here are small; their sizes are still left to the planner.
    """
    counts = contributor_counts(records, contributor)
    # distinct counts are at most sqrt(2 n); the driver sees no contributor
    histogram = [(r[0], r[1]) for r in counts.groupBy("n").agg(F.count(F.lit(1))).collect()]
    level = water_level(histogram, share, basis)
    over = counts.where(F.col("n") > level).select(F.col(contributor).alias("_c"))
    c, q, k = (records[x] for x in (contributor, quality, key))
    heavy = records.join(over, c.eqNullSafe(F.col("_c")), "left_semi").select(
        c.alias("_c"), q.alias("_q"), k.alias("_k"), F.shiftright(k, KEY_BLOCK_BITS).alias("_b")
    )

    def cut(groups: DataFrame, within: list[str], order: list[Column], room: Column) -> DataFrame:
        """The group in which the running count passes ``room``, and the room left in it."""
        w = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        run = groups.withColumn("_run", F.sum("_n").over(w))
        return run.where((F.col("_run") > room) & (F.col("_run") - F.col("_n") <= room)).withColumn(
            "_room", room - (F.col("_run") - F.col("_n"))
        )

    blocks = heavy.groupBy("_c", "_q", "_b").agg(F.count(F.lit(1)).alias("_n"))
    at_quality = cut(
        blocks.groupBy("_c", "_q").agg(F.sum("_n").alias("_n")),
        ["_c"], [F.col("_q").desc_nulls_last()], F.lit(level),
    ).select("_c", F.col("_q").alias("_q0"), F.col("_room").alias("_room0"))
    b = blocks.alias("b").join(
        at_quality.alias("a"), F.expr("b._c <=> a._c AND b._q <=> a._q0")
    ).select("b._c", "b._b", "b._n", "a._room0")
    at_block = cut(b, ["_c"], [F.col("_b").asc()], F.col("_room0")).select(
        F.col("_c"), F.col("_b").alias("_b0"), F.col("_room").alias("_room1")
    )
    limits = (
        at_quality.alias("a")
        .join(at_block.alias("k"), F.expr("a._c <=> k._c"), "left")
        .select(F.col("a._c").alias("_lc"), "_q0", "_b0", "_room1")
    )
    joined = heavy.join(limits, F.expr("_c <=> _lc"), "left")
    better = F.col("_q").isNotNull() & (F.col("_q0").isNull() | (F.col("_q") > F.col("_q0")))
    tied = F.col("_q").eqNullSafe(F.col("_q0"))
    state = (
        F.when(better, 1)
        .when(tied & (F.col("_b") < F.col("_b0")), 1)
        .when(tied & (F.col("_b") == F.col("_b0")), 0)
        .otherwise(-1)
    )
    marked = joined.withColumn("_state", state)
    edge = marked.where("_state = 0").withColumn(
        "_rank", F.row_number().over(W.partitionBy("_c").orderBy("_k"))
    )
    rest = marked.where("_state <> 0").select("_c", "_q", "_k", (F.col("_state") == 1).alias("_keep"))
    edge = edge.select("_c", "_q", "_k", (F.col("_rank") <= F.col("_room1")).alias("_keep"))
    return rest.unionByName(edge).select(
        F.col("_c").alias(contributor), F.col("_q").alias(quality), F.col("_k").alias(key), "_keep"
    )


def cap_contributors(records: DataFrame, contributor: str, quality: str, key: str, share: float, basis: str = "output") -> DataFrame:
    """``records`` without the rows that :func:`split_by_cap` drops; columns unchanged."""
    drop = split_by_cap(records, contributor, quality, key, share, basis).where("NOT _keep")
    return records.join(drop.select(F.col(key).alias("_dropped")), records[key] == F.col("_dropped"), "left_anti")


def hit_records(hits: DataFrame) -> DataFrame:
    """One row per ``hit_id`` with its contributor: the host of ``domain``, else of ``url``.

    Doubled deliveries (all columns equal) collapse; rows without ``hit_id`` are no records.
    """
    host = F.coalesce(host_of(F.col("domain")), host_of(F.col("url")))
    return (
        hits.where("hit_id IS NOT NULL")
        .select("hit_id", host.alias("contributor"), "word_count")
        .groupBy("hit_id")
        .agg(F.min("contributor").alias("contributor"), F.max("word_count").alias("word_count"))
    )
