"""Problem 7: capping by water-filling, and the SQL of the operators for training data."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm import capping, queries

SF = "/root/testdata/sf0.001"


def brute_cap(rows, level):
    by = {}
    for c, q, k in rows:
        by.setdefault(c, []).append((q is not None, q if q is not None else 0, -k, k))
    return {x[3] for v in by.values() for x in sorted(v, reverse=True)[level:]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cap_matches_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", "c", None, "d"]), r.choice([None, 0, 1, 5, 5, 9]), k) for k in r.sample(range(100_000), 400)]
    df = spark.createDataFrame(rows, "c string, q int, k long").withColumn("_keep2", F.lit(1))
    got = {x["k"] for x in capping.split_by_cap(df, "c", "q", "k", 0.1, "input").where("NOT _keep").collect()}
    assert got == brute_cap(rows, 40)
    kept = capping.cap_contributors(df, "c", "q", "k", 0.1, "input")
    assert kept.count() == 400 - len(got) and kept.columns == df.columns


def test_cap_empty_and_one(spark):
    empty = spark.createDataFrame([], "c string, q int, k long")
    assert capping.split_by_cap(empty, "c", "q", "k", 0.5, "input").count() == 0
    single = spark.createDataFrame([("a", None, 1)], "c string, q int, k long")
    assert capping.cap_contributors(single, "c", "q", "k", 0.02, "output").count() == 1


@pytest.mark.parametrize("counts", [[100, 50, 10, 5, 5, 5], [1000, 1, 1, 1], [7] * 60, [3], [500, 400, 300] + [20] * 80])
@pytest.mark.parametrize("share", [0.02, 0.1, 0.3, 1.0])
def test_water_level_is_consistent(counts, share):
    hist = [(c, counts.count(c)) for c in set(counts)]
    level = capping.water_level(hist, share, "output")
    kept = lambda n: sum(min(c, n) for c in counts)
    best = max([n for n in range(1, max(counts) + 1) if n <= share * kept(n) + 1e-9], default=1)
    assert level == best or min(level, max(counts)) == best
    assert capping.water_level(hist, share, "input") == max(1, math.floor(sum(counts) * share + 1e-9))


def test_host_of(spark):
    same = ["Example.org", " example.org ", "https://www.example.org/x", "example.org:443", "WWW.EXAMPLE.ORG", "example.org.", "http://u@example.org?q"]
    df = spark.createDataFrame([(s,) for s in same + ["", None, "www."]], "d string").select(capping.host_of(F.col("d")).alias("h"))
    assert [r["h"] for r in df.collect()] == ["example.org"] * len(same) + [None, None, "www"]


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    con.execute(queries.SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == cols
    assert got == sorted("|".join(plain(r[names.index(c)]) for c in cols) for r in con.fetchall())
