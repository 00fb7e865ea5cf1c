"""Folds over runs against a plain loop, with runs cut at every kind of place."""

import random

import pytest
from pyspark.sql import functions as F

from terrafield.operators import runs, sequences, terrain

FT = 3.28084


def plain_climb(values, threshold):
    ref, up, down = values[0], 0.0, 0.0
    for v in values:
        if abs(v - ref) >= threshold:
            up, down, ref = up + max(v - ref, 0.0), down + max(ref - v, 0.0), v
    return min(values), max(values), up, down


def plain_merge(rows, max_gap, max_span):
    out = []
    for start, length in rows:
        end = start + length
        if out:
            lo, hi, n = out[-1]
            if max(start - hi, lo - end, 0) <= max_gap and max(end, hi) - min(start, lo) <= max_span:
                out[-1] = (min(start, lo), max(end, hi), n + 1)
                continue
        out.append((start, end, 1))
    return [(i, lo, hi - lo, n) for i, (lo, hi, n) in enumerate(out)]


@pytest.fixture(params=[3, 64, 10_000])
def batch(request, spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def walks(rnd):
    flat = [rnd.choice([100.0, 101.0, 111.9]) for _ in range(90)]  # never twelve away
    ramp = [i * 0.5 for i in range(120)]  # every row a new extreme
    steps = [rnd.choice([0.0, 12.0, 24.0, -12.0]) for _ in range(150)]  # exactly at the threshold
    rough, v = [], 0.0
    for _ in range(400):
        v += rnd.gauss(0, 6)
        rough.append(v)
    mostly_flat = [5.0] * 130 + [17.0] * 40 + [4.0]
    return {1: flat, 2: ramp, 3: steps, 4: rough, 5: mostly_flat, 6: [7.0], None: ramp[::-1]}


@pytest.mark.parametrize("chunk", [1, 7, 50, 250_000])
def test_climb_equals_a_plain_loop(spark, batch, chunk):
    data = walks(random.Random(batch))
    rows = [(str(k) if k else None, i * 2, v) for k, vs in data.items() for i, v in enumerate(vs)]
    rows += [("1", 1, None), ("2", 1, float("nan")), ("8", 0, None)]
    random.Random(1).shuffle(rows)
    got = runs.climb(spark.createDataFrame(rows, "k string, s bigint, v double"), "k", "s", "v", 12.0, chunk).collect()
    want = {str(k) if k else None: plain_climb(vs, 12.0) for k, vs in data.items()}
    assert {r.k for r in got} == set(want) and len(got) == len(want)
    for r in got:
        assert (r.lo, r.hi, r.up, r.down) == pytest.approx(want[r.k], abs=1e-9)


@pytest.mark.parametrize("chunk", [1, 7, 50, 250_000])
def test_merged_intervals_equal_a_plain_loop(spark, batch, chunk):
    rnd = random.Random(batch + chunk)
    data = {
        1: [(rnd.randrange(400), rnd.randrange(30)) for _ in range(300)],
        2: [(i * 5, 5) for i in range(300)],  # a file read from front to back
        3: [(3000 - i * 5, 4) for i in range(200)],  # and from back to front
        4: [(rnd.choice([0, 10, 11, 20, 21, 100]), rnd.choice([0, 1, 10, 150])) for _ in range(300)],  # at the limits, some too long
        5: [(0, 1)] * 150,
        6: [(2, 3)],
        None: [(i * rnd.randrange(12, 15), 2) for i in range(100)],
    }
    rows = [(str(k) if k else None, i * 3, *v) for k, vs in data.items() for i, v in enumerate(vs)] + [("6", 1, None, 5), ("9", 1, 5, None)]
    rnd.shuffle(rows)
    got = sequences.merge_intervals(spark.createDataFrame(rows, "k string, s bigint, start bigint, length bigint"), "k", "s", 10, 100, chunk)
    assert got.columns == ["k", "batch_no", "start", "length", "members"]
    found = {}
    for r in got.collect():
        found.setdefault(r.k, []).append(tuple(r)[1:])
    assert {k: sorted(v) for k, v in found.items()} == {str(k) if k else None: plain_merge(vs, 10, 100) for k, vs in data.items()}


def test_empty_tables_and_extra_columns(spark):
    none = spark.createDataFrame([], "k int, s int, filled double, start bigint, length bigint")
    assert terrain.profile_stats(none, "k", "s").collect() == [] and sequences.merge_intervals(none, "k", "s").collect() == []
    d = spark.createDataFrame([(1, 0, 10.0, 0, 5, "x", 1), (1, 1, 20.0, 5, 5, "y", 2)], "k int, s int, filled double, start bigint, length bigint, lo string, _chunk int")
    assert [round(v, 3) for v in terrain.profile_stats(d, "k", "s").first()[1:]] == [32.808, 65.617, 32.808, 0.0]
    assert tuple(sequences.merge_intervals(d, "k", "s").first()) == (1, 0, 0, 10, 2)


def test_one_long_key_is_many_tasks(spark):
    """Two million rows of one key, in forty order chunks, equal the closed form."""
    n = 2_000_000
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("s"), ((F.col("id") % 40) * 0.5).alias("v"),
                              (F.col("id") * 10).alias("start"), F.lit(10).cast("bigint").alias("length"))
    r = runs.climb(d, "k", "s", "v", 12.0, 50_000).first()
    # up 12 at each tooth, then 0 is 12 below: down 12
    assert (r.lo, r.hi, r.up, r.down) == (0.0, 19.5, 12.0 * n / 40, 12.0 * (n / 40 - 1))
    m = sequences.merge_intervals(d, "k", "s", 10, 1000, 50_000).agg(F.count("*"), F.min("members"), F.max("members"), F.max("batch_no")).first()
    assert tuple(m) == (n // 100, 100, 100, n // 100 - 1)
