"""Implausible values, orphan references and interval sweeps on small cases worked out by hand or by brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import implausible as imp
from tidemark.operators import references as ref
from tidemark.operators import sweep

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


LIMITS = "npy_path string, full_scale double, fs double"


def flags(spark, xs, *, fs=1.0, full=1000.0, start=0, path="a", factor=25.0):
    samples = spark.createDataFrame([(path, start + i, x, "extra") for i, x in enumerate(xs)], "npy_path string, idx long, x double, reason string")
    limits = spark.createDataFrame([(path, full, fs)], LIMITS)
    return {(r["idx"] - start): r["reason"] for r in imp.implausible(samples, limits, factor=factor).collect()}


def noise(n, seed=0):
    r = random.Random(seed)
    return [round(r.uniform(-1, 1), 3) for _ in range(n)]


def test_out_of_range_and_not_finite(spark):
    xs = noise(50)
    xs[3], xs[10], xs[20], xs[30] = float("nan"), float("inf"), -1001.0, None
    assert flags(spark, xs) == {3: "range", 10: "range", 20: "range"}


def test_excursions_of_up_to_three_seconds(spark):
    xs = noise(80)
    xs[10:13] = [90.0, 95.0, 80.0]  # three samples at 1 Hz
    xs[30:34] = [90.0] * 4  # too long
    xs[50:] = [x + 200 for x in xs[50:]]  # a level change
    assert flags(spark, xs) == {10: "spike", 11: "spike", 12: "spike"}
    assert set(flags(spark, xs, fs=0.25)) == set()  # one sample only
    xs[60] = -90.0
    assert flags(spark, xs, fs=0.25) == {60: "spike"}


def test_dip_between_two_excursions_is_no_excursion(spark):
    xs = noise(40)
    xs[10] = xs[12] = 90.0
    assert flags(spark, xs) == {10: "spike", 12: "spike"}


@pytest.mark.parametrize("start", [0, imp.BLOCK - 60, 3 * imp.BLOCK - 100])
def test_stuck_runs_across_blocks(spark, start):
    xs = noise(300)
    xs[40:100] = [0.5] * 60
    xs[150:209] = [0.25] * 59
    assert flags(spark, xs, start=start) == {i: "stuck" for i in range(40, 100)}


def test_run_longer_than_a_block(spark):
    xs = noise(10) + [0.125] * (2 * imp.BLOCK + 5) + noise(10, 1)
    assert sorted(flags(spark, xs)) == list(range(10, 2 * imp.BLOCK + 15))


def test_gap_breaks_a_run_and_copies_count_once(spark):
    part = [("a", i, 0.5) for i in list(range(0, 40)) + list(range(41, 80))]
    samples = spark.createDataFrame(part + part + [("a", 200 + i, x) for i, x in enumerate(noise(20))], "npy_path string, idx long, x double")
    limits = spark.createDataFrame([("a", 1e9, 1.0)], LIMITS)
    assert imp.implausible(samples, limits).count() == 0


def test_unknown_source_constant_source_and_empty(spark):
    samples = spark.createDataFrame([("b", i, 7.0) for i in range(100)] + [("b", None, 1.0), (None, 1, 1.0), ("b", 5, 7.0)], "npy_path string, idx long, x double")
    none = spark.createDataFrame([], LIMITS)
    assert imp.implausible(samples, none).count() == 0
    assert imp.implausible(samples.limit(0), none).count() == 0
    assert imp.implausible(samples, spark.createDataFrame([("b", None, 0.5)], LIMITS)).count() == 100


def test_sketch_quantiles_are_close(rng=np.random.default_rng(3)):
    value = rng.lognormal(size=20000)
    row = np.zeros(len(value), int)
    to, points, w = imp.equal_depth(row, value, np.ones(len(value)), 1)
    assert to[-1] == imp.POINTS and abs(w[0] * imp.POINTS - len(value)) < 1e-6
    q = imp.weighted_quantiles(np.zeros(len(points), int), points, np.full(len(points), w[0]), 1, [0.5])[0, 0]
    assert abs((value < q).mean() - 0.5) < 1 / imp.POINTS
    assert imp.weighted_quantiles(np.zeros(4, int), np.array([1.0, 2, 3, 4]), np.ones(4), 1, [0.5])[0, 0] == 2.5


def test_many_blocks_merge_to_the_same_step(spark, monkeypatch):
    monkeypatch.setattr(imp, "BLOCK", 256)
    monkeypatch.setattr(imp, "FAN_IN", 2)
    xs = noise(4000, 5)
    xs[1000] = 60.0
    assert flags(spark, xs) == {1000: "spike"}


def test_doubtful_rates(spark, rows):
    recs = [(1, "A.mat", 1.0, "p1"), (2, "x/a.MAT ", 1.0, "p2"), (3, r"y\A.npy", 2.0, "p3"), (4, "b.mat", None, "p4"), (5, None, 3.0, "p5"), (6, "c_fs0.5.mat", float("nan"), "p6"), (1, "A.mat", 1.0, "p1"), (7, "d.mat", 1.0, "p7"), (8, "d.mat", 2.0, None)]
    df = spark.createDataFrame(recs, "id long, source_file string, fs double, npy_path string")
    assert rows(imp.doubtful_rates(df)) == sorted([("p3", -1), ("p4", -1), ("p6", -1), ("p7", -1), (None, -1)], key=repr)


# ---------------------------------------------------------------- references


def refs_df(spark, items):
    return spark.createDataFrame(items, ref.REF)


def parents_df(spark, items):
    return spark.createDataFrame(items, ref.PARENT)


def test_kinds_and_state_changes(spark, rows):
    state = ref.Orphans(spark)
    state = state.advance(refs_df(spark, [("t", 1, "k", "a", day(1)), ("t", 2, "k", "b", day(1))]), parents_df(spark, [("k", "b", day(0), None, False)]))
    assert rows(state.faults()) == [("t", 1, "missing", day(1))]
    state = state.advance(refs_df(spark, []), parents_df(spark, [("k", "a", day(2), None, False), ("k", "b", day(3), day(3), True)]))
    assert rows(state.faults().drop("ref_at")) == [("t", 1, "late"), ("t", 2, "deleted")]
    state = state.advance(refs_df(spark, []), parents_df(spark, [("k", "a", day(1), None, False), ("k", "b", day(4), day(4), False)]))
    assert rows(state.faults()) == []


def test_batches_do_not_matter(spark, rows):
    r = random.Random(2)
    refs = [("t", i, "k", str(r.randrange(12)) if i % 3 else "0", day(r.randrange(30))) for i in range(80)]
    parents = [("k", str(r.randrange(10)), day(r.randrange(30)), day(r.randrange(30)) if r.random() < 0.3 else None, r.random() < 0.3) for _ in range(15)]
    parents = [(k, key, at, v, rem if v else False) for k, key, at, v, rem in parents]
    whole = ref.track(refs_df(spark, refs), parents_df(spark, parents), [])
    steps = ref.track(refs_df(spark, refs), parents_df(spark, parents), ["2024-01-08", "2024-01-15", "2024-01-22"])
    assert rows(whole.faults()) == rows(steps.faults()) and whole.faults().count()
    assert rows(whole.snapshot()) == rows(steps.snapshot())


def test_moved_and_repeated_references(spark, rows):
    none = parents_df(spark, [])
    state = ref.Orphans(spark).advance(refs_df(spark, [("t", 1, "k", "a", day(5)), ("t", 1, "k", "a", day(6))]), parents_df(spark, [("k", "b", day(0), None, False)]))
    state.advance(refs_df(spark, [("t", 1, "k", "a", day(9))]), none)  # delivered again: nothing changes
    assert state.table("refs").count() == 1
    state.advance(refs_df(spark, [("t", 1, "k", "b", day(3))]), none)  # an earlier row names another key
    assert rows(state.faults()) == [] and state.snapshot().count() == 0
    state.advance(refs_df(spark, []), parents_df(spark, [("k", "a", day(9), None, False)]))  # the old key waits no more
    assert rows(state.faults()) == []
    state.advance(refs_df(spark, []), parents_df(spark, [("k", "b", day(9), day(9), True)]))
    assert rows(state.faults()) == [("t", 1, "deleted", day(3))]
    assert [r.n for r in state.snapshots().orderBy("batch").collect()] == [1, 1, 1]
    whole = ref.Orphans(spark).advance(refs_df(spark, [("t", 1, "k", "a", day(5)), ("t", 1, "k", "b", day(3))]), parents_df(spark, [("k", "b", day(0), None, False), ("k", "b", day(9), day(9), True), ("k", "a", day(9), None, False)]))
    assert rows(whole.faults()) == rows(state.faults())


def test_a_batch_appends_only_what_it_touches(spark):
    refs = [("t", i, "k", str(i % 50), day(2)) for i in range(500)]
    state = ref.Orphans(spark).advance(refs_df(spark, refs), parents_df(spark, [("k", str(i), day(1), None, False) for i in range(25)]))
    before = state.table("refs").count()
    state.advance(refs_df(spark, [("t", 900, "k", "3", day(4))]), parents_df(spark, [("k", "30", day(3), None, False)]))
    assert before == 500 and state.table("refs", [1]).count() == 11  # ten wait for 30, one is new
    assert state.faults().count() == 250 and {(r.kind, r.n) for r in state.snapshot().collect()} == {("missing", 240), ("late", 10)}


def test_state_survives_a_restart(spark, rows, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/state"
    refs = [refs_df(spark, [("t", k, "k", "a", day(k + 1))]) for k in range(3)]
    none = parents_df(spark, [])
    state = ref.Orphans(spark, folder).advance(refs[0], none, 0)
    with monkeypatch.context() as m:  # lost between the tables of a batch
        m.setattr(ref.Orphans, "_count", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            state.advance(refs[1], none, 1)
    again = ref.Orphans(spark, folder)
    assert again.batches() == [0] and again.faults().count() == 1
    again.advance(refs[1], none, 1).advance(refs[1], none, 1)  # sent twice
    again.advance(refs[2], parents_df(spark, [("k", "a", day(2), None, False)]), 2)
    assert again.batches() == [0, 1, 2] and rows(ref.Orphans(spark, folder).faults().select("row_id", "kind")) == [(0, "late")]
    assert [tuple(r) for r in again.snapshot(1).select("kind", "n").collect()] == [("missing", 2)]


def test_empty_state_and_boundaries(spark):
    assert ref.Orphans(spark).faults().count() == 0
    assert ref.even_boundaries(refs_df(spark, []), 3) == []
    assert len(ref.even_boundaries(refs_df(spark, [("t", 1, "k", "a", day(1)), ("t", 2, "k", "a", day(9))]), 3)) == 2


# ---------------------------------------------------------------- sweep


def brute(spans):
    out = []
    for key in {k for k, *_ in spans if k is not None}:
        good = sorted((s, e) for k, s, e in spans if k == key and s is not None and e is not None and e > s)
        periods = []
        for s, e in good:
            if periods and s <= periods[-1][1]:
                periods[-1][1] = max(periods[-1][1], e)
                periods[-1][2] += 1
            else:
                periods.append([s, e, 1])
        out += [(key, "merged", s, e) for s, e, n in periods if n > 1]
        out += [(key, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4, 64, sweep.BLOCK])
def test_sweep_against_brute_force(spark, rows, block):
    r = random.Random(block)
    spans = [(r.choice(["a", "a", "a", "b", None]), s, s + r.randrange(-2, 12)) for s in (r.randrange(-20, 200) for _ in range(90))]
    spans += [("a", None, 3), ("a", 5, None), ("c", 1, 1), ("d", 0, 5), ("d", 5, 9), ("d", 0, 5)]
    df = spark.createDataFrame(spans, "who string, s long, e long").withColumn("kind", F.lit("extra")).withColumn("pos", F.lit(1))
    assert rows(sweep.merged_and_gaps(df, ["who"], "s", "e", block)) == brute(spans)


def test_sweep_empty(spark):
    df = spark.createDataFrame([], "who string, s long, e long")
    assert sweep.merged_and_gaps(df, ["who"], "s", "e").count() == 0 and sweep.periods(df, ["who"], "s", "e").count() == 0


def test_hourly_fences(spark):
    r = np.random.default_rng(8)
    xs = [round(float(v), 4) for v in r.normal(size=200)] + [round(float(v), 4) for v in r.normal(50, 1, size=200)]
    xs[7], xs[250], xs[300] = 40.0, 5.0, float("nan")
    place = [i if i < 200 else 3600 + i for i in range(400)]
    samples = spark.createDataFrame([("a", i, x) for i, x in zip(place, xs)], "npy_path string, idx long, x double")
    limits = spark.createDataFrame([("a", 1e9, 1.0)], LIMITS)
    got = {row["hour"]: row for row in imp.hourly_fences(samples, limits).collect()}
    assert set(got) == {0, 1}
    for hour, part in ((0, xs[:200]), (1, [x for x in xs[200:] if x == x])):
        q1, q2, q3 = np.quantile(part, [0.25, 0.5, 0.75])
        row = got[hour]
        assert abs(row["q1"] - q1) < 0.1 and abs(row["q2"] - q2) < 0.1 and abs(row["q3"] - q3) < 0.1
        assert row["n_outside"] == sum(x < row["low"] or x > row["high"] for x in part) == 1
