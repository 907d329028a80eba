"""Store, interval joins, evaluation, trend modes and change points: edge cases, brute force and known answers."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.operators import measures as me
from tidemark.operators import profile
from tidemark.operators import spectral as sp
from tidemark.operators import store as st
from tidemark.operators import symbols as sy
from tidemark.operators import trends
from tidemark.session import cut_lineage


def sig(spark, *series):
    return spark.createDataFrame([(k, i, float(x)) for k, xs in enumerate(series) for i, x in enumerate(xs)], "recording_id long, idx long, x double")


def spans(spark, items):
    return spark.createDataFrame(items, "id long, recording_id long, start_idx long, end_idx long")


def test_tags_and_filters(spark, rows, tmp_path):
    tags = spark.createDataFrame([(1, "e", "fin"), (1, "e", "dip"), (1, "q", "ok"), (2, "e", "fin"), (3, "q", "ok"), (1, "e", "fin")], "id long, category string, value string")
    assert rows(st.matching_all(tags, {"e": ["fin", "x"], "q": ["ok"]})) == [(1,)]
    assert rows(st.matching_all(tags, {"e": []})) == [(1,), (2,), (3,)]
    fresh = spark.createDataFrame([(1, "e", "crest"), (2, "e", None), (9, "q", "new")], "id long, category string, value string")
    assert rows(st.replace_tags(tags, fresh)) == [(1, "e", "crest"), (1, "q", "ok"), (3, "q", "ok"), (9, "q", "new")]
    assert [tuple(r) for r in st.tag_lists(tags).filter("id = 1 and category = 'e'").collect()] == [(1, "e", ["dip", "fin"])]
    assert rows(st.missing_tag(tags.select("id").distinct(), tags, "q")) == [(2,)]
    df = spark.createDataFrame([(1, "Slow Rise", None, "a"), (2, None, "FIN", "b"), (3, None, None, "a")], "id long, note string, tag string, verdict string")
    assert rows(st.filter_annotations(df, text="fin").select("id")) == [(2,)] and rows(st.filter_annotations(df, verdict=["a"], text="rise").select("id")) == [(1,)]
    assert st.filter_annotations(df, ids=df.limit(0)).count() == 0 and st.filter_annotations(df, verdict=[]).count() == 3
    log = spark.createDataFrame([(1, 1, "x", None), (1, 2, "y", None), (2, 1, "z", None), (2, 3, "z", "gone")], "id long, at long, v string, deleted string")
    assert rows(st.current(log, ["id"], "at", "deleted").select("id", "v")) == [(1, "y")]
    for kind in ("csv", "json"):
        st.export(df, f"{tmp_path}/{kind}", kind)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == spark.read.json(f"{tmp_path}/json").count() == 3


def test_interval_joins_against_brute_force(spark, rows):
    r = random.Random(3)
    make = lambda n: [(r.randrange(3), a, a + r.choice([0, 1, 7, 90, 4000])) for a in (r.randrange(-50, 6000) for _ in range(n))]
    a, b = make(60), make(50)
    da, db = spark.createDataFrame(a, "k long, a0 long, a1 long"), spark.createDataFrame(b, "k long, b0 long, b1 long")
    got = rows(st.overlapping(da, db, ["k"]).select("k", "a0", "a1", "b0", "b1"))
    assert got == sorted([(k, p, q, s, t) for k, p, q in a for j, s, t in b if k == j and p <= t and s <= q], key=repr)
    assert st.overlapping(da, db.limit(0), ["k"]).count() == 0
    one = spans(spark, [(1, 1, 0, 100), (2, 1, 100, 200), (3, 1, 5, 5)])
    assert rows(st.similar_spans(one, one)) == [(1, 1, 1.0), (2, 2, 1.0)]  # touching spans share nothing
    env = spark.createDataFrame([(1, 10, 20), (1, 100, 200), (1, 300, 340)], "recording_id long, a0 long, a1 long")
    wav = spark.createDataFrame([(1, 5, 30), (1, 120, 150), (1, 320, 400)], "recording_id long, b0 long, b1 long")
    assert rows(st.joined_events(env, wav)) == [(1, "part", 120, 150), (1, "part", 300, 330), (1, "whole", 5, 20)]
    hits, events = spans(spark, [(1, 1, 0, 10), (2, 1, 40, 60), (3, 2, 0, 1)]), spans(spark, [(7, 1, 4, 6), (8, 1, 0, 20), (9, 1, 70, 90)])
    assert rows(st.scored_hits(hits, events)) == [(1, 8), (2, None), (3, None)]


def test_evaluation_numbers(spark):
    r = np.random.default_rng(2)
    data = [(bool(t), round(float(s), 2)) for t, s in zip(r.random(300) < 0.3, r.random(300))]
    df = spark.createDataFrame(data, "truth boolean, score double")
    curve = {c.score: c for c in st.precision_recall(df, 7).collect()}
    for score in curve:
        hit = [t for t, s in data if s >= score]
        assert curve[score].precision == pytest.approx(sum(hit) / len(hit)) and curve[score].recall == pytest.approx(sum(hit) / sum(t for t, _ in data))
    assert st.precision_recall(df.limit(0)).count() == 0
    two = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y"), (None, "y")], "p string, q string")
    assert [tuple(v) for v in st.mutual_information(two, "p", "q").collect()] == [(1.0, 1.0, 1.0, 1.0)]
    assert [tuple(v) for v in st.rand_index(two, "p", "q").collect()] == [(6.0, 6.0, 1.0)]
    assert [v.rand for v in st.rand_index(two.limit(0), "p", "q").collect()] == [None]


def test_window_helpers(spark):
    grid = spark.createDataFrame([(1, 0), (1, 10), (1, 20), (2, 0), (2, 10), (2, 25), (3, 4)], "recording_id long, start_idx long")
    assert {g.recording_id: (g.step, g.uniform) for g in st.grid_of(grid).collect()} == {1: (10, True), 2: (10, False), 3: (None, True)}
    rows = spark.createDataFrame([(1, [0.5, float("nan"), 0.7]), (2, [float("nan")]), (3, []), (4, None), (5, [0.1, None])], "id long, features array<double>")
    assert [(x.id, round(x.score, 6), x.label) for x in st.labels_of_scores(rows).orderBy("id").collect()] == [(1, 0.6, 1), (5, 0.1, 0)]
    many = spark.createDataFrame([(k, 0 if k < 90 else 1 if k < 99 else 2) for k in range(100)], "id long, c int")
    assert {x.c: x["count"] for x in st.stratified(many, "c", "id", 20).groupBy("c").count().collect()} == {0: 18, 1: 2, 2: 1}
    assert st.bins_between(1, 100) == [-100, -50, -10, -5, -1, 0, 1, 5, 10, 50, 100]
    one = spark.range(1)
    tiers = [one.select(st.cost_tier(F.lit(v).cast("double"))).first()[0] for v in (None, 60.0, 61.0, 900.5)]
    assert tiers == ["unknown", "interactive", "background", "hpc"]
    with pytest.raises(ValueError):
        st.stage_shape("dance", F.lit(1))


def test_trend_modes(spark):
    x = np.r_[np.linspace(0, 10, 60), np.zeros(60), np.linspace(0, -30, 60)]
    z = sy.trends(sig(spark, x), 12)
    word = lambda cuts, k: "".join(trends.LETTERS[k][r.symbol] for r in trends.symbols_of(z, cuts).orderBy("seg").collect())
    assert word(trends.cut_lines(z, "absolute", threshold=1.0), 3) == "UUUUUSSSSSDDDDD"
    assert word(trends.cut_lines(z, "absolute", threshold=3.0), 3) == "SSSSSSSSSSDDDDD"
    assert word(trends.cut_lines(z, k=5, least_half=1.0), 5)[5:10] == "SSSSS"
    assert word(trends.cut_lines(z, least_half=100.0), 3) == "S" * 15
    for flat, want in ((np.full(60, 3.0), "S"), (np.arange(60.0), "U"), (-np.arange(60.0), "D")):
        d = sy.trends(sig(spark, flat), 12)
        for k in (3, 5):
            letters = {trends.LETTERS[k][r.symbol].upper() for r in trends.symbols_of(d, trends.cut_lines(d, k=k)).collect()}
            assert letters == {want}
    cuts = trends.cut_lines(sy.trends(sig(spark, np.r_[np.zeros(100), [5.0, 9.0]]), 2), k=5).first().cuts
    assert all(b > a for a, b in zip(cuts, cuts[1:]))
    for bad in ({"mode": "absolute", "k": 5, "threshold": 1.0}, {"mode": "absolute"}, {"same_fraction": 1.0}, {"mode": "learnt"}, {"k": 1}):
        with pytest.raises(ValueError):
            trends.cut_lines(z, **bad)
    even = trends.diagnostics(z, trends.cut_lines(z, k=4)).first()
    assert even.half_width is None and even.suspect is None
    assert trends.diagnostics(z, trends.cut_lines(z, "absolute", threshold=1.0)).first().half_width == 1.0


def test_trend_estimators(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=48)
    seg = x.reshape(4, 12)
    got = [t.delta for t in trends.theil_sen(sig(spark, x), 12).orderBy("seg").collect()]
    want = [np.median([(s[j] - s[i]) / (j - i) for i in range(12) for j in range(i + 1, 12)]) * 11 for s in seg]
    assert np.allclose(got, want)
    got = [t.delta for t in trends.robust_endpoints(sig(spark, x), 12, 99).orderBy("seg").collect()]
    assert np.allclose(got, np.median(seg[:, 6:], axis=1) - np.median(seg[:, :6], axis=1))
    assert np.isclose(trends.theil_sen(sig(spark, np.arange(500.0)), 250).first().delta, 249)  # thinned
    with pytest.raises(ValueError):
        trends.theil_sen(sig(spark, x), 1)


def test_seed_places(spark, rows):
    df = spark.createDataFrame([("a", [1, 2, 0, 1, 2]), ("b", [1]), ("c", None), ("d", [3, 2, -1, 1])], "seed_id string, symbols array<int>")
    assert rows(trends.matches(df, "seed_id", [1, 2, -1, 1], most=0)) == [("a", 0, 0.0)]
    assert rows(trends.matches(df, "seed_id", [1, 2, -1, 1], most=1).select("seed_id", "first_pos")) == [("a", 0), ("d", 0)]
    cost = sy.cell_table(sy.cutlines(4))
    got = {(m.seed_id, m.first_pos): m.distance for m in trends.matches(df, "seed_id", [3, 0, -1], cost).collect()}
    assert got["a", 0] == pytest.approx(math.sqrt((cost[3][1] ** 2 + cost[0][2] ** 2) / 3)) and len(got) == 5
    with pytest.raises(ValueError):
        trends.matches(df, "seed_id", [-1, -1])


def test_change_point_searches(spark):
    r = np.random.default_rng(4)
    x = np.r_[r.normal(0, 0.2, 60), r.normal(4, 0.2, 45), r.normal(-2, 0.2, 95)]
    for find in (sp.binary_cuts, sp.merged_cuts):
        assert find(x, breaks=2) == [60, 105] and find(x, penalty=20.0) == [60, 105] and find(x, penalty=1e9) == []
        assert find(x[:3], breaks=2) == [] and find(np.zeros(0), penalty=1.0) == []
    assert sp.window_cuts(x, breaks=2, width=40) == [60, 105] and sp.window_cuts(x[:10], breaks=1) == []
    y = np.r_[r.normal(0, 0.1, 100), r.normal(0, 3, 100)]
    assert abs(sp.binary_cuts(y, breaks=1, kind="normal")[0] - 100) <= 5
    for wrong in ({}, {"penalty": 1.0, "breaks": 1}, {"breaks": 1}, {"penalty": 1.0, "kind": "normal"}):
        with pytest.raises(ValueError):
            sp.change_points(sig(spark, x), **wrong)
    assert [b.idx for b in sp.change_points(sig(spark, x), breaks=2, algorithm="binary").orderBy("idx").collect()] == [60, 105]


def test_seed_search_and_slices(spark):
    r = np.random.default_rng(7)
    shape = np.sin(np.linspace(0, 6, 20))
    x = r.normal(size=300)
    for at in (40, 200):
        x[at : at + 20] = 3 * shape + 10 + r.normal(0, 0.01, 20)
    found = profile.seed_matches(sig(spark, x, [1.0]), shape.tolist(), 2).orderBy("rank").collect()
    assert sorted(f.idx for f in found) == [40, 200] and all(f.distance < 0.3 for f in found)
    assert profile.seed_matches(sig(spark, x), shape.tolist(), 9, limit=0.1).count() == 2
    mp = spark.createDataFrame([(1, k) for k in range(100)], "recording_id long, idx long")
    assert profile.sliced(mp, 10, 20, 40).count() == 11
    with pytest.raises(ValueError):
        profile.sliced(mp, 10, 20, 25)
    groups = spark.createDataFrame([(1, 5, 0.2, 5), (1, 5, 0.2, 50), (1, 9, 0.9, 9), (1, 9, 0.9, 70), (1, 80, 0.1, 80)], "recording_id long, seed long, profile_distance double, member long")
    assert {g.seed for g in profile.families(groups, 0.5, 2).collect()} == {5}
    assert fr.span(mp, 0, 5).count() == 5


def test_train_complexity():
    assert me.train_complexity([], 1) == 0 and me.train_complexity([(0, 3)], 64) == me.lz76(np.r_[np.ones(4), np.zeros(60)]) / (64 / 6)
    assert me.train_complexity([(-5, 2), (60, 99)], 64) == me.lz76(np.r_[np.ones(3), np.zeros(57), np.ones(4)]) / (64 / 6)
    assert me.kolmogorov(1.0) == math.log(2) and math.isnan(me.per_entropy(1.0, 0.0)) and me.per_entropy(1.0, 2.0) == 0.5


def test_estimates_start_anew_at_checkpoints(spark, rows):
    t = spark.range(20).select("id", F.floor(F.col("id") / 2).alias("up"))
    for _ in range(8):
        t = cut_lineage(t.join(t.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
    assert rows(t) == sorted(((k, 0) for k in range(20)), key=repr)
    assert int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 64  # else a product of 2 ** 8 sizes


def joins_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_rows_made_for_joins_are_not_broadcast(spark):
    r = random.Random(5)
    some = spans(spark, [(k, k % 40, a, a + r.choice([1, 30, 500])) for k in range(400) for a in [r.randrange(3000)]]).repartition(4, "id").localCheckpoint()
    ends = lambda p: some.select("recording_id", F.col("start_idx").alias(f"{p}0"), F.col("end_idx").alias(f"{p}1"))
    for df in (st.joined_events(ends("a"), ends("b")), st.scored_hits(some, some), st.similar_spans(some, some)):
        for join in re.findall(r"BroadcastHashJoin \[(.*?)\]", joins_of(df)):
            assert "_k" not in join and "_c" not in join


def test_hits_are_scored_without_the_driver(spark, tmp_path):
    r = random.Random(6)
    some = [(k, k % 40, a, a + r.choice([1, 30, 500])) for k in range(400) for a in [r.randrange(3000)]]
    spans(spark, some).write.parquet(f"{tmp_path}/spans")
    read = spark.read.parquet(f"{tmp_path}/spans")
    scored = st.scored_hits(read, read)
    assert "Broadcast" not in joins_of(scored)
    holds = lambda p, q: p[1] == q[1] and q[2] - (q[3] - q[2]) / 2 <= (p[2] + p[3]) / 2 <= q[3] + (q[3] - q[2]) / 2
    assert dict(map(tuple, scored.collect())) == {p[0]: max(q[0] for q in some if holds(p, q)) for p in some}


@pytest.mark.parametrize("iou,ratio", [(0.8, 1.5), (0.8, 1.1), (0.3, 1.5), (0.0, 2.0), (0.05, 100.0), (1.0, 1.0)])
def test_similar_spans_against_brute_force(spark, rows, iou, ratio):
    r = random.Random(7)
    make = lambda n: [(k, r.randrange(2), a, a + r.choice([0, 1, 2, 4, 5, 8, 10, 64, 80, 100])) for k in range(n) for a in [r.randrange(-40, 90)]]
    a, b = make(90), make(110)
    over = lambda p, q: max(0, min(p[3], q[3]) - max(p[2], q[2])) / max(1, max(p[3], q[3]) - min(p[2], q[2]))
    alike = lambda p, q: over(p, q) > 0 and over(p, q) >= iou and max(p[3] - p[2], q[3] - q[2]) / min(p[3] - p[2], q[3] - q[2]) <= ratio
    want = sorted([(p[0], q[0], over(p, q)) for p in a for q in b if p[1] == q[1] and alike(p, q)], key=repr)
    assert want and rows(st.similar_spans(spans(spark, a), spans(spark, b), iou, ratio)) == want
