"""Operators that SQL cannot express, against brute force, known answers and properties."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import falls
from tidemark.operators import frames as fr
from tidemark.operators import islands as isl
from tidemark.operators import measures as me
from tidemark.operators import overlap, prepare, profile, ranking, search
from tidemark.operators import spectral as sp
from tidemark.operators import symbols as sy
from tidemark.plans import catalogue  # noqa: F401
from tidemark.plans import recipes as rec
from tidemark.queries import records, signals
from tidemark.sources import files
from tidemark.streaming import live


def sig(spark, *series):
    return spark.createDataFrame([(k, i, float(x)) for k, xs in enumerate(series) for i, x in enumerate(xs)], "recording_id long, idx long, x double")


def values(df, name="x"):
    return [r[name] for r in df.orderBy("recording_id", "idx").collect()]


# ---------------------------------------------------------------- frames and islands


def test_frames_do_not_depend_on_blocks(spark, monkeypatch):
    r = random.Random(1)
    xs = [r.uniform(0, 9) for _ in range(100)]
    df = sig(spark, xs)
    whole = [np.round(values(f(df)), 9).tolist() for f in (lambda s: fr.detrend(s, window=7), lambda s: fr.uniform_detrend(s, 6), lambda s: fr.rolling_median(s, 2))]
    monkeypatch.setattr(fr, "BLOCK", 16)
    cut = [np.round(values(f(df)), 9).tolist() for f in (lambda s: fr.detrend(s, window=7), lambda s: fr.uniform_detrend(s, 6), lambda s: fr.rolling_median(s, 2))]
    assert whole == cut
    pad = np.pad(xs, 2, mode="edge")
    assert np.allclose(whole[2], [np.median(pad[i : i + 5]) for i in range(100)])


def test_short_signals(spark):
    for f in (lambda s: fr.detrend(s, window=7), lambda s: fr.detrend(s, "rolling_z", 7), lambda s: fr.detrend(s, "linear"), lambda s: fr.uniform_detrend(s, 9), fr.z_normalise, lambda s: fr.rolling_median(s, 3)):
        assert len(values(f(sig(spark, [5.0])))) == 1
        assert values(f(sig(spark, []))) == []
    assert values(fr.z_normalise(sig(spark, [2.0, 2.0]))) == [0.0, 0.0]
    with pytest.raises(ValueError):
        fr.downsample(sig(spark, [1.0]), 10, 3)


def test_window_grid_counts(spark):
    for n, starts in ((600, [0]), (1200, [0, 600]), (1199, [0]), (599, [])):
        df = spark.range(n).select(F.lit(1).alias("recording_id"), F.col("id").alias("idx"), F.lit(0.0).alias("x"))
        assert [r.start_idx for r in fr.window_grid(df, 600, 600).orderBy("start_idx").collect()] == starts


def test_greedy_folds(spark, rows):
    r = random.Random(3)
    pts = [("a", r.randrange(200), round(r.random(), 3)) for _ in range(50)]
    df = spark.createDataFrame(pts, "k string, idx long, score double")
    kept = []
    for p in sorted(x[1] for x in pts):
        if not kept or p - kept[-1] >= 9:
            kept.append(p)
    assert rows(isl.refractory(df, ["k"], "idx", 9)) == sorted([("a", p) for p in kept], key=repr)
    best = []
    for s, p in sorted((x[2], x[1]) for x in pts):
        if all(abs(p - q) >= 9 for q in best):
            best.append(p)
    assert rows(isl.separated(df, ["k"], "score", "idx", 9)) == sorted([("a", p) for p in best], key=repr)
    spans = spark.createDataFrame([("a", 0, 10), ("a", 4, 12), ("a", 11, 20), ("a", 30, 40), ("b", 1, 2)], "k string, start_idx long, end_idx long")
    assert rows(isl.merge_half_overlaps(spans, ["k"])) == sorted([("a", 0, 12), ("a", 11, 20), ("a", 30, 40), ("b", 1, 2)], key=repr)


def test_near_duplicates_against_brute_force(spark, rows):
    r = random.Random(5)
    spans = [(i, r.randrange(2), s, s + r.choice([0, 1, 5, 6, 7, 40, 41, 48, 300])) for i, s in ((i, r.randrange(60)) for i in range(150))]
    df = spark.createDataFrame(spans, "id long, recording_id long, start_idx long, end_idx long")
    want = []
    for (i, p, a, b), (j, q, c, d) in itertools.combinations(spans, 2):
        if p == q and b > a and d > c and min(b, d) > max(a, c):
            iou = (min(b, d) - max(a, c)) / (max(b, d) - min(a, c))
            if iou >= 0.8 and max(b - a, d - c) / min(b - a, d - c) <= 1.5:
                want.append((p, i, j, iou))
    assert rows(overlap.near_duplicates(df)) == sorted(want, key=repr)


def test_periods_from_before_the_start_keep_their_rest(spark, rows):
    df = spark.createDataFrame([(1, -30, 25), (1, 40, 50), (2, -9, 0), (2, -9, -1)], "recording_id long, from_idx long, to_idx long")
    assert rows(overlap.bucket_cover(overlap.clipped(df), "recording_id", 10)) == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 0.5), (1, 4, 1.0)]


def test_every_label_has_a_status(spark):
    recs = spark.createDataFrame([(1, "a", 0, 100), (2, "a", 1, 100), (3, "b", 0, 50), (4, "b", 1, 60)], "id long, source_file string, channel long, n_samples long")
    spans = [(1, -5, 10), (1, 120, 130), (2, 120, 130), (1, 95, 105), (1, 195, 201), (3, 5, 9), (9, 5, 9), (9, -5, 9), (1, 7, 7)]
    notes = spark.createDataFrame([(k, *s, "seed") for k, s in enumerate(spans)], "id long, recording_id long, start_idx long, end_idx long, verdict string")
    placed = signals.place_labels(notes, recs)
    assert {r.id: (r.channel, r.local_start, r.status) for r in placed.collect()} == {
        0: (-1, 95, "out_of_bounds"), 1: (1, 20, "imported"), 2: (1, 20, "imported"), 3: (0, 95, "straddles"), 4: (1, 95, "out_of_bounds"),
        5: (None, 5, "no_layout"), 6: (None, 5, "no_layout"), 7: (None, -5, "out_of_bounds"),
    }
    assert {r.status: r.n_labels for r in signals.label_counts(placed).collect()} == {"out_of_bounds": 3, "imported": 1, "straddles": 1, "no_layout": 2}


def test_density_per_recording(spark, rows):
    recs = spark.createDataFrame([(1, 1000), (2, 10_000_000)], "id long, n_samples long")
    spans = spark.createDataFrame([(1, 500, 510, "seed"), (2, 5_000_000, 5_000_010, "seed"), (2, 9_000_000, 9_000_010, "seed"), (3, 5, 9, "seed")], "recording_id long, start_idx long, end_idx long, verdict string")
    assert rows(records.density(spans, recs)) == [(1, 50, "seed", 1), (2, 50, "seed", 1), (2, 90, "seed", 1), (3, None, "seed", 1)]


def test_running_sums_in_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") % 7 == 0).alias("g"), "id", (F.col("id") % 5).alias("w")).withColumn("h", ranking.hash_order("id"))
    got = ranking.running(df, ["g"], "h", "id", "w").collect()
    for g in (True, False):
        part = sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.id))
        assert [r.upto for r in part] == np.cumsum([r.w for r in part]).tolist()


# ---------------------------------------------------------------- measures and spectra


def test_measures_on_known_signals():
    x = np.sin(np.arange(64) * 2 * np.pi / 16)
    assert abs(me.spectral_entropy(x)) < 1e-6
    assert me.svd_entropy(np.ones(10)) == pytest.approx(0, abs=1e-6) and math.isnan(me.svd_entropy(np.ones(2)))
    assert me.lz76(np.array([0, 0, 0, 0, 1])) == 2 and me.lz76(np.array([0, 1, 0, 1, 0, 1])) == 3
    assert me.half_width(np.array([0, 1, 2, 3, 4, 3, 2, 1, 0.0])) == 2.0 and math.isnan(me.half_width(np.arange(5.0)))
    noise = np.random.default_rng(0).normal(size=200)
    assert me.sample_entropy(noise) > me.sample_entropy(np.sin(np.arange(200) / 5))
    band = me.stft_log_spectrum(np.sin(np.arange(512) * 2 * np.pi * 0.25), 64, 32, 16)
    assert band.argmax() in (10, 11, 12, 13) and len(band) == 16
    with pytest.raises(ValueError):
        me.stft_log_spectrum(np.ones(3), 8, 4)


def test_failed_measures_are_nan_not_null(spark):
    df = sig(spark, [1.0], [1.0, 2, 3, 4, 5, 6])
    out = {r.recording_id: r for r in me.per_window(df, ["recording_id"], me.FAST).collect()}
    assert math.isnan(out[0].svd_entropy) and out[1].svd_entropy > 0


def test_butterworth_response():
    b, a = sp.butterworth(4, None, 0.1, 1.0)
    at = lambda f: abs(np.polyval(b[::-1], np.exp(-2j * np.pi * f)) / np.polyval(a[::-1], np.exp(-2j * np.pi * f)))
    assert at(1e-6) == pytest.approx(1) and at(0.1) == pytest.approx(2**-0.5) and at(0.4) < 1e-3
    b, a = sp.butterworth(4, 0.1, None, 1.0)
    assert at(0.499) == pytest.approx(1, abs=1e-3) and at(0.1) == pytest.approx(2**-0.5) and at(0.01) < 1e-3
    b, a = sp.butterworth(4, 0.1, 0.2, 1.0)
    assert at(0.1) == pytest.approx(2**-0.5) and at(0.2) == pytest.approx(2**-0.5) and at(0.01) < 1e-3 and at(0.45) < 1e-3
    with pytest.raises(ValueError):
        sp.butterworth(4, None, 0.6, 1.0)


def test_zero_phase_filter_keeps_place_and_level():
    b, a = sp.butterworth(4, None, 0.05, 1.0)
    assert np.allclose(sp.zero_phase(b, a, np.full(100, 3.0)), 3.0)
    x = np.sin(np.arange(400) * 2 * np.pi * 0.01)
    assert np.abs(sp.zero_phase(b, a, x) - x)[50:-50].max() < 0.02
    assert len(sp.zero_phase(b, a, np.array([1.0]))) == 1


def best_split(x, penalty, min_size, jump):
    n = len(x)
    places = [k for k in range(jump, n, jump)]
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    best = None
    for k in range(4):
        for cut in itertools.combinations(places, k):
            e = [0, *cut, n]
            if all(b - a >= min_size for a, b in zip(e, e[1:])):
                c = sum(cost(a, b) for a, b in zip(e, e[1:])) + penalty * k
                if best is None or c < best[0] - 1e-9:
                    best = (c, list(cut))
    return best[1]


@pytest.mark.parametrize("seed", range(4))
def test_change_points_against_all_splits(seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(m, 0.3, 15) for m in r.choice([0, 3, 6], 3)])
    assert sp.pelt_l2(x, 2.0, 2, 5) == best_split(x, 2.0, 2, 5)


def cliff(n=1200, at=300, rise=400, fall=4, top=10.0):
    x = np.zeros(n)
    x[at : at + rise] = np.linspace(0, top, rise)
    x[at + rise : at + rise + fall] = np.linspace(top, 0, fall)
    return x


CLIFF = {"detrend_s": 2400.0, "same_fraction": 0.5, "slope_sigma": 4.0}


def test_ramp_then_cliff_is_one_drop(spark):
    rows, count = falls.detect(cliff(), **CLIFF)
    assert len(rows) == 1 and 700 <= rows[0][2] <= 702 and rows[0][4] < 0 and count["confirmed"] == 1
    for flat in (np.zeros(1000), np.full(1000, -0.42), np.zeros(2), np.zeros(0)):
        assert falls.detect(flat, **CLIFF)[0] == []
    assert falls.detect(np.linspace(0, 1, 1200), **{**CLIFF, "detrend_s": 300})[1]["confirmed"] == 0
    two = np.r_[cliff(), cliff()]
    assert [700 <= r[2] - k * 1200 <= 702 for k, r in enumerate(falls.detect(two, **CLIFF)[0])] == [True, True]
    narrow = falls.detect(two, **{**CLIFF, "detrend_s": 600.0})[0]  # the mean's own recovery falls slowly
    assert len(narrow) == 3 and sum(r[6] > 100 and r[5] < 3 for r in narrow) == 1
    two[1500:1900], two[1900:1904] = np.linspace(0, 20, 400), np.linspace(20, 0, 4)
    rows, count = falls.detect(two, **CLIFF, separation_s=2000.0)
    assert len(rows) == 1 and rows[0][2] > 1200 and count["rejected_duplicate"] == 1
    df = sig(spark, cliff(), np.zeros(10))
    assert [r.recording_id for r in falls.drops(df, **CLIFF).collect()] == [0]
    assert {(r.recording_id, r.n) for r in falls.drop_counts(df, **CLIFF).filter("stage = 'confirmed'").collect()} == {(0, 1), (1, 0)}
    assert falls.drop_gradients(df, **CLIFF).first().max_slope < -2


def test_fall_parts():
    ramp = np.r_[np.zeros(20), np.linspace(0, -30, 31)]
    assert falls.gradients(ramp, 25, 45) == pytest.approx((-1, -1, -1, 1))
    assert falls.gradients(ramp[:2], 0, 1) == (0, 0, 0, 0)
    up = lambda w: np.array(["DSU".index(c) for c in w])
    assert falls.bridged_rises(up("UUSUUDUSSU"), 0) == [(0, 2), (3, 5), (6, 7), (9, 10)]
    assert falls.bridged_rises(up("UUSUUDUSSU"), 1) == [(0, 5), (6, 7), (9, 10)]
    assert falls.bridged_rises(up("UUSUUDUSSU"), 2) == [(0, 5), (6, 10)]
    r = np.random.default_rng(3).normal(size=20000)
    assert falls.slope_noise(r) == pytest.approx(np.gradient(r).std(), rel=0.05)
    assert falls.slope_noise(np.arange(50.0)) == pytest.approx(0.049, rel=0.1) or falls.slope_noise(np.arange(50.0)) > 0
    assert falls.slope_noise(np.ones(50)) == 0


def test_surrogates():
    x = np.random.default_rng(0).normal(size=129).cumsum()
    for n in (128, 129):
        y = sp.surrogate(x[:n], 5)
        assert np.allclose(np.abs(np.fft.rfft(y)), np.abs(np.fft.rfft(x[:n]))) and np.isclose(y.mean(), x[:n].mean())
    assert np.allclose(np.sort(sp.surrogate(x, 5, "iaaft")), np.sort(x))
    assert len(sp.surrogate(x, 5, "bootstrap")) == len(x) and (sp.surrogate(x, 5) == sp.surrogate(x, 5)).all()


def test_edit_search_against_brute_force():
    def dist(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, q in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (p != q and p != -1))
        return row[-1]

    r = random.Random(0)
    text = [r.randrange(3) for _ in range(20)]
    seed = [1, -1, 2, 0]
    want = [min(dist(seed, text[a : j + 1]) for a in range(j + 2)) for j in range(20)]
    assert sp.edit_search(seed, np.array(text)).tolist() == want


# ---------------------------------------------------------------- symbols, profiles, search


def test_trend_words_on_engineered_signals(spark):
    up, down, flat = np.linspace(0, 10, 120), np.linspace(10, 0, 120), np.zeros(120)
    words = {r.recording_id: r.word for r in sy.letters(sy.trend_symbols(sy.trends(fr.z_normalise(sig(spark, up, down, flat)), 12))).collect()}
    assert words == {0: "U" * 10, 1: "D" * 10, 2: "S" * 10}


def test_find_shapes(spark, rows):
    df = spark.createDataFrame([(1, "SUUDDUDS"), (2, ""), (3, None)], "recording_id long, word string")
    assert rows(sy.find_shapes(df, "U+D+")) == [(1, 1, 4), (1, 5, 6)]


def test_word_distance_is_a_lower_bound():
    cuts, r = sy.cutlines(6), np.random.default_rng(2)
    table = sy.cell_table(cuts)
    for _ in range(200):
        a, b = search.scaled(r.normal(size=(2, 32)))
        pa, pb = a.reshape(8, 4).mean(1), b.reshape(8, 4).mean(1)
        word = sum(table[np.searchsorted(cuts, x, "right")][np.searchsorted(cuts, y, "right")] ** 2 for x, y in zip(pa, pb))
        assert math.sqrt(4 * word) <= np.linalg.norm(a - b) + 1e-9


def test_profile_tiles_agree(spark):
    x = np.random.default_rng(4).normal(size=90)
    x[60:68] = x[10:18]
    small = profile.matrix_profile(sig(spark, x), 8, tile=25).orderBy("idx").collect()
    z = profile.z_windows(x, 8)
    d = np.linalg.norm(z[:, None] - z[None], axis=2)
    i = np.arange(len(z))
    d[np.abs(i[:, None] - i[None]) <= 2] = np.inf
    assert np.allclose([r.dist for r in small], d.min(1)) and small[10].other == 60 and small[10].right == 60 and small[60].left == 10
    whole = profile.matrix_profile(sig(spark, x), 8)
    assert [(r.idx, r.following) for r in profile.links(whole).collect() if r.idx == 10] == [(10, 60)]
    groups = profile.motif_groups(sig(spark, x), whole, 8, 2)
    assert {(r.seed, r.member, r.rank) for r in groups.collect()} >= {(10, 10, 0), (10, 60, 1)}
    assert profile.matrix_profile(sig(spark, [1.0, 2.0]), 8).count() == 0


def test_chains_are_links_end_to_end(spark):
    near = [(0, 0, None, 5), (0, 5, 0, 9), (0, 9, 5, None), (0, 2, None, 7), (0, 7, 2, 9), (1, 3, None, None)]
    df = spark.createDataFrame(near, "recording_id long, idx long, left long, right long")
    got = {(r.chain, r.pos, r.idx, r.length, r.longest) for r in profile.chains(df).collect()}
    assert got == {(0, 0, 0, 3, True), (0, 1, 5, 3, True), (0, 2, 9, 3, True), (2, 0, 2, 2, False), (2, 1, 7, 2, False)}
    r = np.random.default_rng(1)
    near = [(0, k, k - 1 if k else None, k + 1) for k in range(200)]
    long = profile.chains(spark.createDataFrame(near, "recording_id long, idx long, left long, right long")).collect()
    assert sorted((c.pos, c.idx) for c in long) == [(k, k) for k in range(200)] and r is not None


def test_motif_groups_find_planted_patterns(spark):
    r, m = np.random.default_rng(0), 30
    t = np.linspace(0, 2 * np.pi, m)
    x = r.standard_normal(3000) * 0.02
    places = {0: [200, 700, 1200], 1: [1800, 2200, 2600]}
    for k, starts in places.items():
        for at in starts:
            x[at : at + m] = np.sin((k + 1) * t) + r.standard_normal(m) * 1e-4
    df = sig(spark, x)
    rows = profile.motif_groups(df, profile.matrix_profile(df, m), m, 3, most=5).collect()
    groups = {}
    for g in rows:
        groups.setdefault((g.profile_distance, g.seed), []).append(g.member)
    first = [sorted(v) for _, v in sorted(groups.items())]
    close = lambda a, b: all(abs(p - q) <= 2 for p, q in zip(a, b))
    for starts in places.values():
        assert any(close(g, starts) for g in first[:3])
    seeds = sorted(s for _, s in groups)
    assert len(groups) == 5 and all(b - a > m // 2 for a, b in zip(seeds, seeds[1:]))


def test_catalogue_texts(spark):
    from tidemark.operators import parsing

    cases = [("16 cycles", None, 16), ("4x sharkfin sequence", None, 4), ("14x sharkfin sequence", None, 14), ("2 sharps", None, 2), ("Regular sequence of 100 furrycaterpillars", None, 100), ("3 sequences", None, 3),
             (None, "60 spikes (7mV) then 40 spikes (6mV)", None), ("nested sharkfin sequence", None, None), ("single cycle; type specimen", None, 1), ("1 sharkfin", None, 1), ("2 spikes", "3 spikes", None), (None, None, None), ("", "", None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = [r.n for r in df.orderBy("k").select(parsing.event_count(F.col("a"), F.col("b")).alias("n")).collect()]
    assert got == [n for *_, n in cases]
    vocab = ["sharkfin", "trough", "crestedwave", "stegasaurus"]
    cells = [("crestedwave ; sharkfin", ["crestedwave", "sharkfin"]), ("sharkfins, troughs", ["sharkfin", "trough"]), ("Stegasauras", ["stegasaurus"]), ("Rolling  Hills", ["rolling_hills"]), (None, []), (" ; ,", []), ("a/b", ["a/b"])]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cells)], "k int, c string")
    assert [r.t for r in df.orderBy("k").select(parsing.terms(F.col("c"), vocab).alias("t")).collect()] == [t for _, t in cells]
    texts = [("single cycle; type specimen", "", True), ("1 sharkfin", "", True), ("nested sharkfin sequence", "", False), (None, None, False)]
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, a string, b string, p boolean").orderBy("k")
    assert [tuple(r) for r in df.select(parsing.structure_kind(F.col("a")), parsing.relation_kind(F.col("a"), F.col("b"), F.col("p"))).collect()] == [("type_specimen", "type_specimen"), (None, "sub_window"), ("nested_sequence", None), (None, None)]
    one = spark.createDataFrame([(3, 3, 0), (3, 4, 7)], "pack long, channel long, parent long")
    assert [r[0] for r in one.filter('channel = 3').select(parsing.global_channel(F.col("pack"), F.col("channel"))).collect()] == [15]
    with pytest.raises(Exception, match="no such channel"):
        one.select(parsing.global_channel(F.col("pack"), F.col("channel"))).collect()
    assert [r[0] for r in one.select(parsing.global_channel(F.col("pack"), F.col("channel"), strict=False)).collect()] == [15, None]
    assert [r[0] for r in one.select(parsing.parent_id(F.col("parent"))).collect()] == [None, 7]
    assert [tuple(r) for r in one.select(parsing.sample_index(F.lit(337.9), F.lit(1.0)), parsing.sample_index(F.lit(0.5), F.lit(2.0))).collect()] == [(1216440, 3600)] * 2


def test_bands_hold_their_upper_bounds(spark):
    seconds = [(0, "short"), (60, "short"), (61, "medium"), (600, "medium"), (900, "medium"), (901, "long"), (3600, "long"), (3601, "very_long"), (21600, "very_long"), (21601, "extreme"), (None, None)]
    counts = [(4, "short"), (5, "medium"), (9, "medium"), (10, "long"), (1000, "long"), (None, None)]
    for cases, bands in ((seconds, records.DURATION_BANDS), (counts, records.TRAIN_BANDS)):
        df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(cases)], "k int, v long").orderBy("k")
        assert [r[0] for r in df.select(records.band(F.col("v"), bands)).collect()] == [b for _, b in cases]


def test_segment_plans(spark):
    df = spark.createDataFrame([(265,), (1000,), (20,), (7201,)], "n long").withColumn("target", sy.recommended_symbols(F.col("n")))
    got = sy.planned(df, F.greatest(F.lit(1), F.bround(F.col("n") / F.col("target"), 0)), "n").orderBy("n").collect()
    assert [(r.n, r.symbols, r.per_symbol, r.trimmed) for r in got] == [(20, 20, 1, 0), (265, 15, 17, 10), (1000, 50, 20, 0), (7201, 257, 28, 5)]
    assert all(math.floor(r.dim_ratio * r.n) == r.symbols for r in got)
    with pytest.raises(ValueError):
        sy.samples_asked("letters", 1, F.lit(1), F.lit(1))


def test_spectral_entropy_is_of_the_power():
    x = 3 + np.cos(np.arange(64) * np.pi / 4)  # power 192^2 at 0 and 32^2 at one frequency
    p = np.array([192.0**2, 32.0**2])
    assert me.spectral_entropy(x) == pytest.approx(-(p / p.sum() * np.log2(p / p.sum())).sum())


def test_search_blocks_agree(spark, rows):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(90)], "id long, v array<double>")
    assert rows(search.nearest(df, 10, 4)) == rows(search.nearest(df, 10, 4, block=4))


def test_uncorrelated_and_kept_columns(spark):
    assert prepare.uncorrelated({(0, 1): 0.999, (1, 2): 0.5, (0, 2): -0.995}, [0, 1, 2]) == [0]
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 2.0, nan],), ([1.0, 3.0, nan],), ([1.0, 4.0, 1.0],)], "v array<double>")
    assert prepare.kept_columns(prepare.column_stats(df).collect()) == [1]


def test_correlations_of_all_columns(spark):
    r = np.random.default_rng(3)
    x = 1e6 + r.normal(size=(400, 12))
    x[:, 11] = -2 * x[:, 9] + r.normal(0, 0.1, 400)
    x[r.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "v array<double>").repartition(3)
    got = {(p.a, p.b): p.r for p in prepare.correlations(df).collect()}
    assert sorted(got) == list(itertools.combinations(range(12), 2))
    for (a, b), value in got.items():
        fine = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
        assert abs(value - np.corrcoef(x[fine, a], x[fine, b])[0, 1]) < 1e-7
    some = {(p.a, p.b): p.r for p in prepare.correlations(df, [9, 11, 20]).collect()}
    assert list(some) == [(9, 11)] and abs(some[9, 11] - got[9, 11]) < 1e-9 and got[9, 11] < -0.99
    flat = spark.createDataFrame([([0.1, float(k)],) for k in range(7)], "v array<double>").repartition(3)
    assert [tuple(p) for p in prepare.correlations(flat).collect()] == [(0, 1, None)]


# ---------------------------------------------------------------- recipes, sources, streaming


def test_recipes(spark, tmp_path):
    steps = [{"stage": "preprocessing", "algorithm": "detrend", "params": {"window": 9}}, {"stage": "detection", "algorithm": "trend_symbols", "params": {}}]
    r = rec.make(3, steps, (10, 60))
    assert rec.problems(r) == [] and rec.canonical(r) == rec.canonical(rec.make(3, [dict(reversed(s.items())) for s in steps], (10, 60)))
    assert len(rec.short_hash(r)) == 8 and rec.short_hash(r) != rec.short_hash(rec.make(3, steps))
    assert rec.problems(rec.make(3, steps[::-1])) and rec.problems(rec.make(3, [{"stage": "x", "algorithm": "y"}]))
    assert rec.problems(rec.make(3, [{"stage": "preprocessing", "algorithm": "detrend", "params": {"what": 1}}]))
    for bad in (lambda: rec.make(3, steps, (5, 5)), lambda: rec.compile_plan(rec.make(3, [{"stage": "catalogue", "algorithm": "sum_field"}], (0, 9000)), None)):
        with pytest.raises((ValueError, AttributeError)):
            bad()
    df = sig(spark, *[np.sin(np.arange(80) / (k + 2)) for k in range(5)])
    with pytest.raises(PermissionError):
        rec.compile_plan(r, df, held_out=frozenset({3}))
    runs = rec.Runs(spark, str(tmp_path))
    first = sorted(map(tuple, runs.run(r, df, "v1").collect()))
    assert runs.done(r, "v1") and not runs.done(r, "v2") and sorted(map(tuple, runs.run(r, df.limit(0), "v1").collect())) == first and first
    assert rec.tier(None) is None and [rec.tier(x) for x in (60, 61, 901)] == ["interactive", "background", "cluster"]
    a, b = (rec.content_hash(x).collect() for x in (df, df.orderBy(F.desc("idx"))))
    assert sorted(a) == sorted(b)
    twice = rec.content_hash(df.unionByName(df)).collect()
    assert not {r.content for r in twice} & {r.content for r in a}  # equal rows do not cancel
    with pytest.raises(PermissionError):
        runs.run(r, df, "v1", held_out=frozenset([r["recording_id"]]))
    assert runs.run(r, df, "v1", held_out=frozenset([r["recording_id"]]), unlocked=True).count() == len(first)
    with pytest.raises(ValueError):
        rec.register(rec.get("preprocessing", "detrend"))


def test_recipe_over_all_recordings(spark):
    df = sig(spark, *[np.sin(np.arange(90 + 7 * k) / (k + 2)) for k in range(4)])
    chain = [{"stage": "preprocessing", "algorithm": "detrend"}, {"stage": "detection", "algorithm": "trend_symbols"}]
    found = lambda k: {(r.recording_id, r.seg): (r.symbol, r.delta) for r in rec.compile_plan(rec.make(k, chain), df).collect()}
    got, want = found(None), {at: r for k in range(4) for at, r in found(k).items()}
    assert {k for k, _ in got} == set(range(4)) and got.keys() == want.keys()
    assert all(got[at][0] == want[at][0] and abs(got[at][1] - want[at][1]) < 1e-9 for at in want)  # sums of a shuffle come in any order
    assert rec.full_hash(rec.make(None, chain)) != rec.full_hash(rec.make(0, chain))
    with pytest.raises(PermissionError):
        rec.compile_plan(rec.make(None, chain), df, held_out=frozenset({3}))


@pytest.mark.parametrize("op", [f"{o.stage}.{o.name}" for o in rec.operators()])
def test_every_operator_runs_with_defaults(spark, op):
    stage, name = op.split(".")
    df = sig(spark, np.sin(np.arange(130) / 5) + np.random.default_rng(0).normal(0, 0.1, 130))
    assert rec.compile_plan(rec.make(0, [{"stage": stage, "algorithm": name}]), df).count() >= 0


def test_channel_files(spark, tmp_path, rows):
    np.save(tmp_path / "one.npy", np.arange(5.0))
    np.save(tmp_path / "two.npy", np.arange(6.0).reshape(3, 2))
    got = files.read_npy(spark, str(tmp_path), chunk=2)
    assert sorted((r.path.rsplit("/", 1)[1], r.channel, r.idx, r.x) for r in got.collect()) == sorted([("one.npy", 0, i, float(i)) for i in range(5)] + [("two.npy", c, i, 2.0 * i + c) for i in range(3) for c in range(2)])
    (tmp_path / "t.csv").write_text("n,a,b\n0,1.5,2\n1,,3\n")
    got = files.read_csv_channels(spark, str(tmp_path / "t.csv"), ["a", "b"], "n")
    assert sorted(((r.channel, r.idx, r.x) for r in got.collect()), key=repr) == sorted([(0, 0, 1.5), (0, 1, None), (1, 0, 2.0), (1, 1, 3.0)], key=repr)
    with pytest.raises(ValueError):
        files.read_csv_channels(spark, "x", ["a"])
    with pytest.raises(ValueError):
        files.split_concatenated(None, 3, 10)
    assert files.artifact_name("mp", "a b", {"m": 8, "f": 0.5}) == "mp_a-b_f0p5_m8"


def test_store_resumes(spark, tmp_path):
    df = sig(spark, np.sin(np.arange(100) / 3))
    grid = fr.window_grid(df, 32, 16)
    store = files.FeatureStore(spark, str(tmp_path / "m"))
    assert store.missing(grid, "svd_entropy").count() == grid.count() == 5
    wide = me.per_window(fr.windowed(df, 32, 16), ["recording_id", "start_idx"], me.FAST)
    store.add(wide.filter("start_idx < 30"), list(me.FAST))
    assert store.missing(grid, "svd_entropy").count() == 3
    store.add(wide, list(me.FAST))
    assert store.read().count() == 5 * len(me.FAST)
    assert {(r.computed, r.total) for r in store.progress(grid, list(me.FAST)).collect()} == {(5, 5)}


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src = tmp_path / "in"
    rows = [("a", t0 + dt.timedelta(minutes=m), 1.0) for m in (0, 1, 2, 30, 31)] + [("z", t0 + dt.timedelta(days=1), 0.0)]
    spark.createDataFrame(rows, "k string, at timestamp, v double").write.parquet(str(src))
    stream = spark.readStream.schema("k string, at timestamp, v double").parquet(str(src))
    for name, df in (("sess", live.event_sessions(stream, "k", "at", "5 minutes", "10 minutes")), ("wins", live.window_stats(stream, "k", "at", "v", "10 minutes", "10 minutes"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.n for r in spark.table("sess").filter("k = 'a'").collect()) == [2, 3]
    assert sorted(r.n for r in spark.table("wins").filter("k = 'a'").collect()) == [2, 3]
    keeper = live.OrphanStream(spark)
    cols = "is_ref boolean, ref_table string, row_id long, parent_kind string, parent_key string, ref_at timestamp, first_at timestamp, version timestamp, removed boolean"
    keeper.batch(spark.createDataFrame([(True, "t", 1, "k", "a", t0, None, None, None)], cols), 0)
    assert [r.kind for r in keeper.state.faults().collect()] == ["missing"]
    keeper.batch(spark.createDataFrame([(False, None, None, "k", "a", None, t0, None, False)], cols), 1)
    assert keeper.state.faults().count() == 0
    again = live.OrphanStream(spark, keeper.state.folder)  # a stream that starts again sends its last batch once more
    again.batch(spark.createDataFrame([(False, None, None, "k", "a", None, t0, None, False)], cols), 1)
    again.batch(spark.createDataFrame([(True, "t", 2, "k", "b", t0, None, None, None)], cols), 2)
    assert [(r.row_id, r.kind) for r in again.state.faults().collect()] == [(2, "missing")]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, rows, how):
    from tidemark.operators.salting import salted_join

    df = spark.createDataFrame([(k, i) for i in range(60) for k in [1 if i % 3 else i % 7]] + [(None, 99), (50, 98)], "k long, i long")
    one = spark.createDataFrame([(k, k * 10) for k in range(7)], "k long, v long")
    assert rows(salted_join(df, one, ["k"], ["i"], how, salts=4, hot=5)) == rows(df.join(one, "k", how))


def test_learned_cut_lines():
    from tidemark.operators import learned

    r = np.random.default_rng(0)
    v = np.concatenate([r.normal(m, 0.1, 80) for m in (-4, 0, 5)])
    for cuts in (learned.lloyd_max(v, 3), learned.mode_cuts(v)):
        assert np.allclose(cuts, [-2, 2.5], atol=0.3)
    assert len(learned.lloyd_max(np.ones(9), 4)) == 0 and len(learned.mode_cuts(np.ones(9))) == 9


def test_ward_against_the_definition():
    from tidemark.operators import linkage

    x = np.random.default_rng(1).normal(size=(14, 3))
    x[:5] += 9
    groups, heights = [[i] for i in range(14)], []
    while len(groups) > 1:
        cost = lambda a, b: np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        h, i, j = min((cost(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        heights.append(h)
        groups[i] += groups.pop(j)
    m = linkage.ward(x)
    assert np.allclose(m[:, 2], heights) and m[-1, 3] == 14
    assert linkage.suggest(m) == 2 and linkage.cut(m, 2).tolist() == [0] * 5 + [1] * 9
    assert linkage.silhouette(x, linkage.cut(m, 2)) > 0.6
    with pytest.raises(ValueError):
        linkage.ward(x[:1])
