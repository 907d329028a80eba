"""Queries of the frame and island operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.operators import islands as isl
from tidemark.operators.store import bins_between
from tidemark.queries.base import LEN, NOTES, RECS, SIG, notes, r6, recs, signal
from tidemark.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def xr(df):
    return df.select("recording_id", "idx", r6("x").alias("x"))


query("span_slice", f"WITH {SIG} SELECT * FROM sig WHERE idx >= 10 AND idx < 40")(lambda s, d: fr.span(signal(s, d), 10, 40))
query("cut_percent", f"WITH {SIG}, {LEN} SELECT recording_id, idx, x FROM sig JOIN len USING (recording_id) WHERE idx < floor(0.25 * n)")(lambda s, d: fr.first_share(signal(s, d), 0.25))
query("downsample", f"WITH {SIG} SELECT recording_id, idx // 5 idx, x FROM sig WHERE idx % 5 = 0")(lambda s, d: fr.downsample(signal(s, d), 10, 2))
query("rolling_mean", f"WITH {SIG} SELECT recording_id, idx, round(avg(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) + 0.0 mean FROM sig")(
    lambda s, d: fr.rolling_mean(signal(s, d), 7).select("recording_id", "idx", r6("mean").alias("mean"))
)
query("detrend_rolling_mean", f"WITH {SIG} SELECT recording_id, idx, round(x - avg(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) + 0.0 x FROM sig")(
    lambda s, d: xr(fr.detrend(signal(s, d), window=10))
)
query(
    "detrend_rolling_z",
    f"WITH {SIG}, a AS (SELECT recording_id, idx, x - avg(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) x FROM sig), b AS (SELECT *, stddev_pop(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) sd FROM a) SELECT recording_id, idx, CASE WHEN sd <= 1e-12 THEN 0.0 ELSE round(x / sd, 6) + 0.0 END x FROM b",
)(lambda s, d: xr(fr.detrend(signal(s, d), "rolling_z", 10)))
query(
    "detrend_linear",
    f"WITH {SIG}, f AS (SELECT recording_id, regr_slope(x, idx) b, regr_intercept(x, idx) a, avg(x) m FROM sig GROUP BY ALL) SELECT recording_id, idx, round(x - CASE WHEN b IS NULL OR isnan(b) THEN m ELSE a + b * idx END, 6) + 0.0 x FROM sig JOIN f USING (recording_id)",
)(lambda s, d: xr(fr.detrend(signal(s, d), "linear")))
_NEAR = "WITH {sig}, {len}, near AS (SELECT s.recording_id, s.idx, s.x, s.n, q.x y FROM (SELECT recording_id, idx, x, n, unnest(range({a}, {b})) k FROM sig JOIN len USING (recording_id)) s JOIN sig q ON q.recording_id = s.recording_id AND q.idx = least(greatest(s.idx + s.k, 0), s.n - 1))"
query("denoise", _NEAR.format(sig=SIG, len=LEN, a=-1, b=2) + " SELECT recording_id, idx, round(avg(y), 6) + 0.0 x FROM near GROUP BY ALL")(lambda s, d: xr(fr.replicated_mean(signal(s, d), 3).withColumn("x", F.col("mean"))))
query("uniform_detrend", _NEAR.format(sig=SIG, len=LEN, a=-3, b=3) + ", whole AS (SELECT recording_id, avg(x) m FROM sig GROUP BY ALL) SELECT recording_id, idx, round(any_value(x) - CASE WHEN any_value(n) <= 6 THEN any_value(m) ELSE avg(y) END, 6) + 0.0 x FROM near JOIN whole USING (recording_id) GROUP BY recording_id, idx")(
    lambda s, d: xr(fr.uniform_detrend(signal(s, d), 6))
)
query("rolling_median", _NEAR.format(sig=SIG, len=LEN, a=-2, b=3) + " SELECT recording_id, idx, median(y) x FROM near GROUP BY recording_id, idx")(lambda s, d: fr.rolling_median(signal(s, d), 2))
query("median_detrend", _NEAR.format(sig=SIG, len=LEN, a=-4, b=5) + " SELECT recording_id, idx, round(any_value(x) - median(y), 6) + 0.0 x FROM near GROUP BY recording_id, idx")(lambda s, d: xr(fr.median_detrend(signal(s, d), 4)))
query(
    "median_filter",
    _NEAR.format(sig=SIG, len=LEN, a=-2, b=3) + ", sm AS (SELECT recording_id, idx, any_value(n) n, median(y) x FROM near GROUP BY recording_id, idx), near2 AS (SELECT s.recording_id, s.idx, s.x, q.x y FROM (SELECT *, unnest(range(-4, 5)) k FROM sm) s JOIN sm q ON q.recording_id = s.recording_id AND q.idx = least(greatest(s.idx + s.k, 0), s.n - 1)) SELECT recording_id, idx, round(any_value(x) - median(y), 6) + 0.0 x FROM near2 GROUP BY recording_id, idx",
)(lambda s, d: xr(fr.median_filter(signal(s, d), 2)))
query("centre_on_median", f"WITH {SIG} SELECT recording_id, idx, round(x - median(x) OVER (PARTITION BY recording_id), 6) + 0.0 x FROM sig")(lambda s, d: xr(fr.centre_on_median(signal(s, d))))
query("z_normalise", f"WITH {SIG}, f AS (SELECT recording_id, avg(x) m, stddev_pop(x) sd FROM sig GROUP BY ALL) SELECT recording_id, idx, CASE WHEN sd = 0 THEN 0.0 ELSE round((x - m) / sd, 6) + 0.0 END x FROM sig JOIN f USING (recording_id)")(lambda s, d: xr(fr.z_normalise(signal(s, d))))
query("gradient", f"WITH {SIG}, g AS (SELECT *, lag(x) OVER w p, lead(x) OVER w q FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) SELECT recording_id, idx, round(coalesce((q - p) / 2, q - x, x - p), 6) + 0.0 dx FROM g")(
    lambda s, d: fr.gradient(signal(s, d)).select("recording_id", "idx", r6("dx").alias("dx"))
)
query("second_derivative", f"WITH {SIG}, g AS (SELECT *, lag(x) OVER w p, lead(x) OVER w q FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) SELECT recording_id, idx, round((coalesce(q, x) - 2 * x + coalesce(p, x)) / 4, 6) + 0.0 d2 FROM g")(
    lambda s, d: fr.second_derivative(signal(s, d)).select("recording_id", "idx", r6("d2").alias("d2"))
)
query("window_grid", f"WITH {SIG}, {LEN} SELECT recording_id, s start_idx, 16::INTEGER length, s + 16 <= n is_full FROM (SELECT recording_id, n, unnest(range(0, n, 8)) s FROM len)")(lambda s, d: fr.window_grid(signal(s, d), 16, 8, partial_tail=True))
query("window_means", f"WITH {SIG}, {LEN}, g AS (SELECT recording_id, unnest(range(0, n - 15, 6)) start_idx FROM len WHERE n >= 16) SELECT recording_id, start_idx, count(*) n, round(avg(x), 6) + 0.0 mean FROM g JOIN sig USING (recording_id) WHERE idx >= start_idx AND idx < start_idx + 16 GROUP BY ALL")(
    lambda s, d: fr.windowed(signal(s, d), 16, 6).groupBy("recording_id", "start_idx").agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"))
)
query("decimate", f"WITH {SIG}, {LEN}, b AS (SELECT recording_id, idx, x, (idx * 10) // n b FROM sig JOIN len USING (recording_id)), m AS (SELECT recording_id, b, min(x) lo, max(x) hi FROM b GROUP BY ALL) SELECT recording_id, min(idx) idx, x FROM b JOIN m USING (recording_id, b) WHERE x = lo OR x = hi GROUP BY recording_id, b, x")(lambda s, d: fr.decimate(signal(s, d), 10))
_SP = f"WITH {SIG}, c AS (SELECT *, sum(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) s FROM sig), cand AS (SELECT recording_id, idx, x FROM c WHERE abs(x) - abs(s / 20) > 60)"
query("spike_candidates", _SP + " SELECT * FROM cand")(lambda s, d: fr.spike_candidates(signal(s, d), 5, 60.0))
_REFR = _SP.replace("WITH sig", "WITH RECURSIVE sig") + ", kept AS (SELECT recording_id, min(idx) idx FROM cand GROUP BY ALL UNION ALL SELECT k.recording_id, (SELECT min(c.idx) FROM cand c WHERE c.recording_id = k.recording_id AND c.idx >= k.idx + 8) FROM kept k WHERE k.idx IS NOT NULL), spikes AS (SELECT recording_id, idx FROM kept WHERE idx IS NOT NULL)"


def spikes(s, d):
    return isl.refractory(fr.spike_candidates(signal(s, d), 5, 60.0), ["recording_id"], "idx", 8)


query("spikes_refractory", _REFR + " SELECT * FROM spikes")(spikes)
query("spike_intervals", _REFR + f", {LEN}, m AS (SELECT recording_id, idx p FROM spikes UNION SELECT recording_id, 0 FROM len UNION SELECT recording_id, n FROM len) SELECT recording_id, p start_idx, nxt end_idx FROM (SELECT *, lead(p) OVER (PARTITION BY recording_id ORDER BY p) nxt FROM m) WHERE nxt IS NOT NULL")(
    lambda s, d: isl.between(spikes(s, d), fr.lengths(signal(s, d)), "idx")
)
query("spike_sessions", _REFR + ", g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) <= 12 THEN 0 ELSE 1 END c FROM spikes), h AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY idx) k FROM g) SELECT recording_id, greatest(0, min(idx) - 3) start_idx, max(idx) + 3 end_idx, count(*) n FROM h GROUP BY recording_id, k HAVING count(*) >= 2")(
    lambda s, d: isl.sessions(spikes(s, d), ["recording_id"], "idx", 12, 2, 3)
)
query("spike_jitter", _REFR + ", g AS (SELECT recording_id, idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) gap FROM spikes) SELECT recording_id, median(gap) median_gap, count(gap) n FROM g GROUP BY ALL HAVING count(gap) > 0")(lambda s, d: _jitter(spikes(s, d)))


def _jitter(points):
    from pyspark.sql import Window

    gap = F.col("idx") - F.lag("idx").over(Window.partitionBy("recording_id").orderBy("idx"))
    return points.select("recording_id", gap.alias("gap")).groupBy("recording_id").agg(F.percentile("gap", 0.5).alias("median_gap"), F.count("gap").alias("n")).filter("n > 0")


query("high_regions", f"WITH {SIG}, q AS (SELECT recording_id, quantile_cont(x, 0.75) t FROM sig GROUP BY ALL), h AS (SELECT recording_id, idx FROM sig JOIN q USING (recording_id) WHERE x > t), g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END c FROM h), k AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY idx) g FROM g) SELECT recording_id, min(idx) first_idx, max(idx) last_idx FROM k GROUP BY recording_id, g HAVING max(idx) - min(idx) + 1 >= 3")(
    lambda s, d: isl.regions(signal(s, d).join(signal(s, d).groupBy("recording_id").agg(F.percentile("x", 0.75).alias("t")), "recording_id"), ["recording_id"], F.col("x") > F.col("t"), 2, 3)
)
query("high_regions_zscore", f"WITH {SIG}, q AS (SELECT recording_id, avg(x) + stddev_pop(x) t FROM sig GROUP BY ALL), h AS (SELECT recording_id, idx FROM sig JOIN q USING (recording_id) WHERE x > t), g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) <= 3 THEN 0 ELSE 1 END c FROM h), k AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY idx) g FROM g) SELECT recording_id, min(idx) first_idx, max(idx) last_idx FROM k GROUP BY recording_id, g HAVING max(idx) - min(idx) + 1 >= 2")(
    lambda s, d: isl.regions(signal(s, d).join(signal(s, d).groupBy("recording_id").agg((F.avg("x") + F.stddev_pop("x")).alias("t")), "recording_id"), ["recording_id"], F.col("x") > F.col("t"), 3, 2)
)


def level_runs(s, d):
    sig = signal(s, d)
    mid = sig.groupBy("recording_id").agg(((F.min("x") + F.max("x")) / 2).alias("mid"))
    return isl.runs(sig.join(mid, "recording_id").withColumn("high", F.col("x") >= F.col("mid")), ["recording_id"], "idx", "high")


_RLE = f"WITH {SIG}, m AS (SELECT recording_id, (min(x) + max(x)) / 2 mid FROM sig GROUP BY ALL), h AS (SELECT recording_id, idx, x >= mid high FROM sig JOIN m USING (recording_id)), g AS (SELECT *, idx - row_number() OVER (PARTITION BY recording_id, high ORDER BY idx) k FROM h), r AS (SELECT recording_id, high, min(idx) first_idx, max(idx) last_idx, count(*) n FROM g GROUP BY recording_id, high, k)"
query("run_length", _RLE + " SELECT * FROM r")(level_runs)


def transitions(s, d):
    """Chunks from each fall below the middle level to the next rise above it."""
    from pyspark.sql import Window

    w = Window.partitionBy("recording_id").orderBy("first_idx")
    low = level_runs(s, d).withColumn("after", F.lead("first_idx").over(w)).withColumn("seen", F.lag("last_idx").over(w)).filter("not high and seen is not null and after is not null")
    return low.select("recording_id", F.col("first_idx").alias("start_idx"), F.col("after").alias("end_idx"))


query("low_chunks", _RLE + ", o AS (SELECT *, lead(first_idx) OVER w nxt, lag(last_idx) OVER w prv FROM r WINDOW w AS (PARTITION BY recording_id ORDER BY first_idx)) SELECT recording_id, first_idx start_idx, nxt end_idx FROM o WHERE NOT high AND prv IS NOT NULL AND nxt IS NOT NULL")(transitions)


def state_levels(s, d):
    """Means of the low and high part of a 100-bin histogram, split in the middle of the occupied bins."""
    sig = signal(s, d)
    m = sig.groupBy("recording_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 100
    b = sig.join(m, "recording_id").filter("hi > lo").withColumn("bin", F.least(F.lit(99), F.floor((F.col("x") - F.col("lo")) / width)))
    h = b.groupBy("recording_id", "bin", "lo", "hi").agg(F.count("*").alias("c"))
    mid = h.groupBy("recording_id").agg(((F.min("bin") + F.max("bin")) / 2).alias("mid"))
    at = F.col("lo") + (F.col("bin") + 0.5) * width
    j = h.join(mid, "recording_id").withColumn("at", at)
    # sums, not means, are rounded: a mean of few values often ends in exactly half of the last place
    side = lambda c: F.round(F.sum(F.when(c, F.col("at") * F.col("c"))), 5) / F.sum(F.when(c, F.col("c")))
    return j.groupBy("recording_id").agg(side(F.col("bin") <= F.col("mid")).alias("low"), side(F.col("bin") > F.col("mid")).alias("high"))


query("state_levels", f"WITH {SIG}, m AS (SELECT recording_id, min(x) lo, max(x) hi FROM sig GROUP BY ALL), b AS (SELECT recording_id, least(99, floor((x - lo) / ((hi - lo) / 100))) bin, lo, hi, count(*) c FROM sig JOIN m USING (recording_id) WHERE hi > lo GROUP BY ALL), k AS (SELECT recording_id, (min(bin) + max(bin)) / 2 mid FROM b GROUP BY ALL), j AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 100 lv FROM b JOIN k USING (recording_id)) SELECT recording_id, round(sum(lv * c) FILTER (bin <= mid), 5) / sum(c) FILTER (bin <= mid) low, round(sum(lv * c) FILTER (bin > mid), 5) / sum(c) FILTER (bin > mid) high FROM j GROUP BY recording_id")(state_levels)

EDGES = bins_between(1, 100)


def next_change(s, d):
    """Each 16-sample window's next change, and its bin among signed semi-logarithmic edges."""
    sig = signal(s, d)
    at = fr.framed(sig, 1, 0, change=lambda w: F.col("x") - F.lag("x").over(w)).select("recording_id", "idx", "change")
    grid = fr.window_grid(sig, 16, 8).select("recording_id", "start_idx", (F.col("start_idx") + 16).alias("idx"))
    return grid.join(at, ["recording_id", "idx"]).select("recording_id", "start_idx", r6("change").alias("change"), fr.signed_bins(EDGES, F.round("change", 6)).alias("bin"))


query("next_change", f"WITH {SIG}, {LEN}, c AS (SELECT recording_id, idx, round(x - lag(x) OVER (PARTITION BY recording_id ORDER BY idx), 6) + 0.0 change FROM sig), g AS (SELECT recording_id, unnest(range(0, n - 15, 8)) start_idx FROM len WHERE n >= 16) SELECT g.recording_id, start_idx, change, (" + " + ".join(f"(change >= {e})::INTEGER" for e in (-100, -50, -10, -5, -1, 0, 1, 5, 10, 50, 100)) + ")::INTEGER bin FROM g JOIN c ON c.recording_id = g.recording_id AND c.idx = start_idx + 16")(next_change)
query("bin_error", f"WITH {SIG} SELECT recording_id, idx, round(CASE WHEN x < 50 THEN 50 - x WHEN x > 200 THEN x - 200 ELSE 0 END, 6) + 0.0 err FROM sig")(
    lambda s, d: signal(s, d).select("recording_id", "idx", r6(F.when(F.col("x") < 50, 50 - F.col("x")).when(F.col("x") > 200, F.col("x") - 200).otherwise(0.0)).alias("err"))
)

# ---------------------------------------------------------------- channels and labels
query("split_channels", "SELECT event_id // 625 channel, event_id % 625 idx, value x FROM events")(lambda s, d: read(s, d, "events").select(F.floor(F.col("event_id") / 625).alias("channel"), F.pmod("event_id", F.lit(625)).alias("idx"), F.col("value").alias("x")))
query("derive_fs", f"WITH {RECS} SELECT id, TRY_CAST(nullif(regexp_extract(regexp_replace(trim(source_file), '\\.[A-Za-z][A-Za-z0-9]*$', ''), '_fs([0-9]+(\\.[0-9]+)?)$', 1), '') AS DOUBLE) fs_name FROM recs")(
    lambda s, d: recs(s, d).select("id", F.expr("try_cast(nullif(regexp_extract(regexp_replace(trim(source_file), '\\\\.[A-Za-z][A-Za-z0-9]*$', ''), '_fs([0-9]+(\\\\.[0-9]+)?)$', 1), '') as double)").alias("fs_name"))
)
_LAB = f"WITH {NOTES}, {RECS}, lay AS (SELECT source_file, max(n_samples) len, max(n_samples) * count(DISTINCT channel) total FROM recs WHERE source_file IS NOT NULL GROUP BY ALL HAVING count(DISTINCT n_samples) = 1 AND max(n_samples) > 0), m AS (SELECT n.id, r.source_file, len, total, start_idx, end_idx, verdict, floor(start_idx / len)::BIGINT channel FROM notes n LEFT JOIN recs r ON r.id = n.recording_id LEFT JOIN lay USING (source_file) WHERE end_idx > start_idx), l AS (SELECT id, source_file, channel, start_idx - coalesce(channel * len, 0) local_start, end_idx - start_idx n, CASE WHEN start_idx < 0 OR end_idx > total THEN 'out_of_bounds' WHEN len IS NULL THEN 'no_layout' WHEN start_idx - channel * len + (end_idx - start_idx) > len THEN 'straddles' ELSE 'imported' END status, verdict FROM m)"


def place_labels(rows, recordings):
    """Every label window to its source file's channels, of the length and number that its recordings have; starts below 0 are out of bounds.

    A source without recordings, or with channels of different lengths, has no layout; such labels keep their start.
    """
    lay = recordings.filter("source_file is not null").groupBy("source_file").agg(F.max("n_samples").alias("len"), F.count_distinct("n_samples").alias("lengths"), F.count_distinct("channel").alias("channels"))
    lay = lay.filter("lengths = 1 and len > 0").select("source_file", "len", (F.col("len") * F.col("channels")).alias("total"))
    of = rows.filter("end_idx > start_idx").join(recordings.select(F.col("id").alias("recording_id"), "source_file"), "recording_id", "left").join(lay, "source_file", "left")
    n, channel = F.col("end_idx") - F.col("start_idx"), F.floor(F.col("start_idx") / F.col("len"))
    local = F.col("start_idx") - F.coalesce(channel * F.col("len"), F.lit(0))
    status = F.when((F.col("start_idx") < 0) | (F.col("end_idx") > F.col("total")), "out_of_bounds").when(F.col("len").isNull(), "no_layout").when(local + n > F.col("len"), "straddles").otherwise("imported")
    return of.select("id", "source_file", channel.alias("channel"), local.alias("local_start"), n.alias("n"), status.alias("status"), "verdict")


def label_counts(placed):
    """Labels of each status; of imported ones, equal windows of one verdict count once."""
    return placed.withColumn("id", F.when(F.col("status") != "imported", F.col("id"))).distinct().groupBy("status").agg(F.count("*").alias("n_labels"))


query("global_to_local", _LAB + " SELECT id, source_file, channel, local_start, n, status FROM l")(lambda s, d: place_labels(notes(s, d), recs(s, d)).drop("verdict"))
query("import_labels", _LAB + ", u AS (SELECT DISTINCT source_file, channel, local_start, n, status, verdict, CASE WHEN status != 'imported' THEN id END id FROM l) SELECT status, count(*) n_labels FROM u GROUP BY ALL")(lambda s, d: label_counts(place_labels(notes(s, d), recs(s, d))))
