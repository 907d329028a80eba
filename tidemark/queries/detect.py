"""Queries of whole-signal detectors, multi-scale symbols, snippets and comparisons of span sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import falls
from tidemark.operators import frames as fr
from tidemark.operators import spectral as sp
from tidemark.operators import sweep
from tidemark.operators import symbols as sy
from tidemark.queries.base import NOTES, SIG, notes, r6, signal
from tidemark.queries.features import _DSAX, dsax
from tidemark.queries.records import _REV, reviewed
from tidemark.tables import first_loaded, read

QUERIES: dict = {}
SQL: dict[str, str] = {}
R = "recording_id"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("lowpass_filter")(lambda s, d: sp.filtered(signal(s, d), 1.0, high=0.1))
query("bandpass_filter")(lambda s, d: sp.filtered(signal(s, d), 1.0, 0.05, 0.2))
query("change_points")(lambda s, d: sp.change_points(signal(s, d), 15000.0))
FALLS = {"detrend_s": 20.0, "segment_s": 4.0, "slope_sigma": 1.0}
query("change_points_binary")(lambda s, d: sp.change_points(signal(s, d), breaks=3, algorithm="binary"))
query("change_points_bottom_up")(lambda s, d: sp.change_points(signal(s, d), 15000.0, algorithm="bottom_up"))
query("change_points_window")(lambda s, d: sp.change_points(signal(s, d), breaks=2, algorithm="window", jump=1))
query("drops")(lambda s, d: falls.drops(signal(s, d), **FALLS))
query("drop_counts")(lambda s, d: falls.drop_counts(signal(s, d), **FALLS))
query("drop_gradients")(lambda s, d: falls.drop_gradients(signal(s, d), **FALLS))
query("wavelet_energy")(lambda s, d: sp.per_recording(signal(s, d), sp.morse_energy, "value"))
query("signal_envelope")(lambda s, d: sp.per_recording(signal(s, d), sp.envelope, "value"))
query("surrogates")(lambda s, d: sp.per_recording(signal(s, d), lambda x: sp.surrogate(x, 1, "iaaft")))
query("log_spectrum")(lambda s, d: sp.marks(signal(s, d), lambda x: [(k, float(v)) for k, v in enumerate(sp_bands(x))], "band long, power double"))


def sp_bands(x):
    from tidemark.operators.measures import stft_log_spectrum

    return stft_log_spectrum(x, 32, 16, 12) if len(x) >= 32 else []


# ---------------------------------------------------------------- multi-scale symbols


def pyramid(s, d, scales=(4, 8, 16)):
    """Segment means at nested scales and two phases each; every sample is read once and sent to its segment of each scale."""
    opts = F.array(*[F.struct(F.lit(k).alias("scale"), F.lit(o).alias("phase")) for k in scales for o in (0, k // 2)])
    e = signal(s, d).select(R, "idx", "x", F.inline(opts)).filter("idx >= phase")
    seg = F.floor((F.col("idx") - F.col("phase")) / F.col("scale")).cast("long")
    g = e.groupBy(R, "scale", "phase", seg.alias("seg")).agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    return g.filter("n = scale").select(R, "scale", "phase", "seg", r6("mean").alias("mean"))


query("segment_pyramid", f"WITH {SIG}, o AS (SELECT unnest([4, 4, 8, 8, 16, 16])::INTEGER scale, unnest([0, 2, 0, 4, 0, 8])::INTEGER phase) SELECT recording_id, scale, phase, (idx - phase) // scale seg, round(avg(x), 6) + 0.0 mean FROM sig, o WHERE idx >= phase GROUP BY ALL HAVING count(*) = scale")(pyramid)


def transitions(s, d):
    w = Window.partitionBy(R).orderBy("seg")
    return dsax(s, d).select(F.col("symbol").alias("a"), F.lead("symbol").over(w).alias("b")).filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


query("symbol_transitions", _DSAX + " SELECT a, b, count(*) n FROM (SELECT symbol a, lead(symbol) OVER (PARTITION BY recording_id ORDER BY seg) b FROM sym) WHERE b IS NOT NULL GROUP BY ALL")(transitions)
query("endpoint_trends", f"WITH {SIG} SELECT recording_id, idx // 6 seg, round(max_by(x, idx) - min_by(x, idx), 6) + 0.0 delta FROM sig GROUP BY ALL HAVING count(*) = 6")(lambda s, d: sy.trends(signal(s, d), 6, "endpoints").withColumn("delta", r6("delta")))

# ---------------------------------------------------------------- snippets


def snippets(s, d, pad=4, length=8):
    """Windows with context on both sides; a position beyond the recording is there with a NaN, values scaled by the window itself."""
    sig = signal(s, d)
    grid = fr.window_grid(sig, length, 24).select(R, "start_idx")
    st = fr.windowed(sig, length, 24).groupBy(R, "start_idx").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    at = grid.join(st, [R, "start_idx"]).select("*", F.explode(F.sequence(F.lit(-pad), F.lit(length + pad - 1))).alias("off")).withColumn("idx", F.col("start_idx") + F.col("off"))
    z = F.when(F.col("x").isNull(), float("nan")).when(F.col("sd") == 0, 0.0).otherwise(r6((F.col("x") - F.col("m")) / F.col("sd")))
    return at.join(sig, [R, "idx"], "left").select(R, "start_idx", "off", z.alias("z"))


query("snippets", f"WITH {SIG}, n AS (SELECT recording_id, count(*) n FROM sig GROUP BY ALL), g AS (SELECT recording_id, unnest(range(0, n - 7, 24)) start_idx FROM n WHERE n >= 8), st AS (SELECT g.recording_id, start_idx, avg(x) m, stddev_pop(x) sd FROM g JOIN sig ON sig.recording_id = g.recording_id AND idx >= start_idx AND idx < start_idx + 8 GROUP BY ALL), o AS (SELECT *, unnest(range(-4, 12)) off FROM st) SELECT o.recording_id, start_idx, off::INTEGER off, CASE WHEN x IS NULL THEN 'nan'::DOUBLE WHEN sd = 0 THEN 0.0 ELSE round((x - m) / sd, 6) + 0.0 END z FROM o LEFT JOIN sig ON sig.recording_id = o.recording_id AND sig.idx = start_idx + off")(snippets)


def plot_limits(s, d, k=3.0):
    """Tukey fences at k, cut to the data; the full range where the quartiles are equal."""
    q = signal(s, d).groupBy(R).agg(F.percentile("x", 0.25).alias("a"), F.percentile("x", 0.75).alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    w = k * (F.col("b") - F.col("a"))
    return q.select(R, r6(F.when(w > 0, F.greatest("lo", F.col("a") - w)).otherwise(F.col("lo"))).alias("low"), r6(F.when(w > 0, F.least("hi", F.col("b") + w)).otherwise(F.col("hi"))).alias("high"))


query("fence_limits", f"WITH {SIG}, q AS (SELECT recording_id, quantile_cont(x, 0.25) a, quantile_cont(x, 0.75) b, min(x) lo, max(x) hi FROM sig GROUP BY ALL) SELECT recording_id, round(CASE WHEN b > a THEN greatest(lo, a - 3 * (b - a)) ELSE lo END, 6) + 0.0 low, round(CASE WHEN b > a THEN least(hi, b + 3 * (b - a)) ELSE hi END, 6) + 0.0 high FROM q")(plot_limits)
query("decibels", f"WITH {SIG}, m AS (SELECT recording_id, max(x) m FROM sig GROUP BY ALL) SELECT recording_id, idx, round(CASE WHEN m <= 0 THEN -60 ELSE 20 * log10(greatest(x, m * 1e-3) / m) END, 6) + 0.0 db FROM sig JOIN m USING (recording_id)")(
    lambda s, d: signal(s, d).join(signal(s, d).groupBy(R).agg(F.max("x").alias("m")), R).select(R, "idx", F.when(F.col("m") <= 0, -60.0).otherwise(r6(20 * F.log10(F.greatest(F.col("x"), F.col("m") * 1e-3) / F.col("m")))).alias("db"))
)

# ---------------------------------------------------------------- span sets compared


def length_of(p):
    return p.groupBy(R).agg(F.sum(F.col("to_idx") - F.col("from_idx")).alias("n"))


def jaccard(s, d):
    """Shared over joint covered positions of annotations and reviewed spans, from three merged lengths."""
    a = notes(s, d).select(R, "start_idx", "end_idx")
    b = first_loaded(read(s, d, "reviewed_spans"), "id", [R, "start_idx", "end_idx"]).select(R, "start_idx", "end_idx")
    la = length_of(sweep.periods(a, [R], "start_idx", "end_idx")).withColumnRenamed("n", "a")
    lb = length_of(sweep.periods(b, [R], "start_idx", "end_idx")).withColumnRenamed("n", "b")
    u = length_of(sweep.periods(a.unionByName(b), [R], "start_idx", "end_idx")).withColumnRenamed("n", "u")
    j = u.join(la, R, "left").join(lb, R, "left").na.fill(0, ["a", "b"])
    return j.select(R, F.round((F.col("a") + F.col("b") - F.col("u")) / F.col("u"), 6).alias("jaccard"))


def _merged(name: str, source: str) -> str:
    return f"{name}_g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r ORDER BY s, e, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM {source}), {name}_i AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY s, e, k ROWS UNBOUNDED PRECEDING) grp FROM {name}_g), {name} AS (SELECT r, sum(e - s) n FROM (SELECT r, min(s) s, max(e) e FROM {name}_i GROUP BY r, grp) GROUP BY r)"


query(
    "coverage_jaccard",
    f"WITH {NOTES}, sa AS (SELECT 'a' || id k, recording_id r, start_idx s, end_idx e FROM notes WHERE end_idx > start_idx AND recording_id IS NOT NULL), sb AS (SELECT 'b' || id k, recording_id r, start_idx s, end_idx e FROM (SELECT * FROM reviewed_spans QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE end_idx > start_idx AND recording_id IS NOT NULL), su AS (SELECT * FROM sa UNION ALL SELECT * FROM sb), "
    f"{_merged('ma', 'sa')}, {_merged('mb', 'sb')}, {_merged('mu', 'su')} SELECT mu.r recording_id, round((coalesce(ma.n, 0) + coalesce(mb.n, 0) - mu.n) / mu.n, 6) jaccard FROM mu LEFT JOIN ma ON ma.r = mu.r LEFT JOIN mb ON mb.r = mu.r",
)(jaccard)


def nearest_review(s, d):
    """Distance from each annotation's start to the nearest reviewed start on its recording; reviewed starts are distinct positions."""
    a = notes(s, d).filter("start_idx is not null and recording_id is not null").select("id", R, F.col("start_idx").alias("p"), F.lit(1).alias("kind"))
    b = reviewed(s, d).select(F.lit(None).cast("long").alias("id"), R, F.col("from_idx").alias("p"), F.lit(0).alias("kind"))
    w = Window.partitionBy(R).orderBy("p", "kind")
    back = F.last(F.when(F.col("kind") == 0, F.col("p")), True).over(w)
    ahead = F.first(F.when(F.col("kind") == 0, F.col("p")), True).over(w.rowsBetween(0, Window.unboundedFollowing))
    j = a.unionByName(b).withColumn("x", back).withColumn("y", ahead).filter("kind = 1")
    return j.select("id", F.least(F.col("p") - F.col("x"), F.col("y") - F.col("p")).alias("distance")).filter("distance is not null")


query("nearest_review", f"WITH {NOTES}, {_REV} SELECT id, min(abs(start_idx - from_idx)) distance FROM notes JOIN per USING (recording_id) WHERE start_idx IS NOT NULL GROUP BY ALL")(nearest_review)
query("odds_ratio", f"WITH {NOTES}, c AS (SELECT tag, count(*) FILTER (verdict = 'interesting') a, count(*) FILTER (verdict != 'interesting') b FROM notes WHERE tag IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(a) OVER () ta, sum(b) OVER () tb FROM c), o AS (SELECT tag, ln((a + 0.5::DOUBLE) * (tb - b + 0.5::DOUBLE) / ((b + 0.5::DOUBLE) * (ta - a + 0.5::DOUBLE))) l, sqrt(1 / (a + 0.5::DOUBLE) + 1 / (b + 0.5::DOUBLE) + 1 / (ta - a + 0.5::DOUBLE) + 1 / (tb - b + 0.5::DOUBLE)) se FROM t) SELECT tag, round(exp(l), 6) odds, round(exp(l - 1.96::DOUBLE * se), 6) low, round(exp(l + 1.96::DOUBLE * se), 6) high FROM o")(lambda s, d: odds(s, d))


def odds(s, d):
    """Odds of an interesting verdict with a tag against without it, half a case added to each cell, and its 95 % interval."""
    c = notes(s, d).filter("tag is not null").groupBy("tag").agg(F.count(F.when(F.col("verdict") == "interesting", 1)).alias("a"), F.count(F.when(F.col("verdict") != "interesting", 1)).alias("b"))
    every = Window.partitionBy(F.lit(1))  # a row per tag of the vocabulary
    t = c.withColumn("ta", F.sum("a").over(every)).withColumn("tb", F.sum("b").over(every))
    cells = [F.col("a") + 0.5, F.col("b") + 0.5, F.col("ta") - F.col("a") + 0.5, F.col("tb") - F.col("b") + 0.5]
    low = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    se = F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    return t.select("tag", F.round(F.exp(low), 6).alias("odds"), F.round(F.exp(low - 1.96 * se), 6).alias("low"), F.round(F.exp(low + 1.96 * se), 6).alias("high"))


query("family_summary", f"WITH {NOTES}, g AS (SELECT tag, recording_id, end_idx - start_idx w, start_idx - lag(start_idx) OVER (PARTITION BY tag, recording_id ORDER BY start_idx, id) gap FROM notes WHERE tag IS NOT NULL AND start_idx IS NOT NULL AND end_idx IS NOT NULL AND recording_id IS NOT NULL) SELECT tag, count(*) n, round(avg(w), 6) + 0.0 mean_width, max(w) max_width, median(gap) median_gap FROM g GROUP BY ALL")(lambda s, d: families(s, d))


def families(s, d):
    w = Window.partitionBy("tag", R).orderBy("start_idx", "id")
    g = notes(s, d).filter("tag is not null and start_idx is not null and end_idx is not null and recording_id is not null").withColumn("gap", F.col("start_idx") - F.lag("start_idx").over(w)).withColumn("w", F.col("end_idx") - F.col("start_idx"))
    return g.groupBy("tag").agg(F.count("*").alias("n"), r6(F.avg("w")).alias("mean_width"), F.max("w").alias("max_width"), F.percentile("gap", 0.5).alias("median_gap"))


@query("recipe_result", _DSAX + " SELECT recording_id, seg, symbol FROM sym")
def recipe_result(s, d):
    """A recipe of two steps over all recordings as one plan."""
    from tidemark.plans import catalogue  # noqa: F401
    from tidemark.plans.recipes import compile_plan, make

    steps = [{"stage": "preprocessing", "algorithm": "detrend", "params": {"window": 20}}, {"stage": "detection", "algorithm": "trend_symbols"}]
    return compile_plan(make(None, steps), signal(s, d)).select(R, "seg", "symbol")
