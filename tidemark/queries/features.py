"""Queries of window measures, symbolic encodings, shape distances and statistics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.operators import measures as me
from tidemark.operators import symbols as sy
from tidemark.queries.base import PTS, SIG, points, r6, signal

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


R = "recording_id"

# ---------------------------------------------------------------- measures of a span
query("linear_residual", f"WITH {SIG} SELECT recording_id, CASE WHEN count(*) < 3 OR stddev_pop(x) = 0 THEN 0.0 ELSE round(sqrt(greatest(0, 1 - corr(x, idx) ** 2)), 6) END residual FROM sig GROUP BY ALL")(
    lambda s, d: signal(s, d).groupBy(R).agg(F.when((F.count("*") < 3) | (F.stddev_pop("x") == 0), 0.0).otherwise(r6(F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(F.corr("x", "idx"), 2))))).alias("residual"))
)


def roughness(s, d):
    """Root mean square of the first difference over the population deviation."""
    w = Window.partitionBy(R).orderBy("idx")
    return signal(s, d).withColumn("dx", F.col("x") - F.lag("x").over(w)).groupBy(R).agg(r6(F.sqrt(F.avg(F.col("dx") * F.col("dx"))) / F.stddev_pop("x")).alias("roughness"))


query("roughness", f"WITH {SIG}, g AS (SELECT *, x - lag(x) OVER (PARTITION BY recording_id ORDER BY idx) dx FROM sig) SELECT recording_id, round(sqrt(avg(dx * dx)) / stddev_pop(x), 6) + 0.0 roughness FROM g GROUP BY ALL")(roughness)
query("moments", f"WITH {SIG}, m AS (SELECT recording_id, avg(x) m, stddev_pop(x) sd FROM sig GROUP BY ALL) SELECT recording_id, CASE WHEN any_value(sd) = 0 THEN 0.0 ELSE round(avg(((x - m) / sd) ** 3), 6) + 0.0 END skewness, CASE WHEN any_value(sd) = 0 THEN 0.0 ELSE round(avg(((x - m) / sd) ** 4) - 3, 6) + 0.0 END kurtosis FROM sig JOIN m USING (recording_id) GROUP BY recording_id")(
    lambda s, d: signal(s, d).groupBy(R).agg(*[F.when(F.stddev_pop("x") == 0, 0.0).otherwise(r6(f("x"))).alias(n) for n, f in (("skewness", F.skewness), ("kurtosis", F.kurtosis))])
)


def histogram_entropy(s, d, bins=50):
    """Bits over a histogram whose last bin is closed."""
    sig = signal(s, d)
    m = sig.groupBy(R).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = sig.join(m, R).withColumn("b", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))).groupBy(R, "b").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(R))
    return b.withColumn("p", p).groupBy(R).agg(r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


query("histogram_entropy", f"WITH {SIG}, m AS (SELECT recording_id, min(x) lo, max(x) hi FROM sig GROUP BY ALL), b AS (SELECT recording_id, least(49, floor((x - lo) / ((hi - lo) / 50))) b, count(*) c FROM sig JOIN m USING (recording_id) GROUP BY ALL), p AS (SELECT recording_id, c / sum(c) OVER (PARTITION BY recording_id) p FROM b) SELECT recording_id, round(-sum(p * log2(p)), 6) + 0.0 entropy FROM p GROUP BY ALL")(histogram_entropy)


def permutation_entropy(s, d):
    """Bits over the order patterns of three successive samples."""
    w = Window.partitionBy(R).orderBy("idx")
    t = signal(s, d).select(R, F.col("x").alias("a"), F.lead("x", 1).over(w).alias("b"), F.lead("x", 2).over(w).alias("c")).filter("c is not null")
    code = (F.col("a") <= F.col("b")).cast("int") * 4 + (F.col("b") <= F.col("c")).cast("int") * 2 + (F.col("a") <= F.col("c")).cast("int")
    k = t.groupBy(R, code.alias("k")).agg(F.count("*").alias("n"))
    return k.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(R))).groupBy(R).agg(r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


query("permutation_entropy", f"WITH {SIG}, t AS (SELECT recording_id, x a, lead(x, 1) OVER w b, lead(x, 2) OVER w c FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), k AS (SELECT recording_id, (a <= b)::INT * 4 + (b <= c)::INT * 2 + (a <= c)::INT k, count(*) n FROM t WHERE c IS NOT NULL GROUP BY ALL), p AS (SELECT recording_id, n / sum(n) OVER (PARTITION BY recording_id) p FROM k) SELECT recording_id, round(-sum(p * log2(p)), 6) + 0.0 entropy FROM p GROUP BY ALL")(permutation_entropy)


def slow_entropies(s, d):
    out = me.per_window(signal(s, d), [R], me.SLOW)
    return out.select(R, r6("approximate_entropy").alias("approximate_entropy"), r6("sample_entropy").alias("sample_entropy"))


def _templates(m: int, count: str) -> str:
    close = " AND ".join(f"abs(a.x{k} - b.x{k}) <= tol" for k in range(m))
    return f"SELECT recording_id, count(*) c, any_value(n) n FROM t a JOIN t b USING (recording_id) JOIN lim USING (recording_id) WHERE a.idx < {count} AND b.idx < {count} AND {close} GROUP BY ALL"


query(
    "slow_entropies",
    f"WITH {SIG}, lim AS (SELECT recording_id, count(*) n, 0.2 * stddev_pop(x) tol FROM sig GROUP BY ALL), t AS (SELECT recording_id, idx, x x0, lead(x, 1) OVER w x1, lead(x, 2) OVER w x2 FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), "
    f"a2 AS ({_templates(2, '(n - 1)')}), a3 AS ({_templates(3, '(n - 2)')}), b2 AS ({_templates(2, '(n - 2)')}), b3 AS ({_templates(3, '(n - 3)')}) "
    "SELECT recording_id, round(ln(a2.c / (a2.n - 1)) - ln(a3.c / (a2.n - 2)), 6) + 0.0 approximate_entropy, CASE WHEN b3.c - (b2.n - 3) > 0 AND b2.c - (b2.n - 2) > 0 THEN round(-ln((b3.c - (b2.n - 3)) / (b2.c - (b2.n - 2))), 6) + 0.0 ELSE 'nan'::DOUBLE END sample_entropy FROM a2 JOIN a3 USING (recording_id) JOIN b2 USING (recording_id) JOIN b3 USING (recording_id)",
)(slow_entropies)
query("fast_measures")(lambda s, d: me.per_window(fr.windowed(signal(s, d), 32, 16), [R, "start_idx"], me.FAST))

# ---------------------------------------------------------------- directions
PER = 6


def slopes(s, d):
    return sy.trends(signal(s, d), PER).select(R, "seg", F.col("delta").alias("slope"))


_SLOPE = f"WITH {SIG}, sl AS (SELECT recording_id, idx // {PER} seg, regr_slope(x, idx) * {PER - 1} slope FROM sig GROUP BY ALL HAVING count(*) = {PER}), ref AS (SELECT recording_id, median(abs(slope)) ref FROM sl WHERE slope != 0 GROUP BY ALL), ang AS (SELECT recording_id, seg, atan(slope / ref) a FROM sl JOIN ref USING (recording_id))"


def angles(s, d):
    """Slope angles against the recording's median slope."""
    sl = slopes(s, d)
    ref = sl.filter("slope != 0").groupBy(R).agg(F.percentile(F.abs("slope"), 0.5).alias("ref"))
    return sl.join(ref, R).select(R, "seg", F.atan(F.col("slope") / F.col("ref")).alias("a"))


query("slope_angles", _SLOPE + " SELECT recording_id, seg, round(a, 6) + 0.0 a FROM ang")(lambda s, d: angles(s, d).withColumn("a", r6("a")))
query("circular_stats", _SLOPE + ", c AS (SELECT recording_id, avg(sin(a)) s, avg(cos(a)) c FROM ang GROUP BY ALL) SELECT recording_id, round(atan2(s, c), 6) + 0.0 mean, round(sqrt(s * s + c * c), 6) r, round(degrees(sqrt(-2 * ln(sqrt(s * s + c * c)))), 6) sd_deg FROM c WHERE sqrt(s * s + c * c) < 0.999999")(
    lambda s, d: angles(s, d).groupBy(R).agg(F.avg(F.sin("a")).alias("s"), F.avg(F.cos("a")).alias("c")).withColumn("q", F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))).filter("q < 0.999999")
    .select(R, r6(F.atan2("s", "c")).alias("mean"), F.round("q", 6).alias("r"), F.round(F.degrees(F.sqrt(-2 * F.log("q"))), 6).alias("sd_deg"))
)
_ROSE = "least(17, greatest(0, floor((a + pi() / 2) / (pi() / 18))))"
query("rose_histogram", _SLOPE + f" SELECT {_ROSE}::INTEGER bin, count(*) n FROM ang GROUP BY ALL")(lambda s, d: angles(s, d).groupBy(F.expr(_ROSE).cast("int").alias("bin")).agg(F.count("*").alias("n")))


def ks_uniform(s, d):
    """Largest distance of the empirical distribution of the angles from the uniform one on [-pi/2, pi/2]."""
    w = Window.partitionBy(R).orderBy("a", "seg")
    n = F.count("*").over(Window.partitionBy(R))
    u = (F.col("a") + math.pi / 2) / math.pi
    k = angles(s, d).withColumn("i", F.row_number().over(w)).withColumn("n", n)
    gap = F.greatest(F.col("i") / F.col("n") - u, u - (F.col("i") - 1) / F.col("n"))
    return k.withColumn("g", gap).groupBy(R).agg(r6(F.max("g")).alias("ks"), F.max("n").alias("n")).filter("n >= 3")


query("ks_uniform", _SLOPE + ", k AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY a, seg) i, count(*) OVER (PARTITION BY recording_id) n, (a + pi() / 2) / pi() u FROM ang) SELECT recording_id, round(max(greatest(i / n - u, u - (i - 1) / n)), 6) ks, max(n) n FROM k GROUP BY ALL HAVING max(n) >= 3")(ks_uniform)

# ---------------------------------------------------------------- symbols
query("paa", f"WITH {SIG} SELECT recording_id, idx // 4 seg, round(avg(x), 6) + 0.0 mean FROM sig GROUP BY ALL HAVING count(*) = 4")(lambda s, d: sy.paa(signal(s, d), 4).select(R, "seg", r6("mean").alias("mean")))
query("fractional_paa", f"WITH {SIG}, l AS (SELECT recording_id, count(*) n FROM sig GROUP BY ALL), p AS (SELECT recording_id, x, idx * 10 / n lo, (idx + 1) * 10 / n hi, unnest(range(0, 10)) seg FROM sig JOIN l USING (recording_id)), w AS (SELECT *, greatest(0, least(hi, seg + 1) - greatest(lo, seg)) w FROM p) SELECT recording_id, seg, round(sum(x * w) / sum(w), 6) + 0.0 mean FROM w WHERE w > 1e-9 GROUP BY ALL")(
    lambda s, d: sy.fractional_paa(signal(s, d), 10).select(R, "seg", r6("mean").alias("mean"))
)


def dsax(s, d, flat=None):
    z = fr.z_normalise(flat if flat is not None else fr.detrend(signal(s, d), window=20))
    return sy.trend_symbols(sy.trends(z, PER))


_DSAX = (
    f"WITH {SIG}, fl AS (SELECT recording_id, idx, x - avg(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) x FROM sig), zs AS (SELECT recording_id, avg(x) m, stddev_pop(x) sd FROM fl GROUP BY ALL), "
    f"z AS (SELECT recording_id, idx, CASE WHEN sd = 0 THEN 0 ELSE (x - m) / sd END x FROM fl JOIN zs USING (recording_id)), dl AS (SELECT recording_id, idx // {PER} seg, regr_slope(x, idx) * {PER - 1} delta FROM z GROUP BY ALL HAVING count(*) = {PER}), "
    "h AS (SELECT recording_id, (quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25)) / 2 h FROM dl GROUP BY ALL), sym AS (SELECT recording_id, seg, (CASE WHEN h > 0 THEN (delta >= -h)::INT + (delta >= h)::INT WHEN delta > 0 THEN 2 WHEN delta < 0 THEN 0 ELSE 1 END)::INTEGER symbol FROM dl JOIN h USING (recording_id))"
)
query("dsax", _DSAX + " SELECT recording_id, seg, symbol FROM sym")(lambda s, d: dsax(s, d).drop("delta"))
_WORD = _DSAX + ", word AS (SELECT recording_id, string_agg(substr('DSU', symbol + 1, 1), '' ORDER BY seg) word FROM sym GROUP BY ALL)"
query("dsax_words", _WORD + " SELECT * FROM word")(lambda s, d: sy.letters(dsax(s, d)))
query("shape_search", _WORD.replace("WITH sig", "WITH RECURSIVE sig") + ", f AS (SELECT recording_id, word, 0 done, NULL::BIGINT a, NULL::BIGINT z FROM word UNION ALL SELECT recording_id, word, done + a0 + len(h), done + a0, done + a0 + len(h) - 1 FROM (SELECT recording_id, word, done, h, strpos(substr(word, (done + 1)::BIGINT), h) - 1 a0 FROM (SELECT *, regexp_extract(substr(word, (done + 1)::BIGINT), 'U+S?D+') h FROM f) WHERE h != '')) SELECT recording_id, a::INTEGER first_seg, z::INTEGER last_seg FROM f WHERE a IS NOT NULL")(
    lambda s, d: sy.find_shapes(sy.letters(dsax(s, d)), "U+S?D+")
)
query("symbol_diagnostics", _DSAX + f", c AS (SELECT recording_id, symbol, count(*) c FROM sym GROUP BY ALL), p AS (SELECT recording_id, c, c / sum(c) OVER (PARTITION BY recording_id) p FROM c), e AS (SELECT recording_id, sum(c)::BIGINT n, -sum(p * log2(p)) entropy FROM p GROUP BY ALL), t AS (SELECT recording_id, coalesce(avg(same), 0) st FROM (SELECT recording_id, (symbol = lag(symbol) OVER (PARTITION BY recording_id ORDER BY seg))::INT same FROM sym) GROUP BY ALL) SELECT recording_id, n, round(entropy, 6) + 0.0 entropy, round(entropy / {math.log2(3)!r}, 6) + 0.0 ratio, round(st, 6) self_transitions FROM e JOIN t USING (recording_id)")(
    lambda s, d: sy.diagnostics(dsax(s, d), 3).select(R, "n", r6("entropy").alias("entropy"), r6("ratio").alias("ratio"), F.round("self_transitions", 6).alias("self_transitions"))
)
query("symbol_counts", _DSAX + " SELECT recording_id, symbol, count(*) n FROM sym GROUP BY ALL")(lambda s, d: dsax(s, d).groupBy(R, "symbol").agg(F.count("*").alias("n")))


def flagship(spark, d):
    """Signal, rolling detrend, trend symbols, letters: one plan from scan to word."""
    return QUERIES["dsax_words"](spark, d)


CUTS = sy.cutlines(5)


def sax_symbols(s, d):
    """Level symbols 1 .. 5 of each ready-made window's eight segments; windows hardly varying (below 0.001) are not scaled."""
    z = points(s, d)
    st = z.groupBy(R).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = z.join(st, R).withColumn("x", F.when(F.col("sd") < 0.001, F.col("x") - F.col("m")).otherwise((F.col("x") - F.col("m")) / F.col("sd")))
    return sy.paa(z, 8).select(R, "seg", (sy.quantise(F.round("mean", 9), CUTS) + 1).alias("symbol"))


_Q = " + ".join(f"(round(avg(x), 9) >= {c!r})::INT" for c in CUTS)
_SAX = f"WITH {PTS}, st AS (SELECT recording_id, avg(x) m, stddev_pop(x) sd FROM pts GROUP BY ALL), z AS (SELECT recording_id, idx, CASE WHEN sd < 0.001 THEN x - m ELSE (x - m) / sd END x FROM pts JOIN st USING (recording_id)), sax AS (SELECT recording_id, idx // 8 seg, ({_Q} + 1)::INTEGER symbol FROM z GROUP BY ALL)"
query("sax_words", _SAX + " SELECT recording_id, seg, symbol FROM sax")(sax_symbols)


def reduced(s, d):
    """Numerosity reduction: a symbol equal to the one before it goes."""
    w = Window.partitionBy(R).orderBy("seg")
    return sax_symbols(s, d).withColumn("p", F.lag("symbol").over(w)).filter("p is null or p != symbol").drop("p")


query("sax_reduced", _SAX + " SELECT recording_id, seg, symbol FROM sax QUALIFY lag(symbol) OVER (PARTITION BY recording_id ORDER BY seg) IS DISTINCT FROM symbol")(reduced)


def mindist_to_queries(s, d):
    """Word distance (without the length factor) of every window to each query window, its nearest five kept."""
    words = sax_symbols(s, d)
    from tidemark.operators.search import nearest

    lists = words.groupBy(R).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", "symbol"))), lambda v: v["symbol"].cast("double")).alias("v"))
    return nearest(lists.select(F.col(R).alias("id"), "v"), 20, 5, "mindist", cuts=CUTS).select("query_id", "id", r6("distance").alias("distance"), "rank")


_CELL = "CASE WHEN abs(a.symbol - b.symbol) <= 1 THEN 0 ELSE list_extract([" + ", ".join(repr(c) for c in CUTS) + "], greatest(a.symbol, b.symbol) - 1) - list_extract([" + ", ".join(repr(c) for c in CUTS) + "], least(a.symbol, b.symbol)) END"
_TOP = " SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER rank FROM dd) WHERE rank <= 5"
query("mindist_search", _SAX + f", dd AS (SELECT a.recording_id query_id, b.recording_id id, round(sqrt(sum(({_CELL}) ** 2)), 6) + 0.0 distance FROM sax a JOIN sax b USING (seg) WHERE a.recording_id % 20 = 0 AND a.recording_id != b.recording_id GROUP BY ALL)" + _TOP)(mindist_to_queries)


def shape_search(s, d, metric="scaled"):
    from tidemark.operators.search import nearest
    from tidemark.queries.base import vectors

    return nearest(vectors(s, d).select(F.col("vec_id").alias("id"), "v"), 20, 5, metric).select("query_id", "id", r6("distance").alias("distance"), "rank")


_ZV = f"WITH {PTS}, st AS (SELECT recording_id, avg(x) m, stddev_pop(x) sd FROM pts GROUP BY ALL), z AS (SELECT recording_id, idx, CASE WHEN sd = 0 THEN 0 ELSE (x - m) / sd END x FROM pts JOIN st USING (recording_id)), dd AS (SELECT a.recording_id query_id, b.recording_id id, round(sqrt(sum((a.x - b.x) ** 2)), 6) + 0.0 distance FROM z a JOIN z b USING (idx) WHERE a.recording_id % 20 = 0 AND a.recording_id != b.recording_id GROUP BY ALL)"
query("shape_distance", _ZV + _TOP)(shape_search)
query("euclidean_distance", f"WITH {PTS}, dd AS (SELECT a.recording_id query_id, b.recording_id id, round(sqrt(sum((a.x - b.x) ** 2)), 6) + 0.0 distance FROM pts a JOIN pts b USING (idx) WHERE a.recording_id % 20 = 0 AND a.recording_id != b.recording_id GROUP BY ALL)" + _TOP)(lambda s, d: shape_search(s, d, "plain"))


def resampled(s, d, n=25):
    """Each window by linear interpolation at n even places."""
    p = points(s, d)
    size = p.groupBy(R).agg(F.count("*").alias("n"))
    pos = F.col("j") * (F.col("n") - 1) / (n - 1)
    at = size.select(R, "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).withColumn("p", pos).withColumn("lo", F.least(F.floor("p"), F.col("n") - 2).cast("long"))
    a = p.select(R, F.col("idx").alias("lo"), F.col("x").alias("xa"))
    b = p.select(R, (F.col("idx") - 1).alias("lo"), F.col("x").alias("xb"))
    return at.join(a, [R, "lo"]).join(b, [R, "lo"]).select(R, "j", r6(F.col("xa") + (F.col("p") - F.col("lo")) * (F.col("xb") - F.col("xa"))).alias("x"))


query("resample", f"WITH {PTS}, n AS (SELECT recording_id, count(*) n FROM pts GROUP BY ALL), g AS (SELECT recording_id, n, unnest(range(0, 25)) j FROM n), k AS (SELECT *, j * (n - 1) / 24 p, least(floor(j * (n - 1) / 24), n - 2)::BIGINT lo FROM g) SELECT k.recording_id, j::INTEGER j, round(a.x + (p - lo) * (b.x - a.x), 6) + 0.0 x FROM k JOIN pts a ON a.recording_id = k.recording_id AND a.idx = lo JOIN pts b ON b.recording_id = k.recording_id AND b.idx = lo + 1")(resampled)

# ---------------------------------------------------------------- significance


def hits(s, d):
    """Each segment's trend as a hit, with its recording's other trends as the null."""
    return slopes(s, d).select(R, "seg", F.abs("slope").alias("dist"))


_HIT = f"WITH {SIG}, hit AS (SELECT recording_id, idx // {PER} seg, abs(regr_slope(x, idx) * {PER - 1}) dist FROM sig GROUP BY ALL HAVING count(*) = {PER})"


def empirical_p(s, d):
    """(1 + nulls at most d) / (1 + nulls); the nulls are the recording's other values, an adjusted q over all of a recording."""
    w = Window.partitionBy(R).orderBy(F.round("dist", 9)).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy(R))
    p = hits(s, d).withColumn("n", n).withColumn("p", F.count("*").over(w) / F.col("n"))
    order = Window.partitionBy(R).orderBy("p", "seg")
    back = Window.partitionBy(R).orderBy(F.desc("p"), F.desc("seg")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = p.withColumn("i", F.row_number().over(order))
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col("p") * F.col("n") / F.col("i")).over(back))).select(R, "seg", r6("p").alias("p"), r6("q").alias("q"))


query("empirical_p", _HIT + ", p AS (SELECT recording_id, seg, count(*) OVER (PARTITION BY recording_id) n, count(*) OVER (PARTITION BY recording_id ORDER BY round(dist, 9) RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY recording_id) p FROM hit), i AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY p, seg) i FROM p) SELECT recording_id, seg, round(p, 6) p, round(least(1, min(p * n / i) OVER (PARTITION BY recording_id ORDER BY p DESC, seg DESC ROWS UNBOUNDED PRECEDING)), 6) q FROM i")(empirical_p)
query("null_z", _HIT + ", m AS (SELECT recording_id, count(*) n, avg(dist) m, stddev_pop(dist) sd FROM hit GROUP BY ALL) SELECT recording_id, seg, CASE WHEN n < 2 OR sd <= 0 THEN 'nan'::DOUBLE ELSE round((dist - m) / sd, 6) + 0.0 END z FROM hit JOIN m USING (recording_id)")(
    lambda s, d: hits(s, d).join(hits(s, d).groupBy(R).agg(F.count("*").alias("n"), F.avg("dist").alias("m"), F.stddev_pop("dist").alias("sd")), R).select(R, "seg", F.when((F.col("n") < 2) | (F.col("sd") <= 0), float("nan")).otherwise(r6((F.col("dist") - F.col("m")) / F.col("sd"))).alias("z"))
)
