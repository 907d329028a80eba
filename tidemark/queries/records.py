"""Queries of the relational store, interval joins, feature tables, evaluation, images and matrix profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import islands as isl
from tidemark.operators import overlap, prepare, sweep
from tidemark.queries.base import NOTES, PTS, RECS, SIG, VEC, notes, points, r6, recs, signal, vectors
from tidemark.session import cut_lineage
from tidemark.tables import first_loaded, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# The verdicts an annotation may have.
VERDICTS = ["seed", "interesting", "not_interesting", "artifact", "unsure"]
# Upper bounds (inclusive) of the bands, of events and of seconds, the last without one.
TRAIN_BANDS = [(4, "short"), (9, "medium"), (None, "long")]
DURATION_BANDS = [(60, "short"), (900, "medium"), (3600, "long"), (21600, "very_long"), (None, "extreme")]


def band(value, bands):
    """The first band whose upper bound is not below the value; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for top, name in bands:
        out = out.when(value <= top, name) if top is not None else out.otherwise(F.lit(name))
    return out


@query("recording_summary", f"WITH {NOTES} SELECT recording_id, " + ", ".join(f"count(*) FILTER (verdict = '{v}') {v}" for v in VERDICTS) + ", count(*) total FROM notes WHERE recording_id IS NOT NULL GROUP BY ALL")
def recording_summary(s, d):
    g = notes(s, d).filter("recording_id is not null").groupBy("recording_id")
    return g.agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in VERDICTS], F.count("*").alias("total"))


_REV = "rv AS (SELECT id, recording_id r, start_idx s, end_idx e FROM (SELECT * FROM reviewed_spans QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE end_idx > start_idx AND recording_id IS NOT NULL), g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM rv), i AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) k FROM g), per AS (SELECT r recording_id, min(s) from_idx, max(e) to_idx FROM i GROUP BY r, k)"


def reviewed(s, d):
    return sweep.periods(first_loaded(read(s, d, "reviewed_spans"), "id", ["recording_id", "start_idx", "end_idx"]), ["recording_id"], "start_idx", "end_idx")


query("reviewed_fraction", f"WITH {RECS}, {_REV}, c AS (SELECT recording_id, sum(to_idx - from_idx) c FROM per GROUP BY ALL) SELECT recs.id, round(coalesce(c, 0) / n_samples, 6) fraction FROM recs LEFT JOIN c ON c.recording_id = recs.id WHERE n_samples > 0")(
    lambda s, d: recs(s, d).filter("n_samples > 0").join(reviewed(s, d).groupBy(F.col("recording_id").alias("id")).agg(F.sum(F.col("to_idx") - F.col("from_idx")).alias("c")), "id", "left").select("id", F.round(F.coalesce("c", F.lit(0)) / F.col("n_samples"), 6).alias("fraction"))
)
query("bucket_coverage", f"WITH {_REV}, b AS (SELECT recording_id, greatest(from_idx, 0) from_idx, to_idx, unnest(range(greatest(from_idx, 0) // 5000, (to_idx - 1) // 5000 + 1)) bucket FROM per WHERE to_idx > 0), f AS (SELECT recording_id, bucket, least(1.0, sum(least(to_idx, (bucket + 1) * 5000) - greatest(from_idx, bucket * 5000)) / 5000) fraction FROM b GROUP BY ALL) SELECT recording_id, bucket, round(fraction, 6) fraction, CASE WHEN fraction >= 0.95 THEN 'full' ELSE 'partial' END state FROM f")(
    lambda s, d: overlap.bucket_cover(overlap.clipped(reviewed(s, d)), "recording_id", 5000).select("recording_id", "bucket", F.round("fraction", 6).alias("fraction"), F.when(F.col("fraction") >= 0.95, "full").otherwise("partial").alias("state"))
)
query("annotation_density", f"WITH {NOTES}, {RECS} SELECT recording_id, CASE WHEN n_samples > 0 THEN least(99, greatest(0, floor((start_idx + end_idx) / 2 * 100 / n_samples)))::BIGINT END bucket, verdict, count(*) n FROM notes LEFT JOIN recs ON recs.id = notes.recording_id WHERE end_idx > start_idx GROUP BY ALL")(lambda s, d: density(notes(s, d), recs(s, d)))


def density(spans, recordings):
    """Midpoints per hundredth of their recording; those outside it in its first or last, the bucket null where its length is unknown."""
    at = F.floor((F.col("start_idx") + F.col("end_idx")) / 2 * 100 / F.col("n_samples"))
    rows = spans.filter("end_idx > start_idx").join(recordings.select(F.col("id").alias("recording_id"), "n_samples"), "recording_id", "left")
    return rows.groupBy("recording_id", F.when(F.col("n_samples") > 0, F.least(F.lit(99), F.greatest(F.lit(0), at))).cast("long").alias("bucket"), "verdict").agg(F.count("*").alias("n"))


query(
    "bands",
    f"WITH {NOTES}, {RECS}, w AS (SELECT notes.id, event_count e, (end_idx - start_idx) / fs sec FROM notes JOIN recs ON notes.recording_id = recs.id WHERE fs > 0 AND NOT isnan(fs)) SELECT id, CASE WHEN e IS NULL THEN NULL WHEN e < 5 THEN 'short' WHEN e < 10 THEN 'medium' ELSE 'long' END train_band, CASE WHEN sec IS NULL THEN NULL WHEN sec > 6 * 3600 THEN 'extreme' WHEN sec > 3600 THEN 'very_long' WHEN sec > 15 * 60 THEN 'long' WHEN sec > 60 THEN 'medium' ELSE 'short' END duration_band FROM w",
)(
    lambda s, d: notes(s, d).join(recs(s, d).select(F.col("id").alias("recording_id"), "fs"), "recording_id").filter("fs > 0 and not isnan(fs)").select("id", band(F.col("event_count"), TRAIN_BANDS).alias("train_band"), band((F.col("end_idx") - F.col("start_idx")) / F.col("fs"), DURATION_BANDS).alias("duration_band"))
)
query("tags_of_recording", f"WITH {NOTES} SELECT recording_id, tag, count(*) n FROM notes WHERE tag IS NOT NULL AND recording_id IS NOT NULL GROUP BY ALL")(lambda s, d: notes(s, d).filter("tag is not null and recording_id is not null").groupBy("recording_id", "tag").agg(F.count("*").alias("n")))


@query("matching_tags", f"WITH {NOTES}, k AS (SELECT DISTINCT recording_id r, tag t FROM notes WHERE tag IS NOT NULL) SELECT DISTINCT a.r recording_id FROM k a JOIN k b USING (r) WHERE a.t IN ('dip', 'fin') AND b.t IN ('drift', 'rolling')")
def matching_tags(s, d):
    """Recordings with a tag of each of two categories."""
    k = notes(s, d).filter("tag is not null and recording_id is not null")
    c = F.when(F.col("tag").isin("dip", "fin"), 1).when(F.col("tag").isin("drift", "rolling"), 2)
    return k.withColumn("c", c).groupBy("recording_id").agg(F.count_distinct("c").alias("k")).filter("k = 2").select("recording_id")


query("annotation_provenance", f"WITH {NOTES}, {RECS} SELECT n.id, r.npy_path, p.verdict parent_verdict FROM notes n JOIN recs r ON r.id = n.recording_id LEFT JOIN notes p ON p.id = n.parent_annotation_id AND p.id != n.id WHERE n.parent_annotation_id IS NOT NULL")(
    lambda s, d: notes(s, d).filter("parent_annotation_id is not null").select("id", "recording_id", "parent_annotation_id").join(recs(s, d).select(F.col("id").alias("recording_id"), "npy_path"), "recording_id")
    .join(notes(s, d).select(F.col("id").alias("parent_annotation_id"), F.col("verdict").alias("parent_verdict")), "parent_annotation_id", "left").select("id", "npy_path", F.when(F.col("parent_annotation_id") != F.col("id"), F.col("parent_verdict")).alias("parent_verdict"))
)
query("latest_run", "SELECT o_custkey config_id, max(o_orderkey) run_id, max_by(o_orderstatus, o_orderkey) status FROM orders WHERE o_orderstatus != 'P' GROUP BY ALL")(
    lambda s, d: read(s, d, "orders").filter("o_orderstatus != 'P'").groupBy(F.col("o_custkey").alias("config_id")).agg(F.max("o_orderkey").alias("run_id"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
)


@query("preferred_artifact", "SELECT o_custkey config_id, o_orderkey run_id, pref FROM (SELECT *, CASE WHEN o_orderstatus = 'F' AND o_orderpriority LIKE '1%' THEN 0 WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END::INTEGER pref FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY pref, o_orderkey DESC) = 1")
def preferred_artifact(s, d):
    """Fresh and complete before fresh before stale; the newest of a kind."""
    pref = F.when((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    best = F.min(F.struct(pref.alias("pref"), (-F.col("o_orderkey")).alias("k")))
    return read(s, d, "orders").groupBy(F.col("o_custkey").alias("config_id")).agg(best.alias("b")).select("config_id", (-F.col("b.k")).alias("run_id"), "b.pref")


@query("ladder_status", f"WITH {NOTES}, l AS (SELECT unnest(['1min', '10min', '1h', '6h', 'whole']) scale), r AS (SELECT DISTINCT recording_id FROM notes WHERE recording_id IS NOT NULL), c AS (SELECT recording_id, scale_viewed scale, count(*) n, count(*) FILTER (status = 'examined') ok FROM notes GROUP BY ALL) SELECT r.recording_id, l.scale, CASE WHEN n IS NULL THEN 'missing' WHEN ok = n THEN 'available' WHEN ok > 0 THEN 'partial' ELSE 'stale' END status FROM r, l LEFT JOIN c ON c.recording_id = r.recording_id AND c.scale = l.scale")
def ladder_status(s, d):
    """The state of each of five scales of every recording; the ladder is a fixed list, exploded per recording."""
    n = first_loaded(read(s, d, "annotations"), "id", ["recording_id", "scale_viewed", "status", "deleted_at"]).filter("deleted_at is null and recording_id is not null")
    ladder = n.select("recording_id").distinct().withColumn("scale", F.explode(F.array(*[F.lit(x) for x in ("1min", "10min", "1h", "6h", "whole")])))
    c = n.groupBy("recording_id", F.col("scale_viewed").alias("scale")).agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "examined", 1)).alias("ok"))
    st = F.when(F.col("n").isNull(), "missing").when(F.col("ok") == F.col("n"), "available").when(F.col("ok") > 0, "partial").otherwise("stale")
    return ladder.join(c, ["recording_id", "scale"], "left").select("recording_id", "scale", st.alias("status"))


query("near_duplicate_spans", f"WITH {NOTES}, n AS (SELECT id, recording_id r, start_idx s, end_idx e FROM notes WHERE end_idx > start_idx), p AS (SELECT a.r recording_id, a.id a_id, b.id b_id, (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) iou, greatest(a.e - a.s, b.e - b.s) / least(a.e - a.s, b.e - b.s) ratio FROM n a JOIN n b ON a.r = b.r AND a.id < b.id AND a.s < b.e AND b.s < a.e) SELECT recording_id, a_id, b_id, round(iou, 6) iou FROM p WHERE iou >= 0.8 AND ratio <= 1.5")(
    lambda s, d: overlap.near_duplicates(notes(s, d)).withColumn("iou", F.round("iou", 6))
)
query("span_durations", f"WITH {NOTES}, c AS (SELECT recording_id, end_idx - start_idx w, count(*) c FROM notes WHERE end_idx > start_idx AND recording_id IS NOT NULL GROUP BY ALL), p AS (SELECT recording_id, c / sum(c) OVER (PARTITION BY recording_id) p FROM c) SELECT recording_id, round(-sum(p * ln(p)), 6) + 0.0 shannon, round(sum(p * p), 6) simpson FROM p GROUP BY ALL")(
    lambda s, d: _diversity(notes(s, d).filter("end_idx > start_idx and recording_id is not null").groupBy("recording_id", (F.col("end_idx") - F.col("start_idx")).alias("w")).agg(F.count("*").alias("c")))
)


def _diversity(c):
    p = F.col("c") / F.sum("c").over(Window.partitionBy("recording_id"))
    return c.withColumn("p", p).groupBy("recording_id").agg(r6(-F.sum(F.col("p") * F.log("p"))).alias("shannon"), F.round(F.sum(F.col("p") * F.col("p")), 6).alias("simpson"))


query("merged_half_overlaps")(lambda s, d: isl.merge_half_overlaps(notes(s, d).filter("end_idx > start_idx and recording_id is not null"), ["recording_id"]))
query("summary_json", f"WITH {NOTES} SELECT verdict, count(*) n, min(end_idx - start_idx) shortest, max(end_idx - start_idx) longest, quantile_cont(end_idx - start_idx, 0.5) mid FROM notes WHERE end_idx > start_idx GROUP BY ALL")(
    lambda s, d: notes(s, d).filter("end_idx > start_idx").withColumn("w", F.col("end_idx") - F.col("start_idx")).groupBy("verdict").agg(F.count("*").alias("n"), F.min("w").alias("shortest"), F.max("w").alias("longest"), F.percentile("w", 0.5).alias("mid"))
)
query("separated_marks")(lambda s, d: isl.separated(notes(s, d).filter("recording_id is not null and start_idx is not null and end_idx is not null").withColumn("score", F.col("start_idx") - F.col("end_idx")), ["recording_id"], "score", "start_idx", 600))
query("union_spans", f"WITH {NOTES} SELECT 'annotation' kind, recording_id, start_idx, end_idx, verdict AS lab FROM notes UNION ALL SELECT 'reviewed', recording_id, start_idx, end_idx, source FROM (SELECT * FROM reviewed_spans QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)")(
    lambda s, d: notes(s, d).select(F.lit("annotation").alias("kind"), "recording_id", "start_idx", "end_idx", F.col("verdict").alias("lab")).unionByName(first_loaded(read(s, d, "reviewed_spans"), "id", ["recording_id", "start_idx", "end_idx", "source"]).select(F.lit("reviewed").alias("kind"), "recording_id", "start_idx", "end_idx", F.col("source").alias("lab")))
)
query("duplicate_keys", "SELECT npy_path, count(DISTINCT id) n FROM recordings WHERE npy_path IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) > 1")(lambda s, d: read(s, d, "recordings").filter("npy_path is not null").groupBy("npy_path").agg(F.count_distinct("id").alias("n")).filter("n > 1"))
query("latest_file_rows", "SELECT npy_path, max(written_at) written_at, max_by(n_samples, written_at) n_samples, max_by(data_sha1, written_at) data_sha1, count(*) > 1 rewritten FROM channel_files GROUP BY ALL")(
    lambda s, d: read(s, d, "channel_files").groupBy("npy_path").agg(F.max("written_at").alias("written_at"), F.max_by("n_samples", "written_at").alias("n_samples"), F.max_by("data_sha1", "written_at").alias("data_sha1"), (F.count("*") > 1).alias("rewritten"))
)

# ---------------------------------------------------------------- feature tables
query("column_stats", f"WITH {VEC}, e AS (SELECT unnest(range(len(v))) col, unnest(v) x FROM vec) SELECT col::INTEGER col, count(*) n, sum(isnan(x)::INT)::BIGINT n_nan, round(avg(x), 6) + 0.0 mean, round(stddev_pop(x), 6) sd, round(median(x), 6) + 0.0 mid FROM e GROUP BY ALL")(
    lambda s, d: prepare.column_stats(vectors(s, d)).select("col", "n", "n_nan", r6("mean").alias("mean"), F.round("sd", 6).alias("sd"), r6("mid").alias("mid"))
)
query("correlations", f"WITH {VEC}, c AS (SELECT unnest(range((SELECT max(len(v)) FROM vec))) c) SELECT a.c::INTEGER a, b.c::INTEGER b, round(corr(v[a.c + 1], v[b.c + 1]), 6) + 0.0 r FROM vec, c a, c b WHERE a.c < b.c AND NOT isnan(v[a.c + 1]) AND NOT isnan(v[b.c + 1]) GROUP BY ALL")(lambda s, d: prepare.correlations(vectors(s, d)).withColumn("r", r6("r")))
query("scaled_columns", f"WITH {VEC}, e AS (SELECT vec_id, unnest(range(len(v))) col, unnest(v) x FROM vec), s AS (SELECT col, avg(x) m, stddev_pop(x) s FROM e GROUP BY ALL) SELECT vec_id, col::INTEGER col, CASE WHEN s = 0 THEN 0.0 ELSE round((x - m) / s, 6) + 0.0 END z FROM e JOIN s USING (col)")(lambda s, d: prepare.scaled_rows(vectors(s, d), ["vec_id"]).withColumn("z", r6("z")))
query("centroids", f"WITH {VEC}, e AS (SELECT label, unnest(range(len(v))) col, unnest(v) x FROM vec) SELECT label, col::INTEGER col, round(avg(x), 6) + 0.0 centre, count(*) n FROM e GROUP BY ALL")(lambda s, d: prepare.centroids(vectors(s, d), "label").withColumn("centre", r6("centre")))
_DIST = f"WITH {VEC}, e AS (SELECT vec_id, label, unnest(range(len(v))) col, unnest(v) x FROM vec), c AS (SELECT label, col, avg(x) m FROM e GROUP BY ALL), cd AS (SELECT vec_id, label, sqrt(sum((x - m) ** 2) / count(*)) distance FROM e JOIN c USING (label, col) GROUP BY ALL)"
cd = lambda s, d: prepare.centre_distances(vectors(s, d), "vec_id", "label")
query("outliers", _DIST + ", z AS (SELECT *, (distance - avg(distance) OVER (PARTITION BY label)) / stddev_samp(distance) OVER (PARTITION BY label) z FROM cd) SELECT vec_id, label, round(distance, 6) distance, round(z, 6) + 0.0 z FROM z WHERE z > 1.5")(
    lambda s, d: prepare.outliers(cd(s, d), "label", 1.5).select("vec_id", "label", F.round("distance", 6).alias("distance"), r6("z").alias("z"))
)
query("representatives", _DIST + " SELECT vec_id, label, round(distance, 6) distance, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), vec_id)::INTEGER rank FROM cd QUALIFY rank <= 3")(lambda s, d: prepare.representatives(cd(s, d), "vec_id", "label", 3).withColumn("distance", F.round("distance", 6)))
query("label_composition", "SELECT label, count(*) n, round(count(*) / (SELECT count(*) FROM embeddings), 6) part FROM embeddings GROUP BY ALL")(
    lambda s, d: vectors(s, d).groupBy("label").agg(F.count("*").alias("n")).withColumn("part", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))
)

# ---------------------------------------------------------------- evaluation
SCORED = f"{NOTES}, sc AS (SELECT id, verdict IN ('seed', 'interesting') truth, least(1.0, (end_idx - start_idx) / 6000) score FROM notes WHERE end_idx > start_idx)"


def scored(s, d):
    return notes(s, d).filter("end_idx > start_idx").select("id", F.col("verdict").isin("seed", "interesting").alias("truth"), F.least(F.lit(1.0), (F.col("end_idx") - F.col("start_idx")) / 6000).alias("score"))


STEPS = [round(0.05 * k, 2) for k in range(1, 20)]
query("threshold_sweep", f"WITH {SCORED}, t AS (SELECT unnest([{', '.join(map(str, STEPS))}])::DOUBLE threshold), c AS (SELECT threshold, count(*) FILTER (score >= threshold) n_positive, count(*) FILTER (score >= threshold AND truth) tp, count(*) FILTER (truth) pos FROM sc, t GROUP BY ALL), p AS (SELECT threshold, n_positive, CASE WHEN n_positive > 0 THEN tp / n_positive ELSE 0 END p, CASE WHEN pos > 0 THEN tp / pos ELSE 0 END r FROM c) SELECT threshold, n_positive, round(p, 6) \"precision\", round(r, 6) recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) f1 FROM p")(
    lambda s, d: prepare.threshold_sweep(scored(s, d), STEPS).select("threshold", "n_positive", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
)
query("auc_roc", f"WITH {SCORED}, c AS (SELECT score, count(*) FILTER (truth) p, count(*) FILTER (NOT truth) q FROM sc GROUP BY ALL), w AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) w FROM c) SELECT round(sum(w) / (sum(p) * sum(q)), 6) auc, sum(p)::BIGINT n_pos, sum(q)::BIGINT n_neg FROM w")(lambda s, d: prepare.auc_roc(scored(s, d)).withColumn("auc", F.round("auc", 6)))
query("accuracy", f"WITH {SCORED} SELECT round(avg(((score >= 0.5) = truth)::INT), 6) accuracy, round((avg(CASE WHEN truth THEN (score >= 0.5)::INT END) + avg(CASE WHEN NOT truth THEN (score < 0.5)::INT END)) / 2, 6) balanced FROM sc")(
    lambda s, d: scored(s, d).select("truth", (F.col("score") >= 0.5).alias("hit")).agg(F.round(F.avg((F.col("hit") == F.col("truth")).cast("double")), 6).alias("accuracy"), F.round((F.avg(F.when(F.col("truth"), F.col("hit").cast("double"))) + F.avg(F.when(~F.col("truth"), (~F.col("hit")).cast("double")))) / 2, 6).alias("balanced"))
)

# ---------------------------------------------------------------- images of windows


def image(s, d, kind):
    """Each window's n x n image as one array of rows, summed up here by its mean, least and largest value."""
    lo, hi = F.array_min("v"), F.array_max("v")
    phi = F.transform("v", lambda x: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (x - lo) / (hi - lo) - 1))))
    w = vectors(s, d).withColumn("phi", phi)
    cell = (lambda a, b: F.cos(a + b)) if kind == "sum" else (lambda a, b: F.sin(a - b))
    img = w.select("vec_id", F.flatten(F.transform("phi", lambda a: F.transform("phi", lambda b: cell(a, b)))).alias("m"))
    total = F.aggregate("m", F.lit(0.0), lambda x, y: x + y)
    return img.select("vec_id", F.size("m").alias("n"), r6(total / F.size("m")).alias("mean"), r6(F.array_min("m")).alias("lo"), r6(F.array_max("m")).alias("hi"))


_PHI = f"WITH {PTS}, m AS (SELECT recording_id, min(x) lo, max(x) hi FROM pts GROUP BY ALL), ph AS (SELECT recording_id, idx, acos(least(1, greatest(-1, 2 * (x - lo) / (hi - lo) - 1))) p FROM pts JOIN m USING (recording_id))"
query("gasf", _PHI + " SELECT a.recording_id vec_id, count(*)::INTEGER n, round(avg(cos(a.p + b.p)), 6) + 0.0 mean, round(min(cos(a.p + b.p)), 6) + 0.0 lo, round(max(cos(a.p + b.p)), 6) + 0.0 hi FROM ph a JOIN ph b USING (recording_id) GROUP BY ALL")(lambda s, d: image(s, d, "sum"))
query("gadf", _PHI + " SELECT a.recording_id vec_id, count(*)::INTEGER n, round(avg(sin(a.p - b.p)), 6) + 0.0 mean, round(min(sin(a.p - b.p)), 6) + 0.0 lo, round(max(sin(a.p - b.p)), 6) + 0.0 hi FROM ph a JOIN ph b USING (recording_id) GROUP BY ALL")(lambda s, d: image(s, d, "difference"))


def recurrence(s, d, m=3, tau=4):
    """Distances between delay vectors (m values, tau apart) of a window: mean and largest."""
    k = F.size("v") - (m - 1) * tau
    emb = F.transform(F.sequence(F.lit(1), k), lambda i: F.array(*[F.element_at("v", i + j * tau) for j in range(m)]))
    w = vectors(s, d).filter(k > 0).withColumn("e", emb)
    gap = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, q: t + q))
    img = w.select("vec_id", F.flatten(F.transform("e", lambda a: F.transform("e", lambda b: gap(a, b)))).alias("m"))
    return img.select("vec_id", F.size("m").alias("n"), r6(F.aggregate("m", F.lit(0.0), lambda x, y: x + y) / F.size("m")).alias("mean"), r6(F.array_max("m")).alias("hi"))


query("recurrence", f"WITH {PTS}, e AS (SELECT recording_id, idx, x a, lead(x, 4) OVER w b, lead(x, 8) OVER w c FROM pts WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), f AS (SELECT * FROM e WHERE c IS NOT NULL), g AS (SELECT p.recording_id vec_id, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2) g FROM f p JOIN f q USING (recording_id)) SELECT vec_id, count(*)::INTEGER n, round(avg(g), 6) + 0.0 mean, round(max(g), 6) + 0.0 hi FROM g GROUP BY ALL")(recurrence)

# ---------------------------------------------------------------- matrix profile and drops
M = 8
_SUBS = f"WITH {SIG}, sub AS (SELECT recording_id, idx i, list(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {M - 1} FOLLOWING) v FROM sig), zz AS (SELECT recording_id, i, list_transform(v, lambda q: (q - list_avg(v)) / list_stddev_pop(v)) z FROM sub WHERE len(v) = {M}), pr AS (SELECT a.recording_id, a.i, b.i j, round(list_distance(a.z, b.z), 6) + 0.0 dist FROM zz a JOIN zz b ON a.recording_id = b.recording_id AND abs(a.i - b.i) > {M // 4}), best AS (SELECT recording_id, i, min(dist) dist FROM pr GROUP BY ALL)"


def profile(s, d):
    from tidemark.operators.profile import matrix_profile

    return matrix_profile(signal(s, d), M)


query("matrix_profile", _SUBS + " SELECT recording_id, i idx, dist FROM best")(lambda s, d: profile(s, d).select("recording_id", "idx", r6("dist").alias("dist")))
query("profile_discords", _SUBS + " SELECT recording_id, max(dist) dist FROM best GROUP BY ALL")(lambda s, d: profile(s, d).groupBy("recording_id").agg(r6(F.max("dist")).alias("dist")))


def noise(s, d):
    """Noise of the slope by the second difference, 1.4826 times its median deviation over root 6 and root 2, and of the level."""
    w = Window.partitionBy("recording_id").orderBy("idx")
    x = signal(s, d).withColumn("d2", F.col("x") - 2 * F.lag("x", 1).over(w) + F.lag("x", 2).over(w))
    mid = x.groupBy("recording_id").agg(F.percentile("x", 0.5).alias("m"), F.percentile("d2", 0.5).alias("m2"))
    j = x.join(mid, "recording_id")
    return j.groupBy("recording_id").agg(r6(1.4826 * F.percentile(F.abs(F.col("x") - F.col("m")), 0.5)).alias("level"), r6(1.4826 * F.percentile(F.abs(F.col("d2") - F.col("m2")), 0.5) / (6**0.5) / (2**0.5)).alias("slope"))


query("noise_sigma", f"WITH {SIG}, x AS (SELECT *, x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w d2 FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), m AS (SELECT recording_id, median(x) m, median(d2) m2 FROM x GROUP BY ALL) SELECT recording_id, round(1.4826::DOUBLE * median(abs(x - m)), 6) level, round(1.4826::DOUBLE * median(abs(d2 - m2)) / sqrt(6) / sqrt(2), 6) slope FROM x JOIN m USING (recording_id) GROUP BY ALL")(noise)


def profiles(s, d):
    from tidemark.operators import profile as mp

    return mp, signal(s, d), profile(s, d)


_LINKS = _SUBS.replace("WITH sig", "WITH RECURSIVE sig", 1).replace("round(list_distance(a.z, b.z), 6)", "round(list_distance(a.z, b.z), 9)") + ", sd AS (SELECT recording_id, i, first(j ORDER BY dist, j) FILTER (j < i) l, first(j ORDER BY dist, j) FILTER (j > i) r FROM pr GROUP BY ALL), lk AS (SELECT a.recording_id, a.i idx, a.r following FROM sd a JOIN sd b ON b.recording_id = a.recording_id AND b.i = a.r AND b.l = a.i)"
query("profile_links", _LINKS + " SELECT * FROM lk")(lambda s, d: profiles(s, d)[0].links(profile(s, d)))
query(
    "profile_chains",
    _LINKS + ", w AS (SELECT recording_id, idx chain, 0::BIGINT pos, idx FROM lk WHERE NOT EXISTS (SELECT 1 FROM lk p WHERE p.recording_id = lk.recording_id AND p.following = lk.idx) UNION ALL SELECT w.recording_id, w.chain, w.pos + 1, lk.following FROM w JOIN lk ON lk.recording_id = w.recording_id AND lk.idx = w.idx), "
    "l AS (SELECT recording_id, chain, count(*) n FROM w GROUP BY ALL), t AS (SELECT recording_id, chain best FROM l QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, chain) = 1) SELECT recording_id, chain, pos, idx, n AS \"length\", chain = best longest FROM w JOIN l USING (recording_id, chain) JOIN t USING (recording_id)",
)(lambda s, d: profiles(s, d)[0].chains(profile(s, d)))


query("profile_slice", _SUBS + " SELECT recording_id, i idx, dist FROM best WHERE i >= 10 AND i + 8 <= 40")(lambda s, d: profiles(s, d)[0].sliced(profile(s, d), M, 10, 40).select("recording_id", "idx", r6("dist").alias("dist")))
SEED = [0.0, 1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 0.5]
query("seed_nearest", f"WITH {SIG}, sub AS (SELECT recording_id, idx, list(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) v FROM sig), q AS (SELECT [0.0, 1.0, 2.0, 3.0, 2.0, 1.0, 0.0, 0.5]::DOUBLE[] q), z AS (SELECT recording_id, list_transform(v, lambda t: (t - list_avg(v)) / list_stddev_pop(v)) z, list_transform(q, lambda t: (t - list_avg(q)) / list_stddev_pop(q)) qz FROM sub, q WHERE len(v) = 8 AND list_stddev_pop(v) > 0) SELECT recording_id, round(min(list_distance(z, qz)), 6) distance FROM z GROUP BY ALL")(
    lambda s, d: profiles(s, d)[0].seed_matches(signal(s, d), SEED, 1).select("recording_id", r6("distance").alias("distance"))
)


@query("motif_groups")
def snippet_families(s, d):
    mp, sig, prof = profiles(s, d)
    return mp.motif_groups(sig, cut_lineage(prof), M, 4)
