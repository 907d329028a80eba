"""Queries of the relational store, interval joins, evaluation, trend modes, event regions and window-matrix helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.operators import islands as isl
from tidemark.operators import store as st
from tidemark.operators import sweep, trends
from tidemark.operators import symbols as sy
from tidemark.queries.base import LEN, NOTES, RECS, SIG, notes, r6, recs, signal, vectors
from tidemark.queries.records import SCORED, reviewed, scored
from tidemark.tables import clean_path, first_loaded, read

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


# ---------------------------------------------------------------- the store
query("list_recordings", f"WITH {RECS} SELECT id, source_file, channel, fs, n_samples FROM recs WHERE channel IN (0, 1, 2, 3)")(lambda s, d: recs(s, d).filter(F.col("channel").isin(0, 1, 2, 3)).select("id", "source_file", "channel", "fs", "n_samples").orderBy("id"))
query("list_runs", "SELECT o_orderkey run_id, o_custkey config_id, o_orderstatus status FROM orders WHERE o_orderstatus = 'F'")(lambda s, d: read(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("config_id"), F.col("o_orderstatus").alias("status")).orderBy("run_id"))
query("annotations_by_ids", f"WITH {NOTES} SELECT id, recording_id, verdict FROM notes WHERE id IN (SELECT parent_annotation_id FROM notes)")(
    lambda s, d: st.filter_annotations(notes(s, d), ids=notes(s, d).select(F.col("parent_annotation_id").alias("id"))).select("id", R, "verdict")
)
query("filtered_annotations", f"WITH {NOTES} SELECT id, verdict, source FROM notes WHERE verdict IN ('seed', 'unsure') AND tag IN ('fin', 'dip', 'crest') AND contains(lower(concat_ws(' ', note, tag)), 'i')")(
    lambda s, d: st.filter_annotations(notes(s, d), verdict=["seed", "unsure"], tag=["fin", "dip", "crest"], source=[], text="I").select("id", "verdict", "source")
)


def tags(s, d):
    """``id, category, value``: an annotation's shape, state and relation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(v).alias("value")) for c, v in (("element", "tag"), ("quality", "status"), ("origin", "source"))])
    return notes(s, d).select("id", F.inline(pairs)).filter("value is not null")


_TAGS = f"WITH {NOTES}, tags AS (SELECT id, 'element' category, tag AS \"value\" FROM notes WHERE tag IS NOT NULL UNION ALL SELECT id, 'quality', status FROM notes WHERE status IS NOT NULL UNION ALL SELECT id, 'origin', source FROM notes)"
query("tag_lists", _TAGS + " SELECT id, category, list(DISTINCT \"value\" ORDER BY \"value\") tags FROM tags GROUP BY ALL")(lambda s, d: st.tag_lists(tags(s, d)))
query("tags_matching_all", _TAGS + " SELECT id FROM tags WHERE category = 'element' AND \"value\" IN ('fin', 'ridge') INTERSECT SELECT id FROM tags WHERE category = 'quality' AND \"value\" IN ('examined', 'confirmed')")(lambda s, d: st.matching_all(tags(s, d), {"element": ["fin", "ridge"], "quality": ["examined", "confirmed"], "origin": []}))
query("replaced_tags", _TAGS + ", f AS (SELECT id, 'quality' category, 'kept' AS \"value\" FROM notes WHERE verdict = 'seed') SELECT * FROM tags WHERE (id, category) NOT IN (SELECT id, category FROM f) UNION SELECT * FROM f")(
    lambda s, d: st.replace_tags(tags(s, d), notes(s, d).filter("verdict = 'seed'").select("id", F.lit("quality").alias("category"), F.lit("kept").alias("value")))
)
query("missing_provenance", _TAGS + " SELECT id FROM notes WHERE source = 'label_import' AND id NOT IN (SELECT id FROM tags WHERE category = 'quality')")(lambda s, d: st.missing_tag(notes(s, d).filter("source = 'label_import'"), tags(s, d), "quality"))
query("current_reviews", "SELECT npy_path, n_samples, data_sha1 FROM (SELECT * FROM channel_files QUALIFY row_number() OVER (PARTITION BY npy_path ORDER BY written_at DESC) = 1) WHERE deleted_at IS NULL")(
    lambda s, d: st.current(read(s, d, "channel_files").select("npy_path", "written_at", "n_samples", "data_sha1", "deleted_at"), ["npy_path"], "written_at", "deleted_at").select("npy_path", "n_samples", "data_sha1")
)
query("motif_provenance", "SELECT l_orderkey, l_linenumber, o_orderstatus, c_name, n_name, r_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(
    lambda s, d: read(s, d, "lineitem").join(read(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    .join(read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("l_orderkey", "l_linenumber", "o_orderstatus", "c_name", "n_name", "r_name")
)
_CP = r"regexp_replace(regexp_replace(replace(trim(npy_path), '\', '/'), '/+', '/', 'g'), '^\./', '')"


def file_states(s, d):
    """Each recording with the newest row of its file: ``fresh`` if that is there and has the recording's length, else ``stale``, ``deleted`` or ``missing``."""
    path = clean_path(F.col("npy_path"))
    files = read(s, d, "channel_files").groupBy(path.alias("path")).agg(F.max(F.struct("written_at", F.col("deleted_at").isNotNull().alias("gone"), "n_samples", "logger")).alias("f"))
    j = recs(s, d).filter("npy_path is not null").select("id", path.alias("path"), "n_samples").join(files, "path", "left")
    state = F.when(F.col("f").isNull(), "missing").when(F.col("f.gone"), "deleted").when(F.col("f.n_samples") == F.col("n_samples"), "fresh").otherwise("stale")
    return j.select("id", state.alias("state"), "f.logger")


query("file_states", f"WITH {RECS}, f AS (SELECT {_CP} p, max_by(deleted_at IS NOT NULL, written_at) gone, max_by(n_samples, written_at) n, max_by(logger, written_at) logger FROM channel_files GROUP BY 1) SELECT id, CASE WHEN p IS NULL THEN 'missing' WHEN gone THEN 'deleted' WHEN n = n_samples THEN 'fresh' ELSE 'stale' END state, logger FROM (SELECT id, n_samples, {_CP} q FROM recs WHERE npy_path IS NOT NULL) LEFT JOIN f ON p = q")(file_states)
query("relabelled", "SELECT CASE WHEN label = 3 THEN 1 ELSE label END label, count(*) n FROM embeddings GROUP BY ALL")(lambda s, d: vectors(s, d).groupBy(F.when(F.col("label") == 3, 1).otherwise(F.col("label")).alias("label")).agg(F.count("*").alias("n")))

# ---------------------------------------------------------------- interval joins
_SP = "s1 AS (SELECT id, recording_id, start_idx, end_idx FROM notes WHERE end_idx > start_idx AND recording_id IS NOT NULL), s2 AS (SELECT id, recording_id, start_idx, end_idx FROM (SELECT * FROM reviewed_spans QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE end_idx > start_idx AND recording_id IS NOT NULL)"


def valid_notes(s, d):
    return notes(s, d).filter("end_idx > start_idx and recording_id is not null").select("id", R, "start_idx", "end_idx")


def valid_reviews(s, d):
    return first_loaded(read(s, d, "reviewed_spans"), "id", [R, "start_idx", "end_idx"]).filter("end_idx > start_idx and recording_id is not null").select("id", R, "start_idx", "end_idx")


query("similar_annotations", f"WITH {NOTES}, {_SP}, p AS (SELECT a.id candidate_id, b.id, (least(a.end_idx, b.end_idx) - greatest(a.start_idx, b.start_idx)) / (greatest(a.end_idx, b.end_idx) - least(a.start_idx, b.start_idx)) iou, greatest(a.end_idx - a.start_idx, b.end_idx - b.start_idx) / least(a.end_idx - a.start_idx, b.end_idx - b.start_idx) ratio FROM s2 a JOIN s1 b ON a.recording_id = b.recording_id AND a.start_idx < b.end_idx AND b.start_idx < a.end_idx) SELECT candidate_id, id, round(iou, 6) iou FROM p WHERE iou >= 0.8 AND ratio <= 1.5")(
    lambda s, d: st.similar_spans(valid_reviews(s, d), valid_notes(s, d)).withColumn("iou", F.round("iou", 6))
)
query(
    "joined_events",
    f"WITH {NOTES}, {_SP}, p AS (SELECT a.recording_id, a.start_idx a0, a.end_idx - 1 a1, b.start_idx b0, b.end_idx - 1 b1 FROM s1 a JOIN s2 b ON a.recording_id = b.recording_id AND a.start_idx <= b.end_idx - 1 AND b.start_idx <= a.end_idx - 1), "
    "k AS (SELECT *, b0 <= a0 AND a1 <= b1 w, a0 <= b0 AND b1 <= a1 e, least(a0, b0) lo, greatest(a1, b1) hi, floor((greatest(a0, b0) + least(a1, b1)) / 2)::BIGINT sp FROM p), "
    "o AS (SELECT recording_id, CASE WHEN w THEN 'whole' ELSE 'part' END kind, CASE WHEN w OR e THEN b0 WHEN sp - lo <= hi - sp THEN lo ELSE sp END from_idx, CASE WHEN w THEN a1 WHEN e THEN b1 WHEN sp - lo <= hi - sp THEN sp ELSE hi END to_idx FROM k) SELECT * FROM o WHERE to_idx - from_idx >= 30",
)(lambda s, d: st.joined_events(valid_notes(s, d).select(R, F.col("start_idx").alias("a0"), (F.col("end_idx") - 1).alias("a1")), valid_reviews(s, d).select(R, F.col("start_idx").alias("b0"), (F.col("end_idx") - 1).alias("b1")), 30))
query("scored_hits", f"WITH {NOTES}, {_SP} SELECT a.id, max(b.id) event FROM s1 a LEFT JOIN s2 b ON a.recording_id = b.recording_id AND (a.start_idx + a.end_idx) / 2 >= b.start_idx - 0.5 * (b.end_idx - b.start_idx) AND (a.start_idx + a.end_idx) / 2 <= b.end_idx + 0.5 * (b.end_idx - b.start_idx) GROUP BY a.id")(
    lambda s, d: st.scored_hits(valid_notes(s, d), valid_reviews(s, d))
)

# ---------------------------------------------------------------- evaluation
query("precision_recall", f"WITH {SCORED}, c AS (SELECT score, count(*) FILTER (truth) p, count(*) n FROM sc GROUP BY ALL), r AS (SELECT score, sum(p) OVER w tp, sum(n) OVER w k, sum(p) OVER () t FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(score, 9) score, round(tp / k, 6) AS \"precision\", round(tp / t, 6) recall FROM r")(
    lambda s, d: st.precision_recall(scored(s, d)).select(F.round("score", 9).alias("score"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
)
query("average_precision", f"WITH {SCORED}, c AS (SELECT score, count(*) FILTER (truth) p, count(*) n FROM sc GROUP BY ALL), r AS (SELECT p, sum(p) OVER w tp, sum(n) OVER w k, sum(p) OVER () t FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(tp / k * p / t), 6) auc FROM r")(lambda s, d: st.precision_recall(scored(s, d)).agg(F.round(F.sum("area"), 6).alias("auc")))
query("best_f1", f"WITH {SCORED}, c AS (SELECT score, count(*) FILTER (truth) p, count(*) n FROM sc GROUP BY ALL), r AS (SELECT score, sum(p) OVER w tp, sum(n) OVER w k, sum(p) OVER () t FROM c WINDOW w AS (ORDER BY score DESC)) SELECT round(max(2 * tp / (k + t)), 6) f1 FROM r")(
    lambda s, d: st.precision_recall(scored(s, d)).agg(F.round(F.max(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)), 6).alias("f1"))
)
query("tag_information", f"WITH {NOTES}, c AS (SELECT tag a, verdict b, count(*) n FROM notes WHERE tag IS NOT NULL AND verdict IS NOT NULL GROUP BY ALL), h AS (SELECT (SELECT -sum(n / t * log2(n / t)) FROM (SELECT sum(n) n, (SELECT sum(n) FROM c) t FROM c GROUP BY a)) h_a, (SELECT -sum(n / t * log2(n / t)) FROM (SELECT sum(n) n, (SELECT sum(n) FROM c) t FROM c GROUP BY b)) h_b, (SELECT -sum(n / t * log2(n / t)) FROM (SELECT n, (SELECT sum(n) FROM c) t FROM c)) h) SELECT round(h_a, 6) h_a, round(h_b, 6) h_b, round(h_a + h_b - h, 6) mutual, round((h_a + h_b - h) / ((h_a + h_b) / 2), 6) nmi FROM h")(
    lambda s, d: st.mutual_information(notes(s, d), "tag", "verdict").select(*[F.round(c, 6).alias(c) for c in ("h_a", "h_b", "mutual", "nmi")])
)
query("rand_index", f"WITH {NOTES}, c AS (SELECT tag a, verdict b, count(*) n FROM notes WHERE tag IS NOT NULL AND verdict IS NOT NULL GROUP BY ALL), o AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) bt, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) n FROM c GROUP BY a)) sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) n FROM c GROUP BY b)) sb, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) pairs) SELECT pairs::DOUBLE pairs, (pairs + 2 * bt - sa - sb)::DOUBLE agreeing, round((pairs + 2 * bt - sa - sb) / pairs, 6) rand FROM o")(
    lambda s, d: st.rand_index(notes(s, d), "tag", "verdict").select("pairs", "agreeing", F.round("rand", 6).alias("rand"))
)

# ---------------------------------------------------------------- regions and complexity
_REG = "h AS (SELECT recording_id, idx FROM lim WHERE x > t), g AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END c FROM h), k AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY idx) g FROM g), reg AS (SELECT recording_id, min(idx) first_idx, max(idx) last_idx FROM k GROUP BY recording_id, g HAVING max(idx) - min(idx) + 1 >= 2)"


def mad_regions(s, d):
    """Runs above the median by 1.5 scaled median deviations."""
    sig = signal(s, d)
    m = sig.groupBy(R).agg(F.percentile("x", 0.5).alias("m"))
    j = sig.join(m, R)
    lim = j.join(j.groupBy(R).agg((F.first("m") + 1.5 * 1.4826 * F.percentile(F.abs(F.col("x") - F.col("m")), 0.5)).alias("t")), R)
    return isl.regions(lim, [R], F.col("x") > F.col("t"), 2, 2)


_MAD = f"WITH {SIG}, m AS (SELECT recording_id, median(x) m FROM sig GROUP BY ALL), t AS (SELECT recording_id, any_value(m) + 1.5::DOUBLE * 1.4826::DOUBLE * median(abs(x - m)) t FROM sig JOIN m USING (recording_id) GROUP BY ALL), lim AS (SELECT * FROM sig JOIN t USING (recording_id)), {_REG}"
query("high_regions_mad", _MAD + " SELECT * FROM reg")(mad_regions)


def moving_regions(s, d, size=9):
    """Runs above the moving mean by one moving deviation, edges repeated."""
    sig = signal(s, d)
    a = fr.replicated_mean(sig, size)
    q = fr.replicated_mean(sig.withColumn("x", F.col("x") * F.col("x")), size).select(R, "idx", F.col("mean").alias("q"))
    lim = a.join(q, [R, "idx"]).withColumn("t", F.col("mean") + F.sqrt(F.greatest(F.col("q") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return isl.regions(lim, [R], F.round(F.col("x") - F.col("t"), 9) > 0, 2, 2)


query(
    "high_regions_moving",
    f"WITH {SIG}, {LEN}, near AS (SELECT s.recording_id, s.idx, s.x, q.x y FROM (SELECT recording_id, idx, x, n, unnest(range(-4, 5)) k FROM sig JOIN len USING (recording_id)) s JOIN sig q ON q.recording_id = s.recording_id AND q.idx = least(greatest(s.idx + s.k, 0), s.n - 1)), lim AS (SELECT recording_id, idx, round(any_value(x) - avg(y) - sqrt(greatest(avg(y * y) - avg(y) ** 2, 0)), 9) x, 0 t FROM near GROUP BY recording_id, idx), {_REG} SELECT * FROM reg",
)(moving_regions)


def peaks_inside(s, d):
    """Strict local maxima that lie within a region."""
    peaks = fr.framed(signal(s, d), 1, 1, p=lambda w: F.lag("x").over(w), q=lambda w: F.lead("x").over(w)).filter("x > p and x > q").select(R, "idx")
    return st.containing(peaks, mad_regions(s, d), [R], "idx", "first_idx", "last_idx").select(R, "idx")


query("peaks_in_regions", _MAD + ", p AS (SELECT recording_id, idx FROM (SELECT *, lag(x) OVER w p, lead(x) OVER w q FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) WHERE x > p AND x > q) SELECT p.recording_id, p.idx FROM p JOIN reg ON reg.recording_id = p.recording_id AND p.idx BETWEEN first_idx AND last_idx")(peaks_inside)


def complexity(s, d):
    """Per recording: entropy and diversity of span lengths, their ratio, and the share of the recording that spans cover."""
    a = valid_notes(s, d)
    c = a.groupBy(R, (F.col("end_idx") - F.col("start_idx")).alias("w")).agg(F.count("*").alias("c"))
    p = c.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(R)))
    h = p.groupBy(R).agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.sum(F.col("p") * F.col("p")).alias("d"))
    u = sweep.periods(a, [R], "start_idx", "end_idx").groupBy(R).agg(F.sum(F.col("to_idx") - F.col("from_idx")).alias("u"))
    n = recs(s, d).select(F.col("id").alias(R), "n_samples")
    return h.join(u, R).join(n, R, "left").select(R, r6("h").alias("shannon"), F.round("d", 6).alias("simpson"), r6(F.when(F.col("d") == 0, 0.0).otherwise(F.col("h") / F.col("d"))).alias("expressiveness"), F.round(F.when(F.col("n_samples") > 0, F.col("u") / F.col("n_samples")), 6).alias("space_filling"))


query("span_complexity", f"WITH {NOTES}, {_SP}, {RECS}, c AS (SELECT recording_id, end_idx - start_idx w, count(*) c FROM s1 GROUP BY ALL), p AS (SELECT recording_id, c / sum(c) OVER (PARTITION BY recording_id) p FROM c), h AS (SELECT recording_id, -sum(p * ln(p)) h, sum(p * p) d FROM p GROUP BY ALL), g AS (SELECT *, CASE WHEN start_idx <= max(end_idx) OVER (PARTITION BY recording_id ORDER BY start_idx, end_idx, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM s1), i AS (SELECT *, sum(n) OVER (PARTITION BY recording_id ORDER BY start_idx, end_idx, id ROWS UNBOUNDED PRECEDING) k FROM g), u AS (SELECT recording_id, sum(e - s) u FROM (SELECT recording_id, min(start_idx) s, max(end_idx) e FROM i GROUP BY recording_id, k) GROUP BY ALL) SELECT h.recording_id, round(h, 6) + 0.0 shannon, round(d, 6) simpson, round(h / d, 6) + 0.0 expressiveness, round(CASE WHEN n_samples > 0 THEN u / n_samples END, 6) space_filling FROM h JOIN u USING (recording_id) LEFT JOIN recs ON recs.id = h.recording_id")(complexity)


def normalised_coefficients(s, d):
    """Absolute segment means of three scales, each scale brought to [0, 240], zeros made 1, summed over scales at each position."""
    opts = F.array(*[F.lit(k) for k in (4, 8, 16)])
    g = signal(s, d).select(R, "idx", "x", F.explode(opts).alias("scale")).groupBy(R, "scale", F.floor(F.col("idx") / F.col("scale")).alias("seg")).agg(F.abs(F.avg("x")).alias("c"))
    m = g.groupBy(R, "scale").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    v = g.join(m, [R, "scale"]).withColumn("v", F.when(F.col("hi") == F.col("lo"), 0.0).otherwise(240.0 * (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    v = v.withColumn("v", F.when(F.col("v") == 0, 1.0).otherwise(F.col("v")))
    at = v.select(R, "v", F.explode(F.sequence(F.col("seg") * F.col("scale"), F.col("seg") * F.col("scale") + F.col("scale") - 1)).alias("idx"))
    return at.groupBy(R, "idx").agg(r6(F.sum("v")).alias("total")).join(fr.lengths(signal(s, d)), R).filter("idx < n").drop("n")


query("normalised_coefficients", f"WITH {SIG}, g AS (SELECT recording_id, scale, idx // scale seg, abs(avg(x)) c FROM (SELECT *, unnest([4, 8, 16]) scale FROM sig) GROUP BY ALL), m AS (SELECT recording_id, scale, min(c) lo, max(c) hi FROM g GROUP BY ALL), v AS (SELECT recording_id, scale, seg, CASE WHEN hi = lo OR c = lo THEN 1 ELSE 240 * (c - lo) / (hi - lo) END v FROM g JOIN m USING (recording_id, scale)) SELECT sig.recording_id, idx, round(sum(v), 6) + 0.0 total FROM sig JOIN v ON v.recording_id = sig.recording_id AND v.seg = sig.idx // v.scale GROUP BY ALL")(normalised_coefficients)


def paired_extrema(s, d):
    """The i-th local minimum with the i-th local maximum from the first one above the first minimum on; rises below mean less deviation of the recording go."""
    e = fr.framed(signal(s, d), 1, 1, p=lambda w: F.lag("x").over(w), q=lambda w: F.lead("x").over(w))
    rank = F.row_number().over(Window.partitionBy(R).orderBy("idx"))
    low = e.filter("x < p and x < q").select(R, "idx", "x").withColumn("i", rank)
    high = e.filter("x > p and x > q").select(R, F.col("idx").alias("hi_idx"), F.col("x").alias("hi"), "idx").withColumn("i", rank).drop("idx")
    base = low.filter("i = 1").select(R, F.col("x").alias("base"))
    start = high.join(base, R).groupBy(R).agg(F.coalesce(F.min(F.when(F.col("hi") > F.col("base"), F.col("i"))), F.lit(1)).alias("j"))
    pairs = low.join(start, R).withColumn("k", F.col("i") + F.col("j") - 1).join(high.select(R, F.col("i").alias("k"), "hi_idx", "hi"), [R, "k"])
    pairs = pairs.select(R, F.col("idx").alias("low_idx"), "hi_idx", (F.col("hi") - F.col("x")).alias("rise"))
    lim = pairs.groupBy(R).agg(F.when(F.count("*") > 1, F.avg("rise") - F.stddev_pop("rise")).alias("least"))
    return pairs.join(lim, R).filter("least is null or rise >= least").select(R, "low_idx", "hi_idx", r6("rise").alias("rise"))


query("paired_extrema", f"WITH {SIG}, e AS (SELECT *, lag(x) OVER w p, lead(x) OVER w q FROM sig WINDOW w AS (PARTITION BY recording_id ORDER BY idx)), lo AS (SELECT recording_id, idx, x, row_number() OVER (PARTITION BY recording_id ORDER BY idx) i FROM e WHERE x < p AND x < q), hi AS (SELECT recording_id, idx, x, row_number() OVER (PARTITION BY recording_id ORDER BY idx) i FROM e WHERE x > p AND x > q), st AS (SELECT hi.recording_id, coalesce(min(hi.i) FILTER (hi.x > b.x), 1) j FROM hi JOIN lo b ON b.recording_id = hi.recording_id AND b.i = 1 GROUP BY ALL), pr AS (SELECT lo.recording_id, lo.idx low_idx, hi.idx hi_idx, hi.x - lo.x rise FROM lo JOIN st USING (recording_id) JOIN hi ON hi.recording_id = lo.recording_id AND hi.i = lo.i + st.j - 1), l AS (SELECT recording_id, CASE WHEN count(*) > 1 THEN avg(rise) - stddev_pop(rise) END least FROM pr GROUP BY ALL) SELECT recording_id, low_idx, hi_idx, round(rise, 6) + 0.0 rise FROM pr JOIN l USING (recording_id) WHERE least IS NULL OR rise >= least")(paired_extrema)

# ---------------------------------------------------------------- trend modes
PER = 6
_SEG = f"WITH {SIG}, sg AS (SELECT recording_id, idx // {PER} seg, list(x ORDER BY idx) v FROM sig GROUP BY ALL HAVING count(*) = {PER})"
query("robust_endpoints", _SEG + " SELECT recording_id, seg, round(list_median(v[5:6]) - list_median(v[1:2]), 6) + 0.0 delta FROM sg")(lambda s, d: trends.robust_endpoints(signal(s, d), PER, 2).withColumn("delta", r6("delta")))
query("theil_sen", f"WITH {SIG}, a AS (SELECT recording_id, idx // {PER} seg, idx, x FROM sig), f AS (SELECT recording_id, seg FROM a GROUP BY ALL HAVING count(*) = {PER}) SELECT recording_id, seg, round(median((b.x - a.x) / (b.idx - a.idx)) * {PER - 1}, 6) + 0.0 delta FROM a JOIN f USING (recording_id, seg) JOIN a b USING (recording_id, seg) WHERE a.idx < b.idx GROUP BY ALL")(lambda s, d: trends.theil_sen(signal(s, d), PER).withColumn("delta", r6("delta")))
_DEL = f"WITH {SIG}, dl AS (SELECT recording_id, idx // {PER} seg, regr_slope(x, idx) * {PER - 1} delta FROM sig GROUP BY ALL HAVING count(*) = {PER})"


def deltas(s, d):
    return sy.trends(signal(s, d), PER)


query("trend_symbols_absolute", _DEL + " SELECT recording_id, seg, ((delta >= -20)::INT + (delta >= 20)::INT)::INTEGER symbol FROM dl")(lambda s, d: trends.symbols_of(deltas(s, d), trends.cut_lines(deltas(s, d), "absolute", threshold=20.0)).drop("delta"))
query("trend_symbols_five", _DEL + ", q AS (SELECT recording_id, quantile_cont(delta, [0.2, 0.4, 0.6, 0.8]) q FROM dl GROUP BY ALL HAVING max(delta) > min(delta)), h AS (SELECT recording_id, (q[4] - q[1]) / 2 o, (q[3] - q[2]) / 2 i FROM q) SELECT recording_id, seg, ((delta >= -o)::INT + (delta >= -i)::INT + (delta >= i)::INT + (delta >= o)::INT)::INTEGER symbol FROM dl JOIN h USING (recording_id)")(
    lambda s, d: trends.symbols_of(deltas(s, d), trends.cut_lines(deltas(s, d), k=5)).join(deltas(s, d).groupBy(R).agg((F.max("delta") > F.min("delta")).alias("vary")), R).filter("vary").drop("delta", "vary")
)
query("trend_diagnostics", _DEL + ", h AS (SELECT recording_id, greatest((quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25)) / 2, 15) h FROM dl GROUP BY ALL HAVING max(delta) > min(delta)), g AS (SELECT recording_id, any_value(h) h, avg((delta >= -h AND delta < h)::INT) s, avg(delta) m FROM dl JOIN h USING (recording_id) GROUP BY ALL) SELECT recording_id, round(h, 6) half_width, round(s, 6) same_share, round(m, 6) + 0.0 mean_delta, s BETWEEN 0.4 AND 0.6 suspect, abs(m) > 0.25 * h drifting FROM g")(
    lambda s, d: trends.diagnostics(deltas(s, d), trends.cut_lines(deltas(s, d), least_half=15.0)).join(deltas(s, d).groupBy(R).agg((F.max("delta") > F.min("delta")).alias("vary")), R).filter("vary").select(R, F.round("half_width", 6).alias("half_width"), F.round("same_share", 6).alias("same_share"), r6("mean_delta").alias("mean_delta"), "suspect", "drifting")
)


def seed_rows(s, d):
    return first_loaded(read(s, d, "seeds"), "seed_id", ["symbols"])


_SEEDS = "WITH q AS (SELECT seed_id, symbols v, unnest(range(len(symbols) - 3)) p FROM (SELECT * FROM seeds QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY loaded_at) = 1) WHERE len(symbols) >= 4)"
query("seed_matches", _SEEDS + ", m AS (SELECT seed_id, p, (v[p + 1] != 1)::INT + (v[p + 2] != 2)::INT + (v[p + 4] != 1)::INT n FROM q) SELECT seed_id, p::INTEGER first_pos, round(n / 3, 6) distance FROM m WHERE n <= 1")(lambda s, d: trends.matches(seed_rows(s, d), "seed_id", [1, 2, -1, 1], most=1).withColumn("distance", F.round("distance", 6)))
_CUT4 = sy.cutlines(4)
_COST = sy.cell_table(_CUT4)
query("seed_distances", _SEEDS + f", c AS (SELECT {[[x * x for x in row] for row in _COST]!r} c) SELECT seed_id, p::INTEGER first_pos, round(sqrt((coalesce(c[4][v[p + 1] + 1], 0) + coalesce(c[1][v[p + 2] + 1], 0) + coalesce(c[3][v[p + 4] + 1], 0)) / 4), 6) distance FROM q, c")(
    lambda s, d: trends.matches(seed_rows(s, d), "seed_id", [3, 0, -1, 2], _COST).withColumn("distance", F.round("distance", 6))
)

# ---------------------------------------------------------------- window matrix
query("window_grids", f"WITH {NOTES}, a AS (SELECT DISTINCT recording_id, start_idx FROM notes WHERE recording_id IS NOT NULL AND start_idx IS NOT NULL), g AS (SELECT recording_id, start_idx - lag(start_idx) OVER (PARTITION BY recording_id ORDER BY start_idx) gap FROM a) SELECT recording_id, min(gap) step, coalesce(min(gap) = max(gap), true) uniform, count(*) n FROM g GROUP BY ALL")(lambda s, d: st.grid_of(notes(s, d).filter("recording_id is not null and start_idx is not null")))
query("labels_of_scores", "WITH w AS (SELECT window_id, list_filter(features, lambda v: v IS NOT NULL AND NOT isnan(v)) f FROM (SELECT * FROM cluster_windows QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY loaded_at) = 1)) SELECT window_id, round(list_sum(list_transform(f, lambda v: v::DOUBLE)) / len(f), 6) + 0.0 score, (list_sum(list_transform(f, lambda v: v::DOUBLE)) / len(f) >= 0.5)::INTEGER label FROM w WHERE len(f) > 0")(
    lambda s, d: st.labels_of_scores(first_loaded(read(s, d, "cluster_windows"), "window_id", ["features"])).select("window_id", r6("score").alias("score"), "label")
)
query("stratified_windows", "WITH c AS (SELECT label, count(*) n FROM embeddings GROUP BY ALL) SELECT vec_id, label FROM (SELECT vec_id, e.label, n, row_number() OVER (PARTITION BY e.label ORDER BY md5(vec_id::VARCHAR), vec_id) r FROM embeddings e JOIN c USING (label)) WHERE r <= greatest(1, round_even(n * 100 / (SELECT sum(n) FROM c), 0))")(lambda s, d: st.stratified(vectors(s, d).select("vec_id", "label"), "label", "vec_id", 100))
query("grey_levels", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), m AS (SELECT vec_id, v, list_min(v) lo, list_max(v) hi FROM v) SELECT vec_id, list_transform(v, lambda x: CASE WHEN hi > lo THEN trunc((x - lo) / (hi - lo) * 255)::INTEGER ELSE 0 END) grey FROM m")(
    lambda s, d: vectors(s, d).withColumn("lo", F.array_min("v")).withColumn("hi", F.array_max("v")).select("vec_id", F.transform("v", lambda x: F.when(F.col("hi") > F.col("lo"), ((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255).cast("int")).otherwise(0)).alias("grey"))
)


def window_costs(s, d):
    """Time of each stage over a recording's windows of ten minutes at 1e-8 s per unit, and where such work belongs."""
    m, n = F.lit(600), F.ceil(F.col("n_samples") / 600)
    r = recs(s, d).filter("n_samples > 0")
    each = [r.select("id", F.lit(k).alias("stage"), (1e-8 * n * st.stage_shape(k, m)).alias("seconds")) for k in ("catch22", "fast_entropy", "slow_entropy", "cnn", "rf")]
    rows = each[0]
    for e in each[1:]:
        rows = rows.unionByName(e)
    return rows.select("id", "stage", F.round("seconds", 6).alias("seconds"), st.cost_tier(F.col("seconds")).alias("tier"))


query("window_costs", f"WITH {RECS}, k AS (SELECT id, ceil(n_samples / 600) n, unnest(['catch22', 'fast_entropy', 'slow_entropy', 'cnn', 'rf']) stage FROM recs WHERE n_samples > 0), t AS (SELECT id, stage, 1e-8 * n * CASE WHEN stage IN ('catch22', 'fast_entropy') THEN 600 * log2(600) WHEN stage = 'rf' THEN 600 ELSE 360000 END sec FROM k) SELECT id, stage, round(sec, 6) AS \"seconds\", CASE WHEN sec <= 60 THEN 'interactive' WHEN sec <= 900 THEN 'background' ELSE 'hpc' END tier FROM t")(window_costs)


def scale_coverage(s, d):
    """What annotations viewed at each scale cover, of examined and other ones apart."""
    rows = first_loaded(read(s, d, "annotations"), "id", [R, "start_idx", "end_idx", "scale_viewed", "status", "deleted_at"]).filter("deleted_at is null and scale_viewed is not null")
    rows = rows.withColumn("complete", F.coalesce(F.col("status") == "examined", F.lit(False)))
    return sweep.periods(rows, [R, "scale_viewed", "complete"], "start_idx", "end_idx").select(R, "scale_viewed", "complete", "from_idx", "to_idx")


query("scale_coverage", f"WITH {NOTES}, a AS (SELECT id, recording_id r, scale_viewed v, coalesce(status = 'examined', false) c, start_idx s, end_idx e FROM notes WHERE end_idx > start_idx AND recording_id IS NOT NULL AND scale_viewed IS NOT NULL), g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r, v, c ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM a), i AS (SELECT *, sum(n) OVER (PARTITION BY r, v, c ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) k FROM g) SELECT r recording_id, v scale_viewed, c complete, min(s) from_idx, max(e) to_idx FROM i GROUP BY r, v, c, k")(scale_coverage)


def review_ribbon(s, d, n=50):
    """Each recording in ``n`` equal parts: ``gap``, ``partial`` or ``full`` (95 %) by what reviews cover."""
    r = recs(s, d).filter("n_samples > 0").select(F.col("id").alias(R), "n_samples")
    w = F.col("n_samples") / n
    p = reviewed(s, d).join(r, R).withColumn("a", F.greatest("from_idx", F.lit(0))).withColumn("z", F.least("to_idx", F.col("n_samples"))).filter("z > a")
    cut = p.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / w), F.least(F.lit(n - 1).cast("long"), F.floor(F.col("z") / w)))))
    share = F.greatest(F.lit(0.0), F.least(F.col("z"), (F.col("bucket") + 1) * w) - F.greatest(F.col("a"), F.col("bucket") * w)) / w
    c = cut.groupBy(R, "bucket").agg(F.sum(share).alias("share"))
    grid = r.select(R, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bucket"))
    f = F.round(F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))), 6)
    return grid.join(c, [R, "bucket"], "left").select(R, "bucket", F.when(f == 0, "gap").when(f >= 0.95, "full").otherwise("partial").alias("state"))


query("review_ribbon", "WITH " + RECS + ", rv AS (SELECT id, recording_id r, start_idx s, end_idx e FROM (SELECT * FROM reviewed_spans QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE end_idx > start_idx AND recording_id IS NOT NULL), g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY r ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM rv), i AS (SELECT *, sum(n) OVER (PARTITION BY r ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) k FROM g), per AS (SELECT r, min(s) a, max(e) z FROM i GROUP BY r, k), b AS (SELECT recs.id, n_samples / 50 w, unnest(range(50)) bucket FROM recs WHERE n_samples > 0), c AS (SELECT b.id, bucket, round(least(1.0, coalesce(sum(CASE WHEN z IS NOT NULL THEN greatest(0, least(z, (bucket + 1) * w) - greatest(a, bucket * w)) / w END), 0)), 6) f FROM b LEFT JOIN per ON per.r = b.id GROUP BY ALL) SELECT id recording_id, bucket, CASE WHEN f = 0 THEN 'gap' WHEN f >= 0.95 THEN 'full' ELSE 'partial' END state FROM c")(review_ribbon)
query("drop_segments", f"WITH {RECS} SELECT id, greatest(2, round_even(n_samples / 24.0, 0))::BIGINT segments, round((greatest(2, round_even(n_samples / 24.0, 0)) + 0.5) / n_samples, 9) dim_ratio FROM recs WHERE n_samples > 0")(
    lambda s, d: recs(s, d).filter("n_samples > 0").withColumn("segments", F.greatest(F.lit(2).cast("long"), F.bround(F.col("n_samples") / 24.0, 0).cast("long"))).select("id", "segments", F.round((F.col("segments") + 0.5) / F.col("n_samples"), 9).alias("dim_ratio"))
)
