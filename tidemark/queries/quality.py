"""Queries p1, p3 and p6: implausible values, orphan references, merged and gapped spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import implausible as imp
from tidemark.operators import references as ref
from tidemark.operators import sweep
from tidemark.session import cut_lineage
from tidemark.tables import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return imp.implausible_values(read(spark, d, "channel_samples"), read(spark, d, "recordings"), read(spark, d, "channel_files"), read(spark, d, "loggers"))


def p1_fences(spark: SparkSession, d: str) -> DataFrame:
    limits = imp.source_limits(read(spark, d, "channel_files"), read(spark, d, "loggers"), read(spark, d, "recordings"))
    return imp.hourly_fences(read(spark, d, "channel_samples"), limits)


def _p3_state(spark: SparkSession, d: str) -> ref.Orphans:
    recordings = read(spark, d, "recordings")
    refs = ref.recording_references(read(spark, d, "annotations"), read(spark, d, "reviewed_spans"), recordings)
    refs = cut_lineage(refs)
    parents = ref.recording_parents(recordings, read(spark, d, "channel_files"))
    return ref.track(refs, parents, ref.even_boundaries(refs, 3))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _p3_state(spark, d).faults().select("ref_table", "row_id", "kind")


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _p3_state(spark, d).snapshot()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sweep.span_cases(read(spark, d, "annotations"), read(spark, d, "reviewed_spans"), read(spark, d, "recordings"))


def p6_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Periods, covered positions and gap positions per table and recording."""
    found = sweep.span_periods(read(spark, d, "annotations"), read(spark, d, "reviewed_spans"), read(spark, d, "recordings"))
    return found.groupBy("span_table", "recording_id").agg(
        F.count("*").alias("n_periods"), F.sum(F.col("to_idx") - F.col("from_idx")).alias("covered"), F.coalesce(F.sum(F.col("next_from") - F.col("to_idx")), F.lit(0)).alias("uncovered")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_fences, p3_found, p3_counts, p6_found, p6_coverage)}

_STEM = r"regexp_replace(lower(trim(regexp_replace(trim({c}), '^.*[/\\]', ''))), '\.[a-z][a-z0-9]*$', '')"
_PATH = r"regexp_replace(regexp_replace(replace(trim({c}), '\', '/'), '/+', '/', 'g'), '^\./', '')"

_P3 = f"""
WITH a AS (SELECT id, min(loaded_at) t0, any_value(recording_id) r, any_value(deleted_at) d FROM annotations GROUP BY id),
s AS (SELECT id, min(loaded_at) t0, any_value(recording_id) r FROM reviewed_spans GROUP BY id),
c AS (SELECT id, min(loaded_at) t0, any_value(npy_path) p, any_value(deleted_at) d, bool_or(deleted_at IS NOT NULL) gone FROM recordings GROUP BY id),
f AS (SELECT {_PATH.format(c="npy_path")} p, min(written_at) t0, max_by(deleted_at IS NOT NULL, written_at) gone FROM channel_files GROUP BY 1),
refs AS (
  SELECT 'annotations' ref_table, a.id row_id, a.t0, c.id IS NOT NULL here, c.gone, c.t0 pat FROM a LEFT JOIN c ON a.r = c.id WHERE a.d IS NULL AND a.r IS NOT NULL
  UNION ALL SELECT 'reviewed_spans', s.id, s.t0, c.id IS NOT NULL, c.gone, c.t0 FROM s LEFT JOIN c ON s.r = c.id WHERE s.r IS NOT NULL
  UNION ALL SELECT 'recordings', x.id, x.t0, f.p IS NOT NULL, f.gone, f.t0 FROM c x LEFT JOIN f ON {_PATH.format(c="x.p")} = f.p WHERE x.d IS NULL AND x.p IS NOT NULL),
faults AS (SELECT ref_table, row_id, t0, CASE WHEN NOT here THEN 'missing' WHEN gone THEN 'deleted' WHEN pat > t0 THEN 'late' END kind FROM refs)
"""

_P6 = """
WITH spans AS (
  SELECT id, 'annotations' span_table, recording_id r, start_idx s, end_idx e FROM (SELECT * FROM annotations QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE deleted_at IS NULL
  UNION ALL SELECT id, 'reviewed_spans', recording_id, start_idx, end_idx FROM (SELECT * FROM reviewed_spans QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)),
ok AS (SELECT * FROM spans WHERE e > s AND r IN (SELECT id FROM recordings)),
g AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY span_table, r ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END n FROM ok),
i AS (SELECT *, sum(n) OVER (PARTITION BY span_table, r ORDER BY s, e, id ROWS UNBOUNDED PRECEDING) k FROM g),
p AS (SELECT span_table, r recording_id, min(s) from_idx, max(e) to_idx, count(*) n FROM i GROUP BY span_table, r, k),
q AS (SELECT *, lead(from_idx) OVER (PARTITION BY span_table, recording_id ORDER BY from_idx) nxt FROM p)
"""

SQL = {
    "p1_found": f"""
WITH r AS (SELECT DISTINCT id, {_STEM.format(c="source_file")} stem, fs FROM recordings WHERE source_file IS NOT NULL),
maj AS (SELECT stem, fs FROM (SELECT stem, fs, count(DISTINCT id) n FROM r GROUP BY ALL) JOIN (SELECT stem, count(DISTINCT id) t FROM r GROUP BY ALL) USING (stem) WHERE 2 * n > t AND fs IS NOT NULL AND NOT isnan(fs)),
f AS (SELECT npy_path, max_by(logger, written_at) logger, {_STEM.format(c="max_by(source_file, written_at)")} stem FROM channel_files GROUP BY npy_path),
par AS (SELECT npy_path, full_scale, CASE WHEN fs > 0 THEN greatest(1, floor(3 * fs + 1e-9)) ELSE 1 END k, CASE WHEN fs > 0 THEN greatest(2, ceil(60 * fs - 1e-9)) END least FROM f LEFT JOIN loggers USING (logger) LEFT JOIN maj USING (stem)),
s AS (SELECT npy_path, idx, min(x) x FROM channel_samples WHERE x IS NOT NULL AND idx IS NOT NULL AND npy_path IS NOT NULL GROUP BY ALL),
far AS (SELECT npy_path, s.idx FROM s LEFT JOIN par USING (npy_path) WHERE isnan(x) OR isinf(x) OR abs(x) > full_scale),
runs AS (SELECT *, idx - row_number() OVER (PARTITION BY npy_path, x ORDER BY idx) g FROM s WHERE isfinite(x)),
stuck AS (SELECT npy_path, unnest(range(a, b + 1)) idx FROM (SELECT npy_path, x, g, min(idx) a, max(idx) b FROM runs GROUP BY ALL) JOIN par USING (npy_path) WHERE b - a + 1 >= least),
fin AS (SELECT npy_path, idx, x, k, row_number() OVER w rn, idx - lag(idx) OVER w gap, x - lag(x) OVER w dx FROM s LEFT JOIN par USING (npy_path) WHERE isfinite(x) WINDOW w AS (PARTITION BY npy_path ORDER BY idx)),
step AS (SELECT npy_path, 25 * median(abs(dx)) far FROM fin WHERE gap = 1 AND dx != 0 GROUP BY npy_path),
j AS (SELECT fin.*, far, gap <= greatest(k, 5) near, abs(dx) > far big FROM fin JOIN step USING (npy_path)),
h AS (SELECT *, coalesce(NOT near OR NOT big, true) hb, coalesce(NOT lead(near) OVER w OR NOT lead(big) OVER w, true) ha FROM j WINDOW w AS (PARTITION BY npy_path ORDER BY idx)),
a AS (SELECT n.npy_path, n.rn, n.idx, p.x lvl, p.hb, n.k, n.far FROM h n JOIN h p ON p.npy_path = n.npy_path AND p.rn = n.rn - 1 WHERE n.near AND n.big),
z AS (SELECT a.npy_path, a.rn a, e.rn e, a.lvl, nx.x nlvl, a.far FROM a JOIN h e ON e.npy_path = a.npy_path AND e.rn >= a.rn AND e.rn < a.rn + a.k AND e.idx - a.idx + 1 <= a.k JOIN h nx ON nx.npy_path = a.npy_path AND nx.rn = e.rn + 1 AND nx.near AND abs(nx.x - a.lvl) <= a.far AND (a.hb OR nx.ha)),
spike AS (SELECT z.npy_path, z.a, z.e FROM z JOIN h m ON m.npy_path = z.npy_path AND m.rn BETWEEN z.a AND z.e GROUP BY ALL HAVING bool_and(m.near AND abs(m.x - z.lvl) > z.far AND abs(m.x - z.nlvl) > z.far)),
ex AS (SELECT h.npy_path, h.idx FROM spike JOIN h ON h.npy_path = spike.npy_path AND h.rn BETWEEN spike.a AND spike.e)
SELECT npy_path, idx FROM far UNION SELECT * FROM stuck UNION SELECT * FROM ex
UNION SELECT r.npy_path, -1 FROM (SELECT npy_path, fs, {_STEM.format(c="source_file")} stem FROM recordings WHERE source_file IS NOT NULL) r LEFT JOIN maj m USING (stem) WHERE r.fs IS NULL OR isnan(r.fs) OR m.fs IS NULL OR r.fs != m.fs
""",
    "p3_found": _P3 + "SELECT ref_table, row_id, kind FROM faults WHERE kind IS NOT NULL",
    "p3_counts": _P3 + "SELECT ref_table, strftime(t0, '%Y-%m') AS month, kind, count(*) AS n FROM faults WHERE kind IS NOT NULL GROUP BY ALL",
    "p6_found": _P6 + "SELECT span_table, recording_id, 'merged' kind, from_idx, to_idx FROM p WHERE n >= 2 UNION ALL SELECT span_table, recording_id, 'gap', to_idx, nxt FROM q WHERE nxt IS NOT NULL",
    "p6_coverage": _P6 + "SELECT span_table, recording_id, count(*) n_periods, sum(to_idx - from_idx)::BIGINT covered, coalesce(sum(nxt - to_idx), 0)::BIGINT uncovered FROM q GROUP BY ALL",
}
