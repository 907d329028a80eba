"""Queries of learned symbols, linkage of centres and catalogue parsing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import learned, linkage, parsing, prepare, symbols
from tidemark.queries.base import NOTES, RECS, notes, recs, signal, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("level_symbols_learned")(lambda s, d: learned.learned_symbols(signal(s, d), 4, "levels", 5))
query("mode_symbols_learned")(lambda s, d: learned.learned_symbols(signal(s, d), 4, "modes"))


@query("linked_centres")
def linked_centres(s, d):
    """Ward clusters of the labels' centres: a row per label, of which there is a fixed, small number."""
    c = prepare.centroids(vectors(s, d), "label").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "centre"))), lambda v: v["centre"]).alias("v"))
    rows = sorted((r["label"], r["v"]) for r in c.limit(linkage.MOST + 1).collect())
    merges = linkage.ward(np.array([v for _, v in rows]))
    k = linkage.suggest(merges)
    return s.createDataFrame([(lab, int(g), k) for (lab, _), g in zip(rows, linkage.cut(merges, k))], "label int, family int, families int")


# The shapes that the test annotations are tagged with.
SHAPES = ["halfdome", "fin", "drift", "ridge", "dropout", "dip", "rolling", "crest", "burst"]
query(
    "note_terms",
    f"WITH {NOTES}, t AS (SELECT id, regexp_replace(lower(trim(p)), '\\s+', '_', 'g') t FROM (SELECT id, unnest(string_split_regex(coalesce(note, tag, ''), '[;,]')) p FROM notes) WHERE trim(p) != ''), k AS (SELECT ['halfdome', 'fin', 'drift', 'ridge', 'dropout', 'dip', 'rolling', 'crest', 'burst'] k), m AS (SELECT id, CASE WHEN t = 'stegasauras' THEN 'stegasaurus' ELSE t END t FROM t) SELECT id, CASE WHEN NOT list_contains(k, t) AND ends_with(t, 's') AND list_contains(k, t[:-2]) THEN t[:-2] ELSE t END term FROM m, k",
)(lambda s, d: notes(s, d).select("id", F.explode(parsing.terms(F.coalesce("note", "tag"), SHAPES)).alias("term")))
_TEXT = "trim(coalesce(note, '') || ' ' || coalesce(tag, ''))"
query(
    "note_counts",
    f"WITH {NOTES}, c AS (SELECT id, coalesce(note, '') ss, {_TEXT} t FROM notes), f AS (SELECT *, list_distinct(list_transform(regexp_extract_all(t, '(?i)(\\d+)\\s+(?:cycles?|sequences?|sharps?|furrycaterpillars?|spikes?|patterns?|sharkfins?)\\b', 1), lambda n: TRY_CAST(n AS INTEGER))) f, regexp_extract(t, '(?i)(\\d+)\\s*x\\s+\\S+.*?sequence', 1) x FROM c) "
    "SELECT id, CASE WHEN regexp_matches(t, '(?i)\\d+\\D+then\\s+\\d+') THEN NULL WHEN regexp_matches(ss, '(?i)\\bsingle\\s+cycle\\b') OR regexp_matches(ss, '^\\s*1\\s+\\S+\\s*$') THEN 1 WHEN x != '' THEN TRY_CAST(x AS INTEGER) WHEN len(f) = 1 THEN f[1] END n FROM f",
)(lambda s, d: notes(s, d).select("id", parsing.event_count(F.col("note"), F.col("tag")).alias("n")))
query(
    "note_structure",
    f"WITH {NOTES}, c AS (SELECT id, lower(coalesce(note, '')) s, lower(concat_ws(' ', note, tag)) t, nullif(parent_annotation_id, 0) parent FROM notes) SELECT id, parent, CASE WHEN contains(s, 'type specimen') THEN 'type_specimen' WHEN contains(s, 'single cycle') THEN 'single_cycle' WHEN contains(s, 'nested') THEN 'nested_sequence' WHEN contains(s, 'sequence') OR regexp_matches(s, '\\bseq\\b') THEN 'sequence' END structure, CASE WHEN contains(t, 'type specimen') THEN 'type_specimen' WHEN parent IS NOT NULL THEN 'sub_window' END relation FROM c",
)(
    lambda s, d: notes(s, d).withColumn("parent", parsing.parent_id(F.col("parent_annotation_id"))).select("id", "parent", parsing.structure_kind(F.col("note")).alias("structure"), parsing.relation_kind(F.col("note"), F.col("tag"), F.col("parent").isNotNull()).alias("relation"))
)
query("hours_to_samples", f"WITH {RECS} SELECT id, round_even(n_samples / 3600.0 * 3600 * fs, 0)::BIGINT idx FROM recs WHERE fs > 0 AND fs < 1e6")(lambda s, d: recs(s, d).filter("fs > 0 and fs < 1e6").select("id", parsing.sample_index(F.col("n_samples") / 3600.0, F.col("fs")).alias("idx")))
query("symbol_letters", f"WITH {RECS} SELECT id, CASE WHEN id % 702 < 26 THEN chr((97 + id % 702)::INTEGER) ELSE chr((96 + (id % 702) // 26)::INTEGER) || chr((97 + id % 26)::INTEGER) END name FROM recs")(lambda s, d: recs(s, d).select("id", parsing.letters(F.col("id") % 702).alias("name")))
query("channel_of_pack", f"WITH {RECS} SELECT id, (id % 4) * 4 + id % 3 channel FROM recs")(lambda s, d: recs(s, d).select("id", parsing.global_channel(F.col("id") % 4, F.col("id") % 3).alias("channel")))
query(
    "segment_plan",
    f"WITH {RECS}, t AS (SELECT id, n_samples n, greatest(16, least(256, round_even(n_samples / 20, 0)))::BIGINT target FROM recs WHERE n_samples > 0), p AS (SELECT *, greatest(1, round_even(n / target, 0))::BIGINT requested FROM t), k AS (SELECT *, greatest(1, n // requested) symbols FROM p) SELECT id, target, requested, symbols, (n - n % symbols) // symbols per_symbol, n % symbols trimmed, round((symbols + 0.5::DOUBLE) / n, 9) dim_ratio FROM k",
)(lambda s, d: segment_plan(s, d))
query(
    "segment_modes",
    f"WITH {RECS}, r AS (SELECT id, n_samples n, fs, unnest(['seconds_per_symbol', 'samples_per_symbol', 'target_symbol_count', 'dim_ratio']) segment_mode FROM recs WHERE n_samples > 0 AND fs > 0 AND fs < 1e6), q AS (SELECT *, greatest(1, CASE segment_mode WHEN 'seconds_per_symbol' THEN round_even(7.5 * fs, 0) WHEN 'samples_per_symbol' THEN 12 WHEN 'target_symbol_count' THEN round_even(n / 40, 0) ELSE 20 END)::BIGINT requested FROM r), k AS (SELECT *, greatest(1, n // requested) symbols FROM q) SELECT id, segment_mode, requested, symbols, (n - n % symbols) // symbols per_symbol, n % symbols trimmed FROM k",
)(lambda s, d: segment_modes(s, d))


def segment_plan(s, d):
    """The recommended number of symbols, a twentieth of the samples between 16 and 256, and what it comes to."""
    r = recs(s, d).filter("n_samples > 0").withColumn("target", symbols.recommended_symbols(F.col("n_samples")))
    return symbols.planned(r, F.greatest(F.lit(1), F.bround(F.col("n_samples") / F.col("target"), 0)), "n_samples").select("id", "target", "requested", "symbols", "per_symbol", "trimmed", F.round("dim_ratio", 9).alias("dim_ratio"))


def segment_modes(s, d):
    """Each of the four ways to ask for segments, with one value each."""
    r = recs(s, d).filter("n_samples > 0 and fs > 0 and fs < 1e6")
    ways = {"seconds_per_symbol": 7.5, "samples_per_symbol": 12, "target_symbol_count": 40, "dim_ratio": 0.05}
    each = None
    for mode, value in ways.items():
        one = symbols.planned(r, symbols.samples_asked(mode, value, F.col("fs"), F.col("n_samples")), "n_samples").select("id", F.lit(mode).alias("segment_mode"), "requested", "symbols", "per_symbol", "trimmed")
        each = one if each is None else each.unionByName(one)
    return each
