"""Columns parsed from catalogue texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings in catalogue sheets that stand for a known term.
ALIASES = {"stegasauras": "stegasaurus"}

# What a catalogue text may say about counts (regular expressions, case does not matter).
SEVERAL = r"(?i)\d+\D+then\s+\d+"
ONE_CYCLE = r"(?i)\bsingle\s+cycle\b"
ONE_OF = r"^\s*1\s+\S+\s*$"
TIMES = r"(?i)(\d+)\s*x\s+\S+.*?sequence"
COUNTED = r"(?i)(\d+)\s+(?:cycles?|sequences?|sharps?|furrycaterpillars?|spikes?|patterns?|sharkfins?)\b"


def sample_index(hours: Column, fs: Column) -> Column:
    """Hours since the start as a sample number, halves to even."""
    return F.bround(hours * 3600 * fs, 0).cast("long")


def global_channel(pack: Column, channel: Column, per_pack: int = 4, channels: int = 16, strict: bool = True) -> Column:
    """The channel's number among all packs. Outside [0, channels) it fails, as a wrong channel must not be clipped; with ``strict`` off it is null."""
    c = pack * per_pack + channel
    fine = (c >= 0) & (c < channels)
    if not strict:
        return F.when(fine, c)
    wrong = F.raise_error(F.concat(F.lit("no such channel: pack "), pack.cast("string"), F.lit(", channel "), channel.cast("string")))
    return F.when(c.isNull(), F.lit(None).cast("long")).when(fine, c).otherwise(wrong.cast("long"))


def parent_id(value: Column) -> Column:
    """0 means no parent."""
    return F.when(value != 0, value.cast("long"))


def terms(cell: Column, vocabulary: list[str] | tuple[str, ...] = ()) -> Column:
    """Entries between semicolons or commas: lower case, blanks as one underscore, known misspellings mended, empty ones left out.

    A plural goes to its singular where only that is in ``vocabulary``, a short list of known terms. A null cell has no terms.
    """
    known = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    right = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])

    def normal(p: Column) -> Column:
        low = F.regexp_replace(F.lower(F.trim(p)), r"\s+", "_")
        term = F.coalesce(F.element_at(right, low), low)
        single = F.substring(term, F.lit(1), F.length(term) - 1)
        plural = ~F.array_contains(known, term) & term.endswith("s") & F.array_contains(known, single)
        return F.when(plural, single).otherwise(term)

    parts = F.filter(F.split(F.coalesce(cell, F.lit("")), "[;,]"), lambda p: F.trim(p) != "")
    return F.transform(parts, normal)


def event_count(structure: Column, notes: Column) -> Column:
    """The one number of events that ``structure`` and ``notes`` state; null if they state none or several."""
    ss = F.coalesce(structure, F.lit(""))
    text = F.trim(F.concat(ss, F.lit(" "), F.coalesce(notes, F.lit(""))))
    times = F.regexp_extract(text, TIMES, 1)
    counts = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(COUNTED), F.lit(1)), lambda n: n.try_cast("int")))
    return (
        F.when(F.regexp_like(text, F.lit(SEVERAL)), F.lit(None).cast("int"))
        .when(F.regexp_like(ss, F.lit(ONE_CYCLE)) | F.regexp_like(ss, F.lit(ONE_OF)), 1)
        .when(times != "", times.try_cast("int"))
        .when(F.size(counts) == 1, counts[0])
    )


def structure_kind(structure: Column) -> Column:
    """``type_specimen``, ``single_cycle``, ``nested_sequence`` or ``sequence``, the first that the text names; else null."""
    s = F.lower(F.coalesce(structure, F.lit("")))
    return (
        F.when(s.contains("type specimen"), "type_specimen")
        .when(s.contains("single cycle"), "single_cycle")
        .when(s.contains("nested"), "nested_sequence")
        .when(s.contains("sequence") | F.regexp_like(s, F.lit(r"\bseq\b")), "sequence")
    )


def relation_kind(structure: Column, notes: Column, has_parent: Column) -> Column:
    """``type_specimen`` if the texts say so, else ``sub_window`` for a row with a parent; else null."""
    s = F.lower(F.concat_ws(" ", structure, notes))
    return F.when(s.contains("type specimen"), "type_specimen").when(has_parent, "sub_window")


def letters(number: Column) -> Column:
    """0 -> a .. 25 -> z, 26 -> aa .. 701 -> zz."""
    one = F.chr(F.lit(97) + number % 26)
    return F.when(number < 26, one).otherwise(F.concat(F.chr(F.lit(96) + F.floor(number / 26)), one))
