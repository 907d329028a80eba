"""Runs of equal or nearly equal neighbours in event sequences.

Each sequence is canonicalised: every symbol is replaced by the first non-wildcard symbol of the run it falls into. Rows are then
exploded, and the difference of the row number within the sequence and the row number within (sequence, canonical symbol) is constant along a
run, so one hash aggregate gives every run's count and duration. A sequence is one row of the input, so no group outgrows a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import first_loaded

WILDCARD = -1


def canonical(symbols: np.ndarray, tolerance: int) -> np.ndarray:
    """Each position's run anchor. A run of wildcards only has the wildcard as its anchor."""
    out = symbols.copy()
    real = np.flatnonzero(symbols != WILDCARD)
    if not len(real):
        return out
    values = symbols[real]
    if tolerance <= 0:
        anchor = values
    else:
        anchor = np.empty_like(values)
        # only where a neighbour differs can a run end; runs of equal symbols are stepped over at once
        at = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        current = None
        for a, z in zip(at, np.r_[at[1:], len(values)]):
            if current is None or abs(int(values[a]) - current) > tolerance:
                current = int(values[a])
            anchor[a:z] = current
    # wildcards belong to the run that is open; leading ones to the first run
    which = np.searchsorted(real, np.arange(len(symbols)), side="right") - 1
    return anchor[np.maximum(which, 0)]


def canonicalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("symbols")
        at = np.asarray(lists.offsets)
        flat = np.asarray(lists.flatten().fill_null(WILDCARD))
        at = at - at[0] if len(at) else at
        tolerance = np.asarray(batch.column("tolerance"))
        out = np.empty_like(flat)
        for k in range(len(batch)):
            out[at[k] : at[k + 1]] = canonical(flat[at[k] : at[k + 1]], int(tolerance[k]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("seed_id"), batch.column("scale"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out, pa.int32()))],
            names=["seed_id", "scale", "canon"],
        )


def runs(seeds: DataFrame, exact_up_to: int = 5) -> DataFrame:
    """``seed_id, symbol, first_pos, last_pos, n, duration``: every run, single symbols included.

    From the left, a run takes in every next symbol at most t from its first non-wildcard symbol, and every wildcard; t is 0 for
    alphabets of up to ``exact_up_to`` symbols (and unknown ones), else 1. A null symbol is a wildcard; a null or empty sequence has no run;
    null ids are dropped; of an id delivered twice the first loaded row holds. ``duration`` is ``n`` times ``scale``, null if that is.
    """
    rows = first_loaded(seeds, "seed_id", ["alphabet_size", "scale", "symbols"])
    tolerance = F.when(F.col("alphabet_size") > exact_up_to, 1).otherwise(0)
    ready = rows.filter(F.size("symbols") > 0).select("seed_id", F.col("scale").cast("long").alias("scale"), tolerance.alias("tolerance"), F.col("symbols").cast("array<int>").alias("symbols"))
    canon = ready.mapInArrow(canonicalise, "seed_id string, scale long, canon array<int>")
    # posexplode's position is the row number within the sequence
    events = canon.select("seed_id", "scale", F.posexplode("canon").alias("pos", "symbol"))
    same = Window.partitionBy("seed_id", "symbol").orderBy("pos")
    keyed = events.withColumn("diff", F.col("pos") - F.row_number().over(same))
    found = keyed.groupBy("seed_id", "symbol", "diff").agg(F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"), F.count("*").alias("n"), F.first("scale").alias("scale"))
    return found.select("seed_id", "symbol", "first_pos", "last_pos", "n", (F.col("n") * F.col("scale")).alias("duration"))
