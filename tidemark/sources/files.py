"""Reading channel files and writing result tables."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "path string, channel long, idx long, x double"


def read_npy(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """``path, channel, idx, x`` of ``.npy`` files: a vector is channel 0, a matrix has a channel per column. Other shapes raise.

    Each file is one task and leaves it in batches of ``chunk`` samples.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                x = np.load(io.BytesIO(content), allow_pickle=False)
                if x.ndim not in (1, 2):
                    raise ValueError(f"{name}: {x.ndim} dimensions")
                x = x[:, None] if x.ndim == 1 else x
                for c in range(x.shape[1]):
                    for at in range(0, len(x), chunk):
                        part = x[at : at + chunk, c].astype(float)
                        yield pd.DataFrame({"path": name, "channel": c, "idx": np.arange(at, at + len(part)), "x": part})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInPandas(run, SAMPLES)


def read_csv_channels(spark: SparkSession, path: str, columns: list[str], index: str | None = None) -> DataFrame:
    """``path, channel, idx, x`` of CSV files with a header, a channel per named column; ``index`` names the position column.

    Without ``index`` a file has no stated order, so that is an error rather than a guess.
    """
    if index is None:
        raise ValueError("name the column that holds the position")
    names = spark.read.option("header", True).csv(path).columns
    rows = spark.read.option("header", True).schema(", ".join(f"`{n}` " + ("long" if n == index else "double" if n in columns else "string") for n in names)).csv(path)
    channels = F.array(*[F.struct(F.lit(k).cast("long").alias("channel"), F.col(c).alias("x")) for k, c in enumerate(columns)])
    return rows.select(F.input_file_name().alias("path"), F.col(index).alias("idx"), F.inline(channels)).select("path", "channel", "idx", "x")


def split_concatenated(signal: DataFrame, n_channels: int, length: int) -> DataFrame:
    """One vector of equal channels end to end -> ``channel, idx, x``; a length that does not divide raises."""
    if length % n_channels:
        raise ValueError(f"{length} samples do not make {n_channels} channels")
    each = length // n_channels
    return signal.select(F.floor(F.col("idx") / each).cast("long").alias("channel"), F.pmod("idx", F.lit(each)).alias("idx"), "x")


def artifact_name(kind: str, recording: str, params: dict) -> str:
    """A deterministic file name: kind, recording and parameters in the order of their names."""
    clean = lambda v: "".join(c if c.isalnum() or c in "-_" else "p" if c == "." else "-" for c in str(v))
    return "_".join([clean(kind), clean(recording), *[f"{clean(k)}{clean(v)}" for k, v in sorted(params.items())]])


class FeatureStore:
    """Window measures in long form, ``recording_id, start_idx, measure, value``, that can be built bit by bit.

    A row is there if the cell was attempted; its value is NaN if the attempt failed. ``missing`` gives the windows still to do.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        try:
            return self.spark.read.parquet(self.folder)
        except Exception as e:  # an empty store has no files yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return self.spark.createDataFrame([], "recording_id long, start_idx long, measure string, value double")

    def missing(self, grid: DataFrame, measure: str) -> DataFrame:
        return grid.join(self.read().filter(F.col("measure") == measure).select("recording_id", "start_idx"), ["recording_id", "start_idx"], "left_anti")

    def add(self, wide: DataFrame, measures: list[str]) -> None:
        """Appends the measures of windows; cells that are there already are left as they are."""
        cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])
        rows = wide.select("recording_id", "start_idx", F.inline(cells))
        fresh = rows.join(self.read().select("recording_id", "start_idx", "measure"), ["recording_id", "start_idx", "measure"], "left_anti")
        fresh.select("recording_id", "start_idx", "measure", "value").write.mode("append").parquet(self.folder)

    def progress(self, grid: DataFrame, measures: list[str]) -> DataFrame:
        """``measure, computed, total``."""
        want = grid.select("recording_id", "start_idx", F.explode(F.array(*[F.lit(m) for m in measures])).alias("measure"))
        have = self.read().select("recording_id", "start_idx", "measure", F.lit(1).alias("one"))
        return want.join(have, ["recording_id", "start_idx", "measure"], "left").groupBy("measure").agg(F.count("one").alias("computed"), F.count("*").alias("total"))
