"""Preparing a feature matrix: column filters, scaling, outliers, and models' evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_stats(rows: DataFrame, vector: str = "v") -> DataFrame:
    """``col, n, n_nan, mean, sd, mid``: per position of the feature vectors; NaN is counted, not averaged."""
    e = rows.select(F.posexplode(vector).alias("col", "x"))
    fine = F.when(~F.isnan("x"), F.col("x"))
    return e.groupBy("col").agg(F.count("x").alias("n"), F.sum(F.isnan("x").cast("long")).alias("n_nan"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("sd"), F.percentile(fine, 0.5).alias("mid"))


def kept_columns(stats: list, most_nan: float = 0.5, least_cv: float = 0.01) -> list[int]:
    """Columns with few NaN that vary: sd above ``least_cv`` of abs(mean). ``stats``: collected rows of ``column_stats``, one a column."""
    out = []
    for r in sorted(stats, key=lambda r: r["col"]):
        if r["n"] and r["n_nan"] / r["n"] <= most_nan and r["sd"] and r["sd"] > least_cv * abs(r["mean"]):
            out.append(r["col"])
    return out


def uncorrelated(corr: dict[tuple[int, int], float], columns: list[int], threshold: float = 0.99) -> list[int]:
    """Columns in order, without those whose correlation with an earlier kept one is above the threshold."""
    kept: list[int] = []
    for c in columns:
        if all(abs(corr.get((k, c), 0.0)) <= threshold for k in kept):
            kept.append(c)
    return kept


def correlations(rows: DataFrame, columns: list[int] | None = None, vector: str = "v") -> DataFrame:
    """``a, b, r`` for a < b, over all columns unless some are named; a row counts for a pair where neither value is NaN or null.

    One pass sums products in matrices, centred on each batch's means; tasks give a row a pair, and their means are joined about the common mean.
    """
    moments = rows.select(vector).mapInArrow(pair_moments(columns), "a int, b int, n double, ma double, mb double, aa double, bb double, ab double")
    pair = Window.partitionBy("a", "b")
    m = moments.select("*", *[(F.sum(F.col("n") * F.col(c)).over(pair) / F.sum("n").over(pair)).alias(f"{c}_all") for c in ("ma", "mb")])
    m = m.withColumn("ga", F.col("ma") - F.col("ma_all")).withColumn("gb", F.col("mb") - F.col("mb_all"))
    joined = [F.sum(F.col(s) + F.col("n") * F.col(x) * F.col(y)).alias(s) for s, x, y in (("aa", "ga", "ga"), ("bb", "gb", "gb"), ("ab", "ga", "gb"))]
    g = m.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("ma_all").alias("ma"), F.first("mb_all").alias("mb"), *joined)
    # a deviation of rounding size is a constant column: no correlation
    varies = [F.sqrt(F.col(s) / F.col("n")) > 1e-14 * F.abs(F.col(c)) for s, c in (("aa", "ma"), ("bb", "mb"))]
    return g.select("a", "b", F.when(varies[0] & varies[1], F.col("ab") / (F.sqrt("aa") * F.sqrt("bb"))).alias("r"))


def pair_moments(columns):
    """For ``mapInArrow``: of each pair of columns the count, means and centred sums of products over the task's rows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            lists = batch.column(0).drop_null()
            if not len(lists):
                continue
            length = lists.value_lengths().to_numpy()
            x = np.full((len(lists), int(length.max())), np.nan)
            x[np.arange(x.shape[1]) < length[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            if columns is not None:
                wide = np.full((len(x), max([x.shape[1], *[c + 1 for c in columns]])), np.nan)
                wide[:, : x.shape[1]] = x
                x = wide[:, columns]
            fine = ~np.isnan(x)
            centre = np.where(fine, x, 0).sum(0) / np.maximum(fine.sum(0), 1)
            y, k = np.where(fine, x - centre, 0.0), fine.astype(float)
            n = k.T @ k
            some = np.maximum(n, 1)
            ga, gb = (y.T @ k) / some, (k.T @ y) / some  # means of a and of b over the rows of the pair, from the column's mean
            part = [n, ga + centre[:, None], gb + centre[None], (y * y).T @ k - n * ga * ga, k.T @ (y * y) - n * gb * gb, y.T @ y - n * ga * gb]
            if total is None:
                total = part
                continue
            w = max(len(total[0]), len(n))
            total, part = ([np.pad(m, (0, w - len(m))) for m in ms] for ms in (total, part))
            n = total[0] + part[0]
            share = part[0] / np.maximum(n, 1)
            da, db = part[1] - total[1], part[2] - total[2]
            between = total[0] * share
            means = [total[1] + da * share, total[2] + db * share]
            total = [n, *means, total[3] + part[3] + between * da * da, total[4] + part[4] + between * db * db, total[5] + part[5] + between * da * db]
        if total is not None:
            i, j = np.triu_indices(len(total[0]), 1)
            there = total[0][i, j] > 0
            i, j = i[there], j[there]
            name = np.arange(len(total[0])) if columns is None else np.array(columns)
            yield pa.RecordBatch.from_arrays([pa.array(name[i].astype(np.int32)), pa.array(name[j].astype(np.int32)), *[pa.array(m[i, j]) for m in total]], ["a", "b", "n", "ma", "mb", "aa", "bb", "ab"])

    return run


def scaled_rows(rows: DataFrame, key: list[str], columns: list[int] | None = None, vector: str = "v") -> DataFrame:
    """``key, col, z``: NaN as the column's median, then by the column's mean and population deviation."""
    stats = column_stats(rows, vector)
    e = rows.select(*key, F.posexplode(vector).alias("col", "x"))
    if columns is not None:
        e = e.filter(F.col("col").isin(columns))
    filled = e.join(F.broadcast(stats.select("col", "mid")), "col").withColumn("x", F.when(F.isnan("x"), F.col("mid")).otherwise(F.col("x")))  # a row a column
    s = filled.groupBy("col").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return filled.join(F.broadcast(s), "col").select(*key, "col", F.when(F.col("s") == 0, 0.0).otherwise((F.col("x") - F.col("m")) / F.col("s")).alias("z"))


def centroids(rows: DataFrame, group: str, vector: str = "v") -> DataFrame:
    """``group, col, centre, n``."""
    return rows.select(group, F.posexplode(vector).alias("col", "x")).groupBy(group, "col").agg(F.avg("x").alias("centre"), F.count("*").alias("n"))


def centre_distances(rows: DataFrame, key: str, group: str, vector: str = "v") -> DataFrame:
    """``key, group, distance``: to the group's centre, over the root of the number of columns."""
    e = rows.select(key, group, F.posexplode(vector).alias("col", "x"))
    gap = F.col("x") - F.col("centre")
    return e.join(centroids(rows, group, vector), [group, "col"]).groupBy(key, group).agg(F.sqrt(F.sum(gap * gap) / F.count("*")).alias("distance"))


def outliers(d: DataFrame, group: str, threshold: float = 3.0) -> DataFrame:
    """Adds ``z`` (sample deviation) within the group and keeps those above the threshold."""
    s = d.groupBy(group).agg(F.avg("distance").alias("m"), F.stddev_samp("distance").alias("s"))
    return d.join(s, group).withColumn("z", (F.col("distance") - F.col("m")) / F.col("s")).filter(F.col("z") > threshold).drop("m", "s")


def representatives(d: DataFrame, key: str, group: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.round("distance", 9), key))
    return d.withColumn("rank", rank).filter(F.col("rank") <= k)


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold, n_positive, precision, recall, f1`` for ``truth`` (boolean) and ``score``; 0 where undefined.

    One aggregate with a column group per threshold: nothing is joined or repeated.
    """
    aggs = [F.sum(F.col("truth").cast("long")).alias("pos")]
    for k, t in enumerate(thresholds):
        hit = F.col("score") >= t
        aggs += [F.sum(hit.cast("long")).alias(f"n{k}"), F.sum((hit & F.col("truth")).cast("long")).alias(f"tp{k}")]
    one = scored.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("n_positive"), F.col(f"tp{k}").alias("tp"), F.col("pos").alias("pos")) for k, t in enumerate(thresholds)])
    r = one.select(F.inline(rows))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, q = ratio(F.col("tp"), F.col("n_positive")), ratio(F.col("tp"), F.col("pos"))
    return r.select("threshold", "n_positive", p.alias("precision"), q.alias("recall"), ratio(2 * p * q, p + q).alias("f1"))


def auc_roc(scored: DataFrame) -> DataFrame:
    """``auc, n_pos, n_neg``: by mean ranks of tied scores; scores are counted first, so ranks run over distinct scores."""
    c = scored.groupBy("score").agg(F.sum(F.col("truth").cast("long")).alias("p"), F.sum((~F.col("truth")).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(F.lit(1)).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = c.withColumn("w", F.col("p") * (below + F.col("q") / 2))
    s = wins.agg(F.sum("w").alias("w"), F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"))
    return s.select((F.col("w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")

