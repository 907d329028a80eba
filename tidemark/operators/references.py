"""References to records that do not exist, kept up to date batch by batch.

State is a folder of three append-only tables, each batch a part of its own: what is known of parents, what is known of references with the
fault each one has, and changes of the fault counts. A batch may bring new references, new or changed parents, or both, in any order:

* a new reference probes the parent index: it is ``missing`` if there is none, ``deleted`` if the parent is removed,
  ``late`` if the parent was first seen after it;
* an arriving parent resolves the references waiting for it (they become ``late``, or no fault);
* a removal reopens references that were resolved.

Of earlier batches only rows whose key the new batch touches are taken up, judged and appended again where something about them changed; earlier parts are read
but never moved or rewritten. Counts are kept as differences, so a snapshot of any batch is a sum of few rows. Result and state do not depend on how rows are batched.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.salting import salted_join
from tidemark.session import cut_lineage, shared_folder
from tidemark.tables import clean_path, first_loaded

REF = "ref_table string, row_id long, parent_kind string, parent_key string, ref_at timestamp"
PARENT = "parent_kind string, parent_key string, first_at timestamp, version timestamp, removed boolean"
TABLES = {
    "parents": PARENT,
    "refs": REF + ", fault string, live boolean, was string, was_at timestamp",
    "counts": "ref_table string, month string, kind string, n long",
}
ID, KEY = ["ref_table", "row_id"], ["parent_kind", "parent_key"]


class Orphans:
    """The state in ``folder``, which all executors must share; an existing folder is taken up where its last whole batch left it."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/orphans-{uuid4().hex}").rstrip("/")

    # ------------------------------------------------------------ files

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """Numbers of the batches that were written whole."""
        fs, path = self._path("whole")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []

    def table(self, name: str, batches: list[int] | None = None) -> DataFrame:
        """Rows of a state table and their ``batch``; of whole batches only."""
        batches = self.batches() if batches is None else batches
        parts = [f"{self.folder}/{name}/batch={k}" for k in batches]
        if not parts:
            return self.spark.createDataFrame([], TABLES[name] + ", batch long")
        return self.spark.read.schema(TABLES[name] + ", batch long").option("basePath", f"{self.folder}/{name}").parquet(*parts)

    def _write(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        rows.select(*columns(TABLES[name])).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        return self.table(name, [batch])

    # ------------------------------------------------------------ batches

    def advance(self, refs: DataFrame, parents: DataFrame, batch: int | None = None) -> Orphans:
        """Takes in one more batch. ``refs``: REF columns, keys not null; ``parents``: PARENT columns.

        A reference seen before keeps its earliest time and that row's key; of a parent, the earliest ``first_at`` and the ``removed`` of the latest
        ``version`` hold (a null version is older than any other; at a tie, removal wins). A ``batch`` that was taken in before is passed over, one that was
        broken off is written anew, so batches that are sent again after a restart count once.
        """
        whole = self.batches()
        number = (whole[-1] + 1 if whole else 0) if batch is None else batch
        if number in whole:
            return self
        known = self._write("parents", number, index_parents(parents))
        judged = self._judged(refs, known, whole)
        self._count(self._write("refs", number, judged), number)
        fs, mark = self._path(f"whole/{number}")
        fs.create(mark, True).close()
        return self

    def _judged(self, refs: DataFrame, arrived: DataFrame, whole: list[int]) -> DataFrame:
        """Rows of the state table of references: those of the batch and those that it touches, where anything changed."""
        none = lambda t: F.lit(None).cast(t)
        rows = refs.select(*columns(REF), none("long").alias("batch"), none("boolean").alias("live"), none("string").alias("fault"))
        if whole:
            seen = self.table("refs", whole).select(*columns(REF), "batch", "live", "fault")
            again = seen.join(refs.select(*ID).distinct(), ID, "left_semi")
            waiting = seen.join(arrived.select(*KEY), KEY, "left_semi")
            rows = rows.unionByName(again.select(rows.columns)).unionByName(waiting.select(rows.columns))
        old = F.max(F.when(F.col("batch").isNotNull(), F.struct("batch", "live", *KEY, "ref_at", "fault"))).alias("old")
        each = rows.groupBy(*ID).agg(F.min(F.struct("ref_at", *KEY)).alias("r"), old, F.max(F.col("batch").isNull()).alias("fresh"))
        # a row left under a key that its reference no longer has is not live and waits for nothing
        each = cut_lineage(each.filter("fresh or old.live").select(*ID, "r.*", "old"))
        index = arrived.select(*columns(PARENT))
        if whole:
            keys = each.select(*KEY).distinct()
            index = index_parents(self.table("parents", whole).join(keys, KEY, "left_semi").select(*columns(PARENT)).unionByName(index))
        # a hot parent's references are spread over copies of its row
        found = salted_join(each, index, KEY, ID, "left")
        fault = F.when(F.col("removed").isNull(), "missing").when(F.col("removed"), "deleted").when(F.col("first_at") > F.col("ref_at"), "late")
        found = found.withColumn("fault", fault)
        moved = ~(F.col("old.parent_kind").eqNullSafe(F.col("parent_kind")) & F.col("old.parent_key").eqNullSafe(F.col("parent_key")))
        same = ~moved & F.col("old.ref_at").eqNullSafe(F.col("ref_at")) & F.col("old.fault").eqNullSafe(F.col("fault"))
        now = F.struct(*KEY, "ref_at", "fault", F.lit(True).alias("live"), F.col("old.fault").alias("was"), F.col("old.ref_at").alias("was_at"))
        gone = F.struct(*[F.col(f"old.{c}").alias(c) for c in KEY], F.col("old.ref_at").alias("ref_at"), none("string").alias("fault"), F.lit(False).alias("live"), none("string").alias("was"), none("timestamp").alias("was_at"))
        changed = found.filter(F.col("old").isNull() | ~same)
        return changed.select(*ID, F.inline(F.when(F.col("old").isNotNull() & moved, F.array(now, gone)).otherwise(F.array(now))))

    def _count(self, written: DataFrame, number: int) -> None:
        month = lambda at: F.date_format(at, "yyyy-MM")
        sides = F.array(
            F.struct(month("ref_at").alias("month"), F.col("fault").alias("kind"), F.lit(1).alias("d")),
            F.struct(month("was_at").alias("month"), F.col("was").alias("kind"), F.lit(-1).alias("d")),
        )
        rows = written.filter("live").select("ref_table", F.inline(sides)).filter("kind is not null")
        self._write("counts", number, rows.groupBy("ref_table", "month", "kind").agg(F.sum("d").alias("n")))

    # ------------------------------------------------------------ results

    def faults(self) -> DataFrame:
        """``ref_table, row_id, kind, ref_at`` of all references that have a fault now."""
        last = self.table("refs").groupBy(*ID).agg(F.max(F.struct("batch", "live", "fault", "ref_at")).alias("r"))
        return last.filter("r.fault is not null").select(*ID, F.col("r.fault").alias("kind"), "r.ref_at")

    def snapshot(self, upto: int | None = None) -> DataFrame:
        """``ref_table, month, kind, n``: faults by table and month of loading (month null if the time is), after batch ``upto`` or now."""
        rows = self.table("counts", [k for k in self.batches() if upto is None or k <= upto])
        return rows.groupBy("ref_table", "month", "kind").agg(F.sum("n").alias("n")).filter("n != 0")

    def snapshots(self) -> DataFrame:
        """``batch, ref_table, month, kind, n``: the snapshot after every batch."""
        each = [self.snapshot(k).withColumn("batch", F.lit(k)) for k in self.batches()]
        return reduce(DataFrame.unionByName, each) if each else self.snapshot().withColumn("batch", F.lit(0))


def columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def index_parents(parents: DataFrame) -> DataFrame:
    """One row per parent key; combines on the map side."""
    latest = F.max(F.struct("version", F.coalesce("removed", F.lit(False)).alias("removed")))
    return (
        parents.filter("parent_key is not null")
        .groupBy(*KEY)
        .agg(F.min("first_at").alias("first_at"), latest.alias("l"))
        .select(*KEY, "first_at", "l.version", "l.removed")
    )


def recording_references(annotations: DataFrame, reviewed: DataFrame, recordings: DataFrame) -> DataFrame:
    """REF rows of the three referring tables; null references and removed referring rows are none."""
    notes = first_loaded(annotations, "id", ["recording_id", "deleted_at"]).filter("deleted_at is null")
    spans = first_loaded(reviewed, "id", ["recording_id"])
    files = first_loaded(recordings, "id", ["npy_path", "deleted_at"]).filter("deleted_at is null")
    parts = [
        (notes, "annotations", "recording", F.col("recording_id").cast("string")),
        (spans, "reviewed_spans", "recording", F.col("recording_id").cast("string")),
        (files, "recordings", "file", clean_path(F.col("npy_path"))),
    ]
    rows = None
    for df, table, kind, key in parts:
        part = df.select(F.lit(table).alias("ref_table"), F.col("id").alias("row_id"), F.lit(kind).alias("parent_kind"), key.alias("parent_key"), F.col("first_at").cast("timestamp").alias("ref_at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.filter("parent_key is not null")


def recording_parents(recordings: DataFrame, channel_files: DataFrame) -> DataFrame:
    """PARENT rows of recordings (removed if any row says so) and files (the latest written row says so)."""
    recs = recordings.select(
        F.lit("recording").alias("parent_kind"),
        F.col("id").cast("string").alias("parent_key"),
        F.col("loaded_at").cast("timestamp").alias("first_at"),
        F.col("deleted_at").cast("timestamp").alias("version"),
        F.col("deleted_at").isNotNull().alias("removed"),
    )
    files = channel_files.select(
        F.lit("file").alias("parent_kind"),
        clean_path(F.col("npy_path")).alias("parent_key"),
        F.col("written_at").cast("timestamp").alias("first_at"),
        F.col("written_at").cast("timestamp").alias("version"),
        F.col("deleted_at").isNotNull().alias("removed"),
    )
    return recs.unionByName(files)


def track(refs: DataFrame, parents: DataFrame, boundaries: list[str], folder: str | None = None) -> Orphans:
    """The state after replaying all rows in batches cut at ``boundaries`` (timestamps); rows without a time come first.

    Both inputs are read once a batch: make them durable first if they cost much.
    """
    state = Orphans(refs.sparkSession, folder)
    cuts = [None, *boundaries, None]
    for low, high in zip(cuts[:-1], cuts[1:]):
        def within(at: str):
            ok = F.lit(True)
            if low is not None:
                ok = ok & (F.col(at) >= F.lit(low).cast("timestamp"))
            if high is not None:
                ok = ok & (F.col(at) < F.lit(high).cast("timestamp"))
            return ok | F.col(at).isNull() if low is None else ok
        state.advance(refs.filter(within("ref_at")), parents.filter(within("first_at")))
    return state


def even_boundaries(refs: DataFrame, batches: int) -> list[str]:
    """Times that cut the references' period of loading into equal parts."""
    low, high = refs.agg(F.min("ref_at").cast("double"), F.max("ref_at").cast("double")).first()
    if low is None or batches < 2 or low == high:
        return []
    spark = refs.sparkSession
    at = [low + (high - low) * k / batches for k in range(1, batches)]
    return [str(r[0]) for r in spark.createDataFrame([(x,) for x in at], "s double").select(F.timestamp_seconds("s").cast("string")).collect()]
