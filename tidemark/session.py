"""Session defaults and durable intermediate results."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    os.environ.setdefault("TZ", "UTC")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder (``spark.checkpoint.dir``).

    Only a single-machine session without that setting gets a temporary folder of its own; a cluster without
    a shared folder is an error, since files on one machine would be lost with it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-checkpoints-")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; it outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return anew(df.checkpoint(eager=True))


def anew(written: DataFrame) -> DataFrame:
    """A checkpointed table without the estimated size and the constraints that Spark carries over from the plan before.

    The size is a product over all joins so far. From checkpoint to checkpoint its digits multiply, until planning takes minutes and the number no
    longer fits. Joins of the result are chosen by what their inputs are seen to hold when they run.
    """
    spark = written.sparkSession
    jvm, plan = spark.sparkContext._jvm, written._jdf.queryExecution().analyzed()
    none = jvm.scala.Option.empty()
    leaf = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), none, spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, leaf), spark)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
