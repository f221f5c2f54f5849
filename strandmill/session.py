"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local mode, where it may be unset (tests), a temporary one is made."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or tempfile.mkdtemp(prefix="strandmill-"))
    return jsc.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder, so that what is used again, or lost, isn't computed again.

    A checkpoint keeps the size estimate of the plan it came from, and a join's estimate is the product of its sides'; in
    loops these grow until planning fails. So the estimate is dropped; sizes that matter are counted or known to AQE.
    """
    spark = df.sparkSession
    shared_folder(spark)
    plan = df.checkpoint(eager=True)._jdf.queryExecution().analyzed()
    none = spark._jvm.scala.Option.empty()
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, plan.stream(), spark._jsparkSession, none, none)
    made = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.classic.Dataset$").getField("MODULE$").get(None)
    return DataFrame(made.ofRows(spark._jsparkSession, bare), spark)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package in local mode too; on a cluster it is installed or sent with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
