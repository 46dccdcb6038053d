"""Tables written once, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_DIRS: dict[str, str] = {}
#: Folders of the tables that the running stage_step() has staged so far; None outside of one.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, as in tests on a local master, a temporary folder is used and removed at exit; on a cluster that
    is an error, because executors can't see each other's local folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="casewright-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder; a lost executor costs nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """As cut(), for wide rows: compressed Parquet under the checkpoint folder, read with column pruning.

    The shuffle files of the write go when it ends, so a chain of tables needs the disk of its largest step only.
    """
    path, conf = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, was)
    staged = _STAGED.get()
    if staged is not None:
        staged.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_step(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows as a staged table. The tables that make() stages on its way are deleted once that one is written,
    so no other plan may read them. If a job fails they stay."""
    staged: list[str] = []
    outer = _STAGED.set(staged)
    try:
        df = make()
    finally:
        _STAGED.reset(outer)
    table = stage_table(df, name)
    spark = df.sparkSession
    for folder in staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return table


def components(links: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node of the links (src, dst); component: its smallest reachable node.

    Contraction: each round a node takes the first node of its closed neighbourhood in some order, and only links
    between different labels stay. Rounds go by the nodes' own order, which ends stars at once, and by a fresh hash of
    them in turn; in a hash's order the expected number of labels is at most three quarters of the nodes whatever the
    links (also for a path whose numbers rise), so the rounds grow with the logarithm of the nodes. Self-links keep
    lone nodes. Links and labels are tables in the shared folder (a checkpoint would carry the constraints of all rounds); the driver sees one flag a round. The labels of all rounds are
    put together from the last, the smallest, to the first. A hub's label comes from a partial aggregate.
    """
    links = links.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    links = stage_table(links.union(links.select("b", "a")).distinct(), "links")
    steps: list[DataFrame] = []
    while True:
        turn = len(steps)

        def order(c: Column) -> Column:
            return F.xxhash64(F.lit(turn), c) if turn % 2 else c

        first = links.groupBy("a").agg(F.min_by("b", order(F.col("b"))).alias("m"))
        label = stage_table(first.select("a", F.when(order(F.col("m")) < order(F.col("a")), F.col("m")).otherwise(F.col("a")).alias("m")), "labels")
        steps.append(label)
        left = links.filter("a <> b").join(label, "a").select("b", F.col("m").alias("x"))
        both = left.join(label.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        links = stage_table(both.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
        if links.isEmpty():
            break
    found = steps.pop()
    while steps:
        label = steps.pop()
        found = label.join(found.select(F.col("a").alias("m"), F.col("m").alias("far")), "m", "left").select("a", F.coalesce("far", "m").alias("m"))
        if len(steps) % 4 == 0:
            found = stage_table(found, "labels")
    least = found.groupBy("m").agg(F.min("a").alias("component"))
    return found.join(least, "m").select(F.col("a").alias("node"), "component")
