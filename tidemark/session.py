"""Session settings, the shared work folder and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC, AQE)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # call-site capture on every column expression costs more than planning does
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def use_utc(spark: SparkSession) -> None:
    """All instants are UTC; Eastern wall time only through `functions.clock`."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


#: Bytes of a file that one scan task reads at most. A scan sums its rows before the shuffle, and what it holds for
#: that grows with the groups it meets: up to a row each.
SCAN_BYTES = 32 << 20


def bound_scans(spark: SparkSession) -> None:
    """Scan tasks of at most `SCAN_BYTES`; a smaller limit of the session stays."""
    name = "spark.sql.files.maxPartitionBytes"
    n, unit = re.match(r"(\d+)\s*([kmgt]?)", spark.conf.get(name).lower()).groups()
    if int(n) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] > SCAN_BYTES:
        spark.conf.set(name, str(SCAN_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir` of the session.

    Only a local master may go without it; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    held = sc.getCheckpointDir()
    if held:
        return held
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, never used before."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the written copy.

    Used where the same rows are read twice and both reads must agree to the
    last bit, also after an executor is lost. The copy is Parquet: later reads take only the
    columns they need, and its size is known when joins are planned.
    """
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
