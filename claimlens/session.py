"""Spark session helpers.

Library code never creates its own session: every operator takes DataFrames.
These helpers exist for tests, the bench and the command line.  On a cluster the
session is built by the job launcher; ``checkpoint_dir`` then reads the shared
folder it names in ``spark.checkpoint.dir`` and never falls back to a local path.
"""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "claimlens", driver_memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, AQE on)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``, so that checkpoints and written intermediate tables land in a
    folder that every executor sees.  Only when it is unset in a one-process local session (tests) is a
    fresh scratch folder created and registered; a cluster without it is an error.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d and sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="claimlens-ckpt-", dir=os.environ.get("CLAIMLENS_SCRATCH", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def materialize(df):
    """Write ``df`` to the shared checkpoint folder and continue from the written copy.

    Used before iterative algorithms (each ML pass would otherwise recompute the
    whole lineage); survives executor loss, unlike a local checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df, tag: str):
    """``df`` as a Parquet table of its own in the shared checkpoint folder, read back: for tables that
    many jobs read, a few columns at a time."""
    import uuid
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/claimlens-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete the folder of ``df``, a table from ``written`` that no later step reads."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not folder.rpartition("/")[2].startswith("claimlens-"):
            raise ValueError(f"not a folder of written(): {folder}")
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(conf).delete(path, True)


def small(df, rows: int = 100_000):
    """``df`` written once and, when it has at most ``rows`` rows, marked for broadcast; a larger table
    is joined by shuffle.  For tables of a few short columns: group means, codes, folds."""
    from pyspark.sql import functions as F
    made = materialize(df)
    return F.broadcast(made) if made.count() <= rows else made


def small_batches(spark=None, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, for Python over whole texts: a worker holds a batch of them, their chunks and both
    as Arrow at once."""
    spark = spark or SparkSession.getActiveSession()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark=None) -> None:
    """Make ``claimlens`` importable in Python workers (pandas UDFs pickle helpers by reference):
    zip the package once per application and register it with ``addPyFile``."""
    import zipfile

    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    with _SHIPPING:  # threads that start jobs may come at once
        if sc.applicationId in _SHIPPED:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="claimlens-pkg-"), "claimlens.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        sc.addPyFile(out)
        _SHIPPED.add(sc.applicationId)
