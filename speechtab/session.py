"""Spark session helpers.

Library code never creates its own session: it receives one.  These helpers
exist for tests, the benchmark and the contract entry points, and they only
fill in settings that the caller (or the cluster) left unset.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings we want on every session; applied only when the key is unset so a
# cluster configuration always wins.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``speechtab`` importable by the Python workers of ``spark``.

    Functions that run in workers (pandas UDFs, ``mapInPandas``,
    ``applyInPandas``) are pickled by reference to this package, so the
    package is zipped once and added with ``addPyFile`` (Spark ships it to
    every executor).  The zip is the driver's own code artifact, in a temporary
    folder that goes with the process: the package itself may be read-only."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: no context to ship through
        return
    key = (id(sc), sc.applicationId)
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="speechtab-code-")
    atexit.register(shutil.rmtree, out_dir, ignore_errors=True)
    path = os.path.join(out_dir, f"speechtab-{sc.applicationId}.zip")
    if not os.path.exists(path):
        tmp = path + ".part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as zf:
            for dirpath, _, files in os.walk(pkg_dir):
                if "__pycache__" in dirpath:
                    continue
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        zf.write(full, os.path.relpath(full, root))
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED.add(key)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "speechtab") -> SparkSession:
    """Session for tests and local benchmarks (``local[cpus]``)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.worker.reuse", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    ship_package(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        if key == "spark.ui.enabled":
            continue  # static; only settable at launch
        if conf.get(key, None) is None:
            conf.set(key, value)
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared filesystem folder and is used
    as is.  Only when it is unset (tests, local runs) do we create a scratch
    folder for it.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not str(sc.master).startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a shared folder (e.g. on the cluster file system) for "
            "checkpoints and stream state; a machine-local folder is only used in local mode"
        )
    local = tempfile.mkdtemp(prefix="speechtab-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def spread(df, min_partitions: int | None = None):
    """Round-robin ``df`` over at least ``min_partitions`` partitions (default:
    the cluster's parallelism) when its scan yields fewer, before heavy
    per-row work.  A no-op on large inputs, whose scans already have many
    splits; planning only, no job is run to decide."""
    spark = df.sparkSession
    try:
        target = min_partitions or spark.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: leave as is
        return df
    if have < target:
        return df.repartition(target)
    return df


def materialize(df, reliable: bool = False):
    """Compute ``df`` once for several later jobs.

    Default: persisted (memory, spilling to disk) and filled by one count;
    a lost executor recomputes only its blocks from lineage.  With
    ``reliable=True`` the rows go to the shared checkpoint folder instead and
    lineage is cut (long pipelines)."""
    from pyspark import StorageLevel

    if reliable:
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out
