"""Session construction and the shared scratch folder.

Scratch data (staging tables, snapshots, derived files) always goes under
the folder the cluster names in ``spark.checkpoint.dir``; a machine-local
temporary folder is only chosen when that setting is absent (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Session settings the library relies on.  AQE re-plans joins and coalesces
# shuffle partitions at run time; skew-join splits hot partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # cp1252 / windows-1252 CSV files need the JDK charset table.
    "spark.sql.legacy.javaCharsets": "true",
    # "name" is an identifier, and TIME a type, as in the reference's dialect
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.timeType.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "tablework",
                shuffle_partitions: int | None = None,
                conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the runtime SQL settings on an existing session (idempotent) and
    make sure executors can import this package."""
    for k in ("spark.sql.legacy.javaCharsets", "spark.sql.session.timeZone", "spark.sql.ansi.enabled",
              "spark.sql.ansi.doubleQuotedIdentifiers", "spark.sql.timeType.enabled"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # pragma: no cover - static on some deployments
            pass
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """``addPyFile`` a zip of ``tablework`` once per application, so Python
    steps that run on executors (file-head probing, xlsx, mapInPandas
    framing) import it there - the same as ``spark-submit --py-files``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="tablework-pyfiles-"), "tablework.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a local one only when none is configured."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if root:
        return root
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tablework-ckpt-"))
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession, *parts: str, unique: bool = True) -> str:
    """A folder below the shared checkpoint root, e.g. for staging tables.

    With ``unique`` a fresh random leaf is appended so concurrent jobs never
    collide.  Returned as a URI/path string usable by DataFrame readers and
    writers on any Hadoop-compatible file system.
    """
    base = checkpoint_root(spark).rstrip("/")
    leaf = "/".join(p.strip("/") for p in parts if p)
    path = f"{base}/tablework" + (f"/{leaf}" if leaf else "")
    if unique:
        path += f"/{uuid.uuid4().hex[:12]}"
    return path

