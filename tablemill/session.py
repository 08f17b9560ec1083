"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "tablemill", **conf) -> SparkSession:
    """A session with what this package relies on; the cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",               # models of a cross-validation are fitted side by side
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Keep the batches sent to Python small, as one page may be many megabytes, and
    let the executors have this package."""
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(limit)) > 512:
        spark.conf.set(limit, "512")
    if not getattr(spark.sparkContext, "_tablemill", False):
        package = os.path.dirname(os.path.abspath(__file__))
        into = os.path.join(tempfile.mkdtemp(), "tablemill")
        spark.sparkContext.addPyFile(shutil.make_archive(
            into, "zip", os.path.dirname(package), os.path.basename(package)))
        spark.sparkContext._tablemill = True
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names; a local one only if it
    names none and runs in this one process."""
    root = spark.sparkContext.getConf().get(CHECKPOINT_DIR) or spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), f"tablemill-{os.getpid()}")
        os.makedirs(root, exist_ok=True)
        spark.conf.set(CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
