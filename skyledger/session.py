"""Session factory and the few settings operators read back from it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", app: str = "skyledger", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Nothing here is needed for right results except UTC; the rest is speed.
    """
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoint(): the cluster's own; a local one only where none is set and all runs in one process.

    On a cluster a folder of this machine would be lost to the others, so without a setting this fails.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="skyledger-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per context.

    Arrow functions are pickled by reference, so a worker that starts elsewhere than in the
    repository must be able to import the package.
    """
    sc = spark.sparkContext
    if getattr(sc, "_skyledger_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="skyledger-")) / "skyledger.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(archive))
    sc._skyledger_shipped = True
