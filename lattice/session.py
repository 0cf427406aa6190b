"""Session factory, and shipping of this package to executors that do not have it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(name: str = "lattice", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects: UTC, AQE, no UI."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.driver.memory": "12g", "spark.scheduler.mode": "FAIR",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="lattice-ship-"), "lattice_package.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("lattice") / p.relative_to(root)))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names; where it names none to a local one, but only in a local session."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lattice-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder, that all executors share."""
    ensure_checkpoints(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
