"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session, whose executors are this process, gets a folder of its own
    where none is set; on a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable on every executor, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(Path("tessera") / f.relative_to(PACKAGE)))
    sc.addPyFile(str(path))
    sc._tessera_shipped = True
