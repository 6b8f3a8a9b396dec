"""Sessions, the folder for intermediate results, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, one of our own if all runs in this
    process; on a cluster that is an error, as executors would not see a folder of this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veriframe-"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and go on from there, so that a lost executor costs no more
    than the step it was in."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers where neither their path nor their folder has it."""
    sc = spark.sparkContext
    on_path = any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or Path.cwd() == ROOT or getattr(sc, "_veriframe_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="veriframe-")) / "veriframe.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in (*ROOT.glob("veriframe/**/*.py"), *ROOT.glob("corpus_pipeline.py")):
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(str(name))
    sc._veriframe_shipped = True
