"""What driver and executors share: the package on the workers' path, and a folder."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def visible_to_workers(spark: SparkSession) -> None:
    """Put the package's folder on the path of Python workers (a cluster has it installed or at the same place)."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, root])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``. Only in local mode, where
    driver and executors are one process, an unset value becomes a folder
    below /tmp.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"/tmp/checkpoints/gristmill-{os.getuid()}"
    os.makedirs(path, exist_ok=True)
    return f"file://{path}"
