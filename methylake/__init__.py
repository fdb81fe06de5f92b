"""Methylation analytics on PySpark: DataFrames in, DataFrames out."""

from __future__ import annotations


def ship(spark) -> None:
    """Sends this package to the cluster's Python workers, for sessions whose executors don't have it installed. Needed
    once a session, before an operator that runs Python (the BAM source and the operators in llm)."""
    import os
    import shutil
    import tempfile

    here = os.path.dirname(os.path.abspath(__file__))
    with tempfile.TemporaryDirectory() as folder:
        target = os.path.join(folder, "package", os.path.basename(here))
        shutil.copytree(here, target, ignore=shutil.ignore_patterns("__pycache__"))
        # the driver serves a copy of its own, so the folder may go
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "methylake"), "zip", os.path.dirname(target)))
