"""What a session needs before Python workers can run this package's functions."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def _packed() -> bytes:
    """The package's modules, and the pipeline's if it is there, as a zip archive."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted([*ROOT.glob("akzentor/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(f, f.relative_to(ROOT).as_posix())
    return held.getvalue()


def ready(spark: SparkSession) -> SparkSession:
    """Let workers import the package. In local mode they are children of this machine's and get the
    path; on a cluster they are sent the package, once an application, through Spark's own file
    distribution, so that no folder has to be shared."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        env = sc.environment
        paths = env.get("PYTHONPATH", "").split(os.pathsep)
        if str(ROOT) not in paths:
            env["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, paths)])
    elif sc.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="akzentor-package-")  # read by this driver alone, which serves it
        path = Path(folder) / "akzentor-package.zip"
        path.write_bytes(_packed())
        sc.addPyFile(str(path))
        _SHIPPED.add(sc.applicationId)
    return spark
