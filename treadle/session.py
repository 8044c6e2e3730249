"""A session with settings that suit the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A running session, or a new one: adaptive execution, UTC, Kryo-free defaults; ``conf`` wins."""
    builder = SparkSession.builder.appName("treadle")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(max(8, (os.cpu_count() or 8))),
        "spark.ui.enabled": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per context, unless their PYTHONPATH has it."""
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    named = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if any(Path(p).resolve() == package.parent for p in named) or getattr(context, "_treadle_shipped", False):
        return
    place = Path(tempfile.mkdtemp(prefix="treadle-")) / "treadle.zip"  # the driver serves it from there
    with zipfile.ZipFile(place, "w") as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(place))
    context._treadle_shipped = True
