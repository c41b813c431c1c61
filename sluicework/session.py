"""Sessions: owned or borrowed, with a task's settings laid over and taken off again."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


@contextmanager
def session(app_name: str = "sluicework", conf: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> Iterator[SparkSession]:
    """Yield ``spark``, the active session, or a new one. Only a new one is stopped."""
    found = spark or SparkSession.getActiveSession()
    if found is not None:
        with overlaid(found, conf or {}):
            yield found
        return
    builder = SparkSession.builder.appName(app_name)
    for key, value in {"spark.sql.session.timeZone": "UTC", **(conf or {})}.items():
        builder = builder.config(key, value)
    made = builder.getOrCreate()
    try:
        yield made
    finally:
        made.stop()


@contextmanager
def overlaid(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Set what can be set at run time and restore it afterwards; the rest belongs to the
    session's owner and is left alone."""
    before = {}
    for key, value in conf.items():
        if spark.conf.isModifiable(key):
            before[key] = spark.conf.get(key, None)
            spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def select_catalog(spark: SparkSession, catalog: str | None = None, schema: str | None = None) -> None:
    if catalog:
        spark.catalog.setCurrentCatalog(catalog)
    if schema:
        spark.catalog.setCurrentDatabase(schema)


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package where their path lacks it."""
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in on_path or os.getcwd() == str(ROOT) or getattr(spark.sparkContext, "_sluicework_shipped", False):
        return
    name = os.path.join(served_folder(), "sluicework.zip")
    with zipfile.ZipFile(name, "w") as z:
        for path in sorted((ROOT / "sluicework").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    spark.sparkContext.addPyFile(name)
    spark.sparkContext._sluicework_shipped = True


def served_folder() -> str:
    """A folder of the driver for files that it serves to executors: they may ask for them at any
    time, so it stays until the driver ends."""
    folder = tempfile.mkdtemp(prefix="sluicework-served-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``, or, in a local
    session without that setting, in this machine's temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/sluicework-shared"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
