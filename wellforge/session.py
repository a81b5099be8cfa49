"""Session helpers: tables, the shared folder, and cutting lineage so that a lost executor costs no result."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, once a session."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        home = Path(__file__).resolve().parent
        stage = Path(tempfile.mkdtemp(prefix="wellforge-ship-"))
        shutil.copytree(home, stage / "src" / home.name, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(stage / home.name), "zip", stage / "src"))
        _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without; it gets a temporary one.

    On a cluster a folder of one machine would lose rows without a word, so a session without the option raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="wellforge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_scratch: list[tuple[str, str]] = []  # application and path of every table written to the shared folder


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark.sparkContext.applicationId, path))
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete every table that this application's operators have written to the shared folder; how many there were.

    Results are lazy and read these tables, so call it when they have been read or written.
    """
    app, context = spark.sparkContext.applicationId, spark.sparkContext
    mine = [path for owner, path in _scratch if owner == app]
    for path in mine:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    _scratch[:] = [x for x in _scratch if x[0] != app]
    return len(mine)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: the partitions stay as they are and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: for tables that several later scans share. What was shuffled for it is dropped."""
    path = scratch_path(df.sparkSession, label)
    with conf(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def conf(spark: SparkSession, **settings: str):
    """Set SQL options (dots written as __) for the actions inside the block, then restore them."""
    keys = {k.replace("__", "."): v for k, v in settings.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
