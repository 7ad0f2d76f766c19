"""Session settings and stage tables.

``stage`` is how a plan is cut: the intermediate result is written as Parquet
below the shared folder named by ``spark.checkpoint.dir`` and read back.  The
next stage then starts from files that survive the loss of any executor, prunes
columns, and sees real sizes when it picks a join strategy.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scopes: list[list[DataFrame]] = []


def local_session(app: str = "gridtrack", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    The grouped kernels are imported there by name, whatever folder the driver
    program was started in.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="gridtrack-package-")) / "gridtrack.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for module in sorted(package.rglob("*.py")):
            bundle.write(module, Path(package.name) / module.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """Folder for stage tables: the one the session names in spark.checkpoint.dir.

    Only a local session without that setting gets a private folder; a cluster
    must name a folder every executor can reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridtrack-stages-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this application's stage tables."""
    return f"{shared_dir(spark).rstrip('/')}/gridtrack-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage table and return the table.

    The tables of an application share one folder, which can be dropped when it ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stage_path = path
    for scope in _scopes:
        scope.append(table)
    return table


def extend_stage(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``rows`` to a stage table and return it as it is then; plans over ``table`` read the rows it had."""
    path = table.stage_path
    rows.write.mode("append").parquet(path)
    longer = table.sparkSession.read.schema(table.schema).parquet(path)
    longer.stage_path = path
    return longer


@contextmanager
def stage_scope() -> Iterator[list[DataFrame]]:
    """Collects the stage tables made inside, so that those without a reader can be deleted."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [scope for scope in _scopes if scope is not made]


def unstage(*tables: DataFrame, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete stage tables that nothing reads any more, all but those to ``keep``."""
    kept = {table.stage_path for table in keep}
    for table in tables:
        if table.stage_path not in kept:
            _delete(table.sparkSession, table.stage_path)


def drop_stages(spark: SparkSession) -> None:
    """Delete all stage tables of this application."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/gridtrack-{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
