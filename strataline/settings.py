"""Session settings the toolkit reads, and the one place that cuts lineage."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Most rows of one key that a single task may sort or hold. Longer series are
# cut into chunks of this many rows.
GROUP_ROWS = "strataline.group.rows"
DEFAULT_GROUP_ROWS = 1_000_000

CHECKPOINT_DIR = "spark.checkpoint.dir"


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS, str(DEFAULT_GROUP_ROWS)))


@contextmanager
def session_conf(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Other settings of the session for the jobs that run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point Spark at the shared folder the session names; only a local session may fall back to a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="strataline-")
    context.setCheckpointDir(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a table, next to the checkpoints where every executor can reach it."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> int:
    """Delete the tables that ``checkpoint`` has written for this application so far, and return how many.

    For long sessions, between pieces of work: what was derived from such a table and is not written yet cannot be read any more.
    """
    context = spark.sparkContext
    written: list[str] = getattr(context, "_strataline_tables", [])
    done = 0
    while written:
        path = context._jvm.org.apache.hadoop.fs.Path(written.pop())
        done += bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
    return done


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application.

    The sources go as one archive into the shared folder and from there to every executor. A package
    that is installed on all machines does not need it.
    """
    context = spark.sparkContext
    if getattr(context, "_strataline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    use_checkpoint_dir(spark)
    name = f"{context.getCheckpointDir()}/strataline-{uuid.uuid4().hex}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(buffer.getvalue()))
    out.close()
    context.addPyFile(name)
    context._strataline_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    A written table is computed once, survives lost executors, and later steps read only the
    columns they need. Column metadata (the recorded bound) is kept in the file schema.
    """
    return checkpoint_parts(df.sparkSession, [df])


def checkpoint_parts(spark: SparkSession, parts: Iterable[DataFrame]) -> DataFrame:
    """Write tables of one schema into one step, each before the next is taken, and go on from there."""
    path = work_folder(spark, "step")
    context = spark.sparkContext
    if not hasattr(context, "_strataline_tables"):
        context._strataline_tables = []
    context._strataline_tables.append(path)
    schema = None
    for df in parts:
        df.write.mode("append").parquet(path)
        schema = schema or df.schema
    return spark.read.schema(schema).parquet(path)
