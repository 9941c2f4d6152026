"""Parquet inputs, table and bundle sinks, checkpoints."""

from __future__ import annotations

import contextlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
#: Tasks per core that list the folders of a table.
LISTING_TASKS = 4


#: Bytes of Parquet files that a task reads, on average. What operators make of a text is many times its size.
PIECE_BYTES = 16 << 20
#: Of the Parquet files that are written: a job's own tables are most of what it keeps on disk.
COMPRESSION = "zstd"


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table, spread over the cores when it has few splits.

    A table of any size comes in pieces of about ``PIECE_BYTES`` of its files, or smaller ones,
    so what a task reads, caches and hands on does not grow with the table.
    """
    table = spark.read.parquet(path)
    # Only the files' lengths are listed here, as in ``read_checked``; no file is opened.
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    return spread(table.select(*columns) if columns else table, -(-size // PIECE_BYTES))


def spread(scan: DataFrame, pieces: int = 1) -> DataFrame:
    """Repartition a scan that has fewer splits than the cluster has cores, or than ``pieces``."""
    wanted = max(scan.sparkSession.sparkContext.defaultParallelism, pieces)
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write as ``parquet`` or as ``csv`` with a header and no row-name column."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path, compression=COMPRESSION)
    elif fmt == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        if nested:
            raise ValueError(f"columns {nested} cannot be written as csv: use parquet")
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'parquet' or 'csv'")


MANIFEST = "manifest"
_MANIFEST = "name string, kind string, format string, n_rows long, schema string"


def write_bundle(
    tables: Mapping[str, DataFrame],
    root: str,
    run_id: str,
    fmt: str = "parquet",
    models: Mapping[str, Callable[[str], None]] | None = None,
) -> dict[str, str]:
    """Write named tables under ``root/run_id=<run_id>/<name>``; return their paths.

    ``run_id`` is normally a time stamp. A run is never written over. ``models`` are
    functions that save a model to the path they are given. A table of what was written,
    with row counts and schemas, comes last: a run that broke off has none, and
    ``read_bundle`` refuses it. A table's shuffle files go when it is written.
    """
    models = models or {}
    names = [*tables, *models]
    if MANIFEST in names or len(set(names)) < len(names):
        raise ValueError(f"names must differ from each other and from {MANIFEST!r}: {names}")
    if not names:
        return {}
    folder = f"{root.rstrip('/')}/run_id={run_id}"
    paths = {name: f"{folder}/{name}" for name in names}
    for name, table in tables.items():
        with shuffles_removed(table.sparkSession):
            write_table(table, paths[name], fmt)
    for name, save in models.items():
        save(paths[name])
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    rows = [(n, "table", fmt, _read(spark, paths[n], fmt, t.schema).count(), t.schema.json()) for n, t in tables.items()]
    rows += [(n, "model", None, None, None) for n in models]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{folder}/{MANIFEST}")
    return paths


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)


def read_bundle(spark: SparkSession, root: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a run that ``write_bundle`` finished, by name.

    Raises ``ValueError`` where the run has no manifest or a table has lost or gained rows.
    An empty string of a csv table comes back as null. Models are loaded from their paths.
    """
    folder = f"{root.rstrip('/')}/run_id={run_id}"
    try:
        listed = spark.read.schema(_MANIFEST).parquet(f"{folder}/{MANIFEST}").where("kind = 'table'").collect()
    except AnalysisException as error:
        raise ValueError(f"{folder} is not a finished run: it has no manifest") from error
    tables = {}
    for row in listed:
        table = _read(spark, f"{folder}/{row.name}", row.format, StructType.fromJson(json.loads(row.schema)))
        found = table.count()
        if found != row.n_rows:
            raise ValueError(f"{row.name} has {found} rows, its manifest says {row.n_rows}")
        tables[row.name] = table
    return tables


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from ``spark.checkpoint.dir`` when it has none.

    A temporary folder is made up only for a local session; a cluster must name a
    shared one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="textloom-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a table to the checkpoint folder and read it back, which cuts its lineage.

    Used between the rounds of iterative operators. A plain table also drops what the
    optimizer has inferred about the rows so far; carried through many rounds, that
    makes planning slower with every round.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4()}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression=COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffles_removed(spark: SparkSession):
    """Inside, a query's shuffle files go when it ends, not when the driver collects garbage.

    A table that was written needs them no more; kept, they would fill the disks of a job
    of many steps.
    """
    return _setting(spark, _CLEANUP, "true")


def folders_in_shares(spark: SparkSession):
    """Inside, folders are listed by a few tasks per core: by default up to 10,000 folders are a task each."""
    return _setting(spark, _LISTING, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Number the rows of a sorted table from 1, without a single-task window.

    The sorted rows are checkpointed, which fixes their partitions; a row's number is
    its place in its partition plus the sizes of the partitions before it. Only those
    sizes, one number per partition, pass through the driver.
    """
    checkpoint_folder(ordered.sparkSession)
    fixed = ordered.checkpoint().withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = fixed.groupBy(part.alias("part")).count().orderBy("part").collect()
    offsets, total = {}, 0
    for row in sizes:
        offsets[row.part] = total
        total += row["count"]
    if not offsets:
        return fixed.withColumn(name, F.lit(0).cast("long")).drop("_at")
    before = ordered.sparkSession.createDataFrame(list(offsets.items()), "_part long, _before long")
    return (
        fixed.withColumn("_part", part)
        .withColumn("_place", place)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_place") + 1)
        .drop("_at", "_part", "_place", "_before")
    )
