"""Incremental folder ingest (T1, T2) with Structured Streaming.

The stream itself only discovers new files: a ``binaryFile`` file stream
that never reads file contents (the ``content`` column is not selected),
with the source's own checkpointed log of seen files.  Each micro-batch
hands its file list to the batch reader (``read_files``: probe heads, group
by header, union by name), so files whose header drifted from the earlier
ones are mapped by name, not by position (T2).

The sink is idempotent: rows carry ``_ingest_batch`` - the stream's own id
and the number of the micro-batch - and each micro-batch is written with
dynamic partition overwrite of its own partition, so one replayed after a
failure replaces, not duplicates, its rows.  The checkpoint lies beside the
target table, so a restarted application goes on where the last one ended;
the stream's id is kept in it, and another stream never touches its rows.
New columns are added to the table before the write (K4).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablework.operators.schema import align
from tablework.sinks.tables import add_missing_columns
from tablework.sources.probe import case_insensitive_glob
from tablework.sources.readers import read_files

BATCH_COLUMN = "_ingest_batch"
MAX_FILES = 10_000  # files of a micro-batch
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def default_checkpoint(spark: SparkSession, table: str) -> str:
    """A folder beside the table's (the warehouse's or its database's), the
    same for every application."""
    database, _, name = table.rpartition(".")
    info = spark.catalog.getDatabase(database or spark.catalog.currentDatabase())
    return f"{info.locationUri.rstrip('/')}/_ingest_checkpoints/{name}"


def write_batch(data: DataFrame, table: str, batch_id: int, stream: str = "batch") -> None:
    """Idempotent append of one micro-batch into a table partitioned by
    ``<stream>-<batch id>``."""
    spark = data.sparkSession
    data = data.withColumn(BATCH_COLUMN, F.lit(f"{stream}-{int(batch_id)}"))
    if not spark.catalog.tableExists(table):
        data.write.format("parquet").partitionBy(BATCH_COLUMN).saveAsTable(table)
        return
    add_missing_columns(spark, table, [f for f in data.schema.fields if f.name != BATCH_COLUMN])
    target = spark.table(table).schema
    # only the batch's own partition is replaced
    key = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(key)
    spark.conf.set(key, "dynamic")
    try:
        align(data, target).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(key, before)


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps in a stream's checkpoint (the same after a restart)."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def start_folder_ingest(spark: SparkSession, folder: str, table: str, file_type: str = "csv",
                        pattern: str = "*.{csv,csv.gz,csv.bz2}", checkpoint: str | None = None,
                        max_files_per_trigger: int = MAX_FILES, available_now: bool = True,
                        recursive: bool = True, **read_options) -> StreamingQuery:
    """Start the ingest stream; with ``available_now`` it loads every file
    not loaded by an earlier run and stops.  A micro-batch takes at most
    ``max_files_per_trigger`` files, whose names are what reaches the driver."""
    checkpoint = checkpoint or default_checkpoint(spark, table)
    src = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
           .option("pathGlobFilter", case_insensitive_glob(pattern))
           .option("recursiveFileLookup", str(recursive).lower()))
    src = src.option("maxFilesPerTrigger", str(max_files_per_trigger))
    files = src.load(folder).select("path")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        # the file names of this micro-batch (one row per new file)
        paths = sorted(r["path"] for r in batch.collect())
        if not paths:
            return
        data, _report = read_files(batch.sparkSession, paths, file_type, **read_options)
        write_batch(data, table, batch_id, _stream_id(batch.sparkSession, checkpoint))

    w = files.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def ingest_new_files(spark: SparkSession, folder: str, table: str, **kw) -> DataFrame:
    """Run the stream to completion for the files present now; return the table."""
    q = start_folder_ingest(spark, folder, table, available_now=True, **kw)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if not spark.catalog.tableExists(table):
        raise ValueError(f"no file matching the pattern has arrived in {folder} yet; {table} not created")
    spark.catalog.refreshTable(table)
    return spark.table(table)
