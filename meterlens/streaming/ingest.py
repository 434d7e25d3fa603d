"""L1: incremental loading of invoice files, each file once."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a file listing; the content is never selected, so files are not read for it.
FILE_LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def load_new_files(spark: SparkSession, folder: str, target: str, checkpoint: str, file_format: str = "parquet",
                   schema: T.StructType | None = None) -> DataFrame:
    """Append the files that arrived since the last call to the bronze table at ``target``.

    A file-source stream does the bookkeeping: its checkpoint, which belongs in
    shared storage, remembers loaded files, so a file is loaded once even if a
    run dies and is repeated, and ``availableNow`` ends the run when the backlog
    is done.  The stream carries only the *paths* of new files; each micro-batch
    reads those files, so files loaded before are not opened again.  A batch owns
    its folder in the table, so repeating one replaces its rows.  New columns
    widen the table; rows of older files read null there.  What columns the table
    has is kept beside it, in a log with an entry per batch.
    """
    paths = (spark.readStream.format("binaryFile").schema(FILE_LISTING).option("recursiveFileLookup", "true").load(folder)
             .select("path"))

    def load(batch: DataFrame, batch_id: int) -> None:
        files = [row.path for row in batch.collect()]  # file names only, a listing the driver has anyway
        if not files:
            return
        rows = _csv_rows(spark, files, schema) if file_format == "csv" else _rows(spark, files, file_format)
        known = logged_schema(spark, target, before=batch_id) or T.StructType([])
        typed = _with_types(rows, schema or known).withColumn("_loaded_at", F.current_timestamp())
        typed.write.mode("overwrite").parquet(f"{target}/load_id={batch_id}")
        names = set(known.names)
        _log_schema(spark, target, batch_id, T.StructType([*known.fields, *[f for f in typed.schema.fields if f.name not in names]]))

    query = (paths.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return read_bronze(spark, target)


def read_bronze(spark: SparkSession, target: str) -> DataFrame:
    """The bronze table with the columns of all its files, as the log beside it names them; no file is opened for that."""
    schema = logged_schema(spark, target)
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(schema)
    return reader.parquet(target).drop("load_id")


def _rows(spark: SparkSession, files: list[str], file_format: str) -> DataFrame:
    return spark.read.format(file_format).option("mergeSchema", "true").load(files)


def _csv_rows(spark: SparkSession, files: list[str], schema: T.StructType | None) -> DataFrame:
    """CSV files grouped by their header line and put together by column name, which one fixed schema cannot do."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for path in files:
        by_header.setdefault(tuple(spark.read.option("header", "true").csv(path).columns), []).append(path)
    parts = [spark.read.option("header", "true").option("inferSchema", str(schema is None).lower()).csv(paths) for paths in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _log(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{target}/_schema")
    return path, folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def logged_schema(spark: SparkSession, target: str, before: int | None = None) -> T.StructType | None:
    """The columns of the table after its last batch, or before a batch; None for a table without a log."""
    path, folder, fs = _log(spark, target)
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder)) if fs.exists(folder) else []
    names = [n for n in names if n.endswith(".json") and (before is None or int(n.removesuffix(".json")) < before)]
    if not names:
        return None
    stream = fs.open(path(folder, names[-1]))
    try:
        return T.StructType.fromJson(json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _log_schema(spark: SparkSession, target: str, batch_id: int, schema: T.StructType) -> None:
    path, folder, fs = _log(spark, target)
    out = fs.create(path(folder, f"{batch_id:012d}.json"), True)
    out.write(bytearray(schema.json().encode()))
    out.close()


def _with_types(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns the schema knows are cast to its types, so a later file cannot change a column's type."""
    types = {f.name: f.dataType for f in schema.fields}
    return rows.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in rows.columns])
