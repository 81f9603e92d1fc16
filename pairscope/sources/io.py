"""Sources and sinks: JSON lines and documents, CSV, indexed scans, resumable appends, file digests."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a
    local session (tests); a cluster has no folder to guess, so there it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pairscope-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the application ends, if not before."""
    own = spark.sparkContext.applicationId
    if own not in _folders:
        folder = f"{shared_dir(spark)}/pairscope/{own}"
        where, files = _place(spark, folder)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _folders[own] = folder
    return f"{_folders[own]}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path through Spark's own file system layer."""
    where, files = _place(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; rows that don't fit the schema raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json_document(spark: SparkSession, path: str, schema: str, rows: str, by_line: bool = False) -> DataFrame:
    """Documents, each a file (or a line), with an array of rows: one row each."""
    return spark.read.schema(schema).option("multiLine", not by_line).json(path).select(F.explode(rows).alias("row")).select("row.*")


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as strings; quoted line ends are kept, blank cells are empty strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    df.select(*columns).write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def write_small_csv(df: DataFrame, path: str, columns: list[str], bom: bool = False, most: int = 100_000) -> None:
    """One local CSV file, with a byte order mark if asked for; more than most rows are refused."""
    rows = df.select(*columns).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a single file")
    rows.to_csv(path, index=False, lineterminator="\n", encoding="utf-8-sig" if bom else "utf-8")


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as an indented JSON file."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary has one row")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows[0].asDict(recursive=True), f, ensure_ascii=False, indent=2, default=str)
        f.write("\n")


def delimited(df: DataFrame, mark: str = "|") -> DataFrame:
    """Array columns as joined strings, for sinks without arrays."""
    return df.select(*[F.array_join(c, mark).alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in df.dtypes])


def cell(value: Column) -> Column:
    """A text cell: NULL reads as blank."""
    return F.coalesce(value.cast("string"), F.lit(""))


def json_text(value: Column, kind: T.DataType) -> Column:
    """value as JSON text with a space after commas and colons; NULL inside is null."""
    if isinstance(kind, T.StringType):
        # to_json quotes and escapes; the text is the only element of the array that it gets
        shown = F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", "$1")
    elif isinstance(kind, T.BooleanType):
        shown = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.concat(json_text(e["key"].cast("string"), T.StringType()), F.lit(": "), json_text(e["value"], kind.valueType)))
        shown = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), json_text(value[f.name], f.dataType)) for f in kind.fields]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("null"))


def text_or_json(df: DataFrame, column: str) -> Column:
    """A cell of any type as text: NULL is blank, a text stays as it is, all else is JSON."""
    kind, value = df.schema[column].dataType, F.col(column)
    shown = value if isinstance(kind, T.StringType) else json_text(value, kind)
    return F.when(value.isNull(), "").otherwise(shown)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is left to do when earlier results exist."""
    return todo.join(done.select(*keys), keys, "left_anti")


def append_new(results: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys aren't in the table at path; returns how many. Only a path that isn't there counts as no table yet."""
    spark = results.sparkSession
    new = pending(results, spark.read.schema(results.schema).parquet(path), keys) if exists(spark, path) else results
    counted = Observation()
    new.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return counted.get["n"]


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files under path that aren't empty: file and length. Their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "length")


def file_digests(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """Per file under path: file, length and sha256, read in chunks by the executors, so a file may be of any size."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        for batch in batches:
            sums = []
            for file in batch.column(0).to_pylist():
                store, inner = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", file))
                found = hashlib.sha256()
                with store.open_input_stream(inner) as stream:
                    while part := stream.read(chunk):
                        found.update(part)
                sums.append(found.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], names=["file", "length", "sha256"])

    return listed(spark, path).mapInArrow(digest, "file string, length long, sha256 string")


def unpinned(digests: DataFrame, pins: dict[str, str]) -> DataFrame:
    """Files whose digest isn't the pinned one, missing ones included; pins: file name -> sha256."""
    wanted = digests.sparkSession.createDataFrame(list(pins.items()), "name string, pinned string")
    named = digests.select(F.element_at(F.split("file", "/"), -1).alias("name"), "sha256")
    return F.broadcast(wanted).join(named, "name", "left").where(~F.col("pinned").eqNullSafe(F.col("sha256")))  # as many pins as the caller wrote


def scoped(df: DataFrame, column: str, scope: str) -> DataFrame:
    """The rows of a scope; ``pooled`` is all of them. An empty scope raises."""
    out = df if scope == "pooled" else df.where(F.col(column) == scope)
    if out.isEmpty():
        raise ValueError(f"empty scope: {scope}")
    return out
