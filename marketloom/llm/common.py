"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where that is unset, a temporary folder serves if driver and executors are one machine, as in tests; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="marketloom-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root.rstrip('/')}/marketloom-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df in the shared folder and read it back. It survives the loss of executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: list[str] = []


class swept:
    """A stretch of work of which only the last table that ``written`` made is read afterwards: the others are removed at its end, and all of them where it fails."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> swept:
        self.first = len(_tables)
        return self

    def __exit__(self, failed, *_) -> None:
        kept = [] if failed else _tables[-1:]
        for path in _tables[self.first :]:
            if path not in kept:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        _tables[self.first :] = kept


def row_key(df: DataFrame) -> Column:
    """16 bytes that are the same for rows alike in all columns, and for no others."""
    marked = [F.coalesce(F.concat(F.length(df[c].cast("string")), F.lit(":"), df[c].cast("string")), F.lit("-")) for c in df.columns]
    return F.unhex(F.md5(F.concat(*marked)))


_held: dict = {}


def held(key, make):
    """An object that a Python worker keeps between tasks. There is one at a time, so that the stages of a pipeline don't add up their models and caches."""
    if key not in _held:
        _held.clear()
        if make is not None:
            _held[key] = make()
    return _held.get(key)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, with one batch in memory."""
    for b in batches:
        yield from zip(*(b.column(n).to_pylist() for n in names))


def batched(items: Iterator[tuple], schema: pa.Schema, n: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of n rows from an iterator of tuples."""
    held: list[tuple] = []
    for x in items:
        held.append(x)
        if len(held) >= n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) in partitions of ascending id, nulls first, rows of one id by a hash of their texts, and rows alike in both by their number in the table, so that none of them has to fit in one partition."""
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("nth"))
    return chosen.repartitionByRange("id", "tie", "nth").sortWithinPartitions("id", "tie", "text").select("id", "text")


def slabs(items: Iterator[tuple], text_at: int, chars: int = 2_000_000) -> Iterator[list[tuple]]:
    """Lists of consecutive rows with about so many characters of text, so that work goes in vectors but memory stays bounded."""
    held, size = [], 0
    for x in items:
        held.append(x)
        size += len(x[text_at] or "") + 64
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def described(df: DataFrame, text_col: str, fields: list[tuple[str, pa.DataType, str]], describe, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of df and new ones that describe(list of texts) gives as a tuple per text. fields: name, Arrow type, Spark type.

    No shuffle. describe is made anew for each partition by calling describe() there."""
    if clash := {f[0] for f in fields} & set(keep):
        raise ValueError(f"columns {sorted(clash)} stand in both the input and the result")
    kept = [f for f in df.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = describe()
        for b in batches:
            size = max(1, min(b.num_rows, 2_000_000 * max(1, b.num_rows) // max(1, b.nbytes)))
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                new = list(zip(*of(part.column("text described").to_pylist())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, f[1]) for x, f in zip(new, fields))], names=[*keep, *(f[0] for f in fields)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} {t}" for n, _, t in fields)])
    return df.select(*keep, df[text_col].alias("text described")).mapInArrow(run, schema)
