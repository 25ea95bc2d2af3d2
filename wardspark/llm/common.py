"""What the operators share: the shared folder, written tables, words, batches.

Work tables and files go below ``spark.checkpoint.dir``, the folder that all
executors and the driver see. A session that names none gets a temporary one if all
its tasks run on this machine (tests), and an error otherwise. Nothing is kept in an
executor's own folders.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    here = sc.master.startswith("local")
    if here and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc.environment.setdefault("PYTHONPATH", ROOT)  # workers started later can import this package; it makes them other workers
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not here:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wardspark-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return named.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, table: DataFrame, key: str, rows: int) -> DataFrame:
    """left joined on ``key`` to a table of one row a key, whose column ``n`` says how many of the ``rows`` rows of left have it.

    Keys of more rows than an eighth of a task's share, at most 8 a task, are
    broadcast, so that their rows stay where they are; all others meet by a shuffle.
    Rows of left without a partner, null keys among them, are dropped.
    """
    hot = table.filter(F.col("n") > max(1, rows // (8 * partitions(left.sparkSession))))
    rest = table.join(F.broadcast(hot.select(key)), key, "left_anti").drop("n")
    cool = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return left.join(F.broadcast(hot.drop("n")), key).unionByName(cool)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def owner_keys(spark: SparkSession, n: int) -> list[int]:
    """For every partition of repartition(n, key) an integer key that goes to it."""
    rows = spark.range(0, 24 * n + 64).select(F.col("id").cast("int").alias("k"))
    found = rows.groupBy(F.pmod(F.hash("k"), F.lit(n))).agg(F.min("k").alias("k")).collect()
    return sorted(r.k for r in found)


def filesystem(uri: str):
    """(pyarrow file system, path) of a shared folder; any scheme that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> None:
    """Writes under a temporary name of this attempt, then renames: no reader sees half a file,
    and a repeated attempt replaces the same name by the same bytes."""
    files, at = filesystem(folder)
    files.create_dir(at, recursive=True)
    temporary = f"{at}/_{name}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    files.move(temporary, f"{at}/{name}")


def read_file(folder: str, name: str, start: int = 0, size: int | None = None) -> bytes:
    """A file, or ``size`` bytes of it from ``start``."""
    files, at = filesystem(folder)
    if size is None:
        with files.open_input_stream(f"{at}/{name}", compression=None) as f:
            return f.read()
    with files.open_input_file(f"{at}/{name}") as f:
        return f.read_at(size, start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) alone, null text as empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z in lower case, split on ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def crc_of(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut into parts of about ``most`` bytes of text; one row may be larger."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, load = 0, 0
        for i, size in enumerate(sizes):
            if load and load + size > most:
                yield batch.slice(start, i - start)
                start, load = i, 0
            load += size
        if start < batch.num_rows:
            yield batch.slice(start)


def spread_out(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cluster when the input has fewer splits than it has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df


def cpu_quiet() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
