"""Saved indexes: a Parquet table of vectors (or chunks) and one row about it."""

from __future__ import annotations

import json
import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import IndexConfig

VERSION = 1


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share, spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tarnwell-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


_standing: dict[tuple, tuple[str, object]] = {}


def standing(spark: SparkSession, name: str, of: DataFrame, build: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` of the files that `of` reads: built and saved when it is first asked for, and again when those
    files have changed; read from then on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = []
    for f in sorted(of.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        at = path.getFileSystem(conf).getFileStatus(path)
        files.append((f, at.getLen(), at.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(files))
    if key not in _standing:
        path, df = folder(spark), build()
        df.write.parquet(path)
        _standing[key] = (path, df.schema)
    path, schema = _standing[key]
    return spark.read.schema(schema).parquet(path)


def get_vector(vectors: DataFrame, value: int, key: str = "vec_id", vector: str = "embedding") -> list[float] | None:
    """The vector of an id; None if there is none. Of equal ids one."""
    row = vectors.where(F.col(key) == value).select(vector).first()
    return None if row is None else row[0]


def saved(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: computed once, whatever reads it, and safe from lost executors."""
    path, schema = folder(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def save(vectors: DataFrame, path: str, cfg: IndexConfig, mode: str = "errorifexists", partition_by: list[str] | None = None, graphs: DataFrame | None = None) -> None:
    """Writes the table with all its columns, texts too, the settings, and the graphs of hnsw.build() if they are given."""
    if graphs is not None:
        graphs.write.mode(mode).parquet(f"{path}/graphs")
    writer = vectors.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    meta = {f: getattr(cfg, f) for f in cfg.__dataclass_fields__}
    vectors.sparkSession.createDataFrame([(VERSION, json.dumps(meta))], "version int, settings string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def append(vectors: DataFrame, path: str) -> None:
    """Adds rows. Ids aren't compared: equal ones are both kept."""
    vectors.write.mode("append").parquet(f"{path}/data")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, IndexConfig]:
    """The table and its settings; ValueError if they aren't what save() writes."""
    row = spark.read.parquet(f"{path}/meta").first()
    if row is None or row.version != VERSION:
        raise ValueError(f"version {row and row.version} of {path} isn't known")
    return spark.read.parquet(f"{path}/data"), IndexConfig(**json.loads(row.settings))


def load_graphs(spark: SparkSession, path: str) -> DataFrame:
    """The graphs that were saved with an index, for hnsw.find(); nothing is built."""
    return spark.read.parquet(f"{path}/graphs")


MAGIC = b"TWIX"
_HEAD, _HEAD_SIZE = "<4sIIIII", 24


def export_binary(vectors: DataFrame, cfg: IndexConfig, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(part, data): each partition's vectors in a binary layout of a header, ids and a row-major float32 matrix."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.asarray(b.column(0).to_pylist(), "<u4")
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), "<f4")
            data = struct.pack(_HEAD, MAGIC, VERSION, cfg.dim, cfg.m, cfg.m_max0, len(ids)) + ids.tobytes() + x.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["n", "data"])

    return vectors.select(key, vector).mapInArrow(pack, "n long, data binary")


def parse_binary(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of export_binary()'s layout; ValueError if it is damaged or out of bounds."""
    if len(data) < _HEAD_SIZE:
        raise ValueError("truncated")
    magic, version, dim, m, m0, n = struct.unpack_from(_HEAD, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not an index, or of another version")
    if not (0 < dim <= 65536 and m <= 255 and m0 <= 255 and n <= 100_000_000):
        raise ValueError("a value of the header is out of bounds")
    if len(data) != _HEAD_SIZE + 4 * n + 4 * n * dim:
        raise ValueError("truncated")
    ids = np.frombuffer(data, "<u4", n, _HEAD_SIZE)
    return ids.astype(np.int64), np.frombuffer(data, "<f4", n * dim, _HEAD_SIZE + 4 * n).reshape(n, dim)


def import_binary(files: DataFrame, column: str = "content") -> DataFrame:
    """(vec_id, embedding) of files read as binaryFile, or of export_binary()."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                ids, x = parse_binary(data.as_py())
                off = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(off, pa.array(x.ravel()))], names=["vec_id", "embedding"])

    return files.select(column).mapInArrow(unpack, "vec_id long, embedding array<float>")


def health(vectors: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(status, index_size, chunks)."""
    n = vectors.agg(F.count("*").alias("index_size"))
    c = chunks.agg(F.count("*").alias("chunks")) if chunks is not None else vectors.sparkSession.createDataFrame([(0,)], "chunks long")
    return n.crossJoin(c).select(F.lit("ok").alias("status"), "index_size", "chunks")
