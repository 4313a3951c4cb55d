"""Embeddings from an HTTP service, a session for each partition."""

from __future__ import annotations

import http.client
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .ingest import URL

#: post(path, body, headers) -> (status, body)
Post = Callable[[str, bytes, dict[str, str]], tuple[int, bytes]]


def http_post(base: str, timeout: float = 30, connect_timeout: float = 10) -> tuple[Post, str]:
    """A function that posts over one connection, and the base's path. Connecting may take connect_timeout, an answer timeout seconds."""
    m = re.fullmatch(URL, base)
    if not m:
        raise ValueError(f"not a base URL: {base}")
    path = (m[4] or "").removesuffix("/")
    kind = http.client.HTTPSConnection if m[1] == "https" else http.client.HTTPConnection
    connection = kind(m[2], int(m[3][1:]) if m[3] else None, timeout=connect_timeout)

    def post(to: str, body: bytes, headers: dict[str, str]) -> tuple[int, bytes]:
        if connection.sock is None:
            connection.connect()
            connection.sock.settimeout(timeout)
        connection.request("POST", to, body, headers)
        answer = connection.getresponse()
        return answer.status, answer.read()

    return post, path


def request(post: Post, path: str, model: str, texts: list[str], key: str = "") -> list[list[float]]:
    """Vectors in the order of the answer. A single text is sent as a string, more as a list."""
    body = json.dumps({"model": model, "input": texts[0] if len(texts) == 1 else texts}).encode()
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    status, answer = post(f"{path}/embeddings", body, headers)
    if status != 200:
        raise RuntimeError(f"embedding service: status {status}: {answer[:200].decode(errors='replace')}")
    out = [x["embedding"] for x in json.loads(answer)["data"]]
    if len(out) != len(texts):
        raise RuntimeError(f"embedding service: {len(out)} vectors for {len(texts)} texts")
    return out


def embed(df: DataFrame, base: str, model: str, key: str = "", text: str = "text", batch: int = 64, connect: Callable[[str], tuple[Post, str]] = http_post) -> DataFrame:
    """df with the column embedding. connect makes a partition's session; tests give their own."""
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, path = connect(base)
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                vectors = request(post, path, model, [t or "" for t in part.column(text).to_pylist()], key)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*part.schema.names, "embedding"])

    return df.mapInArrow(run, schema)
