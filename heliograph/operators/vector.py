"""Exact search over 8-bit vectors for a table of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.functions.vectors import quantize_i8

#: Queries that are sent to the executors at once; larger query sets are searched in blocks.
QUERY_BLOCK = 1_000


def quantized(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    return vectors.withColumn("emb_q8", quantize_i8(F.col(col))).drop(col)


FOUND = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _matrix(rows: pa.Array) -> np.ndarray:
    """Lists of one size as a matrix whose products of integers are exact."""
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    n = len(flat) // max(len(rows), 1)
    if len(rows) and (rows.value_lengths().to_numpy() != n).any():
        raise ValueError("vectors have different sizes")
    return flat.astype(np.float32 if n * 127 * 127 < 1 << 24 else np.float64).reshape(len(rows), n)


def _best(qids: np.ndarray, queries: np.ndarray, k: int):
    """Of each batch and for each query the ids with the k best scores (more, if they tie), an id's score being its best chunk's."""

    def run(it):
        for b in it:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows or not len(qids):
                continue
            ids, v = b.column(0).to_numpy(), _matrix(b.column(1))
            if v.shape[1] != queries.shape[1]:
                raise ValueError(f"vectors have {v.shape[1]} dimensions, queries {queries.shape[1]}")
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            score = np.maximum.reduceat(queries.astype(v.dtype) @ v[order].T, first, axis=1)
            least = np.partition(score, -k, axis=1)[:, -k, None] if score.shape[1] > k else score.min(1, keepdims=True)
            q, i = np.nonzero(score >= least)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q]), pa.array(ids[first][i]), pa.array(score[q, i].astype(np.int64))], schema=FOUND)

    return run


def scores(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score): integer dots of vectors (id, emb_q8) with queries (qid, q8), the best of an id's chunks.

    Rows of at least the ``k`` best ids of each query: an id among them is among the best of the
    batch that holds its best chunk, so batches are cut before anything is moved. Null vectors
    match nothing.
    """
    asked = queries.select(F.col("qid").cast("long").alias("qid"), F.col("q8").cast("array<tinyint>").alias("q8")).filter("qid is not null and q8 is not null")
    parts, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for p in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).toArrow().combine_chunks()
        q8 = block.column("q8").combine_chunks()
        run = _best(block.column("qid").to_numpy(), _matrix(q8), k)
        found = vectors.select(F.col("id").cast("long").alias("id"), "emb_q8").mapInArrow(run, "qid long, id long, score long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("qid", "id").agg(F.max("score").alias("score"))
