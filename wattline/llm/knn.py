"""Exact nearest neighbours by cosine through a block matrix join in int8.

Unit vectors are rounded to int8 with a scale and the length of what rounding lost. A tile of
a query block and a candidate block is one matrix product, exact in integers; with the lost
lengths it bounds every cosine from both sides. Only pairs whose upper bound reaches the k-th
best known value are computed again in double precision, and each query keeps a heap of its
best. So nothing is lost: the result equals brute force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import parts_for, take
from wattline.session import spool

QUERY_BLOCK = 512
BLOCK = 4096
PAIRS = 1 << 15  # pairs computed in double precision at a time


def usable(vector: Column) -> Column:
    """True for vectors with components that are all finite and not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """(dim, <name>, ids, vectors): rows dealt into blocks of about ``size``, vectors as raw doubles."""
    counted = rows.groupBy("dim").agg(F.count("*").alias("n"), F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.join(F.broadcast(counted) if counted.count() <= 10_000 else counted, "dim").withColumn(
        name, F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = table["vec_id"].to_numpy().astype(np.int64)
        return pa.table({"dim": table["dim"][:1], name: table[name][:1], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})

    schema = f"dim int, {name} bigint, ids binary, vectors binary"
    return dealt.select("dim", name, "vec_id", "vector").groupBy("dim", name).applyInArrow(pack, schema)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length of the coded vector, length of what rounding lost) of the unit vectors."""
    shrunk = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = shrunk / np.sqrt((shrunk * shrunk).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    return codes, scale, np.sqrt((near * near).sum(axis=1)), np.sqrt(((unit - near) ** 2).sum(axis=1))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision, summed from left to right."""
    dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
    out = dot / (np.sqrt(aa) * np.sqrt(bb))
    odd = ~np.isfinite(out) | (aa < 1e-280) | (bb < 1e-280)  # squares out of range: bring the vectors to one size first
    if odd.any():
        a, b = (x[odd] / np.abs(x[odd]).max(axis=1, keepdims=True) for x in (a, b))
        dot, aa, bb = (np.cumsum(x, axis=1)[:, -1] for x in (a * b, a * a, b * b))
        out[odd] = dot / (np.sqrt(aa) * np.sqrt(bb))
    return np.clip(out, -1.0, 1.0)


class BestOf:
    """Per query of a block, a heap of its k best (score, smaller id first)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.coded = quantised(vectors)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Merge a candidate block in."""
        codes, scale, length, lost = quantised(vectors)
        q_codes, q_scale, q_length, q_lost = self.coded
        product = q_codes.astype(np.float32) @ codes.astype(np.float32).T  # exact: below 2**24 up to 1,040 components
        about = product.astype(np.float64) * (q_scale[:, None] * scale[None, :])
        error = q_lost[:, None] + q_length[:, None] * lost[None, :] + 1e-7 + 1e-7 * max(0, vectors.shape[1] - 1000)
        own = self.ids[:, None] == ids[None, :]
        sure = np.where(own, -np.inf, about - error)
        if len(ids) > self.k:
            best = np.partition(sure, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
            floor = np.maximum(self.floor, best)
        else:
            floor = self.floor
        i, j = np.nonzero((about + error >= floor[:, None]) & ~own)
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            scores = cosine(self.vectors[a], vectors[b])
            open_ = scores >= self.floor[a]
            for q, score, vec_id in zip(a[open_].tolist(), scores[open_].tolist(), ids[b[open_]].tolist(), strict=True):
                heap, item = self.heaps[q], (score, -vec_id)
                if len(heap) < self.k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
                if len(heap) == self.k:
                    self.floor[q] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        found = [(int(q), -i, s) for q, heap in zip(self.ids.tolist(), self.heaps, strict=True) for s, i in heap]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "vec_id", "score"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest candidates of another id, all if fewer.

    Unusable vectors and null ids take no part. Vectors meet only those of as many components.
    Of repeated rows of an id the one with the least vector counts. Ties go to the smaller id.
    Of candidates with one vector only the k + 1 smallest ids can be among anyone's nearest, so
    a group of copies of any size costs that much. Extra columns are ignored.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = take(df, vec_id=vec_id, vector=vector).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
        rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
        return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), "vector", F.size("vector").alias("dim"))

    alike = Window.partitionBy("vector").orderBy("vec_id")
    pool = clean(candidates).withColumn("copy", F.row_number().over(alike)).where(F.col("copy") <= k + 1).drop("copy")
    stored = spool(_blocks(spool(pool, "candidates"), BLOCK, "cb"), "candidate-blocks")
    asked = spool(_blocks(spool(clean(queries), "queries"), QUERY_BLOCK, "qb"), "query-blocks")
    numbers = stored.groupBy("dim").agg((F.max("cb") + 1).alias("blocks"))
    tiles = asked.join(numbers, "dim").withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    tiles = tiles.select("dim", "cb", "qb", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    met = tiles.join(stored, ["dim", "cb"]).select("dim", "qb", "q_ids", "q_vectors", "ids", "vectors")
    parts = parts_for(met.count(), 4)
    # a query block meets its candidate blocks in a few runs, each with a heap of its own
    run = F.pmod(F.xxhash64(F.col("ids")), F.lit(min(parts, 64)))
    met = met.withColumn("run", run).repartition(parts, "dim", "qb", "run").sortWithinPartitions("dim", "qb", "run")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch["dim"][i].as_py(), batch["qb"][i].as_py(), batch["run"][i].as_py())
                if key != now:
                    if best is not None:
                        yield best.rows()
                    vectors = np.frombuffer(batch["q_vectors"][i].as_buffer(), np.float64).reshape(-1, key[0])
                    now, best = key, BestOf(np.frombuffer(batch["q_ids"][i].as_buffer(), np.int64).copy(), vectors.copy(), k)
                best.meet(
                    np.frombuffer(batch["ids"][i].as_buffer(), np.int64),
                    np.frombuffer(batch["vectors"][i].as_buffer(), np.float64).reshape(-1, key[0]),
                )
        if best is not None:
            yield best.rows()

    found = met.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
