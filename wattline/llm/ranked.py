"""Ranked lexical search by two trees that bound each other.

Items and documents are sparse vectors over the items' terms: an item's coordinate is a term's
weight times its repeats, a document's the saturated share of the term's occurrences. Both
sides are put into trees whose nodes hold the maximum of every coordinate below them, so the
product of two nodes bounds the score of every pair under them. A pair of nodes is left out as
a whole where that bound is under the weakest k-th score of the node's items; all arithmetic is
in whole numbers, so nothing else is ever left out.

Only the items' terms are counted by document; their number is checked and items are dealt into
slices whose terms fit, each a pass of its own. Documents are never shuffled: a task builds the
tree of its own rows. A first pass over some shards gives floors of every item's k-th score to
all others, so that few rows leave a task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import parts_for, take, text_slices, texts_of
from wattline.session import spool

TOP = 20
SLICE_TERMS = 200_000  # different terms of the items of one pass; their table is broadcast
SLICE_ITEMS = 4_096
SHARD_DOCS = 8_192  # documents under one tree
LEAF = 16
FAN_OUT = 4
FIRST = 8  # document nodes of an item that are opened before its others are judged again
SEED_SHARES = 32  # the floors come from one shard in so many

# Letters and digits of ASCII, lower-cased, and every byte beyond ASCII; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


@dataclass(frozen=True)
class Sparse:
    """Rows of a matrix: sorted columns and whole values of row i lie between indptr[i] and indptr[i + 1]."""

    indptr: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.indptr) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        size = np.diff(self.indptr)[rows]
        indptr = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(indptr[-1]) + np.repeat(self.indptr[rows] - indptr[:-1], size)
        return Sparse(indptr, self.columns[at], self.values[at])


def maxima(rows: Sparse, cuts: np.ndarray, width: int) -> Sparse:
    """The maximum of each coordinate over every run of rows that begins at ``cuts``."""
    group = np.repeat(np.searchsorted(cuts, np.arange(len(rows)), side="right") - 1, np.diff(rows.indptr))
    key = group * width + rows.columns
    order = np.lexsort((rows.values, key))
    key = key[order]
    last = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True]))) if len(key) else np.zeros(0, np.int64)
    groups, columns = np.divmod(key[last], width)
    return Sparse(np.searchsorted(groups, np.arange(len(cuts) + 1)), columns, rows.values[order][last])


def tree(rows: Sparse, width: int, leaf: int = LEAF) -> list[tuple[np.ndarray, Sparse]]:
    """Levels from the root to the leaves: (where each node's rows or child nodes begin, its maxima)."""
    cuts = np.arange(0, max(len(rows), 1), leaf)
    levels = [(cuts, maxima(rows, cuts, width))]
    while len(levels[0][0]) > 1:
        cuts = np.arange(0, len(levels[0][1]), FAN_OUT)
        levels.insert(0, (cuts, maxima(levels[0][1], cuts, width)))
    return levels


def in_order(rows: Sparse, weight: np.ndarray) -> np.ndarray:
    """An order of the rows in which those with the same weightiest coordinates come together."""
    if not len(rows):
        return np.zeros(0, np.int64)
    score = rows.values.astype(np.float64) * weight[rows.columns]
    owner = np.repeat(np.arange(len(rows)), np.diff(rows.indptr))
    by = np.lexsort((rows.columns, -score, owner))
    best = np.full((len(rows), 2), -1, np.int64)
    for k in range(2):
        has = np.diff(rows.indptr) > k
        best[has, k] = rows.columns[by][rows.indptr[:-1][has] + k]
    return np.lexsort((best[:, 1], best[:, 0]))


class Search:
    """The best ``top`` documents of every item, found by the trees of items and of one shard."""

    def __init__(self, items: Sparse, width: int, top: int, floors: np.ndarray) -> None:
        self.order = in_order(items, np.ones(width))
        self.items, self.width, self.top = items.take(self.order), width, top
        self.levels = tree(self.items, width, leaf=8)
        self.floors = floors[self.order].copy()  # a score that k documents are known to reach, or 0
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(len(items))]

    def _weakest(self) -> list[np.ndarray]:
        """The lowest floor of the items under every node, by level."""
        out = [np.minimum.reduceat(self.floors, self.levels[-1][0])]
        for cuts, _ in reversed(self.levels[:-1]):
            out.insert(0, np.minimum.reduceat(out[0], cuts))
        return out

    def meet(self, docs: Sparse, ids: np.ndarray, order: np.ndarray) -> None:
        """Merge in a shard: its rows, their ids, and the order of its tree."""
        if not len(self.items) or not len(docs):
            return
        rows, ids = docs.take(order), ids[order]
        levels = tree(rows, self.width)
        dense = np.zeros(self.width, np.int64)
        below = self._weakest()

        def bounds(level: int, node: int, other: Sparse) -> np.ndarray:
            """The product of an item node (or an item, at the last level) with all rows of ``other``."""
            side = self.items if level == len(self.levels) else self.levels[level][1]
            own = slice(side.indptr[node], side.indptr[node + 1])
            dense[side.columns[own]] = side.values[own]
            running = np.concatenate(([0], np.cumsum(dense[other.columns] * other.values)))
            dense[side.columns[own]] = 0
            return running[other.indptr[1:]] - running[other.indptr[:-1]]

        def children(cuts: np.ndarray, nodes: np.ndarray, n: int) -> np.ndarray:
            end = np.append(cuts[1:], n)
            return np.concatenate([np.arange(cuts[i], end[i]) for i in nodes.tolist()]) if len(nodes) else np.zeros(0, np.int64)

        # an item node with the document nodes that it may need, both one level down at a time
        stack = [(0, 0, 0, np.array([0]))]
        while stack:
            level, node, depth, nodes = stack.pop()
            side = levels[depth][1].take(nodes) if depth < len(levels) else rows.take(nodes)
            got = bounds(level, node, side)
            weakest = self.floors[node] if level == len(self.levels) else below[level][node]
            live = (got >= weakest) & (got > 0)
            nodes, got = nodes[live], got[live]
            if not len(nodes):
                continue
            if level == len(self.levels) and depth == len(levels):
                self._offer(node, got, ids[nodes])
                continue
            if level == len(self.levels) and len(nodes) > FIRST:  # the most promising first, so that its floor rises for the rest
                best = np.argsort(-got, kind="stable")
                stack.append((level, node, depth, np.sort(nodes[best[FIRST:]])))
                nodes = np.sort(nodes[best[:FIRST]])
            if depth < len(levels):
                cuts = levels[depth][0]
                below_n = len(levels[depth + 1][1]) if depth + 1 < len(levels) else len(rows)
                nodes, depth = children(cuts, nodes, below_n), depth + 1
            if level < len(self.levels):
                end = self.levels[level][0][node + 1] if node + 1 < len(self.levels[level][0]) else (
                    len(self.levels[level + 1][1]) if level + 1 < len(self.levels) else len(self.items))
                stack += [(level + 1, child, depth, nodes) for child in range(self.levels[level][0][node], end)]
            else:
                stack.append((level, node, depth, nodes))

    def _offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.top:  # only the best of them can stay, with all ties at their edge
            edge = np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            near = scores >= edge
            scores, ids = scores[near], ids[near]
        heap = self.heaps[item]
        for score, doc in zip(scores.tolist(), ids.tolist(), strict=True):
            entry = (score, -doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.top:
            self.floors[item] = max(self.floors[item], heap[0][0])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, document, score), the documents as the places that ``meet`` was given."""
        rows = [(int(self.order[i]), -doc, score) for i, heap in enumerate(self.heaps) for score, doc in heap]
        return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, columns, tf): all terms of each text of (doc_id, text) and the counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("columns", "tf")]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in text_slices(batches, 1):
            n, ends, columns, tf = [], [0], [], []
            for text in texts_of(batch.column(1)):
                terms = terms_of(text)
                n.append(len(terms))
                found = sorted((number[t], k) for t, k in Counter(terms).items() if t in number)
                columns.extend([c for c, _ in found])
                tf.extend([k for _, k in found])
                ends.append(len(columns))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (columns, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=schema.names)

    return docs.mapInArrow(count, schema)


def _sparse(columns: pa.Array, values: pa.Array) -> Sparse:
    sizes = np.diff(columns.offsets.to_numpy())
    first = columns.offsets[0].as_py()
    flat = slice(first, first + int(sizes.sum()))
    return Sparse(
        np.concatenate(([0], np.cumsum(sizes))), columns.values.to_numpy()[flat].astype(np.int64), values.values.to_numpy()[flat].astype(np.int64)
    )


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _best_of(vectors: DataFrame, items: Sparse, weight: np.ndarray, total: tuple[int, int], top: int, floors: np.ndarray) -> DataFrame:
    """(item, doc_id, score): every task's best documents of each item."""
    width = len(weight)
    shared = vectors.sparkSession.sparkContext.broadcast((items, weight, floors))
    n_docs, n_terms = total
    kind = vectors.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])

    def shard(batches: list[pa.RecordBatch], search: Search, weight: np.ndarray) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks().sort_by("doc_id")  # ties go to the smaller id, nulls last
        batch = table.to_batches()[0]
        rows = _sparse(batch.column("columns"), batch.column("tf"))
        long = [n_docs * 25 * n // n_terms for n in batch.column("n").to_pylist()]  # Python's integers don't overflow
        m = np.repeat(np.array([75 + x for x in long], np.int64), np.diff(rows.indptr))
        rows = Sparse(rows.indptr, rows.columns, saturated(rows.values, m))
        search.meet(rows, np.arange(len(rows)), in_order(rows, weight))
        item, place, score = search.found()
        return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), batch.column("doc_id").take(pa.array(place)), pa.array(score)], names=schema.names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items_, weight_, floors_ = shared.value
        reached = floors_.copy()  # a floor of one shard holds for the next of the task

        def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            best = Search(items_, width, top, reached)
            found = shard(held, best, weight_)
            reached[best.order] = best.floors
            return found

        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= SHARD_DOCS:
                yield one(held)
                held, rows = [], 0
        if rows:
            yield one(held)

    live = vectors.where(F.size("columns") > 0).select("doc_id", "n", "columns", "tf")
    return live.mapInArrow(search, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _slices(items: list[tuple[object, Counter]]) -> Iterator[list[tuple[object, Counter]]]:
    """Runs of items with at most SLICE_TERMS different terms and SLICE_ITEMS items, or a single one."""
    held: list[tuple[object, Counter]] = []
    terms: set[bytes] = set()
    for item in items:
        if held and (len(terms | set(item[1])) > SLICE_TERMS or len(held) >= SLICE_ITEMS):
            yield held
            held, terms = [], set()
        held.append(item)
        terms |= set(item[1])
    if held:
        yield held


def _item_blocks(items: DataFrame, n: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items, read in blocks of a checked number of rows: the driver holds one block."""
    blocks = parts_for(n, SLICE_ITEMS)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator()
        yield from _slices([(r["item_id"], Counter(terms_of(bytes(r["text"] or b"")))) for r in rows])


def search_items(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of every item with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are
    lower-cased. Null and empty texts have no term and are no result. Equal scores go to the
    smaller doc_id, null ids last; repeated rows of documents each count, of items with one
    id and text one is searched. Extra columns are ignored.
    """
    rows = take(docs, doc_id=doc_id, text=text)
    asked = spool(take(items, item_id=item_id, text=item_text).dropDuplicates(["item_id", "text"]), "items")
    kinds = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id {rows.schema['doc_id'].dataType.simpleString()}, score bigint"
    spark = docs.sparkSession
    out = spark.createDataFrame([], kinds)
    for block in _item_blocks(asked, asked.count()):
        number = {t: i for i, t in enumerate(sorted(set().union(*(c for _, c in block))))}
        if not number:
            continue
        vectors = spool(occurrences(rows, number), "occurrences")
        total = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        held = vectors.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count("*").alias("df")).collect()  # a row per term of the block
        df = np.zeros(len(number), np.int64)
        for r in held:
            df[r["c"]] = r["df"]
        weight = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        columns = [sorted((number[t], k) for t, k in c.items()) for _, c in block]
        flat = np.array([x for c in columns for x in c], np.int64).reshape(-1, 2)
        matrix = Sparse(np.concatenate(([0], np.cumsum([len(c) for c in columns]))), flat[:, 0], flat[:, 1] * weight[flat[:, 0]])
        of = (int(total["docs"]), int(total["terms"]))
        floors = np.zeros(len(block), np.int64)
        some = vectors.where(F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(SEED_SHARES)) == 0)
        seeds = _ranked(_best_of(some, matrix, weight, of, top, floors), top).where(F.col("rank") == top)
        for r in seeds.select("item", "score").collect():  # at most a row per item of the block
            floors[r["item"]] = r["score"]
        best = _ranked(_best_of(vectors, matrix, weight, of, top, floors), top)
        names = spark.createDataFrame(
            [(i, item) for i, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]])
        )
        out = out.unionByName(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out
