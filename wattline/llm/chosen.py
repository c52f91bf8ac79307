"""MinHash near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, described by COORDINATES minwise values. A tree
branches all sets by the minwise token of its own first coordinate: sets with one token there
share a node. A small node is compared exhaustively. A large one is dealt into chunks first,
and its hubs, the members most similar to the others on average, are compared with all: a group
of near copies is linked by them. Where all but a few members are linked then, only those few
meet the others. Two paths carry a pair of similarity s to 2s children on average, so a large node
whose unlinked pairs are half alike or more would only grow by branching and is compared block by
block, as is one of a few blocks; any other is branched again, by two coordinates that its path selects. Two sets at
the threshold t share a node of a tree with chance t, and TREES independent trees miss them
with chance (1 - t)**TREES: 1e-7 at 0.8.

Within a node sets meet first by their minwise values, which tell sets that are surely apart
(a pair at the threshold agrees in fewer than AGREE of them with chance 1e-8); what is left is
confirmed on the whole sets, made from the whole texts. Equal sets are one set, so copies cost
a row each and never a pair, and of pairs within one known component none is confirmed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.backoff import _mix, tokens
from wattline.llm.common import take, text_slices, texts_of
from wattline.llm.simhash import components
from wattline.session import spool

SHINGLE = 4
SIMILAR_PCT = 80
COORDINATES = 64
TREES = 10
AGREE = 32
NODE = 128  # sets that are compared exhaustively
BLOCKS = 8  # nodes of at most so many times NODE are compared block by block
NOMINATED, HUBS = 4, 16  # central members that a chunk of a large node names, and that the node has
PATHS = 2  # coordinates that branch a large node
MATRIX = 4 << 20  # shingles of a cluster up to which its sets are confirmed by one product
DEPTH = 12  # levels after which large nodes are compared block by block
BROADCAST_RECORDS = 300_000  # records (24 bytes each) that may be broadcast

_ODD = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = _mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the shingles of all texts in a row, shingles per text).

    A text of 1 to ``shingle`` words has one, the whole sequence; a text without words has none.
    """
    words, n = tokens(texts)
    word = np.ones(len(words), bool)
    word[np.cumsum(n) - 1] = False  # the ends of texts are tokens, too
    words, n = words[word], n - 1
    per_text = np.where(n > shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.repeat(np.cumsum(n) - n, per_text)
    at = first + np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    size = np.repeat(np.minimum(n, shingle), per_text)
    out = size.astype(np.uint64)
    for k in range(shingle):
        inside = size > k
        out[inside] = _mix(out[inside] * _ODD + words[at[inside] + k])
    return out, per_text


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes([text], shingle)[0])


def _described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, k1, k2, n, digest, signature, first) from (doc_id, k1, k2, text); the last three are null without a shingle.

    ``signature`` has 32 bits of every minwise token, ``first`` all 64 of those that trees begin with.
    """
    at = docs.columns.index("text")
    own = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType(
        [*own, T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType())), T.StructField("first", T.ArrayType(T.LongType()))]
    )

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            hashes, per_text = shingle_hashes(texts_of(batch.column(at)), shingle)
            ends = np.cumsum(per_text)
            live = np.flatnonzero(per_text)
            values = np.empty((len(live), COORDINATES), np.uint64)
            for c, factor in enumerate(_FACTORS if len(live) else ()):
                values[:, c] = _mix(np.minimum.reduceat(hashes * factor, (ends - per_text)[live]))
            n, digests = [], []
            for a, b in zip((ends - per_text).tolist(), ends.tolist(), strict=True):
                found = np.unique(hashes[a:b])
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            lists = []
            for part in (values.astype(np.uint32).view(np.int32), values[:, :TREES].view(np.int64)):
                offsets = np.concatenate(([0], np.cumsum(per_text > 0) * part.shape[1])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()), mask=pa.array(per_text == 0)))
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in own]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), *lists], names=schema.names)

    return docs.mapInArrow(describe, schema)


def _near(side: DataFrame, n: int) -> DataFrame:
    return F.broadcast(side) if n <= BROADCAST_RECORDS else side


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, size) of nodes with more than one set, stored."""
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"))
    return spool(sizes.where("size > 1"), "nodes")


def _root_nodes(records: DataFrame, node: int) -> DataFrame:
    """(record, n, signature, small, nodes): the records that share a first node with others, and these nodes.

    Bit t of ``small`` tells that the record's node of tree t is compared exhaustively.
    """
    nodes = records.select("record", F.posexplode("first").alias("tree", "token")).select("record", "tree", F.xxhash64("tree", "token").alias("node"))
    shared = _shared(nodes)
    small = F.sum(F.when(F.col("size") <= node, F.expr("shiftleft(1, tree)")).otherwise(0)).alias("small")
    of = nodes.join(_near(shared, shared.count()), "node").groupBy("record")
    of = of.agg(small, F.collect_list(F.struct("tree", "node", "size")).alias("nodes"))  # at most one a tree
    return spool(records.join(of, "record").select("record", "n", "signature", "small", "nodes"), "members")


def _chunk(node: int) -> Column:
    return F.pmod(F.xxhash64("record", "node"), F.ceil(F.col("size") / node))


def _hubs(large: DataFrame, node: int) -> DataFrame:
    """(node, record) of the hubs of large nodes, stored; ``large`` has node, size, record and signature."""

    def nominate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, ["node", "chunk"]):
            signature = np.concatenate([x.flatten().to_numpy() for x in table["signature"].chunks]).reshape(-1, COORDINATES)
            score = agreement(signature).mean(axis=1)
            best = np.argsort(-score, kind="stable")[:NOMINATED]
            named = table.select(["node", "record"]).take(best).append_column("score", pa.array(score[best]))
            yield from named.combine_chunks().to_batches()

    dealt = large.select("node", _chunk(node).alias("chunk"), "record", "signature").repartition("node", "chunk").sortWithinPartitions("node", "chunk", "record")
    named = dealt.mapInArrow(nominate, "node bigint, record bigint, score double")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "record"))
    return spool(named.withColumn("nth", nth).where(F.col("nth") <= HUBS).select("node", "record"), "hubs")


def _groups(members: DataFrame, hubs: DataFrame | None, node: int) -> DataFrame:
    """``members`` (node, size, record, ...) with the ``group`` in which each is compared.

    A small node is one group. A large one is dealt into chunks, and its hubs are in each.
    """
    own = F.when(F.col("size") <= node, F.lit(0).cast("bigint")).otherwise(_chunk(node))
    rows = members.withColumn("chunk", own)
    if hubs is not None:
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("size") / node) - 1))
        met = rows.join(_near(hubs, hubs.count()), ["node", "record"], "left_semi").withColumn("other", every).where("other <> chunk")
        rows = rows.unionByName(met.drop("chunk").withColumnRenamed("other", "chunk"))
    return rows.withColumn("group", F.xxhash64("node", "chunk")).drop("chunk")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; a run may go over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is None or any(c[0] != x for c, x in zip(columns, last, strict=True))
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if new[a] and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
        last = [c[-1] for c in columns]
    if held:
        yield pa.Table.from_batches(held)


class Joined:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def agreement(signature: np.ndarray) -> np.ndarray:
    """In how many coordinates each two rows agree."""
    if len(signature) <= 16:
        return np.count_nonzero(signature[:, None, :] == signature[None, :, :], axis=2)
    out = np.zeros((len(signature),) * 2, np.uint8)
    for column in np.ascontiguousarray(signature.T):
        out += column[:, None] == column[None, :]
    return out.astype(np.int64)


def open_pairs(signature: np.ndarray, n: np.ndarray, component: np.ndarray, tree: int, small: np.ndarray, first: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, agreeing coordinates) of the pairs of a group that may be similar and aren't known to be connected.

    Pairs that met in a small node of an earlier tree (from ``first`` on) are left to it; the
    bits of ``small`` tell the trees in which a record's node is small. Records on one ``side``
    don't meet, unless it is negative.
    """
    agree = agreement(signature)
    fits = 100 * np.minimum(n[:, None], n[None, :]) >= SIMILAR_PCT * np.maximum(n[:, None], n[None, :])
    live = (agree >= AGREE) & fits & (component[:, None] != component[None, :])
    live &= (side[:, None] != side[None, :]) | (side[:, None] < 0)
    for t in range(first, tree):
        live &= ~((signature[:, None, t] == signature[None, :, t]) & (small >> t & 1).astype(bool)[:, None])
    i, j = np.nonzero(np.triu(live, 1))
    return i, j, agree[i, j]


def _clusters(rows: DataFrame, best_only: bool, first: int = 0) -> DataFrame:
    """(group, cluster, record, component) of the records of open pairs, linked by these within each group.

    ``rows`` has group, record, component, n, signature, tree and small, and may have side. With ``best_only``
    only the pairs of a heaviest forest over the known components count.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        names = ["group", "cluster", "record", "component"]

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for table in _by_key(batches, ["group"]):
            if table.num_rows < 2:
                continue
            plain = {c: table[c].to_numpy() for c in ("group", "record", "component", "n", "tree", "small", "side")}
            signature = np.concatenate([x.flatten().to_numpy() for x in table["signature"].chunks]).reshape(-1, COORDINATES)
            i, j, agree = open_pairs(signature, plain["n"], plain["component"], int(plain["tree"][0]), plain["small"], first, plain["side"])
            if not len(i):
                continue
            joined, touched = Joined(table.num_rows), set()
            if best_only:
                places = {c: k for k, c in enumerate(dict.fromkeys(plain["component"].tolist()))}
                of, whole = [places[c] for c in plain["component"].tolist()], Joined(len(places))
                for k in np.lexsort((j - i, -agree)).tolist():
                    a, b = int(i[k]), int(j[k])
                    if whole.join(of[a], of[b]):
                        joined.join(a, b)
                        touched |= {a, b}
            else:
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    joined.join(a, b)
                touched = {*i.tolist(), *j.tolist()}
            group, record, component = int(plain["group"][0]), plain["record"].tolist(), plain["component"].tolist()
            out.extend((group, joined.root(k), record[k], component[k]) for k in touched)
            if len(out) > 10_000:
                yield flush()
        yield flush()

    side = F.col("side") if "side" in rows.columns else F.lit(-1).alias("side")
    narrow = rows.select("group", "record", "component", "n", "signature", "tree", "small", side)
    dealt = narrow.repartition("group").sortWithinPartitions("group", "record")
    return dealt.mapInArrow(find, "group bigint, cluster bigint, record bigint, component bigint")


def overlaps(sets: list[np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """Sizes of the intersections of every two sets, from products of at most ``most`` cells."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[at] > 1
    column = (np.cumsum(counts > 1) - 1)[at[shared]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], owner[shared][order]
    width = max(1, most // len(sets))
    out = np.zeros((len(sets),) * 2, np.int64)
    for first in range(0, int(np.count_nonzero(counts > 1)), width):
        a, b = np.searchsorted(column, [first, first + width])
        cells = np.zeros((len(sets), width), np.float32)
        cells[row[a:b], column[a:b] - first] = 1
        out += (cells @ cells.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def similar_pairs(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(i, j), j < i, of all similar pairs by one product; for sets that are large in all, of those that may be by size."""
    sizes = np.array([len(s) for s in sets], np.int64)
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    live = 100 * low >= SIMILAR_PCT * high
    if sizes.sum() <= MATRIX:
        both = overlaps(sets)
        live &= 100 * both >= SIMILAR_PCT * (low + high - both)
    i, j = np.nonzero(np.tril(live, -1))
    return zip(i.tolist(), j.tolist(), strict=True)


def _confirmed(clusters: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(a, b): pairs of records whose whole sets are similar, enough of them to connect all that are, by cluster."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, ["group", "cluster"]):
            record = table["record"].to_pylist()
            hashes, per_text = shingle_hashes([t for chunk in table["text"].chunks for t in texts_of(chunk)], shingle)
            sets = [np.unique(x) for x in np.split(hashes, np.cumsum(per_text)[:-1])]
            joined, found, seen = Joined(len(sets)), [], {}
            for i, c in enumerate(table["component"].to_pylist()):  # what is known to be connected isn't compared again
                joined.join(i, seen.setdefault(c, i))
            sure = sum(len(x) for x in sets) <= MATRIX
            for i, j in similar_pairs(sets):
                if record[i] == record[j] or joined.root(i) == joined.root(j):
                    continue
                both = 0 if sure else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if sure or 100 * both >= SIMILAR_PCT * (len(sets[i]) + len(sets[j]) - both):
                    joined.join(i, j)
                    found.append((record[i], record[j]))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    asked = clusters.join(texts, "record").repartition("group", "cluster").sortWithinPartitions("group", "cluster", "record")
    return asked.mapInArrow(confirm, "a bigint, b bigint")


class _Links:
    """The links found so far and the components they make."""

    def __init__(self, docs: DataFrame, records: DataFrame, shingle: int) -> None:
        self.docs, self.records, self.shingle = docs, records, shingle
        self.spark = docs.sparkSession
        self.edges: list[DataFrame] = []
        self.roots = self.spark.createDataFrame([], "record bigint, root bigint")
        self.texts: DataFrame | None = None

    def fetch(self, wanted: DataFrame) -> None:
        """Store the texts of the wanted records that aren't stored yet."""
        wanted = wanted.select("record").distinct()
        if self.texts is not None:
            wanted = wanted.join(self.texts.select("record"), "record", "left_anti")
        keys = spool(self.records.join(wanted, "record").select("record", "k1", "k2"), "wanted")
        n = keys.count()
        if n or self.texts is None:
            found = self.docs.join(_near(keys, n), ["k1", "k2"]).groupBy("record").agg(F.first("text").alias("text"))
            found = spool(found, "texts")
            self.texts = found if self.texts is None else self.texts.unionByName(found)

    def confirm(self, clusters: DataFrame) -> None:
        clusters = spool(clusters, "clusters")
        if clusters.isEmpty():
            return
        self.fetch(clusters)
        found = spool(_confirmed(clusters, self.texts, self.shingle), "links")
        if found.isEmpty():
            return
        self.edges.append(found)
        every = self.edges[0]
        for more in self.edges[1:]:
            every = every.unionByName(more)
        self.roots = components(every).select(F.col("node").alias("record"), "root")

    def known(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of each record."""
        return rows.join(self.roots, "record", "left").withColumn("component", F.coalesce("root", "record")).drop("root")

    def mixed(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose ``key`` has members of more than one component."""
        of = spool(rows.groupBy(key).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select(key), "mixed")
        return rows.join(_near(of, of.count()), key, "left_semi")


    def parted(self, rows: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
        """The rows of dense nodes and of those of a few blocks, and the rows to branch, of the rows of large nodes."""
        few = F.col("size") <= BLOCKS * node
        rest = rows.where(~few)
        columns = ["node", "size", "record", "n", "signature"]
        if rest.isEmpty():
            return rows, rest.select(*columns)
        dense = _dense(rest, node)
        n = dense.count()
        settled = rows.where(few).unionByName(rest.join(_near(dense, n), "node", "left_semi").select(*rows.columns))
        return settled, rest.join(_near(dense, n), "node", "left_anti").select(*columns)


def _blocks(rows: DataFrame, node: int) -> DataFrame:
    """Large nodes block against block: every two of a node's members are in one group."""
    blocks = F.greatest(F.lit(2), F.ceil(F.col("size") * 2 / node))
    mine = F.pmod(F.xxhash64("record", F.lit(5)), blocks)
    others = F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    met = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    # a block alone is covered by each of its meetings
    return met.where("mine <> other").withColumn("group", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))).drop("mine", "other")


def _classified(rows: DataFrame, node: int) -> DataFrame:
    """(node, core, in_core, size, whole) of the nodes of ``rows`` with members of more than one component, stored.

    The core is the largest component; a node is ``whole`` where it can be compared exhaustively.
    """
    counts = rows.groupBy("node", "component").agg(F.count("*").alias("n"))
    of = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("components"))
    of = of.where("components > 1").select("node", F.col("top.component").alias("core"), F.col("top.n").alias("in_core"), "size")
    return spool(of.withColumn("whole", (F.col("size") <= node) | (F.col("size") - F.col("in_core") <= node)), "classified")


def _whole_groups(rows: DataFrame, node: int) -> DataFrame:
    """``rows`` of whole nodes with the ``group`` of each comparison: the core in chunks, all others in every chunk."""
    chunks = F.ceil(F.col("in_core") / node)
    chunk = (
        F.when(F.col("size") <= node, F.array(F.lit(0).cast("bigint")))
        .when(F.col("component") == F.col("core"), F.array(F.pmod(F.xxhash64("record", "node"), chunks)))
        .otherwise(F.sequence(F.lit(0).cast("bigint"), chunks - 1))
    )
    return rows.withColumn("chunk", F.explode(chunk)).withColumn("group", F.xxhash64("node", "chunk", F.lit(3)))


def _dense(large: DataFrame, node: int) -> DataFrame:
    """(node) of the large nodes whose open pairs agree in one of PATHS coordinates or more on average, stored.

    ``large`` has node, size, record, component and signature; an open pair has two components.
    The average is that of the pairs that share a chunk.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, ["node", "chunk"]):
            signature = np.concatenate([x.flatten().to_numpy() for x in table["signature"].chunks]).reshape(-1, COORDINATES)
            component = table["component"].to_numpy()
            live = component[:, None] != component[None, :]
            sums = [table["node"][0].as_py(), int(live.sum()), int(agreement(signature)[live].sum())]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names=["node", "pairs", "agreeing"])

    dealt = large.select("node", _chunk(node).alias("chunk"), "record", "component", "signature")
    dealt = dealt.repartition("node", "chunk").sortWithinPartitions("node", "chunk", "record")
    sums = dealt.mapInArrow(measure, "node bigint, pairs bigint, agreeing bigint").groupBy("node").agg(F.sum("pairs").alias("pairs"), F.sum("agreeing").alias("agreeing"))
    return spool(sums.where((F.col("pairs") > 0) & (F.col("agreeing") * PATHS >= F.col("pairs") * COORDINATES)).select("node"), "dense")


def _dense_groups(rows: DataFrame, node: int) -> DataFrame:
    """``rows`` of dense nodes with the ``group`` and ``side`` of each comparison.

    The core and the others are dealt into blocks; a block of others meets itself and every block.
    """
    others, cores = (F.ceil(n / (2 * node)) for n in (F.col("size") - F.col("in_core"), F.col("in_core")))
    in_core = F.col("component") == F.col("core")
    place = F.xxhash64("record", "node")
    mine = F.when(in_core, others + F.pmod(place, cores)).otherwise(F.pmod(place, others))
    met = F.sequence(F.lit(0).cast("bigint"), F.when(in_core, others).otherwise(others + cores) - 1)
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(met))
    group = F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"), F.lit(7))
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return rows.withColumn("group", group).withColumn("side", side).drop("mine", "other")


def set_links(docs: DataFrame, records: DataFrame, shingle: int = SHINGLE, node: int = NODE, depth: int = DEPTH) -> DataFrame:
    """(record, root): the smallest record that each linked record can reach.

    ``records`` has record, n, signature, first, k1 and k2, one row per different set; ``docs`` has
    k1, k2 and text.
    """
    links = _Links(docs, records, shingle)
    members = _root_nodes(records, node)
    members = members.select("record", "n", "signature", "small", F.explode("nodes").alias("at")).select("record", "n", "signature", "small", "at.*")

    huge = members.where(F.col("size") > node)
    hubs = None if huge.isEmpty() else _hubs(huge, node)

    def groups(condition: Column, filtered: bool) -> DataFrame:
        rows = _groups(links.known(members.where(condition)), hubs, node)
        return links.mixed(rows, "group") if filtered else rows

    every = F.lit(True)
    links.fetch(_clusters(groups(every, False), False))  # all that may be similar at all: one reading of the texts
    links.confirm(_clusters(groups(F.col("tree") == 0, False), False))
    links.confirm(_clusters(groups(F.col("tree") > 0, True), True, first=1))  # records that the first tree missed, by their best partners
    # what that left open: whole nodes at once, a pair in the first of its trees only
    nodes = _classified(links.known(members.select("node", "record")), node)
    at = members.select("record", "n", "signature", "tree", "node").join(_near(nodes, nodes.count()), "node")
    bits = at.groupBy("record").agg(F.sum(F.when(F.col("whole"), F.expr("shiftleft(1, tree)")).otherwise(0)).alias("small"))
    at = spool(links.known(at.join(bits, "record")), "open-nodes")
    links.confirm(_clusters(_whole_groups(at.where("whole"), node), False))
    dense, large = links.parted(at.where("not whole"), node)
    settled = at.where("whole").select("record", "tree").unionByName(dense.select("record", "tree"))
    bits = settled.groupBy("record").agg(F.sum(F.expr("shiftleft(1, tree)")).alias("small"))
    links.confirm(_clusters(_dense_groups(dense.drop("small").join(bits, "record"), node), False))
    for level in range(depth):
        if large.isEmpty():
            break
        if level == depth - 1:
            links.confirm(_clusters(_leaf_rows(links.mixed(_blocks(links.known(large), node), "group")), False))
            break
        one = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(COORDINATES)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(COORDINATES - 1)), F.lit(COORDINATES)).cast("int")
        paths = F.array(*[F.xxhash64("node", c, F.element_at("signature", c + 1)) for c in (one, two)])
        children = spool(large.select("record", "n", "signature", F.explode(paths).alias("node")), "branched")
        shared = _shared(children)
        children = children.join(_near(shared, shared.count()), "node")
        huge = children.where(F.col("size") > node)
        if not huge.isEmpty():
            rows = _groups(links.known(huge), _hubs(huge, node), node)
            links.confirm(_clusters(_leaf_rows(links.mixed(rows, "group")), True))
        nodes = _classified(links.known(children.select("node", "record")), node)
        at = spool(links.known(children.drop("size").join(_near(nodes, nodes.count()), "node")), "open-nodes")
        links.confirm(_clusters(_leaf_rows(_whole_groups(at.where("whole"), node)), False))
        dense, large = links.parted(at.where("not whole"), node)
        links.confirm(_clusters(_leaf_rows(_dense_groups(dense, node)), False))
    return links.roots


def _leaf_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tree", F.lit(0)).withColumn("small", F.lit(0))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, node: int = NODE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``.

    Documents whose sets of ``shingle``-word shingles have a Jaccard similarity of 0.8 or more
    are linked; a component is all that is reachable, named by its smallest doc_id, and that
    document is kept. A-Z are lower-cased. A text of fewer words is one shingle; without words
    (null and empty texts) the set is empty and linked with nothing. A null doc_id takes part but
    names no component; it is kept where its whole component has no id. Repeated rows are
    kept apart. Sets are compared as 64-bit hashes of their shingles. Extra columns are ignored.
    """
    source = take(docs, doc_id=doc_id, text=text)
    source = source.select("doc_id", "text", *[F.xxhash64(F.lit(seed), "doc_id", "text").alias(k) for seed, k in ((1, "k1"), (2, "k2"))])
    rows = spool(_described(source, shingle), "sets")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("best")
    records = rows.where("n > 0").groupBy("digest").agg(best, *[F.first(c).alias(c) for c in ("n", "signature", "first")])
    records = records.select("digest", F.col("best.doc_id").alias("least"), "best.k1", "best.k2", "n", "signature", "first")
    records = spool(records.withColumn("record", F.monotonically_increasing_id()), "records")
    roots = set_links(source.select("k1", "k2", "text"), records.select("record", "n", "signature", "first", "k1", "k2"), shingle, node)
    groups = spool(records.join(roots, "record", "left").select("digest", "least", F.coalesce("root", "record").alias("root")), "components")
    named = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of = spool(groups.join(named, "root").select("digest", "component_id"), "named")
    linked = rows.where("n > 0").join(of, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
