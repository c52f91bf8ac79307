"""Best-fit packing of documents into sequences of a fixed length, with conflicts.

Documents are cut into pieces of at most ``capacity`` bytes (tokens of a byte-level model).
Pieces are dealt at random into shards of bounded size; within a shard they are placed in
order of falling size into the tightest open bin that holds no piece of the same source and
none of the same duplicate cluster.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import parts_for, take
from wattline.session import spool

CAPACITY = 8192
SHARD_PIECES = 20_000
# Bits of each bitmap. Two sources or clusters on one bit count as a conflict, which can cost
# tightness but never puts what must stay apart together.
BITMAP = 256


class OpenBins:
    """Bins ordered by residual space, with the bitmaps of what every bin below a node shares.

    A tree over the residuals 0..capacity keeps, per node, the AND of its bins' bitmaps. A
    piece that conflicts with the AND conflicts with every bin below, so the successor search
    passes the whole subtree; else it goes on until it meets the tightest compatible bin.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.shared: list[int] = [-1] * (2 * self.size)  # -1: all bits, no bin
        self.at: list[dict[int, int]] = [{} for _ in range(capacity + 1)]  # residual: bin -> bitmap

    def _update(self, residual: int) -> None:
        value = -1
        for bits in self.at[residual].values():
            value &= bits
        node, shared = residual + self.size, self.shared
        while shared[node] != value:
            shared[node] = value
            node >>= 1
            if not node:
                break
            value = shared[2 * node] & shared[2 * node + 1]

    def put(self, residual: int, bin_: int, bits: int) -> None:
        self.at[residual][bin_] = bits
        self._update(residual)

    def take(self, size: int, bits: int) -> tuple[int, int, int] | None:
        """(residual, bin, bitmap) of the tightest bin with ``size`` left and no bit of ``bits``, removed from here."""
        node, shared = size + self.size, self.shared
        while True:
            if shared[node] >= 0 and not shared[node] & bits:
                if node >= self.size:
                    residual = node - self.size
                    for bin_, held in self.at[residual].items():
                        if not held & bits:
                            del self.at[residual][bin_]
                            self._update(residual)
                            return residual, bin_, held
                else:
                    node *= 2
                    continue
            while node & 1:  # on to the next subtree on the right
                node >>= 1
                if node <= 1:
                    return None
            node += 1


def pack(sizes: list[int], bitmaps: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, start within the bin) of each piece, placed in the given order. Sizes are 1..capacity."""
    bins, n, out = OpenBins(capacity), 0, []
    for size, bits in zip(sizes, bitmaps, strict=True):
        found = bins.take(size, bits)
        if found is None:
            found = (capacity, n, 0)
            n += 1
        residual, bin_, held = found
        out.append((bin_, capacity - residual))
        bins.put(residual - size, bin_, held | bits)
    return out


def _bit(number: int, low: int) -> int:
    return 0 if number < 0 else 1 << (low + number)


def pack_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY
) -> DataFrame:
    """doc_id, piece, text_start, n_tokens, bin_id, bin_start; one row per piece.

    ``piece`` counts from 0 in a document, ``text_start`` is its first byte there and
    ``bin_start`` its first place in its bin. A null or empty text has one row with n_tokens 0
    and a null bin. A duplicate cluster is the texts that are equal after lower-casing and
    folding of white space; a document's own pieces form part of it, so they get bins of their
    own. A null source conflicts with nothing. Repeated rows are separate documents. Bins
    depend on how the input is split, sizes and totals don't. Extra columns are ignored.
    """
    rows = take(docs, doc_id=doc_id, text=text, source=source)
    cluster = F.xxhash64(F.lower(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    rows = rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        # Bit numbers, so that no null or wide integer has to reach Python.
        F.when(F.col("source").isNull(), -1).otherwise(F.pmod(F.xxhash64("source"), F.lit(BITMAP))).cast("int").alias("source"),
        F.pmod(cluster, F.lit(BITMAP)).cast("int").alias("cluster"),
        F.monotonically_increasing_id().alias("row"),
    )
    last = F.greatest(F.ceil(F.col("bytes") / capacity) - 1, F.lit(0))
    pieces = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    pieces = spool(
        pieces.withColumn("text_start", F.col("piece") * capacity).withColumn(
            "n_tokens", F.least(F.col("bytes") - F.col("text_start"), F.lit(capacity).cast("bigint"))
        ),
        "pieces",
    )
    shards = parts_for(pieces.count(), SHARD_PIECES)
    dealt = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("row", "piece"), F.lit(shards)))

    def place(key: tuple, part: pa.Table) -> pa.Table:  # Arrow keeps ids exact beside null ones
        part = part.sort_by([("n_tokens", "descending"), ("row", "ascending"), ("piece", "ascending")])
        pairs = zip(part["source"].to_pylist(), part["cluster"].to_pylist(), strict=True)
        where = pack(part["n_tokens"].to_pylist(), [_bit(s, 0) | _bit(c, BITMAP) for s, c in pairs], capacity)
        first = key[0].as_py() << 32
        part = part.select(["doc_id", "piece", "text_start", "n_tokens"])
        part = part.append_column("bin_id", pa.array([first + b for b, _ in where], pa.int64()))
        return part.append_column("bin_start", pa.array([s for _, s in where], pa.int64()))

    kind = dealt.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece bigint, text_start bigint, n_tokens bigint, bin_id bigint, bin_start bigint"
    packed = dealt.select("shard", "doc_id", "row", "source", "cluster", "piece", "text_start", "n_tokens").groupBy("shard").applyInArrow(place, columns)
    empty = pieces.where("n_tokens = 0").select(
        "doc_id", "piece", "text_start", "n_tokens", F.lit(None).cast("bigint").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_start")
    )
    return packed.unionByName(empty)
