"""SimHash near duplicates by deletion-variant signatures.

A fingerprint is cut into ``radius`` segments, one fewer than the pigeonhole cut that needs
an equal segment. Two fingerprints that differ in at most ``radius`` bits then agree in some
segment up to one bit, so each segment is indexed once per wildcard position and equal
variants are joined and verified. Only distinct fingerprints are indexed: copies of a text
cost one row each and never a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import columns_of, fresh, parts_for, quoted, take, text_slices, texts_of
from wattline.session import spool

RADIUS = 2
SHINGLE = 3
SEED = 42
BITS = 64
# Distinct fingerprints under one variant beyond which its pairs are found by one-bit flips.
BUCKET = 64
TASK_PRINTS = 16_384  # fingerprints whose variants one task makes
BROADCAST_KEYS = 1_000_000  # shared variants (8 bytes each) that may be broadcast


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of the lower-cased words' shingles, repeats included; 0 without a word."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    else:
        whole = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter(
            (digest(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1
        )
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of each whole text in column ``name``."""
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            prints = pa.array([fingerprint(t, shingle, seed) for t in texts_of(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)])
    return docs.mapInArrow(add, schema)


def _variants(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, key): each segment with each of its bits left out, tagged with segment and bit."""
    width = BITS // radius
    keys = []
    for s in range(radius):
        low = s * width
        size = width if s < radius - 1 else BITS - low
        mask = ((1 << size) - 1) << low
        for bit in range(low, low + size):
            wild = mask & ~(1 << bit)
            signed = wild - (1 << 64) if wild >= 1 << 63 else wild
            keys.append(F.xxhash64(F.lit(bit), F.col("fp").bitwiseAND(F.lit(signed).cast("bigint"))))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def _pairs(rows: DataFrame, radius: int) -> DataFrame:
    a, b = rows.select(F.col("fp").alias("a"), "key"), rows.select(F.col("fp").alias("b"), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints ``fp`` that differ in at most ``radius`` bits.

    ``radius`` is 1 or 2. A variant that more than ``bucket`` fingerprints share is never
    paired within itself; its members meet at full-width values one flipped bit away from
    each. At most 65 distinct fingerprints lie around such a value, whatever the data, and
    two fingerprints within two bits always have one in common, so nothing is lost.
    """
    if radius not in (1, 2):
        raise ValueError("the one-bit flips that replace large buckets are exact for a radius of 1 or 2")
    prints = spool(prints.select("fp"), "prints")
    variants = _variants(prints.repartition(parts_for(prints.count(), TASK_PRINTS), "fp"), radius)
    sizes = variants.groupBy("key").agg(F.count("*").alias("n"))
    shared = spool(sizes.where("n > 1"), "variant-sizes")
    keys = shared.where(F.col("n") <= bucket).select("key")
    # few variants are shared: while they are counted few, the others are dropped before the shuffle
    near = F.broadcast if shared.count() <= BROADCAST_KEYS else lambda side: side
    kept = variants.join(near(keys), "key")
    found = _pairs(kept, radius)
    large = shared.where(F.col("n") > bucket).select("key")
    if not large.isEmpty():
        members = variants.join(near(large), "key").select("fp").distinct()
        flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("bigint")) for i in range(BITS)]]
        around = members.select("fp", F.explode(F.array(*flips)).alias("key"))
        found = found.unionByName(_pairs(around, radius))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node can reach.

    Alternates large-star and small-star rounds, each written to shared storage, until the
    edges no longer change; the rounds grow with the logarithm of the longest chain.
    """
    edges = spool(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = spool(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Fingerprints that differ in at most ``radius`` bits link their documents; a component is
    everything reachable. Null and empty texts have fingerprint zero and are linked like
    others. A null doc_id takes part but never names a component; a component of null ids
    only has a null id. Repeated rows are kept. Extra columns are ignored.
    """
    rows = with_fingerprint(take(docs, doc_id=doc_id, text=text), "text", "fp").select("doc_id", "fp")
    rows = spool(rows, "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints.select("fp"), radius))
    groups = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    groups = spool(groups, "groups")
    named = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    of = groups.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` less all but one of each near-duplicate component.

    The row with the smallest (doc_id, fingerprint, text digest) stays, nulls last; of rows
    with one id and text one stays. Columns are those of ``docs``.
    """
    k1, k2, nth = (fresh(docs, x) for x in ("k1", "k2", "nth"))
    key = [F.xxhash64(F.lit(seed), quoted(doc_id), quoted(text)) for seed in (1, 2)]  # 128 bits of id and text
    rows = with_fingerprint(take(docs, doc_id=doc_id, text=text), "text", "fp")
    rows = spool(rows.select("doc_id", "fp", *[F.xxhash64(F.lit(seed), "doc_id", "text").alias(c) for seed, c in ((1, "k1"), (2, "k2"))]), "fingerprints")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp", "k1", "k2"))
    prints = rows.groupBy("fp").agg(best.alias("best"))
    roots = components(links(prints.select("fp"), radius))
    stay = (
        prints.join(roots, prints["fp"] == roots["node"], "left")
        .groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.k1").alias(k1), F.col("best.k2").alias(k2))
    )
    # one row per component: the list grows with the documents, so it is never broadcast
    kept = docs.withColumns({k1: key[0], k2: key[1]}).join(stay.hint("merge"), [k1, k2], "left_semi")
    one = Window.partitionBy(k1, k2).orderBy(F.xxhash64(*columns_of(docs)))
    return kept.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*columns_of(docs))
