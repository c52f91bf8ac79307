"""Removal of repeated byte strings with suffix arrays by induced sorting.

Every 200-byte window belongs to one anchor, the least hashed 32-byte string inside it; equal
windows have equal anchors at equal places. So a text falls into pieces, one per anchor, each
the union of its windows. Pieces meet only under their anchor: anchors that occur once are
dropped, equal pieces are merged and counted, and the pieces that differ under one anchor are
dealt to shards, where a suffix array and its permuted common prefixes find the windows that
occur twice. No two texts are compared as wholes and no text leaves its document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import parts_for, quoted, take, text_slices, texts_of
from wattline.llm.induced import permuted_prefixes, suffix_array
from wattline.session import spool

LENGTH = 200
ANCHOR = 32
SLICE = 1 << 21  # positions per numpy pass; anchors are ranked by the hash bits above these
SHARD = 2 << 20  # bytes per suffix array
GROUP = 8192  # different pieces under one anchor, beyond which the anchor is widened
_BASE = 0x9E3779B97F4A7C15 | 1


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's odd base and of its inverse modulo 2**64."""
    n = SLICE + LENGTH + 1

    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, size, anchor place in the piece, anchor hash, piece hash) of each piece.

    ``data`` holds texts that end at ``ends``, at most SLICE + LENGTH bytes in all; ``start``
    counts from the first byte of ``data``.
    """
    n, width = len(data), LENGTH - ANCHOR + 1
    if n < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    up, down = _powers()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * up[:n], out=sums[1:])
    grams = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    low = np.uint64((1 << 22) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & low).astype(np.int64)  # of each window's anchor
    text = np.searchsorted(ends, np.arange(len(place)), side="right")
    whole = np.arange(len(place)) + LENGTH <= ends[text]
    new = np.empty(len(place), bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    ok = whole[first]
    first, last = first[ok], last[ok]
    stop = last + LENGTH
    piece = _mix((sums[stop] - sums[first]) * down[first] + (stop - first).astype(np.uint64))
    at = place[first]
    return text[first], first, stop - first, at - first, grams[at].view(np.int64), piece.view(np.int64)


def _passes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, ends, number of each text, offset of each text's part): texts joined up to SLICE bytes, longer ones in parts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        return data, np.cumsum([len(x) for _, _, x in held]), np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])

    for i, text in enumerate(texts):
        if len(text) < LENGTH:
            continue
        for start in range(0, len(text) - LENGTH + 1, SLICE // 2):
            part = text[start : start + SLICE // 2 + LENGTH - 1]
            if held and size + len(part) > SLICE:
                yield joined()
                held, size = [], 0
            held.append((i, start, part))
            size += len(part)
    if held:
        yield joined()


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, size, anchor place, anchor hash, piece hash) of the pieces of several texts."""
    found = []
    for data, ends, number, offset in _passes(texts):
        text, start, size, at, anchor, piece = anchors(data, ends)
        begin = np.concatenate(([0], ends[:-1]))
        found.append((number[text], start - begin[text] + offset[text], size, at, anchor, piece))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_windows(pieces: list[bytes], times: list[int]) -> list[list[int]]:
    """For each piece, [first, past the last, ...] of the runs of window starts found at least twice in all pieces.

    ``times`` says how often a piece occurs. Pieces are UTF-8, so bytes 0xFE and 0xFF are free:
    one ends every piece. A window that crosses an end has the mark inside and is not counted.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"\xfe".join(pieces) + b"\xfe", np.uint8) + 1
    symbols = np.append(data, 0).astype(np.int16)
    order = suffix_array(symbols, 256)
    _, prefixes = permuted_prefixes(symbols, order)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    owner = np.append(np.repeat(np.arange(len(pieces)), sizes + 1), len(pieces) - 1)
    inside = np.arange(len(symbols)) + LENGTH <= starts[owner] + sizes[owner]
    block = np.cumsum(prefixes[order] < LENGTH) - 1
    weight = np.where(inside, np.array(times, np.int64)[owner], 0)
    often = np.bincount(block, weights=weight[order]) >= 2
    hit = np.zeros(len(symbols) + 1, bool)
    hit[order] = often[block]
    hit[:-1] &= inside
    out = []
    for a, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit[a : a + size], [False])).astype(np.int8)))
        out.append(edges.tolist())
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the merged spans."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


# --- the Spark job ----------------------------------------------------------------------


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(anchor, piece, tid) of every piece of (tid, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE):
            tid = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            text, _, _, _, anchor, piece = pieces_of([t or b"" for t in texts_of(batch.column(1))])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(piece), pa.array(tid[text])], names=["anchor", "piece", "tid"])

    return texts.mapInArrow(rows, "anchor bigint, piece bigint, tid bigint")


_MARKED = "text string, n_bytes bigint, sure array<bigint>, open array<struct<anchor:bigint,piece:bigint,start:bigint,size:int,at:int>>"


def _keyed(rows: DataFrame, columns: str) -> T.StructType:
    """A schema of the key, whatever its type, and ``columns``."""
    return T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL(columns).fields])


def _mark(joined: DataFrame) -> DataFrame:
    """Per text: spans surely repeated, and the pieces that the suffix arrays must decide."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE):
            texts = [t or b"" for t in texts_of(batch.column(1))]
            sure, open_ = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            live = [i for i in range(len(texts)) if sure[i] or open_[i]]
            text, start, size, at, anchor, piece = pieces_of([texts[i] for i in live])
            spans: list[list[int]] = [[] for _ in texts]
            ask: list[list[dict]] = [[] for _ in texts]
            bounds = np.searchsorted(text, np.arange(len(live) + 1))
            for j, i in enumerate(live):
                mine = slice(bounds[j], bounds[j + 1])
                hit = np.isin(anchor[mine], np.array(sure[i] or [], np.int64))
                for a, b in _merged(list(zip(start[mine][hit].tolist(), (start[mine] + size[mine])[hit].tolist(), strict=True))):
                    spans[i] += (a, b)
                hit = np.flatnonzero(np.isin(anchor[mine], np.array(open_[i] or [], np.int64))) + bounds[j]
                ask[i] = [
                    {"anchor": int(anchor[k]), "piece": int(piece[k]), "start": int(start[k]), "size": int(size[k]), "at": int(at[k])} for k in hit
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(spans, pa.list_(pa.int64())),
                    pa.array(ask, pa.list_(pa.struct([("anchor", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("at", pa.int32())]))),
                ],
                names=["key", "text", "n_bytes", "sure", "open"],
            )

    return joined.mapInArrow(rows, _keyed(joined, _MARKED))


def _decide(pieces: DataFrame, parts: int) -> DataFrame:
    """(anchor, piece, runs) of the pieces (anchor, piece, n, content) with a repeated window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            runs = repeated_windows([x[3] for x in held], [x[2] for x in held])
            found = [(x[0], x[1], r) for x, r in zip(held, runs, strict=True) if r]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["anchor", "piece", "runs"])

        for batch in batches:
            for x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= SHARD and x[0] != held[-1][0]:  # an anchor's pieces stay together
                    yield done()
                    held, size = [], 0
                held.append(x)
                size += len(x[3]) + 1
        if held:
            yield done()

    dealt = pieces.select("anchor", "piece", "n", "content").repartition(parts, "anchor").sortWithinPartitions("anchor", "piece")
    return dealt.mapInArrow(rows, "anchor bigint, piece bigint, runs array<int>")


def _widened(hot: DataFrame, cell: int) -> DataFrame:
    """Pieces (root_anchor, root_piece, off, anchor, piece, at, n, content) cut by where the anchor stands in a window.

    Windows with the anchor ``d`` bytes in go by ``d // cell``. All windows of a cell share
    more than the anchor, and what they share is the new anchor.
    """
    d = F.col("q") * cell
    windows = F.length("content") - LENGTH
    lo = F.greatest(F.col("at") - d - (cell - 1), F.lit(0))
    hi = F.least(F.col("at") - d, windows)
    cells = F.sequence(F.lit(0), F.lit((LENGTH - ANCHOR) // cell))
    core = F.expr(f"substring(content, at - q * {cell} + 1, {LENGTH} - {cell} + 1)")
    cut_ = hot.withColumn("q", F.explode(cells)).withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi")
    cut_ = cut_.withColumn("part", F.expr(f"substring(content, lo + 1, hi - lo + {LENGTH})")).withColumn("core", core)
    return cut_.select(
        "root_anchor", "root_piece", (F.col("off") + F.col("lo")).alias("off"),
        F.xxhash64(F.lit(cell), "q", "anchor", "core").alias("anchor"),
        F.xxhash64(F.lit(cell), "part").alias("piece"), (F.col("at") - F.col("lo")).alias("at"), "n", F.col("part").alias("content"),
    )


def _repeats(open_pieces: DataFrame, group: int) -> DataFrame:
    """(anchor, piece, start, stop): spans of window starts in a piece that occur elsewhere.

    An anchor with more than ``group`` different pieces is widened, again and again, until each
    cell is one window wide, where equal anchor means equal window; so no group is unbounded
    and nothing is left out.
    """
    pieces = open_pieces.groupBy("anchor", "piece").agg(F.count("*").alias("n"), F.first("content").alias("content"), F.first("at").alias("at"))
    pieces = spool(pieces.select(F.col("anchor").alias("root_anchor"), F.col("piece").alias("root_piece"), F.lit(0).alias("off"), "anchor", "piece", "at", "n", "content"), "pieces")
    cell, found = LENGTH - ANCHOR + 1, []
    while True:
        distinct = pieces if not found else spool(
            pieces.groupBy("anchor", "piece").agg(F.sum("n").alias("n"), F.first("content").alias("content"), F.first("at").alias("at")), "pieces"
        )
        large = distinct.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > group).select("anchor")
        large = spool(large, "large-groups")
        last = cell == 1 or large.isEmpty()
        small = distinct if last else distinct.join(large, "anchor", "left_anti")
        bytes_ = small.agg(F.sum(F.length("content"))).first()[0] or 0
        runs = spool(_decide(small, parts_for(bytes_, 2 * SHARD)), "runs")
        pairs = runs.select("anchor", "piece", F.explode(F.expr("transform(sequence(0, cast(size(runs) / 2 as int) - 1), i -> struct(runs[2 * i] as a, runs[2 * i + 1] as b))")).alias("r"))
        back = pieces.select("root_anchor", "root_piece", "off", "anchor", "piece").join(pairs, ["anchor", "piece"])
        found.append(back.select(F.col("root_anchor").alias("anchor"), F.col("root_piece").alias("piece"), (F.col("off") + F.col("r.a")).alias("a"), (F.col("off") + F.col("r.b")).alias("b")))
        if last:
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out
        cell = (cell + 1) // 2
        pieces = spool(_widened(pieces.join(large, "anchor"), cell), "pieces")


def _finish(rows: DataFrame, texts: bool) -> DataFrame:
    """Removal of the spans ``sure`` and ``runs`` from each text."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            out = []
            for text, sure, runs in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text or b""
                spans = [(sure[i], sure[i + 1]) for i in range(0, len(sure), 2)]
                spans = _merged(spans + [(x["a"], x["b"] - 1 + LENGTH) for x in runs or []])
                kept = cut(raw, spans) if spans else raw
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts and text is not None else None))
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    columns = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string"
    return rows.select("key", "text", "sure", "runs").mapInArrow(remove, _keyed(rows, columns))


def removal(keyed: DataFrame, texts: bool = False, group: int = GROUP) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless ``texts``) from (key, text).

    The key is only carried along and needn't be unique.

    A remaining text whose cut falls inside a multi-byte character loses that character's
    remaining bytes in kept_text; kept_sha256 and the counts are over the exact bytes.
    """
    keyed = keyed.withColumn("tid", F.xxhash64("text"))
    rows = spool(_anchor_rows(keyed.select("tid", "text")), "anchors")
    seen = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("piece").alias("lo"), F.max("piece").alias("hi")).where("n > 1")
    # stored, so that both sides of the join have a shuffle of their own and a hot anchor's can be split
    seen = spool(seen.select("anchor", (F.col("lo") == F.col("hi")).alias("one")), "repeated-anchors")
    hits = rows.join(seen, "anchor").select("tid", "anchor", "one").distinct()
    asked = hits.groupBy("tid").agg(
        F.collect_list(F.when(F.col("one"), F.col("anchor"))).alias("sure"), F.collect_list(F.when(~F.col("one"), F.col("anchor"))).alias("open")
    )
    marked = _mark(keyed.join(asked, "tid", "left").select("key", "text", "sure", "open"))
    marked = spool(marked.withColumn("row", F.monotonically_increasing_id()), "marked")
    undecided = marked.where(F.size("open") > 0)
    asks = undecided.select("row", "text", F.explode("open").alias("o")).select("row", "o.*", F.expr("substring(cast(text as binary), cast(o.start as int) + 1, o.size)").alias("content"))
    runs = spool(_repeats(asks, group), "repeats")
    of = undecided.select("row", F.explode("open").alias("o")).select("row", "o.anchor", "o.piece", "o.start").join(runs, ["anchor", "piece"])
    of = of.groupBy("row").agg(F.collect_list(F.struct((F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))).alias("runs"))
    return _finish(marked.join(of, "row", "left"), texts)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of ``docs``.

    Every byte that a 200-byte string covers which also starts elsewhere, in the same text or
    another, is removed; strings are judged on the input. A null text counts as empty. Repeated
    rows are separate texts, so whole copies of 200 bytes and more are removed from each other.
    Extra columns are ignored.
    """
    found = removal(take(docs, key=doc_id, text=text), group=group)
    return found.select(F.col("key").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, text: str = "text", group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` with the repeated bytes cut from ``text``; other columns stay.

    A cut inside a character takes the rest of the character along.
    """
    others = [F.col(quoted(c)) for c in docs.columns if c != text]
    key = F.struct(*others) if others else F.lit(0)
    cuts = removal(docs.select(key.alias("key"), F.col(quoted(text)).alias("text")), texts=True, group=group)
    return cuts.select(*[F.col("kept_text").alias(c) if c == text else F.col("key").getField(c).alias(c) for c in docs.columns])
