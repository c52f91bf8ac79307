"""A code-point n-gram model that grows with the corpus, and the score it gives each text.

All n-grams of one to ORDER code points are counted, A-Z and other letters lower-cased, with
marks for the start and the end of a text. Each order is smoothed towards the one below. The
occurrence that is scored is taken out of its counts, so that a text can't vouch for itself.

No task holds the whole model: texts are dealt into blocks, each block asks for the n-grams it
contains, and hash ranges of the n-grams add up the counts and answer every block in sorted
hash arrays, as in ``backoff``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.backoff import _mix, _packed, _ranges, _unpacked
from wattline.llm.common import parts_for, texts_of

ORDER = 4
SMOOTHING = 5.0  # weight of the order below in a context, in occurrences
BLOCK_BYTES = 4 << 20
RANGE_BYTES = 16 << 20  # text per hash range of n-grams
_START, _END = 0x110000, 0x110001
_POINTS = 0x110002
_DENSE = 1 << 23  # pairs of numbers up to here are numbered by a table, others by a sort
_EMPTY = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def points(text: bytes) -> np.ndarray:
    """The code points of a text, lower-cased, each ASCII white space as a space."""
    out = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.int32)
    out[(out >= 9) & (out <= 13)] = 32
    return out


def _numbered(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(different keys in order, the place of each key among them)."""
    if below > _DENSE:
        found, at = np.unique(keys, return_inverse=True)
        return found, at.astype(np.int32)
    there = np.zeros(below, bool)
    there[keys] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[keys]


class Block:
    """The n-grams of the texts of a block: sorted hashes, and where each position finds its own."""

    def __init__(self, texts: list[bytes | None]) -> None:
        found = [points(t or b"") for t in texts]
        self.sizes = np.array([len(x) + 1 for x in found], np.int64)
        pad, end = np.full(ORDER - 1, _START, np.int32), np.array([_END], np.int32)
        seq = np.concatenate([part for x in found for part in (pad, x, end)])
        ends = np.cumsum(self.sizes + ORDER - 1)
        self.scored = np.ones(len(seq), bool)
        for k in range(ORDER - 1):
            self.scored[ends - self.sizes - 1 - k] = False
        counted = self.scored.copy()
        counted[ends - self.sizes - 1] = True  # the last start mark is a context
        chars, first = _numbered(seq, _POINTS)
        hashes = [_mix(chars.astype(np.uint64) + np.uint64(1))]
        self.at, n = [first], [np.bincount(first[counted], minlength=len(chars))]
        for _ in range(ORDER - 1):
            before = self.at[-1]
            keys = np.roll(before, 1).astype(np.int64) * len(chars) + first
            grams, at = _numbered(keys, len(hashes[-1]) * len(chars))
            hashes.append(_mix(hashes[-1][grams // len(chars)] * _ODD + hashes[0][grams % len(chars)]))
            self.at.append(at)
            n.append(np.bincount(at[counted], minlength=len(grams)))
        self.cuts = np.cumsum([len(h) for h in hashes])
        every = np.concatenate([*hashes, [_EMPTY]])
        self.order = np.argsort(every, kind="stable")
        self.keys = every[self.order]
        self.counts = np.concatenate([*n, [int(self.scored.sum())]])[self.order]

    def nats(self, answered: np.ndarray) -> np.ndarray:
        """Mean negative log probability per code point and end of each text, given the counts of ``keys``."""
        counts = np.empty(len(answered))
        counts[self.order] = answered
        *grams, total = np.split(counts, self.cuts)
        here = np.flatnonzero(self.scored)
        prob = np.full(len(here), 1 / _POINTS)
        context = np.full(len(here), total[0] - 1)
        for n, at in zip(grams, self.at, strict=True):
            prob *= SMOOTHING
            prob += n[at[here]] - 1
            prob /= context + SMOOTHING
            context = n[at[here - 1]] - 1
        return (-np.add.reduceat(np.log(prob), np.cumsum(self.sizes) - self.sizes) / self.sizes).round(9)


def point_scores(rows: DataFrame, text: str, name: str, size: int) -> DataFrame:
    """``rows`` with their score in nats per code point, null for a null or empty text, in place of the text.

    ``size`` is the bytes of all texts. A block sends a row only to the ranges it has n-grams
    of, so the rows exchanged are at most the n-grams of all blocks.
    """
    blocks, ranges = parts_for(size, BLOCK_BYTES), parts_for(size, RANGE_BYTES)
    spread = F.pmod(F.xxhash64(text, F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    dealt = rows.withColumn(name, spread)

    def texts_in(table: pa.Table) -> list[bytes | None]:
        return [t for chunk in table[text].chunks for t in texts_of(chunk)]

    def ask(table: pa.Table) -> pa.Table:
        block = Block(texts_in(table))
        cut = _ranges(block.keys, ranges)
        there = np.flatnonzero(np.diff(cut)).tolist()
        parts = [slice(cut[r], cut[r + 1]) for r in there]
        return pa.table(
            {
                "block": pa.array([table[name][0].as_py()] * len(there), pa.int32()),
                "range": pa.array(there, pa.int32()),
                "keys": pa.array([_packed(np.diff(block.keys[p], prepend=np.uint64(0))) for p in parts], pa.binary()),
                "n": pa.array([_packed(block.counts[p]) for p in parts], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        asked = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table["keys"].to_pylist()]
        n = np.concatenate([_unpacked(x) for x in table["n"].to_pylist()]).astype(np.int64)
        known, at = np.unique(np.concatenate(asked), return_inverse=True)
        sums = np.zeros(len(known), np.int64)
        np.add.at(sums, at, n)
        cuts = np.cumsum([len(x) for x in asked])[:-1]
        return pa.table({"block": table["block"], "range": table["range"], "n": pa.array([_packed(x) for x in np.split(sums[at], cuts)], pa.binary())})

    kept = [f for f in rows.schema.fields if f.name != text]

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_in(table)
        block = Block(texts)
        counts = np.concatenate([_unpacked(x) for x in answers.sort_by("range")["n"].to_pylist()]).astype(np.int64)
        if len(counts) != len(block.keys):
            raise RuntimeError("The input gave other rows when read again; store it before scoring.")
        nats = pa.array(block.nats(counts), mask=np.array([not t for t in texts]))
        return table.select([f.name for f in kept]).append_column(name, nats)

    asked = dealt.groupBy(name).applyInArrow(ask, "block int, range int, keys binary, n binary")
    answers = asked.groupBy("range").applyInArrow(answer, "block int, range int, n binary")
    out = T.StructType([*kept, T.StructField(name, T.DoubleType())])
    return dealt.groupBy(name).cogroup(answers.groupBy("block")).applyInArrow(score, out)
