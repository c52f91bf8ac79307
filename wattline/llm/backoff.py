"""Language-model scores by a weighted backoff automaton over words.

States are the empty history, the start of a text and every trained word. A trained pair of
words is an arc with the smoothed probability of the second after the first; every state has a
failure arc with the weight that smoothing leaves to the empty history, whose arcs are the
single words. One pass from left to right carries the state and adds up weights.

Counts grow with the corpus, so no task holds the whole automaton: documents are dealt into
blocks, each block asks for the n-grams it contains, and hash ranges of the n-grams add up the
training counts and answer every block with exactly the part of the automaton that it walks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import held_out, parts_for, take, text_bytes, texts_of

FOLDS, FOLD = 7, 2
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 12 << 20  # text per hash range of n-grams
SMOOTHING = 300.0  # weight of the single words in a history, in occurrences
_BASE = 0x9E3779B97F4A7C15 | 1
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PART = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each word of ``data``, which ends with a space."""
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, stops = edge[0::2], edge[1::2]
    out = np.zeros(len(starts), np.uint64)
    size = stops - starts
    live = np.arange(len(starts))
    for k in range(int(size.max(initial=0))):  # byte by byte over the words that are long enough
        live = live[size[live] > k]
        if len(live) < 64:
            break
        out[live] = out[live] * np.uint64(_BASE) + data[starts[live] + k].astype(np.uint64) + np.uint64(1)
    else:
        live = live[:0]
    done = k if len(live) else 0
    for i in live.tolist():  # the few very long words
        value = int(out[i])
        for byte in data[starts[i] + done : stops[i]].tolist():
            value = (value * _BASE + byte + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = value
    return starts, _mix(out + size.astype(np.uint64))


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, tokens per text): the words of each text, A-Z lower-cased, and one end each."""
    words, counts, held, size = [], [], [], 0

    def flush() -> None:
        nonlocal held, size
        data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        starts, found = _word_hashes(data)
        ends = np.cumsum([len(t) + 1 for t in held])
        words.append(found)
        counts.append(np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(held)))
        held, size = [], 0

    for text in texts:
        held.append((text or b"").lower())
        size += len(held[-1]) + 1
        if size >= _PART:
            flush()
    if held:
        flush()
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    out = np.full(int(n.sum()) + len(n), _END)
    out[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return out, n + 1


def pairs(hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history of each token, hash of the pair): the word before, or the start of the text."""
    history = np.empty_like(hashes)
    history[1:] = hashes[:-1]
    history[(np.cumsum(per_text) - per_text)[per_text > 0]] = _START
    return history, _mix(history * np.uint64(0xD6E8FEB86659FD93) + hashes)


class Walk:
    """The n-grams of a block, in the order in which they are asked for and answered."""

    def __init__(self, texts: list[bytes | None]) -> None:
        self.hashes, self.per_text = tokens(texts)
        self.history, self.pair = pairs(self.hashes, self.per_text)
        self.words, word_at = np.unique(np.concatenate((self.hashes, [_START])), return_inverse=True)
        self.word_at = word_at[:-1]
        self.grams, self.gram_at = np.unique(self.pair, return_inverse=True)

    def counts(self, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of words and of pairs in the texts to learn from; the start counts as a history only."""
        take_ = np.repeat(learn, self.per_text)
        words = np.bincount(self.word_at[take_], minlength=len(self.words))
        words[np.searchsorted(self.words, _START)] += int(learn.sum())
        return words, np.bincount(self.gram_at[take_], minlength=len(self.grams))

    def score(self, words: np.ndarray, grams: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, base score, automaton score) of each text, in log10."""
        z = total + distinct + 1
        single = np.log10((words + 1) / z)  # arcs of the empty history; an unseen word shares one
        failure = np.log10(SMOOTHING / (words + SMOOTHING))
        state = np.searchsorted(self.words, self.history)
        arc = grams[self.gram_at]
        step = np.where(
            arc > 0,
            np.log10((arc + SMOOTHING * (words[self.word_at] + 1) / z) / (words[state] + SMOOTHING)),
            failure[state] + single[self.word_at],
        )
        starts = np.cumsum(self.per_text) - self.per_text

        def by_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, starts) if len(x) else np.zeros(0, x.dtype)

        known = words[self.word_at] > 0
        return by_text(known.astype(np.int64)), by_text(single[self.word_at]), by_text(step)


def _packed(values: np.ndarray) -> bytes:
    """Integers as bytes, high ones together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel()


def _ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` equal hash ranges begins and ends in sorted ``keys``."""
    width = (1 << 64) // n + 1
    return np.append(np.searchsorted(keys, np.array([i * width for i in range(n)], np.uint64)), len(keys))


def backoff_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of ``docs``.

    Learns from documents whose crc32(doc_id as text) mod ``folds`` isn't ``fold``; a null id is
    learned from. A null or empty text has only its end. Repeated rows are learned as often as
    they occur. Without a training document every token is unknown. Extra columns are ignored.
    """
    rows = take(docs, doc_id=doc_id, text=text)
    size = text_bytes(rows, "text")
    blocks, ranges = parts_for(size, BLOCK_BYTES), parts_for(size, RANGE_BYTES)
    spread = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    rows = rows.select(F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), "doc_id", "text", held_out(F.col("doc_id"), folds, fold).alias("held_out"))

    def in_order(table: pa.Table) -> tuple[pa.Table, list[bytes | None], np.ndarray]:
        texts = [t for chunk in table["text"].chunks for t in texts_of(chunk)]
        return table, texts, ~table["held_out"].to_numpy()

    def ask(table: pa.Table) -> pa.Table:
        _, texts, learn = in_order(table)
        walk = Walk(texts)
        words, grams = walk.counts(learn)
        w, g = _ranges(walk.words, ranges), _ranges(walk.grams, ranges)
        out = []
        for r in range(ranges):
            a, b = slice(w[r], w[r + 1]), slice(g[r], g[r + 1])
            keys = [_packed(np.diff(k, prepend=np.uint64(0))) for k in (walk.words[a], walk.grams[b])]
            out.append((r, *keys, _packed(words[a]), _packed(grams[b])))
        block = table["block"][0].as_py()
        return pa.table({"block": pa.array([block] * ranges, pa.int32()), **{c: pa.array(v, t) for c, v, t in zip(("range", "words", "grams", "word_n", "gram_n"), zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)}})

    def answer(table: pa.Table) -> pa.Table:
        out = {}
        total = distinct = 0
        for keys, counts in (("words", "word_n"), ("grams", "gram_n")):
            asked = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table[keys].to_pylist()]
            n = np.concatenate([_unpacked(x) for x in table[counts].to_pylist()]).astype(np.int64)
            known, at = np.unique(np.concatenate(asked), return_inverse=True)
            sums = np.zeros(len(known), np.int64)
            np.add.at(sums, at, n)
            if keys == "words":
                tokens_ = sums[known != _START]
                total, distinct = int(tokens_.sum()), int((tokens_ > 0).sum())
            cuts = np.cumsum([len(x) for x in asked])[:-1]
            out[counts] = pa.array([_packed(x) for x in np.split(sums[at], cuts)], pa.binary())
        m = table.num_rows
        return pa.table({"block": table["block"], "range": table["range"], **out, "total": pa.array([total] * m, pa.int64()), "distinct": pa.array([distinct] * m, pa.int64())})

    def walk_block(table: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts, _ = in_order(table)
        walk = Walk(texts)
        answers = answers.sort_by("range")
        words, grams = (np.concatenate([_unpacked(x) for x in answers[c].to_pylist()]).astype(np.int64) for c in ("word_n", "gram_n"))
        if len(words) != len(walk.words) or len(grams) != len(walk.grams):
            raise RuntimeError("The input gave other rows when read again; store it before scoring.")
        total, distinct = sum(answers["total"].to_pylist()), sum(answers["distinct"].to_pylist())
        known, base, score = walk.score(words, grams, total, distinct)
        return pa.table(
            {
                "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": walk.per_text.astype(np.int64), "n_known": known,
                "train_tokens": pa.array([total] * table.num_rows, pa.int64()), "base_score": base, "score": score,
            }
        )

    asked = rows.groupBy("block").applyInArrow(ask, "block int, range int, words binary, grams binary, word_n binary, gram_n binary")
    answers = asked.groupBy("range").applyInArrow(answer, "block int, range int, word_n binary, gram_n binary, total bigint, distinct bigint")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk_block, schema)
