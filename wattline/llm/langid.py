"""Language identification with a byte convolutional network trained in numpy.

Filters of several widths slide over one-hot bytes, the strongest answer of each filter over a
window feeds a softmax over the languages. The network is fitted on a bounded sample of the
labelled texts and applied to every fixed-length window of every whole text; a text's language
has the greatest mean log probability over its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import held_out, take, text_slices, texts_of

FOLDS, FOLD = 4, 2
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
# The sample to fit on: so many texts per language, the first by a hash of their id, and so many
# bytes of each, from its middle.
PER_LANGUAGE = 300
SAMPLE_BYTES = 512
EPOCHS = 20
BATCH = 64
RATE = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows(text: bytes) -> np.ndarray:
    """The whole text in rows of WINDOW bytes; the last is filled up with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class ByteNetwork:
    """Filters by width (width, 256, FILTERS), their offsets, and the softmax layer."""

    labels: list[str]
    filters: list[np.ndarray]
    offsets: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def new(labels: list[str], seed: int = 0) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        weights = rng.normal(0, 0.2, (n, len(labels))).astype(np.float32)
        return ByteNetwork(labels, filters, np.zeros(n, np.float32), weights, np.zeros(len(labels), np.float32))

    def pair_tables(self) -> list[list[np.ndarray]]:
        """For each width, tables over two bytes (and one for an odd last byte) whose sum is the filter's answer."""
        out = []
        for f in self.filters:
            parts = [(f[j][:, None] + f[j + 1][None]).reshape(65536, FILTERS) for j in range(0, len(f) - 1, 2)]
            out.append(parts + ([f[-1]] if len(f) % 2 else []))
        return out

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """The greatest answer of each filter in each window."""
        two = x[:, :-1].astype(np.int32) << 8
        two |= x[:, 1:]
        out = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            n = WINDOW - width + 1
            total = parts[0][two[:, :n]]
            for k, table in enumerate(parts[1:], 1):
                index = two if len(table) > 256 else x
                total += table[index[:, 2 * k : 2 * k + n]]
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def log_softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.offsets, 0) @ self.weights + self.bias
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> None:
        """Adam on the cross entropy; the gradient of a pooled answer goes to the bytes that gave it."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.offsets, self.weights, self.bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        columns = np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                bytes_, truth = x[rows], y[rows]
                pooled, places = [], []
                for f in self.filters:
                    n = WINDOW - len(f) + 1
                    total = sum(f[j][bytes_[:, j : j + n]] for j in range(len(f)))
                    places.append(total.argmax(axis=1))
                    pooled.append(total.max(axis=1))
                pool = np.concatenate(pooled, axis=1)
                hidden = np.maximum(pool + self.offsets, 0)
                error = np.exp(self.log_softmax(pool))
                error[np.arange(len(rows)), truth] -= 1
                error /= len(rows)
                back = (error @ self.weights.T) * (hidden > 0)
                grads = [np.zeros_like(f) for f in self.filters]
                for k, (g, place) in enumerate(zip(grads, places, strict=True)):
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(g)):
                        np.add.at(g[j], (np.take_along_axis(bytes_, place + j, axis=1), columns[None, :]), part)
                grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def predict(self, texts: list[bytes], tables: list[list[np.ndarray]], batch: int = 128) -> tuple[list[str], list[float]]:
        """(label, probability) of each whole text."""
        cut = [windows(t) for t in texts]
        x = np.concatenate(cut) if cut else np.zeros((0, WINDOW), np.uint8)
        logs = np.concatenate([self.log_softmax(self.pooled(x[i : i + batch], tables)) for i in range(0, len(x), batch)] or [np.zeros((0, len(self.labels)))])
        sizes = np.array([len(c) for c in cut])
        ends = np.cumsum(sizes)
        filled = np.full(len(x), float(WINDOW))
        filled[ends - 1] = [len(t) - (len(c) - 1) * WINDOW for t, c in zip(texts, cut, strict=True)]
        total = np.add.reduceat(logs * filled[:, None], ends - sizes, axis=0)
        mean = total / np.maximum(np.add.reduceat(filled, ends - sizes), 1)[:, None]
        mean = np.exp(mean - mean.max(axis=1, keepdims=True))
        share = mean / mean.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.labels[b] for b in best], share[np.arange(len(best)), best].astype(float).tolist()


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, part): SAMPLE_BYTES-character parts of at most ``per_language`` texts of each language."""
    fit = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "part")
    start = F.greatest(F.lit(1), (F.length("text") / 2 - SAMPLE_BYTES / 2).cast("int"))
    part = F.substring("text", start, F.lit(SAMPLE_BYTES)).alias("part")
    parts = fit.select("lang", "doc_id", F.xxhash64("doc_id", F.xxhash64("text")).alias("h"), part)  # small rows to rank
    return parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("lang", "part", "n")


def fit_network(docs: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork:
    """The network fitted on the sample of (doc_id, text, lang, held_out), which comes to the driver."""
    rows = sorted((r["lang"], r["n"], r["part"]) for r in sample(docs, per_language).collect())
    labels = sorted({r[0] for r in rows})
    network = ByteNetwork.new(labels)
    if len(labels) > 1:
        xs, ys = [], []
        for lang, n, part in rows:
            raw = part.encode()
            for piece in (raw[:WINDOW], raw[WINDOW : 2 * WINDOW], raw[: 24 + 8 * (n % 12)]):  # short texts too
                if piece:
                    xs.append(windows(piece)[0])
                    ys.append(labels.index(lang))
        network.fit(np.array(xs), np.array(ys))
    return network


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, fold: int = FOLD, per_language: int = PER_LANGUAGE
) -> DataFrame:
    """doc_id, held_out, lang_pred, score; one row per row of ``docs``.

    Learns from rows with a label and a letter whose crc32(doc_id as text) mod ``folds`` isn't
    ``fold``; a null id is learned from. A text that is null or has no letter is ``und`` with
    score 0, and so is every text when there is no label. Extra columns are ignored.
    """
    rows = take(docs, doc_id=doc_id, text=text, lang=lang).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    network = fit_network(rows, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value, None
        for batch in text_slices(batches, 2, 1 << 20):
            if tables is None:
                tables = model.pair_tables()
            names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
            texts = texts_of(batch.column(2))
            live = [i for i, t in enumerate(texts) if t and model.labels and _LETTER.search(t.decode("utf-8", "replace"))]
            if live:
                for i, name, score in zip(live, *model.predict([texts[i] for i in live], tables), strict=True):
                    names[i], scores[i] = name, score
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
