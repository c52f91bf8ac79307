"""Quality rules: fixed counts of words and repeats, and perplexity bands by language.

A modified Kneser-Ney model over folded bytes is counted by Spark. Bytes fold to 32 classes,
so an order of four has at most 32**4 = 1,048,576 n-grams whatever the corpus: the model's
sorted hash arrays have a proven bound (about 17 MB) and may be broadcast. Every text counts
towards the model and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import columns_of, fresh, quoted, take, text_bytes, text_slices, texts_of
from wattline.llm.points import point_scores
from wattline.session import spool

CLASSES = 32
ORDER = 4
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
PART = 1 << 22
SYMBOLS = "#*$%&|<>"
# Width of a perplexity bin in nats per byte, and how many interquartile ranges a band reaches
# beyond the quartiles (at least FLOOR nats). Bands come from documents that pass the base rules.
BIN = 0.002
REACH = 3.0
FLOOR = 0.05
# The pooled interquartile range counts as much as this many documents of a language.
PRIOR_DOCS = 20


def _fold_table() -> np.ndarray:
    """Class of each byte: 1-26 letters, 27 white space, 28 digits, 29 punctuation, 30 other ASCII, 31 UTF-8 lead, 0 UTF-8 tail."""
    out = np.full(256, 30, np.uint8)
    for i in range(26):
        out[[65 + i, 97 + i]] = 1 + i
    out[[9, 10, 11, 12, 13, 32]] = 27
    out[48:58] = 28
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 29
    out[192:] = 31
    out[128:192] = 0
    return out


FOLD = _fold_table()
_SPACES = dict.fromkeys([9, 10, 11, 12, 13, 32])
_MARKS = dict.fromkeys(map(ord, SYMBOLS))


def codes(text: bytes) -> np.ndarray:
    """The n-gram code that ends at each byte, after ORDER - 1 spaces of padding."""
    folded = np.empty(len(text) + ORDER - 1, np.int32)
    folded[: ORDER - 1] = 27
    folded[ORDER - 1 :] = FOLD[np.frombuffer(text, np.uint8)]
    out = folded[: len(text)].copy()
    for k in range(1, ORDER):
        out *= CLASSES
        out += folded[k : k + len(text)]
    return out


def code_parts(text: bytes) -> Iterator[np.ndarray]:
    """The codes of a whole text, at most PART of them at a time."""
    for i in range(0, len(text), PART):
        yield codes(text[max(0, i - ORDER + 1) : i + PART])[min(i, ORDER - 1) :]


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    chars = len(text.translate(_SPACES))
    symbols = len(text) - len(text.translate(_MARKS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        hit = np.zeros(len(words), bool)
        for i, w in enumerate(windows):
            if (j := seen.setdefault(w, i)) != i:
                hit[j : j + 3] = True
                hit[i : i + 3] = True
        repeated = int(hit.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


# --- the model -------------------------------------------------------------------------


def hashed(code: np.ndarray, order: int) -> np.ndarray:
    """A 64-bit mix of an n-gram's code and order; one to one, so a lookup is exact."""
    with np.errstate(over="ignore"):
        x = code.astype(np.uint64) + np.uint64(order << 40)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class HashedModel:
    """Sorted n-gram hashes with the probability and the backoff weight of each."""

    keys: np.ndarray
    prob: np.ndarray
    backoff: np.ndarray

    def find(self, code: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(present, index) of each code in the sorted array."""
        want = hashed(code, order)
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == want if len(self.keys) else np.zeros(len(code), bool)), at

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        """Natural log probability of the last class of each full code given those before it."""
        out = np.zeros(len(code))
        weight = np.ones(len(code))
        open_ = np.arange(len(code))
        for order in range(ORDER, 0, -1):
            part = code[open_] % CLASSES**order
            there, at = self.find(part, order)
            out[open_[there]] = weight[open_[there]] * self.prob[at[there]]
            open_, part = open_[~there], part[~there]
            if len(open_):
                context, at = self.find(part // CLASSES, order - 1)
                weight[open_[context]] *= self.backoff[at[context]]
        out[open_] = weight[open_] / CLASSES
        return np.log(np.maximum(out, 1e-300))


def count_ngrams(texts: DataFrame) -> DataFrame:
    """(code, n) of column ``text``: one dense count array per task, then a sum; at most 32**4 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**ORDER, np.int64)
        for batch in text_slices(batches, 0):  # a slice is counted at once: each count makes a whole table
            parts = [part for text in texts_of(batch.column(0)) if text for part in code_parts(text)]
            for i in range(0, len(parts), 50_000):
                total += np.bincount(np.concatenate(parts[i : i + 50_000]), minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["code", "n"])

    return texts.mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def kneser_ney(code: np.ndarray, n: np.ndarray) -> HashedModel:
    """Interpolated modified Kneser-Ney with three discounts per order, from full-order counts."""
    nothing = np.zeros(1, np.int64)  # the empty context
    keys, probs, backoffs = [hashed(nothing, 0)], [np.full(1, 1 / CLASSES)], [(nothing,)]
    counts = {ORDER: (code.astype(np.int64), n.astype(np.int64))}
    for order in range(ORDER - 1, 0, -1):  # how many different classes stand before each lower n-gram
        higher = counts[order + 1][0][counts[order + 1][1] > 0]
        grams, times = np.unique(higher % CLASSES**order, return_counts=True)
        opening = np.setdiff1d(higher // CLASSES, grams)  # contexts that only open texts
        grams, times = np.concatenate([grams, opening]), np.concatenate([times, np.zeros(len(opening), np.int64)])
        sort = np.argsort(grams)
        counts[order] = (grams[sort], times[sort])
    lower = np.full(CLASSES, 1 / CLASSES)
    for order in range(1, ORDER + 1):
        grams, times = counts[order]
        n1, n2, n3, n4 = (max(1, int((times == k).sum())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cut = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]).clip(0.05, [1, 0.95, 1.95, 2.95])
        cut[0] = 0.0
        discount = np.minimum(cut[np.minimum(times, 3)], times)
        context = grams // CLASSES
        mass = np.bincount(context, weights=times, minlength=CLASSES ** (order - 1)).astype(float)
        left = np.bincount(context, weights=discount, minlength=CLASSES ** (order - 1)).astype(float)
        share = np.divide(left, mass, out=np.ones_like(left), where=mass > 0)
        prob = (times - discount) / np.maximum(mass[context], 1) + share[context] * lower[grams % CLASSES ** max(order - 1, 1)]
        backoffs[-1] = share[backoffs[-1][0]]  # what the contexts of this order leave to the lower one
        keys.append(hashed(grams, order))
        probs.append(prob)
        backoffs.append((grams,))
        if order < ORDER:  # the full distribution of this order, for interpolation one order up
            full = np.tile(lower, CLASSES) if order > 1 else np.full(CLASSES, share[0] / CLASSES)
            if order > 1:
                full = share.repeat(CLASSES) * lower[np.arange(CLASSES**order) % CLASSES ** (order - 1)]
            full[grams] = prob
            lower = full
    backoffs[-1] = np.ones(len(probs[-1]))
    key, prob, back = np.concatenate(keys), np.concatenate(probs), np.concatenate(backoffs)
    order_ = np.argsort(key)
    return HashedModel(key[order_], prob[order_].astype(np.float64), back[order_].astype(np.float64))


def fit_model(texts: DataFrame) -> HashedModel:
    """The model of column ``text``; its counts, at most 32**4 rows, come to the driver."""
    counts = count_ngrams(texts).toPandas().sort_values("code")
    return kneser_ney(counts["code"].to_numpy(), counts["n"].to_numpy())


# --- scores and verdicts ----------------------------------------------------------------

_MEASURES = T.StructType(
    [
        T.StructField(c, T.LongType(), False)
        for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ]
    + [T.StructField("nats", T.DoubleType(), True)]
)


def measured(docs: DataFrame, text: str, name: str, model: HashedModel) -> DataFrame:
    """``docs`` with a struct of the base counts and the mean negative log probability per byte."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.log_prob(np.arange(CLASSES**ORDER)))  # 8 MB, made once
    at = docs.columns.index(text)
    fields = _MEASURES.names

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in text_slices(batches, at):
            rows = []
            for raw in texts_of(batch.column(at)):
                raw = raw or b""
                total = 0.0
                for part in code_parts(raw):
                    total += float(table[part].sum())
                rows.append((*base_counts(raw), -total / len(raw) if raw else None))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            struct = pa.StructArray.from_arrays(
                [c.cast(pa.float64() if f == "nats" else pa.int64()) for c, f in zip(columns, fields, strict=True)],
                fields=[pa.field(f, pa.float64() if f == "nats" else pa.int64(), f == "nats") for f in fields],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, _MEASURES, False)]))


def base_failed(of: str = "") -> Column:
    """The base rules over the counts, which may be fields of a struct."""
    few = F.col(f"{of}n_words") < MIN_WORDS
    return few | (100 * F.col(f"{of}n_repeat_words") > MAX_REPEAT_PCT * F.col(f"{of}n_words"))


def _quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q1, q3, docs) in bins, from columns keys, bin and n."""
    every = Window.partitionBy(*keys)
    running = bins.withColumn("upto", F.sum("n").over(every.orderBy("bin"))).withColumn("docs", F.sum("n").over(every))
    at = [F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("bin"))).alias(c) for q, c in ((0.25, "q1"), (0.75, "q3"))]
    return running.groupBy(*keys).agg(*at, F.max("docs").alias("docs"))


def _binned(scores: DataFrame) -> DataFrame:
    return scores.groupBy("lang", F.floor(F.col("nats") / BIN).alias("bin")).agg(F.count("*").alias("n"))


def language_bands(scores: DataFrame) -> DataFrame:
    """(lang, low, high) from columns lang and nats: every language around its own quartiles.

    Exact quartiles of binned scores. A null ``lang`` is a language of its own. The range between
    the quartiles is drawn towards the pooled one of all languages, by PRIOR_DOCS against the
    documents less one, so no size switches the rule. Up to three documents of a language lie
    within their quartiles and are kept.
    """
    by = _quartiles(_binned(scores), ["lang"]).select("lang", "q1", "q3", (F.col("q3") - F.col("q1")).alias("own"), (F.col("docs") - 1).alias("free"))
    pooled = by.agg((F.sum(F.col("own") * F.col("free")) / F.greatest(F.sum("free"), F.lit(1))).alias("pooled"))
    spread = (F.col("own") * F.col("free") + F.col("pooled") * PRIOR_DOCS) / (F.col("free") + PRIOR_DOCS)
    reach = F.greatest(REACH * (spread + 1) * BIN, F.lit(FLOOR))
    return by.crossJoin(F.broadcast(pooled)).select(
        "lang", (F.col("q1") * BIN - reach).alias("low"), ((F.col("q3") + 1) * BIN + reach).alias("high")
    )


def _scored(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without the text: the base counts, nats, base_failed, and nats_per_point."""
    model = fit_model(take(docs, text=text))
    size = text_bytes(docs, text)  # of docs itself: measured rows would be measured once more
    rows = measured(docs, text, "m", model).select(*docs.columns, "m.*").withColumn("base_failed", base_failed())
    return spool(point_scores(rows, text, "nats_per_point", size), "quality")


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` of _scored with low, high, point_high and kept.

    The growing model finds a text with many copies easy, which is no fault of it: only its upper limit counts.
    """
    good = rows.where("not base_failed")
    byte = language_bands(good.select("lang", "nats")).withColumnRenamed("lang", "band")
    point = language_bands(good.select("lang", F.col("nats_per_point").alias("nats")))
    point = point.select(F.col("lang").alias("point_band"), F.col("high").alias("point_high"))
    out = rows.join(byte, rows["lang"].eqNullSafe(F.col("band")), "left").join(point, rows["lang"].eqNullSafe(F.col("point_band")), "left")
    inside = F.col("nats").between(F.col("low"), F.col("high")) & (F.col("nats_per_point") <= F.col("point_high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, nats_per_byte, low, high,
    nats_per_point, point_high.

    One row per row of ``docs``; extra columns are ignored. A document is kept that passes the
    base rules and lies within its language's band of nats per byte, under the model of byte
    classes, and not above that of nats per code point, under the model of ``points``. Both scores are null for an empty
    text, the limits are null for a language without a document that passes the base rules.
    """
    rows = _judged(_scored(take(docs, doc_id=doc_id, text=text, lang=lang), "text"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang",
        F.col("nats").alias("nats_per_byte"), "low", "high", "nats_per_point", "point_high",
    )


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``.

    The verdict depends on text and language alone, so rows are found again by their text's
    digest among the rejected ones, which is cheaper than to store texts.
    """
    digest, key, band = (fresh(docs, x) for x in ("digest", "rejected", "rejected_lang"))
    of = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))
    source = take(docs, text=text, lang=lang).withColumn("digest", of(F.col("text")))
    bad = _judged(_scored(source, "text")).where("not kept").select(F.col("digest").alias(key), F.col("lang").alias(band)).distinct()
    bad = spool(bad, "rejected")
    rows = docs.withColumn(digest, of(F.col(quoted(text))))
    rejected = (F.col(digest) == F.col(key)) & F.col(quoted(lang)).eqNullSafe(F.col(band))
    return rows.join(bad, rejected, "left_anti").select(*columns_of(docs))
