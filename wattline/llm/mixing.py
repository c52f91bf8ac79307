"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A classifier is fitted on the labelled rows and gives every document a posterior over the
domains. Document rates then follow from least squares: the expected tokens of a domain are
the sum of rate x tokens x posterior, and projected gradient steps from rate 1, measured in
tokens, bring them to the targets while rates stay at zero or above.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import columns_of, quoted, take
from wattline.session import spool

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = {"good": 0.8, "poor": 0.1, "toxic": 0.1}
FEATURES = ("marks", "bars", "spaces", "lines", "size", "distinct", "shown")
MARKERS = 64
BROADCAST_LABELS = 1_000_000  # labelled ids (about 20 bytes each) that may be broadcast; more are joined by a shuffle
STEPS = 30
HALVINGS = 8
TOLERANCE = 1e-9  # of the targets' sum: a gap that counts as none
GAIN = 1e-4  # of the targets' sum: what a step must close of the gap for another to follow


def label_domain(quality: Column, toxic: Column) -> Column:
    """good, poor or toxic; null without a quality label."""
    return F.when(toxic == 1, F.lit("toxic")).when(quality == 1, F.lit("good")).when(quality == 0, F.lit("poor"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _measured(rows: DataFrame) -> DataFrame:
    """(doc_id, domain, tokens, features, words) from doc_id, text, domain."""
    text = F.coalesce("text", F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))

    def share(chars: str) -> Column:
        return sum(((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) for c in chars), F.lit(0)) / length

    return rows.withColumn("words", _words(F.col("text"))).select(
        "*",
        F.size("words").cast("double").alias("tokens"),
        F.sqrt(share("#*$%&")).alias("marks"),
        F.sqrt(share("|")).alias("bars"),
        share(" ").alias("spaces"),
        F.sqrt(share("\n")).alias("lines"),
        F.log1p(F.length(text).cast("double")).alias("size"),
        F.array_distinct("words").alias("vocabulary"),
    ).withColumn("distinct", F.size("vocabulary") / F.greatest("tokens", F.lit(1.0)))


def marker_words(labelled: DataFrame, most: int = MARKERS) -> list[str]:
    """Words whose share of toxic documents is surely above that of others, the surest first; at most ``most``.

    ``labelled`` has domain and vocabulary. The order is by the log odds less two standard
    errors, then by word; every labelled document counts.
    """
    toxic = (F.col("domain") == "toxic").cast("bigint")
    totals = labelled.agg(F.sum(toxic).alias("a"), F.sum(1 - toxic).alias("b")).first()
    if not totals["a"] or not totals["b"]:
        return []
    counts = labelled.select(F.explode("vocabulary").alias("word"), toxic.alias("t")).groupBy("word").agg(
        F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")
    )
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    sure = F.log(a / (totals["a"] + 1)) - F.log(b / (totals["b"] + 1)) - 2 * F.sqrt(1 / a + 1 / b)
    best = counts.select("word", sure.alias("sure")).where("sure > 0").orderBy(F.desc("sure"), "word").limit(most)
    return [r["word"] for r in best.collect()]


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...] = DOMAINS) -> tuple[list[str], list[Column]]:
    """(marker words, log score of each domain over FEATURES), fitted on the labelled rows.

    ``docs`` has doc_id and text, ``labels`` doc_id and domain. Gaussian naive Bayes over seven
    measures of the text, one of them the presence of marker words. A domain without a label
    can't be predicted; without any label all domains score the same.
    """
    known = labels.where(F.col("domain").isin(*domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = spool(known, "labels")
    few = known.count() <= BROADCAST_LABELS
    labelled = _measured(docs.join(F.broadcast(known) if few else known, "doc_id").select("text", "domain"))
    markers = marker_words(labelled.select("domain", "vocabulary"))
    moments = [f(F.col(c)).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("v", F.var_pop))]
    rows = labelled.withColumn("shown", _shown(markers)).groupBy("domain").agg(F.count("*").alias("n"), *moments).collect()
    fitted = {r["domain"]: r for r in rows}  # one row per domain
    total = sum(r["n"] for r in fitted.values())
    scores = []
    for d in domains:
        if d not in fitted:
            scores.append(F.lit(-1e300 if fitted else 0.0))
            continue
        r = fitted[d]
        terms = []
        for c in FEATURES:
            var = max(r[f"v_{c}"] or 0.0, 1e-4)
            terms.append(-((F.col(c) - F.lit(float(r[f"m_{c}"]))) ** 2) / (2 * var) - 0.5 * math.log(var))
        scores.append(sum(terms, F.lit(math.log(r["n"] / total))))
    return markers, scores


def _shown(markers: list[str]) -> Column:
    if not markers:
        return F.lit(0.0)
    return F.log1p(F.size(F.array_intersect("vocabulary", F.array(*map(F.lit, markers)))).cast("double"))


def posteriors(docs: DataFrame, markers: list[str], scores: list[Column], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, tokens and ``post``, an array with the probability of each domain."""
    rows = _measured(docs).withColumn("shown", _shown(markers)).select(*keep, "tokens", F.array(*scores).alias("s"))
    rows = rows.withColumn("e", F.transform("s", lambda x: F.exp(x - F.array_max("s"))))
    norm = F.aggregate("e", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(*keep, "tokens", F.transform("e", lambda x: x / norm).alias("post"))


def fit_rates(members: DataFrame, weights: dict[str, float], domains: tuple[str, ...] = DOMAINS, total: float | None = None, least: float = 0.0) -> Column:
    """The rate of each row of ``members`` (tokens, post) as an expression over it.

    Targets are ``total`` tokens dealt by ``weights``; without a total it is the smallest at
    which no domain has to shrink. A rate is 1 plus the gradient steps so far, weighted by the
    row's posteriors, projected to ``least`` or above; this is the least change, in tokens,
    that meets the targets. A step is one aggregate with one row, which gives the gap to the
    targets and the second moments of the rows that aren't held at ``least``; these scale the
    gradient. A step that does not lower the objective is halved. Where the targets can't be
    met the steps end when they stop closing the gap.
    """
    p = [F.col("post")[i] for i in range(len(domains))]
    share = np.array([weights.get(d, 0.0) for d in domains], float)
    share = share / share.sum()
    pairs = [(i, j) for i in range(len(p)) for j in range(i, len(p))]

    def wish(at: np.ndarray) -> Column:
        return F.lit(1.0) + sum((x * float(v) for x, v in zip(p, at, strict=True)), F.lit(0.0))

    def rate(at: np.ndarray) -> Column:
        return F.greatest(F.lit(float(least)), wish(at))

    def look(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(tokens by domain, moments of the free rows, objective without the targets)."""
        rows = members.select("tokens", "post", rate(at).alias("r"), wish(at).alias("w"))
        live = F.when(F.col("w") >= least, F.col("tokens")).otherwise(0.0)
        row = rows.agg(
            F.sum(F.col("tokens") * F.col("r") * (F.col("w") - F.col("r") / 2)).alias("value"),
            *[F.sum(F.col("r") * F.col("tokens") * x).alias(f"t{i}") for i, x in enumerate(p)],
            *[F.sum(live * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs],
        ).first()
        moment = np.zeros((len(p), len(p)))
        for i, j in pairs:
            moment[i, j] = moment[j, i] = row[f"m{i}_{j}"] or 0.0
        return np.array([row[f"t{i}"] or 0.0 for i in range(len(p))]), moment, float(row["value"] or 0.0)

    at = np.zeros(len(p))
    now, moment, value = look(at)
    if total is None:
        total = max((n / s for n, s in zip(now, share, strict=True) if s > 0 and n > 0), default=0.0)
    target = np.where(now > 0, share * total, 0.0)  # a domain without tokens can't be filled
    size = max(1.0, float(target.sum()))
    for _ in range(STEPS):
        gap = target - now
        if np.abs(gap).max(initial=0.0) <= TOLERANCE * size:
            break
        step, low = np.linalg.pinv(moment, rcond=1e-8, hermitian=True) @ gap, value - target @ at
        for _ in range(HALVINGS):
            then, moment_then, value_then = look(at + step)
            if value_then - target @ (at + step) < low:
                break
            step = step / 2
        else:
            break
        closed = np.abs(gap).sum() - np.abs(target - then).sum()
        at, now, moment, value = at + step, then, moment_then, value_then
        if closed <= GAIN * size:
            break
    return rate(at)


def copies_of(rate: Column, *key: Column, seed: int = 7) -> Column:
    """How often a row appears: the whole part of the rate, and one more with the chance of the rest."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("bigint")).cast("bigint")


def _domains_of(labels: DataFrame) -> DataFrame:
    known = take(labels, doc_id="doc_id", quality="quality", toxic="toxic")
    return known.select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies; one row per row of ``docs``.

    Tokens are words. A null or empty text has no tokens; its posterior is that of an empty
    text and its rate takes part in no total. Labels with a null quality or id teach nothing;
    of several labels of an id the first domain by name counts. Rows with one id and text get
    the same draw. Extra columns are ignored.
    """
    rows = take(docs, doc_id=doc_id, text=text)
    drawn = rows.withColumn("draw", F.xxhash64("doc_id", "text"))
    members = spool(posteriors(drawn, *fit_classifier(rows, _domains_of(labels)), ["doc_id", "draw"]), "posteriors")
    rated = members.withColumn("rate", fit_rates(members, weights or WEIGHTS))
    return rated.select(
        "doc_id", F.col("tokens").cast("bigint").alias("n_tokens"), *[F.col("post")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        "rate", copies_of(F.col("rate"), F.col("draw")).alias("copies"),
    )


def mix(
    docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, doc_id: str = "doc_id", text: str = "text", least: float = 0.0
) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, with the columns of ``docs``.

    With ``least`` 1 no row goes: targets are met as far as repeating rows can meet them. A
    rate follows from the text alone, so the last pass computes it again beside the row and
    nothing is joined.
    """
    rows = take(docs, doc_id=doc_id, text=text)
    markers, scores = fit_classifier(rows, _domains_of(labels))
    members = spool(posteriors(rows, markers, scores, []), "posteriors")
    rate = fit_rates(members, weights or WEIGHTS, least=least)
    whole = F.struct(*columns_of(docs)).alias("row")
    again = posteriors(docs.select(whole, F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), markers, scores, ["row", "doc_id", "text"])
    times = copies_of(rate, F.xxhash64("doc_id", "text"))
    # a filter on the copies would be pushed down and work the rate out twice; one on what explode_outer gives can't be
    copied = again.select("row", F.explode_outer(F.array_repeat(F.lit(1), times.cast("int"))).alias("copy"))
    return copied.where("copy is not null").select("row.*")
