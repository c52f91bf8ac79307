"""Train/test splits and grouped folds as row-local predicates.

Sizes match the usual definitions exactly: random holds out ceil(test * n) rows,
time trains on the first int((1 - test) * n) rows, grouped holds out
ceil(test * sessions) whole sessions. Membership is drawn by MD5 so that it does
not depend on how the table happens to be partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.contract import SESSION, TIMESTAMP
from wattline.functions.coerce import HASH_EXTENT, hash60
from wattline.operators.lookup import is_hot, look_up
from wattline.operators.ordering import cut_point, flag_first, row_index
from wattline.session import spool

STRATEGIES = ("random", "time", "grouped")
BROADCAST_PIECES = 100_000


def random_split(df: DataFrame, test_size: float, seed: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Hold out exactly ceil(test_size * n) rows, drawn by hash."""
    keys = list(keys or df.columns)
    n = df.count()
    hashed = df.withColumn("__h", hash60(seed, *[F.col(f"`{k}`") for k in keys]))
    k = math.ceil(test_size * n)
    return flag_first(hashed, ["__h", *keys], k, "is_test", n, extent=HASH_EXTENT).drop("__h")


def time_split(df: DataFrame, test_size: float, keys: Sequence[str] = ()) -> DataFrame:
    """Train on the earliest rows; rows without a time count as latest. No time at all is an error."""
    sizes = df.agg(F.count("*").alias("n"), F.count(TIMESTAMP).alias("timed")).first()
    n = sizes["n"]
    if n and not sizes["timed"]:
        raise ValueError(f"A time split needs values in '{TIMESTAMP}'.")
    cutoff = int((1.0 - test_size) * n)
    order = [TIMESTAMP, *[k for k in keys if k != TIMESTAMP]]
    flagged = flag_first(df, order, cutoff, "__train", n)
    return flagged.withColumn("is_test", ~F.col("__train")).drop("__train")


def grouped_split(df: DataFrame, test_size: float, seed: int, group: str = SESSION) -> DataFrame:
    """Hold out whole sessions; train and test sessions are disjoint.

    The different sessions are stored once; of them only the boundary session is looked up. Every row then compares its own
    session hash with it, so the rows are not shuffled and a hot session costs
    nothing extra.
    """
    name = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("nan"))
    groups = spool(df.select(name.alias("__g")).distinct().withColumn("__h", hash60(seed, F.col("__g"))), "sessions")
    n = groups.count()
    k = math.ceil(test_size * n)
    tagged = df.withColumn("__g", name).withColumn("__h", hash60(seed, name))
    if k <= 0 or k >= n:
        return tagged.withColumn("is_test", F.lit(k >= n and n > 0)).drop("__g", "__h")
    cut = cut_point(groups, ["__h", "__g"], k, n, extent=HASH_EXTENT)
    return tagged.withColumn("is_test", cut.ahead() | cut.at()).drop("__g", "__h")


def split_used(columns: Sequence[str], strategy: str) -> str:
    """Strategy that will really run: time and grouped need their column, else random."""
    if strategy not in STRATEGIES:
        raise ValueError(f"No split is called '{strategy}'.")
    if strategy == "time" and TIMESTAMP not in columns:
        return "random"
    if strategy == "grouped" and SESSION not in columns:
        return "random"
    return strategy


def split(
    df: DataFrame,
    strategy: str = "random",
    test_size: float = 0.2,
    seed: int = 42,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``is_test`` and the strategy that was applied as ``split_used``."""
    used = split_used(df.columns, strategy)
    if used == "time":
        out = time_split(df, test_size, keys or ())
    elif used == "grouped":
        out = grouped_split(df, test_size, seed)
    else:
        out = random_split(df, test_size, seed, keys)
    return out.withColumn("split_used", F.lit(used))


def _fold_runs(sizes: Sequence[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Greedy "largest session to the lightest fold", one run of equal sizes at a time.

    Within a run every fold's load grows in steps of the same size, so the
    choices settle into a repeating cycle over the folds that have caught up. A
    run is therefore described by at most ``folds`` pieces
    ``(size, first rank, last rank, cycle)`` instead of one entry per session.
    """
    loads = [0] * folds
    pieces = []
    for size, count in sorted(sizes, reverse=True):
        rank = 0
        while rank < count:
            lightest = sorted(range(folds), key=lambda f: (loads[f], f))
            floor = loads[lightest[0]]
            # Folds whose load is within one step of the lightest take turns.
            active = [f for f in lightest if loads[f] < floor + size]
            waiting = [f for f in lightest if loads[f] >= floor + size]
            if waiting:
                rounds = max(1, (loads[waiting[0]] - floor) // size)
            else:
                rounds = max(1, math.ceil((count - rank) / folds))
            take = min(count - rank, rounds * len(active))
            pieces.append((size, rank, rank + take - 1, active))
            for i, f in enumerate(active):
                loads[f] += size * (take // len(active) + (1 if i < take % len(active) else 0))
            rank += take
    return pieces


def grouped_folds(df: DataFrame, folds: int = 3, group: str = SESSION) -> DataFrame | None:
    """(session, rows, fold): whole sessions spread over balanced folds, 1-based.

    Largest session first, ties by name, always to the lightest fold. ``None``
    when the column is missing or there are fewer than three sessions.
    """
    if group not in df.columns:
        return None
    name = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("nan"))
    counts = df.groupBy(name.alias(group)).agg(F.count("*").alias("rows"))
    # Different sizes that add up to n rows number at most sqrt(2n).
    sizes = [(r["rows"], r["n"]) for r in counts.groupBy("rows").agg(F.count("*").alias("n")).collect()]
    total = sum(n for _, n in sizes)
    if total < 3:
        return None
    pieces = _fold_runs(sizes, min(folds, total))
    start, begin = {}, 0
    for size, n in sorted(sizes, reverse=True):
        start[size], begin = begin, begin + n
    table = df.sparkSession.createDataFrame(
        [(size, start[size] + a, start[size] + b, cycle) for size, a, b, cycle in pieces],
        "rows bigint, lo bigint, hi bigint, cycle array<int>",
    )
    ranked = row_index(counts.withColumn("__neg", -F.col("rows")), ["__neg", group], "__idx").drop("__neg")
    turn = ((F.col("__idx") - F.col("lo")) % F.size("cycle")).cast("int")
    side = F.broadcast(table) if len(pieces) <= BROADCAST_PIECES else table
    placed = ranked.join(side, "rows").where(F.col("__idx").between(F.col("lo"), F.col("hi")))
    return placed.select(group, "rows", (F.get("cycle", turn) + 1).cast("bigint").alias("fold"))


def attach_folds(df: DataFrame, folds: DataFrame, group: str = SESSION) -> DataFrame:
    """Put each row's fold on it.

    ``folds`` is (session, rows, fold). Sessions that hold many of the rows are broadcast,
    the others too while they are counted few, and joined by a shuffle beyond.
    """
    name = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("nan"))
    sizes = folds.agg(F.count("*").alias("n"), F.sum("rows").alias("rows")).first()
    side = folds.select(F.col(f"`{group}`").alias("key"), F.col("fold").alias("found"), is_hot(F.col("rows"), F.lit(sizes["rows"])).alias("hot"))
    placed = look_up(df.withColumn("__g", name), side, sizes["n"], F.col("__g"), "fold")
    return placed.where(F.col("fold").isNotNull()).drop("__g")
