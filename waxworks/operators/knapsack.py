"""The best purchases per seller under a budget, exactly.

Prices are whole cents. A budget of C cents holds at most C/w items that cost w cents, and among
equally priced items the more valuable ones are always at least as good. So the C/w best items of
each price are all a solution can need: a seller shrinks to at most about C·ln(C) items before
anything is gathered, whatever the size of the stock, and no optimum is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waxworks.functions.money import to_units
from waxworks.session import stable

VALUE_UNITS, MONEY_UNITS = 1000, 100
HEAP_ROWS = 200_000  # items that a task holds at most before it cuts them, and hands them on if few go
TABLE_BITS = 1 << 31  # choice table kept whole up to 256 MB


def _best_values(values: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Highest value for every capacity up to ``capacity``."""
    best = np.zeros(capacity + 1, dtype=np.int64)
    for v, w in zip(values, weights):
        if w <= capacity:
            best[w:] = np.maximum(best[w:], best[: capacity + 1 - w] + v)
    return best


def _fill(values: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Chosen positions of an optimal filling.

    Keeps one bit per item and capacity. When that is too much, the items are halved, the best split
    of the capacity between the halves is found from their value curves, and each half is solved.
    """
    n = len(values)
    if n == 0 or capacity <= 0:
        return np.zeros(0, dtype=np.int64)
    if n > 1 and n * (capacity + 1) > TABLE_BITS:
        half = n // 2
        left = _best_values(values[:half], weights[:half], capacity)
        right = _best_values(values[half:], weights[half:], capacity)
        share = int(np.argmax(left + right[::-1]))
        return np.concatenate(
            [_fill(values[:half], weights[:half], share), half + _fill(values[half:], weights[half:], capacity - share)]
        )
    best = np.zeros(capacity + 1, dtype=np.int64)
    taken = []
    for v, w in zip(values, weights):
        if w > capacity:
            taken.append(None)
            continue
        grown = best[: capacity + 1 - w] + v
        better = grown > best[w:]
        best[w:][better] = grown[better]
        taken.append(np.packbits(better))
    chosen, room = [], capacity
    for i in range(n - 1, -1, -1):
        at = room - weights[i]
        if at >= 0 and (taken[i][at >> 3] >> (7 - (at & 7))) & 1:
            chosen.append(i)
            room = at
    return np.array(chosen, dtype=np.int64)


def best_subset(values: np.ndarray, weights: np.ndarray, capacity: int) -> np.ndarray:
    """Mask of a most valuable set of items within the capacity.

    The fractional solution bounds what any set can reach. An item whose inclusion (or exclusion)
    cannot beat the greedy set even on that bound is settled; the table is filled only for the rest.
    """
    values, weights = np.asarray(values, dtype=np.int64), np.asarray(weights, dtype=np.int64)
    mask = (weights == 0) & (values > 0)
    open_ = np.flatnonzero((weights > 0) & (values > 0) & (weights <= capacity))
    if not len(open_):
        return mask
    if weights[open_].sum() <= capacity:
        mask[open_] = True
        return mask
    order = open_[np.lexsort((weights[open_], -values[open_] / weights[open_]))]
    v, w = values[order], weights[order]
    filled = np.cumsum(w)
    cut = int(np.searchsorted(filled, capacity, side="right"))  # first item that does not fit
    spent = int(filled[cut - 1]) if cut else 0
    rate = v[cut] / w[cut]
    bound = v[:cut].sum() + rate * (capacity - spent)
    greedy = np.zeros(len(order), dtype=bool)
    greedy[:cut] = True
    room = capacity - spent
    for i in range(cut, len(order)):
        if w[i] <= room:
            greedy[i] = True
            room -= w[i]
    floor = int(v[greedy].sum())
    reach = np.floor(bound - np.abs(v - rate * w) + 1e-6)
    settled = reach <= floor
    core = np.flatnonzero(~settled)
    fixed = np.zeros(len(order), dtype=bool)
    fixed[:cut] = settled[:cut]
    left = capacity - int(w[fixed].sum())
    picked = fixed.copy()
    picked[core[_fill(v[core], w[core], left)]] = True
    if int(v[picked].sum()) < floor:
        picked = greedy
    mask[order[picked]] = True
    return mask


def _solve_seller(pdf: pd.DataFrame) -> pd.DataFrame:
    try:
        pdf = pdf.sort_values("listing_id")
        mask = best_subset(pdf["value"].to_numpy(), pdf["cents"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pdf.loc[mask, ["seller_id", "listing_id", "price", "score"]].assign(error=None)
    except Exception as err:  # one seller must not fail the job
        failed = {"seller_id": pdf["seller_id"].iloc[:1], "listing_id": None, "price": None, "score": None}
        return pd.DataFrame({**failed, "error": str(err)})


_BEST_FIRST = [("seller_id", "ascending"), ("cents", "ascending"), ("value", "descending"), ("listing_id", "ascending")]


def _best_of(table: pa.Table) -> pa.Table:
    """Of each price of each seller the capacity // cents best items."""
    table = table.take(pc.sort_indices(table, sort_keys=_BEST_FIRST, null_placement="at_start")).combine_chunks()
    seller = table["seller_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    cents, capacity = table["cents"].to_numpy(), table["capacity"].to_numpy()
    new = np.append(True, (seller[1:] != seller[:-1]) | (cents[1:] != cents[:-1]))
    first = np.flatnonzero(new)
    rank = np.arange(len(cents)) - np.repeat(first, np.diff(np.append(first, len(cents))))
    return table.filter(pa.array(rank < capacity // cents))


def _best_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best items of a task's rows. What is held is cut whenever it has doubled; where even the best are more
    than ``HEAP_ROWS``, they are handed on and the task starts anew, so nothing is lost and memory is bounded."""
    held, rows, limit = [], 0, HEAP_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows > limit:
            best = _best_of(pa.Table.from_batches(held))
            if best.num_rows > HEAP_ROWS // 2:
                yield from best.to_batches()
                held, rows = [], 0
            else:
                held, rows = best.to_batches(), best.num_rows
    if rows:
        yield from _best_of(pa.Table.from_batches(held)).to_batches()


def prune(items: DataFrame) -> DataFrame:
    """Items that an optimum may need, of (seller_id, listing_id, value, cents, capacity).

    Each task keeps the best of each price of each seller among its own rows, however the rows are dealt. So one
    price of one seller with a third of all rows is cut by all tasks, and at most C/w items of each leave for
    the one shuffle, by seller. There the same rule is applied to what the tasks have left.
    """
    useful = items.filter((F.col("value") > 0) & (F.col("cents") > 0) & (F.col("cents") <= F.col("capacity")))
    best = useful.mapInArrow(_best_each, useful.schema).repartition("seller_id")
    by = Window.partitionBy("seller_id", "cents").orderBy(F.col("value").desc(), F.col("listing_id"))
    ranked = best.withColumn("_r", F.row_number().over(by))
    return ranked.filter(F.col("_r") <= F.floor(F.col("capacity") / F.col("cents"))).drop("_r")


def _in_units(scored: DataFrame, budgets: DataFrame) -> DataFrame:
    return scored.join(budgets, "seller_id").select(
        "seller_id", "listing_id", "price", "score",
        to_units(F.col("score"), VALUE_UNITS).alias("value"),
        to_units(F.col("price"), MONEY_UNITS).alias("cents"),
        to_units(F.col("budget"), MONEY_UNITS).alias("capacity"),
    )


def _solve(kept: DataFrame) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"seller_id {types['seller_id']}, listing_id {types['listing_id']}, price double, score double, error string"
    return kept.groupBy("seller_id").applyInPandas(_solve_seller, schema)


def knapsack_by_seller(scored: DataFrame, budgets: DataFrame) -> DataFrame:
    """What to buy from each seller: (seller_id, listing_id, price, score, error).

    ``scored`` is (seller_id, listing_id, price in USD, score); ``budgets`` is (seller_id, budget).
    Items that cost nothing are taken as they are. A seller that fails gives one row with the error,
    and the others go on.
    """
    items = _in_units(scored, budgets)
    bought = _solve(prune(items))
    free = items.filter((F.col("cents") == 0) & (F.col("value") > 0) & (F.col("capacity") >= 0))
    return bought.unionByName(free.select("seller_id", "listing_id", "price", "score", F.lit(None).cast("string").alias("error")))


def certificate(scored: DataFrame, budgets: DataFrame) -> DataFrame:
    """What can be said of each seller's purchases without solving anything: one row per seller with items to weigh.

    ``bound``: value of the fractional solution, which no purchase can exceed; ``prefix_value``: that of its whole
    items, which a best purchase must reach. ``feasible``: the purchase stays within the budget; ``reached``: its
    value lies between the two; ``maximal``: nothing that was left would still fit. A seller that failed has
    bought nothing, and so isn't maximal. Equal rates go by listing; ids of listings must differ. Bounds are taken
    over pruned items only, at most about C ln C for a seller, so no seller's whole stock meets in a task.
    """
    kept = stable(prune(_in_units(scored, budgets)))
    taken = _solve(kept).filter("error is null").select("seller_id", "listing_id", F.lit(True).alias("taken"))
    by_rate = Window.partitionBy("seller_id").orderBy((F.col("value") / F.col("cents")).desc(), F.col("listing_id"))
    rows = kept.withColumn("filled", F.sum("cents").over(by_rate)).join(taken, ["seller_id", "listing_id"], "left")
    rows = rows.withColumn("taken", F.coalesce("taken", F.lit(False)))
    whole = F.col("filled") <= F.col("capacity")
    total = lambda of, when: F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0))
    seller = rows.groupBy("seller_id").agg(
        F.count("*").alias("items"), F.first("capacity").alias("capacity"),
        total("value", whole).alias("prefix_value"), total("cents", whole).alias("filled"),
        F.min(F.when(~whole, F.struct("filled", "value", "cents"))).alias("broken"),
        total("value", F.col("taken")).alias("value"), total("cents", F.col("taken")).alias("cents"),
        F.min(F.when(~F.col("taken"), F.col("cents"))).alias("cheapest_left"),
    )
    part = F.expr("coalesce(broken.value * (capacity - filled) div broken.cents, 0)")
    return seller.withColumn("bound", F.col("prefix_value") + part).select(
        "seller_id", "items", "prefix_value", "bound",
        (F.col("cents") <= F.col("capacity")).alias("feasible"),
        F.col("value").between(F.col("prefix_value"), F.col("bound")).alias("reached"),
        F.coalesce(F.col("cheapest_left") > F.col("capacity") - F.col("cents"), F.lit(True)).alias("maximal"),
    )
