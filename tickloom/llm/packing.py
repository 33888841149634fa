"""Sequence packing as a cutting-stock problem solved by column generation.

Documents are cut into pieces of at most `capacity` ids. Pieces are counted by length in units of GRAIN ids; the linear
program over packing patterns of that histogram is solved by column generation, where a knapsack by dynamic programming
prices new patterns. Rounded-down patterns give slots, what is left is packed best-fit, and each piece takes the slot of
its rank among the pieces of its length. Only the histogram (capacity / GRAIN rows) reaches the driver.

Edge cases: a null or empty text is one piece with the end id alone; rows with the same doc_id are packed separately; a
null doc_id stays null; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import materialize, tidy
from tickloom.llm.encoding import CACHE_CHUNKS, encoder

CAPACITY = 2048
GRAIN = 8  # lengths are counted in units of so many ids, rounded up
SALTS = 256  # parts of a length, so that one frequent length is ranked by many tasks
GAP = 2e-4  # the linear program may stop this close to the bound by total length
ROUNDS = 4000  # columns generated at most


def _best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern (counts for each size) that fits."""
    value, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = sizes <= c
        v = np.where(fits, prices + value[c - np.minimum(sizes, c)], -1.0)
        best = int(v.argmax())
        value[c], taken[c] = (v[best], best) if v[best] > value[c - 1] + 1e-12 else (value[c - 1], -1)
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[taken[c]] += 1
            c -= sizes[taken[c]]
    return float(value[room]), pattern


def solve_patterns(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> count) and how often each is used; together they hold every piece of `demand` (size -> count)."""
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    need = np.array([demand[k] for k in sizes], float)
    columns = [np.where(np.arange(len(sizes)) == i, room // s, 0).astype(float) for i, s in enumerate(sizes)]
    cost = np.ones(len(sizes))
    inverse = np.diag(1.0 / np.array([room // s for s in sizes]))
    x = inverse @ need
    bound = float(need @ sizes) / room
    for _ in range(ROUNDS):
        if cost @ x <= bound * (1 + GAP):
            break
        prices = cost @ inverse
        if prices.min() < -1e-9:  # a surplus column
            enter, enter_cost = -np.eye(len(sizes))[prices.argmin()], 0.0
        else:
            value, enter = _best_pattern(np.maximum(prices, 0), sizes, room)
            enter_cost = 1.0
            if value <= 1 + 1e-7:
                break
        step = inverse @ enter
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = x - ratio[out] * step
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out], cost[out] = enter, enter_cost
    used: Counter = Counter()
    left = need.astype(np.int64)
    for column, c, n in zip(columns, cost, np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)):
        held = column.astype(np.int64)
        if c and n:
            with np.errstate(divide="ignore"):
                n = min(int(n), int(np.where(held > 0, left // np.maximum(held, 1), n).min()))
            if n > 0:
                left -= n * held
                used[tuple(held)] += n
    out = [({int(s): int(k) for s, k in zip(sizes, p) if k}, n) for p, n in used.items()]
    return out + _best_fit({int(s): int(n) for s, n in zip(sizes, left) if n}, room)


def _best_fit(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing; equal bins are opened and filled together."""
    groups: list[list] = []  # [free room, how many bins, contents]
    for size in sorted(left, reverse=True):
        n = left[size]
        while n > 0:
            fit = min((g for g in groups if g[0] >= size), key=lambda g: g[0], default=None)
            if fit is None:
                each = min(room // size, n)
                many = max(1, n // each)
                groups.append([room - each * size, many, Counter({size: each})])
                n -= each * many
                continue
            each = min(fit[0] // size, n)
            many = min(fit[1], n // each)
            if many < fit[1]:
                groups.append([fit[0], fit[1] - many, Counter(fit[2])])
                fit[1] = many
            fit[0] -= each * size
            fit[2][size] += each
            n -= each * many
    return [(dict(g[2]), g[1]) for g in groups]


def slot_table(patterns: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Rows (unit, first, many, each, sequence, place): ranks first .. first + many - 1 of a unit fill sequences of a pattern."""
    rows, first, sequence = [], Counter(), 0
    for pattern, n in patterns:
        for place, (unit, each) in enumerate(sorted(pattern.items(), reverse=True)):
            rows.append((unit, first[unit], n * each, each, sequence, place))
            first[unit] += n * each
        sequence += n
    return pd.DataFrame(rows, columns=["unit", "first", "many", "each", "sequence", "place"]).astype("int64")


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, cache: int = CACHE_CHUNKS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens[, ids]) of each document's ids and its end id."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, True, cache)
        for batch in batches:
            every, upto = own.column(batch.column("text"))
            rows, ids = [], []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), upto[:-1].tolist(), upto[1:].tolist()):
                whole = np.append(every[a:b], np.uint32(end_id))
                for at in range(0, len(whole), capacity):
                    piece = whole[at : at + capacity]
                    rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
                    ids.append(piece)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            if rows:
                yield pa.RecordBatch.from_arrays(columns, names + ["ids"] * with_ids)

    schema = ", ".join(f"{c} long" for c in names) + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length and more); each has 1 to `capacity` ids."""
    spark = pieces.sparkSession
    room = -(-capacity // GRAIN)
    pieces = materialize(pieces.withColumn("_unit", F.ceil(F.col("length") / GRAIN).cast("long"))
                         .withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS))))
    groups = materialize(pieces.groupBy("_unit", "_salt").agg(F.count("*").alias("n")))
    demand = {r["_unit"]: r.n for r in groups.groupBy("_unit").agg(F.sum("n").alias("n")).collect()}  # at most `room` rows
    slots = slot_table(solve_patterns(demand, room))
    slots = spark.createDataFrame(slots, "unit long, first long, many long, each long, sequence long, place long")
    before = Window.partitionBy("_unit").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("_unit", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_unit", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = (pieces.withColumn("_own", F.row_number().over(own)).join(offsets, ["_unit", "_salt"])
              .withColumn("_rank", F.col("_before") + F.col("_own") - 1))
    # the slots are as many as patterns times lengths, so bounded by the histogram
    placed = ranked.join(F.broadcast(slots), (F.col("_unit") == F.col("unit")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("many")))
    turn = F.col("_rank") - F.col("first")
    placed = (placed.withColumn("sequence_id", F.col("sequence") + F.floor(turn / F.col("each")).cast("long"))
              .withColumn("_place", F.col("place") * capacity + turn % F.col("each")))
    earlier = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
    return placed.select(*[c for c in pieces.columns if not c.startswith("_")], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence; `packed` comes from pieces cut with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
