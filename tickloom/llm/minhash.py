"""Near-duplicate detection: MinHash bands propose pairs, sequential Bayesian tests prune them, full sets decide.

1. Each text becomes its set of word shingles, a signature of BANDS * ROWS minima and BANDS bucket keys. Texts with equal
   sets form a class; only one member of each class goes on, so copies cost nothing further.
2. A class is paired with the smallest id of each of its buckets. Signatures are compared in batches: after each, a pair
   goes if the posterior probability (uniform prior) that its similarity reaches the threshold is below MISS.
3. The most similar survivor of each class is decided on the full shingle sets; links make parts.
4. Buckets that still hold several parts are compared in blocks of signatures inside the tasks, so that a pair that misses
   its bucket's smallest id is found too. A block gives a spanning forest of its survivors, not all of them: with the open
   survivors of step 2 they join whole parts to clusters, so that every survivor lies inside one cluster.
5. Clusters, with all members of their parts, are decided on the full sets, block by block inside the tasks; a block gives
   a spanning forest of its links. Nothing is capped, and no step emits the pairs of a group.

At similarity 0.8 two sets share no bucket with probability (1 - 0.8**ROWS)**BANDS, about 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import materialize, small_enough, tidy, words
from tickloom.llm.components import connected_components

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
BATCH = 40  # hashes compared before each test
MISS = 1e-6  # posterior probability below which a pair goes
SIGNATURE_BLOCK = 1024  # rows of a block when signatures are compared
SET_BLOCK = 256  # the same for full sets
SALTS = 64  # parts of a bucket, so that a hot one is led and joined by many tasks

_rng = np.random.default_rng(20240501)
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = (_rng.integers(0, 2**63, ROWS, dtype=np.uint64) | np.uint64(1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of the whole sequence if it is shorter.

    Two different runs have equal hashes with probability 2**-64, so that two texts of 10,000 shingles each meet such a pair
    with a probability below 1e-11.
    """
    own = words(text)
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, (np.multiply.outer(_A, x[i : i + 1024]) + _B[:, None]).min(axis=1), out=best)
    return best


def _sketches(size: int):
    salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, key, sig, bands = [], [], [], []
            for text in pdf["text"]:
                s = shingle_hashes(text, size)
                n.append(len(s))
                if len(s):
                    v = signature(s)
                    key.append(xxhash.xxh128_digest(s.tobytes()))
                    sig.append((v & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
                    rows = v.reshape(BANDS, ROWS).astype(np.uint64)
                    bands.append(_mix((rows * _MIX).sum(axis=1) + salt).astype(np.int64))
                else:
                    key.append(None), sig.append(None), bands.append(None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_shingles": n, "key": key, "sig": sig, "bands": pd.Series(bands, dtype=object)})

    return run


@lru_cache(maxsize=16)
def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed) after each batch: fewer matches leave P(similarity >= threshold) below `miss`.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    t, out = Fraction(threshold).limit_denominator(1000), []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while m < n and tail < miss:
            m += 1
            tail += float(comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m))
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequential test of the row pairs of two signature tables: (rows that survive, their matches)."""
    rows, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in least_matches(threshold):
        matches = matches + (a[rows, done:n] == b[rows, done:n]).sum(axis=1)
        kept = matches >= least
        rows, matches, done = rows[kept], matches[kept], n
    return rows, matches


def _table(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), HASHES)


def _exact(docs: DataFrame, edges: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """The edges (a, b) whose full shingle sets reach the threshold; an id with several texts links by any of them."""
    num, den = threshold.numerator, threshold.denominator

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        seen: dict[str, np.ndarray] = {}
        out = []
        for pair in zip(left, right):
            for t in pair:
                if t not in seen:
                    if len(seen) > 64:
                        seen.clear()
                    seen[t] = shingle_hashes(t, size)
            x, y = (seen[t] if t in seen else shingle_hashes(t, size) for t in pair)
            both = np.intersect1d(x, y, assume_unique=True).size
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    texts = docs.select(F.col("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    left, right = texts.toDF("a", "left"), texts.toDF("b", "right")
    return edges.select("a", "b").join(left, "a").join(right, "b").where(alike("left", "right")).select("a", "b")


class _Forest:
    """Union-find over the labels of a block's rows."""

    def __init__(self, labels: np.ndarray):
        self.label, self.of = np.unique(labels, return_inverse=True)
        self.root = np.arange(len(self.label))

    def roots(self) -> np.ndarray:
        return self.root[self.of]

    def join(self, i: int, j: int) -> bool:
        a, b = self.root[self.of[i]], self.root[self.of[j]]
        if a == b:
            return False
        self.root[self.root == max(a, b)] = min(a, b)
        return True


def _in_blocks(rows: DataFrame, key: str, block: int, compare, schema: str) -> DataFrame:
    """Compare the rows of each key in blocks: compare(frame, rows of the second block or None) for pairs of blocks.

    rows: key, id, component, main (the component with most rows of the key), n_main, size (rows of the key) and more. Rows
    of the main component need no comparison with each other: they make blocks of their own, each of which meets the blocks
    of the other rows alone, so few other rows cost few copies however many rows the key has. A frame holds two blocks at most.
    """
    is_main = F.col("component") == F.col("main")
    blocks = lambda n: F.ceil(n / block).cast("int")
    others, mains = blocks(F.col("size") - F.col("n_main")), blocks(F.col("n_main"))  # blocks 0 .. others - 1 are those of other rows
    at = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    spread = (rows.withColumn("own", F.when(is_main, others + at(mains)).otherwise(at(others)))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_main, others).otherwise(others + mains) - 1)))
              .withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "size", "main", "n_main"))
    keys = [key, "x", "y"]

    def one(g: pd.DataFrame) -> pd.DataFrame | None:
        g = g.reset_index(drop=True)
        second = (g["own"] == g["y"]).to_numpy() if g["x"].iat[0] != g["y"].iat[0] else None
        return compare(g, second)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            for i, j in zip(starts[:-1], starts[1:]):
                if j > i + 1 and (out := one(pdf.iloc[i:j])) is not None:
                    yield out
            rest = pdf.iloc[starts[-1] :] if len(starts) else None
        if rest is not None and len(rest) > 1 and (out := one(rest)) is not None:
            yield out

    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _close_rows(i: int, n: np.ndarray, roots: np.ndarray, second: np.ndarray | None, threshold: float) -> np.ndarray:
    """Later rows (or those of the other block) that are of another part than row i and of a size that allows a link."""
    ok = (roots != roots[i]) & (np.minimum(n, n[i]) >= threshold * np.maximum(n, n[i]) - 1e-9)
    ok &= np.arange(len(n)) > i if second is None else second != second[i]
    return np.flatnonzero(ok)


def _signature_forest(threshold: float):
    def compare(g: pd.DataFrame, second: np.ndarray | None) -> pd.DataFrame | None:
        s, ids, n, forest, out = _table(g["sig"]), g["id"].to_numpy(), g["n"].to_numpy(), _Forest(g["component"].to_numpy()), []
        for i in range(len(g)) if second is None else np.flatnonzero(~second):
            near = _close_rows(i, n, forest.roots(), second, threshold)
            if len(near):
                rows, _ = survivors(np.broadcast_to(s[i], (len(near), HASHES)), s[near], threshold)
                out += [(ids[i], ids[j]) for j in near[rows] if forest.join(i, j)]
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return compare


def _set_forest(size: int, threshold: Fraction):
    num, den = threshold.numerator, threshold.denominator

    def compare(g: pd.DataFrame, second: np.ndarray | None) -> pd.DataFrame | None:
        if (g["component"] == g["component"].iat[0]).all():
            return None
        sets = [shingle_hashes(t, size) for t in g["text"]]
        n, ids, forest, out = np.array([len(x) for x in sets]), g["id"].to_numpy(), _Forest(g["component"].to_numpy()), []
        if not n.all():  # texts of a repeated id that have no shingles
            keep = np.flatnonzero(n > 0)
            return compare(g.iloc[keep].reset_index(drop=True), None if second is None else second[keep]) if len(keep) > 1 else None
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts, mark = np.concatenate([[0], np.cumsum(n)[:-1]]), np.zeros(len(names), np.int32)
        for i in range(len(g)) if second is None else np.flatnonzero(~second):
            near = _close_rows(i, n, forest.roots(), second, num / den)
            if len(near):
                mark[:] = 0
                mark[flat[starts[i] : starts[i] + n[i]]] = 1
                both = np.add.reduceat(mark[flat], starts)[near]
                out += [(ids[i], ids[j]) for j in near[den * both >= num * (n[i] + n[near] - both)] if forest.join(i, j)]
        return pd.DataFrame(out, columns=["a", "b"]) if out else None

    return compare


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """(key, main, n_main, size) of the keys with rows (key, component) of several components."""
    each = rows.groupBy(key, "component").agg(F.count("*").alias("n"))
    most = F.max_by("component", F.struct("n", -F.col("component")))
    return each.groupBy(key).agg(most.alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1").drop("parts")


def _whole_clusters(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, component, cluster): the parts (id, component) that candidates (a, b) join, with all their members; an end without a part is one of its own."""
    ends = parts.toDF("a", "pa"), parts.toDF("b", "pb")
    joined = candidates.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    clusters = materialize(connected_components(joined).toDF("component", "cluster"))
    alone = clusters.join(parts.select(F.col("id").alias("component")), "component", "left_anti")
    return materialize(clusters.join(parts, "component").select("id", "component", "cluster").union(alone.select(F.col("component").alias("id"), "component", "cluster")))


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of similarity >= threshold; kept marks that document.

    Edge cases: null, empty and blank texts have no shingles and link with nothing; rows with the same doc_id are one
    document (any of their texts may link it); a row without doc_id is kept, unlinked, with a null component_id; an empty
    table gives an empty table.
    """
    exact_threshold = Fraction(threshold).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialize(docs.mapInPandas(_sketches(shingle), "doc_id long, n_shingles long, key binary, sig binary, bands array<long>"))
    known = sketch.where("doc_id IS NOT NULL AND key IS NOT NULL")

    classes = known.groupBy("key").agg(F.min("doc_id").alias("rep"))
    member = materialize(known.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "rep"))
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    same_id = member.join(several, "doc_id").select("a", F.col("rep").alias("b"))

    ones = known.join(classes.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["rep", "key"])
    ones = materialize(ones.select(F.col("rep").alias("id"), F.col("n_shingles").cast("int").alias("n"), "sig", "bands"))
    sigs = ones.select("id", "sig")

    banded = ones.select("id", "n", F.explode("bands").alias("band")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    parts_of = banded.groupBy("band", "salt").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("size"))
    shared = parts_of.groupBy("band").agg(F.min("lead").alias("lead"), F.sum("size").alias("size")).where("size > 1")
    leads = parts_of.select("band", "salt").join(shared, "band")  # a row for each part, so at most SALTS of a bucket
    members = materialize(banded.join(leads, ["band", "salt"]).select("band", "size", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n")))

    close = F.least("n", "lead_n") >= F.greatest("n", "lead_n") * threshold - 1e-9
    pairs = members.where((F.col("id") != F.col("lead")) & close).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()

    @F.pandas_udf("int")
    def test(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), -1, np.int32)
        if len(left):
            rows, m = survivors(_table(left), _table(right), threshold)
            out[rows] = m
        return pd.Series(out)

    test = test.asNondeterministic()  # else the filter below is pushed under the column, and each pair is tested twice
    tested = (pairs.join(sigs.toDF("a", "left"), "a").join(sigs.toDF("b", "right"), "b")
              .withColumn("m", test("left", "right")).where("m >= 0").select("a", "b", "m"))
    tested = materialize(tested.groupBy("a", "b").agg(F.max("m").alias("m")))
    first = tested.groupBy("b").agg(F.max_by("a", F.struct("m", -F.col("a"))).alias("a")).select("a", "b")
    links = materialize(_exact(docs, first, shingle, exact_threshold).union(same_id))
    parts = connected_components(links)

    ends = parts.toDF("a", "pa"), parts.toDF("b", "pb")
    still_open = (tested.join(first, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
                  .where(F.coalesce("pa", "a") != F.coalesce("pb", "b")).select("a", "b"))
    labelled = members.where("size > 2").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    compared = labelled.drop("size").join(_mixed(labelled, "band"), "band").join(sigs, "id").select("band", "size", "main", "n_main", "id", "component", "n", "sig")
    missed = _in_blocks(compared, "band", SIGNATURE_BLOCK, _signature_forest(threshold), "a long, b long")
    candidates = materialize(still_open.union(missed).distinct())
    if not small_enough(candidates, 0):
        grouped = _whole_clusters(candidates, parts)
        inside = grouped.join(_mixed(grouped, "cluster"), "cluster").join(docs.toDF("id", "text").where("text IS NOT NULL"), "id")
        columns = ["cluster", "size", "main", "n_main", "id", "component", "text"]
        new = _in_blocks(inside.select(*columns), "cluster", SET_BLOCK, _set_forest(shingle, exact_threshold), "a long, b long")
        parts = connected_components(links.union(materialize(new)))

    reps = member.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    to = (reps.join(parts, reps.rep == parts.id, "left")
          .select(F.col("doc_id").alias("of"), F.coalesce("component", "rep").alias("part")))
    out = sketch.join(to, sketch.doc_id == to.of, "left")
    component = F.coalesce("part", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
