"""Source divergence audit: how far the term shares of a language's sources lie apart, exactly, over integer dictionaries.

Texts are dealt by (lang, source) and blocks of input partitions, so that a task meets the terms of few sources again and
again and the texts of a large source go to many tasks. Tasks count terms and documents for each (lang, source, term).
These counts are dealt by ranges of (lang, term) and
sorted, so that a task sees every row of its terms in UTF-8 order: it keeps the terms that enough documents of the language
hold, as sorted arrays of at most WIDTH terms, finds each row's id in them by binary search and adds the counts up by one
bincount over (source, id). Ids rise with the terms, across tasks too, so ties go by ids. A chunk of terms is then one
dense matrix of sources by terms; sums of absolute differences and the best terms of each chunk are joined by Spark.

Shares are 1 + floor(10^9 (count + 5) / (N + 5 V)), by long division in 64-bit integers. A task holds one chunk of one
language: WIDTH counts for each of its sources.

Edge cases: null text, lang and source count as ''; texts are read whole; every (lang, source) that occurs has its pairs,
without terms too, and with value 0 where the language keeps none; a language of one source has no pairs; repeated rows
count as often as they occur; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import materialize, tidy

WIDTH = 1024  # terms of a chunk
ROWS = 32_768  # sorted rows that are encoded at a time, at least
DEALT = 4  # input partitions whose texts of one (lang, source) are counted together
HELD = 150_000  # distinct (lang, source, term) that a map task holds, about
SENT = 10_000  # of them in a batch
SMOOTH, ONE = 5, 1_000_000_000
TERMS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Matches of `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in UTF-8 text with A-Z lower-cased."""
    return text.translate(TERMS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, d) over all rows of docs (lang, source, text), none of them null: occurrences in the rows with a source, documents of the language in those without."""

    def flush(found: dict[tuple[str, str | None], Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), n in found.items():
            for at in range(0, len(n), SENT):
                some = list(itertools.islice(n.items(), at, at + SENT))
                counts, none = pa.array([c for _, c in some], pa.int64()), pa.array([0] * len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array([t for t, _ in some], pa.binary()).cast(pa.string()),
                    none if source is None else counts, counts if source is None else none], ["lang", "source", "term", "c", "d"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str | None], Counter] = {}
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, (lang, source) in enumerate(zip(langs, sources)):
                own = terms(batch.column(2)[at].as_py())
                found.setdefault((lang, source), Counter()).update(own)
                found.setdefault((lang, None), Counter()).update(set(own))
            if sum(map(len, found.values())) > HELD:
                yield from flush(found)
                found = {}
        yield from flush(found)

    dealt = docs.withColumn("_block", F.floor(F.spark_partition_id() / DEALT)).repartition("lang", "source", "_block")
    counted = dealt.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term string, c long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))


def encode(pdf: pd.DataFrame, least: int) -> Iterator[tuple[str, np.ndarray, list[str], np.ndarray]]:
    """Chunks of whole terms, sorted by (lang, term): (lang, kept terms, sources, counts of sources by terms)."""
    for lang, rows in pdf.groupby("lang", sort=False):
        word = rows["term"].to_numpy(object)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        kept = word[starts][np.add.reduceat(rows["d"].to_numpy(np.int64), starts) >= least]
        if not len(kept):
            continue
        ids = np.searchsorted(kept, word)
        ids[ids == len(kept)] = 0
        known = kept[ids] == word
        known &= rows["source"].notna().to_numpy()
        ids, counts = ids[known], rows["c"].to_numpy(np.int64)[known]
        codes, sources = pd.factorize(rows["source"].to_numpy(object)[known], sort=True)
        for at in range(0, len(kept), WIDTH):
            here = (ids >= at) & (ids < at + WIDTH)
            width = min(WIDTH, len(kept) - at)
            flat = np.bincount(codes[here] * width + ids[here] - at, weights=counts[here], minlength=len(sources) * width)  # exact below 2^53
            yield lang, kept[at : at + width], list(sources), flat.astype(np.int64).reshape(-1, width)


def chunk_vectors(counts: DataFrame, least: int) -> DataFrame:
    """(lang, chunk, source, terms, counts): dense counts of the kept terms of a chunk, for each source that holds one; terms stand in the first row of a chunk only."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 33, 0
        waiting: list[pd.DataFrame] = []

        def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal number
            for lang, kept, sources, matrix in encode(pdf, least):
                some = [i for i in range(len(sources)) if matrix[i].any()]
                yield pd.DataFrame({"lang": lang, "chunk": first + number, "source": [sources[i] for i in some], "terms": [list(kept) if i == some[0] else None for i in some], "counts": [matrix[i] for i in some]})
                number += 1

        for pdf in batches:
            waiting.append(pdf)
            if sum(map(len, waiting)) >= ROWS:
                pdf = pd.concat(waiting, ignore_index=True)
                last = (pdf["lang"] == pdf["lang"].iloc[-1]) & (pdf["term"] == pdf["term"].iloc[-1])  # its rows may go on
                yield from whole(pdf[~last])
                waiting = [pdf[last]]
        if waiting:
            yield from whole(pd.concat(waiting, ignore_index=True))

    ordered = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return ordered.mapInPandas(run, "lang string, chunk long, source string, terms array<string>, counts array<long>")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * (counts + SMOOTH) / whole), with whole (each at least counts + SMOOTH, below 2^53) down the rows; exact."""
    out, rest = np.divmod(counts + SMOOTH, whole[:, None])
    for _ in range(3):  # three decimal digits at a time
        digits, rest = np.divmod(rest * 1000, whole[:, None])
        out = out * 1000 + digits
    return out + 1


def _compare(pdf: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of one chunk of one language: (source, part, item, value, id) with the pair sums over its terms and each source's best terms."""
    pdf = pdf.sort_values("source", ignore_index=True)
    width = int(pdf["width"].iloc[0])
    counts = np.zeros((len(pdf), width), np.int64)
    named: list[str] = []
    for i, (v, t) in enumerate(zip(pdf["counts"], pdf["terms"])):
        if v is not None:
            counts[i] = v
        if t is not None:
            named = list(t)
    p = shares(counts, pdf["whole"].to_numpy(np.int64))
    q = shares(counts.sum(axis=0)[None], pdf["lang_whole"].to_numpy(np.int64)[:1])[0]
    source = pdf["source"].to_numpy(object)
    out = []
    for i in range(len(pdf)):
        others = np.arange(len(pdf)) != i
        out.append(pd.DataFrame({"source": source[i], "part": "pair", "item": source[others], "value": np.abs(p[others] - p[i]).sum(axis=1), "id": 0}))
        over = np.flatnonzero((counts[i] > 0) & (p[i] > q))
        best = over[np.argsort(q[over] - p[i][over], kind="stable")][:top]  # ties by id, so by term
        out.append(pd.DataFrame({"source": source[i], "part": "term", "item": [named[j] for j in best], "value": (p[i] - q)[best], "id": best}))
    return pd.concat(out, ignore_index=True).assign(lang=pdf["lang"].iloc[0], chunk=pdf["chunk"].iloc[0])


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) over all rows of docs (lang, source, text).

    Terms in at least `least` documents of a language are kept; part `pair` has every other source of the language, part
    `term` the `top` terms whose share in the source exceeds that in the language the most.
    """
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vectors = materialize(chunk_vectors(term_counts(docs), least))
    chunks = vectors.where("terms IS NOT NULL").select("lang", "chunk", F.size("terms").alias("width"))
    lang_terms = chunks.groupBy("lang").agg(F.sum("width").alias("v"))
    in_group = vectors.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    groups = docs.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left").fillna(0, ["n"])
    in_lang = groups.groupBy("lang").agg(F.sum("n").alias("lang_n")).join(lang_terms, "lang", "left").fillna(0, ["v"])
    smoothed = lambda n: F.greatest(F.col(n) + SMOOTH * F.col("v"), F.lit(1))  # noqa: E731  # 1 only where nothing is divided
    groups = materialize(groups.join(in_lang, "lang").select("lang", "source", smoothed("n").alias("whole"), smoothed("lang_n").alias("lang_whole")))
    empty = groups.select("lang").distinct().select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("width"))  # gives pairs where nothing is kept
    cells = groups.join(chunks.unionByName(empty), "lang").join(vectors, ["lang", "chunk", "source"], "left")
    compared = cells.groupBy("lang", "chunk").applyInPandas(lambda pdf: _compare(pdf, top), "lang string, chunk long, source string, part string, item string, value long, id int")
    compared = materialize(compared)
    pairs = compared.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id")
    found = compared.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(found.select(columns))
