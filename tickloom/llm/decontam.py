"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted-shingle check.

A text's words are runs of word characters in lower case. For each length of a benchmark item, windows of so many words slide
over the whole text; a text shorter than an item is one window itself. A window with fewer shingles of the benchmark than
the threshold asks for cannot reach it (an exact bound) and is passed over. All others get a 64-bit SimHash of their words
and word pairs. The fingerprints of the items are indexed by BLOCKS blocks of bits; a block is looked up with all its
variants of up to FLIPS bits, and as a fingerprint within RADIUS bits agrees with some block up to FLIPS bits, every item
within the radius is found. These candidates are decided by the weighted Jaccard similarity of word shingles (weights: how
often each occurs). RADIUS is far beyond what similarity 0.8 implies: see the recall test.

Edge cases: null and empty texts and items match nothing; an item shorter than SHINGLE words is one shingle; repeated
documents or items give the same pair once; a null doc_id or item_id stays null; empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import tidy

SHINGLE = 5
BLOCKS, FLIPS = 4, 4
RADIUS = BLOCKS * (FLIPS + 1) - 1
BLOCK_CHARS = 4_000_000  # characters of benchmark text that one pass over the documents takes
NEARBY = 4096  # words
_WIDTH = 64 // BLOCKS
_MASKS = np.array([sum(1 << i for i in c) for k in range(FLIPS + 1) for c in combinations(range(_WIDTH), k)])
_WORD = re.compile(r"\w+")


def _words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _signs(hashes: np.ndarray) -> np.ndarray:
    """Bits as 1 and -1."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1


def _votes(words: list[str]) -> np.ndarray:
    """Running sums of the bit votes of words and word pairs; row i: those of the words before i, a pair counts at its end."""
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    pair = np.zeros((len(h), 64), np.int8)
    pair[1:] = _signs((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] + (h[1:] << np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F))
    votes = np.zeros((len(h) + 1, 2, 64), np.int32)
    np.cumsum(_signs(h), axis=0, out=votes[1:, 0], dtype=np.int32)
    np.cumsum(pair, axis=0, out=votes[1:, 1], dtype=np.int32)
    return votes


def _fingerprints(votes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    total = votes[starts + length, 0] - votes[starts, 0] + votes[starts + length, 1] - votes[starts + 1, 1]
    return np.packbits(total > 0, axis=1).reshape(-1, 8).copy().view("<u8").ravel()


def shingle_counts(words: list[str]) -> Counter:
    size = min(SHINGLE, len(words))
    return Counter(zip(*[words[k:] for k in range(size)])) if words else Counter()


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return (prints >> np.uint64(b * _WIDTH) & np.uint64(2**_WIDTH - 1)).astype(np.int64)


def block_tables(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of bits: the values that occur, where the items of each value start, the items by value."""
    out = []
    for b in range(BLOCKS):
        v = _block(prints, b)
        order = np.argsort(v, kind="stable")
        start = np.searchsorted(v[order], np.arange(2**_WIDTH + 1))
        out.append((np.unique(v), start, order))
    return out


def within_radius(prints: np.ndarray, tables: list, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (position in wanted, position in prints) of fingerprints that differ in RADIUS bits at most."""
    every, which = np.unique(wanted, return_inverse=True)  # repeated passages have equal fingerprints
    found = [np.empty(0, np.int64)]
    for at in range(0, len(every), 256):
        some = every[at : at + 256]
        for b, (values, start, items) in enumerate(tables):
            own = _block(some, b)[:, None]
            if len(values) <= len(_MASKS):  # fewer values than variants: compare with the values
                rows, near = np.nonzero(np.bitwise_count(own ^ values) <= FLIPS)
                v = values[near]
            else:
                rows, masks = np.nonzero(start[(own ^ _MASKS) + 1] > start[own ^ _MASKS])
                v = own[rows, 0] ^ _MASKS[masks]
            n = start[v + 1] - start[v]
            item = items[np.repeat(start[v] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            row = np.repeat(rows, n)
            close = np.bitwise_count(some[row] ^ prints[item]) <= RADIUS
            found.append((at + row[close]) * len(prints) + item[close])
    pairs = np.unique(np.concatenate(found))
    by_print = np.argsort(which, kind="stable")
    first = np.searchsorted(which[by_print], np.arange(len(every) + 1))
    at, items = pairs // max(len(prints), 1), pairs % max(len(prints), 1)
    n = first[at + 1] - first[at]
    return by_print[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], np.repeat(items, n)


def build_index(items: list[tuple]) -> dict:
    """items: (item_id, text). Fingerprints, their block tables, shingles, and the word pairs that shingles are made of."""
    own = [(i, w) for i, t in items if (w := _words(t))]
    prints = np.array([_fingerprints(_votes(w), np.zeros(1, np.int64), len(w))[0] for _, w in own], np.uint64)
    shingles = [shingle_counts(w) for _, w in own]
    size = np.array([len(w) for _, w in own], np.int64)
    return {"ids": [i for i, _ in own], "size": size, "sizes": sorted({int(n) for n in size}), "prints": prints, "blocks": block_tables(prints), "shingles": shingles,
            "known": frozenset(x for counts in shingles for x in counts), "words": frozenset(x for _, w in own if len(w) < SHINGLE for x in w), "pairs": frozenset(x for _, w in own for x in zip(w, w[1:]))}


def windows(words: list[str], index: dict, threshold: float) -> dict[int, np.ndarray]:
    """Length -> first words of the windows that can reach the threshold with some item of that window length."""
    out: dict[int, np.ndarray] = {}
    for length in (n for n in index["sizes"] if n < SHINGLE):  # such an item is one shingle
        known = np.fromiter(map(index["words"].__contains__, words), np.bool_, len(words))
        run = np.concatenate([[0], np.cumsum(known)])
        starts = np.flatnonzero(run[length:] - run[:-length] == length)
        if len(starts):
            out[length] = starts
    places = len(words) - SHINGLE + 1
    if places < 1:
        return out
    pairs = np.fromiter(map(index["pairs"].__contains__, zip(words, words[1:])), np.bool_, len(words) - 1)
    maybe = np.flatnonzero(np.all(np.lib.stride_tricks.sliding_window_view(pairs, SHINGLE - 1), axis=1))
    hits = [at for at in maybe.tolist() if tuple(words[at : at + SHINGLE]) in index["known"]]
    if not hits:
        return out
    shared = np.zeros(places + 1, np.int32)
    shared[np.array(hits) + 1] = 1
    np.cumsum(shared, out=shared)
    for size in index["sizes"]:
        length = min(size, len(words))
        m, other = length - SHINGLE + 1, size - SHINGLE + 1
        least = max(1, int(np.ceil(threshold * (m + other) / (1 + threshold) - 1e-9)))  # shared / (m + other - shared) >= threshold
        if size >= SHINGLE and len(hits) >= least and length not in out:
            starts = np.flatnonzero(shared[m:] - shared[:-m] >= least)
            if len(starts):
                out[length] = starts
    return out


def find(text: str | None, index: dict, threshold: float) -> dict[int, tuple[float, int, int]]:
    """Item position -> (similarity, first word, words) of its most similar window."""
    words = _words(text)
    found: dict[int, tuple[float, int, int]] = {}
    for length, starts in windows(words, index, threshold).items():
        apart = np.flatnonzero(np.diff(starts // NEARBY)) + 1  # windows that lie together share their running sums
        for some in np.split(starts, apart):
            first = int(some[0])
            votes = _votes(words[first : int(some[-1]) + length])
            rows, items = within_radius(index["prints"], index["blocks"], _fingerprints(votes, some - first, length))
            fits = np.minimum(index["size"][items], len(words)) == length
            rows, items = rows[fits], items[fits]
            order = np.lexsort((rows, items))
            for start, item in zip(some[rows[order]].tolist(), items[order].tolist()):
                if item in found and found[item][0] == 1:
                    continue
                s = similarity(shingle_counts(words[start : start + length]), index["shingles"][item])
                if s >= threshold and (item not in found or s > found[item][0]):
                    found[item] = (s, start, length)
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): for each document and item, the most similar window (of n_words words).

    The benchmark is taken in blocks of about BLOCK_CHARS characters, each of which passes over all documents.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    result = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(build_index([tuple(r) for r in block.collect()]))

        @tidy
        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                out = [(doc, index["ids"][i], s, at, n) for doc, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]) for i, (s, at, n) in find(text, index, threshold).items()]
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "similarity", "start_word", "n_words"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        part = texts.mapInPandas(run, "doc_id long, item_id long, similarity double, start_word long, n_words long")
        result = part if result is None else result.union(part)
    best = F.max_by(F.struct("similarity", "start_word", "n_words"), F.struct("similarity", -F.col("start_word")))
    return result.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")
