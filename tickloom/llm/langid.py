"""Language identification by rank-order n-gram profiles (out-of-place distance).

Profile: a language's most frequent letter n-grams (1 to 3 letters of a lower-cased word with a space on both sides), in
order of frequency, ties by code point. A word is a letter (Unicode category L) with the letters and marks (M) after it. A document is ranked the same way over its whole text; its distance to a profile is the sum of rank
differences, with the profile length for an n-gram the profile lacks. The smallest distance wins, ties go to the first
language name.

Edge cases: a null text or one without a letter (digits, fractions and marks are none) is `und` with score 0; with no training rows every text is `und`; null
languages and null texts teach nothing; repeated rows count as often as they occur; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import tidy

PROFILE = 400  # n-grams in a profile
TRAIN_CHARS = 20_000_000  # about how many characters of each language are learned from (a sample by document id)
COUNTED_CHARS = 1_000_000  # about how many characters have their n-grams sorted at a time
MAX_LANGUAGES = 10_000  # more are an error, as the profiles are sent to all tasks (3 kB a language)
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def _grams(text: str | None) -> Iterator[np.ndarray]:
    """Codes of all 1- to 3-grams of the words, those of about COUNTED_CHARS characters at a time.

    A code holds up to three 21-bit characters; an n-gram has a space at its ends only.
    """
    words = _LETTERS.findall(text.lower()) if text else ()
    if not words:
        return
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(c), COUNTED_CHARS):
        own = c[at : at + COUNTED_CHARS + 2].astype(np.uint64)
        n, blank = min(COUNTED_CHARS, len(c) - at), own == 32
        two = (own[:-1] << np.uint64(21)) | own[1:]
        three = ((two[:-1] << np.uint64(21)) | own[2:])[~blank[1:-1]] if len(own) > 2 else two[:0]
        yield np.concatenate([own[:n][~blank[:n]], two[:n], three])


def _counted(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes, how often each occurs) over all parts; about COUNTED_CHARS codes are sorted at a time."""
    grams, counts, waiting, size = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        own, n = np.unique(np.concatenate(waiting), return_counts=True)
        if not len(grams):
            return own, n
        own, at = np.unique(np.concatenate([grams, own]), return_inverse=True)
        return own, np.bincount(at, weights=np.concatenate([counts, n])).astype(np.int64)

    for part in parts:
        waiting.append(part)
        size += len(part)
        if size >= COUNTED_CHARS:
            (grams, counts), waiting, size = merged(), [], 0
    return merged() if waiting else (grams, counts)


def _ranked(text: str | None) -> np.ndarray:
    grams, counts = _counted(_grams(text))
    if len(grams) > PROFILE:  # only the foremost need an order
        floor = np.partition(counts, -PROFILE)[-PROFILE]
        kept = counts >= floor
        grams, counts = grams[kept], counts[kept]
    return grams[np.argsort(-counts, kind="stable")][:PROFILE]


def train_profiles(docs: DataFrame, chars: int = TRAIN_CHARS) -> dict[str, np.ndarray]:
    """Language -> codes of its n-grams, most frequent first. docs: text, lang and doc_id; all rows may be learned from.

    Where a language has more than `chars` characters, a sample of its documents by a hash of doc_id is used.
    """
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).limit(MAX_LANGUAGES + 1).collect() if r.n}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    large = [F.lit(x) for k, n in sizes.items() if n > chars for x in (k, chars / n)]
    if large:
        share = F.coalesce(F.create_map(*large)[F.col("lang")], F.lit(1.0))
        rows = rows.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(1_000_000)) < share * 1_000_000)

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                grams, counts = _counted(part for t in texts for part in _grams(t))
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": counts.astype(np.int64)})

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (rows.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
           .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE))
    found: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r["rank"])):  # at most PROFILE rows a language
        found.setdefault(r.lang, []).append(r.gram)
    return {k: np.array(v, np.uint64) for k, v in found.items()}


def predictor(profiles: dict[str, np.ndarray]):
    """A column function text -> struct(lang_pred, score); the score is 1 less the distance as a share of the largest."""
    names = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.empty(0, np.uint64)
    ranks = np.full((len(names), len(grams) + 1), -1, np.int64)
    for i, k in enumerate(names):
        ranks[i, np.searchsorted(grams, profiles[k])] = np.arange(len(profiles[k]))

    def one(text: str | None) -> tuple[str, float]:
        own = _ranked(text)
        if not len(own) or not names:
            return "und", 0.0
        at = np.searchsorted(grams, own)
        at[grams[np.minimum(at, len(grams) - 1)] != own] = len(grams)  # in no profile
        r = ranks[:, at]
        far = np.where(r < 0, PROFILE, np.minimum(np.abs(r - np.arange(len(own))), PROFILE)).sum(axis=1)
        best = int(far.argmin())
        return names[best], float(1 - far[best] / (PROFILE * len(own)))

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str | Column = "text") -> DataFrame:
    """All columns of docs with a struct column `language` (lang_pred, score) after them."""
    return docs.withColumn("language", predictor(profiles)(text))
