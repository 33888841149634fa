"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer numpy network.

Each word has a sparse random index vector that follows from a hash of the word alone. A word's context vector is the sum of
the index vectors of the words next to it in the training texts; it is kept in one of SLOTS slots by the word's hash, so no
vocabulary is cut off and the table has a fixed size. A word's vector is its context vector, normalised, plus its own index
vector, normalised again. A document is the mean and the spread of its word vectors over the whole text and the norm of that
mean; a network of two layers gives a probability, calibrated by a temperature that is fitted to cross-fitted logits.

Edge cases: null and empty texts are scored as a document without words; without training rows of both classes every
score is the share of label 1 (0.5 with none); a document labelled twice is learned from with its smallest label; null
labels and ids teach nothing; the sample is chosen by a hash of doc_id, so all rows of a document are in it or none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.chunks import spans
from tickloom.llm.common import tidy

DIM = 32  # of the vectors
WIDTH = 2 * DIM + 1  # of the sums: vectors, their squares, how many
NONZERO = 4  # entries of an index vector that are not 0
WINDOW = 2  # neighbours on either side
TRAIN_ROWS = 12_000  # about how many labelled documents are learned from (a sample by document id)
SLOTS = 65_536  # of context vectors
HIDDEN, EPOCHS, FOLDS, SEED = 32, 60, 3, 7
MADE = 16_384  # chunks whose sums are made or added at a time
#: Letters in lower, upper or mixed case, digits and runs of other marks are words of their own.
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def _words(text: str | None) -> list[str]:
    """Lower-case words and marks, with `<caps>` before a word in capitals."""
    out = []
    for w in _WORD.findall(text) if text else ():
        low = w.lower()
        if len(w) > 1 and w != low and w == w.upper():
            out.append("<caps>")
        out.append(low)
    return out


def _sparse_rows(seed: int) -> np.ndarray:
    """4096 vectors of NONZERO / 2 entries of 1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((4096, DIM), np.float32)
    for _ in range(NONZERO // 2):
        np.add.at(out, (np.arange(4096), rng.integers(0, DIM, 4096)), rng.choice([-1.0, 1.0], 4096))
    return out


_LEFT, _RIGHT = _sparse_rows(1), _sparse_rows(2)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def index_vectors(h: np.ndarray) -> np.ndarray:
    """Sparse random vectors, each the sum of two of 4096 that a hash picks: 16 million different ones."""
    return _LEFT[(h & np.uint64(4095)).astype(np.int64)] + _RIGHT[(h >> np.uint64(12) & np.uint64(4095)).astype(np.int64)]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(24) & np.uint64(SLOTS - 1)).astype(np.int64)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def _chunk_sums(chunks: list[bytes], context: np.ndarray) -> np.ndarray:
    """For each chunk the sums over its words of the vectors and their squares, and how many words it has."""
    out = np.zeros((len(chunks), WIDTH), np.float32)
    for at in range(0, len(chunks), MADE):
        flat: list[str] = []
        sizes = []
        for chunk in chunks[at : at + MADE]:
            text = chunk.decode("utf-8", "replace")
            word = text[1:] if text[:1] == " " else text
            if word.isalpha() and word.islower():
                flat.append(word)
                sizes.append(1)
            else:
                own = _words(text)
                flat += own
                sizes.append(len(own))
        for some in _runs(sizes):
            first = sum(sizes[: some.start])
            own = flat[first : first + sum(sizes[some])]
            if own:
                h = word_hashes(own)
                v = _unit(index_vectors(h) + context[_slots(h)])
                rows = np.repeat(np.arange(at + some.start, at + some.stop), sizes[some])
                every = np.concatenate([v, v * v, np.ones((len(v), 1), np.float32)], axis=1)
                starts = np.flatnonzero(np.diff(rows, prepend=-1))
                out[rows[starts]] = np.add.reduceat(every, starts, axis=0)
    return out


def _runs(sizes: list[int]) -> Iterator[slice]:
    """Consecutive chunks with about 4 * MADE words together; a longer chunk is one run."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > 4 * MADE:
            yield slice(first, i)
            first = i
            total = 0
        total += n
    if first < len(sizes):
        yield slice(first, len(sizes))


def pooled(texts: pa.Array, context: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of its word vectors, the norm of the mean."""
    total = np.zeros((len(texts), WIDTH))
    for span in spans(texts):
        sums = _chunk_sums(span.chunks, context)
        bounds = [0, *span.upto.tolist(), len(span.codes)]
        for text, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]), span.first):
            if b > a:
                rows, counts = np.unique(span.codes[a:b], return_counts=True)
                for at in range(0, len(rows), MADE):
                    total[text] += counts[at : at + MADE].astype(np.float32) @ sums[rows[at : at + MADE]]
    n = np.maximum(total[:, -1:], 1)
    mean = total[:, :DIM] / n
    spread = np.sqrt(np.maximum(total[:, DIM : 2 * DIM] / n - mean * mean, 0))
    return np.concatenate([mean, spread, np.sqrt((mean * mean).sum(axis=1, keepdims=True))], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit_network(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """tanh layer and logistic layer by Adam on mini-batches."""
    rng = np.random.default_rng(SEED)
    net = {"mu": x.mean(0), "sd": x.std(0) + 1e-6}
    x = (x - net["mu"]) / net["sd"]
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            h = np.tanh(x[rows] @ p[0] + p[1])
            e = (_sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
            d = np.outer(e, p[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((x[rows].T @ d + 1e-4 * p[0], d.sum(0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.005 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net | {"w1": p[0], "b1": p[1], "w2": p[2], "b2": p[3], "t": np.ones(1)}


def _logit(net: dict, x: np.ndarray) -> np.ndarray:
    return np.tanh((x - net["mu"]) / net["sd"] @ net["w1"] + net["b1"]) @ net["w2"] + net["b2"][0]


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss."""

    def loss(t: float) -> float:
        p = np.clip(_sigmoid(z / t), 1e-6, 1 - 1e-6)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    return min(np.geomspace(0.25, 8, 60), key=loss)


def _fit_calibrated(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The network over all rows; its temperature from logits of rows that networks over the other folds did not see."""
    fold = np.empty(len(y), np.int64)
    for label in (0, 1):  # both classes in every fold, as far as there are rows
        rows = np.flatnonzero(y == label)
        fold[rows] = np.arange(len(rows)) % FOLDS
    z = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and (fold != k).any():
            z[fold == k] = _logit(_fit_network(x[fold != k], y[fold != k]), x[fold == k])
    return _fit_network(x, y) | {"t": np.array([_temperature(z, y)])}


class QualityModel:
    def __init__(self, context: np.ndarray, net: dict | None, prior: float):
        self.context, self.net, self.prior = context, net, prior

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.net is None or not len(texts):
            return np.full(len(texts), self.prior)
        return np.round(_sigmoid(_logit(self.net, pooled(texts, self.context)) / self.net["t"][0]), 9)


def _contexts(texts: list[str | None], total: np.ndarray) -> None:
    """Adds the index vectors of the neighbours of all words to the words' slots."""
    for text in texts:
        own = _words(text)
        if not own:
            continue
        h = word_hashes(own)
        for first in range(0, len(h), 65_536):  # with the neighbours on both sides
            a, b = max(first - WINDOW, 0), min(first + 65_536 + WINDOW, len(h))
            base = index_vectors(h[a:b])
            near = np.zeros_like(base)
            for k in range(1, WINDOW + 1):
                near[k:] += base[:-k]
                near[:-k] += base[k:]
            own_rows = slice(first - a, min(first + 65_536, len(h)) - a)
            slots, near = _slots(h[a:b][own_rows]), near[own_rows]
            order = np.argsort(slots, kind="stable")
            starts = np.flatnonzero(np.diff(slots[order], prepend=-1))
            total[slots[order][starts]] += np.add.reduceat(near[order], starts, axis=0)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from doc_id, text and label (0 or 1). At most about `rows` rows are used, chosen by a hash of doc_id."""
    labelled = labelled.select("doc_id", "text", "label").where("doc_id IS NOT NULL AND label IS NOT NULL")
    n = labelled.count()
    none = np.zeros((SLOTS, DIM), np.float32)
    if not n:
        return QualityModel(none, None, 0.5)
    share = int(min(1.0, rows / n) * 1_000_000)
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)

    @tidy
    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((SLOTS, DIM), np.float32)
        for pdf in batches:
            _contexts(list(pdf["text"]), total)
        met = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(met), 4096):
            yield pd.DataFrame({"slot": met[at : at + 4096], "v": list(total[met[at : at + 4096]])})

    parts = sample.select("text").mapInPandas(contexts, "slot int, v array<float>")
    summed = parts.groupBy("slot").agg(*[F.sum(F.col("v")[i]).cast("float").alias(f"v{i}") for i in range(DIM)]).toArrow()  # SLOTS rows at most
    context = none
    context[summed["slot"].to_numpy()] = _unit(np.stack([summed[f"v{i}"].to_numpy() for i in range(DIM)], axis=1))
    shared = sample.sparkSession.sparkContext.broadcast(context)

    @tidy
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), shared.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "label", "x"])

    known = sample.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    rows_ = known.mapInArrow(features, "doc_id long, label int, x binary").toArrow().to_pandas()  # a bounded sample
    shared.unpersist()
    rows_ = rows_.sort_values(["doc_id", "label", "x"], kind="stable").drop_duplicates("doc_id")
    y = rows_["label"].clip(0, 1).to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return QualityModel(context, None, float(y.mean()) if len(y) else 0.5)
    return QualityModel(context, _fit_calibrated(np.frombuffer(b"".join(rows_["x"]), np.float32).reshape(len(y), -1).astype(np.float64), y), float(y.mean()))


def scorer(spark, model: QualityModel):
    """A column function text -> score (0 to 1)."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(texts), pa.float64())

    return score
