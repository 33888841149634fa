"""Hidden Markov language model: Baum-Welch over all training texts, exact likelihood by the scaled forward recursion.

Tokens are the lower-cased words of a text and one end. Exact token counts of the training texts give the base model and
the alphabet: the SINGLES most frequent tokens are symbols of their own, all others fall into CLASSES classes by a hash of
their last bytes. A state emits symbols; a token's share within its class follows the smoothed counts. Each round of
Baum-Welch adds up the expected counts of all partitions, over whole texts, until a round gains little: a text of more than LONG tokens is worked on
in segments, which get the forward and backward messages at their borders from the transfer matrices of all segments.
Scoring joins segments of SEGMENT tokens by such matrices, which gives the likelihood of the whole sequence.

Edge cases: a null or empty text has the end token alone; without training texts N and V are 0 and scores follow from the
smoothing alone; repeated rows count as often as they occur; a null doc_id stays null and is held out or not as the
caller's column says; ties in the order of tokens go by their bytes as text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import materialize, words

END = " "  # no word holds a blank
SMOOTH = 0.1
STATES, SEED = 8, 11
ROUNDS, MOST_ROUNDS, GAIN = 5, 30, 0.001  # training ends after ROUNDS once a round adds less than this share of the log-likelihood
SINGLES, CLASSES = 8192, 1024
DICTIONARY = 131_072  # frequent tokens whose counts are sent to all tasks; the others are joined
SEGMENT = 256  # tokens that scoring runs through at a time
LONG = 100_000  # tokens that training runs through at a time
GROUP = 800_000  # tokens whose messages a task holds at a time, about


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of texts (text); every row adds one END."""

    def table(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"token": [t.decode("utf-8", "replace") for t in counts], "c": list(counts.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                counts.update(words(text))
            counts[END.encode()] += len(pdf)
            if len(counts) > 150_000:
                yield table(counts)
                counts = Counter()
        if counts:
            yield table(counts)

    return texts.select("text").mapInPandas(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _dictionary(counts: DataFrame, limit: int = DICTIONARY) -> tuple[list[str], list[int]]:
    """The most frequent tokens and their counts, the most frequent first; tokens of one count are all in or all out, so at most `limit`."""
    total, least = 0, None
    for r in counts.groupBy("c").agg(F.count("*").alias("v")).orderBy(F.desc("c")).limit(limit).collect():
        total += r.v
        if total > limit:
            break
        least = r.c
    if least is None:
        return [], []
    rows = sorted((-r.c, r.token) for r in counts.where(F.col("c") >= least).collect())
    return [t for _, t in rows], [-c for c, _ in rows]


class Alphabet:
    """Symbols and log shares of tokens. place: token -> position among the DICTIONARY most frequent; counts: theirs."""

    def __init__(self, names: list[str], counts: np.ndarray, class_mass: np.ndarray):
        self.place = {t.encode(): i for i, t in enumerate(names)}
        self.symbols = np.array([i if i < SINGLES else SINGLES + class_of(t.encode()) for i, t in enumerate(names)], np.uint16)
        self.log_count = np.log10(counts + SMOOTH) if len(counts) else np.zeros(0)
        self.log_mass = np.log10(class_mass)

    def encode(self, text: str | None) -> tuple[np.ndarray, float, int, float, list[str]]:
        """Symbols; then over the known tokens the sum of log10(c + SMOOTH) and their number; the sum of the log shares of
        classed tokens without that of the counts of other tokens; the other tokens."""
        own = words(text)
        own.append(END.encode())
        at = np.fromiter((self.place.get(w, -1) for w in own), np.int64, len(own))
        rare = np.flatnonzero(at < 0)
        symbols = np.empty(len(own), np.uint16)
        known = at >= 0
        symbols[known] = self.symbols[at[known]]
        others = [own[i] for i in rare]
        symbols[rare] = [SINGLES + class_of(w) for w in others]
        logs = self.log_count[at[known]]
        classed = symbols >= SINGLES
        share = float(self.log_count[at[known & classed]].sum()) - float(self.log_mass[symbols[classed] - SINGLES].sum())
        return symbols, float(logs.sum()), int(known.sum()), share, [w.decode("utf-8", "replace") for w in others]


def _steps(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences as columns, the longest first: (symbols step by step, how many columns each step has, order)."""
    sizes = np.array([len(s) for s in x])
    order = np.argsort(-sizes, kind="stable")
    width = np.searchsorted(-sizes[order], -np.arange(int(sizes.max())))  # columns longer than each step
    first = np.cumsum(width) - width
    flat = np.empty(int(width.sum()), np.int32)
    for column, i in enumerate(order):
        flat[first[: sizes[i]] + column] = x[i]
    return flat, width, order


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: state x symbol

    def _transfer(self, x: list[np.ndarray], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(matrices from each state before to each state at the end of the segments, their logs); no move comes before the first symbol of a text."""
        flat, width, order = _steps(x)
        emitted, k = np.ascontiguousarray(self.emit.T), len(self.start)
        m = np.where(begins[order][:, None, None], np.eye(k), self.move)
        logs, at = np.zeros(len(x)), 0
        for t, n in enumerate(width):
            a = m[:n] if t == 0 else (m[:n].reshape(-1, k) @ self.move).reshape(n, k, k)
            a = a * emitted[flat[at : at + n]][:, None, :]
            c = a.sum(axis=(1, 2))
            m[:n], logs[:n] = a / c[:, None, None], logs[:n] + np.log(c)
            at += n
        out, back = np.empty_like(m), np.empty_like(logs)
        out[order], back[order] = m, logs
        return out, back

    def _borders(self, segments: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of the segments of one text: forward messages before each but the first, backward messages after each."""
        m = np.concatenate([self._transfer(segments[i : i + 256], np.arange(i, min(i + 256, len(segments))) == 0)[0] for i in range(0, len(segments), 256)])
        forward, backward = [self.start], [np.ones(len(self.start))]
        for s in range(len(segments) - 1):
            a = forward[-1] @ m[s]
            forward.append(a / a.sum())
        for s in range(len(segments) - 1, 0, -1):
            b = m[s] @ backward[-1]
            backward.append(b / b.sum())
        return forward, backward[::-1]

    def expected(self, x: list[np.ndarray], total: dict) -> None:
        """Adds the expected counts of some whole texts to `total`."""
        parts, before, after, begins = [], [], [], []
        for s in x:
            cut = [s[at : at + LONG] for at in range(0, len(s), LONG)]
            forward, backward = self._borders(cut) if len(cut) > 1 else ([self.start], [np.ones(len(self.start))])
            parts += cut
            before += forward
            after += backward
            begins += [True] + [False] * (len(cut) - 1)
        flat, width, order = _steps(parts)
        k, kind = len(self.start), np.float32
        emitted, move = np.ascontiguousarray(self.emit.T, kind), self.move.astype(kind)
        before, begins = np.array(before)[order], np.array(begins)[order]
        alpha, scale = np.empty((len(flat), k), kind), np.empty(len(flat), kind)
        ends = np.cumsum(width)
        for t, n in enumerate(width):
            at = ends[t] - n
            a = alpha[at - width[t - 1] : at - width[t - 1] + n] @ move if t else np.where(begins[:, None], before, before @ self.move).astype(kind)
            a *= emitted[flat[at : at + n]]
            c = a.sum(axis=1)
            scale[at : at + n] = c
            np.divide(a, c[:, None], out=alpha[at : at + n])
        beta = np.array(after, kind)[order]
        sizes = np.array([len(s) for s in parts])[order]
        beta /= (alpha[ends[sizes - 1] - width[sizes - 1] + np.arange(len(parts))] * beta).sum(axis=1, keepdims=True)
        for t in range(len(width) - 1, -1, -1):
            n, at = width[t], ends[t] - width[t]
            later = emitted[flat[at : at + n]] * beta[:n] / scale[at : at + n, None]
            alpha[at : at + n] *= beta[:n]  # from here on the share of each state
            if t:
                total["move"] += alpha[at - width[t - 1] : at - width[t - 1] + n].T @ later
                beta[:n] = later @ move.T
            else:
                total["start"] += alpha[:n][begins].sum(axis=0)
                total["move"] += before[~begins].T @ later[~begins]
        for s in range(k):
            total["emit"][s] += np.bincount(flat, weights=alpha[:, s], minlength=total["emit"].shape[1])
        total["log"] += float(np.log(scale, dtype=np.float64).sum())

    def log10_likelihood(self, x: list[np.ndarray]) -> np.ndarray:
        """Of whole sequences. The first segment runs from the start distribution, later ones as matrices from each state."""
        flat, width, order = _steps([s[:SEGMENT] for s in x])
        emitted = np.ascontiguousarray(self.emit.T)
        alpha, logs, at = np.broadcast_to(self.start, (len(x), len(self.start))).copy(), np.zeros(len(x)), 0
        for t, n in enumerate(width):
            a = (alpha[:n] @ self.move if t else alpha[:n]) * emitted[flat[at : at + n]]
            c = a.sum(axis=1)
            alpha[:n], logs[:n] = a / c[:, None], logs[:n] + np.log(c)
            at += n
        out, ends = np.empty_like(logs), np.empty_like(alpha)
        out[order], ends[order] = logs, alpha
        later = [(i, s[at : at + SEGMENT]) for i, s in enumerate(x) for at in range(SEGMENT, len(s), SEGMENT)]
        for at in range(0, len(later), 256):
            some = later[at : at + 256]
            m, logs = self._transfer([s for _, s in some], np.zeros(len(some), np.bool_))
            for j, (i, _) in enumerate(some):  # in the order of the text
                a = ends[i] @ m[j]
                c = a.sum()
                ends[i] = a / c
                out[i] += np.log(c) + logs[j]
        return out / np.log(10)


def baum_welch(encoded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Model of the sequences in `encoded` (symbols: binary of unsigned 16-bit symbols), begun near the symbol shares: `rounds` rounds at least."""
    rng = np.random.default_rng(SEED)
    size = len(share)
    emit = share * np.exp(rng.normal(0, 0.5, (states, size)))
    emit /= emit.sum(axis=1, keepdims=True)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    model = Model(np.full(states, 1 / states), move, emit)
    spark, reached = encoded.sparkSession, None
    for made in range(1, max(rounds, MOST_ROUNDS) + 1):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            total = {"start": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((states, size)), "log": 0.0}
            waiting: tuple[list, list, list] = [], [], []  # texts of like lengths go together
            held = [0, 0, 0]
            for pdf in batches:
                for data in pdf["symbols"]:
                    x = np.frombuffer(data, np.uint16)
                    k = (len(x) > 512) + (len(x) > 2048)
                    waiting[k].append(x)
                    held[k] += len(x)
                    if held[k] >= GROUP:
                        own.expected(waiting[k], total)
                        waiting[k].clear()
                        held[k] = 0
            for texts in waiting:
                if texts:
                    own.expected(texts, total)
            met = np.flatnonzero(total["emit"].sum(axis=0) > 0)
            rows = [(int(i), total["emit"][:, i]) for i in met]
            rows += [(-1, total["start"])] + [(-2 - i, own.move[i] * total["move"][i]) for i in range(states)]
            rows.append((-2 - states, np.full(states, total["log"])))
            yield pd.DataFrame({"symbol": [r[0] for r in rows], "n": [r[1].tolist() for r in rows]})

        sums = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(states)]
        counted = encoded.select("symbols").mapInPandas(run, "symbol int, n array<double>").groupBy("symbol").agg(*sums)
        emit, start, move, log = np.zeros((states, size)), np.zeros(states), np.zeros((states, states)), 0.0
        for r in counted.collect():  # a row for each symbol and state
            n = np.array(r[1:], float)
            if r.symbol >= 0:
                emit[:, r.symbol] = n
            elif r.symbol == -1:
                start = n
            elif r.symbol == -2 - states:
                log = float(n[0])
            else:
                move[-2 - r.symbol] = n
        emit += 0.5 * share  # keeps every symbol possible in every state
        start, move = start + 0.1, move + 0.1
        shared.unpersist()
        model = Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
        if made >= rounds and reached is not None and log - reached <= GAIN * abs(reached):  # log is that of the model before this round
            break
        reached = log
    return model


def score(docs: DataFrame, held_out: F.Column, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    held_out: a boolean column over doc_id; the other rows are learned from.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out)
    counts = materialize(token_counts(docs.where("NOT held_out")))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    names, n = _dictionary(counts)
    single = dict.fromkeys(names[:SINGLES])

    @F.pandas_udf("int")
    def classed(tokens: pd.Series) -> pd.Series:
        return pd.Series([-1 if t in single else class_of(t.encode()) for t in tokens], dtype="int32")

    mass, count_of_class = np.full(CLASSES, SMOOTH), np.zeros(CLASSES)  # one SMOOTH for tokens never seen
    for r in counts.withColumn("k", classed("token")).where("k >= 0").groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r.k] += r.c + SMOOTH * r.v
        count_of_class[r.k] = r.c
    share = np.concatenate([np.array(n[:SINGLES] + [0] * (SINGLES - min(len(n), SINGLES)), float), count_of_class]) + SMOOTH
    share /= share.sum()
    alphabet = spark.sparkContext.broadcast(Alphabet(names, np.array(n, float), mass))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = alphabet.value
        for whole in batches:
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                rows = [own.encode(t) for t in pdf["text"]]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "held_out": pdf["held_out"].array, "n_tokens": [len(r[0]) for r in rows],
                                    "symbols": [r[0].tobytes() for r in rows], "log_count": [r[1] for r in rows], "known": [r[2] for r in rows],
                                    "share": [r[3] for r in rows], "rare": [r[4] for r in rows]})

    schema = "doc_id long, held_out boolean, n_tokens long, symbols binary, log_count double, known long, share double, rare array<string>"
    encoded = materialize(docs.mapInPandas(encode, schema).withColumn("row", F.monotonically_increasing_id()))
    model = baum_welch(encoded.where("NOT held_out"), share, states, rounds)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def likelihood(symbols: pd.Series) -> pd.Series:
        x = [np.frombuffer(s, np.uint16) for s in symbols]
        parts = [shared.value.log10_likelihood(x[at : at + 512]) for at in range(0, len(x), 512)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rare = (encoded.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
            .groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("rare_log"), F.count("c").alias("rare_known")))
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "log_count", "known", "share", likelihood("symbols").alias("hmm"))
    norm = float(np.log10(tokens + SMOOTH * (distinct + 1)))
    logs = F.coalesce("rare_log", F.lit(0.0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") + logs - F.col("n_tokens") * norm).alias("base_score"), (F.col("hmm") + F.col("share") + logs).alias("score"))
