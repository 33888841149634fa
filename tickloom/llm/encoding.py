"""Token ids of the `tokenizers` library for columns of texts, with chunks that recur encoded once per Python worker.

Both tokenizers cut a text before they merge, and every end of a chunk (`chunks.py`) is such a cut. New chunks are encoded
by the library, and the ids of the texts are gathered from those of the chunks: they equal those of whole texts.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from tickloom.llm.chunks import spans

CACHE_CHUNKS = 500_000  # by default, about how many chunks a worker keeps; it starts anew once most chunks of a span are new to a full one
_made: dict[str, "ColumnEncoder"] = {}


class ColumnEncoder:
    def __init__(self, path: str, keep_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.keep_space, self.limit = keep_space, CACHE_CHUNKS
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of a token, or whether it ends a word
        for token, i in vocabulary.items():
            self.width[i] = len(token) if keep_space else token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}

    def _together(self, chunks: list[bytes], joiner: bytes) -> list[bytes] | None:
        """The ids of chunks that are encoded as one text, cut by the widths of the tokens; None if they don't add up."""
        text = joiner.join(chunks).decode("utf-8", "replace")
        ids = array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        ends = np.cumsum(self.width[np.frombuffer(ids, np.uint32)])
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks)) if self.keep_space else np.ones(len(chunks), np.int64)
        gap = len(joiner) if self.keep_space else 0
        stops = np.cumsum(sizes + gap) - gap
        at = np.searchsorted(ends, stops)  # for words: the first token by which so many have ended
        if not len(ends) or ends[-1] != stops[-1] or (ends[at] != stops).any():
            return None
        upto = (4 * (at + 1)).tolist()
        skip = 4 * bool(gap)  # the line end before a chunk
        data = ids.tobytes()
        return [data[: upto[0]], *[data[a + skip : b] for a, b in zip(upto, upto[1:])]]

    def _encode(self, new: list[bytes]) -> list[bytes]:
        """Chunks of letters are encoded many at a time, others singly."""
        spaced, plain, rest, out = [], [], [], [b""] * len(new)
        for i, chunk in enumerate(new):
            word = chunk[1:] if chunk[:1] == b" " else chunk
            if word.isalpha() or (len(word) > 1 and word.decode("utf-8", "replace").isalpha()):
                (plain if word is chunk else spaced).append(i)
            else:
                rest.append(i)
        for joiner, places in ((b"", spaced), (b"\n", plain)):
            if places and (ids := self._together([new[i] for i in places], joiner)) is not None:
                for i, x in zip(places, ids):
                    out[i] = x
            else:
                rest += places
        for at in range(0, len(rest), 1024):
            some = rest[at : at + 1024]
            ids = self.tokenizer.encode_batch_fast([new[i].decode("utf-8", "replace") for i in some], add_special_tokens=False)
            for i, x in zip(some, ids):
                out[i] = array("I", x.ids).tobytes()
        return out

    def _ids_of_chunks(self, chunks: list[bytes]) -> list[bytes]:
        ids = list(map(self.known.get, chunks))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            words = [chunks[i] for i in new]
            made = self._encode(words)
            for i, x in zip(new, made):
                ids[i] = x
            if len(self.known) >= self.limit and 2 * len(new) > len(chunks):  # other texts than those it was filled from
                self.known = {}
            if len(self.known) < self.limit:
                self.known.update(zip(words, made))
        return ids

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; n + 1 bounds) of an Arrow column; a null text counts as empty."""
        parts, bounds, made = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for span in spans(texts):
            ids = self._ids_of_chunks(span.chunks)
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
            own = size[span.codes]
            upto = np.concatenate([[0], np.cumsum(own)])
            parts.append(flat[np.repeat(first[span.codes] - upto[:-1], own) + np.arange(upto[-1])])
            bounds.append(made + upto[span.upto])
            made += int(upto[-1])
        return np.concatenate(parts), np.concatenate(bounds)

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, bounds = self.column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def encoder(path: str, keep_space: bool, limit: int = CACHE_CHUNKS) -> ColumnEncoder:
    """The worker's encoder for a tokenizer file; keep_space: a space belongs to the word after it (byte-level BPE)."""
    if path not in _made:
        _made[path] = ColumnEncoder(path, keep_space)
    _made[path].limit = limit
    return _made[path]
