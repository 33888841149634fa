"""Columns of texts as chunks: cut at once where words certainly end, with equal chunks found by Arrow's dictionary.

A chunk ends before a space or a line end that follows a printable character, between an ASCII or Latin-1 letter or digit
and an ASCII mark, between such letters and digits, after a mark other than the apostrophe, and after a single line end.
Anything else stays together, so a chunk may hold several words, but no word lies in two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPAN = 4_000_000  # bytes of text whose chunks are looked up at a time
_OTHER, _LETTER, _DIGIT, _MARK, _QUOTE, _SPACE, _LINE, _LEAD = range(8)


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x21:0x7F] = _MARK
    for c in range(0x21, 0x7F):
        if chr(c).isalnum():
            out[c] = _LETTER if chr(c).isalpha() else _DIGIT
    out[ord("'")], out[ord(" ")], out[ord("\n")], out[0xC3] = _QUOTE, _SPACE, _LINE, _LEAD
    return out


def _cuts() -> np.ndarray:
    """Whether a chunk ends between two kinds of bytes (left * 8 + right)."""
    out = np.zeros((8, 8), np.bool_)
    out[_LETTER : _QUOTE + 1, [_SPACE, _LINE]] = True
    out[[_LETTER, _DIGIT], _MARK] = out[[_LETTER, _DIGIT], _QUOTE] = True
    out[_LETTER, _DIGIT] = out[_DIGIT, _LETTER] = out[_DIGIT, _LEAD] = True
    out[_MARK, [_LETTER, _DIGIT, _LEAD]] = True
    return out.ravel()


_KINDS, _CUTS = _kinds(), _cuts()


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 text is the last of a chunk."""
    kind = _KINDS[data]
    lead = np.flatnonzero(kind[:-1] == _LEAD)
    second = data[lead + 1]
    plain = (second != 0x97) & (second != 0xB7)  # multiplication and division sign
    kind[lead[plain] + 1] = _LETTER
    kind[lead[~plain]] = kind[lead[~plain] + 1] = _OTHER
    cut = np.ones(len(data), np.bool_)
    cut[:-1] = _CUTS[kind[:-1] * np.uint8(8) + kind[1:]]
    line = np.flatnonzero(kind[1:-1] == _LINE) + 1  # of single line ends between printable characters
    before, after = kind[line - 1], kind[line + 1]
    cut[line] = (before != _OTHER) & (before <= _QUOTE) & (after != _OTHER) & ((after <= _QUOTE) | (after == _LEAD))
    return cut


class Span(NamedTuple):
    first: int  # the text in which the span begins
    chunks: list[bytes]  # distinct
    codes: np.ndarray  # the chunks of the span as positions in `chunks`
    upto: np.ndarray  # how many of these codes lie before the end of each text that ends in the span


def spans(texts: pa.Array) -> Iterator[Span]:
    """The chunks of an Arrow column of texts, about SPAN bytes at a time; a null text counts as empty.

    Every text ends in one span; a long one may begin in an earlier span.
    """
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    ends = (ends - ends[0])[1:]
    at, text, reach = 0, 0, SPAN
    while at < len(data):
        end = min(at + reach, len(data))
        cut = chunk_ends(data[at : end + 2])
        cut[ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, end, "right")] - at - 1] = True
        stops = np.flatnonzero(cut[: end - at]) + 1
        if not len(stops):
            reach *= 2
            continue
        end = at + int(stops[-1])
        offsets = np.concatenate([[0], stops]).astype(np.int32 if end - at < 2**31 else np.int64)
        kind, make = (pa.binary(), pa.BinaryArray) if offsets.dtype == np.int32 else (pa.large_binary(), pa.LargeBinaryArray)
        found = make.from_buffers(kind, len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(data[at:end])]).dictionary_encode()
        last = int(np.searchsorted(ends, end, "right"))
        yield Span(text, found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(stops, ends[text:last] - at, "right"))
        at, text, reach = end, last, SPAN
    if text < len(ends):  # only empty texts
        yield Span(text, [], np.empty(0, np.int32), np.zeros(len(ends) - text, np.int64))
