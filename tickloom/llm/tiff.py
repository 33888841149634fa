"""TIFF media columns: walk the image directories of each file and emit one row per page.

Reads both byte orders, strips and tiles, no compression, PackBits, LZW and deflate, and the horizontal predictor, for
8-bit samples. A writer makes such files from rows of samples, for tests and for lossless storage of bytes.

Edge cases: a null or empty file gives no row; a damaged file gives the pages before the damage and then one row with
the reason in `error` and null pixels; a loop of directories ends at the first one seen again; repeated files give
repeated rows; columns of the input that clash with those of a page are dropped.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Tags of the TIFF format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
#: Bytes of each field type.
_TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MOST_EXPANSION = 2048  # samples that a stored byte can stand for, more than any of the compressions reaches; a page that claims more is damaged
BATCH_BYTES = 16_000_000  # of media or texts that a worker holds at a time, or one of them
_RUN = re.compile(rb"(.)\1{2,127}", re.S)
PAGE_SCHEMA = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string, mean double, deviation double, entropy double"
_PAGE_COLUMNS = ["page", "width", "height", "samples", "compression", "predictor", "tiled", "pixels", "error", "mean", "deviation", "entropy"]


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes((257 - len(m[0]), m[0][0]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at, end = [], 0, len(data)
    while at < end:
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


def _pack_codes(codes: list[int], widths: list[int]) -> bytes:
    """Codes of 9 to 12 bits, the highest bit first."""
    c, w = np.array(codes, np.int64), np.array(widths, np.int64)
    bits = (c[:, None] >> (w[:, None] - 1 - np.arange(12)).clip(0)) & 1
    return np.packbits(bits[np.arange(12)[None, :] < w[:, None]].astype(np.uint8)).tobytes()


def lzw_encode(data: bytes) -> bytes:
    table = {bytes((i,)): i for i in range(256)}
    codes, widths, width, size, at, end = [256], [9], 9, 258, 0, len(data)
    known = dict(table)
    while at < end:
        stop = at + 1
        code = known[data[at:stop]]
        while stop < end and (longer := known.get(data[at : stop + 1])) is not None:
            code, stop = longer, stop + 1
        codes.append(code)
        widths.append(width)
        if stop < end:
            known[data[at : stop + 1]] = size
            size += 1
            if size == 4095:
                codes.append(256)
                widths.append(12)
                known, size, width = dict(table), 258, 9
            elif size + 1 > 1 << width:
                width += 1
        at = stop
    codes.append(257)
    widths.append(width)
    return _pack_codes(codes, widths)


def lzw_decode(data: bytes) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, last = [], list(first), 9, b""
    bits = int.from_bytes
    at, total = 0, len(data) * 8
    while at + width <= total:
        byte = at >> 3
        code = (bits(data[byte : byte + 3].ljust(3, b"\0"), "big") >> (24 - width - (at & 7))) & ((1 << width) - 1)
        at += width
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if code == 257:
            break
        if not last:
            word = table[code]
        else:
            if code < len(table):
                word = table[code]
            elif code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(last + word[:1])
        out.append(word)
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size)


def _chunk(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        raw = data
    elif compression == PACKBITS:
        raw = packbits_decode(data)
    elif compression == LZW:
        raw = lzw_decode(data)
    elif compression in (DEFLATE, OLD_DEFLATE):
        raw = _inflate(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(raw) < size:
        raise ValueError(f"{len(raw)} of {size} bytes")
    return raw[:size]


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int = 256, order: str = "<") -> bytes:
    """A TIFF file of pages (height x width x samples of 8 bits) in tiles (height, width) or strips of `rows` rows."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    squeeze = {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6)}[compression]
    for page in pages:
        h, w, s = page.shape
        th, tw = tile or (min(rows, h), w)
        offsets, sizes = [], []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                part = page[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = squeeze(np.ascontiguousarray(part).tobytes())
                offsets.append(len(out))
                sizes.append(len(data))
                out += data
        fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if s == 1 else 2]), (SAMPLES, 3, [s]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [tw]), (TILE_HEIGHT, 4, [th]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [th]), (STRIP_BYTES, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(fields):
            data = struct.pack(order + ("H" if kind == 3 else "I") * len(values), *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                place = len(out)
                out += data
                data = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = _TYPE_SIZE.get(kind, 0) * count
        place = at + 2 + 12 * i + 8
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size > len(data):
            raise ValueError("a field beyond the end")
        if kind in (1, 3, 4):
            fields[tag] = list(struct.unpack_from(f"{order}{count}" + {1: "B", 3: "H", 4: "I"}[kind], data, place))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, list[int]]) -> tuple:
    def one(tag: int, default: int | None = None) -> int:
        if tag not in f and default is None:
            raise ValueError(f"no tag {tag}")
        return f[tag][0] if tag in f else default

    w, h, s = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    compression, predictor, tiled = one(COMPRESSION, NONE), one(PREDICTOR, 1), TILE_OFFSETS in f
    if set(f.get(BITS, [1])) != {8} or one(PLANAR, 1) not in (1, 2) or predictor not in (1, 2):
        raise ValueError("not 8-bit samples")
    stored = sum(min(n, len(data)) for n in (f[TILE_BYTES] if tiled else f[STRIP_BYTES]))
    if not 0 < w * h * s <= MOST_EXPANSION * stored:
        raise ValueError("size out of range")
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, h), h), w)
    offsets, sizes = (f[TILE_OFFSETS], f[TILE_BYTES]) if tiled else (f[STRIP_OFFSETS], f[STRIP_BYTES])
    out, k = np.empty((h, w, s), np.uint8), 0
    planes = [slice(i, i + 1) for i in range(s)] if one(PLANAR, 1) == 2 else [slice(0, s)]  # separate or interleaved samples
    for plane in planes:
        deep = plane.stop - plane.start
        for y in range(0, h, th):
            for x in range(0, w, tw):
                rows = th if tiled else min(th, h - y)
                raw = _chunk(data[offsets[k] : offsets[k] + sizes[k]], compression, rows * tw * deep)
                part = np.frombuffer(raw, np.uint8).reshape(rows, tw, deep)
                if predictor == 2:
                    part = np.cumsum(part, axis=1, dtype=np.uint8)
                out[y : y + rows, x : x + tw, plane] = part[: h - y, : w - x]
                k += 1
    return w, h, s, compression, predictor, tiled, out.tobytes()


def _figures(pixels: bytes | None) -> tuple:
    """Mean, standard deviation and entropy in bits of the samples."""
    if not pixels:
        return None, None, None
    n = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    p, v = n / n.sum(), np.arange(256)
    mean = float(p @ v)
    return mean, float(np.sqrt(max(p @ (v * v) - mean * mean, 0.0))), float(-(p[p > 0] * np.log2(p[p > 0])).sum())


def pages(data: bytes | None) -> list[tuple]:
    """(page, width, height, samples, compression, predictor, tiled, pixels, error) of each page of a file."""
    out: list[tuple] = []
    if not data:
        return out
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
        if magic != 42:
            raise ValueError("not a TIFF file")
        seen = set()
        while at and at not in seen:
            seen.add(at)
            fields, at = _directory(data, at, order)
            out.append((len(out), *_page(data, fields), None))
    except (ValueError, LookupError, struct.error, zlib.error) as e:
        out.append((len(out), None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
    return out


def _slices(sizes: Iterable[int]) -> Iterator[slice]:
    """Runs of rows of about BATCH_BYTES."""
    first, held, at = 0, 0, -1
    for at, size in enumerate(sizes):
        if held and held + size > BATCH_BYTES:
            yield slice(first, at)
            first, held = at, 0
        held += size
    if at >= first:
        yield slice(first, at + 1)


def read_pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the other columns of `files`, then those of PAGE_SCHEMA."""
    own = [c for c in files.columns if c != media and c not in _PAGE_COLUMNS]
    frame = files.select(*[f"`{c}`" for c in own], f"`{media}`")
    schema = ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in frame.schema if k.name in own] + [PAGE_SCHEMA])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rows in _slices(len(data) if data is not None else 0 for data in pdf[media]):
                part = pdf.iloc[rows]
                found = [(k, (*p, *_figures(p[7]))) for k, data in enumerate(part[media]) for p in pages(data)]
                rest = part[own].iloc[[k for k, _ in found]].reset_index(drop=True)
                made = pd.DataFrame([p for _, p in found], columns=_PAGE_COLUMNS)
                made = made.astype({c: "Int32" for c in ("page", "width", "height", "samples", "compression", "predictor")} | {"tiled": "boolean", "pixels": object, "error": object})
                yield pd.concat([rest, made], axis=1)

    return frame.mapInPandas(run, schema)


ROW = 192  # samples in a row of a stored text
#: How a text is stored, by its crc32: compression, predictor, tile.
STORED = [(DEFLATE, 2, None), (DEFLATE, 1, (64, 96)), (PACKBITS, 1, (64, 192)), (LZW, 1, None)]


def store_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as TIFF files: doc_id, n_bytes, media_bytes, media_sha256, media.

    The payload is the text as UTF-8 (null: empty) with blanks up to a positive multiple of ROW, one row of 8-bit samples
    for each ROW bytes of it. Equal texts are stored alike.
    """
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for some in _slices(len(t) if t else 0 for t in pdf["text"]):
                part, rows = pdf.iloc[some], []
                for text in part["text"]:
                    raw = text.encode("utf-8", "surrogatepass") if text else b""
                    payload = raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW))
                    compression, predictor, tile = STORED[zlib.crc32(payload) % len(STORED)]
                    media = encode([np.frombuffer(payload, np.uint8).reshape(-1, ROW, 1)], compression, predictor, tile)
                    rows.append((len(raw), len(media), hashlib.sha256(media).hexdigest(), media))
                made = pd.DataFrame(rows, columns=["n_bytes", "media_bytes", "media_sha256", "media"])
                yield pd.concat([part[["doc_id"]].astype("Int64").reset_index(drop=True), made], axis=1)

    from pyspark.sql import functions as F

    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return frame.mapInPandas(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, media binary")
