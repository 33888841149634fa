"""Secret scans: an Aho-Corasick pass finds keywords, anchored expressions run at the hits alone, checksums decide the rest.

One automaton over the ASCII-lower-cased text holds the words that assignments begin with, the prefixes of key kinds and
all strings of HEX_KEY hex digits, as a long hex run has no word of its own. At a hit the expression of its kind is tried
at that place only. The base kinds (`assign`, `access`, `hex`) are the leftmost non-overlapping matches of their
expressions, less those that are too short. The other kinds carry a checksum and count only if it is right:

- `github`, `npm`: prefix, 30 characters, then CRC-32 of these as six base-62 digits;
- `xprv`: an extended private key in base 58 whose last four bytes are those of a double SHA-256;
- `age`: a secret key in Bech32 with its six-character polynomial checksum.

Edge cases: null and empty texts hold nothing; texts are read whole and in linear time; spans count code points and their
ends are exclusive; spans of several kinds may overlap; repeated rows give repeated rows; a null doc_id stays null; columns
beside those named are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "xprv", "age")
HEX_KEY = 4  # hex digits of a keyword of the kind hex

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)  # fixed values of the checksum's generator


def crc_base62(body: str, check: str) -> bool:
    n, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, at = divmod(n, 62)
        digits = BASE62[at] + digits
    return digits == check


def base58_checked(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    data = n.to_bytes(82, "big")  # an extended key: 78 bytes and four of the checksum
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_checked(text: str) -> bool:
    prefix, _, data = text.lower().rpartition("1")
    values = [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + [BECH32.index(c) for c in data]
    state = 1
    for v in values:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ v
        for i, step in enumerate(BECH32_STEPS):
            if top >> i & 1:
                state ^= step
    return state == 1


def _no_checks(m: re.Match) -> bool:
    return True


#: kind -> (keywords in lower case, expression from the keyword on, whether a match counts)
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"),
               re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: m.end(2) - m.start(2) >= 8),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 16),
    "hex": (tuple(map("".join, itertools.product("0123456789abcdef", repeat=HEX_KEY))), re.compile(r"[0-9a-f]+"), lambda m: m.end() - m.start() >= 32),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), lambda m: crc_base62(m[1], m[2])),
    "npm": (("npm_",), re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), lambda m: crc_base62(m[1], m[2])),
    "xprv": (("xprv",), re.compile(rf"xprv[{BASE58}]{{107}}(?![0-9A-Za-z])"), lambda m: base58_checked(m[0])),
    "age": (("age-secret-key-1",), re.compile(rf"AGE-SECRET-KEY-1[{BECH32.upper()}]{{58}}(?![0-9A-Za-z])"), lambda m: bech32_checked(m[0])),
}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    """Keyword -> (its length, kinds that begin with it)."""
    kinds: dict[str, list[int]] = {}
    for kind, (keys, _, _) in RULES.items():
        for key in keys:
            kinds.setdefault(key, []).append(KINDS.index(kind))
    found = ahocorasick.Automaton()
    for key, own in kinds.items():
        found.add_word(key, (len(key), tuple(own)))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of all secrets, in this order."""
    if not text:
        return []
    folded = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone, so places stay
    upto, out = [0] * len(KINDS), []  # where the next match of a kind may begin
    for last, (size, kinds) in _automaton().iter(folded):
        start = last + 1 - size
        for k in kinds:  # no keyword of a kind lies inside another one of it, so starts rise
            if start >= upto[k]:
                _, pattern, counts = RULES[KINDS[k]]
                if m := pattern.match(text, start):
                    upto[k] = m.end()
                    if counts(m):
                        out.append((start, k, m.end()))
    return sorted(out)


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row for each secret and the columns kind, start, end and secret (the matched text)."""

    @F.pandas_udf("array<struct<kind string, start long, end long, secret string>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[(KINDS[k], start, end, t[start:end]) for start, k, end in find_spans(t)] for t in texts])

    found = docs.withColumn("_secret", F.explode(find(text)))
    return found.select(*docs.columns, "_secret.*")


def redact(text: Column) -> Column:
    """The text with every secret replaced by its kind in angle brackets; of overlapping ones the first, then the next beyond it."""

    def without(t: str | None) -> str | None:
        parts, at = [], 0
        for start, k, end in find_spans(t):
            if start >= at:
                parts += [t[at:start], f"<{KINDS[k]}>"]
                at = end
            elif end > at:  # the rest of an overlapping secret goes too
                at = end
        return t if not parts else "".join(parts) + t[at:]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([without(t) for t in texts], dtype=object)

    return run(text)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs (doc_id, text)."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                spans = find_spans(t)
                base = [s for s in spans if s[1] < len(BASE)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(_named(base).encode()).hexdigest(), _named(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id"), run("text").alias("_found")).select("doc_id", "_found.*")
