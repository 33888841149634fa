"""Main text of web pages: flat text blocks, classified by a decision tree over word counts and link densities.

Block-level tags cut a page into a flat row of text blocks. A block has its word count and link density and those of the
block before and after it; nothing else of the page counts, neither the kinds nor the names of its elements, but that
scripts, styles, form controls and the like hold no text. Beyond the ends of a page lie, as it were, links. A decision tree (Gini) grown
from a small labelled table, `html_blocks.csv`, keeps or drops each block. Most rows of the table are blocks of 30 pages,
main text where their article element holds them; the rest are laid out for pages of other builds (no menu, no advert, no
footer, links within or below the text). Remarks below an article that read like its paragraphs cannot be told from it.

Edge cases: a null or empty page, or one without kept blocks, has an empty text; unclosed and misnested tags end with
the part around them; an unclosed comment, script or style runs to the end of the page; a quote counts in a tag only
straight after an equals sign; repeated pages give repeated rows; nothing is capped.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

NEAR = 1
FEATURES = [f"{figure}{side}" for side in ("", *[f"_{k}_{way}" for way in ("before", "after") for k in range(1, NEAR + 1)]) for figure in ("words", "links")]
TABLE = Path(__file__).with_name("html_blocks.csv")  # FEATURES, then whether the block is main text
_BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
_HIDDEN = frozenset("script style noscript template textarea title head iframe svg canvas object form select button".split())
_RAW = frozenset("script style textarea title iframe noscript template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)", re.S)


def blocks(page: str | None) -> list[tuple[str, int, int]]:
    """(text, words, words in links) of each block that has text."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, bool]] = []  # tag, then whether text around it is hidden
    hidden = False
    run: list[str] = []
    linked, depth = 0, 0
    at, page = 0, page or ""

    def close() -> None:
        nonlocal run, linked
        text = " ".join("".join(run).split())
        if text:
            out.append((text, len(text.split(" ")), linked))
        run, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            raw = html.unescape(raw) if "&" in raw else raw
            run.append(raw)
            if depth:
                linked += len(raw.split())

    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag closes what is open inside it
            if tag == "a":
                depth = 0
            if tag in _BLOCK_TAGS:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    hidden = stack[i][1]
                    del stack[i:]
                    break
            continue
        if tag in _BLOCK_TAGS:
            close()
            depth = 0
        elif tag == "br":
            add(" ")
        if tag == "a":
            depth = 1
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _VOID or m[3].endswith("/"):
            continue
        if tag in _BLOCK_TAGS or tag in _HIDDEN:
            if tag == "body":  # ends a head that was left open
                hidden = False
            if tag not in ("p", "li"):  # which may end without an end tag
                stack.append((tag, hidden))
            hidden = hidden or tag in _HIDDEN
    add(page[at:])
    close()
    return out


def features(found: list[tuple[str, int, int]]) -> np.ndarray:
    """A row of FEATURES for each block; beyond the ends of the page lie blocks of links without words."""
    n = np.array([b[1] for b in found], float)
    own = np.stack([n, np.array([b[2] for b in found], float) / np.maximum(n, 1)], axis=1)
    edge = np.tile([0.0, 1.0], (NEAR, 1))
    padded = np.concatenate([edge, own, edge])
    shifts = [0, *[-k for k in range(1, NEAR + 1)], *range(1, NEAR + 1)]
    return np.concatenate([padded[NEAR + k : NEAR + k + len(own)] for k in shifts], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """Decision tree by Gini impurity: a share of positives, or (feature, cut, tree up to the cut, tree above it)."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for cut in (v[:-1] + v[1:]) / 2:
            low = x[:, f] <= cut
            gini = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            best = min(best, (round(gini, 9), f, cut))
    if not np.isfinite(best[0]):
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def keep(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree >= 0.5)
    f, cut, below, above = tree
    return np.where(x[:, f] <= cut, keep(below, x), keep(above, x))


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: FEATURES of each row, and whether it is main text."""
    rows = pd.read_csv(TABLE, comment="#")
    return rows[FEATURES].to_numpy(float), rows["main"].to_numpy(float)


@functools.cache
def labelled_tree():
    return grow(*labelled())


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(b[0] for b, k in zip(found, keep(tree, features(found))) if k)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """All columns of pages but the html, then text and n_chars (code points)."""
    tree = labelled_tree()

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in column], dtype=object)

    rest = [F.col(f"`{c}`") for c in pages.columns if c not in (html_column, "text", "n_chars")]
    return pages.select(*rest, text(html_column).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
