"""The registered queries, run over whole small tables with edge rows, against their contracts by brute force."""

import hashlib
import html
import math
import os
import re
import struct
import zlib
from collections import Counter

import pandas as pd
import public_tokenizers
import pytest

from tickloom.llm.queries import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    found = {t: pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark", "pages")}
    docs, pages = found["documents"], found["pages"]
    item = max(found["benchmark"].text, key=len)
    edge = [None, "", " \n\t ", "one", "ÉÀ Ünï ½ ² ①", "½ ② 77 ...", "a," * 20_000, "one two three " * 4000, f"before it {item} after it"]
    more = pd.DataFrame({"doc_id": range(900_000, 900_000 + len(edge)), "text": edge, "lang": None, "source": "edge", "n_chars": None})
    found["documents"] = pd.concat([docs, more[docs.columns]], ignore_index=True).astype({"n_chars": "Int64"})
    found["pages"] = pd.concat([pages, pd.DataFrame({"page_id": [900_000, 900_001], "url": ["u", None], "html": [None, ""]})], ignore_index=True)
    for t, df in found.items():
        df.to_parquet(folder / f"{t}.parquet", index=False)
    return str(folder), found


def run(spark, tables, name):
    got = queries()[name](spark, f"file://{tables[0]}").toPandas()
    return got, {int(i): (t if isinstance(t, str) else "") for i, t in zip(tables[1]["documents"].doc_id, tables[1]["documents"].text)}


def remainder(i, k):
    return zlib.crc32(str(i).encode()) % k


def packed(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(UPPER))


def encode(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: [*t.encode(text, add_special_tokens=False).ids, end] for i, text in texts.items()}


def test_quality(spark, tables):
    got, texts = run(spark, tables, "op2_quality")
    assert sorted(got.doc_id) == sorted(texts)
    assert all(h == (remainder(i, 5) == 0) for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    known = got[got.held_out].merge(tables[1]["labels"].dropna(subset=["quality"]).drop_duplicates("doc_id"), on="doc_id")
    assert len(known) and (known.predicted == known.quality).mean() >= 0.8


def test_decontamination(spark, tables):
    got, texts = run(spark, tables, "op3_decontamination")
    items = {i: " ".join(t.lower().split()) for i, t in zip(tables[1]["benchmark"].item_id, tables[1]["benchmark"].text) if isinstance(t, str) and len(t.split()) >= 15}
    holds = {(d, i) for d, t in texts.items() for i, item in items.items() if item in " ".join(t.lower().split())}
    assert 900_008 in {d for d, _ in holds} and holds <= set(zip(got.doc_id, got.item_id))
    assert set(got.doc_id) <= set(texts) and not set(got.doc_id) & set(range(900_000, 900_008))


def test_packing(spark, tables):
    got, texts = run(spark, tables, "op4_packing")
    ids = encode("byte_bpe_50k.json", texts, 1)
    for i, pieces in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for r in pieces.itertuples():
            assert r.start == at and r.length > 0 and r.ids_crc32 == packed(ids[i][at : at + r.length]) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    assert set(got.doc_id) == set(texts)
    for _, sequence in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum()[:-1]] and sequence.length.sum() <= 2048


def test_language_model(spark, tables):
    got, texts = run(spark, tables, "op5_language_model")
    tokens = {i: [*words(t), None] for i, t in texts.items()}  # None: the end
    counts = Counter(t for i, ts in tokens.items() if remainder(i, 10) for t in ts)
    n, v = sum(counts.values()), len(counts)
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        ts = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(r.doc_id, 10) == 0, len(ts), sum(t in counts for t in ts), n)
        base = math.fsum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and -math.inf < r.score < 0
    held_out = got[got.held_out]
    assert held_out.score.sum() > 1.1 * held_out.base_score.sum()


def test_token_files(spark, tables):
    got, texts = run(spark, tables, "op6_token_files")
    ids, at = encode("word_bpe_49k.json", texts, 2), 0
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.sort_values("doc_id").itertuples():
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), packed(ids[r.doc_id]))
        at += r.n_tokens


def test_pages(spark, tables):
    got, _ = run(spark, tables, "op7_html_text")
    pages = tables[1]["pages"]
    assert sorted(got.page_id) == sorted(pages.page_id) and dict(zip(got.page_id, got.url)) == dict(zip(pages.page_id, pages.url))
    assert all(n == len(t) and t == t.strip() and not re.search(r"</?(p|div|script|nav)\b", t) for t, n in zip(got.text, got.n_chars))
    assert all(not re.search(r"\s", block.replace(" ", "")) and block == block.strip() and "  " not in block for t in got.text for block in t.split("\n\n"))
    for i, page in zip(pages.page_id, pages.html):  # the article by its own tags
        article = re.search(r"<article>(.*?)</article>", page or "", re.S)
        if article:
            parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", p))).split()) for p in re.split(r"</?(?:p|h\d|ul|li|div|blockquote)>", article[1])]
            assert got[got.page_id == i].text.item() == "\n\n".join(p for p in parts if p)
    assert got[got.page_id >= 900_000].text.tolist() == ["", ""] and (got.n_chars > 0).mean() > 0.9


def test_media(spark, tables):
    got, texts = run(spark, tables, "op8_tiff")
    assert sorted(got.doc_id) == sorted(texts)
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64 and r.feature
    own = ["payload_sha256", "media_bytes", "media_sha256", "feature"]
    assert (got.assign(text=got.doc_id.map(texts)).groupby("text")[own].nunique() == 1).all().all()


def test_language(spark, tables):
    got, texts = run(spark, tables, "op10_language_id")
    lang = dict(zip(tables[1]["documents"].doc_id, tables[1]["documents"].lang))
    assert sorted(got.doc_id) == sorted(texts) and got.score.between(0, 1).all()
    for r in got.itertuples():
        assert r.held_out == (remainder(r.doc_id, 4) == 2)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id]))
    held_out = [(r.lang_pred, lang[r.doc_id]) for r in got[got.held_out].itertuples() if isinstance(lang[r.doc_id], str) and r.lang_pred != "und"]
    assert len(held_out) > 20 and sum(a == b for a, b in held_out) / len(held_out) > 0.9
