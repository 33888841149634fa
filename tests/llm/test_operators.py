import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm import chunks, decontam, hmm, html_text, langid, minhash, packing, quality, tiff, tokenbin, toolcalls
from tickloom.llm.common import scratch_dir
from tickloom.llm.components import connected_components
from tickloom.llm.encoding import ColumnEncoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None, 0.5, 1) for i, t, lang in rows], DOCS)


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    vocab = {k: [p + "".join(rng.choice("aeioumnrst") for _ in range(rng.randint(1, 6))) for _ in range(400)] for k, p in (("en", "th"), ("fr", "é"), ("de", "sch"))}
    rows = []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, prose(rng, rng.randint(30, 120), vocab[lang]), lang))
    base = rows[0][1].split()
    rows += [(100 + k, " ".join(base[:5] + [f"x{k}"] + base[6:]), "en") for k in range(12)] + [(130, rows[3][1], "en"), (131, rows[3][1].upper(), "en")]
    edge = [(200, None, "en"), (201, "", None), (202, "   \n", "en"), (203, "one", "en"), (203, "one", "en"), (None, "one", "en"), (204, prose(rng, 20_000, vocab["en"]), "en"), (205, "1234 ...", None)]
    return rows + edge


def brute_components(rows, size, num=80):
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            k = min(size, len(w))
            sets.setdefault(i, []).append(set(zip(*[w[j:] for j in range(k)])) if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= num * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = root(x), root(y)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, corpus, size):
    got = minhash.near_duplicates(docs(spark, corpus), size, 0.8).collect()
    want = brute_components(corpus, size)
    assert len(got) == len(corpus)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert {r.n_shingles for r in got if r.doc_id in (200, 201, 202)} == {0}


def test_near_duplicates_through_missed_leaders(spark):
    """A chain whose ends are not alike, and a group of which the smallest id is alike to few."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 100]), "en") for k in range(14)] + [(50 + k, " ".join(rng.sample(words[:40], 40)), "en") for k in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 2, 0.8).collect()}
    assert got == brute_components(rows, 2)


def test_near_duplicates_links_two_parts_by_one_pair(spark):
    """Two parts whose pairs mostly lie at 0.6 to 0.78; the last two texts alone reach 0.8 across them."""
    rng, d, n = random.Random(0), 18, 300
    first = [f"w{k}" for k in range(100)]
    second = first[: 100 - d] + [f"v{k}" for k in range(d)]
    rows = []
    for i in range(n):
        own, other, last = (*((first, second) if i % 2 else (second, first)), i >= n - 2)
        t, s = list(own), 4 if last else rng.randint(0, 3)
        at = 100 - d if i % 2 else 100 - s
        t[at : at + s] = other[at : at + s]
        for k in () if last else rng.sample(range(100 - d), rng.randint(0, 3)):
            t[k] = f"x{i}-{k}"
        rows.append((i, " ".join(t), "en"))
    want = brute_components(rows, 2)
    assert set(want.values()) == {0} and set(brute_components(rows[:-1], 2).values()) == {0, 1}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), 2, 0.8).collect()} == want


def test_clusters_hold_whole_parts(spark):
    parts = spark.createDataFrame([(1, 1), (2, 1), (11, 11), (12, 11), (21, 21), (22, 21)], "id long, component long")
    got = minhash._whole_clusters(spark.createDataFrame([(2, 11), (12, 30)], "a long, b long"), parts).collect()
    assert {(r.id, r.component, r.cluster) for r in got} == {(1, 1, 1), (2, 1, 1), (11, 11, 1), (12, 11, 1), (30, 30, 1)}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert minhash.near_duplicates(none).count() == 0
    assert packing.pack(packing.cut(none, public_tokenizers.path("byte_bpe_50k.json"), 1)).count() == 0
    assert decontam.leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert hmm.score(none, F.lit(False), rounds=1).count() == 0
    assert tokenbin.token_digest(none, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0
    assert langid.train_profiles(none) == {} and tiff.read_pages(tiff.store_texts(none)).count() == 0
    assert quality.train(none.select("doc_id", "text", F.lit(1).alias("label"))).score(["x"])[0] == 0.5
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    calls, results = toolcalls.from_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert toolcalls.link(calls, results, toolcalls.turn_schemas(spark)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, None)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}
    for a, b in edges:
        if b is not None and a != b:
            x, y = ({v for v in parent if parent[v] == parent.get(k, k)} | {k} for k in (a, b))
            low = min(x | y)
            parent.update({v: low for v in x | y})
    assert got == parent


def test_posterior_bounds():
    steps = minhash.least_matches(0.8)
    assert [n for n, _ in steps] == list(range(40, 241, 40))
    rng = np.random.default_rng(0)
    a = np.zeros((4000, minhash.HASHES), np.uint16)
    b = (rng.random(a.shape) >= 0.8).astype(np.uint16)
    assert len(minhash.survivors(a, b, 0.8)[0]) == 4000
    assert len(minhash.survivors(a, (rng.random(a.shape) >= 0.4).astype(np.uint16), 0.8)[0]) < 40


def test_quality(spark):
    rng = random.Random(2)
    words = ["tha", "one", "in", "of", "reading", "mint", "sole", "rant"]
    rows = [(i, prose(rng, 60, words) if i % 3 else " ".join(w + "***" for w in rng.choices(words, k=60)), "en") for i in range(300)] + [(900, None, None), (901, "", None)]
    frame = docs(spark, rows).withColumn("label", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1))
    model = quality.train(frame.where("doc_id < 200"))
    got = {r.doc_id: r.s for r in frame.select("doc_id", quality.scorer(spark, model)("text").alias("s")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert sum((got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300)) >= 97


def test_language(spark, corpus):
    profiles = langid.train_profiles(docs(spark, [r for r in corpus if r[0] is None or r[0] < 60]))
    got = langid.identify(docs(spark, corpus), profiles).collect()
    assert len(got) == len(corpus)
    assert {r.language.lang_pred for r in got if r.doc_id in (200, 201, 202, 205)} == {"und"}
    tested = [(r.language.lang_pred, r.lang) for r in got if r.doc_id is not None and 60 <= r.doc_id < 90]
    assert sum(a == b for a, b in tested) / len(tested) > 0.9


def test_decontamination(spark, corpus):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    items = spark.createDataFrame([(1, item), (2, "un deux trois"), (3, None), (1, item), (4, "")], "item_id long, text string")
    rows = [(1, corpus[0][1] + " " + item.upper() + " " + corpus[3][1], "en"), (2, " ".join(words[:18] + ["x", "y"]), "en"), (3, " ".join(words[:8]), "en"), (4, "so un, deux. Trois!", "fr"), (5, None, None), (1, item, "en"), (6, corpus[1][1], "fr"), (7, "alpha " * 500, "en")]
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs(spark, rows), items).collect()}

    def brute(text):
        w = decontam._words(text)
        found = {}
        for i, t in ((1, item), (2, "un deux trois")):
            own = decontam._words(t)
            best = max((decontam.similarity(decontam.shingle_counts(w[k : k + len(own)]), decontam.shingle_counts(own)) for k in range(len(w) - len(own) + 1)), default=0)
            if best >= 0.8:
                found[i] = best
        return found

    want = {}
    for i, t, _ in rows:
        for item_id, s in brute(t).items():
            want[i, item_id] = max(s, want.get((i, item_id), 0))
    assert got == want and (1, 1) in got and (3, 1) not in got and (7, 1) not in got


def test_decontamination_finds_cut_and_changed_passages(spark):
    """Texts shorter than an item, and passages with changed ends; all windows are compared."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(i, prose(rng, rng.choice((3, 15, 38, 50, 59)), vocabulary)) for i in range(40)]
    rows = []
    for i, t in items:
        w = t.split()
        for x in (w[1:], w[:-1], w[: len(w) * 9 // 10], w[: len(w) * 4 // 5]):
            rows.append((len(rows), " ".join(x), "en"))
        for k in range(8):
            n = rng.randint(1, max(1, len(w) // 9))
            new = [rng.choice(vocabulary) for _ in range(n)]
            rows.append((len(rows), " ".join([*rng.choices(vocabulary, k=k), *(new + w[n:] if k % 2 else w[:-n] + new), *rng.choices(vocabulary, k=k)]), "en"))
    want = {}
    for d, t, _ in rows:
        w = t.split()
        for i, own in items:
            own = own.split()
            n = min(len(own), len(w))
            best = max((decontam.similarity(decontam.shingle_counts(w[k : k + n]), decontam.shingle_counts(own)) for k in range(len(w) - n + 1)), default=0)
            if best >= 0.8:
                want[d, i] = best
    got = {(r.doc_id, r.item_id): (r.similarity, r.n_words) for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {k: s for k, (s, _) in got.items()} == want and len(want) > 150
    assert all(n == min(len(rows[d][1].split()), len(items[i][1].split())) for (d, i), (_, n) in got.items())


@pytest.mark.parametrize("probe", [False, True])
def test_multi_index_finds_all_within_radius(probe):
    rng = np.random.default_rng(4)
    index = decontam.build_index([(i, " ".join(f"w{rng.integers(0, 500)}" for _ in range(20))) for i in range(40)])
    prints = index["prints"]
    if probe:  # as with more values than variants
        index["blocks"] = [(np.arange(2**16), *rest) for _, *rest in index["blocks"]]
    near = [int(p) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, decontam.RADIUS + 1), replace=False)) for p in prints]
    wanted = np.array(near + rng.integers(0, 2**63, 100).tolist(), np.uint64)
    rows, items = decontam.within_radius(prints, index["blocks"], wanted)
    brute = {(i, j) for i in range(len(wanted)) for j in range(len(prints)) if int(wanted[i] ^ prints[j]).bit_count() <= decontam.RADIUS}
    assert set(zip(rows.tolist(), items.tolist())) == brute and all((i, i) in brute for i in range(40))


def test_encoder_equals_whole_texts(monkeypatch):
    rng = random.Random(6)
    bits = [" ", "  ", "\n", " \n", "a", "Bc", "é", "12", "'s", ".", "!!", "\t", "\r\n", "\xa0", "<|endoftext|>", "中", "Σ", "İ", "́", "😀", "_", "|", ", "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 16))) for _ in range(3000)]
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        e = ColumnEncoder(public_tokenizers.path(name), spaces)
        want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)] + [[]]
        for span, limit in ((4_000_000, 500_000), (61, 40)):  # few bytes at a time, a cache that is full at once
            monkeypatch.setattr(chunks, "SPAN", span)
            e.limit = limit
            assert [g.tolist() for g in e.ids_of([*texts, None])] == want


def test_packing(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack(packing.cut(docs(spark, corpus), path, 1, with_ids=True))
    rows = packed.toPandas()
    assert set(packing.sequences(packed).toPandas().ids.map(len)) <= set(range(1, 2049))
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048
    e = ColumnEncoder(path, True).tokenizer
    for i, t, _ in corpus:
        if i is not None and i != 203:
            g = rows[rows.doc_id == i].sort_values("start")
            ids = np.concatenate(g.ids.to_list())
            assert ids.tolist() == [*e.encode(t or "", add_special_tokens=False).ids, 1] and (g.doc_tokens == len(ids)).all()
            assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in g.ids] == g.ids_crc32.tolist()
    assert len(rows[rows.doc_id == 203]) == 2 and rows.doc_id.isna().sum() == 1


def test_patterns_hold_all_pieces():
    rng = random.Random(8)
    demand = {s: rng.randint(1, 400) for s in range(1, 257)}
    patterns = packing.solve_patterns(demand, 256)
    held = {}
    for p, n in patterns:
        assert sum(s * k for s, k in p.items()) <= 256
        for s, k in p.items():
            held[s] = held.get(s, 0) + k * n
    assert held == demand
    assert sum(n for _, n in patterns) <= 1.05 * sum(s * n for s, n in demand.items()) / 256 + 2


def test_language_model(spark, corpus):
    frame = docs(spark, corpus)
    got = {r.doc_id: r for r in hmm.score(frame, F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False)), states=3, rounds=3).collect()}
    counts, n = {}, 0
    for i, t, _ in corpus:
        if i is None or i % 10:
            for w in [*(t or "").encode().lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
                n += 1
    for i, t, _ in corpus:
        own = [*(t or "").encode().lower().split(), None]
        base = sum(np.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert abs(got[i].base_score - base) < 1e-6 * len(own) and np.isfinite(got[i].score) and got[i].score < 0
    long = [r for r in got.values() if not r.held_out and r.n_tokens > 30]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)


def test_likelihood_is_exact():
    rng = np.random.default_rng(1)
    m = hmm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(30), 4))
    x = [rng.integers(0, 30, n).astype(np.uint16) for n in (1, 5, 255, 256, 257, 700, 513, 5000)]
    for got, s in zip(m.log10_likelihood(x), x):
        a = m.start * m.emit[:, s[0]]
        total = 0.0
        for t in range(len(s)):
            a = a if t == 0 else (a @ m.move) * m.emit[:, s[t]]
            total += np.log10(a.sum())
            a = a / a.sum()
        assert abs(got - total) < 1e-8


def test_token_files(spark, corpus):
    path, frame = public_tokenizers.path("word_bpe_49k.json"), docs(spark, corpus)
    folder = scratch_dir(spark) + "-test"
    rows = tokenbin.read_tokens(tokenbin.write_tokens(frame, folder, path, 2), folder, with_ids=True).toPandas().sort_values("start")
    e = ColumnEncoder(path, False).tokenizer
    want = sorted(((i, t) for i, t, _ in corpus), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [None if v != v else int(v) for v in rows.doc_id.astype(object).where(rows.doc_id.notna(), float("nan"))] == [i for i, _ in want]
    at = 0
    for (_, t), r in zip(want, rows.itertuples()):
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 2]
        assert list(r.ids) == ids and r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_frame_of_reference_blocks():
    rng = np.random.default_rng(2)
    for k in range(100):
        found = [(None if k % 7 == 0 else k, rng.integers(0, (1, 50, 49408, 2**32)[k % 4], rng.integers(1, 3000), dtype=np.uint64).astype(np.uint32)) for _ in range(3)]
        f = tokenbin.TokenFile(tokenbin.encode_file(found))
        every = np.concatenate([x for _, x in found])
        a, b = sorted(rng.integers(0, f.size + 1, 2))
        assert (f.ids(0, f.size) == every).all() and (f.ids(a, b) == every[a:b]).all()
    with pytest.raises(ValueError):
        tokenbin.TokenFile(tokenbin.encode_file(found)[:-1] + b"x")


def test_html(spark):
    long = "Words of the article go on and on in this line of text, " * 4
    page = ("<html><head><title>t</title><script>if (a<b) x()</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>One</a></li></ul></nav><div class='x'><p>We use cookies on this site, please accept them all.</div>"
            f"<h1>Head &amp; line</h1><div>First   <b>para</b>\n graph<p>Ti.<p>{long}<form>name <input></form><p><a href=b>A link</a> {long}<ul><li><a href=b>More</a><li><a href=c>And more</a></ul><div>&copy; x</div>")
    rows = [(1, "u", page, "t", 9), (2, "u", None, "t", 9), (3, "u", "", "t", 9), (4, "u", "<p>open <!-- never closed", "t", 9), (1, "u", page, "t", 9), (None, None, f"<p>{'word ' * 200_000}", "t", 9)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(frame).collect()
    assert len(got) == len(rows) and got[0] == got[4]
    line = long.strip()
    assert got[0].text == f"Head & line\n\nFirst para graph\n\nTi.\n\n{line}\n\nA link {line}" and got[0].n_chars == len(got[0].text)
    assert (got[1].text, got[2].text, got[1].n_chars) == ("", "", 0) and got[5].n_chars == 5 * 200_000 - 1 and got[5].page_id is None


def test_tiff(spark, corpus):
    rng = np.random.default_rng(9)
    for k in range(80):
        made = [rng.integers(0, (2, 256)[k % 2], (rng.integers(1, 60), rng.integers(1, 60), (1, 3)[k % 2])).astype(np.uint8) for _ in range(2)]
        data = tiff.encode(made, (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS)[k % 4], 1 + k // 4 % 2, (None, (16, 32))[k // 8 % 2], (7, 256)[k % 2], "<>"[k // 16 % 2])
        assert [p[7] for p in tiff.pages(data)] == [m.tobytes() for m in made]
        assert all(p[8] is None or p[7] is None for p in tiff.pages(data[: len(data) // 2]))
    stored = tiff.store_texts(docs(spark, corpus))
    got = {(r.doc_id, r.pixels) for r in tiff.read_pages(stored).collect()}
    want = {(i, (t or "").encode().ljust(max(192, -(-len((t or "").encode()) // 192) * 192))) for i, t, _ in corpus}
    assert {(i, bytes(p)) for i, p in got} == want
    assert tiff.read_pages(spark.createDataFrame([(1, None), (2, bytearray(b"II*\0junk"))], "page int, media binary")).count() == 1


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, "a", "add", 0, {"x": "1", "y": "2"}, ["c"]), (1, "b", "add", 1, {"x": "one"}, ["a"]), (1, "c", "add", 2, {"x": "1", "y": "2", "z": "3"}, None), (2, "p", "add", 0, {"x": "1", "y": "1"}, ["q"]), (2, "q", "add", 1, {"x": "1", "y": "1"}, ["p"]),
         (3, "d", "none", 0, None, ["gone"]), (3, "d", "none", 0, None, ["gone"]), (None, None, None, None, None, None)],
        "conv_id long, call_id string, name string, position long, arguments map<string,string>, after array<string>")
    results = spark.createDataFrame([(1, "a", 'three "3"'), (1, "b", None), (2, "p", "1"), (2, "p", "2"), (2, "p", "2"), (2, "p", None), (9, "zz", "lost"), (9, "zz", "lost"), (None, "a", "x"), (1, None, None)], "conv_id long, call_id string, content string")
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "integer", True)], "name string, parameter string, type string, required boolean")
    every = toolcalls.link(calls, results, schemas).collect()
    others = {(r.conv_id, r.call_id, r.errors, r.n_results, r.json) for r in every if r.errors in ("no call", "further result")}
    assert others == {(2, "p", "further result", 2, '{"id":"p","result":"2"}'), (2, "p", "further result", 1, '{"id":"p"}'), (9, "zz", "no call", 2, '{"id":"zz","result":"lost"}'), (None, "a", "no call", 1, '{"id":"a","result":"x"}'), (1, None, "no call", 1, "{}")}
    rows = [r for r in every if r.errors not in ("no call", "further result")]
    assert len(rows) + len(others) == len(every)
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert len(rows) == 8 and [got[1, k].seq for k in "cab"] == [0, 1, 2]
    assert got[1, "a"].errors == "" and got[1, "a"].json == '{"arguments":{"x":"1","y":"2"},"id":"a","name":"add","result":"three \\"3\\"","seq":1}'
    assert got[1, "b"].errors == "missing y; wrong type x" and got[1, "c"].errors == "unknown z; no result"
    assert "cycle" in got[2, "p"].errors and "several results" in got[2, "p"].errors
    assert got[3, "d"].errors == "duplicate id; no schema; no call gone; no result" and "no id" in got[None, None].errors
    assert [r.call_id for r in toolcalls.orphan_results(calls.where("conv_id = 1 AND call_id = 'a'"), results.where("call_id IN ('a', 'zz') AND conv_id IS NOT NULL")).collect()] == ["zz", "zz"]


def test_levels_by_longest_chains(spark, monkeypatch):
    """Levels of random calls against the plain definition; a long chain of late dependencies takes few rounds."""
    rng = random.Random(12)
    rows, want = [], {}
    for conv in range(12):
        n = rng.randrange(2, 25)
        needs = {i: sorted({rng.randrange(n) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} - ({i} if conv % 2 else set())) for i in range(n)}
        if conv % 3:  # without cycles
            needs = {i: [j for j in js if j > i] for i, js in needs.items()}
        rows += [(conv, f"{i}", i, [f"{j}" for j in js]) for i, js in needs.items()]
        if any(j >= i for i, js in needs.items() for j in js):
            level = {}
            for _ in range(n + 1):
                level = {i: max((level[j] + 1 for j in js), default=0) for i, js in needs.items() if all(j in level for j in js)}
            want |= {(conv, f"{i}"): level.get(i) for i in needs}
    kind = "conv_id int, call_id string, position long, after array<string>"
    assert {(r.conv_id, r.call_id): r.level for r in toolcalls._levels(spark.createDataFrame(rows, kind)).collect()} == want
    calls = []
    monkeypatch.setattr(toolcalls, "materialize", lambda df, own=toolcalls.materialize: calls.append(1) or own(df))
    n = 1500
    chain = spark.createDataFrame([(1, f"{i}", i, [f"{i + 1}"] if i + 1 < n else None) for i in range(n)], kind)
    found = {int(r.call_id): r.level for r in toolcalls._levels(chain).collect()}
    assert found == {i: n - 1 - i for i in range(n)} and len(calls) < 5 * 20


def test_token_files_of_a_hot_id(spark):
    """A doc_id that fills most ranges is dealt out over them; order and starts hold."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, f"the words of copy {k}", "en") for k in range(300)] + [(i, f"a text {i}", "en") for i in range(100)]
    frame, folder = docs(spark, rows), scratch_dir(spark) + "-hot"
    made = tokenbin.write_tokens(frame, folder, path, 2)
    assert made.count() > 5 and made.agg(F.max("n_docs")).first()[0] < 200
    got = tokenbin.read_tokens(made, folder).toPandas().sort_values("start")
    assert got.doc_id.tolist() == sorted(i for i, _, _ in rows) and (got.start == got.n_tokens.cumsum() - got.n_tokens).all()


def test_radius_holds_windows_at_the_threshold():
    """Changed ends, cut ends and scattered changes that just leave a similarity of 0.8: their fingerprints lie within RADIUS."""
    rng = random.Random(31)
    vocabulary = [f"w{int(300 * rng.random() ** 3)}" for _ in range(5000)]
    far, n = 0, 0
    for _ in range(1500):
        own = rng.choices(vocabulary, k=rng.randint(15, 80))
        counts, changed = decontam.shingle_counts(own), list(own)
        kind = rng.randrange(3)
        for k in range(len(own)):
            at = (k, len(own) - 1 - k, rng.randrange(len(own)))[kind]
            other = list(changed)
            other[at] = rng.choice(vocabulary)
            if decontam.similarity(decontam.shingle_counts(other), counts) < 0.8:
                break
            changed = other
        prints = [int(decontam._fingerprints(decontam._votes(w), np.zeros(1, np.int64), len(w))[0]) for w in (own, changed)]
        far += (prints[0] ^ prints[1]).bit_count() > decontam.RADIUS
        n += 1
    assert far <= 0.001 * n


def brute_rank(text):
    import unicodedata
    from collections import Counter

    clean, kept = [], False
    for ch in (text or "").lower():
        kept = unicodedata.category(ch)[0] == "L" or (kept and unicodedata.category(ch)[0] == "M")
        clean.append(ch if kept else " ")
    counts = Counter()
    for w in "".join(clean).split():
        w = f" {w} "
        for n in (1, 2, 3):
            counts.update(x for k in range(len(w) - n + 1) if (x := w[k : k + n]) != " ")
    code = lambda g: sum(ord(ch) << 21 * (len(g) - 1 - k) for k, ch in enumerate(g))
    return [code(g) for g in sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.PROFILE]]


@pytest.mark.parametrize("sorted_at_a_time", [langid.COUNTED_CHARS, 50])
def test_out_of_place_distance(spark, corpus, monkeypatch, sorted_at_a_time):
    """Ranks and distances against brute force, with ties, marks, fractions and texts longer than what is sorted at a time."""
    monkeypatch.setattr(langid, "COUNTED_CHARS", sorted_at_a_time)
    odd = ["½ ² ①", "1234 ...", "नमस्ते दुनिया", "́e", "é e\u0301", "ab ab cd cd", "", None, "İstanbul", "a", "x1y", "中文 字", "_a_b"]
    texts = [t for _, t, _ in corpus[:60]] + odd
    assert all(langid._ranked(t).tolist() == brute_rank(t) for t in texts)
    rows = [(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)]
    profiles = langid.train_profiles(docs(spark, rows[:40]))
    assert {k: v.tolist() for k, v in profiles.items()} == {k: brute_rank(" ".join(t for _, t, lang in rows[:40] if lang == k)) for k in ("en", "fr")}
    for r in langid.identify(docs(spark, rows), profiles).collect():
        own = brute_rank(r.text)
        far = {k: sum(min(abs(v.tolist().index(g) - i), langid.PROFILE) if g in v else langid.PROFILE for i, g in enumerate(own)) for k, v in profiles.items()}
        best = min(sorted(far), key=far.get)
        want = (best, 1 - far[best] / (langid.PROFILE * len(own))) if own else ("und", 0.0)
        assert r.language.lang_pred == want[0] and abs(r.language.score - want[1]) < 1e-12


def test_quality_of_odd_texts(spark):
    """Long texts without blanks, ties, repeated rows and few labels give finite scores."""
    rows = [(i, "fine words here" if i % 2 else "JUNK!! JUNK!!", "en") for i in range(12)] * 2
    model = quality.train(docs(spark, rows).withColumn("label", (F.col("doc_id") % 2).cast("int")))
    odd = [(100, "a," * 200_000, "en"), (101, "ab" * 300_000, "en"), (102, ",." * 300_000, "en"), (103, " " * 10_000, "en"), (104, None, "en"), (None, "\u0301", None)]
    got = [r.s for r in docs(spark, rows + odd).select(quality.scorer(spark, model)("text").alias("s")).collect()]
    assert all(0 <= s <= 1 for s in got) and len(set(got[:24:2])) == 1 and got[0] < 0.3 < got[1]
    assert quality.train(docs(spark, rows[:0]).withColumn("label", F.lit(1))).prior == 0.5
    assert quality.train(docs(spark, rows).withColumn("label", F.lit(1))).prior == 1


def test_pooled_vectors_by_brute_force(monkeypatch):
    """Sums over chunks equal those over the words of whole texts, however texts are cut."""
    import pyarrow as pa

    rng = random.Random(9)
    bits = [" ", "\n", "a", "Bc", "BC", "é", "12", "'s", ".", "!!", "\t", "\xa0", "中", "_", "|", ", "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(200)] + [None, ""]
    context = np.random.default_rng(1).normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    want = []
    for t in texts:
        h = quality.word_hashes(quality._words(t))
        v = quality._unit(quality.index_vectors(h) + context[quality._slots(h)]) if len(h) else np.zeros((1, quality.DIM))
        want.append(np.concatenate([v.mean(0), v.std(0), [np.linalg.norm(v.mean(0))]]))
    for span, made in ((4_000_000, quality.MADE), (61, 5)):
        monkeypatch.setattr(chunks, "SPAN", span)
        monkeypatch.setattr(quality, "MADE", made)
        assert np.allclose(quality.pooled(pa.array(texts), context), want, atol=2e-3)


def pages_and_articles(spark):
    import os
    import re

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        found = html_text.blocks(r.html)
        inside = re.search(r"<article[^>]*>(.*)</article>", r.html or "", re.S)
        texts, own = [b[0] for b in found], [b[0] for b in html_text.blocks(inside[1] if inside else "")]
        at = next(i for i in range(len(texts) + 1) if texts[i : i + len(own)] == own)
        yield found, np.array([at <= i < at + len(own) for i in range(len(found))])


def test_blocks_of_pages_by_words_and_links(spark):
    """The shipped tree finds the articles of pages that the table was not made of, by word counts and link densities: without either its results change."""
    every = [(html_text.features(f), y) for f, y in pages_and_articles(spark) if f]
    x, y = np.concatenate([f for f, _ in every]), np.concatenate([y for _, y in every])
    tree = html_text.labelled_tree()
    kept = html_text.keep(tree, x)
    assert (kept & y).sum() / kept.sum() >= 0.999 and (kept & y).sum() / y.sum() >= 0.999
    table = html_text.labelled()[0]

    def changed(rows, figure):
        blind = rows.copy()
        blind[:, [i for i, n in enumerate(html_text.FEATURES) if n.startswith(figure)]] = 0
        return int((html_text.keep(tree, blind) != html_text.keep(tree, rows)).sum())

    # the pages have a menu above and a footer below, so links tell; words tell where the laid-out pages have neither
    assert changed(x, "links") > 0.1 * len(x) and changed(table, "words") >= 10
    assert [n.split("_")[0] for n in html_text.FEATURES] == ["words", "links"] * 3 and len(html_text.labelled()[0]) < 1000


def test_tree_by_brute_force():
    """The first split has the least impurity of all splits; a tree of enough depth repeats a table without contradictions."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, (40, 3)).astype(float), rng.integers(0, 2, 40).astype(float)
    of = {tuple(r): v for r, v in zip(x.tolist(), y)}
    y = np.array([of[tuple(r)] for r in x.tolist()])
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0
    best = min(gini(y[x[:, f] <= c]) + gini(y[x[:, f] > c]) for f in range(3) for c in (0.5, 1.5, 2.5, 3.5))
    f, cut, *_ = html_text.grow(x, y)
    assert abs(gini(y[x[:, f] <= cut]) + gini(y[x[:, f] > cut]) - best) < 1e-9
    assert (html_text.keep(html_text.grow(x, y, 30), x) == (y == 1)).all()


def test_broken_tags():
    texts = lambda page: [b[0] for b in html_text.blocks(page)]
    assert texts('<p data-x=5">one</p><p title="a > b">two</p><p title=\'"\'>three') == ["one", "two", "three"]
    assert texts("<p>a<br>b &amp; c&#33;<p>d <b>e<p>f</b> g") == ["a b & c!", "d e", "f g"]
    assert texts("<p>x<!-- never closed <p>y") == ["x"] and texts("<p>x<script>y") == ["x"] and texts("") == texts(None) == []
    assert texts("<p " + "a=' " * 20_000 + ">end") in (["end"], [])  # in linear time
    assert html_text.blocks("<li>see <a href=x>one two</a></li>") == [("see one two", 3, 2)]


def test_expected_counts_are_exact(monkeypatch):
    """Baum-Welch counts of whole texts against the plain recursions, with texts of one and of many segments."""
    monkeypatch.setattr(hmm, "LONG", 16)
    rng = np.random.default_rng(6)
    m = hmm.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(12), 3))
    x = [rng.integers(0, 12, n).astype(np.uint16) for n in (1, 2, 15, 16, 17, 40, 100, 33)]
    got = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((3, 12)), "log": 0.0}
    m.expected(x, got)
    want = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((3, 12)), "log": 0.0}
    for s in x:
        e = m.emit[:, s].T
        alpha, beta = np.zeros((len(s), 3)), np.ones((len(s), 3))
        for t in range(len(s)):
            alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.move) * e[t]
        for t in range(len(s) - 2, -1, -1):
            beta[t] = m.move @ (e[t + 1] * beta[t + 1])
        p = alpha[-1].sum()
        want["log"] += np.log(p)
        want["start"] += alpha[0] * beta[0] / p
        for t in range(len(s)):
            want["emit"][:, s[t]] += alpha[t] * beta[t] / p
            if t:
                want["move"] += np.outer(alpha[t - 1], e[t] * beta[t]) / p
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-4, atol=1e-4), k


def test_dictionary_has_whole_levels(spark):
    counts = spark.createDataFrame([(f"t{k}", c) for k, c in enumerate([9, 5, 5, 5, 2, 1, 1])], "token string, c long")
    assert hmm._dictionary(counts, 5) == (["t0", "t1", "t2", "t3", "t4"], [9, 5, 5, 5, 2])
    assert hmm._dictionary(counts, 3) == (["t0"], [9]) and hmm._dictionary(counts.where("c = 5"), 2) == ([], [])


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_of_separate_planes_by_hand(order):
    first, second = [[1, 2, 3], [4, 5, 6], [7, 8, 9]], [[10, 20, 30], [40, 50, 60], [70, 80, 90]]
    strips = [bytes(sum(plane[y : y + 2], [])) for plane in (first, second) for y in (0, 2)]  # two rows a strip, plane by plane
    head = (b"II" if order == "<" else b"MM") + (42).to_bytes(2, "little" if order == "<" else "big")
    number = lambda v, n: v.to_bytes(n, "little" if order == "<" else "big")
    at, places, body = 8, [], b""
    for strip in strips:
        places.append(at + len(body))
        body += strip
    lists = {273: 8 + len(body), 279: 8 + len(body) + 16}
    body += b"".join(number(p, 4) for p in places) + b"".join(number(len(x), 4) for x in strips)
    entry = lambda tag, value, count=1: number(tag, 2) + number(4, 2) + number(count, 4) + number(value, 4)
    two = number(258, 2) + number(3, 2) + number(2, 4) + number(8, 2) * 2
    entries = [entry(256, 3), entry(257, 3), two, entry(259, 1), entry(262, 1), entry(273, lists[273], 4), entry(277, 2), entry(278, 2), entry(279, lists[279], 4), entry(284, 2)]
    data = head + number(8 + len(body), 4) + body + number(len(entries), 2) + b"".join(entries) + number(0, 4)
    (page,) = tiff.pages(data)
    assert page[-1] is None and page[1:4] == (3, 3, 2)
    assert page[-2] == bytes(v for y in range(3) for x in range(3) for v in (first[y][x], second[y][x]))


def test_batches_of_media_by_bytes(monkeypatch):
    monkeypatch.setattr(tiff, "BATCH_BYTES", 10)
    cut = lambda sizes: [list(range(len(sizes)))[s] for s in tiff._slices(sizes)]
    assert cut([]) == [] and cut([3, 3, 3, 3]) == [[0, 1, 2], [3]] and cut([50, 1, 9, 0]) == [[0], [1, 2, 3]] and cut([0, 0]) == [[0, 1]]
    page = np.full((3000, 3000, 1), 32, np.uint8)
    for compression in (tiff.LZW, tiff.DEFLATE, tiff.PACKBITS, tiff.NONE):  # as small as they get
        assert tiff.pages(tiff.encode([page], compression))[0][7] == page.tobytes()
    claims = bytearray(tiff.encode([page[:4, :4]], tiff.NONE))
    small = claims.find((4).to_bytes(4, "little"), claims.find((256).to_bytes(2, "little")))
    claims[small : small + 4] = (2**30).to_bytes(4, "little")
    assert tiff.pages(bytes(claims))[0][8] is not None
