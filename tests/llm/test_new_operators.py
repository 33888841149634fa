"""Operators 11 to 13: brute force, exact arithmetic and edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import divergence, queries, secrets, whitening

# ---- secrets ----
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
LEAST = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (name, p) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if LEAST[name](m)]
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found))


def base62(n, width):
    out = ""
    while n or len(out) < width:
        n, d = divmod(n, 62)
        out = secrets.BASE62[d] + out
    return out


def github_token(body):
    return f"ghp_{body}{base62(zlib.crc32(body.encode()), 6)}"


def extended_key(payload):
    data = payload + hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4]
    n, out = int.from_bytes(data, "big"), ""
    while n:
        n, d = divmod(n, 58)
        out = secrets.BASE58[d] + out
    return out


def age_key(data):
    """A key of 32 bytes by the definition of the checksum as a remainder, divided bit by bit."""
    bits = "".join(f"{b:08b}" for b in data) + "0" * 4
    values = [int(bits[i : i + 5], 2) for i in range(0, len(bits), 5)]
    prefix = "age-secret-key-"
    state = 1
    for v in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix] + values + [0] * 6:
        top = state >> 25
        state = ((state & (2**25 - 1)) << 5) ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= g if top >> i & 1 else 0
    state ^= 1
    return (prefix + "1" + "".join(secrets.BECH32[v] for v in values + [state >> 5 * (5 - i) & 31 for i in range(6)])).upper()


def pieces(rng):
    yield rng.choice(["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "APIKEY", "toKen", "ſecret", "toKen"])
    yield rng.choice(["", '"', "'"]) + " " * rng.randrange(3) + rng.choice([":", "=", "==", " "]) + " " * rng.randrange(3) + rng.choice(["", '"', "'"])
    yield "".join(rng.choice("abcXYZ019+/_.=-") for _ in range(rng.randrange(12)))
    yield rng.choice([" ", "", "é", "\n", "AKIA", "AKIAAKIA", "secretoken=", "tokentoken:"])
    yield "AKIA" + "".join(rng.choice("ABZ019a") for _ in range(rng.randrange(20)))
    yield "".join(rng.choice("0123456789abcdefABg"[: rng.choice([16, 16, 19])]) for _ in range(rng.randrange(50)))
    yield rng.choice(["ü", "日本", "𝒳", " ", "", "password"])


def test_base_spans_by_brute_force():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join("".join(rng.sample(list(pieces(rng)), 4)) for _ in range(rng.randrange(1, 6)))
        assert secrets._named([s for s in secrets.find_spans(text) if s[1] < 3]) == base_spans(text), text


def test_checksums_decide():
    good = github_token("A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5")
    key = extended_key(bytes.fromhex("0488ade4") + bytes(range(74)))
    assert key.startswith("xprv") and len(key) == 111
    age = age_key(range(32))
    wrong = good[:-1] + ("a" if good[-1] != "a" else "b")
    found = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find_spans(t)]
    assert found(f"x {good} y") == ["github"] and found(wrong) == [] and found(good + "Z") == []
    assert found(key) == ["xprv"] and found(key[:-1] + ("A" if key[-1] != "A" else "B")) == []
    assert found(age) == ["age"] and len(age) == 74 and found(age[:-1] + ("Q" if age[-1] != "Q" else "P")) == [] and found(age.lower()) == []
    assert found("npm_" + good[4:]) == ["npm"]


def test_secret_rows(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdefgh"), (3, "é" * 70_000 + " Password: 'hunter2hunter2' " + "a" * 40), (3, "x"), (4, "TOKEN = \"" + "f" * 32 + '"')]
    docs = spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    got = secrets.digest(docs).collect()
    assert len(got) == len(rows)
    want = Counter((i, base_spans(t), hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t in rows)
    assert Counter((r.doc_id, r.spans, r.base_sha256) for r in got) == want
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in got if r.doc_id == 4} == {4: (1, 0, 1)}
    assert secrets.digest(docs.limit(0)).count() == 0
    spans = secrets.secret_spans(docs.select("doc_id", "text")).collect()
    assert {(r.doc_id, r.kind) for r in spans} == {(None, "assign"), (3, "assign"), (3, "hex"), (4, "assign"), (4, "hex")}
    assert all(r.secret == r.text[r.start : r.end] for r in spans)
    clean = docs.select("doc_id", secrets.redact(F.col("text")).alias("t")).collect()
    assert [r.t for r in clean if r.doc_id == 4] == ["<assign>\""] and [r.t for r in clean if r.doc_id == 1] == [None]


# ---- whitening ----
def test_error_free_covariance_is_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(2**40), 2**40, (5000, 3)).astype(float) + 2.0**45
    sums = tuple(int(v) for v in x.astype(np.int64).astype(object).sum(axis=0))
    w = whitening.Whitener(len(x), sums, np.zeros(3), np.eye(3), 0.0)
    high, low = whitening.outer_products(*w.centred(x), (np.zeros((3, 3)), np.zeros((3, 3))))
    rows = [[Fraction(int(v)) - Fraction(s, len(x)) for v, s in zip(r, sums)] for r in x[:, :2]]
    for i in range(2):
        for j in range(2):
            exact = sum(r[i] * r[j] for r in rows)
            bound = sum(abs(r[i] * r[j]) for r in rows)
            assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= bound * Fraction(1, 2**95)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = (rng.normal(0, 1, (60, 6)) * [3, 2, 1.5, 1, 0.5, 0.2]).round(3)
    vectors = [*base.tolist(), base[0].tolist(), base[0].tolist(), [*base[1].tolist()[:5], None], [math.nan] * 6, [math.inf] * 6, None, base[2].tolist()[:4], []]
    df = spark.createDataFrame([(i if i != 3 else None, v, "n") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n string").repartition(7)
    got = whitening.whiten(df).collect()
    valid = [(i, v) for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] + [0] * (6 - len(v)) for _, v in valid])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, components = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, components = values[::-1], components[:, ::-1]
    want = np.abs((x - s / n) @ components[:, :4] / np.sqrt(values[:4]))
    assert len(got) == 4 * len(valid) and {r.n for r in got} == {n}
    place = {i: k for k, (i, _) in enumerate(valid)}
    for r in got:
        k = place[3 if r.vec_id is None else r.vec_id]
        assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[k], s))
        assert abs(abs(r.whitened) - want[k, r.component - 1]) < 1e-9 and abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 and r.identity_error < 1e-9
    for c in range(1, 5):  # one sign for all rows
        signs = {np.sign(r.whitened * ((x[place[3 if r.vec_id is None else r.vec_id]] - s / n) @ components[:, c - 1])) for r in got if r.component == c and abs(r.whitened) > 1e-6}
        assert len(signs) == 1


def test_whitening_without_variance(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], kind)).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in line)
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38]), (3, [0.0])], kind)).collect()
    assert {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: 0}


def test_packed_vectors_round_trip():
    x = np.array([[1, -5], [40_000, 2], [-(2**50), 2**53]], float)
    assert (whitening.unpack(whitening.pack(x), 2) == x).all() and [len(b) for b in whitening.pack(x)] == [4, 16, 16]
    rows, m = whitening.integers(pa.array([[0.5, -0.001], None, [1.0, None]], pa.list_(pa.float32())), 2)
    assert rows.tolist() == [0] and m.tolist() == [[128.0, -1.0]]


# ---- divergence ----
def audit_rows(spark, rows, tmp_path, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, c int")
    return docs, sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


def test_audit_against_sql(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(260):
        lang = ["en", "fr", None, "one"][i % 4]
        source = "alone" if lang == "one" else rng.choice(["b", "a", "É", "zz", None])
        text = " ".join(rng.choice(["Alpha", "beta", "É" + rng.choice("abc"), "日本", "x1y", "o'clock", "ZETA", "tie", "TIE2", rng.choice("abcdefgh") * 2]) for _ in range(rng.randrange(40)))
        rows.append((i, rng.choice([text, text, text, None, ""]), lang, source, "own", 7))
    rows += [(900, "alpha " * 50_000, "en", "long", "own", 7), (900, "alpha " * 50_000, "en", "long", "own", 7), (901, "beta", "xx", "q", "own", 7), (902, "", "xx", "r", "own", 7)]
    monkeypatch.setattr(divergence, "WIDTH", 3)  # terms of a language lie in many chunks
    monkeypatch.setattr(divergence, "ROWS", 5)
    docs, got = audit_rows(spark, rows, tmp_path)
    path = str(tmp_path / "documents.parquet")
    docs.toPandas().to_parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = sorted(con.sql(queries.OP11_SQL).fetchall())
    assert got == want and len(got) > 60
    assert {(r[0], r[1]) for r in got if r[0] == "xx"} == {("xx", "q"), ("xx", "r")} and all(r[4] == 0 for r in got if r[0] == "xx")


def test_audit_of_nothing(spark, tmp_path):
    assert audit_rows(spark, [], tmp_path)[1] == []
    assert audit_rows(spark, [(1, "a b", "en", "s", "t", 1)], tmp_path)[1] == []  # one source, no kept term


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        whole = rng.randrange(6, 2**52)
        count = rng.randrange(0, whole - 5)
        assert divergence.shares(np.array([[count]]), np.array([whole]))[0, 0] == 1 + 10**9 * (count + 5) // whole
