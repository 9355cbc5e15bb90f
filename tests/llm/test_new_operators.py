"""Collocations, fingerprints and whitening against brute force; nulls, empties, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from lectern.llm import collocations, whitening, winnowing
from lectern.llm.queries import oracle_sql, queries
from lectern.llm.scratch import ship

from ..oracle import connect
from ..oracle import rows as compared


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_collocations_match_their_sql(spark):
    # the smallest tables have few phrases that occur a hundred times
    data = "/root/testdata/sf0.01"
    got, want = queries()["op11_collocations"](spark, data).toPandas(), connect(data).sql(oracle_sql()["op11_collocations"]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and compared(got) == compared(want)


# --- 11: collocations ------------------------------------------------------------------------------------------------


def brute_collocations(texts, size: int, least: int, best: int) -> list[tuple]:
    import re

    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for s in range(1, size + 1):
                for i in range(len(w) - s + 1):
                    f[lang][tuple(w[i : i + s])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best])]
    return sorted(out)


@pytest.mark.parametrize(("dictionary", "hot"), [(collocations.DICTIONARY, 1000), (collocations.DICTIONARY, 6), (0, 1000)])
@pytest.mark.parametrize("size", [2, 3, 5])
def test_collocations_brute_force(spark, monkeypatch, size, dictionary, hot):
    monkeypatch.setattr(collocations, "HOT", hot)
    rng = np.random.default_rng(3)
    vocabulary = ["The", "of", "É", "naïve", "x\x00y", " ", "a\u0085b", "B", "b", "\x1f", "ﬁ", "zz"]
    texts = [("en" if i % 3 else None, "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", ",", "\r\n", " \t "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(rng.integers(0, 60)))) for i in range(60)]
    texts += [("de", None), ("fr", ""), ("fr", " .;\t"), ("es", "ja ja ja ja ja ja ja"), ("es", "ja ja ja ja ja ja ja"), ("es", "word"), (None, "ja " * 500)]
    rows = [(lang, text, 7, "x") for lang, text in texts]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string, w1 int, n string"), size, 3, 20, dictionary)
    assert sorted(map(tuple, got.collect())) == brute_collocations(texts, size, 3, 20)


def test_collocations_of_nothing(spark):
    for rows in ([], [("en", None), (None, "")]):
        for dictionary in (collocations.DICTIONARY, 0):
            assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), dictionary=dictionary).collect() == []


def test_collocation_products_pass_64_bits(spark):
    got = spark.sql("SELECT 1000 a, 9000000000000000 n, 3000000000 l, 3000000001 r").selectExpr("cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s")
    assert got.first()[0] == 1000 * 1000 * 9000000000000000 // (3000000000 * 3000000001)


# --- 12: fingerprints ------------------------------------------------------------------------------------------------


def brute_winnow(text: str, k: int, window: int) -> list[tuple[int, int]]:
    counts = lambda c: not (c.isspace() or (ord(c) < 128 and not c.isalnum()))
    at = [i for i, c in enumerate(text) if counts(c)] or list(range(len(text)))
    code = [ord(text[i]) + (32 if "A" <= text[i] <= "Z" else 0) + 1 for i in at]
    grams, mask = [], (1 << 64) - 1
    k = min(k, len(code))
    for i in range(len(code) - k + 1 if code else 0):
        h = 0
        for c in code[i : i + k]:
            h = (h * winnowing._BASE + c) & mask
        h = ((h ^ (h >> 33)) * winnowing._MIX) & mask
        grams.append(h ^ (h >> 29))
    out = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[i : i + window]
        best = max(j for j in range(len(part)) if part[j] == min(part)) + i
        if not out or out[-1][1] != at[best]:
            out.append((grams[best], at[best]))
    return out


TEXTS = ["", " ", "!?", "a", "The same, the SAME.", "x" * 300, "ab " * 200, "naïve Ünïcode — 漢字かな交じり文 " * 20, "\U0001f600" * 90, "one two three\u0085four " * 12]


@pytest.mark.parametrize(("k", "window"), [(20, 32), (5, 4), (7, 6), (1, 1), (16, 16)])
def test_winnowing_brute_force(k, window):
    rng = np.random.default_rng(1)
    for text in [*TEXTS, "".join(rng.choice(list("abC .\n"), 700))]:
        assert [(int(h), int(at)) for h, at in winnowing.winnow(text, k, window)] == brute_winnow(text, k, window)


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    for _ in range(200):
        shared = word(winnowing.K + winnowing.WINDOW - 1)
        a, b = word(rng.integers(0, 300)) + shared + word(rng.integers(0, 300)), word(rng.integers(0, 300)) + shared + word(rng.integers(0, 300))
        assert set(winnowing.winnow(a)["hash"]) & set(winnowing.winnow(b)["hash"])


def test_edited_texts_and_the_next_document(spark):
    rows = [(5, "five " * 30), (1, "one and more words " * 9), (None, "no id, but a text"), (3, ""), (2, None), (5, "five " * 30), (9, "nine"), (7, "a" * 4000), (4, "ünï \U0001f600 " * 30), (5, "another text of five")]
    got = winnowing.compared(spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, fingerprint string, head boolean")).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    # repeated ids follow one another in the order of their texts' hashes, so each text's follower is read from its sums
    order = [None, 1, 2, 3, 4, 5, 7, 9]
    text = {i: [t or "" for j, t in rows if j == i] for i in order}
    for i, following in zip(order, order[1:] + order[:1], strict=True):
        for r in by_id[i]:
            own = [t for t in text[i] if winnowing.winnow(t).tobytes().hex() == r["fingerprint"] and len(t) == r["n_chars"]]
            after = text[following] + text[i]
            possible = set()
            for t in own:
                cut = len(t) // 4
                for nxt in after:
                    edited = t[: len(t) - cut] + nxt[:cut]
                    possible.add((hashlib.sha256(edited.encode()).hexdigest(), winnowing.winnow(edited).tobytes().hex()))
            assert (r["edited_sha256"], r["edited_fingerprint"]) in possible
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert {r["fingerprint"] for r in by_id[5] if r["n_chars"] == 150} == {winnowing.winnow("five " * 30).tobytes().hex()}
    assert by_id[2][0]["near_next"] == 1 and by_id[2][0]["fingerprint"] == "" and by_id[3][0]["near_next"] == 0
    last = by_id[9][0]
    assert last["edited_sha256"] == hashlib.sha256(b"ninn").hexdigest()  # the first document comes after the last


def test_one_document_follows_itself_and_none_gives_none(spark):
    one = winnowing.compared(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one[0]["near_next"] == 1
    assert winnowing.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_fingerprints_against_plain_python(spark, data):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in queries()["op12_fingerprints"](spark, data).collect()}
    assert len(got) == len(docs)
    for (i, own), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        cut = len(own) // 4
        edited, r = own[: len(own) - cut] + following[:cut], got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (set(winnowing.winnow(t)["hash"].tolist()) for t in (own, edited, following))
        assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))


def test_places_of_fingerprints(spark):
    shared = "a passage of more than fifty characters that both of the texts hold as it is"
    docs = spark.createDataFrame([(1, f"First. {shared}"), (2, f"Something else before it, then: {shared}"), (3, None), (4, "nothing in common here at all, whatever the length")], "doc_id long, text string")
    prints = winnowing.fingerprints(docs)
    first = winnowing.first_places(prints).collect()
    assert {r["doc_id"] for r in first} == {1, 2} and {r["first_id"] for r in first} == {1}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in first:
        assert text[r["doc_id"]][r["at"] : r["at"] + 15] == text[1][r["first_at"] : r["first_at"] + 15]
    whole = {(r["doc_id"], int(r["hash"], 16), r["at"]) for r in winnowing.places(prints).collect()}
    assert whole == {(i, int(h), int(at)) for i, t in text.items() for h, at in winnowing.winnow(t or "")}


# --- 13: whitening ---------------------------------------------------------------------------------------------------


def test_jacobi_davidson_on_hard_spectra():
    rng = np.random.default_rng(4)
    spectra = [np.arange(1.0, 61), np.r_[np.full(30, 2.0), np.full(10, 1.0)], 10.0 ** -np.arange(0, 40), np.r_[5.0, np.zeros(9)], np.r_[1 + 1e-9 * np.arange(20), np.linspace(0, 0.9, 300)], np.array([3.0])]
    for s in spectra:
        q, _ = np.linalg.qr(rng.standard_normal((len(s), len(s))))
        v = (q * s) @ q.T
        values, axes = whitening.jacobi_davidson(lambda x: v @ x, len(s), 16)
        want = np.sort(s)[::-1][:16]
        assert values == pytest.approx(want, abs=1e-12 * s.max())
        assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-12
        assert np.abs(v @ axes - axes * values).max() <= 1e-12 * s.max()


def test_minres_solves_the_projected_equation():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((30, 30)))
    v, space = (q * np.linspace(1, 3, 30)) @ q.T, q[:, 27:]
    right = rng.standard_normal((30, 3))
    right -= space @ (space.T @ right)
    theta = np.array([3.1, 2.95, 0.5])
    t = whitening.minres(lambda x: v @ x, theta, space, right, 60)
    z = v @ t - t * theta
    assert np.abs(z - space @ (space.T @ z) - right).max() < 1e-8


def brute_whitened(vectors, count: int):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    w, e = np.linalg.eigh(v)
    w, e = w[::-1][:count], e[:, ::-1][:, :count]
    deviation = [sum(Fraction(int(n * a - b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return n, deviation, ((x - s / n) @ e) / np.sqrt(w), w / np.trace(v)


def test_whitening_brute_force(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.standard_normal((300, 8)) * np.linspace(1, 3, 8)).tolist()
    vectors += vectors[:50] + [vectors[0]] * 200
    rows = [(i, v, 1, "n") for i, v in enumerate(vectors)]
    odd = [(1000, None, 1, "n"), (1001, [1.0] * 7 + [None], 1, "n"), (1002, [float("nan")] * 8, 1, "n"), (1003, [float("inf")] + [0.0] * 7, 1, "n")]
    got = whitening.whiten(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int, x string"), 5).collect()
    n, deviation, whitened, explained = brute_whitened(vectors, 5)
    assert len(got) == 5 * len(vectors) and {r["n"] for r in got} == {n}
    signs = {}
    for r in got:
        i, c = r["vec_id"], r["component"] - 1
        assert r["deviation"] == deviation[i] and r["explained"] == pytest.approx(explained[c], rel=1e-12)
        sign = signs.setdefault(c, np.sign(r["whitened"] * whitened[i, c]))
        assert r["whitened"] == pytest.approx(sign * whitened[i, c], abs=1e-10)
        assert r["identity_error"] < 1e-10


def test_whitening_matches_numpy_on_the_given_vectors(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas().sort_values("vec_id")
    got = queries()["op13_whitening"](spark, data).toPandas().sort_values(["vec_id", "component"])
    n, deviation, whitened, explained = brute_whitened(table["embedding"].tolist(), 16)
    assert got["deviation"].tolist() == [int(d) for d in deviation for _ in range(16)]
    mine = got["whitened"].to_numpy().reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * whitened).sum(0)) - whitened).max() < 1e-8
    assert np.abs(got["explained"].to_numpy()[:16] / explained - 1).max() < 1e-10 and got["identity_error"].max() < 1e-10


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    # a line in three dimensions has one component; a shorter vector ends in zeros
    line = [(i, [float(i), 2.0 * i] + ([0.0] if i % 2 else [])) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5 and got[0]["explained"] == pytest.approx(1)
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(spark.createDataFrame([(1, [1e16]), (2, [-1e16]), (3, [3e15])], "vec_id long, embedding array<double>")).collect()
