"""Operators against brute force, exact round trips and held-out accuracy; nulls, empties, ties, repeats, extra columns."""

from __future__ import annotations

import math
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from lectern.llm import decontaminate, knn, licenses, lm, mixing, near_dup, simple8b, site_style, token_files, toxicity, url_filter
from lectern.llm.queries import oracle_sql, queries, tokenizer_path
from lectern.llm.scratch import ship
from pyspark.sql import functions as F

from ..oracle import connect
from ..oracle import rows as compared

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def words(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, data, name):
    got, want = queries()[name](spark, data).toPandas(), connect(data).sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and compared(got) == compared(want)


# --- 1: urls ---------------------------------------------------------------------------------------------------

URLS = (
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://x.net/a", "x.net", "/a", "net/", "block"),
    ("http://example.com/de/2#f", "example.com", "/de/2", "example.com/de/", "block"), ("http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"), ("http://q.org/frx", "q.org", "/frx", None, "allow"),
    ("notaurl", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://net", "net", "", None, "allow"), ("http://?a://b/c", "", "", None, "allow"), ("ftp://notnet/a", "notnet", "/a", None, "allow"),
)


def test_url_rules(spark):
    rows = [(i, u[0], "extra") for i, u in enumerate(URLS)] + [(0, URLS[0][0], "again")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, rule string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:]


def test_url_templates_learn_from_labels(spark):
    rows = [(f"http://h.com/{'spam' if i % 2 else 'news'}/{i}", i % 2) for i in range(400)] + [("http://h.com/spam/777", None), ("http://h.com/news/778", None), ("http://other.com/spam/1", None)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, label int"), rules=(), label="label")
    last = {r["url"]: r["verdict"] for r in got.where("label is null").collect()}
    assert last == {"http://h.com/spam/777": "block", "http://h.com/news/778": "allow", "http://other.com/spam/1": "allow"}


def _verdicts(spark, rows) -> dict:
    got = url_filter.judge_urls(spark.createDataFrame(rows, "url string, label int"), rules=(), label="label")
    return {r["url"]: r["verdict"] for r in got.where("label is null").collect()}


def test_rare_siblings_do_not_hide_frequent_branches(spark):
    rows = [(f"http://h.com/{'spam' if i % 2 else 'news'}/{i}", i % 2) for i in range(400)] + [(f"http://h.com/{w}/x", None) for w in words(30, 5).split()]
    assert _verdicts(spark, [*rows, ("http://h.com/spam/777", None), ("http://h.com/news/778", None)]).items() >= {"http://h.com/spam/777": "block", "http://h.com/news/778": "allow"}.items()


def test_templates_reach_to_the_last_segment(spark):
    slugs = words(400, 6).split()
    rows = [(f"http://h.com/a/b/c/d/e/{'spam' if i % 2 else 'ok'}/{w}{i}/end", i % 2) for i, w in enumerate(slugs)]
    last = {"http://h.com/a/b/c/d/e/spam/new/end": "block", "http://h.com/a/b/c/d/e/ok/new/end": "allow", "http://h.com/a/" + "x/" * 60: "allow", "http://h.com": "allow"}
    assert _verdicts(spark, rows + [(u, None) for u in last]) == last


def test_urls_of_an_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "url string")).count() == 0


# --- 2: decontamination ----------------------------------------------------------------------------------------


def _sets(text: str) -> set:
    import re

    w = [x for x in re.split(r"[^\w]+|_+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_leaks_match_brute_force(spark, data, docs):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contained_items(docs, items).collect()}
    sets = {r["item_id"]: _sets(r["text"]) for r in items.collect()}
    want = {}
    for r in docs.collect():
        s = _sets(r["text"])
        for i, x in sets.items():
            if x and len(x & s) / len(x) >= 0.8:
                want[r["doc_id"], i] = len(x & s) / len(x)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want) and want


def test_leaks_of_odd_rows(spark):
    item = words(40, 1)
    rows = [(1, words(3000, 2) + " " + item.upper().replace(" ", ", ") + " " + words(3000, 3), "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, words(40, 4), "en", "s", 1), (5, " ".join(item.split()[:20]), "en", "s", 1), (1, "other", "en", "s", 1)]
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "one two three", 1), (7, item, 1)], "item_id long, text string, doc_id int")
    d = spark.createDataFrame(rows, DOC)
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, items).collect()] == [(1, 7)]
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(d, items).collect()) == [2, 3, 4, 5]
    assert decontaminate.contained_items(d.limit(0), items).count() == 0 and decontaminate.contained_items(d, items.limit(0)).count() == 0


# --- 3: top-k --------------------------------------------------------------------------------------------------


def _brute(rows: list, k: int, query) -> list:
    ok = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if query(i)):
        scored = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_matches_brute_force(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], [float(np.float32(x)) for x in r["embedding"]]) for r in v.collect()]
    got = sorted(tuple(r) for r in knn.top_k(v, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == _brute(rows, 5, lambda i: i % 50 == 0)


def test_top_k_of_odd_rows(spark):
    same = [0.5, 0.5]
    rows = [(i, same) for i in range(8)] + [(50, None), (51, [0.1, None]), (52, [float("nan"), 1.0]), (53, [float("inf"), 1.0]), (100, [0.0, 0.0]), (101, [-0.5, 2.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in [*rows, rows[0]]], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in knn.top_k(v, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == _brute(rows, 5, lambda i: i % 50 == 0)
    assert knn.top_k(v.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert [tuple(r) for r in knn.top_k(v.where("vec_id in (0, 1)"), F.col("vec_id") == 0).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 32768)]


# --- 4: mixing -------------------------------------------------------------------------------------------------


def test_targets_are_dealt_again():
    got = mixing.targets([100, 10, 1000], (3, 1, 2))
    assert got[0] == 200 and got[1] == 20 and math.isclose(sum(got), 1.5 * 1110)
    assert mixing.targets([], (3, 1, 2)) == [] and mixing.targets([0, 0], (3, 1, 2)) == [0, 0]


def test_mix_is_near_its_targets(spark, docs):
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    by: dict = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [0, r["target"], 0])
        by[r["source"]][0] += r["taken"]
        by[r["source"]][2] += r["size"]
    for taken, target, size in by.values():
        assert abs(taken - target) <= mixing.BLOCK and target <= 2 * size + 1e-9
    again = mixing.taken_words(docs.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_mix_of_odd_rows(spark):
    long = words(5000, 5)
    rows = [(1, long, "en", "b", 1), (2, None, "en", "a", 1), (3, "", None, None, None), (4, words(300, 6), "en", None, 1), (5, words(300, 6), "en", "é", 1), (5, words(300, 6), "en", "é", 1)]
    d = spark.createDataFrame(rows, DOC)
    got = mixing.taken_words(d).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5, 5]
    assert {r["doc_id"]: r["taken"] for r in got}[2] == 0
    assert mixing.taken_words(d.limit(0)).count() == 0
    mixed = mixing.mixed_documents(d).collect()
    count = lambda s: len(s.split())
    sums: dict = {}
    for r in mixed:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + count(r["text"])
        assert set(r["text"].split()) <= set(dict((x[0], x[1] or "") for x in rows)[r["doc_id"]].split())
    want: dict = {}
    for r in got:
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["taken"]
    assert sums == {k: v for k, v in want.items() if v}


def test_permutations_are_permutations():
    for n in (1, 2, 7, 64, 1000):
        for e in (0, 1):
            a, c = mixing._step(n, 3, e)
            assert sorted((a * i + c) % n for i in range(n)) == list(range(n))


# --- 5: language model -----------------------------------------------------------------------------------------


def test_base_scores_match_brute_force_and_the_model_beats_them(spark, docs):
    got = {r["doc_id"]: r for r in lm.score_texts(docs).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    tokens = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(low)) + [None] for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c: dict = {}
    for i, ts in tokens.items():
        for t in ts if not held(i) else ():
            c[t] = c.get(t, 0) + 1
    n, v = sum(c.values()), len(c)
    base = model = 0.0
    for i, ts in tokens.items():
        r = got[i]
        want = sum(math.log10((c.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(i), len(ts), n) and r["n_known"] == sum(t in c for t in ts)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["score"] < 0
        if held(i):
            base, model = base + want, model + r["score"]
    assert model > base


def test_known_words_have_probabilities_that_add_up():
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63 - 1, 400)
    rows, states, counts = rng.choice(h, 3000), rng.integers(0, lm.STATES, 3000), rng.integers(1, 50, 3000)
    known = np.unique(rows)
    bits = []
    lm.paths(rows, states, counts, known, np.zeros(len(known), np.int64), 0, lambda at, bit, n: bits.append((bit, n)))
    mixer = lm.Mixer(lm.LEVELS**2, 3)
    for bit, n in bits:
        mixer.learn(*lm.inputs(n), bit, np.ones(len(bit)))
    for state in (0, 3, lm.STATES - 1):
        lg = lm.path_costs(rows, states, counts, known, np.full(len(known), state), 0, mixer)
        assert math.isclose((10**lg).sum(), 1.0, rel_tol=1e-9)
    # cut into groups by the top bit, the bits above and below add up to the same
    top = (known.view(np.uint64) ^ np.uint64(2**63)) >> np.uint64(63)
    for g in (0, 1):
        inside = ((rows.view(np.uint64) ^ np.uint64(2**63)) >> np.uint64(63)) == g
        lg = lm.path_costs(rows[inside], states[inside], counts[inside], known[top == g], np.full(int((top == g).sum()), 3), 1, mixer)
        assert math.isclose((10**lg).sum(), 1.0, rel_tol=1e-9)


def test_spelled_words_have_probabilities_that_add_up():
    spelling = lm.Spelling([])
    slots, bit, _ = lm.spelled_bits(["banana", "bandana", "é"])
    for s in slots:
        np.add.at(spelling.table, s + bit, 3)
    spelling.learn(["banana", "bandana"])
    slots, bit, of = lm.spelled_bits([chr(i) for i in range(128)])
    p = spelling.mixer(*lm.inputs(spelling.counts(slots), from_half=True))
    first = np.arange(len(bit)) % 16 < 8  # the bits of the first byte; a leading 0 is the first of them
    lg = np.bincount(of[first], np.log(np.where(bit, p, 1 - p))[first])
    assert math.isclose(np.exp(lg).sum(), 1 - p[0], rel_tol=1e-9)


def test_texts_are_parsed_as_the_contract_says():
    import pyarrow as pa
    import re

    texts = ["A b. C\nd \n\n e", "", " \t ", "x\u000by\u001fz \u0085w", "a\uffff b\nc", "É É.\n\uffff", "one two. one two. three"]
    p = lm.Parsed(pa.array(texts))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in enumerate(texts):
        assert [p.words[w] for w in p.word[p.text == i]] == re.findall(r"[^\x20\x09-\x0D]+", text.translate(low)) + [""]
    own, before, text = p.sentences()
    last = text == len(texts) - 1
    assert last.sum() == 3 and own[last][0] == own[last][1] == before[last][2] != own[last][2] and before[last][0] == 0
    assert (text == 0).sum() == 4


def test_tallies_match_brute_force():
    rng = np.random.default_rng(5)
    key, train = rng.integers(0, 40, 500), rng.integers(0, 2, 500)
    got = list(zip(*(x.tolist() for x in lm._tallied(key, train))))
    assert got == [(k, int(train[key == k].sum()), int((key == k).sum())) for k in sorted(set(key.tolist()))]
    assert [len(x) for x in lm._tallied(key[:0], train[:0])] == [0, 0, 0]


def test_commonest_pairs_are_those_from_a_count_on(spark, monkeypatch):
    counts = [0, 0, *[1] * 50, *[2] * 20, 3, 3, 9, 100]
    scored = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "h long, c long")
    for top, want in ((1000, 74), (74, 74), (73, 24), (23, 4), (3, 2), (0, 0)):
        monkeypatch.setattr(lm, "TOP", top)
        got = [r["c"] for r in lm._commonest(scored).collect()]
        assert len(got) == want and sorted(got) == sorted(counts)[len(counts) - want :]
    assert lm._commonest(scored.limit(0)).count() == 0


def test_scores_do_not_depend_on_partitions(spark, docs):
    some = docs.where("doc_id < 60").union(docs.where("doc_id < 3"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted((r["doc_id"], r["score"]) for r in lm.score_texts(some).collect())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        again = sorted((r["doc_id"], r["score"]) for r in lm.score_texts(some.repartition(6)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert len(first) == len(again) == some.count() and all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(first, again))


def test_scores_of_odd_rows(spark):
    rows = [(i, words(30, i % 4), "en", "s", 1) for i in range(40)] + [(90, None, None, None, None), (91, "", "en", "s", 0), (None, "x\u000by", "en", "s", 3), (5, "again", "en", "s", 1)]
    got = lm.score_texts(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == len(rows) and {r["n_tokens"] for r in got if r["doc_id"] in (90, 91)} == {1}
    assert all(r["score"] is not None and math.isfinite(r["score"]) for r in got)
    assert lm.score_texts(spark.createDataFrame([], DOC)).count() == 0


def test_mixers_learn_from_every_bit_of_every_group():
    rng = np.random.default_rng(6)
    words_ = np.unique(rng.integers(-(2**63), 2**63 - 1, 20_000))
    h, s = np.repeat(words_, 2), np.tile([3, 20], len(words_))
    c = rng.integers(0, 4, len(h))
    c0 = np.repeat(c[::2] + c[1::2], 2)
    x, gate, bit, times = lm._learning_bits(h, s, c, c0, 0)
    # each pair of a word seen twice or more comes with the bits of its path, far more than 200,000
    some, found = (c > 0) & (c0 > 1), []
    lm.paths(h[c > 0], s[c > 0], c[c > 0], h[some], s[some], 0, lambda at, b, n: found.append(int(((n[0][0] - ~b > 0) & (n[0][1] - b > 0)).sum())))
    assert len(bit) == len(times) == len(gate) == len(x) == sum(found) > 250_000
    # all groups' bits are in the mixer: the parts' outcomes add up, and a gate that one group alone used keeps its weights
    one, two = gate < 20, gate >= 20
    parts = [lm.Mixer(lm.LEVELS**2, 3).part(x[w], gate[w], bit[w], times[w]) for w in (one, two)]
    mixer, alone = lm.Mixer(lm.LEVELS**2, 3).gather(parts), lm.Mixer(lm.LEVELS**2, 3)
    alone.learn(x[two], gate[two], bit[two], times[two], 1)
    used = np.unique(gate[two])
    assert np.allclose(mixer.weights[used], alone.weights[used]) and np.allclose(mixer.refine[used], alone.refine[used])
    assert (mixer.weights[np.unique(gate[one])] != lm.Mixer(lm.LEVELS**2, 3).weights[0]).any(1).all()


def test_spelling_learns_from_every_word():
    each = ["a", "ab", "banana", "bandana", "é", ""] + [f"w{i}" for i in range(9000)]
    spelling = lm.Spelling([])
    slots, bit, times = lm._different_bits(each)
    assert times.sum() == sum(8 * (len(w.encode()) + 1) for w in each) > len(times)
    whole = np.zeros_like(spelling.table)
    for s in slots:
        np.add.at(whole, s + bit, times)
    slots, bit, _ = lm.spelled_bits(each)
    for s in slots:
        np.add.at(spelling.table, s + bit, 1)
    assert (whole == spelling.table).all() and spelling.bits(each)[3].sum() == times.sum()


def test_kinds_are_learned_from_all_documents(spark):
    # a word that is frequent in one of many documents only, and words that stand in the same texts
    rows = [(("red blue " if i % 2 else "sun moon ") * 3,) for i in range(6000)] + [("seldom " * 5000,)]
    kinds = lm._kinds(spark.createDataFrame(rows, "text string").repartition(5))
    of = {w: kinds[lm.hash_of(w)] for w in ("red", "blue", "sun", "moon", "seldom")}
    assert of["red"] == of["blue"] != of["sun"] == of["moon"]


def test_chunks_list_each_pair_and_sentence_once(spark, docs):
    from collections import Counter

    some = docs.where("doc_id < 120").selectExpr("doc_id", "cast(doc_id % 3 as int) as fold", "coalesce(text, '') as text")
    some = some.union(some).union(some).coalesce(2)
    rows = some.mapInArrow(lm._chunks({}), lm._CHUNKS).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    want: Counter = Counter()
    for r in some.collect():
        for w in [*re.findall(r"[^\x20\x09-\x0D]+", r["text"].translate(low)), ""]:
            want[w] += r["fold"] != 0
    got: Counter = Counter()
    listed = 0
    for r in rows:
        if r["words"]:
            h, s, c = lm._pairs_of(r["words"], r["bucket"])
            listed += len(h)
            for k, n in zip(h.tolist(), c.tolist()):
                got[k] += n
    assert got == {(lm.hash_of(w) + 2**63) >> (64 - lm.KEY_BITS): n for w, n in want.items()}
    assert listed <= len(want) * len({r["chunk"] for r in rows}) < sum(want.values())


def test_sentences_have_probabilities_that_add_up():
    # three sentences, of which training has two; before it stands one that training has four times
    words_ = np.log10([0.5, 0.2, 0.3])
    alone, both, before = np.array([6, 2, 0]), np.array([1, 3, 0]), np.full(3, 4)
    tries, fails = np.full(lm.SAID + 1, 50), np.arange(lm.SAID + 1) * 4
    for b in (before, 0 * before):
        lg = lm.sentence_costs(words_, alone, both, b, np.full(3, 8), tries, fails)
        assert math.isclose((10**lg).sum(), 1.0, rel_tol=1e-9)


# --- 6: near duplicates ----------------------------------------------------------------------------------------


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**62, 300)
    b = np.concatenate([a[:240], a[:50], rng.integers(0, 2**62, 40)])
    (x, u), (y, v) = near_dup.weighted(a), near_dup.weighted(b)
    sig = near_dup.signatures(np.concatenate([x, y]), np.concatenate([u, v]), np.repeat([0, 1], [len(x), len(y)]), 2, 4000)
    exact = near_dup.probability_jaccard(a, b)
    wa, wb = dict(zip(x, u)), dict(zip(y, v))
    every = set(wa) | set(wb)
    brute = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in every) for i in set(wa) & set(wb))
    assert math.isclose(exact, brute, rel_tol=1e-9) and abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_bounds_of_blocks_hold():
    rng = np.random.default_rng(3)
    sets = [near_dup.weighted(rng.integers(0, 60, n)) for n in (1, 5, 40, 80, 200)] + [near_dup.weighted(rng.permutation(9000)[:n]) for n in (50, 6000, 8000)]
    spread = [(np.repeat(v, np.rint(np.exp(w - 1)).astype(int))) for v, w in sets]
    bound = near_dup.most_similar(sets, sets)
    for i, a in enumerate(spread):
        for j, b in enumerate(spread):
            exact = near_dup.probability_jaccard(a, b)
            assert bound[i, j] >= exact - 1e-4 and (min(i, j) < 5 or math.isclose(bound[i, j], exact, abs_tol=1e-4))


def test_classes_match_brute_force(spark, docs):
    sets = docs.select("doc_id", "text", near_dup.shingle_hashes(F.col("text"), short=True).alias("s")).collect()
    parent = {r["doc_id"]: r["doc_id"] for r in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, p in enumerate(sets):
        for q in sets[:n]:
            if (p["text"] or "") == (q["text"] or "") or (p["s"] and q["s"] and len(set(p["s"]) & set(q["s"])) and near_dup.probability_jaccard(p["s"], q["s"]) >= 0.8):
                a, b = sorted((root(p["doc_id"]), root(q["doc_id"])))
                parent[b] = a
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == {i: root(i) for i in parent}


def test_near_duplicates_of_odd_rows(spark):
    base = words(200, 9).split()
    chain = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in range(0, 60, 5)]
    rows = [(i, x, "en", "s", 1) for i, x in enumerate(chain)] + [(50, None, None, None, None), (51, "", "en", "s", 0), (52, "a b", "en", "s", 1), (53, "A, b!", "en", "s", 1), (0, chain[0], "en", "s", 1), (60, words(9000, 3), "en", "s", 1)]
    d = spark.createDataFrame(rows, DOC)
    got = near_dup.near_duplicates(d).collect()
    cls = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == len(rows) and {cls[i] for i in range(len(chain))} == {0} and cls[51] == 50 and cls[53] == 52 and cls[60] == 60
    assert sorted(r["doc_id"] for r in near_dup.one_of_each(d).collect()) == [0, 50, 52, 60]
    assert near_dup.near_duplicates(d.limit(0)).count() == 0


# --- 7: html ---------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Site</header><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div>
<article><h1>Title &amp; more</h1><p>One  <b>two</b>
three<br>four<p>Five &lt; six<form>mail <input></form><div class="ad-box">Buy</div></article><aside>Side</aside><div id="comments"><p>Nice</p></div><footer>&copy; me</footer></body></html>"""


def test_article_text():
    assert site_style.page_text(PAGE, frozenset()) == "Title & more\nOne two three four\nFive < six"


def test_elements_inside_a_line_stay():
    page = '<article><p>A study of <span class="share">market share</span> grew <svg><g>no</g></svg>fast<button>Buy</button>.</p><div class="related-work">Kept</div><div class="related-posts">Gone</div><div id="comments-2"><p>c</p></div></article>'
    assert site_style.page_text(page, frozenset()) == "A study of market share grew fast.\nKept"


def test_odd_and_long_pages():
    for page, text in (("<div class='a'>" * 16_000 + "x", "x"), ("<!" * 20_000, ""), ("<li><div>" * 8000 + "y", "y"), ("</div>" * 20_000 + "z", "z"), ("<p>" + words(200_000, 7), words(200_000, 7)), ("<svg>a", ""), ("a < b & c", "a < b & c")):
        began = time.time()
        assert site_style.page_text(page, frozenset()) == text
        assert time.time() - began < 5


def test_repeated_branches_go(spark):
    page = lambda i: f"<html><body><div class='box'>Same everywhere</div><div class='main'><p>{words(20, i)}</p></div></body></html>"
    rows = [(i, "http://h.com/x", page(i)) for i in range(8)] + [(8, None, None), (9, "http://h.com/", ""), (10, "http://solo.com/", page(1)), (0, "http://h.com/x", page(0))]
    got = site_style.main_texts(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["text"] == words(20, i) for i in range(8))
    assert by[8]["text"] == by[9]["text"] == "" and by[10]["text"].startswith("Same") and all(r["n_chars"] == len(r["text"]) for r in got)
    assert site_style.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 8: toxicity -----------------------------------------------------------------------------------------------


def test_misspellings_are_found():
    trie = toxicity.Trie([("worthless", False, 5.0), ("moron", False, 4.0), ("lowei", True, 3.0), ("bad", False, 9.0)])
    assert trie.find("worthless") == ("exact", 5.0)
    for w in ("worthles", "worthlesss", "wurthless", "worhtless", "orthless"):
        assert trie.find(w) == ("misspelled", 5.0)
    assert trie.find("loweischaft") == ("stem", 3.0) and trie.find("bat") is None and trie.find("worhtlss") is None and trie.find("morn") == ("misspelled", 4.0)


def test_windows_tell_quotation():
    trie = toxicity.Trie([("moron", False, 4.0)])
    f = lambda s: dict(zip(toxicity.FEATURES, toxicity.features(s, trie)))
    assert f('he said "moron" and left')["quoted"] == 1.0 and f("you are a moron")["addressed"] == 1.0 and f("moron here")["quoted"] == 0.0


def test_windows_reach_to_both_sides():
    trie = toxicity.Trie([("moron", False, 4.0)])
    f = lambda s: dict(zip(toxicity.FEATURES, toxicity.features(s, trie)))
    assert f("moron, he said")["quoted"] == 1.0 and f("moron, you are")["addressed"] == 1.0 and f("moron one two three four you")["addressed"] == 0.0


def test_a_short_term_does_not_hide_a_long_one():
    assert toxicity.Trie([("moro", False, 9.0), ("moron", False, 4.0)]).find("morop") == ("misspelled", 4.0)


def test_all_terms_that_pass_are_kept(spark):
    terms = [f"{w}{i}" for i, w in enumerate(words(4500, 31).split())]
    rows = [(" ".join(terms), 1)] * 30 + [(words(30, i), 0) for i in range(60)]
    found = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {t for t, stem, _ in found if not stem} >= set(terms)


def test_held_out_toxicity(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    s = toxicity.score_texts(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    pos, neg = [r["score"] for r in s if r["toxic"] == 1], [r["score"] for r in s if r["toxic"] == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.75 and sum(r["predicted"] == 1 and r["toxic"] == 0 for r in s) <= 0.03 * len(neg)


def test_toxicity_of_odd_rows(spark):
    rows = [(i, ("moron scum idiot " if i % 2 else "") + words(30, i), "en", "s", 1) for i in range(120)] + [(200, None, None, None, None), (201, "", "en", "s", 0)]
    d = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(120)] + [(200, 1, None)], "doc_id long, text int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_texts(d, labels).collect()}
    assert len(got) == 122 and all(0 <= r["score"] <= 1 for r in got.values()) and got[200]["predicted"] == 0 and got[201]["score"] == got[200]["score"]
    assert all(got[i]["predicted"] == i % 2 for i in range(120))
    assert {r["predicted"] for r in toxicity.score_texts(d, labels.limit(0)).collect()} == {0}
    assert toxicity.score_texts(d.limit(0), labels).count() == 0


# --- 9: token ids ----------------------------------------------------------------------------------------------


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 59, 60, 61, 5000):
        for top in (1, 2, 200, 49_408, 2**20, 2**32):
            v = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            w, e, big = simple8b.encode(v)
            assert (simple8b.decode(w, n, e, big) == v).all()
    data = simple8b.write_block(np.array([5, 9]), np.array([False, True]), np.array([2, 1]), np.array([7, 2**31, 1], np.uint32))
    docs, gone, lengths, ids = simple8b.read_block(data)
    assert docs.tolist() == [5, 0] and gone.tolist() == [False, True] and lengths.tolist() == [2, 1] and ids.tolist() == [7, 2**31, 1]
    mostly_small = np.where(np.arange(5000) % 100, 40, 40_000).astype(np.uint32)
    w, e, _ = simple8b.encode(mostly_small)
    assert len(e) == 50 and 8 * len(w) + 8 * len(e) < 5000
    with pytest.raises(ValueError):
        simple8b.read_block(b"other")


def test_token_ids_match_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    odd = [(10**9, None, "e", "s", 0), (10**9 + 1, "", "e", "s", 0), (-5, "A\u000bb \u0085 <|endoftext|>x <|EndOfText|> İΣ ΟΔΟΣ don't ''s é e\u0301 ...,!?", "e", "s", 0), (-4, "日本 \u200b語 ｆｕｌｌ", "e", "s", 0)]
    d = docs.unionByName(spark.createDataFrame(odd, DOC))
    got = {r["doc_id"]: r for r in token_files.read_documents(token_files.write_blocks(d, tokenizer_path(), 5)).collect()}
    tok, start = Tokenizer.from_file(tokenizer_path()), 0
    for r in sorted(d.collect(), key=lambda r: r["doc_id"]):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.read_documents(token_files.write_blocks(d.limit(0), tokenizer_path())).count() == 0


def test_files_of_odd_rows(spark):
    from pyarrow import fs

    rows = [(None, "a b", 1), (None, None, 2), (3, words(60_000, 4) + " É!!", 3), (3, "x", 4), (3, "x", 5), (4, " \n\t", 6), (None, "z" * 70_000, 7)]
    blocks = token_files.write_blocks(spark.createDataFrame(rows, "doc_id long, text string, part int"), tokenizer_path(), 2)
    got = token_files.read_documents(blocks).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, None, 3, 3, 3, 4] and sorted(r["n_tokens"] for r in got)[:4] == [1, 1, 2, 2]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))
    for file in {r["file"] for r in blocks.collect()}:
        system, path = fs.FileSystem.from_uri(file)
        with system.open_input_file(path) as f:
            for offset, size, docs, ids, _ in token_files.read_index(file):
                f.seek(offset)
                found = simple8b.read_block(f.read(size))
                assert len(found[0]) == docs and len(found[3]) == ids and (found[3][np.cumsum(found[2]) - 1] == token_files.END_ID).all()


# --- 10: licenses ----------------------------------------------------------------------------------------------


def test_phrases_match_brute_force(spark, docs):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    odd = [(-1, None, "e", "s", 0), (-2, "", "e", "s", 0), (-3, "CC BY, cc-by all RIGHTS reserved cc by", "e", "s", 0), (-4, "all rights all rights reserved general public", "e", "s", 0), (-3, "cc by", "e", "s", 0)]
    d = docs.unionByName(spark.createDataFrame(odd, DOC))
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(d).collect()), key=str)
    want = []
    for r in d.collect():
        w = re.findall(licenses.WORD, (r["text"] or "").translate(low))
        hits = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((r["doc_id"], len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=str)
    assert licenses.scan(d.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "label", "found"), [
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-notice", True), ("Licensed under CC BY 4.0", "cc-by-notice", True), ("licensed under the GNU General Public License, version 3", "gpl-notice", True),
    ("licensed under the General License", "gpl-notice", False), ("Copyright (c) 2020 Foo. All rights reserved.", "reserved-notice", True), ("Copyright all rights reserved", "reserved-notice", False),
    ("Licensed under the Apache License", "apache-notice", True), ("under the MIT License", "mit-notice", True), ("under the MIT new License", "mit-notice", False),
])
def test_templates(text, label, found):
    a = licenses.Automaton(dict(licenses.TEMPLATES)[label])
    w = licenses.words_of(text)
    assert any(a.longest(w, i) for i in range(len(w))) is found


def test_whole_licenses():
    """Filled templates match from end to end, also with optional regions left out; a word more, less or changed does not."""
    import re

    others = {label: licenses.Automaton(t) for label, t in licenses.BODIES}
    for label, wording in licenses.BODIES:
        for optional in (True, False):
            t = wording
            while not optional and "<<optional>>" in t:
                t = re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", " ", t, flags=re.S)
            t = re.sub(r"<<(?:optional|end)>>", " ", t)
            w = licenses.words_of(re.sub(r"<<var:(\d+)-(\d+)>>", lambda m: " Any" * int(m[1 if optional else 2]), t))
            fits = lambda a, w: any(a.longest(w, i) for i in range(len(w)))
            assert others[label].longest(["x", *w, "y"], 1) >= len(w)
            assert {n for n, a in others.items() if fits(a, w)} == {label}
            places = [i for i, x in enumerate(w) if x in others[label].mandatory and x != "any"]
            for i in (places[1], places[len(places) // 2]):
                assert not fits(others[label], [*w[:i], "changed", *w[i + 1 :]])


def test_whole_licenses_in_long_texts(spark):
    import re

    body = re.sub(r"<<var:.*?>>", "the owner", re.sub(r"<<(optional|end)>>", " ", dict(licenses.BODIES)["mit"]))
    rows = [(1, words(50_000, 1) + " " + body + " " + words(50_000, 2)), (None, body), (3, body.replace("NONINFRINGEMENT", "")), (3, None)]
    got = {(r["doc_id"], r["labels"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit,mit-text"), (None, "mit,mit-text"), (3, "mit-text"), (3, "")}


def test_templates_need_sound_markup():
    for bad in ("<<optional>> a", "<<optional>> a <<end>>"):
        with pytest.raises(ValueError):
            licenses.Automaton(bad)


# --- pipeline --------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = corpus_pipeline.keep(stage(spark, docs, data), name)
        assert docs.columns == columns
        assert docs.count() <= before or name == "mixing"
        if name == "decontamination":
            assert decontaminate.contained_items(docs, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count() > 0 and last.agg(F.sum("n_tokens")).first()[0] > 0


def test_stages_tell_rows_of_one_id_and_of_none_apart(spark):
    a, b, c = words(60, 21), words(60, 22), words(60, 23)
    rows = [(1, a), (1, b), (None, c), (None, words(60, 24)), (0, a), (None, b), (1, b), (2, "")]
    d = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], DOC)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in near_dup.one_of_each(d).collect())
    assert got == sorted([(0, a), (1, b), (-1, c), (-1, words(60, 24)), (2, "")])

    items = spark.createDataFrame([(7, c)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(d, items).collect()] == [(None, 7)]
    assert sorted(r["text"] for r in decontaminate.without_leaks(d, items).collect()) == sorted(x for _, x in rows if x != c)

    foul = [(i, ("moron scum idiot " if i % 2 else "") + words(30, i), "en", "s", 1) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    odd = [(None, "moron scum idiot " + words(30, 300), "en", "s", 1), (None, words(30, 301), "en", "s", 1), (500, "moron scum idiot " + words(30, 302), "en", "s", 1), (500, words(30, 303), "en", "s", 1)]
    left = toxicity.without_toxic(spark.createDataFrame(foul + odd, DOC), labels).where("doc_id is null or doc_id = 500").collect()
    assert sorted(r["text"] for r in left) == sorted([words(30, 301), words(30, 303)])


def test_signatures_do_not_depend_on_steps_or_batches(monkeypatch):
    """Rows signed in any runs, texts longer than a step among them, have the bands of each text signed alone."""
    rng = np.random.default_rng(5)
    lists = [rng.integers(-50, 50, n).tolist() for n in (0, 1, 7, 300, 0, 40, 5)] + [rng.integers(-(2**62), 2**62, 900).tolist()]
    alone = []
    for x in lists:
        v, w = near_dup.weighted(np.array(x, np.int64))
        alone.append(near_dup.bands(near_dup.signatures(v, w, np.zeros(len(v), np.int64), 1))[0].tolist() if len(v) else [])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(lists))), pa.array([b"n"] * len(lists)), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "node", "s"])
    for step in (1, 64, 350, 10**6):
        monkeypatch.setattr(near_dup, "STEP", step)
        got = pa.Table.from_batches(near_dup._sign(iter([batch, batch.slice(3, 4), batch.slice(0, 1)])))
        assert got["bands"].to_pylist() == alone + alone[3:7] + alone[:1]
        assert got["doc_id"].to_pylist() == [*range(len(lists)), 3, 4, 5, 6, 0]
