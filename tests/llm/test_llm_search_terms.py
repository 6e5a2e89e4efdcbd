"""Toxicity scores and lexical ranking against plain computations, and their odd inputs."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from conftest import SMALL
from llm import lexical, toxicity

DOCS, ITEMS, LABELS = "doc_id long, text string", "item_id long, text string", "doc_id long, quality int, toxic int"
_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, k=10):
    """{(item_id, rank, doc_id, score)} from (doc_id, text) and (item_id, text) rows."""
    lists = [(d, Counter(w), len(w)) for d, w in ((d, plain_terms(t)) for d, t in docs) if w]
    n_docs, n_terms = len(lists), sum(n for _, _, n in lists)
    df = Counter(t for _, own, _ in lists for t in own)
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(plain_terms(t))
    out = set()
    for item, query in asked.items():
        scores = []
        for d, own, n in lists:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * own[t] // (1000 * own[t] + 8 * m)) for t, q in query.items() if t in own)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out |= {(item, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda v: v[:3])[:k])}
    return out


def ranked(spark, docs, items, parts=3, **settings):
    found = lexical.best_documents(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), **settings)
    return {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()}


def test_terms_are_those_of_the_pattern():
    rng = random.Random(0)
    chars = [chr(c) for c in range(128)] + list("éÀß日本İ​\U0001f600")
    for _ in range(500):
        text = "".join(rng.choices(chars, k=40))
        assert [t.decode() for t in lexical.terms(text)] == plain_terms(text)
    assert lexical.terms(None) == []


@pytest.mark.parametrize("k", [1, 3, 10])
def test_ranking_matches_a_plain_one(spark, k):
    """Common and rare terms, ties, long and empty texts, repeated ids and items."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 40, 200])))) for i in range(1500)]
    docs += [(i, docs[i % 7][1]) for i in range(2000, 2040)]  # ties
    docs += [(3, "w0 W1, w299"), (None, "w298 w298"), (-5, None), (-6, ""), (-7, "!?"), (9999, "w5 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(40)]
    items += [(100, "w0"), (101, "w0 w0 w1"), (102, "nothing here"), (103, None), (104, "w298 w299"), (104, "w298 w299"), (104, "w1"), (None, "w7")]
    assert ranked(spark, docs, items, k=k) == plain_ranking(docs, items, k)
    assert ranked(spark, docs, items, parts=1, k=k, block_items=7, block_terms=20) == plain_ranking(docs, items, k)


def test_lexical_edges(spark):
    assert ranked(spark, [], [(1, "a")]) == set() and ranked(spark, [(1, "a")], []) == set()
    assert ranked(spark, [(1, None), (2, "?")], [(1, "a")]) == set()
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], DOCS).withColumns({c: F.lit("x") for c in ("item_id", "rank", "score", "terms", "places")})
    items = spark.createDataFrame([(1, "B")], ITEMS).withColumns({c: F.lit(0) for c in ("doc_id", "item", "rank")})
    assert {(r["rank"], r["doc_id"]) for r in lexical.best_documents(docs, items).collect()} == {(1, 2), (2, 1)}


def test_bounds_spare_documents():
    """The k-th score and the windows' bounds leave most documents of long lists without a score, and the result exact."""
    rng = np.random.default_rng(0)
    size = 8000
    has = {0: np.arange(size), 1: np.sort(rng.choice(size, size // 2, False)), 2: np.sort(rng.choice(size, 40, False))}
    row = {
        "doc_ids": np.arange(size), "lengths": np.full(size, 10), "terms": np.array(list(has)), "sizes": np.array([len(p) for p in has.values()]),
        "places": np.concatenate(list(has.values())), "times": np.concatenate([rng.integers(1, 4, len(p)) for p in has.values()]),
    }
    block = lexical.Block(row, size, 10 * size)
    query = [(0, 1), (1, 700), (2, 5000)]
    best = lexical.Best(10)
    scored = lexical.search(block, query, best)
    whole = np.zeros(size, np.int64)
    for t, w in query:
        places, worth = block.list_of(t)
        whole[places] += w * worth
    order = np.lexsort([np.arange(size), -whole])[:10]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == whole[order].tolist()
    assert scored < size / 4


def test_op13(spark):
    rows = {t: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id"))}
    got = entry_point.queries()["op13_hybrid_lexical_search"](spark, SMALL).collect()
    assert {(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got} == plain_ranking(rows["documents"], rows["benchmark"])


def test_fit_follows_the_update_rule():
    """Against the rule coordinate by coordinate; the L1 term leaves noise at zero."""
    rng = random.Random(3)
    rows = [(np.array(sorted(rng.sample(range(2, 50), 5) + [y]), np.int32), float(y)) for y in rng.choices([0, 1], k=400)]
    model = toxicity.fit(rows, alpha=0.5, l1=2.0, l2=0.5, epochs=2)
    ones = sum(y for _, y in rows)
    share = {1.0: len(rows) / (2 * ones), 0.0: len(rows) / (2 * (len(rows) - ones))}
    z, n = defaultdict(float), defaultdict(float)

    def w(i):
        l1 = 0.0 if i == "base" else 2.0
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((1 + math.sqrt(n[i])) / 0.5 + 0.5)

    for _ in range(2):
        for found, y in rows:
            at = [*found.tolist(), "base"]
            before = [w(i) for i in at]
            g = (1 / (1 + math.exp(-sum(before))) - y) * share[y]
            for i, own in zip(at, before):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.5 * own
                n[i] += g * g
    assert model.base == pytest.approx(w("base"))
    assert {i: v for i in range(50) if (v := w(i))} == pytest.approx(dict(zip(model.buckets.tolist(), model.weights.tolist())), rel=1e-5)
    assert {0, 1} <= set(model.buckets.tolist()) and len(model.buckets) < 25


def test_features_of_long_texts_are_whole():
    rng = random.Random(4)
    words = [f"word{rng.randrange(5000)}" for _ in range(150_000)]
    text = "\n".join(words)
    h = toxicity._hashes(words)
    assert toxicity.features(text).tolist() == np.unique(np.concatenate(toxicity.grams(h))).tolist()
    assert toxicity.features(None).tolist() == toxicity.features(" !? ").tolist() == []


def test_toxicity_edges(spark):
    texts = [(1, None), (2, ""), (3, "!?"), (None, "no id"), (5, "ünï 日本語"), (5, "again"), (7, "word " * 300_000)]
    docs = spark.createDataFrame(texts, DOCS).withColumns({c: F.lit("x") for c in ("y", "toxic", "score", "features")})
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.score_toxicity(docs, none).collect()
    assert len(rows) == len(texts) and {r["score"] for r in rows} == {0.5} and {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    own = next(i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5)
    one = spark.createDataFrame([(own, 0, 1), (own, 0, 1), (None, 0, 0), (7, 0, None), (5, 0, 3)], LABELS)
    assert all(r["score"] > 0.5 for r in toxicity.score_toxicity(docs, one).collect())
    assert toxicity.score_toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    """Words and pairs decide; labels of held-out rows are never learnt."""
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(1200):
        words = rng.choices(plain, k=30)
        kind = rng.choice(["clean", "word", "pair", "apart"])
        at = rng.randrange(28)
        words[at : at + 2] = {"clean": words[at : at + 2], "word": ["vile", "w1"], "pair": ["bad", "apple"], "apart": ["apple", "bad"]}[kind]
        toxic = int(kind in ("word", "pair"))
        out = zlib.crc32(str(i).encode()) % 5 == 0
        docs.append((i, " ".join(words)))
        labels.append((i, 0, 1 - toxic if out else toxic))
    rows = toxicity.score_toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), l1=3.0).collect()
    right = [r["predicted"] != labels[r["doc_id"]][2] for r in rows if r["held_out"]]
    assert len(right) > 150 and np.mean(right) > 0.95


def test_op11(spark):
    rows = entry_point.queries()["op11_ftrl_toxicity"](spark, "/root/testdata/sf0.1").collect()
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    found = [(marks[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([p for y, p in found if y]) > 0.75 and np.mean([p for y, p in found if not y]) < 0.02
