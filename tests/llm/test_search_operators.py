"""Vector search, lexical search and the source audit against brute force, with every awkward kind of row."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwright.llm import lexical_search, source_divergence, vector_search
from planwright.llm.terms import ALPHANUMERIC, LETTERS, terms

DOCS = "doc_id long, text string, lang string, source string, term string, rank int, terms string"
ITEMS = "item_id long, text string, terms string, q long"
VECTORS = "vec_id long, embedding array<float>, row_id string, v string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")]


def found(pattern, text):
    return pattern.findall((text or "").translate(LOWER))


def corpus():
    r = random.Random(3)
    words = ["".join(r.choice("aeioulnrstÉéß漢") for _ in range(r.randint(1, 5))) for _ in range(120)]
    text = lambda n: " ".join(min(r.choices(words, k=3)) + r.choice(["", "", ".", "'s", "9", " X", "İ"]) for _ in range(n))
    rows = []
    add = lambda t, g="en", s="a": rows.append((len(rows), t, g, s, "t", 1, "z"))
    for i in range(60):
        add(text(r.choice([3, 30, 300])), r.choice(["en", "de"]), r.choice("abc"))
    add(None)
    add("")
    add(" \n.,;!", "en", "silent")
    add("é", None, None)
    add("lonely", "fr", "only")
    add(text(30_000), "en", "b")  # a very long one
    rows += [rows[0], rows[0], (None, *rows[1][1:])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.mark.parametrize("piece", [1, 7, 10**6])
def test_terms_are_never_cut(monkeypatch, piece):
    monkeypatch.setattr("planwright.llm.terms.PIECE", piece)
    text = "Ab c9 ÉÉ漢 x'y  \x00tail" * 3
    for table, pattern in ((LETTERS, WORDS[0]), (ALPHANUMERIC, WORDS[1])):
        assert [t.decode() for part in terms(text.encode(), table) for t in part] == found(pattern, text)


def brute_audit(rows, min_df):
    said = [(g or "", s or "", found(WORDS[0], t)) for _, t, g, s, *_ in rows]
    out = []
    for lang in {g for g, _, _ in said}:
        df = collections.Counter(w for g, _, ws in said if g == lang for w in set(ws))
        kept = sorted((w for w in df if df[w] >= min_df), key=str.encode)
        count = collections.defaultdict(collections.Counter)
        for g, s, ws in said:
            if g == lang:
                count[s].update(w for w in ws if w in set(kept))
        whole = sum(count.values(), collections.Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept))
        for s in count:
            pairs = [(t, sum(abs(share(count[s], w) - share(count[t], w)) for w in kept)) for t in count if t != s]
            terms_of = [(w, share(count[s], w) - share(whole, w)) for w in kept if count[s][w] and share(count[s], w) > share(whole, w)]
            for part, found_, most in (("pair", pairs, None), ("term", terms_of, 50)):
                ranked = sorted(found_, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def audited(df, **how):
    return sorted(map(tuple, source_divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()))


@pytest.mark.parametrize("min_df", [2, 30])
def test_audit(docs, rows, min_df):
    assert audited(docs, min_df=min_df) == brute_audit(rows, min_df)


def test_audit_in_many_tiles_and_flushes(docs, rows, monkeypatch):
    monkeypatch.setattr(source_divergence, "TILE_TERMS", 5)
    monkeypatch.setattr(source_divergence, "FLUSH", 50)
    assert audited(docs, min_df=2) == brute_audit(rows, 2)


def test_audit_of_nothing(spark, docs):
    assert audited(docs.limit(0)) == []
    silent = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "b")], "doc_id long, text string, lang string, source string")
    assert audited(silent) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(2000):
        total = r.randint(1, 10 ** r.randint(1, 15))
        count = r.randint(0, total)
        assert source_divergence.scaled_share(np.array([count]), np.array([total]))[0] == 1 + 10**9 * count // total


def brute_search(rows, items, k):
    docs = [(i, collections.Counter(found(WORDS[1], t))) for i, t, *_ in rows]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(w for _, c in docs for w in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m)) for w in set(found(WORDS[1], text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    r = random.Random(8)
    out = [(i, " ".join(r.sample(rows[i][1].split(), min(12, len(rows[i][1].split())))), "x", 7) for i in range(25)]
    return out + [(90, None, "x", 7), (91, "", "x", 7), (92, "nowheretobefound", "x", 7), (93, rows[4][1] + " " + rows[5][1], "x", 7), (93, "é E'S s", "x", 7), (None, rows[0][1], "x", 7), out[0]]


@pytest.mark.parametrize("k", [1, 5, 50])
def test_lexical_search(spark, docs, rows, items, k):
    got = lexical_search.searched(docs, spark.createDataFrame(items, ITEMS), k)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(rows, items, k)


def test_lexical_search_in_small_shards_and_blocks(spark, docs, rows, items, monkeypatch):
    for name, value in (("SHARD_POSTINGS", 300), ("HELD", 20), ("BLOCK_BYTES", 400)):
        monkeypatch.setattr(lexical_search, name, value)
    monkeypatch.setattr("planwright.llm.terms.PIECE", 50)
    got = lexical_search.searched(docs.coalesce(2), spark.createDataFrame(items, ITEMS), 3)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute_search(rows, items, 3)


def test_lexical_search_of_nothing(spark, docs, items):
    asked = spark.createDataFrame(items, ITEMS)
    assert lexical_search.searched(docs.limit(0), asked).count() == 0
    assert lexical_search.searched(docs, asked.limit(0)).count() == 0
    assert lexical_search.searched(docs.where("text IS NULL"), asked).count() == 0


def test_scoring_stops_early_and_stays_exact():
    r = np.random.default_rng(2)
    for k, floor in ((1, 0), (10, 0), (10, 900)):
        lists = [lexical_search._Postings(d := np.sort(r.choice(400, 200, False)), r.integers(0, 60, len(d)) * (9 if i == 0 else 1)) for i in range(12)]
        whole = np.zeros(400, np.int64)
        for p in lists:
            whole[p.docs] += p.impact
        docs, score = lexical_search._accumulate(lists, 400, k, floor)
        assert (whole[docs] == score).all()
        need = max(floor, np.sort(whole)[-k])
        assert set(np.flatnonzero(whole >= need)) <= set(docs)


def brute_vectors(rows, k):
    fit = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, a in fit:
        if q is not None and q % 50 == 0:
            scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i is None, i or 0) for m, i, b in fit if m != n)
            out += [(q, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


def vectors(n=400, dim=16):
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, dim))
    rows = [(i, (centre[i % 6] / 3 + r.normal(size=dim) / 6).astype("f4").tolist(), "r", "v", "s") for i in range(n)]
    rows += [rows[50], rows[50], (None, rows[51][1], "r", "v", "s")]
    for i, bad in enumerate(([None] * dim, [float("nan")] + [0.0] * 15, [float("inf")] + [0.0] * 15, None, [], [1.0, 2.0], [0.0] * dim)):
        rows.append((1000 + 50 * i, bad, "r", "v", "s"))
    return rows


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_vector_search(spark, k):
    rows = vectors()
    got = vector_search.searched(spark.createDataFrame(rows, VECTORS).repartition(3), k=k)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == brute_vectors(rows, k)


def test_vector_search_in_small_tiles_and_blocks(spark, monkeypatch):
    for name, value in (("TILE", 64), ("SEED", 8), ("PROBED", 2), ("BLOCK_BYTES", 700)):
        monkeypatch.setattr(vector_search, name, value)
    rows = vectors()
    got = vector_search.searched(spark.createDataFrame(rows, VECTORS).coalesce(1))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == brute_vectors(rows, 5)


def test_vector_search_beyond_doubles(spark):
    r = random.Random(1)
    rows = [(i * 25, [r.choice([-1, 1]) * 2.0 ** r.randint(0, 50) for _ in range(4)], "r", "v", "s") for i in range(30)]
    frame = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    assert sorted(map(tuple, vector_search.searched(frame).select("query_id", "rank", "vec_id", "score").collect()), key=str) == brute_vectors(rows, 5)


def test_vector_search_of_nothing(spark):
    frame = spark.createDataFrame(vectors(), VECTORS)
    assert vector_search.searched(frame.limit(0)).count() == 0
    assert vector_search.searched(frame.where("embedding IS NULL")).count() == 0
    assert vector_search.searched(frame, F.lit(False)).count() == 0
