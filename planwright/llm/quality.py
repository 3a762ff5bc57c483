"""Quality rules: base rules and bands of n-gram perplexity by language.

Method: a modified Kneser-Ney model of byte 4-grams per language, counted by Spark over every whole
document of plain prose, told by intake rules (the base rules, few symbols, few capitals); the
interpolated log-probabilities and back-off weights are stored in sorted hash arrays.  The intake is
part of the method, since a model that counts junk predicts it: with one junk text among 60 plain ones
counted as well, its perplexity was 3.5 under a bound of 4.0, and it was kept.  A document is rejected
if its perplexity leaves its language's band, whose bounds are fixed multiples of the median perplexity
over all documents that pass the base rules, however far those spread.

Size of what is broadcast: hash slots number 2**24 at most whatever the corpus, eight bytes each;
n-grams that meet in one slot share their count-weighted mean.

Defined results: null and empty texts have no words and fail the base rules; a null language is a
language of its own, apart from the empty one; repeated rows are scored one by one; a text under four
bytes has no perplexity (null) and is judged by the base rules alone; a very long text is counted and
scored whole; a language whose documents all fail the base rules has no band and rejects nothing more;
other columns are ignored by ``assess`` and pass through ``passing``; an empty table gives an empty one.
Sums are taken in whole numbers, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .shared import checkpointed, fields, whole_rows

U = np.uint64
ORDER = 4
SLOT_BITS = 24
#: Rows of the count tables per task.
PER_TASK = 50_000
#: Base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Intake rules of the model: symbols per word and capitals per letter, in percent.
MAX_SYMBOL_PERCENT, MAX_UPPER_PERCENT = 10, 30
#: Bounds of the band of perplexity, as multiples of the language's median; the lower one leaves room
#: for near copies, which the model of a small language predicts well.
LOWER, UPPER = 0.5, 2.4

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER_CASE = np.zeros(256, bool)
UPPER_CASE[65:91] = True
LOWER_CASE = np.zeros(256, bool)
LOWER_CASE[97:123] = True

#: Steps per nat in which medians are taken, and the fixed point of a slot's mean.
STEPS, SCALE = 1000, 1_000_000

COUNTS = "lang string, gram long, c long"
BASE = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_sum double, n_grams long"


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(c: T.Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of the document."""
    out = np.zeros(c.n, np.int64)
    if not len(c.data):
        return out
    edge = np.zeros(len(c.data) + 1, bool)
    newline = np.flatnonzero(c.data == 10)
    edge[c.bounds] = True
    edge[newline + 1] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(c.data))
    ends = ends - (c.data[ends - 1] == 10)
    words = np.zeros(len(c.data) + 1, np.int64)
    np.cumsum(~c.space, out=words[1:])
    full = words[ends] > words[starts]
    starts, ends = starts[full], ends[full]
    if not len(starts):
        return out
    doc = np.searchsorted(c.bounds, starts, side="right") - 1
    key = T.span_hashes(c.data, starts, ends, "line") + T.mix(doc.astype(U) + U(1))
    _, place = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[place] = False
    return np.bincount(doc[later], minlength=c.n)


def _repeat_words(c: T.Chunk, k: int = 3) -> np.ndarray:
    """Words in k-word windows that occur twice or more in the document."""
    if len(c.doc) < k:
        return np.zeros(c.n, np.int64)
    grams = T.gram_hashes(c.word_hashes(), k)
    at = np.flatnonzero(c.doc[: len(grams)] == c.doc[k - 1 :])
    key = grams[at] + T.mix(c.doc[at].astype(U) + U(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    twice = at[order[same[1:] | same[:-1]]]
    delta = np.zeros(len(c.doc) + 1, np.int64)
    np.add.at(delta, twice, 1)
    np.add.at(delta, twice + k, -1)
    return _per_doc(np.cumsum(delta)[:-1] > 0, c.first)


def _base(c: T.Chunk) -> dict[str, np.ndarray]:
    lead = ~c.space & ((c.data & 0xC0) != 0x80)
    return {
        "n_words": c.counts,
        "word_chars": _per_doc(lead, c.bounds),
        "n_symbols": _per_doc(SYMBOL[c.data], c.bounds),
        "n_dup_lines": _dup_lines(c),
        "n_repeat_words": _repeat_words(c),
    }


def _grams(data: np.ndarray) -> np.ndarray:
    """Bytes i - 3 to i, packed; the first three values are of no use."""
    g = data.astype(np.int64)
    out = g.copy()
    for j in range(1, ORDER):
        out[j:] |= g[: len(g) - j] << (8 * j)
    return out


def _usable(c: T.Chunk) -> np.ndarray:
    """Whether the four bytes up to each place lie in one document."""
    ok = np.ones(len(c.data), bool)
    for j in range(ORDER - 1):
        at = c.bounds[:-1] + j
        ok[at[at < len(ok)]] = False
    return ok


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        names = sorted(set(langs))
        numbers = {n: i for i, n in enumerate(names)}
        ids = np.array([numbers[x] for x in langs], np.int64)
        keys, counts = [], []
        for c in T.chunks(batch.column(2)):
            base = _base(c)
            upper, lower = _per_doc(UPPER_CASE[c.data], c.bounds), _per_doc(LOWER_CASE[c.data], c.bounds)
            good = (base["n_words"] >= MIN_WORDS) & (100 * base["n_repeat_words"] <= MAX_REPEAT_PERCENT * base["n_words"])
            good &= 100 * base["n_symbols"] <= MAX_SYMBOL_PERCENT * base["n_words"]
            good &= 100 * upper <= MAX_UPPER_PERCENT * (upper + lower)
            length = np.diff(c.bounds)
            take = _usable(c) & np.repeat(good, length)
            key = _grams(c.data) | (np.repeat(ids[c.lo : c.lo + c.n], length) << 32)
            u, n = np.unique(key[take], return_counts=True)
            keys.append(u)
            counts.append(n)
        if not keys:
            continue
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
        lang = pa.array(names, pa.string()).take(pa.array(u >> 32))
        yield pa.RecordBatch.from_arrays([lang, pa.array(u & 0xFFFFFFFF), pa.array(n)], names=["lang", "gram", "c"])


def slots(lang: np.ndarray, order: int, gram: np.ndarray) -> np.ndarray:
    """Hash slot of an entry; ``lang`` holds the language's own hash."""
    return (T.mix(gram.astype(U) + lang + U(order * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(64 - SLOT_BITS)).astype(np.uint32)


def lang_hash(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(T.span_hashes(raw, np.array([0]), np.array([len(raw)]), "word")[0]) if len(raw) else 1


def _named(lang: Column) -> Column:
    """A language's name behind a mark, and the empty string for null, so that joins find both."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (lang, kind, gram, value, c); each order is cut by a checkpoint, which keeps the plans small.

    Kind k holds ln p of k-grams, kind 8 + k ln of the weight left by a context.  ``counts`` has
    (lang, gram, c) for the highest order.  Lower orders count distinct left neighbours.  Discounts come from the counts of counts of each language and order.
    """
    tasks = 1 + counts.count() // PER_TASK
    tables = {order: counts.coalesce(tasks)}
    for k in range(order - 1, 0, -1):
        lower = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        tables[k] = checkpointed(lower.coalesce(tasks))
    below, out = None, None
    for k in range(1, order + 1):
        t = tables[k].withColumn("ctx", F.shiftright("gram", 8))
        many = [F.sum((F.col("c") == j).cast("double")).alias(f"n{j}") for j in range(1, 5)]
        d = t.groupBy("lang").agg(*many).withColumn("y", F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")))
        cuts = []
        for j in range(1, 4):
            raw = F.lit(float(j)) - F.lit(j + 1.0) * F.col("y") * F.try_divide(F.col(f"n{j + 1}"), F.col(f"n{j}"))
            cuts.append(F.least(F.greatest(F.coalesce(raw, F.lit(j / 2)), F.lit(0.05)), F.lit(j - 0.05)).alias(f"d{j}"))
        d = d.select("lang", *cuts)
        sums = [F.sum("c").alias("s"), *(F.sum((F.col("c") == j).cast("long")).alias(f"m{j}") for j in (1, 2)), F.sum((F.col("c") >= 3).cast("long")).alias("m3")]
        s = t.groupBy("lang", "ctx").agg(*sums).coalesce(tasks).join(d.coalesce(1), "lang").coalesce(tasks)
        s = checkpointed(s.withColumn("left", (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("s")))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(s, ["lang", "ctx"]).coalesce(tasks).withColumn("own", (F.col("c") - cut) / F.col("s"))
        if below is None:
            t = t.withColumn("p", F.col("own") + F.col("left") / 256)
        else:
            t = t.withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
            t = t.join(below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"]).coalesce(tasks).withColumn("p", F.col("own") + F.col("left") * F.col("q"))
        below = checkpointed(t.select("lang", "gram", "p", "c"))
        rows = below.select("lang", F.lit(k).alias("kind"), "gram", F.log("p").alias("value"), "c")
        rows = rows.unionByName(s.select("lang", F.lit(8 + k).alias("kind"), F.col("ctx").alias("gram"), F.log("left").alias("value"), F.col("s").alias("c")))
        out = rows if out is None else out.unionByName(rows)
    return out


MODEL = "slot long, value double, c double"


def _to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = b.column(0).to_pylist()
        known = {n: lang_hash(n) for n in set(names)}
        lang = np.array([known[n] for n in names], U)
        kind, gram = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
        slot = (T.mix(gram.astype(U) + lang + kind.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - SLOT_BITS)).astype(np.int64)
        c = b.column(4).to_numpy(zero_copy_only=False).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(b.column(3).to_numpy(zero_copy_only=False) * c), pa.array(c)], names=["slot", "value", "c"])


def train(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The model's sorted hash array and its values, from (doc_id, lang, text); at most 2**SLOT_BITS entries of eight bytes."""
    counted = docs.mapInArrow(_count, COUNTS).groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    rows = kneser_ney(checkpointed(counted)).select("lang", "kind", "gram", "value", "c").mapInArrow(_to_slots, MODEL)
    exact = F.sum(F.round(F.col("value") * SCALE).cast("decimal(38,0)"))
    entries = rows.groupBy("slot").agg((exact.cast("double") / SCALE / F.sum("c")).cast("float").alias("value")).select(F.col("slot").cast("int"), "value")
    got = entries.toArrow()
    slot = got.column("slot").to_numpy().astype(np.uint32)
    order = np.argsort(slot)
    return slot[order], got.column("value").to_numpy().astype(np.float32)[order]


def _find(model: tuple[np.ndarray, np.ndarray], slot: np.ndarray) -> np.ndarray:
    """Values of slots; NaN where the model has no entry."""
    keys, values = model
    if not len(keys):
        return np.full(len(slot), np.nan)
    at = np.searchsorted(keys, slot)
    at[at == len(keys)] = 0
    return np.where(keys[at] == slot, values[at], np.nan).astype(np.float64)


def log_probabilities(model: tuple[np.ndarray, np.ndarray], lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """ln p of the last byte of each 4-gram given the three before it."""
    out = np.zeros(len(gram))
    todo = np.arange(len(gram))
    for k in range(ORDER, 0, -1):
        if not len(todo):
            return out
        g = gram[todo] & ((1 << 8 * k) - 1)
        found = _find(model, slots(lang[todo], k, g))
        hit = ~np.isnan(found)
        out[todo[hit]] += found[hit]
        todo, g = todo[~hit], g[~hit]
        weight = _find(model, slots(lang[todo], 8 + k, g >> 8))
        out[todo] += np.nan_to_num(weight, nan=0.0)
    out[todo] += np.log(1 / 256)
    return out


def _scorer(shared):
    """Base figures and the sum of logarithms of each document (doc_id, lang, text)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names = batch.column(1).to_pylist()
            known = {n: lang_hash(n) for n in set(names)}
            langs = np.array([known[n] for n in names], U)
            parts: dict[str, list[np.ndarray]] = {}
            for c in T.chunks(batch.column(2)):
                own = _base(c)
                ok = _usable(c)
                length = np.diff(c.bounds)
                doc = np.repeat(np.arange(c.n), length)[ok]
                key, inverse = np.unique(_grams(c.data)[ok] | (doc_lang(langs[c.lo : c.lo + c.n])[0][doc] << 32), return_inverse=True)
                lang = doc_lang(langs[c.lo : c.lo + c.n])[1][key >> 32]
                value = log_probabilities(model, lang, key & 0xFFFFFFFF)
                own["log_sum"] = np.bincount(doc, weights=value[inverse], minlength=c.n)
                own["n_grams"] = np.bincount(doc, minlength=c.n)
                for k, v in own.items():
                    parts.setdefault(k, []).append(v)
            if not parts:
                continue
            arrays = [batch.column(0), batch.column(1)] + [pa.array(np.concatenate(v)) for v in parts.values()]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", *parts])

    return score


def doc_lang(langs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for a chunk's languages, and the hash of each number."""
    u, inverse = np.unique(langs, return_inverse=True)
    return inverse.astype(np.int64), u


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the base figures, base_failed, kept, perplexity and its band."""
    return _judged(docs.select(F.col(id_col).cast("long").alias("doc_id"), _named(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text")))


def _medians(scored: DataFrame) -> DataFrame:
    """Rows (band_lang, mid): each language's median log-perplexity, to a step, from counts by step."""
    steps = scored.groupBy("lang", F.round(F.col("log_ppl") * STEPS).cast("long").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("lang").orderBy("step"))
    whole = F.sum("n").over(Window.partitionBy("lang"))
    steps = steps.withColumns({"up_to": up_to, "whole": whole})
    return steps.where(2 * F.col("up_to") >= F.col("whole")).groupBy(F.col("lang").alias("band_lang")).agg((F.min("step") / STEPS).alias("mid"))


def _judged(docs: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    scored = checkpointed(docs.mapInArrow(_scorer(shared), BASE))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("log_ppl", F.when(F.col("n_grams") > 0, -F.col("log_sum") / F.col("n_grams")))
    band = _medians(scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()))
    joined = scored.join(band, F.col("lang") == F.col("band_lang"), "left")
    low, high = F.exp("mid") * LOWER, F.exp("mid") * UPPER
    inside = F.coalesce(F.exp("log_ppl").between(low, high), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"),
        F.exp("log_ppl").alias("perplexity"), low.alias("lower_band"), high.alias("upper_band"),
    )


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that the rules reject; rows of equal text and language share a verdict.

    So ids, which may be null or shared, don't count.
    """
    keyed = whole_rows(docs, key=F.xxhash64(docs[text_col], docs[lang_col].isNull(), docs[lang_col]), lang=_named(docs[lang_col]), text=docs[text_col].cast("string"))
    kept = _judged(keyed.select(F.col("key").alias("doc_id"), "lang", "text")).where("kept").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(kept, "key", "left_semi").select(*fields(docs))
