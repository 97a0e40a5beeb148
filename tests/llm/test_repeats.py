"""Substring dedup against all windows, the index against plain search."""

import hashlib
import random
import re

import numpy as np
import pytest
from lucidform.llm import queries, repeats
from lucidform.llm.fmindex import FmIndex
from pyspark.sql import functions as F

import checker

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """(doc_id, n_words, n_removed, kept) of each row; null ids stand first, by their text."""
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = {}
    for (i, w), (_, t) in zip(texts, rows):
        for k in range(len(w) - window + 1):
            key, at = tuple(w[k : k + window]), (i is not None, i or 0, "" if i is not None else t, k)
            seen[key] = min(seen.get(key, at), at)
    out = []
    for (i, w), (_, t) in zip(texts, rows):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < (i is not None, i or 0, "" if i is not None else t, k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    return sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def made(seed, n=70):
    """Texts of few words with shared passages, copies, periodic runs and short ones."""
    rng = random.Random(seed)
    fresh = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    passages = [fresh(rng.choice((19, 20, 21, 30, 55, 120))) for _ in range(9)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += fresh(rng.choice((0, 3, 18, 25, 60)))
            words += rng.choice(passages) if rng.random() < 0.6 else []
            if rng.random() < 0.2:
                words += fresh(rng.randrange(1, 4)) * rng.randrange(8, 40)
        rows.append((i * 3, rng.choice((" ", "\n", " \t ")).join(words)))
    rows += [(1000 + k, rows[5][1]) for k in range(12)] + [(2, rows[9][1] + " more")]
    return rows


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"crowd": 2}), (3, {"shard_words": 300}), (4, {"gram": 3, "crowd": 3}), (5, {"window": 9, "gram": 4})])
def test_equals_all_windows(docs_of, seed, how):
    rows = made(seed)
    got = repeats.without_repeats(docs_of(rows), **how).collect()
    want = brute(rows, how.get("window", 20))
    assert same(got, want) and sum(r[2] for r in want) > 500


def test_odd_rows(docs_of):
    rng = random.Random(9)
    fresh = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(k))
    long, passage = fresh(40_000), fresh(33)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a " * 50), (6, "a " * 25), (7, long), (8, "x " + long), (9, passage)]
    rows += [(10, passage), (10, "y " + passage), (10, None), (12, passage), (12, passage), (None, passage + " z"), (None, "é " + passage), (None, None)]
    rows += [(20, fresh(19)), (21, fresh(20)), (22, "É " * 30), (23, "é " * 30)]
    got = repeats.without_repeats(docs_of(rows)).collect()
    nulls = [r for r in got if r["doc_id"] is None]
    want = brute([r for r in rows if r[0] is not None] + [(None, passage + " z"), (None, "é " + passage), (None, None)])
    assert same([r for r in got if r["doc_id"] is not None and r["doc_id"] != 9], [r for r in want if r[0] is not None and r[0] != 9])
    assert sorted(r["n_removed"] for r in nulls) == [0, 0, 33]  # which of the two comes first is up to their hashes
    assert [r["n_removed"] for r in got if r["doc_id"] == 9] == [33]
    assert repeats.without_repeats(docs_of(rows[:4])).where("n_removed > 0").count() == 0
    assert repeats.without_repeats(docs_of(rows).where("false")).collect() == []


def test_op11_equals_all_windows_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = queries.QUERIES["op11_fm_index_dedup"](spark, sf)
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute(rows)]
    assert same(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), want)
    assert checker.compare(found, checker.connect(sf), queries.ORACLES["op11_fm_index_dedup"]) == []


@pytest.mark.parametrize("seed", range(6))
def test_index_against_plain_search(seed):
    rng = np.random.default_rng(seed)
    window, most = int(rng.integers(2, 12)), int(rng.integers(1, 6))

    def drawn(k):
        lengths = rng.integers(0, 40, k)
        return rng.integers(1, most + 1, lengths.sum()), np.concatenate([[0], np.cumsum(lengths)])

    text, bounds = drawn(25)
    place = rng.permutation(len(text))
    index = FmIndex(text, bounds, place, window)
    known = {}
    for a, b in zip(bounds[:-1], bounds[1:]):
        for i in range(a, b - window + 1):
            key = tuple(text[i : i + window])
            known[key] = min(known.get(key, 1 << 40), int(place[i]))
    other, ends = drawn(30)
    other[: len(other) // 2] = np.resize(text, len(other) // 2)
    other[rng.random(len(other)) < 0.05] = 0  # words that the index doesn't know
    got = index.match(other, ends)
    want = np.full(len(other), -1)
    for a, b in zip(ends[:-1], ends[1:]):
        for i in range(a, b - window + 1):
            want[i] = known.get(tuple(other[i : i + window]), -1)
    assert (got == want).all() and (want >= 0).any()


def test_spans_are_bounded_and_extra_columns_ignored(docs_of):
    rows = made(8, 30)
    spans = repeats.repeated_spans(docs_of(rows).withColumn("row", F.lit("x")).withColumn("key", F.lit(1)))
    sizes = {i: len(WORD.findall(t)) for i, t in rows}
    assert all(0 <= s["start"] and s["length"] >= 20 and s["start"] + s["length"] <= sizes[r["doc_id"]] for r in spans.collect() for s in r["spans"])
