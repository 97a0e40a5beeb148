"""MinHash near-duplicates and components against all pairs."""

import random

import pytest
from lucidform.llm import minhash, queries
from lucidform.llm.components import components


def shingles(text):
    w = (text or "").encode().lower().split()  # bytes: only A-Z are folded, only ASCII space parts
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def smallest(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = []
    for k, (a, s) in enumerate(sets):
        for b, t in sets[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                pairs.append((a, b))
    return smallest(pairs, [i for i, _ in rows]), {i: len(s) for i, s in sets}


def check(got, rows):
    want, sizes = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len(got) == len(rows)


def test_op10_equals_all_pairs(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(queries.QUERIES["op10_minhash_near_dedup"](spark, sf).collect(), rows)


def test_spread_group_in_blocks(docs_of):
    """One base, many edited copies around the threshold, several blocks a bucket."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 5))):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    check(minhash.near_duplicates(docs_of(rows), block=40).collect(), rows)


def test_odd_texts(docs_of):
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (9, "É b c d e f"), (10, "é b c d e f"), (11, "x y b c d e"), (12, "x y b c d e")]
    check(minhash.near_duplicates(docs_of(rows)).collect(), rows)


def test_null_and_repeated_ids(docs_of):
    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (5, "a b c d e f"), (5, "other words entirely in this one")]
    got = minhash.near_duplicates(docs_of(rows)).collect()
    assert len(got) == 6
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(3, 3), (5, 3), (5, 5)}
    kept = minhash.one_of_each(docs_of(rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 0, 3, 5, 5]
    assert minhash.near_duplicates(docs_of(rows).where("false")).collect() == []


def test_repeated_ids_with_blank_and_other_texts(docs_of):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    near = " ".join([*base[:40], "x", *base[41:]])
    far = [" ".join(f"f{k}{rng.randrange(10**6)}" for _ in range(30)) for k in range(4)]
    rows = [(7, " ".join(base)), (7, None), (7, ""), (7, " \n"), (9, near), (9, far[0]), (9, None), (4, far[0]), (4, far[1]), (12, far[1] + " tail"), (12, far[2]), (12, far[2]), (15, far[3])]
    got = minhash.near_duplicates(docs_of(rows)).collect()
    texts = [(k, t) for k, (_, t) in enumerate(rows)]
    groups, sizes = brute(texts)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[groups[k]] = min(i, least.get(groups[k], i))
    want = sorted((i, sizes[k], least[groups[k]]) for k, (i, _) in enumerate(rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert {(9, 76, 7), (9, 26, 4), (9, 0, 9), (4, 26, 4)} < set(want)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(700, 760)]
    want = smallest([p for p in pairs if p[0] != p[1]], {i for p in pairs if p[0] != p[1] for i in p})
    got = components(spark.createDataFrame([*pairs, *pairs[:9], (None, 3), (4, None)], "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
