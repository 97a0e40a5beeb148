"""Neighbour search and cap filters against all pairs."""

import numpy as np
import pytest
from lucidform.llm import caps, probing, queries

ODD = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0, None] + [0.0] * 6), (904, [float("nan")] * 8), (905, [float("inf")] * 8), (None, [1.0] * 8), (906, [1.0, 2.0])]


def table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    return [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in rows]


def near(rows):
    ids = np.array([i for i, _ in rows])
    x = np.stack([v / np.linalg.norm(v) for _, v in rows])
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    comp = ids.copy()
    for _ in range(len(ids)):
        new = comp.copy()
        i, j = np.nonzero(link)
        np.minimum.at(new, i, comp[j])
        if (new == comp).all():
            break
        comp = new
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, link.sum(1), comp)}


def test_op6_equals_all_pairs(spark, sf):
    got = queries.QUERIES["op6_cap_filter_near_dedup"](spark, sf).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == near(table(spark, sf))


def test_clusters_copies_and_odd_vectors(vectors_of):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(24)
    rows = [(i, v) for i, v in enumerate((centre + 0.22 * rng.standard_normal((150, 24))).astype(np.float32).astype(float))]
    rows += [(200 + i, v) for i, v in enumerate(rng.standard_normal((150, 24)).astype(np.float32).astype(float))]
    rows += [(400 + i, rows[3][1]) for i in range(30)] + [(450, 5 * rows[7][1])]
    got = caps.near_vectors(vectors_of([(i, v.tolist()) for i, v in rows] + ODD), block=32).collect()
    want = near(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got if r["vec_id"] in want} == want
    odd = [r for r in got if r["vec_id"] not in want]
    assert len(odd) == len(ODD) and all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] and r["kept"] for r in odd)
    assert caps.near_vectors(vectors_of(ODD[:3])).count() == 3
    assert caps.near_vectors(vectors_of(ODD).where("false")).collect() == []


def test_few_pairs_at_the_threshold_share_no_filter():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((800, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    codes = caps.codes_for(64, 50_000)
    a, b = (set(zip(*(v.tolist() for v in caps.decode_all(codes, y)))) for y in (x, 0.95 * x + np.sqrt(1 - 0.95**2) * z))
    assert len({row for row, _ in a & b}) >= 797


@pytest.mark.parametrize("dims, vectors", [(64, 50_000_000), (64, 80_000), (32, 1_000_000), (16, 100_000), (8, 100_000), (4, 100_000), (2, 50)])
def test_few_pairs_share_no_filter_in_large_tables_and_low_dims(dims, vectors):
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, 800, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    codes = caps.codes_for(dims, vectors)
    a, b = (row * (1 << 50) + number for row, number in (caps.decode_all(codes, y) for y in (x, 0.95 * x + np.sqrt(1 - 0.95**2) * z)))
    assert len(np.unique(np.intersect1d(a, b) >> 50)) >= 799


def test_decoding_finds_all_exceeding_filters():
    code = caps.product_code(10, 300, 1)
    x = np.random.default_rng(2).standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    first, second = code.words
    full = np.concatenate([np.hstack([np.tile(f, (len(second), 1)), second]) for f in first])
    score = (x @ code.rotation) @ full.T
    want = {(i, j) for i in range(20) for j in range(len(full)) if score[i, j] >= min(code.cap, score[i].max()) - 1e-12}
    assert set(zip(*(v.tolist() for v in caps.decode(code, x)))) == want


def nearest(rows, asks, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.stack([v for _, v in rows])
    out = {}
    for i, v in rows:
        if asks(i):
            s = x @ v
            out[i] = [(int(a), float(b)) for b, a in sorted(((-b, a) for a, b in zip(ids, s) if a != i))][:k]
            out[i] = [(a, -b) for a, b in out[i]]
    return out


def recall(got, want):
    have = {}
    for r in got:
        have.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(have) == set(want)
    hits = 0
    for q, w in want.items():
        rows = sorted(have[q])
        assert [r[0] for r in rows] == list(range(1, len(w) + 1))
        assert [(-s, v) for _, v, s in rows] == sorted((-s, v) for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in w})
    return hits / sum(map(len, want.values()))


def test_op4_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op4_multiprobe_neighbours"](spark, sf).collect()
    assert recall(got, nearest(table(spark, sf), lambda i: i % 20 == 0)) >= 0.9


def test_neighbours_of_copies_odd_and_few_vectors(vectors_of):
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate((rng.standard_normal((700, 8)) * rng.uniform(0.2, 3, (700, 1))).astype(np.float32).astype(float))]
    rows += [(1000 + i, rows[40][1]) for i in range(90)]
    got = probing.nearest_vectors(vectors_of([(i, v.tolist()) for i, v in rows] + ODD)).collect()
    want = nearest(rows, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.9
    copies = {r["rank"]: r["vec_id"] for r in got if r["query_id"] == 1000}
    assert copies == {k + 1: v for k, (v, _) in enumerate(want[1000])}
    few = probing.nearest_vectors(vectors_of([(i, v.tolist()) for i, v in rows[:9]] + ODD)).collect()
    assert recall(few, nearest(rows[:9], lambda i: i % 20 == 0)) == 1
    assert probing.nearest_vectors(vectors_of(ODD[:4])).collect() == []
    assert probing.nearest_vectors(vectors_of(rows[:0])).collect() == []


def test_two_lengths_and_one_long_vector_leave_no_query_short(vectors_of, monkeypatch):
    """Each length is searched among its own; all queries get all their rows; recall stays above 0.9."""
    monkeypatch.setattr(probing, "WHOLE", 100)
    rng = np.random.default_rng(14)
    wide = rng.standard_normal((2600, 16)) * np.exp(rng.standard_normal((2600, 1)))
    wide[7] *= 1000
    short = rng.standard_normal((300, 5))
    few = rng.standard_normal((40, 3))
    rows = [(i, v.astype(np.float32).astype(float)) for i, v in enumerate([*wide, *short, *few])]
    got = probing.nearest_vectors(vectors_of([(i, v.tolist()) for i, v in rows])).collect()
    want = {}
    for n in (16, 5, 3):
        want |= nearest([(i, v) for i, v in rows if len(v) == n], lambda i: i % 20 == 0)
    assert len(want) == 147 and all(len(w) == 20 for w in want.values())
    assert recall(got, want) >= 0.9


def test_short_queries_are_scored_against_all_vectors(spark, vectors_of):
    rng = np.random.default_rng(3)
    rows = [(i, v.astype(np.float32).astype(float)) for i, v in enumerate(rng.standard_normal((500, 6)))]
    packed = probing.as_bytes(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "id bigint, embedding array<double>"), "<f8")
    got = probing.exact_nearest(packed, packed.where("id % 9 = 0"), "<f8", 4, block=17).collect()
    have = {}
    for r in got:
        have.setdefault(r["query"], []).append((-r["score"], r["id"]))
    x = np.stack([v for _, v in rows])
    for q, found in have.items():
        assert [i for _, i in sorted(found)][:5] == np.argsort(-(x @ x[q]), kind="stable")[:5].tolist()
    assert len(have) == 56


@pytest.mark.parametrize("cells, distance", [(7, 1.0), (9, 1.0)])
def test_probed_cells_reach_their_share_with_many_projections(cells, distance):
    """Queries and unit vectors at the distance that neighbours have in tables of many millions."""
    rng = np.random.default_rng(4)
    x, z = rng.standard_normal((2, 60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = 1 - distance**2 / 2
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    h = probing.Hashing(64, 1.0, cells, distance)
    found = np.zeros(len(x), dtype=bool)
    for t in range(probing.TABLES):
        row, number = probing.probes(h, x, t)
        hit = number == probing.bucket(h, y, t)[row]
        found[row[hit]] = True
    assert found.mean() >= 0.9


def test_projections_are_held_at_what_the_cells_cover():
    x = np.random.default_rng(5).standard_normal((16, 64))
    h = probing.Hashing(64, 1.0, 0, 1.0)
    assert probing.projections_for(h, x, 3) == 3
    k = probing.projections_for(h, x, 10)
    assert 5 <= k < 10
    assert sum(len(probing._probes(h._replace(cells=k), x, t, probing.REACH, probing.CELLS)[2]) for t in range(probing.TABLES)) <= 4
