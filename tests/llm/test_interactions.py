"""Filter interactions against a plain walk through every order."""

import re
from itertools import permutations

from lucidform.llm import interactions, queries

import checker

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *flags in labels if flags[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        tests = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i)
        parts.setdefault(lang or "", []).append(({c for c, x in zip("ABCDE", tests) if x}, i in good, i in toxic))
    out, shapley = {}, {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[0]]
                redundant = sum(c in r[0] for r in rows) - sum(c in r[0] for r in left)
                left = [r for r in left if c not in r[0]]
                out[part, order, step] = [len(left), len(gone), redundant, sum(r[0] == {c} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_dict(df):
    rows = df.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(got) == len(rows)
    return got


def test_op12_equals_a_plain_walk_and_sql(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = queries.QUERIES["op12_filter_interactions"](spark, sf)
    want = brute([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], [tuple(r[c] for c in ("doc_id", "quality", "toxic")) for r in labels.collect()])
    assert as_dict(found) == want and len(want) == 600 * len({k[0] for k in want})
    assert checker.compare(found, checker.connect(sf), queries.ORACLES["op12_filter_interactions"]) == []


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    many = " ".join(f"w{i}" for i in range(150))
    docs = [(1, None, None), (2, "", "en"), (3, " ", "en"), (4, long, "fr"), (5, long, "en"), (5, long, "fr"), (None, long, "fr"), (None, many, None)]
    docs += [(6, many, "en"), (6, many, "en"), (6, many, "de"), (7, many, "de"), (8, many + " $", "de"), (9, many.upper(), "de"), (10, "a " * 200, "de"), (10, "É#", "de")]
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, None), (7, 1, 1), (99, 1, 1), (None, 1, 1), (10, None, 1)]
    table = spark.createDataFrame([(*d, 7, "x", 1) for d in docs], "doc_id bigint, text string, lang string, mask int, part string, n int").repartition(3)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    assert as_dict(interactions.audit(table, marks)) == brute(docs, labels)
    assert interactions.audit(table.where("false"), marks).collect() == []
    assert as_dict(interactions.audit(table, marks.where("false"))) == brute(docs, [])
