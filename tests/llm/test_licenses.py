"""License scans against a full alignment of every template with every document."""

import numpy as np
from lucidform.llm import licenses, queries


def full_alignment(template, text):
    """Best local alignment score without a band."""
    best, before = 0, np.zeros(len(text) + 1, dtype=int)
    for w in template:
        now = np.zeros(len(text) + 1, dtype=int)
        for j, t in enumerate(text, 1):
            now[j] = max(0, before[j - 1] + (2 if w == t else -1), before[j] - 1, now[j - 1] - 1)
        best, before = max(best, int(now.max())), now
    return best


def words(text):
    return [p for w in licenses.WORD.findall(text or "") if (p := licenses.plain(w))]


def test_op9_finds_what_full_alignment_finds(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {}
    for r in queries.QUERIES["op9_license_scan"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(r)
    short = [(n, words(t)) for n, t in licenses.TEMPLATES if len(words(t)) < 15]
    for i, text in docs:
        own = words(text)
        exact = {n for n, t in short if any(own[k : k + len(t)] == t for k in range(len(own)))}
        assert exact <= {r["license"] for r in got.get(i, [])}
        for r in got.get(i, []):
            assert r["coverage"] >= licenses.COVERED and words(text[r["start"] : r["end"]])[0] in words(licenses.TEMPLATES[r["template"]][1])


def test_edited_notices_and_odd_texts(docs_of):
    apache, gpl3 = licenses.TEMPLATES[1][1], dict(licenses.TEMPLATES)["GPL-3.0-or-later"]
    cut_up = gpl3.replace("free software", "very free and open software").replace("modify it", "change it")
    rows = [(1, "Intro words.\n" + apache + "\nmore"), (2, cut_up.upper()), (3, None), (4, ""), (5, "MIT"), (6, "no notice here at all, " * 30_000 + "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (8, " ".join(apache.split()[:20])), (9, "Released under the MIT License. And: released under the MIT license!")]
    got = licenses.scan(docs_of(rows)).collect()
    told = {(r["doc_id"], r["license"]) for r in got}
    assert told == {(1, "Apache-2.0"), (2, "GPL-3.0-or-later"), (6, "MIT"), (None, "CC-BY-NC-4.0"), (8, "Apache-2.0"), (9, "MIT")}
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["coverage"] == 1 and rows[0][1][one["start"] : one["end"]] == apache
    assert sum(r["doc_id"] == 9 for r in got) == 2
    assert licenses.scan(docs_of(rows).where("false")).collect() == []


def test_banded_alignment_equals_full_alignment_near_the_diagonal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        template = [f"w{i}" for i in rng.integers(0, 30, 25)]
        text = [w for w in template if rng.random() > 0.15]
        for _ in range(3):
            text.insert(int(rng.integers(len(text))), "new")
        text = ["x"] * 40 + text + ["y"] * 40
        m = licenses.align(template, text, 40)
        part = text[m.start : m.end]
        assert full_alignment(template, text) == full_alignment(template, part)


def test_every_long_enough_run_shares_a_fingerprint():
    index = licenses.build_index()
    run = licenses.GRAM + licenses.WINDOW - 1
    for t, own in enumerate(index.words):
        places = set(index.place[index.template == t].tolist())
        for k in range(len(own) - run + 1):
            assert places & set(range(k, k + licenses.WINDOW))
