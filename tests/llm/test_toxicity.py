"""Toxicity: held-out accuracy, sentences, odd texts."""

import math
import re

import numpy as np
from lucidform.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.QUERIES["op7_toxicity"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = [(r["toxic"], r["predicted"]) for r in got.where("held_out").join(labels, "doc_id").collect()]
    bad, good = [p for t, p in rows if t], [p for t, p in rows if not t]
    assert np.mean(bad) >= 0.8 and np.mean(good) <= 0.01


def test_labels_held_out_stay_unread(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert a.words == b.words and np.allclose(a.weights, b.weights) and a.bias == b.bias


def learned(docs_of, spark):
    rows = [(i, f"plain words number {i}. more of them here! " * 3 + (("you blorf now. ", "some blorf there. ")[i % 2] if i % 5 == 0 else ("you now. ", "some there. ")[i % 2])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    return toxicity.fit(docs_of(rows), labels)


def test_offending_sentences_are_located(spark, docs_of):
    model = learned(docs_of, spark)
    rows = [(1, "Nothing here. You BLORF, now! Good day."), (2, "Nothing at all.\nblorf"), (3, "plain words number 7."), (4, None), (5, ""), (6, " \n. "), (7, "so it goes. " * 30_000), (None, "blorf blorf")]
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(rows), model).collect()}
    assert len(got) == len(rows)
    assert [s["text"] for s in got[1]["sentences"]] == ["You BLORF, now!"] and got[1]["sentences"][0]["number"] == 1
    assert [s["text"] for s in got[2]["sentences"]] == ["blorf"]
    assert {k: r["predicted"] for k, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0, None: 1}
    assert got[4]["score"] == got[5]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    # a document's score is the noisy-or of its sentences'
    kept = toxicity.accepted(docs_of(rows), model)
    assert kept.columns == docs_of(rows).columns and {r["score"] for r in kept.collect()} == {1.5}
    assert {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7}


def test_without_labels_nothing_is_toxic(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = docs_of([(1, "any text"), (2, None)])
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), learned(docs_of, spark)).collect() == []


def plain_score(text, model):
    """Noisy-or over sentences from the model's weights, word by word."""
    weight = dict(zip(model.words, model.weights))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").replace("\n", " . ")) if w]
    sentences = []
    for k, w in enumerate(words):
        if not k or (re.search(toxicity.SENTENCE_END, words[k - 1]) and w.strip(toxicity.TRIMMED)):
            sentences.append([])
        sentences[-1].append(w.strip(toxicity.TRIMMED).lower())
    clean = 1.0
    for s in sentences:
        known = [weight[f] for w in s for f in [w, *(w[:n] + "|" for n in toxicity.OPENINGS if len(w) > n)] if f in weight]
        clean *= 1 - (1 / (1 + math.exp(-model.bias - sum(known))) if known else 0.0)
    return 1 - clean


def test_scores_are_the_noisy_or_of_sentences(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(model.words) > 5 and any(r["score"] > 0.3 for r in got)
    for r in got:
        assert abs(r["score"] - plain_score(r["text"], model)) < 1e-9
        assert all(0 <= s["score"] <= 1 for s in r["sentences"])


def test_repeated_ids_dont_lift_the_sample(spark, docs_of):
    rows = [(i % 3, f"text number {i} here.") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "doc_id bigint, toxic int")
    some = toxicity.training_rows(docs_of(rows), labels, limit=100).count()
    assert 50 < some < 160
    held = docs_of([(None, "x"), (2, "y")]).select(toxicity.held_out().alias("h")).collect()
    assert {r["h"] for r in held} <= {True, False}
