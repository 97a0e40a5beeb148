"""Stages of the corpus pipeline, each on what the one before it kept."""

import math
import random
from collections import Counter

import __spark_entry__
import corpus_pipeline
from lucidform.llm import minhash, mixing, queries, toxicity
from pyspark.sql import functions as F
from test_near_duplicates import brute, shingles, smallest
from test_tokens_packing import check_placed


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    (_, toxic), (_, copies), (_, mix), (_, pack) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, sf).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    one = copies(spark, kept, sf).cache()
    component, _ = brute(rows, corpus_pipeline.COPIES_PERCENT)
    assert one.columns == docs.columns and sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, c in component.items() if i == c)
    mixed = mix(spark, one, sf).cache()
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns
    assert times == {r["doc_id"]: r["copies"] for r in mixing.mix(one).collect() if r["copies"]}
    placed = pack(spark, mixed, sf).collect()
    assert Counter(r["doc_id"] for r in placed if r["piece"] == 0) == times
    bins, least = check_placed(placed)
    assert bins <= 1.01 * least + 1


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_pipeline_runs(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_stages_with_nulls_repeats_and_clashing_columns(spark, sf):
    """Null and blank texts, null and repeated ids and sources, columns named like those of the operators."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs.where("doc_id < 12")
    odd = docs.where("doc_id < 40").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN ' ' ELSE '' END AS text", "lang", "source", "n_chars")
    nameless = first.selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "lang", "CAST(NULL AS string) AS source", "n_chars")
    extra = docs.unionByName(first).unionByName(odd).unionByName(nameless).selectExpr("*", "1 AS id", "'x' AS words", "2.5 AS size", "3 AS copies", "4 AS sequence_id").cache()
    now, counts = extra, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        counts.append(now.count())
        assert now.columns == extra.columns, name
    assert counts[0] <= extra.count() and counts[1] < counts[0]
    copies = {r["n"] for r in now.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    assert copies <= {1, 2}
    placed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    check_placed(placed)
    assert len([r for r in placed if r["piece"] == 0]) == counts[2]


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == []


def test_copies_stage_takes_pairs_from_080(spark, sf, docs_of):
    rng = random.Random(6)
    rows, close = [], 0
    for i in range(120):
        n, places = ((49, [24]), (90, [2, 40]), (90, [30, 60]), (94, [30, 60]), (90, [45]))[i % 5]  # 0.80, 0.83, 0.79, 0.80, 0.89
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        copy = list(words)
        for at in places:
            copy[at] = f"v{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    pairs = []
    for (a, s), (b, t) in zip(rows[::2], rows[1::2]):
        s, t = shingles(s), shingles(t)
        if 100 * len(s & t) >= 80 * len(s | t):
            pairs.append((a, b))
            close += 100 * len(s & t) < 85 * len(s | t)
    want = smallest(pairs, [i for i, _ in rows])
    assert close > 30 and len(pairs) < 120
    got = corpus_pipeline.drop_copies(spark, docs_of(rows), sf)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, c in want.items() if i == c)


def test_signature_check_lies_well_below_080():
    n = minhash.BANDS * minhash.ROWS
    need, agree = math.ceil(minhash.LIKELY * n), 0.8 + 0.2 / 256
    assert sum(math.comb(n, k) * agree**k * (1 - agree) ** (n - k) for k in range(need)) < 1e-6
