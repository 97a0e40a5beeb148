"""Headline timings: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lucidform.functions.formulas import OpSet
from lucidform.functions.traces import binary, leaf, unary
from lucidform.operators.scoring import score
from lucidform.operators.screening import search_scores
from lucidform.plans import registry
from lucidform.session import local_session
from lucidform.sources.labelled import returned_items, working_copy

HEADLINES = (
    "b04_div",
    "e01_exact_f1",
    "e03_percentile_f1_binned",
    "e07_confusion_metrics",
    "e13_linear_fit_r2",
    "e17_cond_mutual_info",
    "e22_describe_group",
    "f01_tie_safe_prefix",
    "i01_phased_search_full",
    "i03_beam_search_depth3",
    "j01_viability",
    "k02_pls",
    "l01_repeated_stratified_kfold",
    "m01_group_gram_wide",
    "m03_mode_gram",
    "n01_closest_return",
)


def exact_20(spark, sf):
    """Exact F1 and AUROC of 20 formulas."""
    lab = returned_items(spark, sf)
    traces = [leaf(i) for i in range(4)] + [binary(leaf(i), o, (i + 1) % 4) for i in range(4) for o in ("+", "*", "max", "/")]
    return score(lab, traces).collect()


def screen_1920(spark, sf):
    """Exact best 100 of 1920 formulas."""
    ops = OpSet()
    pairs = [leaf(i) for i in range(4)] + [binary(leaf(i), o, j) for i in range(4) for j in range(4) for o in ops.binary]
    many = [unary(u, t) for u in ops.unary for t in pairs][:1280] + [binary(t, o, 0) for t in pairs for o in ops.binary]
    with working_copy(returned_items(spark, sf)) as lab:
        return search_scores(lab, many[:1920], keep=100)


def main() -> None:
    registry.load_all()
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}

    def timed(name, run):
        t = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - t, 3)

    for name in HEADLINES:
        timed(name, lambda n=name: registry.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save())
    timed("exact_20", lambda: exact_20(spark, sf))
    timed("screen_1920", lambda: screen_1920(spark, sf))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
