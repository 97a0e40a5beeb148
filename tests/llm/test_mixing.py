"""Source mixing: targets, nearness, and the SQL."""

import checker
import pytest
from lucidform.llm import mixing, queries


def test_op8_equals_sql(spark, sf):
    assert checker.compare(queries.QUERIES["op8_mix_sources"](spark, sf), checker.connect(sf), queries.ORACLES["op8_mix_sources"], tol=1e-12) == []


def test_targets_fill_and_reshare():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    many = [(f"s{i:02}", n) for i, n in enumerate([5, 900, 40, 0, 77, 12, 300])] + [(None, 50)]
    got = mixing.targets(many)
    assert sum(got.values()) == pytest.approx(1.5 * sum(n for _, n in many))
    assert all(got[s] <= 2 * n for s, n in many)
    free = [got[s] / w for (s, n), w in zip(many, (5, 2, 1) * 3) if got[s] < 2 * n - 1e-9]
    assert max(free) == pytest.approx(min(free))
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_taken_words_are_near_and_nested(docs_of):
    rows = [(i, "w " * (i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(900)] + [(2000, None, None), (2001, "a\x0bb c\x85d", None), (2001, "a\x0bb c\x85d", None), (None, "five words are in here", "s1"), (2003, "w " * 30_000, "long")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by.setdefault(r["source"], []).append(r)
    assert by[None][0]["source_size"] == 6
    for own in by.values():
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.mix(docs_of(rows, parts=5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mixed(docs_of(rows))
    assert mixed.columns == docs_of(rows).columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs_of(rows).where("false")).collect() == []


def test_rows_without_doc_id_are_drawn_one_by_one(docs_of):
    """Half of the rows have no doc_id, many share one; their words still come near the target."""
    rows = [(None if i % 2 else 5 if i % 4 else i, f"{i} a b c d", "big" if i % 8 else "small") for i in range(3000)]
    got = mixing.mix(docs_of(rows)).collect()
    for source in ("big", "small"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
