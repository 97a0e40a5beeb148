"""Quotation linking against a plain walk over small conversations."""

from lucidform.llm import queries, quotes

TALK = [
    (1, 0, "user", "Hello all.\nThis is the first message,\nwrapped in lines.\n\nSecond paragraph here."),
    (1, 1, "assistant", "> Second   paragraph\n> HERE.\nI agree with that."),
    (1, 2, "user", "A new topic without quotes."),
    (1, 3, "user", "On Monday Ann wrote:\n> > second paragraph here.\n> I agree with that.\n\nMe too."),
    (1, 4, "user", "> never said anywhere\nWho said so?"),
    (1, 5, "user", ">A new topic without quotes.\nLate answer.\n>> Hello all.\nend"),
    (1, 6, "user", "> Me too.\nok"),
    (2, 0, "user", "> I agree with that.\nquote of another conversation"),
    (2, 1, "user", None),
    (2, 2, "user", ""),
    (None, 5, "user", "> Hello all.\nx"),
    (2, None, "user", "5 > 3"),
]


def talk(spark, rows=TALK):
    return spark.createDataFrame([(*r, "x", 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, lines string, root int").repartition(3)


def test_links_order_and_text(spark):
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(talk(spark)).collect()}
    assert len(got) == len(TALK)
    told = {k: (r["parent"], r["root"], r["depth"], r["n_quoted"], r["n_linked"]) for k, r in got.items()}
    assert told == {
        (1, 0): (None, 0, 0, 0, 0), (1, 1): (0, 0, 1, 1, 1), (1, 2): (None, 2, 0, 0, 0), (1, 3): (1, 0, 2, 2, 2), (1, 4): (None, 4, 0, 1, 0),
        (1, 5): (2, 2, 1, 2, 2), (1, 6): (3, 0, 3, 1, 1), (2, 0): (None, 0, 0, 1, 0), (2, 1): (None, 1, 0, 0, 0), (2, 2): (None, 2, 0, 0, 0),
        (None, 5): (None, 5, 0, 0, 0), (2, None): (None, None, 0, 0, 0),
    }
    assert got[1, 1]["text"] == "I agree with that." and got[1, 3]["text"] == "\nMe too." and got[1, 5]["text"] == "Late answer.\nend"
    assert got[2, 1]["text"] is None and got[2, 2]["text"] == "" and got[2, None]["text"] == "5 > 3"
    order = [r["turn"] for r in quotes.conversations(talk(spark)).where("conv_id = 1").orderBy("root", "depth", "turn").collect()]
    assert order == [0, 1, 3, 6, 2, 5, 4]


def test_deep_thread_repeated_rows_and_empty(spark):
    rows = [(7, 0, "user", "message 0")] + [(7, i, "user", f"> message {i - 1}\nmessage {i}") for i in range(1, 40)]
    got = quotes.conversations(talk(spark, rows + rows[:3])).collect()
    assert len(got) == 43 and all(r["root"] == 0 and r["depth"] == r["turn"] and (r["parent"] or 0) == max(0, r["turn"] - 1) for r in got)
    assert quotes.conversations(talk(spark, rows).where("false")).collect() == []


def test_op2_keeps_every_message(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    got = queries.QUERIES["op2_quotation_linking"](spark, sf)
    assert got.count() == table.count()
    quoting = table.where("text rlike '(?m)^[ \\t]*>'").count()
    assert got.where("n_quoted > 0").count() == quoting
    assert got.join(table.where("NOT text rlike '(?m)^[ \\t]*>'"), ["conv_id", "turn", "role", "text"], "left_semi").count() == table.count() - quoting


def test_no_python_in_the_plan(spark, sf):
    plan = queries.QUERIES["op2_quotation_linking"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_trimmed_and_nested_announced_quotes(spark):
    rows = [
        (3, 0, "user", "First part, line one.\nFirst part, line two.\nFirst part, line three.\n\nSecond part.\n\nThird part."),
        (3, 1, "user", "Second part.\nsomething else"),
        (3, 2, "user", "> First part, line one.\n> First part, line two.\n> First part, line three.\n>\n> Second part.\nTwo of three paragraphs."),
        (3, 3, "user", "> First part, line two.\n> First part, line three.\nTwo of three lines."),
        (3, 4, "user", "I agree.\nIt is so.\nOn Monday Ann wrote:\n> Third part.\nYes."),
        (3, 5, "user", "On Tuesday Bob wrote:\n> I agree.\n> It is so.\n> On Monday Ann wrote:\n>> Third part.\n> Yes.\nFine."),
        (3, 6, "user", "> On Monday Ann wrote:\n>> Third part.\nOnly the inner one."),
        (3, 7, "user", "> not said\n> nor this\nNothing found."),
    ]
    got = {r["turn"]: (r["parent"], r["root"], r["n_quoted"], r["n_linked"]) for r in quotes.conversations(talk(spark, rows)).collect()}
    assert got == {0: (None, 0, 0, 0), 1: (None, 1, 0, 0), 2: (0, 0, 1, 1), 3: (0, 0, 1, 1), 4: (0, 0, 1, 1), 5: (4, 0, 3, 3), 6: (None, 6, 1, 1), 7: (None, 7, 1, 0)}
    texts = {r["turn"]: r["text"] for r in quotes.conversations(talk(spark, rows)).collect()}
    assert texts[5] == "Fine." and texts[4] == "I agree.\nIt is so.\nYes."
