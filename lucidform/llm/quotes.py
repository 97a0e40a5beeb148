"""Quotation linking: quoted passages are joined to the messages they come from, and conversations are put in reply
order without quotes.  DataFrame functions only.

A line's quote level is the number of ``>`` it opens with.  Consecutive lines of one level are a passage; lines that
announce a deeper quote aren't part of it.  Quoted passages, whole messages and their unquoted passages, each with its
paragraphs and lines, are hashed after lower-casing and joining words by one space, so re-wrapped quotes meet their
origin.  A passage comes from the latest earlier message that holds the largest of its units that any holds, so a
trimmed quote is linked by what is left of it.  A message replies to the latest earlier message of its conversation
that one of its first-level passages comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lucidform.llm.common import cut, few_ids

MARKS = r"^(?:[ \t]*>)+"
#: A line that announces a quote and goes with it.
ANNOUNCES = r"(?i)^.{0,200}\b(wrote|schrieb|escribió|a écrit)\s*:\s*$"


def parsed(text: Column) -> Column:
    """array<struct<level, body>> of the lines."""
    line = lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS + " ?", "").alias("body"))
    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), line)


def normal(text: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def digest(text: Column) -> Column:
    return F.md5(normal(text))


def announcing(lines: str, i: str) -> str:
    """SQL: whether line i announces the deeper quote after it."""
    pattern = ANNOUNCES.replace(chr(92), chr(92) * 2)
    return f"(coalesce(get({lines}, {i} + 1).level, 0) > {lines}[{i}].level AND {lines}[{i}].body RLIKE '{pattern}')"


def passages(lines: str) -> Column:
    """array<struct<level, bodies>>: runs of lines of one level, without those that announce a quote."""
    return F.expr(f"""
        transform(
          filter(sequence(0, size({lines}) - 1), i -> i = 0 OR {lines}[i].level <> get({lines}, i - 1).level),
          s -> named_struct('level', {lines}[s].level, 'bodies', transform(
            filter(
              sequence(s, coalesce(get(filter(sequence(s, size({lines}) - 1), j -> {lines}[j].level <> {lines}[s].level), 0), size({lines})) - 1),
              j -> NOT {announcing(lines, 'j')}),
            j -> {lines}[j].body)))
    """)


def own_lines(lines: str) -> Column:
    """The unquoted lines, without those that announce a quote."""
    kept = f"filter({lines}, (x, i) -> x.level = 0 AND NOT {announcing(lines, 'i')})"
    return F.expr(f"array_join(transform({kept}, x -> x.body), '\\n')")


def units(text: str | Column) -> Column:
    """The whole text, its paragraphs and its lines."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n")))


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, quoted, origin): each quoted passage of a message, and the turn it comes from or null."""
    parts = messages.where(F.col("text").rlike("(?m)" + MARKS) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("lines", parsed("text")).select("conv_id", "turn", F.explode(passages("lines")).alias("p"))
    quoting = cut(parts.where("p.level > 0 AND size(p.bodies) > 0").select("conv_id", "turn", "p.level", F.array_join("p.bodies", "\n").alias("quoted")).distinct(), "quoted")
    unit = normal(F.col("unit"))
    asked = quoting.withColumn("unit", F.explode(units("quoted"))).where(unit != "").withColumn("digest", digest(F.col("unit"))).withColumn("size", F.length(unit)).drop("unit")
    where = cut(quoting.select("conv_id").distinct(), "quoting")
    origins = messages.join(few_ids(where), "conv_id", "left_semi").where("turn IS NOT NULL").withColumn("lines", parsed("text")).withColumn("own", own_lines("lines"))
    runs = F.transform(F.filter(passages("lines"), lambda p: p["level"] == 0), lambda p: units(F.array_join(p["bodies"], "\n")))
    origins = origins.select("conv_id", F.col("turn").alias("origin"), F.explode(F.array_union(units("own"), F.flatten(runs))).alias("unit")).select("conv_id", "origin", digest(F.col("unit")).alias("digest")).distinct()
    wanted = asked.select("conv_id", "turn", "digest").distinct()
    both = wanted.withColumn("origin", F.lit(None).cast("bigint")).unionByName(origins.withColumn("turn", F.col("origin")))
    before = Window.partitionBy("conv_id", "digest").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)  # a common line would make pairs
    latest = both.withColumn("latest", F.max("origin").over(before)).where("origin IS NULL AND latest IS NOT NULL").select("conv_id", "turn", "digest", "latest")
    best = F.max(F.struct("size", "latest"))["latest"]
    found = asked.join(latest, ["conv_id", "turn", "digest"]).groupBy("conv_id", "turn", "level", "quoted").agg(best.alias("origin"))
    return quoting.join(found, ["conv_id", "turn", "level", "quoted"], "left")


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of replies (conv_id, turn, parent), by doubling the way walked in each round."""
    now = parents.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    while True:
        above = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        walked = now.join(above, ["conv_id", "root"], "left")
        now = cut(walked.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent, root, depth, n_quoted, n_linked, text) for every message.

    Sorted by (conv_id, root, depth, turn) a conversation is in reply order: each reply follows what it answers.
    ``parent`` is the answered turn or null, ``root`` the turn its thread starts with (its own if it answers none),
    ``text`` the message without quotes.  Null text stays null and quotes nothing; rows without conv_id or turn link
    with nothing; rows that repeat a turn are all kept and treated alike.  Other columns are ignored.
    """
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    links = cut(linked(rows), "quote-links")
    told = links.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quoted"), F.count("origin").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent"))
    told = cut(told, "replies")
    replies = told.where("parent IS NOT NULL")
    placed = told if replies.isEmpty() else told.join(threads(replies), ["conv_id", "turn"], "left")
    if "root" not in placed.columns:
        placed = placed.withColumn("root", F.lit(None).cast("bigint")).withColumn("depth", F.lit(None).cast("int"))
    placed = cut(placed, "placed")
    clean = F.when(F.col("text").rlike("(?m)" + MARKS), own_lines("lines")).otherwise(F.col("text"))
    out = rows.withColumn("lines", F.when(F.col("text").rlike("(?m)" + MARKS), parsed("text"))).withColumn("text", clean)
    out = out.join(placed, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text")
