"""Quotation linking with DataFrame operations only.

A line's quote level is the number of ``>`` marks in front of it. Neighbouring
lines of one level are a passage. Normalised passages, their paragraphs (parted by
blank lines) and their single lines are hashed; a quoted passage links to the
earliest message of its conversation that says all of it in its own words, before
the quoting message, or else says a paragraph or a line of it: of several such
messages the one that says most of its lines, then the earliest. A message replies to the message its least deeply
quoted linked passage comes from (of several the latest). Threads are the trees of
replies; conversations are ordered by thread and turn, so that a reply comes after
what it answers, and lose their quotes.

Defined cases: a null text has no passages and stays null; lines without words
belong to no passage hash; quotes that nobody said link to nothing; repeated rows
of a turn each keep a row and read as one message where others quote them; a null
conversation is a conversation, a null turn comes first; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phenoweave.session import durable

# Fixed value: quote marks may be spaced.
QUOTE = r"^(?:[ \t]*>)+"
NO_KEY = -(1 << 63)


def _normal(text):
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, level, passage, normal, lines, parts) of each passage, numbered in order.

    ``parts`` are the (normal, lines) of its paragraphs and lines that have words.
    Long texts are worked on as arrays of lines within their row.
    """
    line = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, QUOTE, 0), "[^>]", "")).alias("level"),
        F.regexp_replace(F.regexp_replace(x, QUOTE, ""), "^ ", "").alias("words"),
    )
    split = conversations.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(NO_KEY)).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_KEY)).alias("turn"),
        F.transform(F.split(F.col(text), "\n"), line).alias("lines"),
    )
    # A passage starts where the level changes: neighbours are folded into runs.
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: (i == 1) | (F.element_at("lines", i)["level"] != F.get("lines", i - 2)["level"]))
    cut = split.filter("lines is not null").withColumn("starts", starts)
    run = lambda i, k: F.struct(
        F.element_at("lines", i)["level"].alias("level"),
        F.slice("lines", i, F.coalesce(F.get("starts", k + 1), F.size("lines") + 1) - i).alias("lines"),
    )
    rows = cut.select("conv", "turn", F.posexplode(F.transform("starts", run)).alias("passage", "run"))
    said = rows.select("conv", "turn", F.col("run.level").alias("level"), "passage", F.transform("run.lines", lambda x: x["words"]).alias("said"))
    part = lambda normal, lines: F.struct(normal.alias("normal"), lines.alias("lines"))
    worded = lambda x: F.size(F.filter(F.split(x, "\n"), lambda y: _normal(y) != ""))
    paragraphs = F.transform(F.split(F.array_join("said", "\n"), r"\n(?:[ \t\r]*\n)+"), lambda x: part(_normal(x), worded(x)))
    single = F.transform("said", lambda x: part(_normal(x), F.lit(1)))
    return said.select(
        "conv", "turn", "level", "passage", _normal(F.array_join("said", " ")).alias("normal"), F.size("said").alias("lines"),
        F.filter(F.concat(paragraphs, single), lambda x: x["normal"] != "").alias("parts"),
    )


def own_paragraphs(conversations: DataFrame, conv: str, turn: str, text: str) -> DataFrame:
    """(conv, hash, source): the earliest turn that says a passage, a paragraph or a single line of it unquoted."""
    every = passages(conversations, conv, turn, text).filter("level = 0 and normal <> ''")
    said = every.select("conv", "turn", F.explode(F.array_union(F.array("normal"), F.transform("parts", lambda x: x["normal"]))).alias("normal"))
    return said.groupBy("conv", F.sha2("normal", 256).alias("hash")).agg(F.min("turn").alias("source"))


def without_quotes(text):
    """The text's lines without a quote mark."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(QUOTE)), "\n")


def link_quotations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, n_quotes, n_linked, reply_to) of each message with quotes."""
    quoted = passages(conversations, conv, turn, text).filter("level > 0 and normal <> ''")
    # Equal passages of a turn are one row that counts ``n`` times, whatever their line breaks.
    counted = durable(
        quoted.groupBy("conv", "turn", F.sha2("normal", 256).alias("whole")).agg(F.min("level").alias("level"), F.count("*").alias("n"), F.max("parts").alias("parts")), "quoted"
    )
    pieces = counted.select("conv", "turn", "whole", F.col("whole").alias("hash"), F.lit(None).cast("int").alias("lines")).unionByName(
        counted.select("conv", "turn", "whole", F.explode("parts").alias("part")).select("conv", "turn", "whole", F.sha2("part.normal", 256).alias("hash"), F.col("part.lines").alias("lines"))
    )
    found = pieces.join(own_paragraphs(conversations, conv, turn, text), ["conv", "hash"]).filter("source < turn")
    votes = found.groupBy("conv", "turn", "whole", "source").agg(F.max(F.col("lines").isNull()).alias("all"), F.sum("lines").alias("lines"))
    sources = votes.groupBy("conv", "turn", "whole").agg(F.max(F.struct("all", "lines", (-F.col("source")).alias("back"))).alias("said")).select(
        "conv", "turn", "whole", (-F.col("said.back")).alias("source")
    )
    linked = counted.drop("parts").join(sources, ["conv", "turn", "whole"], "left")
    # The smallest (level, -source) among linked passages is the message answered.
    best = F.min(F.when(F.col("source").isNotNull(), F.struct("level", (-F.col("source")).alias("back"))))
    return linked.groupBy("conv", "turn").agg(
        F.sum("n").alias("n_quotes"), F.sum(F.when(F.col("source").isNotNull(), F.col("n")).otherwise(0)).alias("n_linked"), best.alias("best")
    ).select("conv", "turn", "n_quotes", "n_linked", (-F.col("best.back")).alias("reply_to"))


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of (conv, turn, reply_to) rows, by doubling the way up; ends when no way grows."""
    current = durable(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "reply-ways")
    while True:
        up = current.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = durable(
            current.join(up, ["conv", "root"], "left").select(
                "conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")
            ),
            "reply-ways",
        )
        if step.filter("moved").isEmpty():
            return step.drop("moved")
        current = step.drop("moved")


def reply_ordered(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, thread, turn, depth, reply_to, role, text, n_quotes, n_linked), sorted by conversation, thread and turn.

    ``thread`` is the turn of the first message of the tree of replies; ``text`` has no quoted lines.
    """
    links = durable(link_quotations(conversations, conv, turn, text), "quotations")
    roots = thread_roots(links.filter("reply_to is not null").select("conv", "turn", "reply_to"))
    about = links.join(roots, ["conv", "turn"], "left")
    rows = conversations.select(
        F.coalesce(F.col(conv).cast("long"), F.lit(NO_KEY)).alias("conv"), F.coalesce(F.col(turn).cast("long"), F.lit(NO_KEY)).alias("turn"),
        F.col(role).alias("role"), without_quotes(F.col(text)).alias("text"),
    )
    real = lambda c: F.when(c != NO_KEY, c)
    joined = rows.join(about, ["conv", "turn"], "left").select(
        real(F.col("conv")).alias("conv_id"), real(F.coalesce("root", "turn")).alias("thread"), real(F.col("turn")).alias("turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), real(F.col("reply_to")).alias("reply_to"), "role", "text",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    return joined.orderBy("conv_id", "thread", "turn", "role", F.xxhash64("text"))
