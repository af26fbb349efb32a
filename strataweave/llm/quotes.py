"""Chat formatting by quotation linking.

A message's lines carry quote levels (the number of leading ``>``). Runs of lines with one
level are passages. Passages and their lines are normalised (white space, case), hashed, and
joined within their conversation to the earliest earlier message that says the same in its own
words. A message's parent is the original that most of its outermost quotes come from, of
equal ones the latest; without a link, the message of the turn before. The result has each
message's own words, without quotes and the attribution lines above them, its parent, and the thread that
it belongs to: the turn that the thread begins with and how many replies lie between. A parent's
turn is always smaller, so ``root_turn, turn`` orders a conversation by threads and replies.

Only built-in expressions run. Texts aren't shuffled, but for the conversations that quote;
originals are reduced to one row for each conversation and hash before the join, and are
written out first, so that a hash that very many messages quote can be split by the engine.

Null text is an empty message. Messages with a null conv_id or turn link with nothing. Rows
that share conv_id and turn are versions of one message: each is returned, with links of its
own; exact repeats stay repeats. A thread goes through turns: of versions with different parents,
the latest parent counts. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, settle

MARK = r"^(\s*>)+"
HAS_QUOTE = r"(?m)^[ \t]*>"
#: Lines that introduce a quotation.
ATTRIBUTION = r"(?i)^\s*(on .{1,200} wrote|am .{1,200} schrieb.{0,100}|le .{1,200} a écrit ?|el .{1,200} escribió|.{1,100} (wrote|said))\s*:\s*$"


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n")


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARK, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[\s ]+", " ")))


def own_words(text: Column) -> Column:
    """The lines of level 0, without attribution lines right above a quotation, trimmed."""
    quoted = lambda x: F.coalesce(x, F.lit("")).rlike(MARK)
    all_lines = F.col("lines")
    kept = F.filter(all_lines, lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & quoted(F.get(all_lines, i + 1))))
    return F.when(text.rlike(HAS_QUOTE), F.btrim(F.array_join(kept, "\n"), F.lit(" \t\r\n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, level, hash, size): every quoted line and every run of them."""
    marked = (
        messages.filter(F.col("text").rlike(HAS_QUOTE))
        .dropDuplicates(["mid", "conv_id", "turn"])
        .select("mid", "conv_id", "turn", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .withColumn("level", level(F.col("line")))
    )
    by = Window.partitionBy("mid", "conv_id", "turn").orderBy("pos")
    runs = marked.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(by)).cast("int")).withColumn("run", F.sum("new").over(by))
    lines = runs.filter("level > 0").withColumn("said", normalised(F.regexp_replace("line", MARK, ""))).filter("said <> ''")
    whole = lines.groupBy("mid", "conv_id", "turn", "level", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "said"))).alias("s"))
    whole = whole.filter(F.size("s") > 1).select("mid", "conv_id", "turn", "level", F.array_join("s.said", " ").alias("said"))
    both = lines.select("mid", "conv_id", "turn", "level", "said").unionByName(whole)
    return both.select("mid", "conv_id", "turn", "level", F.xxhash64("said").alias("hash"), F.length("said").alias("size"))


def originals(messages: DataFrame, quoting: DataFrame) -> DataFrame:
    """(conv_id, hash, original): the first turn that says it, for conversations that quote."""
    own = messages.join(quoting, "conv_id", "left_semi")
    words = F.col("body")
    units = F.concat(lines_of(words), F.split(words, r"\n\s*\n"), F.array(words))
    said = own.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, normalised))).alias("said")).filter("said <> ''")
    return said.groupBy("conv_id", F.xxhash64("said").alias("hash")).agg(F.min("turn").alias("original"))


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) for (conv_id, turn, parent), by pointer jumping.

    Each round doubles how far a turn looks up; what has reached its root rests. Both sides of the
    join are written tables, so that a turn that very many reply to can be split by the engine.
    """
    root = F.col("parent").isNull()
    found = settle(
        parents.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("rests")),
        "quotes-threads",
    )
    while found.filter("NOT rests").take(1):
        above = found.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"), F.col("rests").alias("top"))
        step = found.filter("NOT rests").join(above, ["conv_id", "up"])
        step = step.select("conv_id", "turn", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("rests"))
        found = settle(found.filter("rests").unionAll(step), "quotes-threads")
    return found.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def link(conversations: DataFrame) -> DataFrame:
    """Every message: conv_id, turn, role, body, n_levels, n_quoted, n_linked, parent_turn, parent_by, root_turn, depth."""
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"mid": F.xxhash64("role", "text"), "lines": lines_of(F.col("text"))})
    rows = rows.withColumn("body", own_words(F.col("text"))).drop("lines")

    quoted = settle(passages(rows).distinct(), "quotes-passages")
    first = settle(originals(rows, quoted.select("conv_id").distinct()), "quotes-originals")
    linked = quoted.join(first, ["conv_id", "hash"]).filter("original < turn")
    votes = linked.groupBy("mid", "conv_id", "turn", "level", "original").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    key = ["mid", "conv_id", "turn"]
    choice = F.struct(-F.col("level"), F.col("size"), F.col("original"))
    parents = votes.groupBy(*key).agg(F.max_by("original", choice).alias("quoted_turn"), F.sum("n").alias("n_linked"))
    levels = quoted.groupBy(*key).agg(F.max("level").alias("n_levels"), F.count(F.lit(1)).alias("n_quoted"))
    about = settle(levels.join(parents, key, "left"), "quotes-about")

    turns = settle(rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct(), "quotes-turns")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    quoting = about.groupBy("conv_id", "turn").agg(F.max("quoted_turn").alias("quoted_turn"), F.count(F.lit(1)).alias("n"))
    plain = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL").join(about.select(*key, "quoted_turn").filter("quoted_turn IS NOT NULL"), key, "left_anti")
    plain = plain.select("conv_id", "turn", F.lit(True).alias("plain")).distinct()
    parent = turns.join(before, ["conv_id", "turn"], "left").join(quoting, ["conv_id", "turn"], "left").join(plain, ["conv_id", "turn"], "left")
    parent = parent.select("conv_id", "turn", F.greatest("quoted_turn", F.when(F.col("plain"), F.col("before"))).alias("parent"))
    thread = threads(parent).join(before, ["conv_id", "turn"], "left")

    joined = rows.drop("text").join(about, key, "left").join(settle(thread, "quotes-thread"), ["conv_id", "turn"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "body",
        zero("n_levels"),
        zero("n_quoted"),
        zero("n_linked"),
        F.coalesce("quoted_turn", "before").alias("parent_turn"),
        F.when(F.col("quoted_turn").isNotNull(), "quote").when(F.col("before").isNotNull(), "turn").alias("parent_by"),
        "root_turn",
        "depth",
    )


def op7_quotes(spark, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "conversations"))
