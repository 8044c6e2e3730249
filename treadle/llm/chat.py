"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of `>` marks that it begins with. Lines of one level that follow one another without a blank
one make a passage; passages and their single lines are normalised (outer spaces, runs of white space, lower case) and
hashed. A quoted hash belongs to the latest earlier message of the conversation that has it among its own, unquoted
passages and lines. A message replies to the message that most of its quoted text at the outermost linked level
comes from (ties: the later one); without a link it replies to the message before it. Quotes, and lines that announce
one ("... wrote:"), leave the text.

Reply order: a message that replies to another one than the message before it starts a branch, numbered by its turn;
others carry on the branch they are in. By (branch, position) every message follows the one it replies to, and each
branch is a conversation that continues another from its first message's reply_to.

"Latest earlier" and positions come from running maxima and counts over blocks of SPAN turns and then over the
blocks, so a conversation, or a passage in it, that holds a third of all rows isn't gathered in one task, and no pairs of
equal passages are made.

A null text is an empty message; a null role is written as `unknown`. Rows with a null conversation or turn keep
their own text, without links, branch or position. Rows that repeat a turn share links; positions order them by role and text. Texts
may be of any length; further columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadle.llm.common import let

SPAN = 1024
MARK = r"^([ \t]*>)+"
ANNOUNCES = r"(wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t]*$"


def parsed_lines(text: Column) -> Column:
    """An array of (level, raw, norm) of a text's lines; ``norm`` is the normalised text after the marks."""
    def line(x: Column) -> Column:
        mark = F.regexp_substr(x, F.lit(MARK))
        level = F.coalesce(F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit(""))), F.lit(0))
        rest = F.when(mark.isNull(), x).otherwise(F.substring(x, F.length(mark) + 1, F.length(x)))
        return F.struct(level.alias("level"), x.alias("raw"), F.lower(F.trim(F.regexp_replace(rest, r"\s+", " "))).alias("norm"))

    def told(a: Column) -> Column:  # a line that announces the quote below it counts as quoted by no one: level -1
        return F.transform(
            a,
            lambda x, k: F.struct(
                F.when((x["level"] == 0) & F.coalesce(F.get(a, k + 1)["level"] > 0, F.lit(False)) & x["raw"].rlike(ANNOUNCES), F.lit(-1)).otherwise(x["level"]).alias("level"),
                x["raw"].alias("raw"),
                x["norm"].alias("norm"),
            ),
        )

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), line), told)


def units(lines: Column) -> Column:
    """(level, norm) of every passage and every line with text, of levels 0 and up."""

    def found(a: Column) -> Column:
        text = lambda k: (F.get(a, k)["norm"] != "") & (F.get(a, k)["level"] >= 0)
        joins = lambda k, other: F.coalesce((F.get(a, other)["norm"] != "") & (F.get(a, other)["level"] == F.get(a, k)["level"]), F.lit(False))
        places = F.sequence(F.lit(0), F.size(a) - 1)
        starts = F.filter(places, lambda k: text(k) & ~((k > 0) & joins(k, k - 1)))
        stops = F.filter(places, lambda k: text(k) & ~joins(k, k + 1))
        whole = lambda x, y: F.array_join(F.transform(F.slice(a, x + 1, y - x + 1), lambda line: line["norm"]), " ")
        passages = F.zip_with(starts, stops, lambda x, y: F.struct(F.get(a, x)["level"].alias("level"), whole(x, y).alias("norm")))
        single = F.transform(F.filter(a, lambda x: (x["norm"] != "") & (x["level"] >= 0)), lambda x: F.struct(x["level"].alias("level"), x["norm"].alias("norm")))
        return F.array_distinct(F.concat(passages, single))

    return let(lines, found)


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, before: bool) -> DataFrame:
    """``out``: the greatest ``value`` of rows with the same keys and a smaller (or, unless ``before``, equal) ``order``."""
    df = df.withColumn("_block", F.floor(F.col(order) / SPAN))
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if before else 0)
    blocks = df.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carried", F.max("_top").over(earlier)).drop("_top")
    df = df.withColumn("_inside", F.max(value).over(inside)).join(blocks, [*keys, "_block"], "left")
    return df.withColumn(out, F.greatest("_inside", "_carried")).drop("_block", "_inside", "_carried")


def positions(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``out``: the row's place among rows with the same keys, from 0; the first of ``order`` is a number."""
    df = df.withColumn("_block", F.floor(F.col(order[0]) / SPAN))
    blocks = df.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    df = df.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))).join(blocks, [*keys, "_block"], "left")
    return df.withColumn(out, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_block", "_own", "_before")


def quote_links(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original, chars): for each message and level, the earlier messages quoted and how much of each."""
    rows = parsed.select("conv_id", "turn", F.explode("units").alias("u")).select(
        "conv_id", "turn", F.col("u.level").alias("level"), F.xxhash64("u.norm").alias("h1"), F.xxhash64(F.lit("second"), "u.norm").alias("h2"), F.length("u.norm").alias("chars")
    ).distinct()
    rows = rows.withColumn("source", F.when(F.col("level") == 0, F.col("turn")))
    found = running_max(rows, ["conv_id", "h1", "h2"], "turn", "source", "original", before=True)
    return found.where("level > 0 and original is not null").groupBy("conv_id", "turn", "level", "original").agg(F.sum("chars").alias("chars"))


def chat_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, content, quote_depth, reply_to, linked, branch, position, formatted), one row per message."""
    rows = messages.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("lines", parsed_lines(F.col("text")))
    content = F.trim(F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["raw"]), "\n"))
    content = F.regexp_replace(content, r"^\n+|\n+$", "")
    depth = F.greatest(F.lit(0), F.array_max(F.transform("lines", lambda x: x["level"])))
    plain = rows.select("conv_id", "turn", "role", content.alias("content"), depth.alias("quote_depth"))
    whole = rows.where("conv_id is not null and turn is not null")
    quoted = whole.select("conv_id", "turn", units(F.col("lines")).alias("units"))
    links = quote_links(quoted).groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "chars", "original")).alias("best")).select("conv_id", "turn", F.col("best.original").alias("linked"))
    turns = running_max(whole.select("conv_id", "turn").distinct().withColumn("own", F.col("turn")), ["conv_id"], "turn", "own", "previous", before=True).drop("own")
    turns = turns.join(links, ["conv_id", "turn"], "left")
    starts = F.col("previous").isNull() | (F.col("linked") != F.col("previous"))
    turns = running_max(turns.withColumn("start", F.when(starts, F.col("turn"))), ["conv_id"], "turn", "start", "branch", before=False)
    turns = turns.select("conv_id", "turn", F.coalesce("linked", "previous").alias("reply_to"), F.col("linked").isNotNull().alias("linked"), "branch")
    out = positions(plain.where("conv_id is not null and turn is not null").join(turns, ["conv_id", "turn"]), ["conv_id", "branch"], ["turn", "role", "content"], "position")
    apart = plain.where("conv_id is null or turn is null").select("*", F.lit(None).cast("long").alias("reply_to"), F.lit(False).alias("linked"), F.lit(None).cast("long").alias("branch"), F.lit(None).cast("long").alias("position"))
    columns = ["conv_id", "turn", "role", "content", "quote_depth", "reply_to", "linked", "branch", "position"]
    formatted = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("\n<|end|>")).alias("formatted")
    return out.select(*columns).unionByName(apart.select(*columns)).select(*columns, formatted)
