"""Chat threads from quotations. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import ranked, settle

QUOTED = r"^[ \t]*>"  # a quoted line; each further mark is one level more
MARKS = r"^((?:[ \t]*>)+)"


def level_of(line: Column) -> Column:
    """Quote level of a line: the number of marks before its text."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[ \t]", ""))


def normal(passage: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(passage), r"[ \t\r\n]+", " "))


def own_text(text: Column) -> Column:
    """A text without its quoted lines; null counts as empty."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(QUOTED)), "\n")


def passages(messages: DataFrame) -> DataFrame:
    """(conversation, position, uid, level, hash, size): every line and every run of lines of one level.

    Runs are found inside a message, whose size is that of one cell. Empty passages are left out. ``size``
    is the number of characters of the normalised passage, ``hash`` its MD5.
    """
    lines = messages.select("conversation", "position", "uid", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    lines = lines.select(
        "conversation",
        "position",
        "uid",
        "line",
        level_of(F.col("raw")).alias("level"),
        F.regexp_replace("raw", MARKS, "").alias("raw"),
    )
    order = Window.partitionBy("uid").orderBy("line")
    changed = F.coalesce(F.col("level") != F.lag("level").over(order), F.lit(True)).cast("int")
    run = F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("changed", changed).withColumn("run", run)
    whole = lines.groupBy("conversation", "position", "uid", "run", "level").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), " "
        ).alias("raw")
    )
    columns = ["conversation", "position", "uid", "level", "raw"]
    both = lines.select(columns).unionByName(whole.select(columns)).withColumn("passage", normal(F.col("raw")))
    return both.where(F.col("passage") != "").select(
        *columns[:-1], F.md5("passage").alias("hash"), F.length("passage").cast("long").alias("size")
    )


def originals(found: DataFrame) -> DataFrame:
    """(uid, to): the position of the message that each quoting message answers.

    The original of a passage is the first message of the conversation that says it itself. Per message
    the outermost level with an original decides, then the longest passage, then the latest original.
    A passage has one original, however often it is said or quoted, so no hash multiplies rows.
    """
    said = found.where("level = 0").groupBy("conversation", "hash").agg(F.min("position").alias("to"))
    said = settle(said, "said")
    quoted = found.where("level > 0").join(said, ["conversation", "hash"]).where("to < position")
    best = F.max(F.struct(-F.col("level"), "size", "to")).alias("best")
    return quoted.groupBy("uid").agg(best).select("uid", F.col("best.to").alias("to"))


def reply_order(messages: DataFrame) -> DataFrame:
    """Add ``reply_order`` (from 0): each message before its replies, replies in order, depth first.

    ``messages`` has (conversation, position, to): ``to`` is the position answered, null at the start.
    Messages that answer the one before form runs. A run is shown whole; then come the runs that answer its
    messages, those of the last message first. So a run is sorted by the places at which it and the runs
    above it branch off. These paths are joined by doubling, in as many rounds as the logarithm of the depth.
    """
    opens = (F.coalesce(F.col("to") != F.col("position") - 1, F.lit(True))).cast("long")
    runs = settle(
        ranked(messages.withColumn("opens", opens), ["conversation"], ["position"], ("opens",)).withColumn(
            "run", F.col("before_opens") + F.col("opens")
        ).drop("rank", "before_opens"),
        "runs",
    )
    heads = runs.where("opens = 1").select("conversation", "run", F.col("position").alias("head"), "to")
    above = runs.select("conversation", F.col("position").alias("to"), F.col("run").alias("above"))
    step = F.concat(
        F.lpad(F.hex(F.lit((1 << 60)) - F.coalesce("to", F.lit(0))), 16, "0"), F.lpad(F.hex("head"), 16, "0")
    )
    paths = heads.join(above, ["conversation", "to"], "left").select("conversation", "run", "above", step.alias("path"))
    paths = settle(paths, "paths")
    while not paths.where("above is not null").isEmpty():
        upper = paths.select(
            "conversation", F.col("run").alias("above"), F.col("above").alias("next"), F.col("path").alias("upper")
        )
        paths = paths.join(upper, ["conversation", "above"], "left").select(
            "conversation", "run", F.col("next").alias("above"), F.concat(F.coalesce("upper", F.lit("")), "path").alias("path")
        )
        paths = settle(paths, "paths")
    placed = runs.join(paths.select("conversation", "run", "path"), ["conversation", "run"])
    placed = ranked(placed.drop("run", "opens"), ["conversation"], ["path", "position"])
    return placed.drop("path").withColumnRenamed("rank", "reply_order")


def link_quotations(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per row of ``df``: conversation, turn, role, reply_to, by_quote, reply_order, body, chat.

    Within a conversation, messages stand in order of turn (nulls last, repeated turns in any fixed order).
    A message answers the original of what it quotes, else the message before it; ``reply_to`` is that
    message's turn, ``by_quote`` tells which. ``body`` is the text without quoted lines, ``chat`` the role
    and body as one chat entry; a conversation is its rows in ``reply_order``. Null texts count as empty,
    null roles as "user" in ``chat``; a row without a conversation is one of its own. Other columns are
    not read.
    """
    uid = F.monotonically_increasing_id()
    rows = df.select(
        F.col(conversation).alias("c"),
        F.col(turn).alias("t"),
        F.col(role).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        uid.alias("uid"),
    )
    own = F.coalesce(F.concat(F.lit("c"), F.col("c").cast("string")), F.concat(F.lit("u"), F.col("uid").cast("string")))
    rows = settle(rows.withColumn("conversation", own), "messages")
    placed = ranked(rows.select("conversation", "t", "uid"), ["conversation"], ["t", "uid"])
    placed = settle(placed.withColumnRenamed("rank", "position"), "positions")
    messages = rows.select("uid", "text").join(placed.select("conversation", "position", "uid"), "uid")
    found = settle(passages(messages), "passages")
    linked = placed.join(settle(originals(found), "originals"), "uid", "left")
    before = F.when(F.col("position") > 0, F.col("position") - 1)
    linked = settle(
        linked.select(
            "conversation",
            "uid",
            "position",
            F.col("to").isNotNull().alias("by_quote"),
            F.coalesce("to", before).alias("to"),
        ),
        "linked",
    )
    ordered = settle(reply_order(linked.select("conversation", "uid", "position", "to", "by_quote")), "ordered")
    said = placed.select("conversation", F.col("position").alias("to"), F.col("t").alias("reply_to"))
    ordered = ordered.join(said, ["conversation", "to"], "left").select("uid", "by_quote", "reply_order", "reply_to")
    body = own_text(F.col("text"))
    chat = F.concat(F.lit("<|"), F.coalesce("r", F.lit("user")), F.lit("|>\n"), body, F.lit("\n"))
    return rows.join(ordered, "uid").select(
        F.col("c").alias(conversation),
        F.col("t").alias(turn),
        F.col("r").alias(role),
        "reply_to",
        "by_quote",
        "reply_order",
        body.alias("body"),
        chat.alias("chat"),
    )
