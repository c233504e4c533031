"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it as context, and only its text
trainable. Turns behind the last assistant turn make one more example, without a trainable part, so that
the examples of a conversation hold all of it.

A turn is written between two control strings, by its role:

    user       [INST]text[/INST]
    system     [SYS]text[/SYS]
    assistant  <s>text</s>
    other      [ROLE]role[/ROLE]text[/TURN]

Where a text has a control string, or one with backslashes behind its first character, one backslash more
goes there. So no text can end a turn, and taking one away gives the text back.

An example repeats its context, so a conversation's output grows with the square of its turns. That is the
method. A conversation is one row while its turns are put in order; the examples of a long one are then dealt to as
many tasks as their characters need. A conversation whose square can be written at all is no large row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Characters of the examples of one conversation that one task writes.
BLOCK_CHARS = 20_000_000
#: Long conversations of which the ids are broadcast; more are joined.
MOST_LONG = 100_000
_BODY = r"(/?(?:s>|INST\]|SYS\]|ROLE\]|TURN\]))"
_TURN = r"(?s)\[INST\].*?\[/INST\]|\[SYS\].*?\[/SYS\]|<s>.*?</s>|\[ROLE\].*?\[/TURN\]"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("<s>", "</s>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _BODY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _BODY, r"$1$2$3")


def _written(role: Column, text: Column) -> Column:
    out = F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), escape(text), F.lit("[/TURN]"))
    for name, (begin, end) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(begin), escape(text), F.lit(end))).otherwise(out)
    return out


def examples(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv, position, text, loss_start, loss_end, trainable) for each example.

    position counts a conversation's turns from 1; it is that of the last turn in the example. The characters
    (code points) from loss_start to before loss_end of text are trainable. Turns are ordered by turn, null
    first, equal ones by role and text; repeated rows are turns of their own. Null roles and texts count as
    empty; a null conversation id is an id like others; other columns are not read.
    """
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    chars = F.sum(F.length(row["role"]) + F.length(row["text"]) + 32).cast("double")
    blocks = F.greatest(F.lit(1), F.ceil(chars * F.count("*") / BLOCK_CHARS).cast("int")).alias("blocks")
    by_conv = turns.groupBy(F.col(conv_col).alias("conv"))
    in_order = F.sort_array(F.collect_list(row)).alias("turns")
    many = checkpointed(by_conv.agg(blocks).filter("blocks > 1").select(F.col("conv").alias(fresh(turns.columns, "long_conv")), "blocks"))
    if not (count := many.count()):
        whole = by_conv.agg(in_order).select("conv", "turns", F.lit(1).alias("blocks"), F.lit(0).alias("block"))
    else:
        many = F.broadcast(many) if count <= MOST_LONG else many
        same = F.col(conv_col).eqNullSafe(F.col(many.columns[0]))
        short = turns.join(many, same, "left_anti").groupBy(F.col(conv_col).alias("conv")).agg(in_order)
        long = turns.join(many, same, "left_semi").groupBy(F.col(conv_col).alias("conv")).agg(in_order)
        long = long.join(many, F.col("conv").eqNullSafe(F.col(many.columns[0]))).select("conv", "turns", "blocks")
        long = long.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        # a given number of partitions: AQE would join them by what they read, and they write far more
        long = long.repartition(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv", "block")
        whole = short.select("conv", "turns", F.lit(1).alias("blocks"), F.lit(0).alias("block")).union(long)
    written = whole.select(
        "conv",
        "blocks",
        "block",
        F.transform("turns", lambda t: _written(t["role"], t["text"])).alias("written"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
    )
    last = F.size("written")
    positions = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.element_at("replies", i))
    positions = F.filter(positions, lambda _, nth: nth % F.col("blocks") == F.col("block"))
    each = written.select("conv", "written", "replies", F.explode(positions).alias("position"))
    begin, end = MARKS["assistant"]
    texts = each.select(
        "conv",
        "position",
        F.array_join(F.slice("written", F.lit(1), F.col("position")), "").alias("text"),
        F.length(F.element_at("written", F.col("position"))).alias("length"),
        F.element_at("replies", F.col("position")).alias("trainable"),
    )
    whole_length = F.length("text")
    return texts.select(
        "conv",
        "position",
        "text",
        F.when(F.col("trainable"), whole_length - F.col("length") + len(begin)).otherwise(whole_length).alias("loss_start"),
        F.when(F.col("trainable"), whole_length - len(end)).otherwise(whole_length).alias("loss_end"),
        "trainable",
    )


def read_turns(text: Column) -> Column:
    """The turns of an example, as an array of (role, text)."""

    def read(x: Column) -> Column:
        role = F.regexp_extract(x, r"(?s)\A\[ROLE\](.*?)\[/ROLE\]", 1)
        other = F.regexp_extract(x, r"(?s)\A\[ROLE\].*?\[/ROLE\](.*)\[/TURN\]\z", 1)
        out = F.struct(unescape(role).alias("role"), unescape(other).alias("text"))
        for name, (begin, end) in MARKS.items():
            body = F.substring(x, F.lit(len(begin) + 1), F.length(x) - len(begin) - len(end))
            out = F.when(x.startswith(begin), F.struct(F.lit(name).alias("role"), unescape(body).alias("text"))).otherwise(out)
        return out

    return F.transform(F.regexp_extract_all(text, F.lit(_TURN), F.lit(0)), read)


def digests(made: DataFrame) -> DataFrame:
    """Of examples: what a conversation's texts say when they are read back.

    All turns come from the longest example of a conversation, the trainable texts from the loss spans of all.
    """
    loss = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = made.groupBy("conv").agg(
        F.max_by("text", "position").alias("text"),
        F.sort_array(F.collect_list(F.when(F.col("trainable"), F.struct("position", loss.alias("loss"))))).alias("losses"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = read_turns(F.col("text"))
    spoken = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
