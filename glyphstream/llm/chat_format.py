"""Chat formatting with Spark expressions only.

A conversation becomes one string: each run of turns of one role is a block

    <|start|>ROLE<|text|>TEXT<|turn|>TEXT...<|end|>

Roles and texts are escaped: a backslash becomes two, and one is put after the
first character of every control string, of this template and of common others.

A conversation's turns are sorted as collected structs, adjacent turns of one
role are merged by collecting them once more, and running sums over the turns
tell where each text stands: the work is linear in the number of turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>"
#: Strings that are broken up inside texts (fixed values); the first two cover the template's own.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once; inside a lambda, a plain column would be worked out for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, and loss_spans: where the texts of loss_role stand in it.

    turns has conv_id, turn, role and text.  Spans are (start, length) in bytes
    of the UTF-8 string, over escaped text.  Null roles and texts count as
    empty.  Rows of one turn number are ordered by role, then text; null turns
    come first; a null conv_id is a conversation of its own.  Repeated rows are
    turns like any other.  Other columns are left out.  A conversation becomes
    one string, so one task holds it.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    single = collected.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", "pos", "t.role", "t.text")
    # One exchange, by conv_id, serves all that follows.
    order = Window.partitionBy("conv_id").orderBy("pos")
    marked = single.withColumn("new", F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)))
    header = F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT))
    lead = F.when(~F.col("new"), F.lit(TURN)).when(F.col("pos") == 0, header).otherwise(F.concat(F.lit(END), header))
    led = marked.select("conv_id", "pos", "new", (F.col("role") == loss_role).alias("loss"), lead.alias("lead"), escape(F.col("text")).alias("text"))
    led = led.withColumn("length", F.octet_length("text").cast("long"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = led.withColumns({"block": F.sum(F.col("new").cast("int")).over(so_far), "end": F.sum(F.octet_length("lead") + F.col("length")).over(so_far)})
    piece = F.struct("pos", F.concat("lead", "text").alias("text"), "loss", F.struct((F.col("end") - F.col("length")).alias("start"), "length").alias("span"))
    merged = laid.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    merged = merged.select("conv_id", "block", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: p["span"]).alias("spans"))
    whole = merged.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "text", "spans"))).alias("blocks"))
    formatted = F.concat(F.array_join(F.transform("blocks", lambda b: b["text"]), ""), F.lit(END))
    return whole.select("conv_id", formatted.alias("formatted"), F.flatten(F.transform("blocks", lambda b: b["spans"])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role and text, unescaped) and loss_text, from the formatted string alone and its spans."""
    blocks = F.split("formatted", r"<\|end\|>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    start = len(START) + 1

    def block(b: Column) -> Column:
        texts = lambda role, all_: F.transform(F.split(all_, r"<\|turn\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))
        return _let(F.split(F.substring(b, start, F.length(b)), r"<\|text\|>"), lambda parts: _let(unescape(parts[0]), lambda role: texts(role, parts[1])))

    # A part of a byte string is cut without going over what is before it.
    cut = lambda raw: F.transform("loss_spans", lambda s: unescape(F.substring(raw, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string")))
    loss = F.array_join(_let(F.col("formatted").cast("binary"), cut), "")
    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, block)).alias("turns"), loss.alias("loss_text"))
