"""Message contents to text, and operations on ordered conversations (rows of conv_id, turn, role, text)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomkit.functions.strings import py_strip
from loomkit.functions.udfs import arrow_udf

EXIT_WORDS = ("exit", "quit")


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _has_text(value: Column) -> Column:
    """Whether an object has the key text; a null there counts, which variant_get alone can't tell."""
    return F.coalesce(F.map_contains_key(F.try_variant_get(value, "$", "map<string,variant>"), F.lit("text")), F.lit(False))


def flatten_content(content: Column) -> Column:
    """Text of a message content, given as JSON text.

    A string is itself; an object with a text is that text; of a list, strings and texts of such objects are taken,
    empty ones dropped, and joined by line feeds; anything else is what Python prints for it. Native as long as texts
    are strings, as they nearly always are; other values go through an Arrow UDF, which sees null for all the rest.
    """
    value = F.try_parse_json(content)
    items = F.try_variant_get(value, "$", "array<variant>")
    plain_item = lambda v: (_kind(v) == "STRING") | (_kind(v) == "OBJECT") & (~_has_text(v) | (_kind(F.try_variant_get(v, "$.text", "variant")) == "STRING"))
    own = lambda v: F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(_has_text(v), F.try_variant_get(v, "$.text", "string"))
    parts = F.filter(F.transform(items, own), lambda t: t.isNotNull() & (t != ""))
    kind = _kind(value)
    native = (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when((kind == "ARRAY") & F.forall(items, plain_item), F.array_join(parts, "\n"))
        .when((kind == "OBJECT") & (_kind(F.try_variant_get(value, "$.text", "variant")) == "STRING"), F.try_variant_get(value, "$.text", "string"))
    )
    return F.coalesce(native, flatten_in_python(F.when(native.isNull(), content)))


@arrow_udf("string")
def flatten_in_python(contents: pd.Series) -> pd.Series:
    return contents.map(flattened, na_action="ignore")


def flattened(content: str) -> str:
    """As flatten_content, for one JSON text. Text that isn't JSON is itself."""
    try:
        value = json.loads(content)
    except ValueError:
        return content
    if isinstance(value, list):
        texts = [v if isinstance(v, str) else str(v["text"]) for v in value if isinstance(v, str) or isinstance(v, dict) and "text" in v]
        return "\n".join(filter(None, texts))
    return str(value["text"] if isinstance(value, dict) and "text" in value else value)


def last_message(messages: DataFrame, role: str | None = None) -> DataFrame:
    """The last text of each conversation, of any role or of one."""
    rows = messages if role is None else messages.filter(F.col("role") == role)
    return rows.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def until_exit(messages: DataFrame) -> DataFrame:
    """Inputs before the first exit or quit (whatever case and space around), trimmed, blanks left out."""
    text = py_strip(F.col("text"))
    exits = F.sum(F.lower(text).isin(*EXIT_WORDS).cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return messages.withColumn("exits", exits).filter("exits = 0").withColumn("text", text).filter("text <> ''").drop("exits")


def with_history(messages: DataFrame) -> DataFrame:
    """Adds `history`: the turns up to and with each one. Its size is the turn's place, so a long conversation's
    histories grow with the square of its length; history_sizes tells them without building them."""
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(upto))


def history_sizes(messages: DataFrame) -> DataFrame:
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.select("conv_id", "turn", F.count("*").over(upto).alias("n_turns"), F.sum(F.length("text")).over(upto).alias("n_chars"))


def printed_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks a reader sees: texts of AI message chunks that aren't empty. Works on streams."""
    shown = chunks.filter("mode = 'messages' AND type = 'AIMessageChunk'").withColumn("text", flatten_content(F.col("content")))
    return shown.filter("text <> ''").select("conv_id", "seq", "text")


def streamed_replies(chunks: DataFrame) -> DataFrame:
    """conv_id, reply (what was printed, without separators) and state (content of the last `values` chunk, else null)."""
    printed = printed_chunks(chunks).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    states = chunks.groupBy("conv_id").agg(F.max_by(F.when(F.col("mode") == "values", F.col("content")), F.when(F.col("mode") == "values", F.col("seq"))).alias("state"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return states.join(printed, "conv_id", "left").select("conv_id", F.coalesce(text, F.lit("")).alias("reply"), "state")
