"""Line dedup by winnowing, in DataFrame operations only.

A text is the sequence of its lines that aren't blank, trimmed. Of each window of `run` lines the place of the smallest
line hash is selected as a fingerprint: equal windows select the same line, so any repeated run of `run` lines is
guaranteed to share a fingerprint, and neighbouring windows often select the same place, so there are fewer of them
than lines. Where single long lines count as runs, each of them is a fingerprint of its own.

A fingerprint's row carries hashes of the windows it was selected for, those that reach from it to the lines before and
after. Places are joined by their fingerprint with how often it occurs; only where it occurs again are matches extended
both ways, over those windows. Windows that agree overlap into the longest run that agrees. All but the first
occurrence of a run are deleted.

Texts are split and hashed once. What goes on from there are fingerprints, and at last the numbers of the lines to
delete, which meet the texts in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import WORD, cut, join_counted

# The white space that lines are trimmed of.
BLANKS = " \\t\\n\\u000B\\u000C\\r"


def trimmed_lines(text: str) -> Column:
    """The lines of a text, without ASCII white space at either end; a null text has none."""
    return F.expr(f"coalesce(transform(split({text}, '\\n'), l -> btrim(l, '{BLANKS}')), array())")


def fingerprints(docs: DataFrame, run: int, long_words: int | None = None) -> DataFrame:
    """A row for each selected place: its document, the smallest line hash, and the windows it was selected for, each
    with its first line's place, its size and two hashes of its lines."""
    full = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.filter(trimmed_lines("text"), lambda line: line != "").alias("lines"))
    if long_words is None or run == 1:
        full = full.filter(F.size("lines") >= run).withColumn("long", F.array().cast("array<int>"))
    else:
        # A word and the space before the next take two characters, so short lines needn't be counted.
        is_long = lambda line: (F.length(line) >= 2 * long_words - 1) & (F.regexp_count(line, F.lit(WORD)) >= long_words)
        full = full.withColumn("long", F.filter(F.transform("lines", lambda line, i: F.when(is_long(line), i + 1)), lambda i: i.isNotNull()))
        full = full.filter((F.size("lines") >= run) | (F.size("long") > 0))
    full = full.withColumn("hashes", F.transform("lines", lambda line: F.xxhash64(line))).withColumn("more", F.transform("lines", lambda line: F.hash(line)))
    # explode() of a single element keeps Spark from computing an array again for each use.
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(F.expr(value))))
    full = once(full, "marks", f"""if(size(lines) >= {run}, transform(sequence(1, size(lines) - {run - 1}), i ->
        array_min(transform(slice(hashes, i, {run}), (h, j) -> struct(h AS hash, i + j AS place))).place), array())""")
    window = lambda at, size: f"struct({at} AS at, {size} AS size, xxhash64(slice(hashes, {at}, {size}), {size}) AS key, hash(slice(more, {at}, {size})) AS more)"
    full = once(full, "found", f"""concat(
        transform(array_distinct(marks), p -> struct(hashes[p - 1] AS hash, transform(
            filter(sequence(greatest(1, p - {run - 1}), least(p, size(marks))), i -> marks[i - 1] = p), i -> {window("i", run)}) AS windows)),
        transform(long, p -> struct(hashes[p - 1] AS hash, array({window("p", 1)}) AS windows)))""")
    return full.select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")


def repeated_lines(docs: DataFrame, run: int, long_words: int | None = None) -> DataFrame:
    """doc_id, text_key and the numbers (from 1, blank lines not counted) of the lines to delete, of each document with any."""
    places = cut(fingerprints(docs, run, long_words))
    shared = cut(places.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    extended = join_counted(places, shared, ["hash"]).select("doc_id", "text_key", F.explode("windows").alias("w"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key", "w.at")
    extended = cut(extended.select("w.key", "w.more", "w.size", place.alias("place")))
    firsts = cut(extended.groupBy("key", "more").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    later = join_counted(extended, firsts, ["key", "more"]).filter("place > first")
    lines = F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(place.at, place.at + size - 1)"))))
    return later.groupBy("place.doc_id", "place.text_key").agg(lines.alias("gone"))


def dedup_lines(docs: DataFrame, run: int = 2, long_words: int | None = None) -> DataFrame:
    """Deletes each line that lies in a run of `run` or more lines which also occurs earlier and, if `long_words` is
    given, each line of that many words or more which occurs earlier by itself.

    Earlier means in a document of smaller doc_id, or before in the same text. Lines are compared without white space
    at their ends; blank lines are neither compared nor deleted. Takes doc_id and text and returns all columns with
    text replaced, and n_lines and n_removed added (columns of these names in the input are replaced).

    Null texts stay null with 0 lines; empty texts stay empty. Very long texts and lines are read whole, in time in
    proportion to their length; a document has to fit in a task. A null doc_id comes after all others. Rows that share
    doc_id and text are one document, so repeated rows come out alike; texts that share a doc_id are ordered by hash.
    An empty table gives an empty table. Runs of one document may overlap; their first lines stay. A line that very
    many documents share is joined without bringing its rows together.
    """
    gone = repeated_lines(docs, run, long_words)
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), "text")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("r.text_key") == F.col("g.text_key"))
    out = rows.alias("r").join(gone.alias("g"), same, "left").select("r.row", "r.text", "g.gone")
    # From its first character that isn't blank to its end, a line is one match. Only texts that lose lines are split.
    n_lines = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0))
    once = F.struct(F.split("text", "\n").alias("lines"), F.filter(F.transform(trimmed_lines("text"), lambda line, i: F.when(line != "", i)), lambda i: i.isNotNull()).alias("places"))
    out = out.select("row", "text", "gone", n_lines.alias("n_lines"), F.explode(F.array(F.when(F.col("gone").isNotNull(), once))).alias("o"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(o.lines) - 1), transform(gone, g -> o.places[g - 1])), i -> o.lines[i]), '\\n')")
    out = out.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    columns = [F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*columns, F.col("n_lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
