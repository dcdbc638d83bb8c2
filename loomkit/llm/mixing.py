"""Mixing sources to target weights, in DataFrame operations only.

Each document gets a hash-random key. A source takes whole epochs and then, in key order, documents up to its exact
budget; the last one is cut. Where that is, distributed prefix sums tell: the key range of each source is cut into
buckets of equal width, the buckets' sums are added up to the one that the budget ends in, and that is cut into buckets
again, until it holds few documents. Only sizes and keys take part. Each document then compares its own key with that
of its source's cut, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomkit.llm.common import broadcast_if_small, count_words, cut

MOST_EPOCHS = 3
BUCKET_ROWS = 2000  # documents of a bucket that are summed one by one
DIGITS = 3  # hexadecimal digits of the key that a level adds: 4096 buckets
KEY_DIGITS = 48  # of md5 and xxhash64


def targets(sizes: DataFrame, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Adds weight and target to (source, source_size, ...): one row for each source, so the windows here are over
    sources, not documents.

    Sources by code point, null last, weigh 1, 2, 3, repeating. All sizes are shared by weight; a target stops at
    most_epochs times its source's size and the excess is reshared. That is min(cap, level * weight) with the one
    level at which targets add up: sources are capped in order of cap / weight until the rest fits under the level.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("rank", rank).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * most_epochs)
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - before("cap")) / (F.sum("weight").over(whole) - before(F.col("weight").cast("double")))
    ranked = ranked.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    ranked = ranked.withColumn("level", F.min(F.struct(fits.isNull(), F.col("cap") / F.col("weight"), "rank", fits.alias("level"))).over(whole)["level"])
    return ranked.withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.lit(0.0))).drop("rank", "cap", "level")


def cuts(light: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds to each source (column of) the key at which its budget ends, how many rows share that key, and the words
    left for them. `light` has source, size and key of each document."""
    found = cut(sources.withColumns({"at": F.lit(""), "rest": F.col("part"), "sharing": F.when(F.col("source_size") > 0, F.col("n")).otherwise(F.lit(0)), "done": F.col("source_size") == 0}))
    length = 0
    while True:
        todo = found.filter("NOT done")
        most = todo.agg(F.max("sharing")).first()[0]
        if most is None:
            return found
        length += DIGITS
        # The last level is the key itself, on which only copies of a document agree.
        name = F.col("key") if most <= BUCKET_ROWS or length >= KEY_DIGITS else F.substring("key", 1, length)
        last = most <= BUCKET_ROWS or length >= KEY_DIGITS
        small = broadcast_if_small(todo.select("of", "at", "rest"))
        sums = light.join(small, F.col("source").eqNullSafe(F.col("of")) & F.startswith("key", F.col("at"))).groupBy("of", "rest", name.alias("next"))
        sums = sums.agg(F.sum("size").alias("words"), F.count("*").alias("n_next"))
        upto = F.sum("words").over(Window.partitionBy("of").orderBy("next"))
        placed = sums.withColumn("upto", upto).filter("upto > rest").withColumn("rank", F.row_number().over(Window.partitionBy("of").orderBy("next"))).filter("rank = 1")
        placed = placed.select(F.col("of").alias("named"), "next", "n_next", (F.col("rest") - (F.col("upto") - F.col("words"))).alias("left_next"))
        new = found.filter("NOT done").join(broadcast_if_small(cut(placed)), F.col("of").eqNullSafe(F.col("named")))
        new = new.withColumns({"at": F.col("next"), "rest": F.col("left_next"), "sharing": F.col("n_next"), "done": F.lit(last)}).select(*found.columns)
        found = cut(found.filter("done").unionByName(new))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """All rows of `docs` with size, source_size, target and taken added (columns of these names are replaced).

    Takes doc_id, text and source. Null and blank texts have size 0 and nothing of them is taken. Very long texts are
    counted whole. Null sources are one source. The order within a source is md5 of seed and doc_id, then a hash of the
    text; only copies of one row share a place in it and take their turns one after the other, so the taken words are
    the same in each run. An empty table gives an empty table. A source takes exactly floor(target) words, and no
    document more than 3 times its size.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    key = F.concat(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).cast("binary")), F.lower(F.lpad(F.hex(F.xxhash64("text")), 16, "0")))
    size = count_words(F.col("text"))
    light = cut(docs.select("source", size.alias("size"), key.alias("key")))
    sources = targets(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    sources = sources.withColumn("epochs", epochs).withColumn("part", F.floor("target") - F.col("epochs") * F.col("source_size"))
    ends = cuts(light, sources.select(F.col("source").alias("of"), "source_size", "target", "n", "epochs", "part"))
    ends = cut(ends.select("of", "source_size", "target", "epochs", "at", "rest", "sharing"))

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("source"), size.alias("size"), key.alias("key"))
    placed = rows.join(broadcast_if_small(ends), F.col("source").eqNullSafe(F.col("of")))
    own = F.when(F.col("key") < F.col("at"), F.col("size")).otherwise(F.lit(0))
    others = placed.filter("key <> at").withColumn("taken", F.col("epochs") * F.col("size") + own)
    at_cut = placed.filter("key = at")
    if ends.filter("sharing > 1").isEmpty():
        part = F.least("rest", "size")
    else:  # copies of one row, in turn
        turn = F.row_number().over(Window.partitionBy("of", "key").orderBy("key"))
        part = F.least(F.greatest(F.col("rest") - (turn - 1) * F.col("size"), F.lit(0)), F.col("size"))
    at_cut = at_cut.withColumn("taken", F.col("epochs") * F.col("size") + part)
    out = [f.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "size", "source_size", "target", F.col("taken").cast("long").alias("taken")) for f in (others, at_cut)]
    return out[0].unionByName(out[1])
