"""Mixing sources to target weights.

Documents get hash-random keys and are range-sorted by them within each source: the leading hex digits of the key are the range, so
that even a source with a third of all rows is dealt over thousands of ranges. The prefix sum of a document is the total of the ranges before its
own plus the running sum inside it, and each source is cut at its exact budget after as many whole epochs as fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricerank.llm.common import n_words, stored

#: Leading hex digits of a key that name its range: 4,096 ranges a source.
RANGE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """Adds `target` to a table of one row per source (`source`, `source_size`).

    Sources by code point, null last, take the weights in turn and share `share` of all words. No target is above max_repeats
    times its source's size; the excess goes to the others by weight. With the sources in order of cap / weight, the
    level reached is the first at which (total - caps so far) / (weights left) is no higher than the next cap / weight.
    The windows here run over one row per source, never over documents. An empty table gives no rows; sources without words get 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", weight).withColumn("_cap", (max_repeats * F.col("source_size")).cast("double"))
    s = s.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    s = s.withColumn("_level", (total - before) / left).withColumn("_at", F.row_number().over(order))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))).over(everything)
    s = s.withColumn("_first", first)
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    return s.withColumn("target", F.when(capped, F.col("_cap")).otherwise(F.col("_first._level") * F.col("_w"))).drop("_w", "_cap", "_ratio", "_level", "_at", "_first")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.0, max_repeats: int = 3, with_row: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, epochs, taken and, with_row, the whole document as the struct column row.

    `size` counts the words of `text` (null: 0); `taken` is what the mix takes of the document: `epochs` whole passes over its source and,
    where the source's remaining budget ends inside or after it, that many words more. A source's taken words
    add up to its target rounded down, so reruns agree. Documents are ordered by the md5 of their id, those without an id by that of their text, so that many of
    them do not share a range; ties by id, size and a hash of the text, so repeated rows are taken one after another. Sizes and keys are stored, so that the words of a text are counted once (twice with_row). A null source is a source of its own. Empty
    tables give no rows. Other columns are not read, unless with_row.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")).cast("binary"))
    d = docs.select("doc_id", F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_text"), key.alias("_key"), *row)
    d = d.withColumn("_s", _non_null(F.col("source"))).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS))
    d = d if with_row else stored(d)
    ranges = stored(d.groupBy("_s", "_range").agg(F.sum("size").alias("_range_size"), F.first("source").alias("source")))
    sources = ranges.groupBy("_s").agg(F.sum("_range_size").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sources, weights, share, max_repeats).drop("source")
    up_to = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = ranges.withColumn("_before", F.sum("_range_size").over(up_to) - F.col("_range_size")).join(targets, "_s").drop("source", "_range_size")
    running = Window.partitionBy("_s", "_range").orderBy("_key", "doc_id", "size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_running", F.sum("size").over(running) - F.col("size")).join(offsets, ["_s", "_range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    d = d.withColumn("epochs", epochs)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    more = F.least(F.greatest(rest - F.col("_before") - F.col("_running"), F.lit(0).cast("long")), F.col("size"))
    return d.select("doc_id", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + more).alias("taken"), *(["row"] if with_row else []))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row for each epoch in which a document is taken, with the columns of documents, size, source_size, target, epoch (from 1)
    and taken (words of this row). The text is cut after `taken` words where the budget ends inside it, else it is whole.
    Documents of which nothing is taken go; so do those without words. Columns of documents with one of the five new names give way to them."""
    d = mix(docs, with_row=True, **options)
    passes = F.col("epochs") + F.when(F.col("taken") > F.col("epochs") * F.col("size"), 1).otherwise(0)
    d = d.where("taken > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    part = F.least(F.col("taken") - (F.col("epoch") - 1) * F.col("size"), F.col("size"))
    words = F.slice(F.filter(F.split("row.text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), part.cast("int"))
    text = F.when(part < F.col("size"), F.concat_ws(" ", words)).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.char_length(text)}
    value = lambda c: new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "epoch": F.col("epoch"), "taken": part}
    return d.select(*[value(c).alias(c) for c in docs.columns if c not in added], *[x.alias(c) for c, x in added.items()])


def _non_null(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))
