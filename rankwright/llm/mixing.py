"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source gets a share of the mix by its weight, but no more than ``epochs`` times its size;
what is cut off goes to the other sources by weight, until no source is above its cap. A source
is then taken as often as its target goes into its size: all documents a whole number of times,
and once more the documents that come first in a seeded order, until the target is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.session import write_table


@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources in order of their names, null last."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5  # size of the mix, as a multiple of all sizes
    epochs: float = 2.0  # the most times a source is taken
    seed: str = "mix-1"
    slices: int = 4096  # of the seeded order, for finding where a source's share ends


def n_words(text: Column) -> Column:
    """Number of runs of characters outside ``\\x20\\x09-\\x0D``; null has none."""
    blank = r"[\x20\x09-\x0D]+"
    inner = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{blank}", ""), f"{blank}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, blank))).cast("long")


def _targets(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """Adds ``target`` to a row per source with ``source, source_size``.

    The level of the water is the share per unit of weight at which shares and caps add up to the
    mix. Sources are met in the order in which they reach their caps; the first k are at their cap
    if the level that remains for the others is above theirs.
    """
    everything = Window.partitionBy()
    names = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    place = (F.row_number().over(names) - 1) % len(spec.weights)
    sources = sources.withColumn("weight", F.get(weights, place)).withColumn(
        "cap", F.col("source_size") * F.lit(float(spec.epochs))
    )
    order = [(F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    filling = Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy().orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.least(F.sum("source_size").over(everything) * F.lit(spec.share), F.sum("cap").over(everything))
    level = (total - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / F.sum("weight").over(after)
    sources = sources.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level at the first source that is not full is the level of all that follow
    final = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(final["level"] * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Adds ``size, source_size, target, taken, copies`` to ``docs (doc_id, text, source)``.

    ``copies`` is how often the mix takes a document, at most ``spec.epochs`` rounded up, and
    ``taken`` its words, repeats counted. Other columns are kept. The taken words of a source
    come as near to its target as whole documents in the seeded order allow. Null is a source of
    its own, after all others. A null or empty text has size 0. Rows that agree in doc_id, source
    and size have the same place in the order and are taken alike. A column that the result adds replaces one of
    the same name. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies")]
    # the columns of the input stay in one struct, apart from those of the work
    size = n_words(F.col("text").cast("string")).alias("size")
    docs = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc"), "doc_id", "source", size)
    sized = write_table(docs.select("doc_id", "source", "size"), "sizes")
    targets = _targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), spec)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("times", F.floor(ratio)).withColumn(
        "left_over", F.col("target") - F.col("times") * F.col("source_size")
    )
    targets = write_table(targets, "targets")

    # words of each source by slice of the order; the slice in which its share ends is looked into
    key = _order_key(spec)
    cut = F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * spec.slices / F.lit(2.0**32)
    keyed = sized.withColumn("key", key).withColumn("slice", F.floor(cut))
    slices = keyed.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    joined = _by_source(slices, targets)
    last = joined.filter("before < left_over AND left_over <= before + words").select(
        "source", "slice", "before", "left_over"
    )
    last = write_table(last, "last")
    inside = _by_source(keyed, last.withColumnRenamed("slice", "last")).filter("slice = last")
    inside = inside.groupBy("source", "key", "before", "left_over").agg(F.sum("size").alias("size"))
    here = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(here), F.lit(0))
    # a document at the end counts if the target is nearer with it than without it
    inside = inside.withColumn("start", start).filter(F.col("left_over") - F.col("start") >= F.col("size") / 2)
    ends = inside.filter("size > 0").groupBy("source").agg(F.max("key").alias("end"))
    begins = last.select("source", F.format_string("%08x", F.ceil(F.col("slice") * F.lit(2.0**32) / spec.slices)).alias("begin"))
    plan = _by_source(_by_source(targets, ends, "left"), begins, "left")
    # without a document in the last slice, the share ends before that slice
    plan = plan.select("source", "source_size", "target", "times", F.coalesce("end", "begin").alias("end"))
    out = _by_source(docs, write_table(plan, "plan"))
    again = F.coalesce(F.col("end") >= _order_key(spec), F.lit(False)).cast("long")
    copies = F.col("times") + again
    return out.select(
        "doc.*", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies")
    )


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Null-safe join on ``source``."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _order_key(spec: MixSpec) -> Column:
    """The seeded order of a source's documents."""
    text = F.concat_ws(":", F.lit(spec.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))
    return F.md5(text.cast("binary"))
