"""Benchmark items in documents, by SimHash windows; DataFrame operations only.

1. Texts become word shingles (lower case, letters and digits only). Places where a document has a
   shingle of the benchmark are found by a join. A window that is similar enough to an item has a
   shared shingle among its first ones, so only windows that begin shortly before such a place are
   looked at, and only with the items that hold this shingle; no other window can be similar.
2. Every such window of the size of an item gets a SimHash of 64 bits of its shingles.
3. Fingerprints are cut into ``radius + 1`` blocks. Two that differ in at most ``radius`` bits
   agree in a block, so a join by item and block finds all of them.
4. Candidates are verified by the exact weighted similarity: shingles count as often as they
   occur, and it is the sum of the smaller counts over the sum of the larger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwright.llm.names import unused
from rankwright.session import write_table

#: The most rows of a table of ids or shingles that is broadcast; more are shuffled.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class LeakSpec:
    """Similarity of at least ``percent`` / 100 on shingles of ``words`` words."""

    words: int = 5
    percent: int = 80
    radius: int = 22  # differing bits


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}\s]+", "")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def _cuts(words: Column, sizes: list[int]) -> Column:
    """For each of ``sizes`` the hashes of the runs of so many words, as an array of arrays.

    The words are bound to a variable, for otherwise the optimiser would put the expression that
    makes them into the inner function and work it out again for each shingle.
    """

    def runs(w: Column, size: int) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - (size - 1))
        hashes = F.transform(places, lambda i: F.xxhash64(F.slice(w, i, size)))
        return F.when(F.size(w) >= size, hashes).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), lambda w: F.array(*[runs(w, size) for size in sizes])), F.lit(0))


def _fingerprints(windows: DataFrame, *keys: str) -> DataFrame:
    """SimHash of the shingles in column ``h``, for each group of ``keys``.

    The 64 counts of set bits are kept in 32 sums of two halves each, added up before the shuffle.
    Their majority is that of the shingles added, so equal rows give the fingerprint of one.
    """
    sums = [F.sum(F.expr(f"shiftright(h, {k}) & 4294967297L")).alias(f"s{k}") for k in range(32)]
    counted = windows.groupBy(*keys).agg(F.count("*").alias("added"), *sums)
    halves = F.array(*[f"s{k}" for k in range(32)])
    bits = F.expr(
        "aggregate(sequence(0, 63), 0L, (f, i) -> f | shiftleft(CAST("
        "2 * (shiftrightunsigned(sums[i % 32], 32 * (i div 32)) & 4294967295L) > added AS BIGINT), i))"
    )
    return counted.select(*keys, "added", halves.alias("sums")).select(*keys, bits.alias("print"))


def _masks(radius: int) -> list[tuple[int, int]]:
    """First bit and width mask of each of the ``radius + 1`` blocks of a fingerprint."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def _blocks(radius: int) -> Column:
    """The blocks of a fingerprint as (block, value)."""
    parts = [
        f"struct({k} AS block, shiftrightunsigned(print, {a}) & {mask}L AS value)"
        for k, (a, mask) in enumerate(_masks(radius))
    ]
    return F.inline(F.expr(f"array({', '.join(parts)})"))


def _first_agreeing(radius: int) -> str:
    """The first block in which ``print`` and ``own`` agree."""
    parts = [f"shiftrightunsigned(print ^ own, {a}) & {mask}L" for a, mask in _masks(radius)]
    return f"CAST(array_position(array({', '.join(parts)}), 0L) AS INT) - 1"


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text``; ``row`` tells apart the texts of one doc_id, or of none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return docs.withColumn("row", _row(F.col("text")))


def _row(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def find_leaks(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: the best window for each pair found.

    Needs ``doc_id, text`` and ``item_id, text``; other columns are ignored. ``start`` is the place
    of the window's first word, from 0. An item of fewer than ``spec.words`` words has its whole
    sequence as its one shingle; null and empty texts have none and take no part. Rows of docs
    that share a doc_id, or have none, are searched each on its own and are one document in the
    result; so are rows of benchmark that share an item_id. Equal rows count once. Of windows that
    tie, the first is returned. Empty tables give no rows.
    """
    pairs = _pairs(docs, benchmark, spec)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words")).alias("b")
    return pairs.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.s")).alias("start"), "b.n_words", F.col("b.similarity").alias("similarity")
    )


def _pairs(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec) -> DataFrame:
    """``doc_id, row, item_id, start, n_words, similarity``: all windows that hold an item."""
    docs = _numbered(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _words(F.col("text")).alias("words"))
    items = items.filter("size(words) > 0").withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"])
    items = write_table(items.withColumn("size", F.least(F.size("words"), F.lit(spec.words))), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # spec.words values at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, row long, item_id long, start int, n_words int, similarity double")
    place = F.array_position(F.array(*[F.lit(n) for n in sizes]), F.col("size")).cast("int") - 1
    items = items.select("item_id", "item", place.alias("k"), _cuts(F.col("words"), sizes).alias("cuts"))
    items = items.select("item_id", "item", "k", F.get("cuts", F.col("k")).alias("hs"))
    items = write_table(items.withColumn("m", F.size("hs")), "items")

    def cut(texts: DataFrame, name: str) -> DataFrame:
        return texts.select("doc_id", "row", _cuts(_words(F.col("text")), sizes).alias(name))

    index = write_table(items.select("k", "m", "item", F.explode(F.array_distinct("hs")).alias("h")), "shingles")
    places = write_table(_places(cut(docs, "cuts"), index), "places")
    ids = _bounded(places.select("_id", "_row"))
    texts = docs.join(ids, _same_row(), "left_semi")
    prints = write_table(_windows(cut(texts, "cuts"), places, spec), "prints")
    own = _fingerprints(items.select("item", "k", "m", F.explode("hs").alias("h")), "item", "k", "m")
    own = write_table(own.withColumnRenamed("print", "own"), "prints")
    shared = write_table(_sharing(places, index, spec), "sharing")
    candidates = write_table(_within(shared, prints, own, spec), "candidates")
    return _verified(cut(texts, "cuts"), candidates, items, sizes, spec)


def _spare(spec: LeakSpec) -> str:
    """The most shingles of a window of ``m`` that its item need not hold.

    Window and item have ``m`` each; sharing n of them gives a similarity of n / (2m - n).
    """
    return f"CAST(m * {100 - spec.percent} div {100 + spec.percent} AS INT)"


def _places(cuts: DataFrame, index: DataFrame) -> DataFrame:
    """``_id, _row, places``: where each document has shingles of the benchmark, in one pass for all sizes."""
    lengths = index.groupBy("k", "h").agg(F.collect_set("m").alias("ms"))
    rows = cuts.select("doc_id", "row", F.posexplode("cuts").alias("k", "hs"))
    rows = rows.select("doc_id", "row", "k", F.posexplode("hs").alias("place", "h"))
    rows = rows.join(_bounded(write_table(lengths, "lengths")), ["k", "h"])
    rows = rows.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    return rows.agg(F.collect_set(F.struct("k", "place", "h", "ms")).alias("places"))


def _windows(cuts: DataFrame, places: DataFrame, spec: LeakSpec) -> DataFrame:
    """``doc_id, row, k, m, s, print`` of each window with a shared shingle among its first ones."""
    begins = (
        "array_distinct(flatten(flatten(transform(places, p -> transform(p.ms, m -> transform("
        f"sequence(greatest(0, p.place - {_spare(spec)}), p.place), s -> struct(p.k AS k, m, s)))))))"
    )
    windows = cuts.join(places, _same_row()).select("doc_id", "row", "cuts", F.explode(F.expr(begins)).alias("w"))
    windows = windows.select("doc_id", "row", "w.*", F.expr("cuts[w.k]").alias("hs")).filter("s + m <= size(hs)")
    windows = windows.select("doc_id", "row", "k", "m", "s", F.explode(F.expr("slice(hs, s + 1, m)")).alias("h"))
    return _fingerprints(windows, "doc_id", "row", "k", "m", "s")


def _sharing(places: DataFrame, index: DataFrame, spec: LeakSpec) -> DataFrame:
    """``doc_id, row, k, m, s, item``: windows with the items that hold one of their first shingles."""
    rows = places.select(F.col("_id").alias("doc_id"), F.col("_row").alias("row"), F.inline("places"))
    rows = rows.select("doc_id", "row", "k", "h", "place", F.explode("ms").alias("m"))
    rows = rows.withColumn("s", F.explode(F.expr(f"sequence(greatest(0, place - {_spare(spec)}), place)")))
    return rows.join(_bounded(index), ["k", "h", "m"]).select("doc_id", "row", "k", "m", "s", "item").distinct()


def _within(shared: DataFrame, prints: DataFrame, own: DataFrame, spec: LeakSpec) -> DataFrame:
    """The rows of ``shared`` whose fingerprints are within the radius, found by their blocks.

    A pair may agree in several blocks; it is taken at the first, so no pair comes twice.
    """
    window = [F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}")) for name in ("doc_id", "row", "k", "m", "s")]
    a = shared.alias("a").join(prints.alias("b"), window).select("a.*", "b.print")
    a = a.select("*", _blocks(spec.radius))
    b = own.select("item", F.col("own").alias("print")).select("item", F.col("print").alias("own"), _blocks(spec.radius))
    near = a.join(_bounded(write_table(b, "blocks")), ["item", "block", "value"])
    near = near.filter(f"bit_count(print ^ own) <= {spec.radius}").filter(f"block = {_first_agreeing(spec.radius)}")
    return near.select("doc_id", "row", "k", "m", "s", "item")


def _verified(cuts: DataFrame, candidates: DataFrame, items: DataFrame, sizes: list[int], spec: LeakSpec) -> DataFrame:
    """Exact similarity: only windows that are candidates are cut out again."""
    wanted = candidates.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    wanted = wanted.agg(F.collect_list(F.struct("k", "s", "m", "item")).alias("ws"))
    again = cuts.join(wanted, _same_row()).select("doc_id", "row", "cuts", F.explode("ws").alias("w"))
    again = again.select("doc_id", "row", "w.*", F.expr("slice(cuts[w.k], w.s + 1, w.m)").alias("hs"))
    again = again.dropDuplicates(["doc_id", "row", "s", "m", "item"]).withColumn("h", F.explode("hs"))
    counted = again.groupBy("doc_id", "row", "k", "s", "m", "item", "h").agg(F.count("*").alias("n"))
    known = items.select("item", "item_id", F.explode("hs").alias("h"))
    known = known.groupBy("item", "item_id", "h").agg(F.count("*").alias("n_item"))
    shared = counted.join(known, ["item", "h"]).groupBy("doc_id", "row", "k", "s", "m", "item_id", "item").agg(
        F.sum(F.least("n", "n_item")).alias("shared")
    )
    shared = shared.filter(f"100 * shared >= {spec.percent} * (2 * m - shared)")
    size = F.get(F.array(*[F.lit(n) for n in sizes]), F.col("k"))
    return shared.select(
        "doc_id", "row", "item_id", F.col("s").alias("start"), (F.col("m") + size - 1).alias("n_words"),
        (F.col("shared") / (2 * F.col("m") - F.col("shared"))).alias("similarity"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    doc, row = unused(docs, "_id"), unused(docs, "_row")
    leaks = _pairs(docs, benchmark, spec).select(F.col("doc_id").alias(doc), F.col("row").alias(row))
    leaks = _bounded(write_table(leaks.distinct(), "leaks"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (_row(F.col("text")) == F.col(row))
    return docs.join(leaks, same, "left_anti")
