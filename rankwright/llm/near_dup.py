"""Near-duplicate groups of documents: SuperMinHash, banding, verification, union-find.

1. Every text becomes its set of word shingles. Documents with equal sets are one node of the
   graph from here on, so copies cost one row each whatever their number.
2. Nodes get a SuperMinHash signature and fall into one bucket per band of it.
3. In each bucket the least node is compared with all others on the full sets; links found are
   joined into components.
4. What a bucket has then not settled is compared too: its members outside its largest component.
   The Jaccard distance is a metric, so those whose distances to the least node differ by more
   than the limit can't be links and are skipped. Members near enough to the largest component
   are compared with all of it in blocks, without a row for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwright.llm.components import components
from rankwright.llm.names import unused
from rankwright.llm.superminhash import band_keys, signatures
from rankwright.llm.words import mix, range_hashes, slices, split_words
from rankwright.session import write_table

#: Sets in a block on either side, where groups are compared in blocks.
BLOCK = 256
#: The most ids that are broadcast to fetch the sets of compared documents; more are shuffled.
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class NearDup:
    """Similarity of at least ``percent`` / 100 on shingles of ``words`` words.

    With 40 bands of 5 slots a pair of similarity 0.8 is missed with probability 1e-7.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    slots: int = 200


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin.

    A text of fewer words has its whole sequence as its one shingle, one without words none.
    """
    words = split_words(column, lower=True)
    counts = np.diff(words.first)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), shingles)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    starts = words.first[owner] + inside
    ends = np.minimum(starts + size, words.first[owner + 1])
    hashes = range_hashes(words.hashes, starts, ends)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))


def _long_lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(rows.reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], flat)


def _sign(spec: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, first = shingle_sets(part.column("text"), spec.words)
                sizes = np.diff(first)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ np.uint64(s)), dtype=np.uint64)]) for s in (3, 5)]
                low, high = (mix(s[first[1:]] - s[first[:-1]] + sizes.astype(np.uint64)) for s in sums)
                keys = band_keys(signatures(sets, first, spec.slots), spec.bands)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        _long_lists(keys),
                    ],
                    ["doc_id", "n_shingles", "low", "high", "bands"],
                )

    return run


def _sets(spec: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, first = shingle_sets(part.column("text"), spec.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([sets[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of intersection and union of the sets of each pair."""
    for batch in batches:
        shared, total = [], []
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.uint64))
        for a, b in zip(batch.column("a_set"), batch.column("b_set")):
            a, b = a.as_buffer(), b.as_buffer()
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            shared.append(both)
            total.append(len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
            ["a", "b", "shared", "total"],
        )


def _fetch(nodes: DataFrame, docs: DataFrame, spec: NearDup) -> DataFrame:
    """``node, shingles``: the full sets of some nodes, worked out from the texts again."""
    nodes = write_table(nodes.select(F.col("node").alias("doc_id")), "compared")
    few = nodes.count() <= BROADCAST_IDS
    found = docs.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")
    return write_table(found.mapInArrow(_sets(spec), "node long, shingles binary").dropDuplicates(["node"]), "sets")


def _compare(pairs: DataFrame, docs: DataFrame, spec: NearDup) -> DataFrame:
    """``a, b, shared, total`` of each pair of nodes, on the full sets."""
    pairs = write_table(pairs, "pairs")
    sets = _fetch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, spec)
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set"))
    return pairs.join(b, "b").join(a, "a").mapInArrow(_shared, "a long, b long, shared long, total long")


def near_duplicates(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """Rows ``doc_id, n_shingles, component_id, kept``: one for each row of ``docs``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Documents are linked
    when 100 * intersection >= percent * union of their shingle sets, and ``component_id`` is the
    smallest doc_id that links reach; ``kept`` is doc_id = component_id. A null or empty text, or
    one of white space, has no shingle and is linked with nothing. Rows with the same doc_id are
    one document for the links: if their texts differ, they are linked. A row without a doc_id
    is linked with nothing, has no component_id and is kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, low long, high long, bands array<long>"
    signed = write_table(docs.mapInArrow(_sign(spec), schema), "signed")
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    node_of = write_table(real.groupBy("low", "high").agg(F.min("doc_id").alias("node")), "nodes")
    # rows that share an id with another text: their node is linked to that id
    strays = real.join(node_of, ["low", "high"]).filter("doc_id != node").select(F.col("doc_id").alias("b"), F.col("node").alias("a"))
    strays = strays.join(node_of.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b").distinct()

    rows = (
        signed.join(node_of.select(F.col("node").alias("doc_id"), "low", "high"), ["doc_id", "low", "high"], "left_semi")
        .select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    )
    heads = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("other")).filter("a < other").select("key", "a")
    member = write_table(rows.join(heads, "key").filter("node != a").select("key", "a", F.col("node").alias("b")), "members")

    link = F.expr(f"100 * shared >= {spec.percent} * total")
    tested = write_table(_compare(member.select("a", "b").distinct(), docs, spec), "tested")
    edges = write_table(tested.filter(link).select("a", "b").union(strays), "edges")
    first = write_table(components(edges), "components")

    known = _unsettled(member, tested, first, spec)
    if not known.isEmpty():
        more = _compare(_far_pairs(known), docs, spec).filter(link).select("a", "b")
        near = _near_links(known, first, docs, spec)
        before = first.select(F.col("component").alias("a"), F.col("node").alias("b")).filter("a < b")
        first = write_table(components(before.union(more).union(near)), "components")

    labels = node_of.join(first, "node", "left").select("low", "high", F.coalesce("component", "node").alias("component_id"))
    out = signed.join(labels, ["low", "high"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def keep_one_of_each(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``near_duplicates`` keeps.

    Of rows that share a kept doc_id one stays.
    """
    rows = write_table(near_duplicates(docs, spec).filter("n_shingles > 0 AND doc_id IS NOT NULL"), "rows")
    doc = unused(docs, "_id")
    gone = write_table(rows.filter("NOT kept").select(F.col("doc_id").alias(doc)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    same = F.col("doc_id").cast("long") == F.col(doc)
    left = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    repeated = rows.filter("kept").groupBy(F.col("doc_id").alias(doc)).agg(F.count("*").alias("n"))
    repeated = write_table(repeated.filter("n > 1").select(doc), "repeated")
    if repeated.isEmpty():
        return left
    return left.join(repeated, same, "left_anti").union(left.join(repeated, same, "left_semi").dropDuplicates(["doc_id"]))


def _unsettled(member: DataFrame, tested: DataFrame, comps: DataFrame, spec: NearDup) -> DataFrame:
    """Of buckets with several components, the members outside the largest one, called ``main``.

    ``away`` is the distance to the bucket's least node in steps of the limit. A member is ``near``
    if by the triangle inequality it may be linked to a member of the main component.
    """
    away = (F.lit(1.0) - F.col("shared") / F.col("total")) / F.lit(1 - spec.percent / 100)
    heads = member.select("key", F.col("a").alias("b"), F.lit(0.0).alias("away")).distinct()
    known = member.join(tested, ["a", "b"]).select("key", "b", away.alias("away")).union(heads)
    comps = comps.select(F.col("node").alias("b"), F.col("component").alias("comp"))
    known = write_table(
        known.join(comps, "b", "left").select("key", "b", F.coalesce("comp", "b").alias("comp"), "away"), "known"
    )
    each = known.groupBy("key", "comp").agg(
        F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")
    )
    main = each.groupBy("key").agg(
        F.max(F.struct("n", F.col("comp").alias("main"), "low", "high")).alias("m"), F.count("*").alias("comps")
    )
    main = main.filter("comps > 1").select("key", "m.main", "m.low", "m.high")
    near = F.expr("away BETWEEN low - 1 - 1e-9 AND high + 1 + 1e-9").alias("near")
    known = known.join(main, "key").filter("comp != main")
    return write_table(known.select("key", "b", "comp", "main", "away", near), "open")


def _far_pairs(known: DataFrame) -> DataFrame:
    """Pairs of one bucket, not both near, that may be links."""
    step = F.floor("away").alias("step")
    a = known.select("key", F.col("b").alias("a"), F.col("comp").alias("a_comp"), F.col("away").alias("a_away"),
                     F.col("near").alias("a_near"), F.explode(F.array(F.floor("away") - 1, F.floor("away"), F.floor("away") + 1)).alias("step"))
    pairs = a.join(known.select("key", "b", "comp", "away", "near", step), ["key", "step"]).filter(
        "a < b AND a_comp != comp AND NOT (a_near AND near) AND abs(a_away - away) <= 1 + 1e-9"
    )
    return pairs.select("a", "b").distinct()


def _near_links(known: DataFrame, comps: DataFrame, docs: DataFrame, spec: NearDup) -> DataFrame:
    """Links of near members with each other and with the component they are near to.

    Both sides come in blocks, so that no row is made for a pair: a group of near copies that are
    just below the limit has as many pairs as the square of its size.
    """
    near = write_table(known.filter("near").select(F.col("b").alias("node"), F.col("main").alias("group")).distinct(), "near")
    groups = near.groupBy("group").agg(F.count("*").alias("asking"))
    inside = comps.select("node", F.col("component").alias("group")).join(groups.select("group"), "group", "left_semi")
    # a component of one node is not in the table of components
    alone = groups.select(F.col("group").alias("node"), "group")
    asked = write_table(inside.select("node", "group").union(near.select("node", "group")).union(alone).distinct(), "asked")
    sets = _fetch(asked.select("node").distinct(), docs, spec)
    parts = asked.groupBy("group").agg(F.count("*").alias("asked")).join(groups, "group").select(
        "group",
        F.ceil(F.col("asked") / BLOCK).alias("columns"),
        F.ceil(F.col("asking") / BLOCK).alias("rows"),
    )
    here = lambda of: F.expr(f"pmod(xxhash64(node), {of})")
    every = lambda of: F.explode(F.expr(f"sequence(0L, {of} - 1)"))
    left = near.join(parts, "group").select("group", "node", here("rows").alias("row"), every("columns").alias("column"))
    right = asked.join(parts, "group").select("group", "node", every("rows").alias("row"), here("columns").alias("column"))
    keys = ["group", "row", "column"]
    own = sets.select(F.col("node").alias("asking"), F.col("shingles").alias("own"))
    left = left.join(own, left["node"] == own["asking"]).select(*keys, "asking", "own")
    right = right.join(sets, "node").select(*(F.col(k).alias(f"to_{k}") for k in keys), "node", "shingles")
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"to_{k}" for k in keys))).applyInArrow(_blocks(spec), "a long, b long")


def _blocks(spec: NearDup):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = np.asarray(left.column("asking")), np.asarray(right.column("node"))
        found_a, found_b = [], []
        if len(a) and len(b):
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in left.column("own")]
            other = [np.frombuffer(x.as_buffer(), np.uint64) for x in right.column("shingles")]
            sizes = np.array([len(x) for x in other])
            hashes, owner = np.concatenate(other), np.repeat(np.arange(len(b), dtype=np.int32), sizes)
            order = np.argsort(hashes)
            hashes, owner = hashes[order], owner[order]
            for i, x in enumerate(own):
                low = np.searchsorted(hashes, x, side="left")
                many = np.searchsorted(hashes, x, side="right") - low
                at = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
                shared = np.bincount(owner[at], minlength=len(b))
                links = (100 * shared >= spec.percent * (len(x) + sizes - shared)) & (b != a[i])
                found_b.append(b[links])
                found_a.append(np.full(links.sum(), a[i]))
        empty = np.empty(0, np.int64)
        a, b = np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run
