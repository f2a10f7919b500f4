"""Removal of word passages that repeat across documents, by fixed-block anchors.

A passage of ``window`` words holds at least one whole block of ``block`` words that starts at a
multiple of ``block`` in its document, as window >= 2 * block - 1. So:

1. Index and probe. Every document indexes its non-overlapping blocks and probes the index with
   all its rolling windows of ``block`` words. Both are hashes, shuffled in packed arrays by ranges
   of the hash. A task first settles what repeats within its own texts and passes on one copy
   of it, so a passage in very many documents costs its range one hash per task.
2. Extend. Every window of ``window`` words over a hit is hashed, again one copy per task is passed
   on, and the smallest doc_id for each is found. Windows in other documents are
   repeats; neighbouring ones join into maximal repeats, whose words are removed.

Documents that equal a smaller one word by word are removed as a whole without that search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwright.llm.words import slices, split_words, window_hashes
from rankwright.session import write_table


@dataclass(frozen=True)
class RepeatSpec:
    """Repeats of at least ``window`` words."""

    window: int = 50
    block: int = 25
    hashes_per_range: int = 1_000_000
    words_held: int = 1_500_000  # words of text a task gathers before it deals out their hashes

    def __post_init__(self) -> None:
        if self.window < 2 * self.block - 1:
            raise ValueError("window must be at least 2 * block - 1")


_EMPTY = hashlib.sha256(b"").hexdigest()


def _kept(words, row: int, keep: np.ndarray | None) -> str:
    a, b = words.first[row], words.first[row + 1]
    starts, ends = words.starts[a:b], words.ends[a:b]
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    data = words.data.data
    return hashlib.sha256(b" ".join([data[s:e] for s, e in zip(starts.tolist(), ends.tolist())])).hexdigest()


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and digest of the whole word sequence."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = split_words(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array([_kept(words, i, None) for i in range(part.num_rows)]),
                ],
                ["doc_id", "n_words", "whole_sha256"],
            )


class _Dealer:
    """Gathers (hash, document, place) and deals them out by range of the hash.

    Where documents of one task share a hash, its places are settled at once. Of windows only the
    smallest document's is passed on; of anchors one more of another document, as whichever document
    a place of another task belongs to, it must meet a second one.
    """

    def __init__(self, ranges: int, anchors: bool) -> None:
        self.ranges, self.anchors, self.n = np.uint64(ranges), anchors, 0
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: int, hashes: np.ndarray, places: np.ndarray, indexed: np.ndarray) -> None:
        self.parts.append((hashes, np.full(len(hashes), doc), places.astype(np.int32), indexed))
        self.n += len(hashes)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        hashes, docs, places, indexed = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.n = [], 0
        order = np.argsort(hashes, kind="stable")
        hashes, docs, places, indexed = hashes[order], docs[order], places[order], indexed[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(docs, first)
        shared = np.maximum.reduceat(docs, first) > least
        any_indexed = np.logical_or.reduceat(indexed, first)
        own = docs == least[group]
        # within a task: for anchors all places of a shared hash are hits, for windows those of
        # documents after the smallest are repeats
        settled = shared[group] if self.anchors else ~own
        if settled.any():
            yield _places(docs[settled], places[settled])
        if self.anchors:  # a place of the smallest document and one of another go on, to answer other tasks
            passed = ~settled
            for rows in (np.flatnonzero(own), np.flatnonzero(~own)):
                passed[rows[np.diff(group[rows], prepend=-1) > 0]] = True
        else:
            passed = own
        hashes, docs, places, indexed = hashes[passed], docs[passed], places[passed], any_indexed[group[passed]]
        ranges = ((hashes >> np.uint64(32)) * self.ranges >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        bounds = [0, *cuts.tolist(), len(ranges)]
        ids, where = np.unique(docs, return_inverse=True)
        rows = {k: [] for k in ("range", "hashes", "docs", "doc", "place", "indexed")}
        for a, b in zip(bounds[:-1], bounds[1:]):
            near, at = np.unique(where[a:b], return_inverse=True)
            rows["range"].append(int(ranges[a]))
            rows["hashes"].append(_packed(hashes[a:b], _bytes(self.anchors)))
            rows["docs"].append(ids[near].tobytes())
            rows["doc"].append(at.astype(np.uint16 if len(near) < 65_536 else np.uint32).tobytes())
            rows["place"].append(places[a:b].tobytes())
            rows["indexed"].append(np.packbits(indexed[a:b]).tobytes())
        binary = [pa.array(rows[k], pa.binary()) for k in list(rows)[1:]]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(rows["range"]), pa.int64()), pa.nulls(len(rows["range"]), pa.binary()), pa.array(rows["range"], pa.int64()), *binary],
            _DEALT_NAMES,
        )


_DEALT_NAMES = ["doc_id", "settled", "range", "hashes", "docs", "doc", "place", "indexed"]
_DEALT = "doc_id long, settled binary, range long, hashes binary, docs binary, doc binary, place binary, indexed binary"


def _bytes(anchors: bool) -> int:
    """Of a hash: an anchor too many costs a look at its windows, a window too many would cost words."""
    return 6 if anchors else 8


def _packed(hashes: np.ndarray, size: int) -> bytes:
    """The low bytes of sorted hashes, byte planes apart."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _unpacked(raw, n: int, size: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return wide.view(np.uint64).reshape(-1)


def _places(docs: np.ndarray, places: np.ndarray, settled_only: bool = True) -> pa.RecordBatch:
    """Places packed by document."""
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order].astype(np.int32)
    cuts = np.flatnonzero(np.diff(docs)) + 1
    bounds = [0, *cuts.tolist(), len(docs)]
    ids = [int(docs[a]) for a in bounds[:-1]]
    packed = [places[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    columns = [pa.array(ids, pa.int64()), pa.array(packed, pa.binary())]
    if settled_only:
        columns += [pa.nulls(len(ids), pa.int64())] + [pa.nulls(len(ids), pa.binary())] * 5
        return pa.RecordBatch.from_arrays(columns, _DEALT_NAMES)
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "settled"])


def _digest(words, row: int) -> str:
    return _kept(words, row, None)


def _base(part: pa.RecordBatch, words, row: int) -> int:
    """What is added to the places of a row: not 0 only where rows share a doc_id."""
    bases = part.column("bases")[row]
    return dict(bases.as_py())[_digest(words, row)] if bases.is_valid else 0


def _own_places(part: pa.RecordBatch, words, row: int, column: str) -> np.ndarray:
    """The packed places that lie in this row, counted from its first word."""
    at = np.concatenate([np.frombuffer(x, np.int32) for x in part.column(column)[row].as_py()])
    at = at - _base(part, words, row)
    return at[(at >= 0) & (at < words.first[row + 1] - words.first[row])]


def _probe(spec: RepeatSpec, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(ranges, anchors=True)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    if words.first[i + 1] - words.first[i] < spec.window:
                        continue
                    hashes = window_hashes(words.of(i), spec.block)
                    places = np.arange(len(hashes))
                    dealer.add(doc, hashes, places + _base(part, words, i), places % spec.block == 0)
                if dealer.n > spec.words_held:
                    yield from dealer.drain()
        yield from dealer.drain()

    return run


def _extend(spec: RepeatSpec, ranges: int):
    """Hashes of the windows over the hits of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = _Dealer(ranges, anchors=False)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    hashes = window_hashes(words.of(i), spec.window)
                    if not len(hashes):
                        continue
                    at = _own_places(part, words, i, "hits")
                    steps = np.zeros(len(hashes) + spec.block + spec.window, np.int32)
                    np.add.at(steps, np.maximum(at - (spec.window - spec.block), 0), 1)
                    np.add.at(steps, at + 1, -1)
                    places = np.flatnonzero(np.cumsum(steps)[: len(hashes)] > 0)
                    dealer.add(doc, hashes[places], places + _base(part, words, i), np.ones(len(places), dtype=bool))
                if dealer.n > spec.words_held:
                    yield from dealer.drain()
        yield from dealer.drain()

    return run


def _meet(anchors: bool):
    """The places of one range of hashes whose hash occurs in several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {k: batch.column(k)[i].as_buffer() for k in ("hashes", "docs", "doc", "place", "indexed")}
                places = np.frombuffer(raw["place"], np.int32)
                n, ids = len(places), np.frombuffer(raw["docs"], np.int64)
                at = np.frombuffer(raw["doc"], np.uint16 if len(ids) < 65_536 else np.uint32)
                indexed = np.unpackbits(np.frombuffer(raw["indexed"], np.uint8), count=n).astype(bool)
                parts.append((_unpacked(raw["hashes"], n, _bytes(anchors)), ids[at], places, indexed))
        hashes, docs, places, indexed = (np.concatenate(c) for c in zip(*parts))
        parts = []
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        docs = docs[order]
        least = np.minimum.reduceat(docs, first)
        if anchors:
            hit = (np.maximum.reduceat(docs, first) > least) & np.logical_or.reduceat(indexed[order], first)
            hit = hit[group]
        else:
            hit = docs > least[group]
        if hit.any():
            yield _places(docs[hit], places[order][hit], settled_only=False)

    return run


def _cut(spec: RepeatSpec):
    """Removes the words of the repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_words(part.column("text"))
                removed, digests = [], []
                whole = [_digest(words, i) for i in range(part.num_rows)]
                for i in range(part.num_rows):
                    n = int(words.first[i + 1] - words.first[i])
                    at = _own_places(part, words, i, "repeats")
                    steps = np.zeros(n + spec.window + 1, np.int32)
                    np.add.at(steps, at, 1)
                    np.add.at(steps, at + spec.window, -1)
                    keep = np.cumsum(steps)[:n] == 0
                    removed.append(n - int(keep.sum()))
                    digests.append(_kept(words, i, keep))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(whole), pa.array(removed, pa.int64()), pa.array(digests)],
                    ["doc_id", "whole_sha256", "n_removed", "kept_sha256"],
                )

    return run


def _repeats(texts: DataFrame, spec: RepeatSpec, total: int, anchors: bool) -> DataFrame:
    """``doc_id, settled``: packed places of hits (anchors) or of repeated windows."""
    ranges = max(1, -(-total // spec.hashes_per_range))
    run = (_probe if anchors else _extend)(spec, ranges)
    dealt = texts.mapInArrow(run, _DEALT)
    # both kinds of rows go through one shuffle: settled places by document, hashes by range
    key = F.coalesce("range", F.lit(-1) - F.pmod(F.xxhash64("doc_id"), F.lit(ranges)))
    dealt = dealt.withColumn("range_key", key)
    return dealt.groupBy("range_key").applyInArrow(_split_kinds(anchors), "doc_id long, settled binary")


def _split_kinds(anchors: bool):
    meet = _meet(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and batch.column("range")[0].is_valid:
                    yield batch
                elif batch.num_rows:
                    ready.append(batch.select(["doc_id", "settled"]))

        ready: list[pa.RecordBatch] = []
        source = dealt()
        head = next(source, None)
        if head is not None:
            yield from meet(_chain(head, source))
        yield from ready

    return run


def _chain(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


def _with_bases(docs: DataFrame, described: DataFrame, spec: RepeatSpec) -> DataFrame:
    """Adds ``bases``: where texts share a doc_id, the place of the first word of each by digest."""
    texts = described.filter("doc_id IS NOT NULL").select("doc_id", "whole_sha256", "n_words").distinct()
    shared = texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if shared.isEmpty():
        return docs.withColumn("bases", F.lit(None).cast("map<string,long>"))
    before = Window.partitionBy("doc_id").orderBy("whole_sha256").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("n_words") + spec.window).over(before), F.lit(0))
    bases = texts.join(shared, "doc_id", "left_semi").select("doc_id", F.struct("whole_sha256", base.alias("base")).alias("e"))
    bases = bases.groupBy("doc_id").agg(F.map_from_entries(F.collect_list("e")).alias("bases"))
    return docs.join(bases, "doc_id", "left")


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for each row of ``docs``.

    Needs ``doc_id`` (long) and ``text``; other columns are ignored. A word is removed if a window
    of ``spec.window`` words covers it whose word sequence also starts in a document with a smaller
    doc_id; windows are judged on the input. Null and empty texts have no words, and the digest
    of nothing; texts shorter than the window lose nothing. Rows with the same doc_id never take
    words from each other. A row without doc_id loses nothing and takes nothing. An empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = write_table(docs.mapInArrow(_describe, "doc_id long, n_words long, whole_sha256 string"), "described")
    long = F.col("n_words") >= spec.window
    copies = described.filter(long & F.col("doc_id").isNotNull()).groupBy("whole_sha256").agg(F.min("doc_id").alias("least"))
    described = described.join(copies, "whole_sha256", "left").select(
        "doc_id", "n_words", "whole_sha256", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy")
    )
    described = write_table(described, "described")
    total = described.filter(long).agg(F.sum("n_words")).first()[0] or 0
    ids = _with_bases(docs.filter("doc_id IS NOT NULL"), described, spec)
    hits = write_table(_repeats(ids, spec, total, anchors=True), "hits")
    whole = described.filter(~F.col("copy") & long & F.col("doc_id").isNotNull()).select("doc_id", "whole_sha256").distinct()
    hits = hits.groupBy("doc_id").agg(F.collect_list("settled").alias("hits")).join(whole, "doc_id", "left_semi")
    found = write_table(ids.join(hits, "doc_id"), "found")
    held = found.select(F.sum(F.expr("aggregate(hits, 0L, (n, x) -> n + length(x) div 4)"))).first()[0] or 0
    repeats = write_table(_repeats(found, spec, 4 * held, anchors=False), "repeats")
    repeats = repeats.groupBy("doc_id").agg(F.collect_list("settled").alias("repeats"))
    cut = found.select("doc_id", "text", "bases").join(repeats, "doc_id")
    cut = cut.mapInArrow(_cut(spec), "doc_id long, whole_sha256 string, n_removed long, kept_sha256 string")
    cut = cut.withColumnRenamed("kept_sha256", "cut_sha256").dropDuplicates(["doc_id", "whole_sha256"])
    out = described.join(cut, ["doc_id", "whole_sha256"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_EMPTY)).otherwise(F.coalesce("cut_sha256", "whole_sha256")).alias("kept_sha256"),
    )
