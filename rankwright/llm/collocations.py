"""Phrases whose words keep together, per language, by sorting suffixes of the word sequence.

A suffix is the run of up to ``longest`` words that begins at a word. Suffixes are routed to tasks
by their leading words, so all occurrences of a phrase meet; a multikey three-way quicksort of
pointers to them then splits by one word after the other, and the size of an equal part is the
count of the phrase that its suffixes share. Parts below ``least`` are given up at once.

A phrase is no more frequent than any run of words in it. Runs are counted by their hash first,
pairs in one pass and longer ones, of pairs that are frequent enough, in the next. A suffix ends
where a run in it has a counter below ``least``, and those of one word are left out. Runs that
share a counter make it too high, never too low, so no phrase is lost, whatever the number of
counters. Equal suffixes of a task are one row with a number; texts are read by as many tasks as
run at a time, as rows are phrases times tasks. Leading words found very often are followed by one
more word in the routing, and by more if need be; the counts of phrases shorter than the words
routed by are then sums of those of several tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwright.llm.runs import Runs, byte_set, split_runs, texts_of
from rankwright.llm.words import mix, range_hashes, slices
from rankwright.operators.skew import lookup_join
from rankwright.session import write_table

_BREAKS = byte_set(*map(ord, ".,;:!?"), range(0x0A, 0x0E))
_SOLID = ~(_BREAKS | byte_set(0x20, 0x09))
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
_HELD = 500_000  # rows that a task keeps before it adds up equal ones
_PENDING = 4_000_000  # runs that a task keeps before it counts them
_BLOCK = 1 << 16  # counters in a row of a packed table
_ROUTE_ROWS = 50_000  # rows sorted at a time, about
_TASK_BYTES = 1 << 30  # text that a task reads, about, if there are more tasks than cores
_SALTS = 16


@dataclass(frozen=True)
class Collocations:
    """Phrases of 2 to ``longest`` words found ``least`` times or more, the ``top`` of each language.

    A phrase is dropped if one that contains it has ``percent`` of its count. There are up to
    ``2 ** bits`` counters of runs, one for 32 bytes of text; too few cost time, not phrases.
    """

    least: int = 100
    longest: int = 5
    percent: int = 100
    top: int = 2000
    bits: int = 26


def _languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def _word_ids(words: Runs) -> np.ndarray:
    """Equal words of a slice have equal numbers, from 1."""
    begin = np.append(words.starts, len(words.data)).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(words.count, pa.py_buffer(begin), pa.py_buffer(words.data))
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _run_codes(words: Runs, lang: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 2, 3... words: a hash for each first word, and whether the run is within a piece."""
    hashes = range_hashes(_CODES[words.data], words.starts, words.ends)
    codes = hashes + lang
    for size in range(2, longest + 1):
        if words.count < size:
            return
        whole = words.piece[size - 1 :] == words.piece[: words.count - size + 1]
        codes = mix(codes[: len(whole)] * np.uint64(0xD6E8FEB86659FD93) + hashes[size - 1 :])
        yield codes, whole


def _bit(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _language_hashes(names: list[str]) -> np.ndarray:
    return mix(np.array([zlib.crc32(n.encode()) for n in names], dtype=np.uint64))


class _Sums:
    """Rows (lang, text, n, depth), equal texts added up now and then."""

    def __init__(self) -> None:
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, lang: list[str], of: np.ndarray, texts: pa.Array, n: np.ndarray, depth: np.ndarray) -> Iterator[pa.Table]:
        names = pa.array(lang, pa.large_string()).take(pa.array(of))
        columns = {"lang": names, "text": texts, "n": pa.array(n, pa.int64()), "depth": pa.array(depth, pa.int32())}
        self.tables.append(pa.table(columns))
        self.rows += len(n)
        if self.rows > _HELD:
            yield from self.flush(_HELD // 2)

    def flush(self, keep: int = 0) -> Iterator[pa.Table]:
        if not self.tables:
            return
        added = pa.concat_tables(self.tables).group_by(["lang", "text"]).aggregate([("n", "sum"), ("depth", "max")])
        added = added.select(["lang", "text", "n_sum", "depth_max"]).rename_columns(["lang", "text", "n", "depth"])
        self.tables, self.rows = [added], added.num_rows
        if self.rows > keep:
            self.tables, self.rows = [], 0
            yield added


class _Counts:
    """Counters of runs, packed as (block, the low halves of their numbers and their counts)."""

    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.pending: list[np.ndarray] = []
        self.held = 0

    def add(self, codes: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self.pending.append((codes >> self.shift).astype(np.uint32))
        self.held += len(codes)
        if self.held > _PENDING:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        at, n = np.unique(np.concatenate(self.pending), return_counts=True)
        self.pending, self.held = [], 0
        low, n = (at % _BLOCK).astype(np.uint16), np.minimum(n, 65535).astype(np.uint16)
        begins = np.flatnonzero(np.diff(at // _BLOCK, prepend=-1))
        for first, last in zip(begins, np.append(begins[1:], len(at))):
            yield int(at[first] // _BLOCK), low[first:last].tobytes() + n[first:last].tobytes()


def _add_up(least: int, often: int):
    """Flags per block: counters of ``least`` or more, and of ``often`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist()):
                low, n = np.frombuffer(packed, dtype=np.uint16).reshape(2, -1)
                totals.setdefault(block, np.zeros(_BLOCK, dtype=np.uint32))[low] += n
        for block, total in totals.items():
            flags = [pa.array([np.packbits(total >= limit, bitorder="little").tobytes()]) for limit in (least, often)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *flags], ["block", "least", "often"])

    return run


def _flags(packed: DataFrame, bits: int, least: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits for each counter, so 2 ** bits / 4 bytes come to the driver."""
    # a counter's parts stop at 65535, so it is high enough if the whole is
    schema = "block int, least binary, often binary"
    rows = packed.select("block", "packed").repartition("block").mapInArrow(_add_up(least, often), schema)
    size = max(1, (1 << bits) // _BLOCK)
    flags = np.zeros((2, size, _BLOCK // 8), dtype=np.uint8)
    for r in rows.toLocalIterator():
        for one, value in zip(flags, (r.least, r.often)):
            one[r.block] = np.frombuffer(value, dtype=np.uint8)
    return flags[0].ravel(), flags[1].ravel()


def _words_and_pairs(bits: int):
    schema = pa.schema(
        [("lang", pa.large_string()), ("text", pa.large_string()), ("n", pa.int64()), ("block", pa.int32()), ("packed", pa.binary())]
    )

    def of_words(table: pa.Table) -> Iterator[pa.RecordBatch]:
        empty = [pa.nulls(table.num_rows, schema.field(i).type) for i in (3, 4)]
        columns = [*table.select(["lang", "text", "n"]).columns, *empty]
        yield from pa.table(columns, schema=schema).to_batches(max_chunksize=20_000)

    def of_pairs(block: int, packed: bytes) -> pa.RecordBatch:
        columns = [pa.nulls(1, schema.field(i).type) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([block], pa.int32()), pa.array([packed])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = _Sums(), _Counts(bits)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_runs(part.column("text"), _SOLID, _BREAKS)
                if not words.count:
                    continue
                lang, names = _languages(part.column("lang"))
                lang = lang[words.rows()]
                ids = _word_ids(words)
                _, place, n = np.unique(lang * (ids.max() + 1) + ids, return_index=True, return_counts=True)
                texts = texts_of(words.data, words.starts[place], words.ends[place])
                for table in sums.add(names, lang[place], texts, n, np.ones(len(n))):
                    yield from of_words(table)
                for codes, whole in _run_codes(words, _language_hashes(names)[lang], 2):
                    for row in counts.add(codes[whole]):
                        yield of_pairs(*row)
        for table in sums.flush():
            yield from of_words(table)
        for row in counts.flush():
            yield of_pairs(*row)

    return run


def _longer_runs(pairs: np.ndarray, bits: int, longest: int):
    """Packed counters of the runs of 3 words and more whose pairs all have a flag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift = _Counts(bits), np.uint64(64 - bits)

        def row_of(block: int, packed: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed])], ["block", "packed"])

        for batch in batches:
            for part in slices(batch, "text"):
                words = split_runs(part.column("text"), _SOLID, _BREAKS)
                lang, names = _languages(part.column("lang"))
                goes_on = alive = np.zeros(0, dtype=bool)
                for codes, whole in _run_codes(words, _language_hashes(names)[lang[words.rows()]], longest):
                    if not len(goes_on):
                        goes_on = alive = whole & _bit(pairs, (codes >> shift).astype(np.int64))
                        continue
                    alive = whole & alive[:-1] & goes_on[len(goes_on) - len(codes) :]
                    for row in counts.add(codes[alive]):
                        yield row_of(*row)
        for row in counts.flush():
            yield row_of(*row)

    return run


def _truncated_suffixes(pairs: tuple[np.ndarray, np.ndarray], runs: tuple[np.ndarray, np.ndarray], spec: Collocations, bits: int):
    """Distinct suffixes of a task with their number, and how many leading words they are routed by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, shift = _Sums(), np.uint64(64 - bits)
        for batch in batches:
            for part in slices(batch, "text"):
                words = split_runs(part.column("text"), _SOLID, _BREAKS)
                if words.count < 2:
                    continue
                lang, names = _languages(part.column("lang"))
                lang = lang[words.rows()]
                sizes = np.ones(words.count, dtype=np.int64)
                depth = np.full(words.count, 2)
                alive = hot = np.ones(words.count, dtype=bool)
                for codes, whole in _run_codes(words, _language_hashes(names)[lang], spec.longest):
                    least, often = runs if len(codes) < words.count - 1 else pairs
                    at = (codes >> shift).astype(np.int64)
                    # a run is as frequent as the shorter ones that it begins and ends with, at most
                    alive = whole & alive[:-1] & alive[1:] & _bit(least, at)
                    hot = alive & hot[:-1] & _bit(often, at)
                    sizes[: len(alive)] += alive
                    depth[: len(alive)] += hot
                begins = np.flatnonzero(sizes > 1)
                if not len(begins):
                    continue
                ids = np.concatenate([_word_ids(words), np.zeros(spec.longest, dtype=np.int64)])
                # the words of a suffix as digits of a number, made small again when it grows too large
                base = int(ids.max()) + 1
                code, sizes = lang[begins] * base + ids[begins], sizes[begins]
                for d in range(1, spec.longest):
                    if (int(code.max()) + 1) * base >= 1 << 62:
                        code = np.unique(code, return_inverse=True)[1]
                    code = code * base + np.where(sizes > d, ids[begins + d], 0)
                _, place, n = np.unique(code, return_index=True, return_counts=True)
                first = begins[place]
                texts = texts_of(words.data, words.starts[first], words.ends[first + sizes[place] - 1])
                for table in sums.add(names, lang[first], texts, n, np.minimum(depth[first], spec.longest)):
                    yield from table.to_batches(max_chunksize=20_000)
        for table in sums.flush():
            yield from table.to_batches(max_chunksize=20_000)

    return run


def equal_parts(columns: np.ndarray, weights: np.ndarray, depths: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort: (a row, number of words, weight) of each part of equal leading words.

    ``columns`` holds a row per word place, the language first; 0 is the end of a suffix. A part
    below ``least`` is given up, unless its rows are routed by more words than it shares: then
    more of it is in other tasks.
    """
    stack = [(np.arange(columns.shape[1]), 0)]
    while stack:
        rows, place = stack.pop()
        keys = columns[place][rows]
        # the middle of three, so that sorted rows split well too
        pivot = sorted((int(keys[0]), int(keys[len(keys) // 2]), int(keys[-1])))[1]
        for side in (keys < pivot, keys > pivot):
            part = rows[side]
            if len(part) and (weights[part].sum() >= least or depths[part].max() > max(place, 2)):
                stack.append((part, place))
        equal = rows[keys == pivot]
        if place and not pivot:
            continue  # suffixes that end here
        weight = int(weights[equal].sum())
        if place > 1:
            if weight < least and depths[equal[0]] <= place:
                continue
            yield int(equal[0]), place, weight
        elif weight < least and depths[equal].max() <= 2:
            continue
        if place + 1 < len(columns):
            stack.append((equal, place + 1))


def _sort(spec: Collocations):
    def run(table: pa.Table) -> pa.Table:
        suffixes = table.column("text").to_pylist()
        split = [s.split(" ") for s in suffixes]
        lang = table.column("lang").combine_chunks().dictionary_encode()
        numbers: dict[str, int] = {}
        columns = np.zeros((spec.longest + 1, len(split)), dtype=np.int64)
        columns[0] = lang.indices.to_numpy(zero_copy_only=False)
        for row, words in enumerate(split):
            for place, word in enumerate(words, 1):
                columns[place, row] = numbers.setdefault(word, len(numbers) + 1)
        weights = table.column("n").to_numpy()
        depths = table.column("depth").to_numpy()
        names = lang.dictionary.to_pylist()
        found = list(equal_parts(columns, weights, depths, spec.least))
        return pa.table(
            {
                "lang": pa.array([names[columns[0, row]] for row, _, _ in found], pa.string()),
                "phrase": pa.array([" ".join(split[row][:size]) for row, size, _ in found], pa.string()),
                "size": pa.array([size for _, size, _ in found], pa.int32()),
                "a": pa.array([n for _, _, n in found], pa.int64()),
            }
        )

    return run


def phrase_counts(docs: DataFrame, spec: Collocations = Collocations()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, size, a) of the phrases of 2 words and more, (lang, phrase, a) of the words found
    ``least`` times or more, and (lang, n) of all words."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(1, min(spec.bits, math.ceil(math.log2(size / 32 + 2))))
    # a word or phrase is a row of each task that reads it, so small parts of the input are read together
    texts = texts.coalesce(max(context.defaultParallelism, math.ceil(size / _TASK_BYTES)))
    seen = write_table(
        texts.mapInArrow(_words_and_pairs(bits), "lang string, text string, n long, block int, packed binary"), "words"
    )
    words = write_table(
        seen.filter("block IS NULL").groupBy("lang", F.col("text").alias("phrase")).agg(F.sum("n").alias("a")), "counted"
    )
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    everything = totals.agg(F.sum("n")).first()[0] or 0
    often = min(65_535, max(_ROUTE_ROWS // 10, everything // 2000))
    pairs = context.broadcast(_flags(seen.filter("block IS NOT NULL"), bits, spec.least, often))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _longer_runs(pairs.value[0], bits, spec.longest)(batches)

    runs = context.broadcast(_flags(texts.mapInArrow(count, "block int, packed binary"), bits, spec.least, often))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _truncated_suffixes(pairs.value, runs.value, spec, bits)(batches)

    # no more routes than words, and rows of a pair that isn't spread come with it
    routes = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), everything // _ROUTE_ROWS)
    lead = F.xxhash64("lang", F.expr("substring_index(text, ' ', depth)"))
    suffixes = texts.mapInArrow(cut, "lang string, text string, n long, depth int")
    routed = suffixes.withColumn("route", F.pmod(lead, F.lit(routes)))
    parts = routed.groupBy("route").applyInArrow(_sort(spec), "lang string, phrase string, size int, a long")
    counts = parts.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= spec.least)
    return write_table(counts, "phrases"), words.filter(F.col("a") >= spec.least), totals


def _part(first: str, size: str) -> Column:
    return F.expr(f"array_join(slice(split(phrase, ' '), {first}, {size}), ' ')")


def _not_inside_longer(phrases: DataFrame, spec: Collocations) -> DataFrame:
    """Without the phrases that a longer one with ``percent`` of their count contains.

    What lies inside a longer phrase lies inside one that is longer by a single word, which is at
    least as frequent; so only those are looked at.
    """
    longer = phrases.filter("size > 2")
    inside = longer.select("lang", F.explode(F.array(_part("1", "size - 1"), _part("2", "size - 1"))).alias("phrase"), "a")
    most = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_most"))
    joined = phrases.join(most, ["lang", "phrase"], "left")
    covered = F.coalesce(100 * F.col("_most") >= spec.percent * F.col("a"), F.lit(False))
    return joined.filter(~covered).drop("_most")


def _scored(phrases: DataFrame, parts: DataFrame, totals: DataFrame) -> DataFrame:
    """Add ``l, r, n, score`` of the lowest-scoring cut. Products are decimals of 38 digits."""
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select(
        "lang", "phrase", "a", "k", _part("1", "k").alias("first"), _part("k + 1", "size - k").alias("rest")
    )
    cuts = write_table(cuts, "cuts")
    spread = ("phrase", "k")
    out = lookup_join(cuts, totals, ["lang"], spread_by=spread)
    for name, count in (("first", "l"), ("rest", "r")):
        table = parts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
        out = lookup_join(out, table, ["lang", name], spread_by=spread)
    wide = "CAST({} AS DECIMAL(19, 0))"
    above = f"{wide.format('1000 * a')} * {wide.format('n')}"
    score = F.expr(f"({above}) DIV ({wide.format('l')} * {wide.format('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", "n")).alias("best")
    return out.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def find_collocations(docs: DataFrame, spec: Collocations = Collocations()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``spec.top`` phrases of each language.

    Needs ``lang`` and ``text``; other columns are ignored. Texts are lower-cased from A to Z and
    cut into pieces at ``. , ; : ! ?`` and line ends, these into words at spaces and tabs. A phrase
    of count ``a`` is cut in two parts of counts ``l`` and ``r``; of all cuts the lowest
    floor(1000 a n / (l r)) is its score, with ``n`` the words of the language. Ranks go by score,
    ``a``, then phrase in byte order. A null ``lang`` is ``und``, like that text; null and empty
    texts have no words; repeated rows count again; an empty table gives no rows.
    """
    phrases, words, totals = phrase_counts(docs, spec)
    parts = phrases.select("lang", "phrase", "a").unionByName(words)
    scored = write_table(_scored(_not_inside_longer(phrases, spec), parts, totals), "scored")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # a language's phrases first in some groups, so that its last task has top * _SALTS rows at most
    salted = Window.partitionBy("lang", "_salt").orderBy(*order)
    some = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = some.withColumn("_place", F.row_number().over(salted)).filter(F.col("_place") <= spec.top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.filter(F.col("rank") <= spec.top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
