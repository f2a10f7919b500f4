"""Collocations: counts and cuts against a plain version, hot leading words, odd rows, large numbers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankwright.llm import collocations
from rankwright.llm.collocations import Collocations

SCHEMA = "lang string, text string, phrase string, n string, a string, bucket string, route string, size string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def _expected(rows, spec):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, spec.longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    often = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= spec.least}
    covered = set()
    for (lang, p), a in often.items():
        for size in range(1, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * a >= spec.percent * counts[lang, p[i : i + size]]:
                    covered.add((lang, p[i : i + size]))
    result = []
    for (lang, p), a in often.items():
        if (lang, p) in covered:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        result.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, place = [], Counter()
    for lang, score, a, phrase, left, right in sorted(result):
        place[lang] += 1
        if place[lang] <= spec.top:
            out.append((lang, place[lang], phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def _rows(seed, n, hot):
    rng = random.Random(seed)
    pool = ["a", "b", "C", "d-d", "é", "中文", "e'", "\x00f"] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        words = [rng.choice(pool[: rng.choice([3, 8, 38])]) for _ in range(rng.randrange(0, 60))]
        if rng.random() < hot:
            words = [w for x in words for w in ("very", "common", x)]
        gaps = [rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " : "]) for _ in words]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(w + g for w, g in zip(words, gaps))))
    return rows


def _found(docs, spec):
    return sorted(tuple(r) for r in collocations.find_collocations(docs, spec).collect())


@pytest.mark.parametrize("bits", [4, 16])  # with 4 all pairs share counters
def test_against_plain_version(spark, bits):
    rows = _rows(1, 400, 0.1)
    spec = Collocations(least=6, bits=bits)
    assert _found(_table(spark, rows).repartition(3), spec) == _expected(rows, spec)
    assert len(_expected(rows, spec)) > 50


def test_hot_leading_words_are_routed_deeper(spark, monkeypatch):
    rows = _rows(2, 300, 0.6)
    spec = Collocations(least=8, percent=60, top=40, longest=4)
    depths = set()
    added = collocations._Sums.add

    def watched(self, lang, of, texts, n, depth):
        depths.update(depth.tolist())
        return added(self, lang, of, texts, n, depth)

    monkeypatch.setattr(collocations, "_ROUTE_ROWS", 100)
    monkeypatch.setattr(collocations._Sums, "add", watched)
    docs = _table(spark, rows)
    assert _found(docs.repartition(4), spec) == _expected(rows, spec)
    # the same in this process, to see what rows are routed by
    lang, text = (pa.array([r[i] or "und" if i == 0 else r[i] for r in rows]) for i in range(2))
    batch = pa.RecordBatch.from_arrays([lang, text], ["lang", "text"])
    flags = []
    packed = [b for b in collocations._words_and_pairs(16)([batch])]
    chosen = [pa.RecordBatch.from_arrays([b.column("block"), b.column("packed")], ["block", "packed"]) for b in packed if b.column("packed").null_count == 0]
    for source in (chosen, None):
        source = source or list(collocations._longer_runs(flags[0][0], 16, 4)([batch]))
        result = list(collocations._add_up(8, 10)(source))
        flags.append(tuple(np.frombuffer(result[0].column(i)[0].as_py(), dtype=np.uint8) for i in (1, 2)))
    list(collocations._truncated_suffixes(*flags, spec, 16)([batch]))
    assert {2, 3, 4} <= depths


def test_rows_of_suffixes_do_not_grow_with_the_parts_of_the_input(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    sort = collocations._sort

    def counted(spec):
        run = sort(spec)

        def count(table):
            seen.add(table.num_rows)
            return run(table)

        return count

    monkeypatch.setattr(collocations, "_sort", counted)
    rows = [("en", "a b c d e f g")] * 240
    spec = Collocations(least=100)
    made = []
    for parts in (8, 40):
        before = seen.value
        assert _found(_table(spark, rows).repartition(parts), spec) == _expected(rows, spec)
        made.append(seen.value - before)
    assert made[0] == made[1] <= 6 * spark.sparkContext.defaultParallelism


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_HELD", 50)
    rows = [("en", None), ("en", ""), (None, " \n\t"), (None, "x y"), ("und", "X\ty z"), ("en", "x y"), ("en", "x y"),
            ("de", "a " * 30_000), ("de", "b" * 200_000 + " b"), ("", "x y. x  y"), ("en", "one"), ("en", "x.y")]
    spec = Collocations(least=2)
    assert _found(_table(spark, rows).coalesce(1), spec) == _expected(rows, spec)
    few = [("en", "x y z")]
    assert _found(_table(spark, few), Collocations(least=1)) == _expected(few, Collocations(least=1))
    assert collocations.find_collocations(_table(spark, [])).count() == 0


def test_equal_parts_give_up_infrequent_ones():
    columns = np.array([[0] * 6, [1, 1, 1, 1, 2, 2], [3, 3, 3, 4, 3, 3], [5, 5, 0, 5, 5, 6]])
    weights, depths = np.array([4, 3, 2, 9, 1, 1]), np.full(6, 2)
    parts = collocations.equal_parts(columns, weights, depths, 5)
    assert sorted((tuple(columns[1 : s + 1, r]), n) for r, s, n in parts) == [((1, 3), 9), ((1, 3, 5), 7), ((1, 4), 9), ((1, 4, 5), 9)]
    deep = collocations.equal_parts(columns, weights, np.array([2, 2, 2, 2, 3, 3]), 5)
    assert ((2, 3), 2) in [(tuple(columns[1 : s + 1, r]), n) for r, s, n in deep]


def test_large_numbers_are_exact(spark):
    a, n, left, right = 123_456_789_012_345, 987_654_321_987_654_321, 999_999_999_999_937, 333_333_333_333_331
    phrases = spark.createDataFrame([("en", "p q", 2, a)], "lang string, phrase string, size int, a long")
    parts = spark.createDataFrame([("en", "p", left), ("en", "q", right)], "lang string, phrase string, a long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    row = collocations._scored(phrases, parts, totals).first()
    assert (row.score, row.l, row.r, row.n) == (1000 * a * n // (left * right), left, right, n)
