"""Candidates of the decontamination: found without pairing windows with items that share nothing."""

import random
from collections import Counter

from rankwright.llm import decontaminate


def _search(docs, bench, spec=decontaminate.LeakSpec()):
    """The tables between the steps of the search, for items of five words or more."""
    docs = decontaminate._numbered(docs)
    cut = lambda text: decontaminate._cuts(decontaminate._words(text), [spec.words])
    items = bench.select("item_id", cut(bench.text)[0].alias("hs")).selectExpr("item_id AS item", "0 AS k", "hs", "size(hs) AS m")
    index = items.selectExpr("k", "m", "item", "explode(array_distinct(hs)) AS h")
    cuts = docs.select("doc_id", "row", cut(docs.text).alias("cuts"))
    places = decontaminate._places(cuts, index)
    return decontaminate._windows(cuts, places, spec), decontaminate._sharing(places, index, spec)


def test_few_candidates(spark):
    """500 items of one size and 500 documents that hold a piece of one item each."""
    items = [[f"i{n}x{k}" for k in range(49)] for n in range(500)]
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in enumerate(items)], "item_id long, text string")
    rows = [(n, " ".join([f"d{n}x{k}" for k in range(60)] + items[n][20:25] + [f"e{n}x{k}" for k in range(60)])) for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows, shared = _search(docs, bench)
    # a place is among the first 6 of 45 shingles of 6 windows, and one item holds it
    assert windows.count() == 3000 and shared.count() == 3000
    assert decontaminate.find_leaks(docs, bench).count() == 0


def test_items_of_all_sizes_against_brute_force(spark):
    """Items of 1 to 40 words with repeated words, planted with changed words, in texts of few words."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(12)}"
    items = [[word() + "ab"[n % 2] * (n < 4) for _ in range(1 + n)] for n in range(4)]
    items += [[word() for _ in range(rng.randrange(5, 40))] for _ in range(20)]
    texts = []
    for n in range(120):
        item = list(items[n % len(items)])
        for _ in range(n % 3):
            item[rng.randrange(len(item))] = word()
        texts.append([word() for _ in range(rng.randrange(20))] + item + [word() for _ in range(rng.randrange(20))])
    bench = spark.createDataFrame([(n, " ".join(i)) for n, i in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    expected = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            size = min(5, len(item))
            own = Counter(tuple(item[k : k + size]) for k in range(len(item) - size + 1))
            for start in range(len(text) - len(item) + 1):
                window = text[start : start + len(item)]
                here = Counter(tuple(window[k : k + size]) for k in range(len(item) - size + 1))
                both, either = (own & here).total(), (own | here).total()
                if 100 * both >= 80 * either and both / either > expected.get((d, i), (0, 0))[0]:
                    expected[d, i] = (both / either, start)
    found = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == expected and any(s < 1 for s, _ in expected.values())
