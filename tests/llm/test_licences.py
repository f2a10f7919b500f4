"""Licence scans: places of phrases and templates against a plain version, odd rows."""

import math
import random
import re

import pytest

from rankwright.llm import licences
from rankwright.llm.licences import PHRASES, TEMPLATES, LicenceSpec

SCHEMA = "doc_id long, text string, word string, n string, labels string, score string, n_words string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA)


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", lower)


def _expected(docs):
    """Every template laid at every place of every text."""
    texts = [_words(t) for _, t in docs]
    known = {w for _, t, *_ in (*PHRASES, *TEMPLATES) for w in _words(t)}
    weight = {w: 1 + math.floor(1000 * math.log((len(docs) + 1) / (sum(w in t for t in map(set, texts)) + 1))) for w in known}
    rows = []
    for (doc, _), words in zip(docs, texts):
        base, labels, score = [], set(), 0.0
        for label, text in PHRASES:
            phrase = _words(text)
            base += [(i, label) for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        if base:
            score = 1.0
        for label, text, keys in TEMPLATES:
            model = _words(text)
            total = sum(weight[w] for w in model)
            for start in range(1 - len(model), len(words)):
                own = [words[start + i] if 0 <= start + i < len(words) else None for i in range(len(model))]
                held = sum(weight[w] for w, o in zip(model, own) if w == o)
                within = [any(own[i : i + len(k)] == k for i in range(len(own))) for k in map(_words, keys)]
                if 100 * held >= 80 * total and all(within):
                    labels.add(label)
                    score = max(score, held / total)
        names = {label for _, label in base}
        first, last = (min(base)[0], max(base)[0]) if base else (None, None)
        rows.append((doc, len(words), len(base), first, last, ",".join(sorted(names)), ",".join(sorted(names | labels)), score))
    return sorted(rows, key=repr)


def _same(found, docs):
    assert sorted((tuple(r) for r in found.collect()), key=repr) == _expected(docs)


def test_against_plain_version(spark):
    rng = random.Random(7)
    pool = sorted({w for _, t, *_ in (*PHRASES, *TEMPLATES) for w in _words(t)})
    docs = []
    for i in range(120):
        words = [rng.choice([*pool, "filler", "é", "x1"]) for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(0, 3)):
            _, text, *_ = rng.choice((*PHRASES, *TEMPLATES))
            quoted = re.split(r"(\W+)", text)
            for _ in range(rng.randrange(0, 3)):
                quoted[rng.randrange(len(quoted) // 2) * 2] = rng.choice(["other", "words here", ""])
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["".join(quoted)[rng.randrange(2) * 9 :]]
        docs.append((i, rng.choice([" ", "\n", " - "]).join(words)))
    assert sum("," in r[6] or bool(r[6]) for r in _expected(docs)) > 40
    _same(licences.find_licences(_table(spark, docs).repartition(3)), docs)


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \n"), (None, "All rights reserved."), (4, "x " * 4_000 + "ALL-RIGHTS\tReserved"),
        (5, "cc by"), (5, "cc by"), (6, "by"), (7, "rights reserved all"), (8, "cc"), (9, "by cc by-nc 4.0 cc by"),
        (10, "a" * 300_000), (11, "released under the mit"), (12, "License"),
    ]
    _same(licences.find_licences(_table(spark, docs).coalesce(1)), docs)
    assert licences.find_licences(_table(spark, [])).count() == 0


def test_own_templates(spark):
    spec = LicenceSpec(templates=[("own", "a b a c", ("b a",))], phrases=[("twice", "z z")], percent=50)
    found = licences.find_licences(_table(spark, [(1, "z z z a b a q"), (2, "a b q c"), (3, "c z")]), spec)
    rows = {r.doc_id: r for r in found.collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].labels) == (2, 0, 1, "own,twice")
    assert rows[2].labels == "" and rows[3].labels == ""


@pytest.mark.parametrize("percent", [1, 80, 100])
def test_a_fit_holds_an_indexed_word(percent):
    spec = LicenceSpec(percent=percent)
    weights = {w: 1 + len(w) for w in licences.vocabulary(spec)}
    index = licences._Index(spec, weights)
    for template in index.templates:
        total, held = template.weights.sum(), template.weights[template.rarest()].sum()
        assert template.phrase or 100 * (total - held) < percent * total
