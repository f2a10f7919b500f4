"""The queries that SQL cannot express, against brute force; tests/test_queries.py has the others."""

import hashlib
import re

import pytest
import corpus_pipeline
from rankwright.llm import catalog, secrets


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").cache()


def test_secrets_against_plain_patterns(spark, folder, docs):
    found = {r.doc_id: r for r in catalog.QUERIES["op10_secrets"](spark, folder).collect()}
    assert len(found) == docs.count()
    patterns = (secrets._ASSIGN, secrets._ACCESS, secrets._HEX)
    good = (lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24)
    for r in docs.collect():
        spans = sorted(
            (m.start(), k, m.end()) for k, (p, ok) in enumerate(zip(patterns, good)) for m in p.finditer(r.text) if ok(m)
        )
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        row = found[r.doc_id]
        assert row.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_leaks_against_brute_force(spark, folder, docs):
    def shingles(text):
        words = re.sub(r"[^\w\s]|_", "", text.lower()).split()
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    expected = set()
    for r in docs.collect():
        own = shingles(r.text)
        at = {}
        for i, s in enumerate(own):
            at.setdefault(s, []).append(i)
        for item, wanted in items.items():
            starts = {p - d for s in wanted for p in at.get(s, []) for d in range(len(wanted))}
            for start in starts:
                window = own[max(0, start) : start + len(wanted)]
                both = sum(min(window.count(s), wanted.count(s)) for s in set(window))
                if len(window) == len(wanted) and 100 * both >= 80 * (2 * len(wanted) - both):
                    expected.add((r.doc_id, item))
    found = catalog.QUERIES["op3_decontaminate"](spark, folder)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == expected


def test_toxicity_tells_held_out_documents_apart(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = catalog.QUERIES["op2_toxicity"](spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", "toxic").collect()
    toxic = [r.score for r in rows if r.toxic]
    clean = [r.score for r in rows if not r.toxic]
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean)
    assert above / (len(toxic) * len(clean)) > 0.94
    assert all(0 <= r.score <= 1 for r in rows)


def test_pii_is_gone_and_the_rest_stays(spark, folder, docs):
    entity = re.compile(r"[\w.]+@[\w.]+\w|(?<!\d)\d{16}(?!\d)|\+\d \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)")
    old = {r.doc_id: r.text for r in docs.collect()}
    new = {r.doc_id: r.text for r in catalog.QUERIES["op4_pii"](spark, folder).collect()}
    assert old.keys() == new.keys()
    given = {}
    for doc, text in old.items():
        a, b = entity.findall(text), entity.findall(new[doc])
        assert len(a) == len(b)
        assert entity.sub("", text) == entity.sub("", new[doc])
        for x, y in zip(a, b):
            assert given.setdefault(x, y) == y and x != y
    assert given and len(set(given.values())) == len(given)


def test_pipeline_stages(spark, folder, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    by = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, kept, folder)
        assert set(docs.columns) <= set(result.columns)
        path = f"{corpus_pipeline.write_table(result, name).inputFiles()[0].rsplit('/', 1)[0]}"
        kept = spark.read.parquet(path)
        by[name] = kept.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in by.items()}
    scores = {r.doc_id: r.score for r in catalog.QUERIES["op2_toxicity"](spark, folder).collect()}
    assert ids["toxicity"] == {d for d, s in scores.items() if s < 0.5}
    assert ids["near_dedup"] == _one_of_each(by["toxicity"])
    leaks = {r.doc_id for r in catalog.QUERIES["op3_decontaminate"](spark, folder).collect()}
    assert ids["decontamination"] == ids["near_dedup"] - leaks
    assert ids["pii"] == ids["decontamination"]
    assert all(r.n_chars == len(r.text) for r in by["pii"])
    copies = {}
    for r in by["mixing"]:
        copies.setdefault(r.doc_id, []).append(r.repetition)
    assert all(sorted(n) == list(range(1, len(n) + 1)) and len(n) <= 2 for n in copies.values())
    assert {r.doc_id for r in by["mixing"]} <= ids["pii"]


def _one_of_each(rows):
    """The smallest doc_id of each group of documents linked by 5-word shingles, by brute force."""
    sets = {}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    return {d for d, g in group.items() if d == g}
