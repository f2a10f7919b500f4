"""Tables whose other columns have the names that the operators use themselves; odd rows in the stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rankwright.llm import decontaminate, mixing, near_dup, pii, toxicity

OWN = [
    "_row", "_id", "_ID", "_mentions", "_place", "_mention", "_pieces", "_new", "m", "kind", "canonical", "surrogate",
    "doc", "end", "begin", "times", "left_over", "words", "before", "last", "slice", "_source", "key", "s", "row",
    "item", "start", "shared", "node", "component", "low", "high", "n", "score", "passages", "evidence", "repetition",
    "n_words", "kept", "bases", "a", "b", "away", "comp", "total", "copies", "size", "target", "taken", "source_size",
]
REPLACED = {"n_entities", "size", "source_size", "target", "taken", "copies", "repetition"}
TEXTS = [
    (1, "Mr. John Smith wrote to a.b@example.org " + "word " * 30), (2, "plain text of five words"), (2, "plain text of five words"),
    (3, None), (4, ""), (5, " \t\n"), (None, "nobody knows this text"), (None, None), (6, "long " * 30_000), (7, "x" * 200_000),
    (8, "Call +1 (555) 123-4567 or write to a.b@example.org"), (9, "this item leaks from the benchmark into a text"),
]


@pytest.fixture(scope="module")
def clashing(spark):
    own = list(dict((n.lower(), n) for n in OWN).values())
    rows = [(d, t, ["a", "b", None][i % 3], *[f"{n}{i}" for n in own]) for i, (d, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in own)
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "this item leaks from the benchmark into", "x"), (2, None, "x"), (3, "", "x")]
    return spark.createDataFrame(rows, "item_id long, text string, _row string")


def _kept(result, docs, replaced=()):
    """Every column but the replaced ones is as it was in the row it came from."""
    names = [c for c in docs.columns if c not in replaced and c != "text"]
    given = {tuple(r) for r in docs.select(*names).collect()}
    found = [tuple(r) for r in result.select(*[F.col(f"`{n}`") for n in names]).collect()]
    assert set(found) <= given
    return len(found)


def test_operators_keep_clashing_columns(clashing, bench):
    n = clashing.count()
    assert _kept(pii.replace_pii(clashing), clashing, REPLACED) == n
    assert _kept(mixing.mix(clashing), clashing, REPLACED) == n
    assert _kept(decontaminate.remove_leaks(clashing, bench), clashing) == n - 1
    assert 0 < _kept(near_dup.keep_one_of_each(clashing), clashing) < n


def test_stages_keep_clashing_columns(spark, clashing, bench, tmp_path):
    labels = [(d, 0, d % 2) for d in range(1, 10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (clashing, clashing.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            result = stage(spark, docs, str(tmp_path))
            assert set(docs.columns) <= set(result.columns), name
            count = _kept(result, docs, REPLACED if name in ("pii", "mixing") else ())
            assert count or docs.isEmpty() or name == "toxicity"


def test_labels_are_not_needed_for_an_empty_table(spark, clashing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(clashing, labels)
    assert _kept(toxicity.drop_toxic(clashing, model), clashing) <= clashing.count()
