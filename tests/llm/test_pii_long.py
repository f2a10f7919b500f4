"""Long runs of one class of characters take linear time."""

import time

import pytest

from rankwright.llm import pii


@pytest.mark.parametrize("unit", ["0123456789abcdef", "x", "a.", "a@", "x@a.a.a.", "+1 ", "Ab "])
def test_a_megabyte_without_an_end(spark, unit):
    text = (unit * 1_000_000)[:1_000_000]
    docs = spark.createDataFrame([(1, text), (2, f"a@{text}"), (3, f"{text} a.b@example.org")], "doc_id long, text string")
    begin = time.monotonic()
    rows = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    assert time.monotonic() - begin < 90
    assert rows[3].n_entities >= 1 and not rows[3].text.endswith("a.b@example.org")
