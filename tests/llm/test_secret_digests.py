"""Named digests are known strings, whatever stands around them."""

import base64
import hashlib

import pytest

from rankwright.llm import secrets


def _spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.spans for r in secrets.find_secrets(docs).orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["sha1", "sha256", "sha384", "sha512"])
def test_digests_in_base64(spark, name):
    texts, wrong = [], []
    for i in range(40):
        value = base64.b64encode(hashlib.new(name, str(i).encode()).digest()).decode()
        texts += [f"integrity {name}-{value} here", f'"integrity":"{name}-{value}"', f"integrity={name}-{value}"]
        wrong.append(f"integrity {name}-{value.rstrip('=')[:-4]} here")  # cut, so no digest
    assert set(_spans(spark, texts)) == {""}
    assert all("random:" in s for s in _spans(spark, wrong))


def test_random_strings_beside_digests_stay(spark):
    value = base64.b64encode(hashlib.sha256(b"x").digest()).decode()
    text = f"sha256-{value} and kX92vQzL0pT7rWb4NsYc8GhJ"
    start = text.index("kX92")
    assert _spans(spark, [text]) == [f"random:{start}:{len(text)}"]
