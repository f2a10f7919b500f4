"""People under several titles and without one, national numbers, check digits."""

import random
import re

import pytest

from rankwright.llm import pii

SPEC = pii.PiiSpec(key="k")


def _replace(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in pii.replace_pii(docs, SPEC).collect()}
    return [rows[i] for i in range(len(texts))]


def test_one_person_stays_one(spark):
    text = "Mr. John Smith came. John Smith said hello. Smith left. Dr. John Smith too. SMITH's dog; Smithson, smith stay."
    new, other, plain = _replace(spark, [text, "Mrs Smith and Ms. Kim Lee", "John Smith, without a title"])
    pattern = r"Mr\. (\w+) (\w+) came\. (\w+) (\w+) said hello\. (\w+) left\. Dr\. (\w+) (\w+) too\. (\w+)'s dog; Smithson, smith stay\."
    m = re.fullmatch(pattern, new.text)
    assert m[1] == m[3] == m[6] != "John" and m[2] == m[4] == m[5] == m[7] == m[8].capitalize() != "Smith" and m[8].isupper()
    assert new.n_entities == 6
    two = re.fullmatch(r"Mrs (\w+) and Ms\. (\w+) (\w+)", other.text)
    assert two[1] == m[2] and two[3] != m[2] and two[2] in pii.FIRST_NAMES["latin", "f"].split()
    assert plain.n_entities == 0 and plain.text == "John Smith, without a title"


def test_mentions_against_a_plain_version(spark):
    """Texts are put together of items whose entities are known; each must become its own surrogate."""
    rng = random.Random(4)
    men, women = [f"Mab{c}or" for c in "abcdefghijklmnopqrstuvw"], [f"Fen{c}ia" for c in "abcdefghijklmnopqrstuvw"]
    families = ["O'Barr", "Voss-Hale", *(f"Gr{a}{b}st" for a in "aeiou" for b in "klmnp")]
    texts, planted = [], []
    for _ in range(150):
        items = []
        for _ in range(rng.randint(0, 4)):
            man, last = rng.random() < 0.5, rng.choice(families)
            first = rng.choice(men if man else women)
            g = "m" if man else "f"
            items.append((rng.choice(pii.TITLES[g][:2]) + rng.choice([" ", ". "]), [(g, first), (last,)]))
            for _ in range(rng.randint(0, 3)):
                title = rng.choice(["", "Dr. ", "Prof "])
                items.append((title, [(g, first), (last,)]) if title or rng.random() < 0.5 else ("", [(last,)]))
        rng.shuffle(items)
        items = [("plain words, ", [])] + [x for i in items for x in (i, ("; Other Words and ", []))]
        planted.append(items)
        texts.append("".join(t + " ".join(e[-1] for e in es) for t, es in items))
    given = {}
    for row, items in zip(_replace(spark, texts), planted):
        assert row.n_entities == sum(1 if t else len(es) for t, es in items if es)
        name = r"([\w'’-]+)"
        m = re.fullmatch("".join(re.escape(t) + " ".join(name for _ in es) for t, es in items), row.text)
        assert m, row.text
        for entity, new in zip((e for _, es in items for e in es), m.groups()):
            assert given.setdefault(entity, new) == new != entity[-1]
    assert len(given) > 60 and len(set(given.values())) == len(given)
    assert not set(given.values()) & {*men, *women, *families}


@pytest.mark.parametrize("number", [
    "06 12 34 56 78", "06.12.34.56.78", "030 1234567", "089/12345678", "090-1234-5678", "03-1234-5678", "0120-12-3456",
    "2001:db8::ff00:42:8329", "fe80:0:0:0:0:0:0:1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334",
])
def test_further_numbers(spark, number):
    once, twice = _replace(spark, [f"at {number}.", f"({number}) and {number}"])
    assert once.n_entities == 1 and twice.n_entities == 2
    new = once.text[3:-1]
    assert new != number and twice.text == f"({new}) and {new}"
    shape = re.compile("[0-9a-f]" if ":" in number else "[0-9]")
    assert shape.sub("#", new) == shape.sub("#", number)
    if ":" not in number:
        assert new[0] == "0"


def test_what_is_no_number(spark):
    texts = ["12:30:45", "std::vector and a::b", "01-02-2024", "0.12.34", "1:2:3:4", "v01 2345678", "10 20 30 40 50"]
    assert [(r.n_entities, r.text) for r in _replace(spark, texts)] == [(0, t) for t in texts]


def test_account_numbers_keep_valid_check_digits(spark):
    (row,) = _replace(spark, ["GB82 WEST 1234 5698 7654 32 and DE89370400440532013000"])
    m = re.fullmatch(r"(GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) and (DE\d{20})", row.text)
    for iban in m.groups():
        moved = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def test_long_texts_with_people(spark):
    long = "Mr Ab " * 150_000
    hyphens, row, many = _replace(spark, ["Mr " + "Ab-" * 300_000, long, " ".join(f"Mr. N{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)) * 20])
    assert row.n_entities == 150_000 and len(set(row.text.split())) == 2 and "Ab" not in row.text.split()
    assert hyphens.n_entities >= 1 and many.n_entities >= 11_900
