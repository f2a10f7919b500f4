"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankwright.llm import (
    chat, decontaminate, mixing, near_dup, pii, secrets, substring, superminhash, toxicity, vptree, warc,
)

# columns whose names the operators use themselves
CLASHING = "node string, key string, low string, n_words string, kept string, bases string, size string, target string"
SCHEMA = f"doc_id long, text string, source string, {CLASHING}"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    words = [f"w{i % 97}" for i in range(30_000)]
    long = " ".join(words)
    rows = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (3, None, None), (4, "", "b"), (5, " \t\n", None),
        (6, "One", "b"), (7, "one", None), (8, "two words", "b"), (None, "two words", "b"), (None, None, None),
        (9, "x " * 60, "c"), (10, "y " + "x " * 55, "c"), (11, "two words", "b"), (11, "other text here", "b"),
    ]
    return _docs(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return _docs(spark, [])


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for seed in range(40):
        pool = rng.integers(0, 2**63, 500).astype(np.uint64)
        sets = [pool[:400], pool[100:]]
        first = np.array([0, 400, 800])
        least = superminhash.signatures(np.concatenate(sets), first, 200, seed)
        errors.append((least[0] == least[1]).mean() - 300 / 500)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.034  # independent minima: 0.0346
    tiny = superminhash.signatures(np.array([7], dtype=np.uint64), np.array([0, 1, 1]), 64)
    assert sorted(np.floor(tiny[0])) == list(range(64)) and np.isinf(tiny[1]).all()


def test_near_duplicates(odd, nothing):
    rows = near_dup.near_duplicates(odd, near_dup.NearDup(words=2)).collect()
    assert len(rows) == odd.count()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    for row in [(1, 97, 1, True), (2, 97, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]:
        assert row in got
    for row in [(6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True), (11, 1, 8, False), (11, 2, 8, False)]:
        assert row in got
    assert (None, 1, None, True) in got and (None, 0, None, True) in got
    assert near_dup.near_duplicates(nothing).count() == 0
    kept = near_dup.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 8, 9, 10]
    assert near_dup.keep_one_of_each(nothing).count() == 0


def test_near_duplicates_against_brute_force(spark):
    """Chains of edits around the limit, in which components need links between any members."""
    rng = random.Random(3)
    base = [f"t{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(2000)}"
        rows.append((i, " ".join(words), "s"))
    sets = {d: {tuple(t.split()[k : k + 2]) for k in range(119)} for d, t, _ in rows}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    assert len(set(group.values())) > 5
    found = near_dup.near_duplicates(_docs(spark, rows), near_dup.NearDup(words=2)).collect()
    assert {r.doc_id: r.component_id for r in found} == group


def _segments_by_force(values):
    """Maximal segments by their definition: take the best, then go on left and right of it."""
    if not values or max(values) <= 0:
        return []
    spans = [(sum(values[i:j]), -(j - i), -i) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
    best, length, start = max((round(s, 9), n, i) for s, n, i in spans)
    a, b = -start, -start - length
    left, right = _segments_by_force(values[:a]), _segments_by_force(values[b:])
    return left + [(a, b - 1, best)] + [(x + b, y + b, s) for x, y, s in right]


def test_maximal_segments():
    rng = random.Random(1)
    for _ in range(200):
        hits = {i: rng.choice([0.7, 1.3, 2.9]) for i in range(25) if rng.random() < 0.3}
        values = [hits.get(i, -0.41) for i in range(25)]
        found = toxicity.maximal_segments(sorted(hits.items()), 0.41)
        assert [(a, b, round(s, 6)) for a, b, s in found] == [(a, b, round(s, 6)) for a, b, s in _segments_by_force(values)]


def test_toxicity(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int"
    )
    texts = [(i, f"plain words number {i % 7} " + ("you vile creature" if i < 60 else "and more"), "s") for i in range(400)]
    model = toxicity.fit_toxicity(_docs(spark, texts), labels)
    scored = {r.doc_id: r for r in toxicity.score_toxicity(_docs(spark, texts), model).collect()}
    assert all((scored[i].score >= 0.5) == (i < 60) for i in range(400))
    assert scored[3].passages[0].score > 0 and scored[3].n_words >= 6
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 for r in rows)
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.drop_toxic(_docs(spark, texts), model).count() == 340
    for none in (labels.limit(0), labels.filter("toxic = 0")):
        flat = toxicity.fit_toxicity(_docs(spark, texts), none)
        assert {r.score < 0.01 for r in toxicity.score_toxicity(odd, flat).collect()} == {True}


def test_decontamination(spark, odd, nothing):
    bench = spark.createDataFrame(
        [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa", 0), (2, "Short item", 1), (3, None, 2), (4, " ", 3), (2, "Short item", 1)],
        "item_id long, text string, h int",
    )
    docs = _docs(spark, [
        (20, "so ALPHA, beta. gamma delta epsilon zeta eta theta iota kappa and so on", "s"),
        (21, "alpha beta gamma delta epsilon zeta eta theta iota other", "s"),
        (22, "alpha beta gamma delta other zeta eta theta iota kappa", "s"),
        (23, "a short item here", "s"), (None, "short item", "s"), (24, None, None), (25, "", "s"),
    ])
    found = decontaminate.find_leaks(docs.unionByName(odd), bench)
    assert {(r.doc_id, r.item_id, r.start, r.n_words, r.similarity) for r in found.collect()} == {
        (20, 1, 1, 10, 1.0), (23, 2, 1, 2, 1.0), (None, 2, 0, 2, 1.0),
    }
    left = decontaminate.remove_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {20, 23} & {r.doc_id for r in left.collect()} == set()
    assert decontaminate.find_leaks(nothing, bench).count() == 0
    assert decontaminate.remove_leaks(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_of_repeated_rows(spark):
    """Items and documents listed several times, and rows without doc_id that are told apart."""
    item = " ".join(f"i{k}" for k in range(25))
    again = " ".join(["one two three four five six seven"] * 4)  # its shingles occur several times
    once = " ".join(f"s{k}" for k in range(30))
    rows = [(1, item), (1, item), (1, item), (2, again), (2, again), (3, once)]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    near = item.replace("i24", "other") + " at the end of it"
    less = " ".join(["one two three four five six seven"] * 2 + [f"n{k}" for k in range(14)])
    docs = _docs(spark, [
        (1, f"a {item} b", "s"), (1, f"a {item} b", "s"), (2, near, "s"), (2, near, "s"), (2, near, "s"),
        (None, f"c d {item}", "s"), (None, f"c d {item}", "s"), (None, "nothing of " + " ".join(f"o{k}" for k in range(40)), "s"),
        (3, less, "s"), (3, less, "s"), (3, less, "s"), (4, again, "s"), (4, again, "s"),
        (5, item, "s"), (6, once, "s"), (6, once, "s"),
    ])
    found = {(r.doc_id, r.item_id, r.start, r.similarity) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert found == {(1, 1, 1, 1.0), (2, 1, 0, 20 / 22), (None, 1, 2, 1.0), (4, 2, 0, 1.0), (5, 1, 0, 1.0), (6, 3, 0, 1.0)}
    left = decontaminate.remove_leaks(docs, bench).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text[:7]) for r in left) == [(0, "nothing")] + [(3, "one two")] * 3


def test_decontamination_at_the_limit(spark):
    """Windows that share 40 of 45 shingles, a similarity of 0.8, for which prints differ most."""
    item = [f"i{k}" for k in range(49)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = _docs(spark, [(d, " ".join(item[:44] + [f"d{d}x{k}" for k in range(5)]), "s") for d in range(400)])
    found = decontaminate.find_leaks(docs, bench).collect()
    assert {r.doc_id for r in found} == set(range(400)) and {r.similarity for r in found} == {0.8}


def test_pii(spark, odd, nothing):
    docs = _docs(spark, [
        (1, "Mr. John Smith and Mrs Smith met Mr John Smith; mail A.b9@site.org, a.b9@SITE.org", "s"),
        (2, "call +1 (743) 555-3824 or +17435553824, card 4111 1111 1111 1111 and 4111111111111111", "s"),
        (3, None, None), (4, "", "s"), (None, "г-жа Анна Петрова 10.0.0.1", "s"), (2, "version 1.2.3 of 2024-01-02", "s"),
    ])
    new = pii.replace_pii(docs, pii.PiiSpec(key="k"))
    assert new.columns == [*docs.columns, "n_entities"]
    rows = {(r.doc_id, r.n_entities): r.text for r in new.collect()}
    one = re.fullmatch(r"Mr\. (\w+ \w+) and Mrs (\w+) met Mr (\w+ \w+); mail (\S+), (\S+)", rows[1, 5])
    assert one[1] == one[3] and one[1].split()[0] in pii.FIRST_NAMES["latin", "m"].split() and one[4] == one[5]
    two = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10}), card (4\d{3}(?: \d{4}){3}) and (\d{16})", rows[2, 4])
    assert two[1] + two[2] + two[3] == two[4] != "7435553824" and two[5].replace(" ", "") == two[6]
    digits = [int(c) for c in reversed(two[6])]
    assert sum(d if i % 2 == 0 else sum(map(int, str(2 * d))) for i, d in enumerate(digits)) % 10 == 0
    assert rows[3, 0] is None and rows[4, 0] == "" and rows[2, 0] == "version 1.2.3 of 2024-01-02"
    assert re.fullmatch(r"г-жа [А-я]+ [А-я]+ \d+\.\d+\.\d+\.\d+", rows[None, 2]) and "Анна Петрова" not in rows[None, 2]
    assert new.exceptAll(pii.replace_pii(docs, pii.PiiSpec(key="k"))).count() == 0
    assert pii.replace_pii(nothing).count() == 0
    assert pii.replace_pii(odd).filter("n_entities > 0").count() == 0


def test_surrogates_stay_distinct(spark):
    """Numbers of two digits: nearly all hundred are taken, so most draws collide."""
    known = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(40)], "kind string, canonical string")
    given = pii.assign_surrogates(known, pii.PiiSpec(most_attempts=200)).collect()
    new = {r.surrogate for r in given}
    assert len(given) == len(new) == 40 and not new & {f"{i:02d}" for i in range(40)}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)).astype(np.float32)
    vectors[100:160] = vectors[7]  # one vector very often
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(500, None), (550, [0.0] * 8), (600, [float("nan")] * 8), (650, [1.0, None] * 4), (700, [1.0, 2.0]), (None, [1.0] * 8), (3, rows[3][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    found = vptree.nearest(table, F.col("vec_id") % 50 == 0, vptree.VpSpec(shard=64, block=4, leaf=8))
    exact = np.array([v for v in vectors], dtype=np.float64)
    expected = []
    for q in range(0, 400, 50):
        scores = vptree.cosine(np.broadcast_to(exact[q], exact.shape), exact)
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:5]
        expected += [(q, n + 1, int(i), float(scores[i])) for n, i in enumerate(order)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    relaxed = vptree.nearest(table, F.col("vec_id") % 50 == 0, vptree.VpSpec(shard=64, block=4, leaf=8, factor=1.5))
    hits = {(r.query_id, r.vec_id) for r in relaxed.collect()} & {(q, i) for q, _, i, _ in expected}
    assert len(hits) >= 0.9 * len(expected)
    assert vptree.nearest(table.limit(0), F.lit(True)).count() == 0


def test_mixing(odd, nothing, spark):
    mixed = mixing.mix(odd)
    assert sorted(mixed.columns) == sorted({*odd.columns, "size", "source_size", "target", "taken", "copies"})
    rows = mixed.collect()
    assert len(rows) == odd.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {r.source: r for r in rows}
    assert by["a"].source_size == 90_000 and by[None].source_size == 1
    assert mixing.mix(nothing).count() == 0
    many = _docs(spark, [(i, "w " * (5 + i % 9), "abc"[i % 3] if i % 2 else "a") for i in range(3000)])
    taken = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 14 for r in taken)


def test_archives(spark, tmp_path):
    ugly = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", ugly), (2, None, ugly), (3, "u", None), (4, "u", ""), (None, "n", "only"), (5, "v", "é"), (5, "v", "é"), (6, "w", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    found = warc.archive_and_read(pages).collect()
    got = sorted(str((r.page_id, r.payload_bytes, r.record_type, r.refers_to)) for r in found)
    assert got == sorted(map(str, [
        (1, len(ugly), "response", None), (2, len(ugly), "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3),
        (None, 4, "response", None), (5, 2, "response", None), (5, 2, "revisit", 5), (6, 2, "revisit", 5),
    ]))
    assert warc.archive_and_read(pages.limit(0)).count() == 0
    path = str(tmp_path / "w")
    warc.write_archive(pages, path, warc.WarcSpec(date="2024-01-01T00:00:00Z"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert len(list(warc.parse_records(gzip.decompress(raw)))) == len(rows)


def _repeats_by_force(rows, size):
    texts = [(d, re.findall(r"[^\x20\x09-\x0d]+", t or "")) for d, t in rows]
    least = {}
    for d, w in texts:
        for i in range(len(w) - size + 1):
            if d is not None:
                key = tuple(w[i : i + size])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if d is not None and least[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark, odd, nothing):
    rng = random.Random(4)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.randrange(8, 30))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"u{rng.randrange(5000)}" for _ in range(9)) for _ in range(5)]
        rows.append((i // 2 if i % 10 == 0 else i, " ".join(parts), "s"))
    spec = substring.RepeatSpec(window=10, block=5, hashes_per_range=700, words_held=500)
    docs = _docs(spark, rows).repartition(4).unionByName(odd)
    found = sorted(map(tuple, substring.remove_repeats(docs, spec).collect()), key=str)
    assert found == _repeats_by_force([(r.doc_id, r.text) for r in docs.collect()], 10)
    assert substring.remove_repeats(nothing).count() == 0


def test_chat_parts_and_escapes(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\|end|> <|end|> <\\\\|end|>", "", "plain < [x]", "<|start|>user<|message|>x<|end|>"]
    assert all(chat.unescape(chat.escape(t)) == t for t in texts)
    assert not any(c in chat.escape("".join(texts)) for c in chat.CONTROLS)
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(None, None, None, None), (2, 0, "user", "a"), (2, 0, "user", "a")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    messages = messages.select("conv_id", "turn", "role", chat.text_parts().alias("parts"), F.lit(1).alias("formatted"))
    read = {r.conv_id: r for r in chat.format_and_read(messages).collect()}
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in enumerate(texts))
    assert read[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and read[1].n_turns == 5
    learned = texts[1] + texts[3]
    assert (read[1].loss_chars, read[1].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert read[2].n_turns == 2 and read[None].n_turns == 1 and read[None].loss_chars == 0
    assert chat.format_and_read(messages.limit(0)).count() == 0
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 56, 29, None, None), ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3)]
    mixed = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_messages(mixed).first()
    assert row.formatted == "<|start|>user<|message|>see <|image|><|audio|><|document|><|end|>"
    assert [(a.number, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 768)]
    assert row.n_tokens == 810


def test_chat_token_counts(spark):
    counter = chat.bpe_counter("/opt/tokenizers/byte_bpe_50k.tiktoken", secrets.PATTERN)
    messages = spark.createDataFrame([(1, 0, "user", "hello there")], "conv_id long, turn long, role string, text string")
    messages = messages.select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    assert chat.format_messages(messages, counter=counter).first().n_tokens > 5


def test_secrets(spark, odd, nothing):
    key = "Zk3" + "q9XvT7LmP2bR8wY4cN6d"
    docs = _docs(spark, [
        (1, f'é API_KEY = "{key}" and {key} then', "s"), (2, "id 123e4567-e89b-12d3-a456-426614174000 " + "0123456789" * 3, "s"),
        (3, "token: short paſſword=abcdefgh", "s"), (4, "f" * 23 + " " + "0a" * 16, "s"), (5, "responsibilitiesandinternationalization", "s"),
        (6, "AKIA" + "B" * 15, "s"), (7, "AKIA" + "B2C3D4E5F6G7H8I9", "s"),
    ])
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(docs).collect()}
    a, b = 13 + len(key), 19 + len(key)
    expected = {1: f"assign:2:{a},random:{b}:{b + len(key)}", 2: "hex:40:70", 3: "", 4: "hex:24:56", 5: "", 6: "", 7: "access:0:20"}
    assert rows == expected
    assert secrets.find_secrets(odd).filter("spans != ''").count() == 0
    assert secrets.find_secrets(nothing).count() == 0


def test_random_strings_behind_words():
    rng = random.Random(6)
    spec = secrets.SecretSpec()
    efficiency = secrets._Efficiency(spec)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    digest = hashlib.sha256(b"x").hexdigest()

    def spans(text):
        return secrets.random_spans(text, secrets.base_spans(text), efficiency, spec)

    for before in (
        "/customers/settings/integrations/production/accounts/callback/", "production-database-connection-service-account-",
        f"/objects/{digest}/keys/", "/services/2024/notifications/123e4567-e89b-12d3-a456-426614174000/subscription/",
    ):
        plain = f"see {before}documents/description/overview"
        assert spans(plain) == []
        for _ in range(50):
            key = "".join(rng.choice(letters) for _ in range(32))
            text = f"see {before}{key}/documents"
            assert any(a <= len(before) + 4 and b >= len(before) + 36 for a, _, b in spans(text)), text
            split = "/customers/settings/integrations/production/accounts/callback/" + key[:15] + "+" + key[15:] + "/description"
            assert any(b - a >= 24 for a, _, b in spans(split)), split
