"""DuckDB SQL for the results that SQL can express."""

from rankwright.llm.licences import PHRASES, TEMPLATES, words_of

SQL: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"

SQL["op1_near_dup"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) > 1
      THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS sh
    FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), x AS (
  SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS c
  FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p, q FROM x JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q
  WHERE 100 * c >= 80 * (a.n + b.n - c)
), both_ways AS (SELECT p, q FROM e UNION SELECT q, p FROM e
), reach AS (
  SELECT doc_id AS p, doc_id AS q FROM documents
  UNION SELECT r.p, b.q FROM reach r JOIN both_ways b ON r.q = b.p
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT p, min(q) AS c FROM reach GROUP BY 1) r ON r.p = d.doc_id
"""

SQL["op8_substring_dedup"] = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), p AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), m AS (SELECT k, min(doc_id) AS least FROM p GROUP BY 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM p JOIN m USING (k) WHERE least < doc_id
), one AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY 1
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

SQL["op6_mixing"] = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    md5('mix-1:' || doc_id || ':' || len(regexp_extract_all(coalesce(text, ''), '{WORD}'))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS n,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER before, 0)) / sum(w) OVER since AS level
  FROM s WINDOW before AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    since AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), t AS (
  SELECT source, n, CASE WHEN 2 * n <= level * w THEN 2 * n
    ELSE w * (SELECT arg_min(level, 2 * n / w) FROM f g WHERE 2 * g.n > g.level * g.w) END AS target
  FROM f
), u AS (SELECT source, n, target, floor(target / n) AS times, target - floor(target / n) * n AS rest FROM t WHERE n > 0
), o AS (
  SELECT d.*, u.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, n::BIGINT AS source_size, target,
  (size * (times + CASE WHEN start < rest AND rest - start >= size / 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""

# what the chat template escapes, as DuckDB's regular expressions want it
_CONTROL = (
    r"\|start\|>|\|message\|>|\|end\|>|\|image\|>|\|audio\|>|\|document\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|"
    r"\|startoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|\|eot_id\|>|s>|/s>|unk>|pad>|<SYS>>|</SYS>>|INST\]|/INST\]"
)

SQL["op9_chat"] = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|start|><|message|><|end|>' || role || text)
    + len(regexp_extract_all(text, '[<\[]\\*({_CONTROL})')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

_HEX = "substr(sha1(coalesce(html, '')), {}, 10)"
_GROUP = "lpad(to_base(('0x' || " + _HEX + ")::UBIGINT::BIGINT, 32), 8, '0')"

SQL["op7_warc"] = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    translate({" || ".join(_GROUP.format(i) for i in (1, 11, 21, 31))},
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

SQL["op5_vptree"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT q.vec_id AS query_id, (row_number() OVER best)::INT AS rank, c.vec_id,
  list_cosine_similarity(q.e, c.e) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id)
QUALIFY row_number() OVER best <= 5
"""

#: Words of letters, digits and all that is not ASCII, lower-cased from A to Z.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL["op13_resample"] = rf"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS c
    FROM range(256) r(i))
), d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_RUN}') AS ws FROM documents
), dw AS (SELECT doc_id, unnest(ws) AS word FROM d
), bw AS (SELECT unnest(regexp_extract_all({_LOWER}, '{_RUN}')) AS word FROM benchmark
), bytes AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), b AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295,
      list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
    lambda c, x: xor(tab[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
  FROM bytes, crc
), s AS (SELECT bucket, count(*) AS n FROM dw JOIN b USING (word) GROUP BY 1
), t AS (SELECT bucket, count(*) AS n FROM bw JOIN b USING (word) GROUP BY 1
), totals AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000 AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000 AS t
), g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * totals.s
    / ((coalesce(s.n, 0)::DOUBLE + 1) * totals.t)))::BIGINT AS gain
  FROM range(10000) r(bucket) CROSS JOIN totals LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), w AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1
), c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(
    -1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id)
), p AS (
  SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () * 10 // 100 AS drawn FROM c
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM p
"""


def _list(texts) -> str:
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]::VARCHAR[]"


_TEMPLATES = ",\n    ".join(
    [f"({i}, '{label}', {_list(words_of(text))}, []::VARCHAR[][], true)" for i, (label, text) in enumerate(PHRASES)]
    + [
        f"({i}, '{label}', {_list(words_of(text))}, [{', '.join(_list(words_of(k)) for k in keys)}]::VARCHAR[][], false)"
        for i, (label, text, keys) in enumerate(TEMPLATES, len(PHRASES))
    ]
)

SQL["op12_licences"] = rf"""
WITH t(id, label, ws, keys, phrase) AS (VALUES
    {_TEMPLATES}
), tw AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS q FROM t
), d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_RUN}') AS ws FROM documents
), dw AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d
), hit AS (SELECT * FROM dw WHERE word IN (SELECT word FROM tw)
), weight AS (
  SELECT word, 1 + floor(1000 * ln(((SELECT count(*) FROM documents)::DOUBLE + 1) / (count(DISTINCT doc_id) + 1)))::BIGINT AS w
  FROM (SELECT DISTINCT word FROM tw) LEFT JOIN hit USING (word) GROUP BY word
), total AS (SELECT id, sum(w) AS total FROM tw JOIN weight USING (word) GROUP BY id
), place AS (
  SELECT doc_id, id, p - q AS place, sum(w) AS held FROM hit JOIN tw USING (word) JOIN weight USING (word) GROUP BY ALL
), fit AS (
  SELECT doc_id, id, label, phrase, place, held / total AS share
  FROM place JOIN total USING (id) JOIN t USING (id) JOIN d USING (doc_id)
  WHERE 100 * held >= CASE WHEN phrase THEN 100 ELSE 80 END * total
    AND len(list_filter(keys, lambda k: len(list_filter(range(greatest(place, 0), least(place + len(t.ws), len(d.ws)) - len(k) + 1),
      lambda i: d.ws[i + 1 : i + len(k)] = k)) = 0)) = 0
), doc AS (
  SELECT doc_id, count(*) FILTER (phrase) AS n_base, min(place) FILTER (phrase) AS first_word,
    max(place) FILTER (phrase) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share)::DOUBLE AS score
  FROM fit GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN doc USING (doc_id)
"""

SQL["op11_collocations"] = rf"""
WITH p AS (
  SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f AS (
  SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM p, range(1, 6) s(size) WHERE len(ws) >= size)
  GROUP BY ALL
), totals AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (SELECT * FROM f WHERE size > 1 AND a >= 100
), kept AS (
  SELECT * FROM c WHERE NOT EXISTS (FROM c y WHERE y.lang = c.lang AND y.size > c.size AND 100 * y.a >= 100 * c.a
    AND contains(' ' || y.phrase || ' ', ' ' || c.phrase || ' '))
), cut AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS first, array_to_string(ws[k + 1 :], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM kept)
), s AS (
  SELECT cut.lang, cut.phrase, cut.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * cut.a * n) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first JOIN f y ON y.lang = cut.lang AND y.phrase = rest
  JOIN totals ON totals.lang = cut.lang
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM s
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
QUALIFY row_number() OVER best <= 2000
"""
