"""Archives of repeated rows and of long payloads."""

from rankwright.llm import warc


def _records(path):
    return [list(warc.parse_records(p.read_bytes())) for p in sorted(path.glob("part-*"))]


def test_repeated_rows_keep_one_payload(spark, tmp_path):
    """Rows equal in all columns: one response, the others revisit it, all with ids of their own."""
    rows = [(1, "u", "same")] * 5 + [(2, "u", "same")] * 3 + [(None, None, "other")] * 2 + [(3, "u", None)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in warc.archive_and_read(pages).collect())
    expected = [(1, "response", None, 4)] + [(1, "revisit", 1, 4)] * 4 + [(2, "revisit", 1, 4)] * 3
    expected += [(None, "response", None, 5), (None, "revisit", None, 5), (3, "response", None, 0), (3, "revisit", 3, 0)]
    assert found == sorted(map(str, expected))
    warc.write_archive(pages, str(tmp_path / "w"))
    records = [r for file in _records(tmp_path / "w") for r in file]
    assert sum(head["warc-type"] == "response" for head, _ in records) == 3
    originals = {head["warc-record-id"] for head, _ in records if head["warc-type"] == "response"}
    revisits = [head for head, _ in records if head["warc-type"] == "revisit"]
    assert {head["warc-refers-to"] for head in revisits} <= originals
    assert len({head["warc-record-id"] for head, _ in records}) == len(records) == len(rows)


def test_files_by_bytes(spark, tmp_path):
    rows = [(n, "u", chr(97 + n % 26) * 1000 + str(n)) for n in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archive(pages, str(tmp_path / "w"), warc.WarcSpec(file_bytes=40_000))
    files = _records(tmp_path / "w")
    assert sum(map(len, files)) == 400 and max(map(len, files)) <= 20


def test_a_long_payload(spark):
    """50 MB in one row, twice; lengths and digests are those of the whole payload."""
    pages = spark.range(2).selectExpr("id AS page_id", "'u' AS url", "repeat('0123456789', 5000000) AS html")
    found = {r.page_id: r for r in warc.archive_and_read(pages).collect()}
    assert {r.payload_bytes for r in found.values()} == {50_000_000}
    assert (found[0].record_type, found[1].record_type, found[1].refers_to) == ("response", "revisit", 0)
