"""Revisits name records that exist."""

from shelflight.llm import warc


def test_every_revisit_names_a_response_of_the_index(spark):
    big, other = "a" * 3000, "b" * 3000
    rows = [(1, "u", big), (2, None, big), (8, "u", big), (8, "u", big), (8, "v", other), (3, "u", other), (None, "u", big), (2, "w", big), (9, "u", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    index = warc.write_archives(pages, warc.archive_folder(spark), frame_bytes=900, bundle_bytes=3000).collect()
    heads = {}
    for place in index:
        headers, _ = warc.parse_record(warc.read_record(place["bundle"], place["frame"], place["start"], place["size"]))
        assert headers["warc-record-id"] == f"<{place['record_id']}>"
        heads[headers["warc-record-id"]] = headers
    assert len(heads) == len(rows)
    revisits = [h for h in heads.values() if h["warc-type"] == "revisit"]
    assert len(revisits) == 4
    for headers in revisits:
        target = heads[headers["warc-refers-to"]]
        assert target["warc-type"] == "response" and target["warc-payload-digest"] == headers["warc-payload-digest"]
