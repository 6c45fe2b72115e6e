import os

import duckdb
import pytest
import zstandard

from siltstone.llm import warc
from siltstone.llm.common import new_folder
from siltstone.sources.storage import run

SHAPE = "page_id long, url string, html string"


def files(folder):
    folder = folder.removeprefix("file:")
    return [f"{folder}/{f}" for f in os.listdir(folder)]


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = duck.sql(warc.ORACLE_SQL)
    with run(spark):
        got = warc.op12_warc(spark, sf)
        assert got.columns == want.columns
        assert sorted(got.collect(), key=lambda r: r.page_id) == sorted(want.fetchall(), key=lambda r: r[0])


def test_copies_nulls_and_odd_rows(spark):
    rows = [(1, "http://a/ä b", "same"), (9, None, "same"), (4, "x\r\nWARC-Type: y", "same"), (2, "", None), (3, "u", ""), (None, "n", "same"), (None, "n", "other"), (7, "q", "twice"), (7, "q", "twice"), (5, "long", "ö\r\n\r\n" * 500_000)]
    with run(spark):
        got = warc.records(warc.written(spark.createDataFrame(rows, SHAPE).withColumn("payload", warc.F.lit(1)), new_folder(spark, "w")), with_payload=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.id_text, []).append(r)
    assert len(got) == len(rows)
    kinds = {k: sorted((r.record_type, r.refers_to_text) for r in v) for k, v in by.items()}
    assert kinds["9"] == [("response", None)] and kinds["1"] == kinds["4"] == [("revisit", "9")]
    assert kinds["2"] == [("revisit", "3")] and kinds["3"] == [("response", None)] and by["2"][0].payload_bytes == 0
    assert sorted(kinds[None], key=str) == [("response", None), ("revisit", "9")]
    assert kinds["7"] == [("response", None)] * 2
    assert by["5"][0].payload.decode() == rows[-1][2] and by["5"][0].payload_digest == warc.digest(rows[-1][2].encode())
    assert by["4"][0].target_uri == rows[2][1] and by["1"][0].target_uri == rows[0][1] and by["9"][0].target_uri is None
    assert by["1"][0].payload_bytes == 4 and by["1"][0].payload is None and by["1"][0].refers_to_record == by["9"][0].record_id


def test_small_payloads_never_revisit(spark):
    rows = [(1, "a", "abc"), (2, "b", "abc"), (3, "c", "abcd"), (4, "d", "abcd")]
    with run(spark):
        got = warc.records(warc.written(spark.createDataFrame(rows, SHAPE), new_folder(spark, "w"), min_bytes=4)).collect()
    assert {r.id_text: r.refers_to_text for r in got} == {"1": None, "2": None, "3": "4", "4": None}


def test_an_empty_table(spark):
    with run(spark):
        index = warc.written(spark.createDataFrame([], SHAPE), new_folder(spark, "w"))
        assert index.count() == 0 and warc.records(index).collect() == []


def test_bundles_are_zstandard_and_frames_are_independent(spark, sf):
    """A whole bundle unpacks with any reader to well-formed records; the index finds each, also through one frame alone."""
    with run(spark):
        folder = new_folder(spark, "w")
        index = warc.written(spark.read.parquet(f"{sf}/pages.parquet"), folder)
        places = {}
        for r in index.collect():
            places.setdefault(r.bundle, []).append(r)
        assert {p.split("/")[-1] for p in places} == {f.split("/")[-1] for f in files(folder)}
        for path, rows in places.items():
            raw = open(path.removeprefix("file:"), "rb").read()
            plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
            at = n = 0
            while at < len(plain):
                _, _, at = warc.parsed(plain, at)
                n += 1
            assert n == len(rows)
            reader = warc.BundleReader(path)
            for r in rows:
                fields, _, end = warc.parsed(reader.frame(r.frame), r.offset)
                assert fields["warc-record-id"] == r.record_id and end - r.offset == r.length
            reader.close()


def test_records_by_identifier_read_one_frame(spark, sf, tmp_path):
    with run(spark):
        index = warc.written(spark.read.parquet(f"{sf}/pages.parquet"), new_folder(spark, "w"))
        one = index.orderBy("id_text").first()
        wanted = spark.createDataFrame([(one.record_id,), (one.record_id,), ("<urn:none>",)], "record_id string")
        (got,) = warc.fetched(index, wanted).collect()
        assert got.id_text == one.id_text and len(got.payload or b"") in (got.payload_bytes, 0)


def test_frames_end_at_their_size(tmp_path):
    out = warc.BundleWriter(f"file:{tmp_path}/b.warc.zst")
    sizes = [warc.FRAME_BYTES // 2, warc.FRAME_BYTES // 2, 1, 3 * warc.FRAME_BYTES, 5]
    assert [out.add(bytes([k]) * n) for k, n in enumerate(sizes)] == [(0, 0), (0, sizes[0]), (1, 0), (2, 0), (3, 0)]
    out.close()
    reader = warc.BundleReader(f"file:{tmp_path}/b.warc.zst")
    assert [len(reader.frame(k)) for k in range(4)] == [warc.FRAME_BYTES, 1, 3 * warc.FRAME_BYTES, 5]
    reader.close()


def test_a_damaged_payload_is_an_error():
    _, data = warc.record("1", "u", b"payload", None)
    with pytest.raises(ValueError, match="digest"):
        warc._row(data.replace(b"payload\r\n", b"paYload\r\n"), 0, False)
    with pytest.raises(ValueError, match="no record"):
        warc.parsed(b"nothing\r\n\r\n")
