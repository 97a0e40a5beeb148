"""Archives: exact round trip, frames that stand alone, and the SQL."""

import struct

import checker
import zstandard
from lucidform.llm import archives, queries
from lucidform.llm.common import file_system

PAGES = [(9, "http://a/\r\n100%", "same"), (2, None, "same"), (5, "u", None), (4, "u", ""), (7, "u", "ü" * 70_000), (None, "n", "same"), (None, None, "alone"), (3, "r", "twice"), (3, "r", "twice"), (8, "e", "x\r\n\r\ny")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, sha1 string, first int").repartition(3)


def test_round_trip_of_odd_pages(spark):
    got = archives.read_archives(archives.write_archives(pages(spark))).collect()
    assert len(got) == len(PAGES)
    told = sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], None if r["payload"] is None else r["payload"].decode()) for r in got), key=str)
    revisit = {(9, "same"): 2, (None, "same"): 2, (5, ""): 4}
    want = []
    for i, url, html in PAGES:
        html = html or ""
        to = revisit.get((i, html))
        want.append((i, url, "revisit" if to is not None else "response", to, len(html.encode()), None if to is not None else html))
    assert told == sorted(want, key=str)
    assert archives.read_archives(archives.write_archives(pages(spark).where("false"))).collect() == []


def test_dictionary_leads_and_each_record_is_a_frame(spark, sf):
    listed = archives.write_archives(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    for row in listed:
        fs, path = file_system(row["path"])
        data = fs.open_input_stream(path).read()
        assert len(data) == row["bytes"]
        mark, size = struct.unpack("<II", data[:8])
        assert mark == archives.DICTIONARY_FRAME and size
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        rest, n = data[8 + size :], 0
        while rest:
            one = plain.decompressobj()
            assert one.decompress(rest).startswith(b"WARC/1.1\r\n") and one.eof
            rest, n = one.unused_data, n + 1
        assert n == row["records"] + 1


def test_op5_equals_sql(spark, sf):
    assert checker.compare(queries.QUERIES["op5_warc_dictionary"](spark, sf), checker.connect(sf), queries.ORACLES["op5_warc_dictionary"]) == []
