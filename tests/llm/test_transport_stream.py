import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronoloom.llm import queries
from chronoloom.llm import transport_stream as ts


@given(st.binary(min_size=0, max_size=700))
def test_round_trip(data):
    read = ts.read_stream(ts.write_stream(data))
    assert (read["data"], read["continuity_errors"], read["lost_sync"], read["bad_tables"]) == (data, 0, 0, 0)


@pytest.mark.parametrize("size", [1, 157, 158, 159, 160, 161, 162, 163, 176, 184, ts.UNIT - 1, ts.UNIT, ts.UNIT + 1, 9 * ts.UNIT + 77])
def test_sizes_and_time_stamps(size):
    data = bytes(i % 251 for i in range(size))
    media = ts.write_stream(data)
    read = ts.read_stream(media)
    units = -(-size // ts.UNIT)
    assert len(media) % 188 == 0 and read["data"] == data
    assert [u["pts"] for u in read["units"]] == [i * ts.UNIT_TICKS for i in range(units)]
    assert [u["random_access"] for u in read["units"]] == [i % ts.ACCESS_EVERY == 0 for i in range(units)]
    assert read["programs"] == [{"program": 1, "pid": ts.TABLE_PID, "pcr_pid": ts.DATA_PID, "streams": [{"pid": ts.DATA_PID, "stream_type": 6}]}]


def test_damage_is_told():
    media = ts.write_stream(bytes(3000))
    lost = media[: 5 * 188] + media[6 * 188 :]
    assert ts.read_stream(lost)["continuity_errors"] == 1
    twice = media[: 5 * 188] + media[4 * 188 :]
    assert ts.read_stream(twice)["continuity_errors"] == 0 and ts.read_stream(twice)["data"] == bytes(3000)
    assert ts.read_stream(b"\0" + media[1:])["lost_sync"] == 1
    broken = bytearray(media)
    broken[20] ^= 255
    assert ts.read_stream(bytes(broken[:188]))["bad_tables"] in (0, 1)
    wrong = bytearray(media)
    wrong[8] ^= 1
    assert ts.read_stream(bytes(wrong))["bad_tables"] == 1
    assert ts.read_stream(b"")["n_packets"] == 0


def test_counter_runs_over():
    media = ts.write_stream(bytes(184 * 40))
    assert ts.read_stream(media)["continuity_errors"] == 0


def test_query_against_brute_force(spark, small):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op2_media(spark, small).collect():
        data = (texts[r["doc_id"]] or "").encode()
        payload = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_hard_rows(hard, none):
    made = ts.with_stream_read(ts.with_stream(hard.withColumn("payload", ts.padded())))
    rows = made.collect()
    assert len(rows) == hard.count()
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["stream"]["data"] == data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
    assert ts.with_stream_read(ts.with_stream(none.withColumn("payload", ts.padded()))).count() == 0
