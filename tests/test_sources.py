import struct
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowtusk.checks.queries import QUERIES
from flowtusk.schema import PACKET_COLUMNS
from flowtusk.sinks.files import write_packets_csv
from flowtusk.sources import captures, text
from flowtusk.sources.captures import read_packets_pcap, read_records_pcap, to_tuple_dataset
from flowtusk.sources.events import read_event_packets
from flowtusk.sources.replay import replay, with_ingress_time
from flowtusk.sources.text import parse_packet_lines, read_packets_csv, rejected_lines

FULL = "1700000000000001,10.0.0.1,10.0.0.2,6,118,100,20,80,20,60,1000,80,5,0,512,1"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_number_of_fields_decides(spark):
    eleven = ",".join(FULL.split(",")[:11])
    twelve = ",".join(FULL.split(",")[:12])
    rows = parse_packet_lines(lines(spark, eleven, twelve, eleven + ",", eleven + ",,,,", FULL)).collect()
    assert len(rows) == 2
    assert rows[0].seq is None and rows[1].seq == 5 and rows[1].syn == 1


def test_bad_numbers(spark):
    bad = FULL.replace(",118,", ",many,")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parse_packet_lines(lines(spark, bad)).collect()
    assert parse_packet_lines(lines(spark, bad), strict=False).first().pkt_len is None
    found = {r.reason for r in rejected_lines(lines(spark, bad, "a,b", "x" + FULL, FULL)).collect()}
    assert found == {"bad length", "too few fields", "bad time"}


def test_every_bad_number_is_rejected(spark):
    port, win = FULL.replace(",5000,", ",port,"), FULL.replace(",512,", ",junk,")
    table = lines(spark, port, win, FULL) if port != FULL else lines(spark, win, FULL)
    found = [r.reason for r in rejected_lines(table).collect()]
    assert "bad win" in found and len(found) == table.count() - 1
    assert parse_packet_lines(table, strict="drop").count() == 1


def test_unused_columns_are_not_converted(spark):
    odd = FULL.replace(",512,", ",junk,")
    assert parse_packet_lines(lines(spark, odd)).select("src_ip", "pkt_len").first().pkt_len == 118


def test_csv_round_trip(spark, folder, tmp_path):
    table = read_event_packets(spark, folder)
    write_packets_csv(table, str(tmp_path / "dotted"))
    back = read_packets_csv(spark, str(tmp_path / "dotted")).select(*PACKET_COLUMNS)
    assert back.exceptAll(table.select(*PACKET_COLUMNS)).count() == 0 and back.count() == table.count()
    write_packets_csv(table.filter("pkt_id = 1"), str(tmp_path / "numeric"), dotted=False)
    text = spark.read.text(str(tmp_path / "numeric")).first().value.split(",")
    assert len(text) == 16 and int(text[1]) & 0xFF == 10
    raw = read_packets_csv(spark, str(tmp_path / "numeric"), addresses="raw").select(*PACKET_COLUMNS)
    assert raw.exceptAll(table.select(*PACKET_COLUMNS)).count() == 0 and raw.count() == 1
    with pytest.raises(ValueError):
        read_packets_csv(spark, str(tmp_path / "numeric"), addresses="hex")


def frame(src, dst, sport, dport, flags=0x10, ack=99, vlan=False, proto=6, ethertype=0x0800, options=b"", length=100):
    head = b"\x00" * 12 + (struct.pack(">HH", 0x8100, 7) if vlan else b"") + struct.pack(">H", ethertype)
    words = 5 + len(options) // 4
    ip = struct.pack(">BBHHHBBH4s4s", 0x40 | words, 0, length, 1, 0, 64, proto, 0, bytes(src), bytes(dst)) + options
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 4000000000, ack, 5 << 4, flags, 513, 0, 0)
    return head + ip + tcp + b"\xff" * (length - 40)


def capture(frames, order="<", nano=False):
    magic = 0xA1B23C4D if nano else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, data in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000, (5 + i) * (1000 if nano else 1), len(data), len(data)) + data
    return out


SRC, DST = (10, 0, 0, 1), (192, 168, 1, 200)


def test_captures(spark, tmp_path):
    frames = [
        frame(SRC, DST, 1000, 80),
        frame(SRC, DST, 1001, 80, vlan=True, flags=0x02),
        frame(SRC, DST, 1002, 80, proto=17),
        frame(SRC, DST, 1003, 80, ethertype=0x86DD),
        frame(SRC, DST, 1004, 80, options=b"\x01" * 8),
        frame(SRC, DST, 1005, 80)[:40],
    ]
    for name, order, nano in [("a", "<", False), ("b", ">", False), ("c", "<", True), ("d", ">", True)]:
        (tmp_path / f"{name}.pcap").write_bytes(capture(frames, order, nano))
    got = read_packets_pcap(spark, str(tmp_path / "*.pcap")).orderBy("pkt_id").collect()
    assert len(got) == 12 and len({r.pkt_id for r in got}) == 12
    by_port = {r.src_port: r for r in got}
    plain, tagged, longer = by_port[1000], by_port[1001], by_port[1004]
    assert (plain.src_ip, plain.dst_ip, plain.ts_us) == ("10.0.0.1", "192.168.1.200", 1_700_000_000_000_005)
    assert (plain.pkt_len, plain.ip_len, plain.ip_hdr_len, plain.ip_payload_len) == (118, 100, 20, 80)
    assert (plain.tr_hdr_len, plain.tr_payload_len, plain.win, plain.seq) == (20, 60, 513, 4000000000)
    assert (plain.ack, plain.syn, tagged.ack, tagged.syn) == (99, 0, 0, 1)
    assert (longer.ip_hdr_len, longer.dst_port) == (28, 80)
    assert to_tuple_dataset(read_packets_pcap(spark, str(tmp_path / "*.pcap")), 3).count() == 3


@pytest.mark.parametrize("content", [b"notacapture" * 4, capture([frame(SRC, DST, 1, 2)])[:-3]])
def test_broken_captures_fail(spark, tmp_path, content):
    (tmp_path / "x.pcap").write_bytes(content)
    with pytest.raises(Exception, match="not a capture file|truncated"):
        read_packets_pcap(spark, str(tmp_path / "x.pcap")).collect()


def mixed_capture(count, order, nano, fake=False):
    """Records of many lengths; `fake`: payloads that hold heads of records themselves, and runs of zeros."""
    rows = []
    for i in range(count):
        data = frame(SRC, DST, 1000 + i % 50000, 80, length=60 + i * 37 % 900)
        if fake:
            data += capture([b"\x00" * 50] * 12, order, nano)[24:] + b"\x00" * (i % 3 * 300)
        rows.append(data)
    return capture(rows, order, nano)


@pytest.mark.parametrize("order,nano,fake", [(">", True, False), ("<", False, True)])
def test_captures_in_ranges(spark, tmp_path, order, nano, fake):
    for name, count in (("a", 300), ("b", 0), ("c", 1), ("d", 77)):
        (tmp_path / f"{name}.pcap").write_bytes(mixed_capture(count, order, nano, fake))
    whole = read_records_pcap(spark, str(tmp_path)).collect()
    assert len(whole) == 378 and {(r.file_no, r.rec_no) for r in whole} == {
        (f, n) for f, count in ((0, 300), (2, 1), (3, 77)) for n in range(count)}
    for range_bytes in (100, 5000):
        assert sorted(read_records_pcap(spark, str(tmp_path), range_bytes).collect()) == sorted(whole)


def test_doubtful_ranges_are_walked_again(spark, tmp_path, monkeypatch):
    """Payloads full of plausible heads mislead every guess; a file may still need one walk."""
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 5, 40, 40) + b"\x00" * 40 for _ in range(60))
    (tmp_path / "x.pcap").write_bytes(capture([inner + bytes([i]) for i in range(40)]))
    whole = sorted(read_records_pcap(spark, str(tmp_path)).collect())
    assert len(whole) == 40
    for rounds in (0, 1):
        monkeypatch.setattr(captures, "ROUNDS", rounds)
        assert sorted(read_records_pcap(spark, str(tmp_path), 2000).collect()) == whole


def test_long_records_and_small_reads(tmp_path, monkeypatch):
    monkeypatch.setattr(captures, "READ_BYTES", 64)
    (tmp_path / "x.pcap").write_bytes(capture([b"\x07" * n for n in (0, 1, 500, 30, 9000, 64)]))
    opened = captures._Capture.open(f"file://{tmp_path}/x.pcap")
    got = [n for batch in opened.records(24, opened.size, 0) for n in map(len, batch.column("frame").to_pylist())]
    assert got == [0, 1, 138, 30, 138, 64]
    assert opened.count(24, 100, True)[1:] == (573, 3)


def test_contents_are_not_copied():
    """A batch of capture files is read where it lies: memory for one of them, not for all."""
    content = capture([b"\x05" * 84] * 20_000)
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}" for i in range(32)]), pa.array([content] * 32), pa.array(range(32))],
                                       ["path", "content", "file_no"])
    tracemalloc.start()
    records = next(captures._cut_content([batch])).num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert records == 20_000 and len(content) > 2_000_000 and peak < 32 * len(content) / 2


def test_a_capture_beyond_two_gigabytes_is_ranged(spark, tmp_path):
    """A sparse file of 2.2 GB: only its ends hold bytes, the middle is one long hole of empty records."""
    size, block = (1 << 31) + (200 << 20), 1 << 20
    head, record = capture([]), capture([b"\x05" * 84])[24:]
    hole = struct.pack("<IIII", 1_700_000_000, 5, block - 16, block - 16)
    with open(tmp_path / "x.pcap", "wb") as out:
        out.write(head + record)
        at = len(head + record)
        while at + block <= size:
            out.seek(at)
            out.write(hole)
            at += block
        out.seek(at)
        out.write(record)
    ranges = captures.stitched_ranges(captures.capture_ranges(spark, str(tmp_path)), captures.RANGE_BYTES)
    first, last = ranges.orderBy("k").first(), ranges.orderBy(F.desc("k")).first()
    assert first.entry == 24 and last.exit == at + 100 == last.size > 1 << 31
    assert last.first_no + last.records == 2 + (at - 124) // block


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "100", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_ids_of_lines_of_several_splits(spark, small_splits, tmp_path):
    """Lines of one byte, and one that begins where its split ends: the ids grow with the line all the same."""
    (tmp_path / "x.txt").write_text("\n" * 100 + "a\n" + "\n" * 150 + "b\n" + "\n" * 40)
    lines = text.number_lines(spark.read.text(str(tmp_path)))
    ids = [r.pkt_id for r in lines.collect()]
    assert len(set(ids)) == len(ids) == 292
    assert [r.value for r in lines.filter("value <> ''").orderBy("pkt_id").collect()] == ["a", "b"]


def test_stream_ids_of_several_splits(spark, small_splits, tmp_path):
    events = spark.range(60).selectExpr("id AS event_id", "id AS user_id", "'click' AS event_type", "1.0D AS value",
                                        "timestamp_ntz'2024-01-01' AS ts")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = QUERIES["s2_stream_ids"](spark, str(tmp_path)).collect()
    assert sorted((r.protocol, r.lines, r.ids, r.in_order) for r in rows) == [(6, 54, 54, True), (17, 6, 6, True)]


def test_replay(packets):
    table = packets((100, "a", "b", 1), (150, "a", "b", 2))
    times = [r.ts_us for r in replay(table, 3).orderBy("ts_us").collect()]
    assert times == [100, 150, 151, 201, 202, 252]
    assert replay(table, 2, replicas=3).groupBy("gen", "replica").count().count() == 6
    assert [r.ts_us for r in replay(table, 2, span_us=1000).orderBy("ts_us").collect()] == [100, 150, 1100, 1150]
    assert with_ingress_time(table).filter(F.col("ingress_us") > 0).count() == 2


def test_replay_of_a_long_trace(packets):
    table = packets((0, "a", "b", 1))
    assert replay(table, 100, span_us=60_000_000).agg(F.max("ts_us")).first()[0] == 99 * 60_000_000
