from pyspark.sql import functions as F

from flowtusk.functions import addresses, keys


def wrapped(text):
    h = 0
    for ch in text:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    return h


def signed(value):
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


PAIRS = [("10.0.0.1", "192.168.1.5"), ("255.255.255.255", "8.8.8.8"), ("1.1.1.1", "10.0.0.25"), ("", "x"),
         ("16777226", "200")]


def test_text_keys_match_a_plain_loop(spark):
    df = spark.createDataFrame(PAIRS, "s string, d string").select(
        "s", "d", keys.flow_id_poly17("s", "d").alias("p"), keys.flow_id_objects31("s", "d").alias("o"))
    for row in df.collect():
        a, b = wrapped(row.s), wrapped(row.d)
        assert row.p == signed((17 * 17 + a) * 17 + b)
        assert row.o == signed(31 * (31 + a) + b)


def test_colliding_pairs_share_poly17_only(spark):
    df = spark.createDataFrame([("1.1.1.1", "10.0.0.25"), ("1.1.1.3", "10.0.0.12")], "s string, d string")
    count = lambda key: df.select(key("s", "d")).distinct().count()
    assert count(keys.flow_id_poly17) == 1
    assert count(keys.flow_id_pair) == 2


def test_direction(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.0.0.2"), ("10.0.0.2", "10.0.0.1")], "s string, d string")
    assert df.select(keys.flow_id_poly17("s", "d")).distinct().count() == 2
    assert df.select(keys.flow_id_xor("s", "d")).distinct().count() == 1


def test_five_tuple(spark):
    df = spark.createDataFrame([("0.0.0.1", "0.0.0.2", 4, 8, 6)], "s string, d string, a int, b int, p int")
    assert df.select(keys.flow_id_5tuple_xor("s", "d", "a", "b", "p")).first()[0] == 1 ^ 2 ^ 4 ^ 8 ^ 6


def test_addresses(spark):
    row = spark.range(1).select(
        addresses.ip_from_saddr(F.lit(16777226)).alias("raw"), addresses.ip_to_long(F.lit("10.0.0.1")).alias("n"),
        addresses.ip_to_string(F.lit(4294967295)).alias("top"), addresses.saddr_from_ip(F.lit("10.0.0.1")).alias("back"),
    ).first()
    assert (row.raw, row.n, row.top, row.back) == ("10.0.0.1", 167772161, "255.255.255.255", 16777226)
