"""Packets derived from a table of timed user events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Start of the event table, and the factor that turns 30 days into 60 seconds.
EPOCH_US = 1_704_067_200_000_000
COMPRESSION = 43_200

_COLUMNS = {
    "pkt_id": "event_id",
    "ts_us": f"{EPOCH_US} + (unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div {COMPRESSION}",
    "src_ip": "concat('10.0.0.', user_id % {hosts})",
    "dst_ip": "concat('192.168.1.', case event_type when 'click' then 1 when 'view' then 2 "
              "when 'purchase' then 3 when 'signup' then 4 else 5 end)",
    "protocol": "cast(case when event_id % 10 = 0 then 17 else 6 end as smallint)",
    "pkt_len": "cast(58 + least(1442, cast(round(value * 100) as bigint) div 10) as int)",
    "src_port": "cast(1024 + event_id % 50000 as int)",
    "dst_port": "80",
    "seq": "event_id",
    "ack": "cast(0 as bigint)",
    "win": "512",
    "syn": "cast(0 as smallint)",
}


def packets_from_events(events: DataFrame, hosts: int = 16) -> DataFrame:
    """Map a table or stream of events to packets; `hosts` bounds the number of sources."""
    base = events.select(*[F.expr(e.format(hosts=hosts)).alias(n) for n, e in _COLUMNS.items()])
    return (base
            .withColumn("ip_len", F.col("pkt_len") - 18)
            .withColumns({
                "ip_hdr_len": F.lit(20), "tr_hdr_len": F.lit(20),
                "ip_payload_len": F.col("ip_len") - 20, "tr_payload_len": F.col("ip_len") - 40,
            }))


def read_event_packets(spark: SparkSession, folder: str, hosts: int = 16) -> DataFrame:
    """Packets of `<folder>/events.parquet`. Event times carry no zone; they are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return packets_from_events(spark.read.parquet(f"{folder}/events.parquet"), hosts)


def stream_event_packets(spark: SparkSession, folder: str, hosts: int = 16) -> DataFrame:
    """The same packets as an unbounded input."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return packets_from_events(events, hosts)
