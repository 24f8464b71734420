"""Decoding and scalar functions on literals."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowsentry.functions import decode, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n,name", [(6, "TCP"), (47, "GRE"), (99, "PROTO_99"), (1, "ICMP"), (17, "UDP"), (50, "ESP"), (51, "AH")])
def test_protocols(spark, n, name):
    assert one(spark, decode.protocol_name(F.lit(n))) == name


@pytest.mark.parametrize("bits,names", [(0, "NONE"), (2, "SYN"), (18, "SYN|ACK"),
                                        (255, "FIN|SYN|RST|PSH|ACK|URG|ECE|CWR")])
def test_flags(spark, bits, names):
    assert one(spark, decode.tcp_flag_names(F.lit(bits))) == names


@pytest.mark.parametrize("text,want", [
    ("2024-02-03 04:05:06", datetime(2024, 2, 3, 4, 5, 6)), ("2024-02-03 04:05", datetime(2024, 2, 3, 4, 5)),
    ("2024-02-03", datetime(2024, 2, 3)), ("2024-02-03T04:05:06", datetime(2024, 2, 3, 4, 5, 6)),
    ("2024-02-03T04:05:06Z", datetime(2024, 2, 3, 4, 5, 6)), ("2024-2-3 4:05", datetime(2024, 2, 3, 4, 5)),
    ("soon", None), ("2024-13-03", None)])
def test_datetimes(spark, text, want):
    got = one(spark, F.unix_micros(scalars.parse_datetime(F.lit(text))))
    assert got == (None if want is None else int((want - datetime(1970, 1, 1)).total_seconds()) * 1_000_000)


def test_strict_datetime_raises(spark):
    with pytest.raises(Exception, match="Unable to parse"):
        one(spark, scalars.parse_datetime(F.lit("soon"), strict=True))


@pytest.mark.parametrize("n,text", [(0, "0 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "1.5 KB"),
                                    (1048576, "1 MB"), (10 * 1024, "10 KB"), (1234567, "1.18 MB")])
def test_sizes(spark, n, text):
    assert one(spark, scalars.human_bytes(F.lit(n))) == text


@pytest.mark.parametrize("n,text", [(999, "999"), (1000, "1.0K"), (1_500_000, "1.5M")])
def test_short_numbers(spark, n, text):
    assert one(spark, scalars.short_number(F.lit(n))) == text


def test_buckets_and_labels(spark):
    ts = F.lit(datetime(2024, 1, 6, 13, 14)).cast("timestamp")
    assert one(spark, scalars.is_weekend(ts)) is True
    assert one(spark, scalars.hour_of_day(ts)) == 13
    assert one(spark, scalars.period_label(ts, ts)) == "2024-01-06 13:14 to 2024-01-06 13:14"
    with pytest.raises(ValueError):
        scalars.time_bucket(ts, "week")


def test_ratios(spark):
    assert one(spark, scalars.ratio_guarded(F.lit(6), F.lit(0.5))) == 6.0
    assert one(spark, scalars.percent_of(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, scalars.severity_rank(F.lit("Critical"))) == 4
    assert one(spark, scalars.words(F.lit("sql_injection"))) == "sql injection"


def test_fixed_rounds_the_binary_value_like_python(spark):
    import random
    rng = random.Random(7)
    values = [n / 60 for n in range(1, 700)] + [0.05, 0.25, 0.75, 2.675, 1.005, 0.125, 0.375, 0.0, 12345.6785, -0.0004, 0.9996]
    values += [rng.uniform(-2, 2) for _ in range(500)] + [rng.uniform(0, 1e6) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", *[scalars.fixed(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 3)],
                     scalars.round2(F.col("v")).alias("r")).collect()
    for r in rows:
        assert (r.d1, r.d2, r.d3) == (f"{r.v:.1f}", f"{r.v:.2f}", f"{r.v:.3f}"), r.v
        assert r.r == round(r.v, 2)


def test_true_halves_go_up_in_short_texts(spark):
    assert one(spark, scalars.short_number(F.lit(1250))) == "1.3K"
    assert one(spark, scalars.short_number(F.lit(1150))) == "1.1K"
