"""Sums of doubles come out the same however the events are cut, and as the SQL's on one thread: rounding ties show every difference."""

import itertools
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import rows

from pulsegrid.plans import catalogue

N = 160  # means of numbers with two digits often lie on a tie of the digits that are kept


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """(one, many): folders with the same events in a file in order, and out of order in seven."""
    rng, base = random.Random(5), tmp_path_factory.mktemp("order")
    e = [(i, 1_704_067_200_000_000 + i * 53_000_000, i % 300, rng.choice(["click", "view", "error"]), rng.randrange(20_000) / 100, f'{{"k": {rng.randrange(100)}}}') for i in range(300 * N)]
    schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    table = lambda part: pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
    (base / "one").mkdir()
    pq.write_table(table(e), base / "one" / "events.parquet")
    rng.shuffle(mixed := list(e))
    (base / "many" / "events.parquet").mkdir(parents=True)
    for i in range(7):
        pq.write_table(table(mixed[i::7]), base / "many" / "events.parquet" / f"part-{i}.parquet")
    return base / "one", base / "many"


@pytest.mark.parametrize("name", ["first_person_sentiment", "speaking_split", "head_summary", "voice_summary", "hourly_stream", "gps_summary", "gps_summary_table", "blink_detection"])
def test_cut_does_not_matter(spark, cut, name):
    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute(f"create view events as select * from '{cut[0]}/events.parquet'")
    want = rows(con.sql(catalogue.oracle_sql()[name]).df())
    assert [rows(catalogue.queries()[name](spark, str(p)).toPandas()) == want for p in cut] == [True, True]


def test_voice_sums_in_order_of_frames(spark):
    from pulsegrid.plans import voice

    rng = random.Random(3)
    value = {r: [rng.randrange(1, 20_000) / 100 for _ in range(60)] for r in range(40)}
    mixed = [(r, i, x, x) for r, v in value.items() for i, x in enumerate(v)]
    rng.shuffle(mixed)
    frames = spark.createDataFrame(mixed, "r int, frame_idx long, f0 double, loudness double").repartition(5)
    silence = spark.createDataFrame([(r, 0.6, 0.61, 0.01) for r in value], "r int, pause_start double, pause_end double, pause_duration double")
    got = {x.r: x.f0_mean for x in voice.vocal_summary(frames, silence, ["r"]).collect()}
    assert got == {r: sum_in_order(v) / len(v) for r, v in value.items()}


def sum_in_order(values):
    total = 0.0
    for v in values:  # sum() compensates since Python 3.12
        total += v
    return total


def test_stream_sums_in_order_of_events(spark, tmp_path):
    """One hour of users whose three events lie in three files in every order."""
    from pulsegrid.streaming.windows import hourly_counts, run_once

    e = [(f, u * 3 + k, u, v) for u, p in enumerate(itertools.permutations(range(3))) for k, (f, v) in enumerate(zip(p, (83.49, 60.53, 57.73), strict=True))]
    rows = spark.createDataFrame([(f, i, u, v) for f, i, u, v in e], "f int, event_id long, user_id int, value double").selectExpr("*", "TIMESTAMP_NTZ'2024-01-01 00:10:00' ts").cache()
    for f in range(3):
        rows.where(f"f = {f}").drop("f").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e.parquet")
    got = run_once(hourly_counts(spark, f"{tmp_path}/e.parquet"), "t", f"file://{tmp_path}").collect()
    assert len(got) == 6 and {r.total for r in got} == {sum_in_order((83.49, 60.53, 57.73))} and {r.n for r in got} == {3}
