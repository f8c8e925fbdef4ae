"""Readers, sinks and streaming edge cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tideline.sources import files
from tideline.streaming import jobs


def test_macro_csv_missing_token(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("series_id,obs_date,raw\nX,2020-01-01,1.5\nX,2020-01-02,.\nX,2020-01-03,oops\nX,2021-01-01,9\n")
    got = [(str(r.obs_date), r.value) for r in files.read_macro_csv(spark, str(p), "2020-01-01", "2020-12-31").collect()]
    assert got == [("2020-01-01", 1.5), ("2020-01-02", None), ("2020-01-03", None)]


def test_bars_csv_is_end_inclusive(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("symbol,session,open,high,low,close,volume\nA,2020-01-01,1,2,1,2,10\nA,2020-01-02,1,2,1,2,10\nA,2020-01-03,1,2,1,2,10\n")
    assert files.read_bars_csv(spark, str(p), "2020-01-01", "2020-01-02").count() == 2


def test_growing_file_skips_broken_rows(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("a,b\n1,2\nx,y\n3,4\n5")
    assert files.read_growing_csv(spark, str(p), "a INT, b INT").filter("b IS NOT NULL").count() == 2


def test_leak_guard(spark, tmp_path):
    files.assert_no_leakage(["ret_5", "in_rsi"])
    for bad in ("out_rsi", "future_5d_return", "Label_End_At", "overall_x"):
        with pytest.raises(ValueError):
            files.assert_no_leakage(["ok", bad])
    p = tmp_path / "v.csv"
    p.write_text("event_id,future_return\n1,0.5\n")
    with pytest.raises(ValueError):
        files.read_vendor_events(spark, str(p))


def test_results_grow_new_columns(spark, tmp_path):
    path = str(tmp_path / "r")
    files.append_results(spark.createDataFrame([(1, 0.5)], "id int, score double"), path, "a")
    files.append_results(spark.createDataFrame([(2, 0.7, "x")], "id int, score double, tag string"), path, "b")
    got = sorted((r.id, r.tag, r.run_id) for r in files.read_results(spark, path).collect())
    assert got == [(1, None, "a"), (2, "x", "b")]


def test_strict_json_and_fingerprint(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.5), ("c", float("inf"))], "k string, v double")
    files.export_json(df, str(tmp_path / "j"))
    rows = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()), key=lambda r: r["k"])
    assert rows == [{"k": "a", "v": None}, {"k": "b", "v": 1.5}, {"k": "c", "v": None}]
    a, b = files.fingerprint(df).first(), files.fingerprint(df.orderBy(F.desc("k"))).first()
    assert a == b and a.rows == 3


def test_aligned_samples_keep_input_side_only(spark, tmp_path):
    p = str(tmp_path / "s.parquet")
    spark.createDataFrame([([1.0, 2.0], '{"in_rsi": [50, 51], "out_rsi": [60], "overall_x": [1]}'), ([1.0], "broken")], "input_window array<double>, technical string").write.parquet(p)
    got = [r.technical_in for r in files.read_aligned_samples(spark, p).orderBy(F.size("input_window").desc()).collect()]
    assert got == [{"in_rsi": [50.0, 51.0]}, {}]


def test_articles_and_event_tables(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": "1", "title": "t", "event_scores": {"earnings": 0.5}}, {"id": "2", "title": "u"}]))
    got = {r.id: r.event_scores for r in files.read_articles_json(spark, str(p)).collect()}
    assert got == {"1": {"earnings": 0.5}, "2": None}
    q = tmp_path / "e.json"
    q.write_text(json.dumps([{"id": "x", "date": "2020-01-01", "category": "CPI", "secondary_categories": ["RATES"]}]))
    assert files.read_event_table(spark, str(q)).first().secondary_categories == ["RATES"]


def _write_ticks(spark, folder, rows, name):
    schema = jobs.TICK_SCHEMA
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_late_rows_are_dropped_and_files_can_arrive_in_steps(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    f = str(tmp_path)
    first = [(i, t + dt.timedelta(minutes=10 * i), 1, "A", 4.0, '{"k": 1}') for i in range(40)]
    _write_ticks(spark, f, first, "in1")
    _write_ticks(spark, f, [(98, t + dt.timedelta(hours=8), 1, "A", 9.0, '{"k": 1}')], "in2")
    _write_ticks(spark, f, [(99, t, 1, "A", 9.0, '{"k": 1}'), (100, t + dt.timedelta(hours=12), 1, "A", 9.0, '{"k": 1}')], "in3")
    raw = spark.readStream.schema(jobs.TICK_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{f}/in*")
    out = jobs.run_to_table(jobs.tumbling_bars(jobs.shape_ticks(raw)), spark)
    got = {r.bar.hour: r.n for r in out.collect()}
    assert got[10] == 6  # the late row of the third file fell behind the watermark
    assert sum(got.values()) == 41  # all rows of the closed windows, once


def test_broken_lines_are_marked(spark):
    lines = spark.createDataFrame([('{"event_id": 1, "ts": "2024-01-01T00:00:00", "symbol": "A", "value": 2.5}',), ("{oops",)], "value string")
    got = [(r.event_id, r.x, r.broken) for r in jobs.parse_lines(lines).collect()]
    assert got == [(1, 2.5, False), (None, None, True)]


def test_record_sink_is_idempotent_and_refuses_changes(spark, tmp_path):
    path = str(tmp_path / "records")
    df = spark.createDataFrame([("m", "A", dt.date(2020, 1, 1), 0.6)], "model string, symbol string, session date, prob double")
    jobs.record_once(df, path)
    jobs.record_once(df, path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        jobs.record_once(df.withColumn("prob", F.lit(0.7)), path)


def test_stream_equals_batch_on_closed_windows(spark, data):
    stream = jobs.run_to_table(jobs.activity_sessions(jobs.tick_stream(spark, data)), spark)
    batch = jobs.activity_sessions(jobs.shape_ticks(spark.read.parquet(f"{data}/events.parquet")))
    assert stream.exceptAll(batch).count() == 0 and stream.count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "sharpe_ratio" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_records_refuse_changes_and_forget_repeats(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = [("m", "A", dt.date(2024, 1, 2), 0.5), ("m", "A", dt.date(2024, 1, 2), 0.5), ("m", "B", dt.date(2024, 2, 2), 0.1)]
    schema = "model string, symbol string, session date, p double"
    jobs.record_once(spark.createDataFrame(rows, schema), path)
    jobs.record_once(spark.createDataFrame(rows, schema), path)
    assert spark.read.parquet(path).count() == 2
    for changed in ([("m", "A", dt.date(2024, 1, 2), 0.6)], [("m", "C", dt.date(2024, 1, 2), 0.1), ("m", "C", dt.date(2024, 1, 2), 0.2)]):
        with pytest.raises(Exception, match="may not change"):
            jobs.record_once(spark.createDataFrame(changed, schema), path)
    assert spark.read.parquet(path).count() == 2


def test_enrichment_restart_adds_no_row(spark, data, tmp_path):
    bars = spark.createDataFrame([("view", dt.datetime(2024, 1, 1), 1.0)], "symbol string, bar_end timestamp, bar_close double")
    ticks = jobs.tick_stream(spark, data).select("event_id", "symbol", "ts")
    first = jobs.enrich_stream(ticks, bars, spark, str(tmp_path)).count()
    assert jobs.enrich_stream(ticks, bars, spark, str(tmp_path)).count() == first == spark.read.parquet(f"{data}/events.parquet").count()


@pytest.mark.parametrize("column", ["future_5d_direction", "Trend", "signal", "out_close", "ret_after_event", "my_future", "technical"])
def test_guard_names_every_leak(column):
    with pytest.raises(ValueError, match=column):
        files.assert_no_leakage(["close", column])
