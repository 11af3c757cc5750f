import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gridmill.functions import filemeta
from gridmill.operators.ordered import failure_streak, rate_window
from gridmill.sources import files, ingest, payloads, sinks
from gridmill.streaming import jobs, keyed


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="gridmill-test-")


def put(folder, name, content):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(content)
    return path


def test_file_facts(spark, folder):
    put(folder, "a.csv", "id,näme\n1,ä\n2,ö\n".encode("utf-8"))
    put(folder, "b.csv", b"\xef\xbb\xbfid;name\n1;x,y\n2;y\n")
    put(folder, "c.csv", "id\tname\n1\té\n".encode("latin-1"))
    put(folder, "d.csv", b"id|name\n1|\x80 euro\n")
    put(folder, "e.csv", b"plain words\n")
    put(folder, "copy.csv", "id,näme\n1,ä\n2,ö\n".encode("utf-8"))

    def by_name(df, column):
        return {os.path.basename(r["path"]): r[column] for r in df.collect()}
    assert by_name(files.infer_delimiters(spark, folder), "delimiter") == {
        "a.csv": ",", "b.csv": ";", "c.csv": "\t", "d.csv": "|", "e.csv": None, "copy.csv": ","}
    assert by_name(files.detect_encodings(spark, folder), "encoding") == {
        "a.csv": "utf-8", "b.csv": "utf-8", "c.csv": "latin-1", "d.csv": "cp1252", "e.csv": "utf-8", "copy.csv": "utf-8"}
    marked = files.first_copies(files.file_hashes(spark, folder), order=["path"])
    assert by_name(marked, "is_duplicate") == {
        "a.csv": False, "b.csv": False, "c.csv": False, "d.csv": False, "e.csv": False, "copy.csv": False} | {"copy.csv": True} \
        or by_name(marked, "is_duplicate")["a.csv"] != by_name(marked, "is_duplicate")["copy.csv"]
    assert files.list_files(spark, folder, prefix="c").count() == 2


def test_bad_lines_are_kept_aside(spark, folder):
    put(folder, "x.csv", b'id,name,v\n1,a,2\n2,"b,c",3\n3,short\n4,d,5,6\n')
    good, bad = files.read_csv(spark, folder)
    assert sorted(tuple(r) for r in good.collect())[2] == ("3", "short", None)
    assert good.count() == 3 and [r["line"] for r in bad.collect()] == ["4,d,5,6"]


def test_quotes_breaks_and_header_orders(spark, folder):
    put(folder, "a.csv", b'id,name,v\n1,"a ""q"", b",5\n2,"two\nlines",6\n3,"x,y",7,\n4,"p",8,"9,10"\n')
    put(folder, "b.csv", b'v,id\n50,10\n')
    good, bad = files.read_csv(spark, folder)
    assert {tuple(r) for r in good.select("id", "name", "v").collect()} == {
        ("1", 'a "q", b', "5"), ("2", "two\nlines", "6"), ("3", "x,y", "7"), ("10", None, "50")}
    assert [r["line"] for r in bad.collect()] == ['4,"p",8,"9,10"']


def test_export_reads_back(spark, folder):
    rows_in = [("1", 'say "a, b"'), ("2", "two\nlines"), ("3", "  blanks  "), ("4", None), ("5", "a;b\\")]
    target = os.path.join(folder, "out")
    sinks.export_csv(spark.createDataFrame(rows_in, "k string, v string"), target)
    assert sorted(tuple(r) for r in files.read_csv(spark, target)[0].collect()) == rows_in


def test_router_and_guards(spark, folder):
    put(folder, "t.csv", b"a,b\n1,2\n")
    df = files.read_table(spark, os.path.join(folder, "t.csv"))
    assert files.require_shape(df) is df
    with pytest.raises(ValueError):
        files.require_shape(df, 2)
    with pytest.raises(ValueError):
        files.require_shape(df, 1, 3)
    with pytest.raises(ValueError):
        files.read_table(spark, "x.xlsx")


def test_admission(spark):
    df = spark.createDataFrame([("a.CSV", 5), ("b.png", 5), ("c.csv", 200 * 1024 * 1024)], "name string, size long")
    assert [r[0] for r in df.select(filemeta.admission_reason(F.col("name"), F.col("size"))).collect()] == [
        None, "type not allowed", "too large"]
    wild = filemeta.admission_reason(F.col("name"), F.col("size"), ["image/*"], [])
    assert [r[0] for r in df.select(wild).collect()] == ["type not allowed", None, "type not allowed"]


def test_payloads(spark):
    docs = ['{"a": 1}', '[{"a": 2}, {"a": 3}]', '{"data": {"a": 4}}', '{"data": [{"a": 5}]}', "[]", "{}", "7", "{bad",
            '{"data": "{}"}', '[1]', '{"data": null, "a": 6}', None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, p string")
    good, bad = payloads.payload_rows(df, "p", ["i"])
    got = payloads.payload_fields(good, {"a": "int"})
    assert sorted((r["i"], r["item"], r["a"]) for r in got.collect()) == [
        (0, 0, 1), (1, 0, 2), (1, 1, 3), (2, 0, 4), (3, 0, 5), (10, 0, 6)]
    assert {r["i"]: r["reason"] for r in bad.collect()} == {
        4: "empty", 5: "empty", 6: "no object or array", 7: "not json", 8: "no object or array",
        9: "element is no object", 11: "not json"}


def test_ingest_and_replace(spark, folder):
    put(folder, "in.csv", "User ID,Full Name,Joined\n1, Ann ,2024-01-05\n1, Ann ,2024-01-05\n2,Bob,2024-02-06\n,,\n3,x,y,z\n".encode())
    target = os.path.join(folder, "store")
    done = ingest.ingest_csv(spark, os.path.join(folder, "in.csv"), target, "org", "d1",
                             rules={"required_columns": ["User ID"], "not_null": ["Full Name"]})
    got = sorted((r["row_number"], r["user_id"], r["full_name"], r["joined"].isoformat()) for r in done.records.collect())
    assert got == [(1, 1, "Ann", "2024-01-05T00:00:00"), (3, 2, "Bob", "2024-02-06T00:00:00")]
    assert [r["line"] for r in done.rejected_lines.collect()] == ["3,x,y,z"]
    assert {r["column"]: r["inferred_type"] for r in done.types.collect()} == {
        "User ID": "integer", "Full Name": "string", "Joined": "date"}
    assert {(r["rule"], r["severity"]) for r in done.checks.collect()} == {("required_columns", "info"), ("not_null", "error")}
    sinks.append_records(sinks.envelope(spark.range(3).withColumnRenamed("id", "row_number"), "org", "d2"), target)
    ingest.ingest_csv(spark, os.path.join(folder, "in.csv"), target, "org", "d1")
    assert sinks.read_records(spark, target, "org", "d1").count() == 2
    assert sinks.read_records(spark, target, "org", "d2").count() == 3
    contract = {r["column"]: r["category"] for r in ingest.column_contract(spark, target, "org", "d1").collect()}
    assert contract == {"user_id": "numeric", "full_name": "categorical", "joined": "datetime"}


@pytest.fixture(scope="module")
def split_events(spark, tables):
    """The events as six files in time order, so that a stream sees six batches."""
    path = tempfile.mkdtemp(prefix="gridmill-events-")
    n = tables.events.count()
    for i in range(6):
        part = tables.events.filter((F.col("event_id") >= n * i // 6) & (F.col("event_id") < n * (i + 1) // 6))
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_streaks_across_batches(spark, tables, split_events, folder):
    failed = F.col("event_type") != "view"
    stream = jobs.read_stream(spark, split_events, tables.events.schema, files_per_batch=1)
    query = jobs.streaks(stream, "user_id", "event_id", failed, f"{folder}/out", f"{folder}/cp")
    jobs.run_available(query)
    assert len(jobs.progress(query)) >= 6 and jobs.progress(query)[-1]["percent"] == 100.0
    got = spark.read.parquet(f"{folder}/out/rows").select("event_id", "failure_count")
    want = failure_streak(tables.events, "user_id", "event_id", failed).select("event_id", "failure_count")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_rates_across_batches(spark, tables, split_events, folder):
    def timed(df):
        return df.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    stream = timed(jobs.read_stream(spark, split_events, tables.events.schema, files_per_batch=1))
    jobs.run_available(jobs.rates(stream, "user_id", "t", 86_400, 3, f"{folder}/out", f"{folder}/cp"))
    got = spark.read.parquet(f"{folder}/out/rows").select("event_id", "current_count")
    want = rate_window(timed(tables.events), "user_id", "t", 86_400, 3).select("event_id", "current_count")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_tumbling_across_batches(spark, tables, split_events, folder):
    stream = jobs.read_stream(spark, split_events, tables.events.schema, files_per_batch=1)
    windows = jobs.tumbling(stream, "ts", "1 day", "1 day", {"n": F.count(F.lit(1))})
    jobs.run_available(jobs.write_updates(windows, f"{folder}/out", f"{folder}/cp"))
    got = jobs.latest_updates(spark, f"{folder}/out", ["window_start"])
    want = tables.events.groupBy(F.date_trunc("day", "ts").alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("files", [1, 3])
def test_streams_read_tables_of_many_files(spark, tmp_path, files):
    import __spark_entry__ as entry
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    docs.filter("doc_id % 2 = 0").select("doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"] for r in entry.queries()["stream_check"](spark, str(tmp_path)).collect()} == set(range(0, 40, 2))


@pytest.fixture(scope="module")
def unordered_log(spark, tables):
    """The events as eight files in the order of arrival, some rows one or three files late; and the rows with their file."""
    path = tempfile.mkdtemp(prefix="gridmill-log-")
    home = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 5)
    delay = F.when(F.col("event_id") % 50 == 0, 3).when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    told = tables.events.withColumn("_b", F.least(home + delay, F.lit(7)))
    for n in range(8):
        told.filter(F.col("_b") == n).drop("_b").coalesce(1).write.mode("append").parquet(path)
    rows = [(r["event_id"], int(r["t"]), r["_b"]) for r in told.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "_b").collect()]
    high = [max(t for _, t, b in rows if b <= n) for n in range(8)]
    late = {i for i, t, b in rows if b > 1 and t <= (high[b - 2] // 1000 - 172_800_000) * 1000}
    passed = (high[7] // 1000 - 172_800_000) * 1000
    return path, late, {i for i, t, _ in rows if i not in late and t <= passed}


def test_rates_of_rows_out_of_order(spark, tables, unordered_log, folder):
    path, late, final = unordered_log
    stream = jobs.read_stream(spark, path, tables.events.schema, files_per_batch=1)
    query = keyed.keyed_rates(stream, "user_id", "ts", 86_400, 3, "2 days", ["event_id"], f"{folder}/out", f"{folder}/cp")
    jobs.run_available(query)
    assert len(jobs.progress(query)) >= 8 and keyed.dropped(query) == len(late) > 0
    timely = tables.events.filter(~F.col("event_id").isin(list(late))).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    want = {r["event_id"]: (r["current_count"], r["is_allowed"], r["remaining"]) for r in rate_window(timely, "user_id", "t", 86_400, 3).collect() if r["event_id"] in final}
    got = {r["event_id"]: (r["current_count"], r["is_allowed"], r["remaining"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == want and set(got) == final


def test_streaks_of_rows_out_of_order(spark, tables, unordered_log, folder):
    path, late, final = unordered_log
    stream = jobs.read_stream(spark, path, tables.events.schema, files_per_batch=1)
    failed = F.col("event_type") != "view"
    jobs.run_available(keyed.keyed_streaks(stream, "user_id", "ts", "event_id", failed, "2 days", f"{folder}/out", f"{folder}/cp", disable_at=3))
    want, streak = {}, {}
    for r in sorted(tables.events.collect(), key=lambda r: (r["ts"], r["event_id"])):
        if r["event_id"] not in late:
            streak[r["user_id"]] = n = streak.get(r["user_id"], 0) + 1 if r["event_type"] != "view" else 0
            want[r["event_id"]] = (n, n >= 3)
    got = {r["event_id"]: (r["failure_count"], r["auto_disable"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    assert got == {i: x for i, x in want.items() if i in final}


@pytest.fixture()
def many_keys(spark, folder):
    """Four files, a day each, of 400 keys (one null, some above 2 ** 53); as a stream, and as rows of (key, day, position, failed)."""
    rows = [(None if k == 7 else (1 << 60) + k, d, None if d == 3 and k % 5 == 0 else (1 << 58) + 4 * k + d, None if k % 11 == d else k % 3 != d) for k in range(400) for d in range(4)]
    frame = spark.createDataFrame(rows, "k long, d int, p long, failed boolean").withColumn("ts", F.timestamp_micros(F.col("d").cast("long") * 86_400_000_000 + 1))
    for d in range(4):
        frame.filter(F.col("d") == d).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.read_stream(spark, f"{folder}/in", frame.schema, files_per_batch=1), rows


def state_rows(query):
    return max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators)


def test_streaks_share_states_of_many_keys(spark, many_keys, folder, monkeypatch):
    monkeypatch.setattr(keyed, "GROUPS", 4, raising=False)
    stream, rows = many_keys
    query = keyed.keyed_streaks(stream, "k", "ts", "p", F.col("failed"), "1 second", f"{folder}/out", f"{folder}/cp", disable_at=2)
    jobs.run_available(query)
    want, streak = [], {}
    for k, d, p, failed in sorted(rows, key=lambda r: r[1]):
        streak[k] = n = streak.get(k, 0) + 1 if failed else 0
        if d < 3:  # the last day has not been passed
            want.append((k, p, n, n >= 2))
    assert sorted(map(repr, map(tuple, spark.read.parquet(f"{folder}/out").collect()))) == sorted(map(repr, want))
    assert state_rows(query) <= 40


def test_rates_share_states_of_many_keys(spark, many_keys, folder, monkeypatch):
    monkeypatch.setattr(keyed, "GROUPS", 4, raising=False)
    stream, rows = many_keys
    query = keyed.keyed_rates(stream, "k", "ts", 2 * 86_400, 2, "1 second", ["p", "failed"], f"{folder}/out", f"{folder}/cp")
    jobs.run_available(query)
    # the window is open: it leaves out the row two days before
    want = [(k, p, failed, min(d, 1), d < 2 or min(d, 1) < 2, 2 - min(d, 1) - 1) for k, d, p, failed in rows if d < 3]
    assert sorted(map(repr, map(tuple, spark.read.parquet(f"{folder}/out").collect()))) == sorted(map(repr, want))
    assert state_rows(query) <= 40


def test_late_rows_are_stored_and_counted(spark, tables, unordered_log, folder):
    path, late, _ = unordered_log
    jobs.run_available(keyed.late_rows(jobs.read_stream(spark, path, tables.events.schema, files_per_batch=1), "ts", 172_800, f"{folder}/out", f"{folder}/cp"))
    stored = {name: [r["event_id"] for r in spark.read.parquet(f"{folder}/out/{name}").collect()] for name in ("late", "on_time")}
    assert sorted(stored["late"]) == sorted(late) and len(stored["late"]) + len(stored["on_time"]) == tables.events.count()
    marks = spark.read.parquet(f"{folder}/out/marks").agg(F.sum("late"), F.sum("on_time"), F.count("batch")).first()
    assert tuple(marks) == (len(late), len(stored["on_time"]), 8)


def test_a_reload_is_seen_as_a_whole(spark, tmp_path):
    def load(n, dataset="d1", **extra):
        rows = spark.range(n).withColumnRenamed("id", "row_number").withColumns({k: F.lit(v) for k, v in extra.items()})
        return sinks.envelope(rows, "org", dataset)

    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        sinks.read_records(spark, path)
    sinks.append_records(load(4), path)
    sinks.append_records(load(5, "d2"), path)
    before = sinks.read_records(spark, path, "org", "d1")
    assert before.count() == 4
    # a version without its manifest row, as a load leaves that has not ended, is not seen
    half = load(100).withColumn("version", F.lit("half"))
    half.write.mode("append").partitionBy(*sinks.PARTITIONS, "version").parquet(f"{path}/records")
    assert sinks.read_records(spark, path, "org", "d1").count() == 4
    sinks.replace_dataset(load(0), path, [("org", "d1")])
    assert before.count() == 4  # made before the swap
    empty = sinks.read_records(spark, path, "org", "d1")
    assert empty.count() == 0 and empty.columns == before.columns
    assert sinks.read_records(spark, path).groupBy("dataset_id").count().collect() == [("d2", 5)]
    sinks.append_records(load(2, note="new"), path)
    sinks.append_records(load(3), path)
    now = sinks.read_records(spark, path, "org", "d1")
    assert now.count() == 5 and now.filter("note = 'new'").count() == 2
    sinks.replace_dataset(load(1), path)
    assert sinks.read_records(spark, path, "org", "d1").count() == 1 and sinks.read_records(spark, path, "org", "none").count() == 0
    assert {(r["dataset_id"], r["kind"]) for r in sinks.live_versions(spark, path).collect()} == {("d1", "replace"), ("d2", "append")}


def test_a_file_without_rows_empties_its_dataset(spark, tmp_path):
    target = str(tmp_path / "records")
    sinks.append_records(sinks.envelope(spark.range(3).withColumnRenamed("id", "row_number"), "org", "d1"), target)
    sinks.replace_dataset(sinks.envelope(spark.range(0).withColumnRenamed("id", "row_number"), "org", "d1"), target, [("org", "d1")])
    assert sinks.read_records(spark, target, "org", "d1").count() == 0
