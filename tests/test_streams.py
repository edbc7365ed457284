"""Incremental ingest over a folder of files."""

import json

from pyspark.sql import functions as F

from assayer.sources import blobs as B, configs as C
from assayer.streaming import streams as S

GOOD = {"correlation_id": "x", "config_id": "k", "inbound_data": {"headline": "h", "body": "b"}, "subject_results": None}


def folder(tmp_path, n=5):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(n):
        (src / f"b{i}.json").write_text(json.dumps({**GOOD, "correlation_id": f"x{i}"}, indent=1))
    (src / "note.txt").write_text("no blob")
    return src


def test_ingest_is_incremental(spark, tmp_path):
    src, out, mark = folder(tmp_path), str(tmp_path / "bronze"), str(tmp_path / "mark")
    S.ingest(B.stream_files(spark, str(src), 2), out, mark)
    bronze = spark.read.parquet(out)
    assert bronze.count() == 5 and bronze.columns == ["payload", "source_path", "ingested_at"]
    S.ingest(B.stream_files(spark, str(src), 2), out, mark)
    assert spark.read.parquet(out).count() == 5
    (src / "late.json").write_text(json.dumps(GOOD))
    S.ingest(B.stream_files(spark, str(src), 2), out, mark)
    assert spark.read.parquet(out).count() == 6
    assert B.inbound(B.parse_blobs(spark.read.parquet(out))).select("body").distinct().collect()[0].body == "b"


def test_a_table_streams_as_one_file_and_as_a_folder(spark, tmp_path):
    rows = spark.range(100)
    rows.repartition(3).write.parquet(str(tmp_path / "folder.parquet"))
    rows.repartition(3).write.parquet(str(tmp_path / "other.parquet"))
    (part,) = [p for p in (tmp_path / "other.parquet").iterdir() if p.name.startswith("part-00000")]
    (tmp_path / "file.parquet").write_bytes(part.read_bytes())
    for name in ("folder", "file"):
        out, mark = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-mark")
        for _ in range(2):  # the second run finds nothing new
            S.ingest(S.table_stream(spark, str(tmp_path), f"{name}.parquet", rows.schema, 1), out, mark)
        want = spark.read.parquet(str(tmp_path / f"{name}.parquet"))
        assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(r.id for r in want.collect())


def test_bounded_ingest_stops_early(spark, tmp_path):
    src, out, mark = folder(tmp_path, 12), str(tmp_path / "bronze"), str(tmp_path / "mark")
    seen = S.bounded_ingest(B.stream_files(spark, str(src), 1), out, mark, rows=2, poll_seconds=0.02)
    assert seen >= 2
    S.ingest(B.stream_files(spark, str(src)), out, mark)
    assert spark.read.parquet(out).count() == 12
    assert S.bounded_ingest(B.stream_files(spark, str(src), 1), out, mark, rows=2) == 0  # nothing new: it returns


def test_malformed_payloads_are_kept_apart(spark):
    raw = spark.createDataFrame([("{bad",), ("{}",), (json.dumps(GOOD),), (json.dumps({**GOOD, "new_field": 1}),)], "payload STRING")
    assert B.quarantine(raw).collect()[0].payload == "{bad"
    assert B.parse_blobs(raw).count() == 3
    assert B.subject_results(B.parse_blobs(raw)).count() == 0


def test_config_files(spark, tmp_path):
    for name, doc in {"a": {"snapshot": {"subjects": [{"id": 1, "name": "Acme"}, {"id": 2}]}}, "b": {"snapshot_data": {"subjects": []}}, "c": {"snapshot": None}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "d.json").write_text("{bad")
    raw = B.config_files(spark, str(tmp_path))
    assert {r.config_id for r in raw.collect()} == {"a", "b", "c", "d"}
    s = C.snapshot_unwrap(raw)
    assert {r.config_id for r in s.collect()} == {"a", "b"}
    assert [(r.pos, r.subject_id, r["name"]) for r in C.subject_rows(s).orderBy("pos").collect()] == [(0, "1", "Acme"), (1, "2", "Subject 2")]


def test_latest_across_batches(spark, tmp_path):
    src, out, mark = tmp_path / "in", str(tmp_path / "latest"), str(tmp_path / "mark")
    schema = "id LONG, created_at TIMESTAMP, config_id STRING, correlation_id STRING, status STRING"
    row = lambda i, t, s: f"({i}, timestamp'2024-01-0{t}', 'k', 'c', '{s}')"
    for vals in ((row(1, 1, "old"), row(2, 3, "newest")), (row(3, 2, "late"),)):
        spark.sql(f"select * from values {', '.join(vals)} as t(id, created_at, config_id, correlation_id, status)").select(
            F.col("id").cast("long"), "created_at", "config_id", "correlation_id", "status").write.mode("append").parquet(str(src))
        log = spark.readStream.schema(schema).parquet(str(src))
        S.stream_latest(log, out, mark)
    assert [r.status for r in S.read_latest(spark, out, log.schema).collect()] == ["newest"]


RECORD = "article_no LONG, run_id STRING, config_id STRING, status STRING, at TIMESTAMP"


def progress(spark, src, out, mark, rows, **more):
    spark.sql("select * from values " + ", ".join(f"({n}, '{r}', '{c}', '{s}', timestamp'2024-01-{day:02d} {hour:02d}:00:00')" for n, r, c, s, day, hour in rows) + " as t(article_no, run_id, config_id, status, at)").selectExpr(
        "cast(article_no as bigint) as article_no", "run_id", "config_id", "status", "at").coalesce(1).write.mode("append").parquet(src)
    S.stream_progress(spark.readStream.schema(RECORD).parquet(src), out, mark, ["article_no"], "at", "6 hours", **more)
    return sorted(map(tuple, S.read_progress(spark, out).collect())), [tuple(r) for r in S.read_batch_log(spark, out).orderBy("batch_id").collect()]


def test_progress_counts_once_reports_late_and_forgets(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "p"), str(tmp_path / "mark")
    got, _ = progress(spark, src, out, mark, [(1, "r", "k", "ok", 1, 0), (2, "r", "k", "failed", 1, 1), (2, "r", "k", "failed", 1, 1)])
    assert got == [("r", "k", 1, 1, 0)]
    got, log = progress(spark, src, out, mark, [(1, "r", "k", "ok", 1, 0), (3, "r", "z", "skipped", 1, 3)], merge_every=1)  # record 1 again, in another batch
    assert got == [("r", "k", 1, 1, 0), ("r", "z", 0, 0, 1)] and max(r[3] for r in log) == 3
    got, log = progress(spark, src, out, mark, [(4, "s", "k", "ok", 9, 0)])  # eight days on: the run before is over
    got, log = progress(spark, src, out, mark, [(5, "s", "k", "ok", 9, 1), (9, "r", "k", "ok", 1, 2)])  # and one record of it comes late
    assert got == [("r", "k", 1, 1, 0), ("r", "z", 0, 0, 1), ("s", "k", 2, 0, 0)]
    assert sum(r[2] for r in log) == 1 and log[-1][3] == 2  # one late record; only the open run's records are state


def test_folds_do_not_depend_on_their_rhythm(spark, tmp_path):
    src, out, mark = str(tmp_path / "in"), str(tmp_path / "p"), str(tmp_path / "mark")
    for i, every in enumerate((3, 1, 2, 5, 1, 2)):
        got, _ = progress(spark, src, out, mark, [(i, "r", "k", "ok", 1, i)], merge_every=every)
        assert got == [("r", "k", i + 1, 0, 0)]


def test_sequences_from_a_stream(spark, tmp_path):
    """Several files and a restart give the table of the batch; broken texts are kept apart."""
    from assayer.operators import training as T
    from tests.test_policy import flow
    sets, src = flow(spark), tmp_path / "in"
    src.mkdir()
    record = lambda i: {"correlation_id": f"c{i}", "config_id": "k", "headline": f"Acme {i}", "body": "word " * (300 * i), "subject_results": [{"subject_id": "1", "is_valid": True, "prominence": "passing", "sentiment": "neutral"}]}
    articles = lambda parsed: parsed.selectExpr("correlation_id", "config_id", "body as state", "subject_results", "cast(array() as array<struct<tag_id: string, result: boolean>>) as base_tags")
    run = lambda: S.stream_sequences(B.stream_files(spark, str(src), 2), articles, sets, T.whitespace_tokenizer, str(tmp_path / "out"), str(tmp_path / "mark"))
    for lo, hi in ((0, 3), (3, 7)):
        for i in range(lo, hi):
            (src / f"b{i}.json").write_text(json.dumps(record(i)) if i != 4 else "{bad")
        run()
    run()
    payloads = spark.createDataFrame([(json.dumps(record(i)),) for i in range(7) if i != 4], "payload STRING")
    want = T.encode_windows(articles(B.parse_blobs(payloads)), sets, T.whitespace_tokenizer).collect()
    got = S.read_windows(spark, str(tmp_path / "out")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want))) and len(got) > 18
    assert [r.payload for r in spark.read.parquet(str(tmp_path / "out" / "dead_letters")).collect()] == ["{bad"]


def test_newest_rows_are_merged_and_complete(spark, tmp_path):
    src, out, mark = str(tmp_path / "log"), str(tmp_path / "latest"), str(tmp_path / "mark")
    for i in range(7):  # one file a batch; key k0 comes in each, k<i> in one
        rows = [("cfg", "k0", i, i), ("cfg", f"k{i}", i, i)]
        spark.createDataFrame(rows, "config_id STRING, correlation_id STRING, id LONG, created_at LONG").coalesce(1).write.mode("append").parquet(src)
    log = lambda: spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    S.stream_latest(log(), out, mark, merge_every=3)
    newest = lambda: {r.correlation_id: r.id for r in S.read_latest(spark, out, log().schema).collect()}
    got = newest()
    assert got == {"k0": 6} | {f"k{i}": i for i in range(1, 7)}
    assert sorted(p.name for p in (tmp_path / "latest" / "merged").iterdir()) == ["2", "5"]
    spark.createDataFrame([("cfg", "k2", 9, 9)], "config_id STRING, correlation_id STRING, id LONG, created_at LONG").coalesce(1).write.mode("append").parquet(src)
    S.stream_latest(log(), out, mark, merge_every=1)
    assert newest() == got | {"k2": 9}


def test_records_go_to_more_files_as_texts_grow():
    from assayer.plans import q_training as Q

    assert [Q.record_files(n) for n in (0, 1 << 20, 4 * Q.RECORD_FILE_BYTES, 4 * Q.RECORD_FILE_BYTES + 1, 6_000_000_000)] == [4, 4, 4, 6, 90]
