"""CSV exports, archives, integrity, registries and sinks in a scratch folder."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyco.operators import registry as G
from glyco.operators import udf as U
from glyco.operators.udf import map_reduce
from glyco.sources import files as S
from glyco.sources import sinks as K

HEAD = "EventDateTime,DeviceMode,BolusType,Basal,CorrectionDelivered,TotalBolusInsulinDelivered,FoodDelivered,CarbSize,CGM"


def test_csv_headers_in_different_order(spark, tmp_path):
    a, b = tmp_path / "Subject 1", tmp_path / "Subject2"
    a.mkdir()
    b.mkdir()
    (a / "x.csv").write_text(f"{HEAD}\n2024-01-01 00:00:00,auto,NA,0.5,,nan,0,10,120\nbad time,auto,std,x,1,2,3,4,130\n")
    (b / "y.csv").write_text("CGM,EventDateTime,Extra\n140,2024-01-01 00:05:00,hello\n")
    df = S.read_cgm_csv(spark, str(tmp_path))
    rows = {(r["participant_id"], r["CGM"]): r for r in df.collect()}
    assert set(rows) == {("subject_1", 120.0), ("subject_1", 130.0), ("subject_2", 140.0)}
    first = rows[("subject_1", 120.0)]
    assert first["BolusType"] is None and first["TotalBolusInsulinDelivered"] is None and first["Basal"] == 0.5
    assert rows[("subject_1", 130.0)]["EventDateTime"] is None and rows[("subject_1", 130.0)]["Basal"] is None
    assert rows[("subject_2", 140.0)]["Extra"] == "hello"
    probe = {r["complete"] for r in S.probe_headers(spark, str(tmp_path)).collect()}
    assert probe == {True, False}


def test_no_csv_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        S.read_cgm_csv(spark, str(tmp_path))


def test_skipped_files_and_nothing_to_read(spark, tmp_path):
    for name, text in {"good.csv": f"{HEAD}\n2024-01-01 00:00:00,auto,NA,0.5,,nan,0,10,120\n", "foreign.csv": "foo,bar\n1,2\n", "cut.csv": HEAD[:40]}.items():
        (tmp_path / name).write_text(text)
    found = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in S.skipped_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"foreign.csv", "cut.csv"} and all(x.startswith("missing columns: ") for x in found.values())
    assert S.read_cgm_csv(spark, str(tmp_path)).filter("CGM = 120").count() == 1
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "head.csv").write_text(HEAD + "\n")
    with pytest.raises(ValueError):
        S.read_cgm_csv(spark, str(bare))


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.csv", "a\n1\n")
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("top.csv", "b\n2\n")
        z.writestr("nested.zip", inner.getvalue())
    (tmp_path / "broken.zip").write_bytes(b"not a zip")
    rows = S.archive_entries(spark, str(tmp_path)).collect()
    texts = {r["entry"]: r["text"] for r in rows if r["text"]}
    assert texts == {"top.csv": "b\n2\n", "deep.csv": "a\n1\n"}
    assert [r["crc_ok"] for r in rows if r["archive"].endswith("broken.zip")] == [False]


def test_integrity(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"hello")
    (tmp_path / "empty.bin").write_bytes(b"")
    files = S.file_integrity(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.collect()}
    assert rows["f.bin"]["md5"] == hashlib.md5(b"hello").hexdigest() and "empty.bin" not in rows
    # Spark lists no empty files, so an empty one is found missing.
    both = files.select("path").unionByName(files.select(F.replace("path", F.lit("f.bin"), F.lit("empty.bin")).alias("path")))
    expected = both.withColumn("expected_hash", F.lit(hashlib.sha256(b"hello").hexdigest()))
    intact = {r["path"].rsplit("/", 1)[1]: r["intact"] for r in S.verify_files(files, expected).collect()}
    assert intact == {"f.bin": True, "empty.bin": False}
    joined = hashlib.sha256(b"hello").hexdigest()
    assert S.folder_hash(files).first()["folder_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_registry_and_runs(spark, tmp_path):
    registry = {"m": {f"1.{i}.0": {"created_at": f"2024-01-{i + 1:02d}T00:00:00", "performance": {"loss": 1.0 / (i + 1)}, "description": "", "tags": ["t"]} for i in range(12)}}
    (tmp_path / "registry.json").write_text(json.dumps(registry, indent=1))
    versions = G.read_registry(spark, str(tmp_path / "registry.json"))
    assert G.latest_versions(versions).first()["version"] == "1.11.0"
    assert {r["version"] for r in G.surplus_versions(versions, 10).collect()} == {"1.0.0", "1.1.0"}
    candidates = spark.createDataFrame([("m", 0.01), ("new", 1.0)], "model string, loss double")
    assert {r["model"]: r["next_version"] for r in G.next_version(versions, candidates).collect()} == {"m": "1.12.0", "new": "1.0.0"}
    run = {"run_id": "r1", "status": "completed", "history": [{"epoch": i, "timestamp": f"2024-01-01T00:0{i}:00", "loss": 5.0 - i, "mae": i} for i in range(4)]}
    (tmp_path / "run.json").write_text(json.dumps(run))
    logs = G.read_run_logs(spark, str(tmp_path / "run.json"))
    stats = {r["metric"]: r for r in G.run_statistics(logs).collect()}
    assert stats["loss"]["best"] == 2.0 and stats["mae"]["best"] == 3.0
    assert G.run_durations(logs).first()["duration_seconds"] == 180.0


def test_registry_and_run_files_hold_many_records(spark, tmp_path):
    from entry_queries import monitoring as Y

    for n in range(3):
        record = {"created_at": "2024-01-01T00:00:00", "performance": {"loss": float(n)}, "description": "", "tags": []}
        (tmp_path / f"registry{n}.json").write_text(json.dumps({f"m{n}{k}": {"1.0.0": record} for k in range(4)}))
        (tmp_path / f"runs{n}.json").write_text(json.dumps([{"run_id": f"r{n}{k}", "status": "completed", "history": [{"epoch": 1, "loss": k}]} for k in range(4)], indent=1))
    assert {r["model"] for r in G.read_registry(spark, str(tmp_path / "registry*.json")).collect()} == {f"m{n}{k}" for n in range(3) for k in range(4)}
    assert {r["run_id"]: r["value"] for r in G.read_run_logs(spark, str(tmp_path / "runs*.json")).collect()} == {f"r{n}{k}": k for n in range(3) for k in range(4)}
    # Files written for a table of 2000 users: a few, not one each.
    (tmp_path / "data").mkdir()
    spark.range(4000).selectExpr("id % 2000 user_id", "timestamp_ntz'2024-01-01 00:00:00' ts", "double(id) value").write.parquet(str(tmp_path / "data" / "events.parquet"))
    folder = Y.registry_folder(spark, str(tmp_path / "data"))
    assert G.read_registry(spark, folder).count() == 2000 and spark.read.text(folder, wholetext=True).count() <= 8
    logs = Y.read_run_logs(spark, str(tmp_path / "data"))
    assert logs.count() == 2000 and len(logs.inputFiles()) <= 8


def test_user_function_per_group(spark):
    """Groups that cross batches, null keys and null whole numbers beside large ones; Python is not entered once per group."""
    big = 2**60 + 1
    rows = [(None if k % 50 == 49 else k % 50, "a" if k % 2 else None, big if k % 50 < 25 else None, k % 50 == 3 or None) for k in range(3000)]
    df = spark.createDataFrame(rows, "participant_id long, name string, x long, flag boolean")

    def told(pdf):
        x, flag = pdf["x"], pdf["flag"]
        return pd.DataFrame({"id": [pdf["participant_id"].iat[0]], "n": [len(pdf)], "x": [int(x.iat[0]) if x.notna().all() else None], "t": [f"{x.dtype} {flag.dtype} {list(pdf.index) == list(range(len(pdf)))}"], "names": [pdf["name"].nunique(dropna=False)]})

    schema = "id long, n long, x long, t string, names long"
    out = U.apply_per_participant(df, told, schema)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        got = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == {tuple(r) for r in df.groupBy("participant_id").applyInPandas(told, schema).collect()} and len(got) == 50
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_sequence_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", [[1.0]], 1.0, "train"), ("b", [[2.0]], 2.0, "test")], "participant_id string, x array<array<double>>, y double, split string")
    K.write_sequences(df, str(tmp_path / "out"), spark.createDataFrame([(1,)], "steps int"))
    assert K.read_sequences(spark, str(tmp_path / "out"), "train").first()["participant_id"] == "a"
    text = K.render_report(K.tidy(spark.createDataFrame([(1.5, "x")], "m double, n string"), "part"), "Title")
    assert "m: 1.5" in text and text.startswith("Title")


def test_map_reduce(spark):
    out = map_reduce(spark.range(1000).toDF("n"), lambda b: b["n"] * 2.0, lambda a, b: a + b, fan_in=4)
    assert out.first()["result"] == 999000.0


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    from glyco.streaming import live as L

    folder, schema = tmp_path / "in", "participant_id long, EventDateTime timestamp, CGM double, Basal double, TotalBolusInsulinDelivered double, FoodDelivered double"
    folder.mkdir()

    def feed(name, times):
        rows = spark.createDataFrame([(1, t, 100.0, 0.0, 0.0, 0.0) for t in times], "participant_id long, t string, CGM double, Basal double, TotalBolusInsulinDelivered double, FoodDelivered double")
        table = rows.select("participant_id", F.to_timestamp("t").alias("EventDateTime"), "CGM", "Basal", "TotalBolusInsulinDelivered", "FoodDelivered")
        table.coalesce(1).write.mode("append").parquet(str(folder / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        query = L.run_to_parquet(L.stream_resample(stream, "5 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
        return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

    feed("a", ["2024-01-01 00:00:00", "2024-01-01 02:00:00"])
    assert run() == 0
    feed("b", ["2024-01-01 00:01:00", "2024-01-01 02:01:00"])  # the first is later than the watermark allows
    assert run() == 1


def test_written_tables_can_be_dropped(spark):
    from glyco.session import drop_written, write_through

    drop_written(spark)
    table = write_through(spark.range(10))
    path = table.inputFiles()[0]
    assert table.count() == 10
    assert drop_written(spark) == 1 and drop_written(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


class Counted(io.BytesIO):
    """A stream that counts the bytes read from it."""

    taken = 0

    def read(self, size=-1):
        out = super().read(size)
        self.taken += len(out)
        return out


def test_probe_reads_the_head_only():
    from glyco.sources import handles as H

    stream = Counted(b"a,b\n" + b"1,2\n" * 5_000_000)
    assert H.first_line(stream) == "a,b" and stream.taken == H.STEP
    endless = Counted(b"x" * 3_000_000)
    assert len(H.first_line(endless)) == H.HEAD_LIMIT == endless.taken
    assert H.first_line(io.BytesIO(b"\r\n\r\nCGM,x\r\n1,2")) == "CGM,x"
    assert H.first_line(io.BytesIO(b"")) is None and H.first_line(io.BytesIO(b"\n\n")) is None


def test_hash_trees(spark, tmp_path):
    texts = {"a.bin": b"0123456789" * 50, "b c+%.bin": b"z", "Ünï.bin": b"q" * 64}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)

    def sha(x):
        return hashlib.sha256(x).hexdigest()

    def tree(hashes, fan):
        while True:
            hashes = [sha("".join(hashes[i : i + fan]).encode()) for i in range(0, len(hashes), fan)]
            if len(hashes) == 1:
                return hashes[0]

    files = S.file_integrity(spark, str(tmp_path))
    assert sorted((r.length, r.sha256) for r in files.collect()) == sorted((len(t), sha(t)) for t in texts.values())
    got = {r.tree_sha256 for r in S.file_trees(spark, str(tmp_path), range_bytes=64, fan=3).collect()}
    assert got == {tree([sha(t[i : i + 64]) for i in range(0, len(t), 64)], 3) for t in texts.values()}
    many = spark.range(50).select(F.format_string("p%03d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    row = S.folder_hash(many, fan=4).first()
    assert (row.folder_sha256, row.n_files) == (tree([sha(str(k).encode()) for k in range(50)], 4), 50)


def test_file_streams(spark, tmp_path):
    import pandas as pd

    from glyco.operators.udf import map_file_streams, map_files

    for k in range(3):
        (tmp_path / f"f {k}.txt").write_text("line\n" * (1000 + k))

    def lines(path, stream):
        while part := stream.read(1024):
            yield pd.DataFrame({"n": [part.count(b"\n")]})

    assert map_file_streams(spark, str(tmp_path), lines, "n long", "*.txt").agg(F.sum("n")).first()[0] == 3003
    sizes = map_files(spark, str(tmp_path), lambda path, content: pd.DataFrame({"n": [len(content)]}), "n long", "*.txt")
    assert sorted(r.n for r in sizes.collect()) == [5000, 5005, 5010]
