import json

from pyspark.sql import functions as F

from equilens.sources import records
from equilens.streaming import monitor as mo


def test_json_lines_with_rejects(spark, tmp_path):
    ok = {"subject_id": 1, "toi": 23, "th": 5, "true_label": "Balanced", "condition": "ND", "run_idx": 0, "provider": "p", "model": "m", "ok": True, "response": {"risk_label": "Growth", "proposed_asset_mix": {"growth_pct": 82, "income_pct": 18}, "assumptions_made": {"demographics": ["age"]}}}
    failed = ok | {"ok": False, "response": {"error": "late"}, "subject_id": 2}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(ok), json.dumps(failed), '{"error": "x"}', "not json", ""]))
    calls, rejects = records.read_calls(spark, str(tmp_path / "a.jsonl"))
    assert calls.count() == 2 and rejects.count() == 2
    rows = {r["subject_id"]: r for r in records.tidy(calls).collect()}
    assert (rows[1]["acc"], rows[1]["ordinal_error"], rows[1]["growth_gap"]) == (0, 2, 30.0)
    assert rows[2]["pred_label"] is None and rows[2]["acc"] is None and rows[2]["assumed_demo"] == "[]"
    assert records.assumption_rate(records.tidy(calls), ["model"]).first()["assumption_rate"] == 0.5


def test_catalogue_versions_checkpoint_config(spark, tmp_path):
    for run, flags in (("r1", [True, False]), ("r2", [True])):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "results.jsonl").write_text("\n".join(json.dumps({"ok": f, "model": "m"}) for f in flags))
    got = {r["run"]: (r["n"], r["success_pct"]) for r in records.catalogue(spark, str(tmp_path / "runs")).collect()}
    assert got == {"r1": (2, 50.0), "r2": (1, 100.0)}
    assert records.read_versions(spark, str(tmp_path / "none")).count() == 0
    records.append_versions(spark.sql("select 'v1' version_id, timestamp'2024-01-01' timestamp, '{}' payload"), str(tmp_path / "log"))
    assert records.read_versions(spark, str(tmp_path / "log")).first()["version_id"] == "v1"
    state = {"total_calls": 5, "completed_calls": 3, "failed_calls": 1, "start_time": 1.0, "last_checkpoint": 2.0}
    records.save_checkpoint(spark, state, str(tmp_path / "cp"))
    assert records.load_checkpoint(spark, str(tmp_path / "cp")) == state and records.load_checkpoint(spark, str(tmp_path / "nocp")) is None
    config = records.AuditConfig(models=("a", "b"), repeats=2)
    config.save(str(tmp_path / "c.json"))
    assert records.AuditConfig.load(str(tmp_path / "c.json")) == config
    (tmp_path / "bad.json").write_text('{"unknown": 1}')
    try:
        records.AuditConfig.load(str(tmp_path / "bad.json"))
        raise AssertionError
    except TypeError:
        pass
    assert records.progress(10, 5, 0, 10.0)["seconds_left"] == 10.0


def test_upsert_sink_and_sessions(spark, tmp_path):
    src = tmp_path / "src"
    df = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 'a'), (1, timestamp'2024-01-01 00:10:00', 'b'), (2, timestamp'2024-01-01 02:00:00', 'c') t(k, ts, v)")
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = stream.writeStream.foreachBatch(mo.upsert_into(str(tmp_path / "out"), ["k"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert mo.latest(spark, str(tmp_path / "out"), ["k"]).count() == 2
    out = mo.sessions(spark.readStream.schema(df.schema).parquet(str(src)), "ts", ["k"])
    q = out.writeStream.outputMode("complete").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("sess").collect()} == {(1, 2), (2, 1)}


def test_entry_without_the_llm_parts(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/equilens", tmp_path / "equilens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert F is not None
