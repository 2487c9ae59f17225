"""Files and helpers that live on the driver."""

import json

from gazetta import __main__ as cli
from gazetta.operators import jobs
from gazetta.streaming import calls, local_models, state


def test_resume_state(spark, tmp_path):
    source = tmp_path / "in.csv"
    source.write_text("a\n1\n")
    ledger = spark.createDataFrame([("r1", "{}", None, 1), ("r2", None, "x", 3)], calls.LEDGER)
    state.save_state(str(tmp_path), str(source), ledger, 5, "m", 0.25)
    found = state.load_state(str(tmp_path), str(source))
    assert (found["completed"], found["api_calls"], found["total_cost"], found["total_records"]) == (2, 4, 0.5, 5)
    source.write_text("a\n1\n2\n")
    assert state.load_state(str(tmp_path), str(source)) is None
    assert state.clear_state(str(tmp_path), str(source)) and not state.clear_state(str(tmp_path), str(source))


def test_saved_jobs_are_listed(spark, tmp_path):
    state.save_job(str(tmp_path), {"batch_id": "b", "batch_name": "one", "dataset": "d", "record_count": 2, "submitted_at": "2024-01-01"})
    state.save_job(str(tmp_path), {"dataset": "s", "total_records": 7, "batches": [], "submitted_at": "2024-01-02"}, staggered=True)
    assert [(r.kind, r.record_count) for r in jobs.list_jobs(spark, str(tmp_path)).collect()] == [("staggered", 7), ("single", 2)]


def test_cached_probe():
    seen, now = [], [0.0]

    def fetch():
        seen.append(1)
        if len(seen) == 1:
            raise OSError
        return ["m"]

    cached = state.Cached(fetch, [], 15, lambda: now[0])
    assert cached.get() == [] and cached.get() == [] and len(seen) == 1
    now[0] = 16
    assert cached.get() == ["m"] and len(seen) == 2
    assert local_models.installed_cached("http://127.0.0.1:9").get() == []


def test_progress(spark, tmp_path):
    told = []
    listener = state.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        df = spark.createDataFrame([(0, "1", "A", "x")], "_row long, Barcode string, locality string, Country string")
        df.write.parquet(f"{tmp_path}/in")
        calls.stream_process(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/cp", calls.StubProvider(), f"{tmp_path}/ledger")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert told and told[-1]["processed"] >= 1


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "in.csv"
    path.write_text("Barcode,locality,Country\n1,A,x\n2,a,X\n")
    assert cli.main(["prep", str(path)]) == 0
    assert "'groups': 1" in capsys.readouterr().out
    assert cli.main(["datasets", str(tmp_path)]) == 0
    assert json.dumps(sorted(cli.parser().parse_args(["expand", "a", "b"]).__dict__)) and "in.csv" in capsys.readouterr().out


def test_small_helpers(spark, tmp_path):
    from pyspark.sql import functions as F

    from gazetta.functions import text
    from gazetta.operators import cost, results
    from gazetta.sources import readers

    names = spark.createDataFrame([("../a b/.hidden?.csv",), ("C:\\x\\y.tsv",)], "n string")
    assert [r[0] for r in names.select(text.safe_filename(F.col("n"))).collect()] == ["hidden_.csv", "y.tsv"]
    assert names.limit(1).select(text.model_slug(F.lit("GPT 5.mini_É"))).first()[0] == "gpt5mini_é"
    assert results.fetched_rate(names, 4).first().rate == 0.5 and results.fetched_rate(names, 0).first().rate == 0
    flags = spark.createDataFrame([(True, True, None), (True, None, "long enough key"), (False, True, "short"), (False, None, "long enough key")], "l boolean, i boolean, k string")
    assert [r[0] for r in flags.select(cost.ready(F.col("l"), F.col("i"), F.col("k"))).collect()] == [True, False, False, True]
    (tmp_path / "p.tsv").write_text("Barcode\tLatitude\tNote\n1\t2.5\t\n2\tx\ty\n")
    got = [(r["Latitude"], r["Note"]) for r in readers.read_progress(spark, str(tmp_path / "p.tsv")).orderBy("_row").collect()]
    assert got == [(2.5, None), (None, "y")]


def test_local_model(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self._say({"models": [{"name": "m1"}]})

        def do_POST(self):
            self._say({"message": {"content": "{}"}})

        def _say(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        assert local_models.installed(url) == ["m1"] and local_models.LocalModel("m1", url).call("x") == "{}"
        assert local_models.installed_table(spark, ["m1"]).count() == 1
    finally:
        server.shutdown()


def test_profiles(spark, monkeypatch):
    """Each layout against a server that answers in it and checks what it is asked."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import pytest

    from gazetta.streaming import profiles

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((dict(self.headers), body))
            if "busy" in json.dumps(body):
                self.send_response(429)
                self.end_headers()
                return
            answer = {"/chat": {"choices": [{"message": {"content": '{"a":1}'}}]}, "/messages": {"content": [{"type": "text", "text": '{"a":'}, {"text": "1}"}]}, "/keyed": {"candidates": [{"content": {"parts": [{"thought": True}, {"text": '{"a":1}'}]}}]}}[self.path]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "secret")
    try:
        for layout in (profiles.CHAT, profiles.MESSAGES, profiles.KEYED):
            profile = profiles.Profile("m", "id-1", f"http://127.0.0.1:{server.server_port}/{layout}", layout, 0)
            model = profiles.HostedModel(profile, "SOME_KEY", "Do this.")
            assert model.call("where") == '{"a":1}'
            headers, body = asked[-1]
            assert any("secret" in v for v in headers.values()) and "Do this." in json.dumps(body) and "where" in json.dumps(body)
            with pytest.raises(calls.CallError) as e:
                model.call("busy")
            assert e.value.status == 429
            requests = spark.createDataFrame([("r", "where")], "request_id string, prompt string")
            assert calls.call_stage(requests, model, 1).first().response == '{"a":1}'
    finally:
        server.shutdown()


def test_hosted_batches(spark, tmp_path, monkeypatch):
    """Upload, job, status, output and error files, cancel, against a server that keeps them."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from gazetta.streaming import batches

    files, made = {}, {}

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            assert self.headers["Authorization"] == "Bearer secret"
            if self.path == "/files":
                files[f"f{len(files)}"] = [json.loads(x) for x in body.decode().splitlines() if x.startswith("{")]
                self._say({"id": f"f{len(files) - 1}"})
            elif self.path == "/batches":
                asked, n = files[json.loads(body)["input_file_id"]], len(made)
                good = [{"custom_id": r["custom_id"], "response": {"status_code": 200, "body": {"choices": [{"message": {"content": '{"latitude": 1}'}}]}}} for r in asked if not r["custom_id"].endswith("3")]
                bad = [{"custom_id": r["custom_id"], "response": {"status_code": 400}, "error": {"message": "refused"}} for r in asked if r["custom_id"].endswith("3")]
                files[f"o{n}"], files[f"e{n}"] = ("\n".join(map(json.dumps, x)).encode() for x in (good, bad))
                made[f"b{n}"] = {"id": f"b{n}", "status": "completed", "request_counts": {"total": len(asked), "completed": len(good), "failed": len(bad)}, "output_file_id": f"o{n}", "error_file_id": f"e{n}" if bad else None}
                self._say(made[f"b{n}"])
            else:
                self._say({"status": "cancelling"})

        def do_GET(self):
            kind, name = self.path.split("/")[1:3]
            self._say(files[name] if kind == "files" else made[name])

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("SOME_KEY", "secret")
    try:
        service = batches.HostedBatches(spark, f"http://127.0.0.1:{server.server_port}/", "SOME_KEY")
        requests = spark.createDataFrame([(f"r{i}", f"wh\u00e9re {i}") for i in range(7)], "request_id string, prompt string")
        summary = batches.submit_staggered(requests, ["request_id"], service, "m", str(tmp_path), size=4, sleep=lambda _: None)
        ids = [b["batch_id"] for b in summary["batches"]]
        assert ids == ["b0", "b1"] and batches.wait(service, ids[0], sleep=lambda _: None)["succeeded"] == 3
        out = {r.barcode: (r.success, r.error) for r in service.results_of(ids).collect()}
        assert len(out) == 7 and out["r3"] == (False, "refused") and out["r2"] == (True, None)
        assert service.results("b1").count() == 3 and service.cancel("b1")
    finally:
        server.shutdown()
