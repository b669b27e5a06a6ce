"""The commands, on small files."""

import pytest

from spanloom.__main__ import main


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "docs").mkdir()
    for k in range(2):
        text = " ".join(f"The unit {k} reported result number {i} in the second week of May." for i in range(40))
        (tmp_path / "docs" / f"d{k}.txt").write_text(text)
    return tmp_path


def test_summarize(spark, folder, capsys):
    assert main(["summarize", str(folder / "docs"), "--length", "brief"]) == 0
    out = capsys.readouterr().out
    assert out.count("FACTS AND SOURCES") == 2 and "[4]" in out and "[5]" not in out and "tokens:      0 in / 0 out" in out
    assert main(["summarize", str(folder / "docs"), "--backend", "verified", "--stand-in", "--format", "json"]) == 0
    assert '"citation_precision" : 0.75' in capsys.readouterr().out
    assert main(["summarize", str(folder / "docs"), "--format", "html", "--out", str(folder / "html")]) == 0
    assert sorted(p.name for p in (folder / "html").iterdir()) == ["d0.txt.html", "d1.txt.html"]
    assert "<mark" in (folder / "html" / "d0.txt.html").read_text()


def test_model_backends_fail_without_a_model(spark, folder, capsys, monkeypatch):
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    for more in (["--backend", "remote"], ["--backend", "local"], ["--backend", "api", "--model", "m"], ["--backend", "verified", "--model", "m", "--endpoint", "http://127.0.0.1:9", "--key-variable", "NO_SUCH_KEY"]):
        assert main(["summarize", str(folder / "docs"), *more]) == 2
        said = capsys.readouterr()
        assert "extractive" in said.err and "spacecraft" not in said.out
    assert main(["models"]) == 2


def test_a_server_answers(spark, folder, capsys, monkeypatch):
    """The whole way of a remote backend over HTTP on this machine: key, retry, models, summary."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    busy = [True]

    class Server(BaseHTTPRequestHandler):
        def answer(self, status, body):
            self.send_response(status)
            self.send_header("Retry-After", "0")
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):  # noqa: N802
            self.answer(200 if self.headers["Authorization"] == "Bearer s3" else 401, {"data": [{"id": "b"}, {"id": "a"}]})

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert asked["model"] == "m"
            self.answer(200, {"choices": [{"message": {"content": "The unit 0 reported result number 3 in the second week of May."}, "finish_reason": "stop"}]})

        def log_message(self, *a):
            busy[0] = False

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setenv("SOME_KEY", "s3")
    assert main(["models", "--endpoint", address, "--key-variable", "SOME_KEY"]) == 0
    assert capsys.readouterr().out == "a\nb\n"
    assert main(["summarize", str(folder / "docs"), "--backend", "remote", "--model", "m", "--endpoint", address, "--key-variable", "SOME_KEY"]) == 0
    assert "result number 3" in capsys.readouterr().out and not busy[0]
    server.shutdown()


def test_inspect(spark, folder, capsys):
    assert main(["inspect", str(folder / "docs"), "--query", "result number 7"]) == 0
    assert "score=" in capsys.readouterr().out
    assert main(["inspect", str(folder / "docs")]) == 0
    assert "aspect sweep" in capsys.readouterr().out


def test_compare_and_validate(spark, folder, capsys):
    dialogues = folder / "pairs.csv"
    dialogues.write_text("ID,section_header,section_text,dialogue\n" + "".join(f"{i},X,Result {i} came in May.,\"The unit saw result {i} in May. It was a long and quiet week for all.\"\n" for i in range(6)))
    assert main(["compare", str(dialogues), "--dataset", "dialogues", "--backends", "extractive,verified", "--stand-in"]) == 0
    out = capsys.readouterr().out
    assert "extractive" in out and "verified" in out
    summaries, scores = folder / "s.csv", folder / "h.csv"
    summaries.write_text("ID,Dialogue,Reference Summary,Automatic Summary\n" + "".join(f"{i},The dose was {i} mg on Monday.,Dose {i} mg.,The dose was {i % 3} mg on Monday.\n" for i in range(12)))
    scores.write_text("FactualPrecision,FactualRecall,FactualF1,HallucinationRate,OmissionRate\n" + "".join(f"0.{i},0.5,0.{9 - i % 9},0,{i}\n" for i in range(12)))
    assert main(["validate", str(summaries), str(scores), "--out", str(folder / "rows")]) == 0
    assert "numeric_fidelity" in capsys.readouterr().out
    assert list((folder / "rows").glob("*.csv"))
