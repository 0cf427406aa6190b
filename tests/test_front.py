import json
import threading
import urllib.request

import pytest

from lattice.cli import COMMANDS, main
from lattice.http import answer, server
from lattice.tools import Engine

from .graphs import mini


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("db")))
    e.save(mini(spark))
    docs = spark.createDataFrame([("d1", "t", "shop", "Red lamp", "lamp", "u", "", "", "red lamp", 10)], "doc_id string, source_type string, source_name string, title string, content string, url string, created string, tags string, text string, popularity bigint")
    e.index_source(docs)
    return e


def test_http(engine):
    assert answer(engine, "/health") == (200, {"status": "ok", "total": 1, "sources": 1})
    assert answer(engine, "/search")[0] == 400 and answer(engine, "/search?q=a&n=x")[0] == 400 and answer(engine, "/nothing")[0] == 404
    assert answer(engine, "/search?q=a&source=zz") == (400, {"error": "unknown source: zz", "available": ["shop"]})
    s = server(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{s.server_port}/search?q=red+lamp&source=shop&n=1", timeout=60) as r:
            assert json.loads(r.read())["results"][0]["title"] == "Red lamp"
    finally:
        s.shutdown()


def test_commands(engine, capsys, tmp_path):
    def run(*argv):
        assert main(argv, engine) == 0
        return capsys.readouterr().out.strip()

    assert json.loads(run("stats"))["Project"] == 2
    assert json.loads(run("query", "MATCH (p:Project) RETURN COUNT(p)")) == {"value": 2}
    assert "src/lib/util.ts" in run("files", "alpha") and "react" in run("deps", "alpha") and "react" in run("shared") and "util.ts" in run("imports", "alpha")
    assert "src/app.ts" in run("callers", "fmt") and "UserRead" in run("hierarchy", "Base") and "languages" in run("explain", "beta") and "Base" in run("diagram", "beta", "--kind", "inheritance")
    assert "s2" in run("sessions", "alpha") and "EDITED" in run("session-files", "s1") and "s1" in run("file-sessions", "util") and "shop" in run("source-list") and "Red lamp" in run("source-search", "lamp")
    (tmp_path / "log" / "-Users-j-projects-alpha").mkdir(parents=True)
    (tmp_path / "log" / "-Users-j-projects-alpha" / "s9.jsonl").write_text(json.dumps({"type": "user", "cwd": "/w", "timestamp": "2026-02-01", "message": {"content": "look at the app please"}}) + "\n" + json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/src/app.ts"}}]}}))
    run("scan-sessions", str(tmp_path / "log"))
    assert "s9" in run("file-sessions", "app.ts") and "s9" in run("session-search", "the app")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.py").write_text("def f():\n    pass\n")
    assert "python" in run("xray", f"gamma={tmp_path / 't'}") and "File" in run("scan", f"gamma={tmp_path / 't'}") and "a.py" in run("files", "gamma")
    assert len(COMMANDS) > 30
    with pytest.raises(SystemExit):
        main(["nothing"], engine)


def test_watch_command_follows_a_tree(spark, tmp_path, capsys):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("# Alpha\nabout cats")
    e = Engine(spark, str(tmp_path / "db"))
    assert main(["watch", str(root), "--once"], e) == 0 and json.loads(capsys.readouterr().out) == {"files": 1, "chunks": 1}
    (root / "b.md").write_text("# Beta\nabout dogs")
    (root / "a.md").unlink()
    main(["watch", str(root), "--once"], e)
    capsys.readouterr()
    main(["watch-search", "dogs cats"], e)
    assert [json.loads(x)["heading"] for x in capsys.readouterr().out.splitlines()] == ["Beta"]


def test_only_changed_files_are_cut_again(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    tree = lambda *rows: spark.createDataFrame(list(rows), "project STRING, path STRING, text STRING")
    a, b, m = ("p", "a.py", "def a():\n    return 1\n"), ("p", "b.py", "def b():\n    return 2\n"), ("q", "m.md", "# One\ntext\n" + "x " * 200 + "\n## Two\nmore")
    assert e.index_code(tree(a, b, m)) == {"files": 3, "chunks": 4, "code_chunks": 2, "doc_chunks": 2}
    before = e._chunks.rows("chunks")
    assert e.index_code(tree(a, b)) == {"files": 3, "chunks": 4, "code_chunks": 2, "doc_chunks": 2} and e._chunks.rows("chunks") == before
    assert e.index_code(tree(a, ("p", "c.py", "def c():\n    return 3\n"))) == {"files": 3, "chunks": 4, "code_chunks": 2, "doc_chunks": 2}
    assert e._chunks.rows("chunks") - before == 1 and sorted(r["file"] for r in e.chunks().collect()) == ["a.py", "c.py", "m.md", "m.md"]
    assert {r["id"]: r["heading"] for r in e.chunks().where("project = 'q'").collect()} == {"m.md::chunk_0": "One", "m.md::chunk_1": "One > Two"}
