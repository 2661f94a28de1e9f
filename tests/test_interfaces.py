"""Rendering, command line, shell, web interface, bridges, watching."""

import io
import json
import threading
import time
import urllib.request
import warnings

import pytest

from docframe import bridges, cli
from docframe.errors import DocframeError
from docframe.operators.catalog import Database
from docframe.render import render
from docframe.repl import Shell
from docframe.server import make_server
from docframe.streaming.watch import Watcher

ROWS = [{"a": 1, "b": "x,\"y\"", "c": ["p", "q"]}, {"a": None, "b": "long " * 30, "c": None}]


def test_formats():
    assert json.loads(render(ROWS, ["a", "b"], "json"))[0] == {"a": 1, "b": 'x,"y"'}
    assert render(ROWS[:1], ["a", "b", "c"], "csv") == 'a,b,c\n1,"x,""y""",p;q'
    table = render(ROWS, ["a", "b"], longest=20).split("\n")
    assert table[1].startswith("-") and table[3].endswith("...")
    assert render([], ["a"]) == "No results." and render([], ["a"], "json") == "[]" and render([], ["a"], "csv") == "a"
    with pytest.raises(ValueError):
        render([], [], "xml")


def test_command_line(spark, shop, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    assert cli.main(["query", str(shop), "SELECT path FROM orders WHERE amount = 9", "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"path": "second.md"}]
    assert cli.main(["validate", str(shop)]) == 1 and "enum_violation" in capsys.readouterr().out
    assert cli.main(["validate", str(shop / "tags"), "-q"]) == 0
    assert cli.main(["create", str(shop / "customers"), "-s", "title=Cyd"]) == 0 and (shop / "customers/cyd.md").exists()
    assert cli.main(["inspect", str(shop / "orders"), "-f", "broken.md"]) == 1
    assert cli.main(["inspect", str(shop / "orders")]) == 0
    assert cli.main(["schema", str(shop)]) == 0 and "orders.customer -> customers.path" in capsys.readouterr().out
    assert cli.main(["stamp", str(shop / "tags")]) == 0
    assert cli.main(["rename", str(shop), "customers", "cyd", "cy"]) == 0
    assert cli.main(["query", str(shop), "SELECT"]) == 1 and "error:" in capsys.readouterr().err
    monkeypatch.chdir(shop / "orders")
    assert cli.main(["schema"]) == 0 and "Table: orders" in capsys.readouterr().out


def test_shell(spark, shop):
    out = io.StringIO()
    shell = Shell(Database(shop, spark), watch=False, stdout=out)
    for line in (r"\d", r"\d orders", r"\d big_open", r"\?", "SELECT title FROM tags JOIN", "SELECT COUNT(*) n FROM orders", ""):
        assert not shell.onecmd(line)
    text = out.getvalue()
    assert "open_orders (view)" in text and "amount: int" in text and "error:" in text and "\n3" in text
    assert "`Go-Live Notes`" in shell.names() and "customers" in shell.completenames("cust") and shell.onecmd(r"\q")


def test_web(spark, shop):
    server = make_server(Database(shop, spark), 0, watch=False)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_address[1]}"

    def call(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(root + path, json.dumps(body).encode() if body is not None else None)) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert {"name": "big_open", "kind": "view"} in json.loads(call("/api/tables")[1])["tables"]
    assert json.loads(call("/api/tables/orders")[1])["primary_key"] == "path"
    got = json.loads(call("/api/query", {"sql": "SELECT path, due FROM orders WHERE amount = 9"})[1])
    assert got["rows"] == [{"path": "second.md", "due": "2024-05-03"}]
    assert call("/api/query", {"sql": "SELECT"})[0] == 400 and call("/api/nosuch")[0] == 404
    assert json.loads(call("/api/query", {"sql": "SELECT path FROM tags", "format": "csv"})[1])["output"].startswith("path")
    assert json.loads(call("/api/reload", {})[1])["errors"] == 2 and len(json.loads(call("/api/fk-errors")[1])["errors"]) == 2
    assert "<!doctype html>" in call("/anything")[1]
    elsewhere = urllib.request.Request(root + "/api/query", b'{"sql": "DELETE FROM tags"}', {"Origin": "http://elsewhere.example"})
    with pytest.raises(urllib.error.HTTPError, match="403"):
        urllib.request.urlopen(elsewhere)
    own = urllib.request.Request(root + "/api/query", b'{"sql": "SELECT COUNT(*) n FROM tags"}', {"Origin": root})
    with urllib.request.urlopen(own) as r:
        assert json.loads(r.read())["rows"] == [{"n": 2}] and r.headers["Access-Control-Allow-Origin"] is None
    server.shutdown()


def test_bridges(spark, shop):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert list(bridges.load_pandas(shop / "orders", spark)["path"]) == ["first.md", "second.md", "third.md"]
    assert any("broken.md" in str(w.message) for w in seen)
    with pytest.raises(DocframeError):
        bridges.load_pandas(shop / "orders", spark, errors="raise")
    assert len(bridges.load_pandas(shop / "orders", spark, errors="ignore")) == 3


def test_watcher_sees_edits_and_deletions(spark, shop):
    watcher = Watcher(Database(shop, spark)).start()
    try:
        time.sleep(4)
        (shop / "customers/zoe.md").write_text('---\ntitle: "Zoe"\n---\n')
        (shop / "customers/ann.md").unlink()
        end, found = time.time() + 60, None
        while time.time() < end:
            found = watcher.poll() or found
            if found and any("ann.md" in p.message for p in found):
                break
            time.sleep(0.3)
        assert {p.file_path for p in found} == {"orders/first.md"}
    finally:
        watcher.stop()


def test_change_stream_remembers_by_number(tmp_path):
    from docframe.streaming.watch import _Reader

    root, log = tmp_path / "r", tmp_path / "l"
    root.mkdir()
    (root / "a.md").write_text("a")
    reader = _Reader(str(root), str(log))
    start = reader.initialOffset()
    assert start == {"n": 0} and reader.read(start)[1] == start
    (root / "b.md").write_text("b")
    rows, one = reader.read(start)
    assert list(rows) == [("b.md", "create")] and one == {"n": 1}
    (root / "a.md").unlink()
    again = _Reader(str(root), str(log))  # as after a restart
    rows, two = again.read(one)
    assert list(rows) == [("a.md", "remove")] and two == {"n": 2}
    assert list(again.readBetweenOffsets(start, two)) == [("b.md", "create"), ("a.md", "remove")]
    again.commit(one)
    assert list(again.readBetweenOffsets(one, two)) == [("a.md", "remove")] and not (log / "1.json").exists()
