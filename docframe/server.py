"""Web interface: a small REST service and one page."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

from docframe.errors import DocframeError
from docframe.functions.values import display_text
from docframe.operators.catalog import Database
from docframe.render import FORMATS, render
from docframe.sources.markdown import Problem
from docframe.streaming.watch import Watcher

PAGE = """<!doctype html><meta charset="utf-8"><title>docframe</title>
<style>body{font:14px sans-serif;margin:0;display:flex;height:100vh}nav{width:220px;padding:12px;background:#f4f4f4;overflow:auto}
main{flex:1;padding:12px;overflow:auto}textarea{width:100%;height:90px;font:13px monospace}table{border-collapse:collapse;margin-top:8px}
td,th{border:1px solid #ccc;padding:3px 7px;text-align:left;vertical-align:top}th{cursor:pointer}li{cursor:pointer}.bad{color:#a00}pre{white-space:pre-wrap}</style>
<nav><b>Tables</b><ul id="tables"></ul><pre id="schema"></pre><b>History</b><ul id="history"></ul></nav>
<main><textarea id="sql" placeholder="SELECT ... (Ctrl+Enter runs)"></textarea><button id="run">Run</button> <span id="note"></span>
<div id="keys" class="bad"></div><div id="out"></div></main>
<script>
const $ = id => document.getElementById(id), KEEP = 50
let last = null
const past = () => JSON.parse(localStorage.getItem('docframe') || '[]')
const cell = v => v === null || v === undefined ? '' : Array.isArray(v) ? v.join(', ') : typeof v === 'object' ? JSON.stringify(v) : String(v)
function line(tag, values) { const tr = document.createElement('tr'); for (const v of values) { const td = document.createElement(tag); td.textContent = cell(v); tr.append(td) } return tr }
function show() {
  const table = document.createElement('table'), head = line('th', last.columns)
  head.querySelectorAll('th').forEach((th, i) => th.onclick = () => {
    const c = last.columns[i]; last.up = last.by === c ? !last.up : true; last.by = c
    last.rows.sort((a, b) => (a[c] === b[c] ? 0 : a[c] === null ? 1 : b[c] === null ? -1 : a[c] < b[c] ? -1 : 1) * (last.up ? 1 : -1)); show() })
  table.append(head); for (const r of last.rows) table.append(line('td', last.columns.map(c => r[c])))
  $('out').replaceChildren(table)
}
async function run() {
  const sql = $('sql').value, began = performance.now()
  const got = await (await fetch('/api/query', {method: 'POST', body: JSON.stringify({sql, format: 'json'})})).json()
  $('note').textContent = got.error ? '' : `${got.rows ? got.rows.length + ' rows, ' : ''}${Math.round(performance.now() - began)} ms`
  localStorage.setItem('docframe', JSON.stringify([sql, ...past().filter(x => x !== sql)].slice(0, KEEP))); history_()
  if (got.error) { const p = document.createElement('pre'); p.className = 'bad'; p.textContent = got.error; $('out').replaceChildren(p) }
  else if (got.message) $('out').textContent = got.message
  else { last = got; show() }
}
function history_() { $('history').replaceChildren(...past().map(s => { const li = document.createElement('li'); li.textContent = s.slice(0, 60); li.onclick = () => $('sql').value = s; return li })) }
async function tables() {
  const got = await (await fetch('/api/tables')).json()
  $('tables').replaceChildren(...got.tables.map(t => { const li = document.createElement('li'); li.textContent = t.name; li.onclick = async () => {
    $('schema').textContent = JSON.stringify((await (await fetch('/api/tables/' + encodeURIComponent(t.name))).json()).columns, null, 1) }; return li }))
}
async function keys() { const got = await (await fetch('/api/fk-errors')).json(); $('keys').textContent = got.errors.length ? got.errors.length + ' foreign-key violations' : '' }
$('run').onclick = run; $('sql').onkeydown = e => { if (e.ctrlKey && e.key === 'Enter') run() }
tables(); history_(); keys(); setInterval(keys, 3000)
</script>"""


class Service:
    """What the routes do, apart from HTTP."""

    def __init__(self, database: Database, watch: bool = True) -> None:
        self.database = database
        self.lock = threading.Lock()
        self.errors: list[Problem] = []
        self.watcher = Watcher(database, on_result=self._keep).start() if watch else None

    def _keep(self, found: list[Problem]) -> None:
        self.errors = found

    def tables(self) -> dict:
        names = [{"name": n, "kind": "table"} for n in self.database.tables]
        return {"database": self.database.name, "tables": names + [{"name": n, "kind": "view"} for n in self.database.view_names]}

    def table(self, name: str) -> dict:
        df = self.database.sql(f"SELECT * FROM `{name}`")
        key = self.database.table(name).schema.primary_key if name in self.database.tables and name not in self.database.registered else None
        return {"name": name, "primary_key": key, "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]}

    def query(self, body: dict) -> dict:
        sql, kind = body.get("sql"), body.get("format", "json")
        if not isinstance(sql, str) or kind not in FORMATS:
            raise DocframeError(f"Expected sql, and a format of {', '.join(FORMATS)}")
        with self.lock:
            out = self.database.execute(sql)
        if isinstance(out, str):
            return {"message": out}
        rows, columns = out
        return {"columns": columns, "rows": rows} if kind == "json" else {"columns": columns, "output": render(rows, columns, kind)}

    def reload(self) -> dict:
        with self.lock:
            self.database.reload()
            self.errors = [Problem(*r) for r in self.database.foreign_key_errors().collect()]
        return {"tables": len(self.database.tables), "errors": len(self.errors)}

    def fk_errors(self) -> dict:
        return {"errors": [p.__dict__ for p in self.errors]}


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def _send(self, status: int, body: bytes, kind: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, work) -> None:
            try:
                status, out = 200, work()
            except (DocframeError, ValueError) as e:
                status, out = 400, {"error": str(e)}
            self._send(status, json.dumps(out, default=display_text).encode(), "application/json")

        def _foreign(self) -> bool:
            """Whether a page of another origin sends this; such pages may not write."""
            origin = self.headers.get("Origin")
            return origin is not None and urlparse(origin).netloc != self.headers.get("Host")

        def do_GET(self) -> None:
            path = unquote(urlparse(self.path).path)
            if path == "/api/tables":
                self._json(service.tables)
            elif path.startswith("/api/tables/"):
                self._json(lambda: service.table(path.removeprefix("/api/tables/")))
            elif path == "/api/fk-errors":
                self._json(service.fk_errors)
            elif path.startswith("/api/"):
                self._send(404, b'{"error": "not found"}', "application/json")
            else:
                self._send(200, PAGE.encode(), "text/html; charset=utf-8")

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self._foreign():
                self._send(403, b'{"error": "another origin"}', "application/json")
            elif self.path == "/api/query":
                self._json(lambda: service.query(json.loads(body or b"{}")))
            elif self.path == "/api/reload":
                self._json(service.reload)
            else:
                self._send(404, b'{"error": "not found"}', "application/json")

    return Handler


def make_server(database: Database, port: int = 3000, host: str = "127.0.0.1", watch: bool = True) -> ThreadingHTTPServer:
    service = Service(database, watch)
    server = ThreadingHTTPServer((host, port), handler(service))
    server.service = service  # type: ignore[attr-defined]
    return server


def serve(database: Database, port: int = 3000, host: str = "127.0.0.1") -> None:
    server = make_server(database, port, host)
    print(f"http://{host}:{server.server_address[1]}")
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()
