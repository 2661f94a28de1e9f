"""Interactive statements, with completion and history."""

from __future__ import annotations

import cmd
import contextlib
import re
from pathlib import Path

from docframe.cli import run_sql, schema_lines
from docframe.errors import DocframeError
from docframe.operators.catalog import Database, Table
from docframe.plans.lexer import KEYWORDS
from docframe.streaming.watch import Watcher

HISTORY = Path.home() / ".docframe_history"
HELP = r"""\d          list tables and views
\d TABLE    describe a table
\?          this help
\q          quit
Anything else is a statement of the dialect."""


class Shell(cmd.Cmd):
    prompt = "docframe> "

    def __init__(self, target: Database | Table, watch: bool = True, stdout=None) -> None:
        super().__init__(stdout=stdout)
        self.target = target
        self.watcher = None
        if watch and isinstance(target, Database):
            with contextlib.suppress(Exception):
                self.watcher = Watcher(target).start()

    def _say(self, text: str) -> None:
        print(text, file=self.stdout)

    def names(self) -> list[str]:
        """Words for completion: keywords, tables, columns (in back-ticks where they have spaces)."""
        if isinstance(self.target, Database):
            schemas = [self.target.table(n).schema for n in self.target.tables if n not in self.target.registered]
            found = [*self.target.tables, *self.target.view_names]
        else:
            schemas, found = [self.target.schema], [self.target.name]
        for s in schemas:
            found += [c if re.fullmatch(r"[A-Za-z_]\w*", c) else f"`{c}`" for c in ("path", *s.fields, *s.sections)]
        return sorted({*found, *KEYWORDS})

    def completenames(self, text: str, *_: object) -> list[str]:
        return [n for n in self.names() if n.lower().startswith(text.lower())]

    completedefault = completenames

    def emptyline(self) -> bool:
        return False

    def preloop(self) -> None:
        with contextlib.suppress(ImportError, OSError):
            import readline

            readline.read_history_file(HISTORY)

    def postloop(self) -> None:
        if self.watcher:
            self.watcher.stop()
        with contextlib.suppress(ImportError, OSError):
            import readline

            readline.write_history_file(HISTORY)

    def precmd(self, line: str) -> str:
        if self.watcher:
            for p in self.watcher.poll() or ():
                self._say(f"warning: {p.file_path}: {p.message}")
        return line

    def onecmd(self, line: str) -> bool:
        line = line.strip()
        if line in (r"\q", "exit", "quit", "EOF"):
            return True
        if line in (r"\?", "help"):
            self._say(HELP)
        elif line.startswith(r"\d"):
            self._describe(line[2:].strip())
        elif line:
            try:
                self._say(run_sql(self.target, line))
            except DocframeError as e:
                self._say(f"error: {e}")
        return False

    def _describe(self, name: str) -> None:
        if isinstance(self.target, Table):
            self._say("\n".join(schema_lines(self.target.schema)))
        elif not name:
            self._say("\n".join([*self.target.tables, *(f"{v} (view)" for v in self.target.view_names)]))
        else:
            try:
                if name in self.target.view_names:
                    self._say("\n".join(f"{n}: {k}" for n, k in self.target.sql(f"SELECT * FROM {name}").dtypes))
                else:
                    self._say("\n".join(schema_lines(self.target.table(name).schema)))
            except DocframeError as e:
                self._say(f"error: {e}")
