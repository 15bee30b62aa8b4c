"""Interactive shell and batch runner: ``python -m tessera.cli [FOLDER QUERY_FILE [--single-file]]``."""

from __future__ import annotations

import re
import sys
from pathlib import Path

from tessera.engine import Engine
from tessera.session import get_session
from tessera.sources import format_table, write_result

HELP = """.load FILE     register a CSV file under its stem
.tables        list tables
.schema TABLE  show columns, types and keys
.help          this text
.exit, .quit   leave
A statement ends with a semicolon and may span lines."""


#: What a semicolon inside doesn't end: literals, quoted names and comments, open ones included.
_WHOLE = re.compile(r"""'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`[^`]*(?:`|\Z)|--[^\n]*|/\*.*?(?:\*/|\Z)|;""", re.S)


def split_statements(text: str) -> tuple[list[str], str]:
    """Statements ended by a semicolon outside quotes and comments, and the unfinished rest."""
    done, start = [], 0
    for m in _WHOLE.finditer(text):
        if m[0] == ";":
            done.append(text[start : m.start()].strip())
            start = m.end()
    return [s for s in done if s], text[start:].strip()


class Shell:
    """Line-driven shell; ``feed`` returns the lines to print and keeps going after errors."""

    def __init__(self, engine: Engine):
        self.engine, self.buffer, self.done = engine, "", False
        self.commands = {".load": self._load, ".tables": self._tables, ".schema": self._schema, ".help": lambda _: [HELP], ".exit": self._exit, ".quit": self._exit}

    def _load(self, arg: str) -> list[str]:
        self.engine.load_csv(arg)
        return [f"loaded {Path(arg).stem}"]

    def _tables(self, _: str) -> list[str]:
        return self.engine.tables() or ["no tables"]

    def _schema(self, arg: str) -> list[str]:
        return [f"{c}  {t}  {k}".rstrip() for c, t, k in self.engine.describe(arg)]

    def _exit(self, _: str) -> list[str]:
        self.done = True
        return []

    def feed(self, line: str) -> list[str]:
        try:
            if not self.buffer and line.strip().startswith("."):
                name, _, arg = line.strip().partition(" ")
                if name not in self.commands:
                    return [f"unknown command {name}; try .help"]
                return self.commands[name](arg.strip())
            statements, self.buffer = split_statements(f"{self.buffer}\n{line}")
            return [row for s in statements for row in format_table(self.engine.sql(s))]
        except Exception as error:
            self.buffer = ""
            return [f"error: {str(error).splitlines()[0]}"]


def run_batch(engine: Engine, folder: str, query_file: str, out_dir: str = ".", single_file: bool = False) -> list[Path]:
    """Load a folder of CSV files, run each statement of a file, write ``<stem>_<n>.csv`` each.

    Each result is a folder of part files that tasks write in parallel; ``single_file`` streams it through the
    driver into one local file instead. A last statement without semicolon is an error, as are failing statements.
    """
    engine.load_folder(folder)
    statements, rest = split_statements(Path(query_file).read_text(encoding="utf-8"))
    if rest:
        raise ValueError("the last statement lacks its semicolon")
    written = []
    for n, statement in enumerate(statements, 1):
        target = Path(out_dir) / f"{Path(query_file).stem}_{n}.csv"
        write_result(engine.sql(statement), str(target), single_file)
        written.append(target)
    return written


def main(argv: list[str] | None = None) -> int:
    args = sys.argv[1:] if argv is None else argv
    engine = Engine(get_session("tessera-cli"))
    single = "--single-file" in args
    args = [a for a in args if a != "--single-file"]
    if len(args) == 2:
        try:
            for path in run_batch(engine, *args, single_file=single):
                print(path)
            return 0
        except Exception as error:
            print(f"error: {error}", file=sys.stderr)
            return 1
    shell = Shell(engine)
    while not shell.done:
        try:
            line = input("... " if shell.buffer else "sql> ")
        except EOFError:
            break
        print(*shell.feed(line), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
