"""An interactive shell: SQL over several lines, dot commands, tables of results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

from quarry import errors as E
from quarry.database import Command, Database

HELP = """.help  .tutorial  .tables  .schema TABLE  .indexes TABLE  .checkpoint  .save PATH  .open PATH
.read PATH  .timer on|off  .cancel  .quit  .exit
SQL ends with a semicolon and may span lines."""
TUTORIAL = """CREATE TABLE notes (id INTEGER PRIMARY KEY, title TEXT, embedding VECTOR(3));
INSERT INTO notes VALUES (1, 'first', ARRAY[1, 0, 0]), (2, 'second', ARRAY[0, 1, 0]);
SELECT id, title, embedding <=> ARRAY[1, 0, 0] AS distance FROM notes ORDER BY distance LIMIT 1;"""
#: name: (what its argument is: none, needed, or one of some words)
COMMANDS = {".help": "", ".tutorial": "", ".tables": "", ".schema": "needed", ".indexes": "needed", ".checkpoint": "", ".save": "needed", ".open": "needed", ".read": "needed", ".timer": "on off", ".cancel": "", ".quit": "", ".exit": ""}


def parse_command(line: str) -> tuple[str, str] | None:
    """(name, argument) of a dot command; None for anything else; ValueError for a wrong one."""
    if not line.startswith("."):
        return None
    name, _, argument = line.partition(" ")
    name, argument = name.lower(), argument.strip()
    if name not in COMMANDS:
        raise ValueError(f"unknown command '{name}'; type .help for help")
    rule = COMMANDS[name]
    if rule == "" and argument:
        raise ValueError(f"{name} does not accept an argument")
    if rule == "needed" and not argument:
        raise ValueError(f"{name} requires an argument")
    if rule not in ("", "needed") and argument.lower() not in rule.split():
        raise ValueError(f"{name} expects one of: {rule}")
    if len(argument) > 1 and argument[0] == argument[-1] and argument[0] in "'\"":
        argument = argument[1:-1]
    return name, argument


def complete(text: str) -> bool:
    """Whether a text ends with a semicolon outside of strings, quoted names and comments."""
    from quarry.plans.syntax import TOKEN

    at, last = 0, ""
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return False
        if m.lastgroup:
            last = m[0]
        at = m.end()
    return last == ";"


def shown(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "[" + ", ".join(f"{x:g}" for x in v) + "]" if isinstance(v, list) else str(v)


def table(columns: list[str], rows: list[tuple]) -> str:
    cells = [columns, *([shown(v) for v in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width)) + " |"
    bar = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([bar, line(cells[0]), bar, *map(line, cells[1:]), bar, f"({len(rows)} row{'s' * (len(rows) != 1)})"])


class Shell:
    def __init__(self, db: Database, out=sys.stdout):
        self.db, self.out, self.buffer, self.timer, self.done = db, out, "", False, False

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def feed(self, line: str) -> None:
        """One line of input."""
        try:
            if not self.buffer or line.strip() in (".cancel",):
                if (command := parse_command(line.strip())) is not None:
                    return self.command(*command)
            self.buffer += line + "\n"
            if complete(self.buffer):
                text, self.buffer = self.buffer, ""
                self.run(text)
        except (E.QuarryError, ValueError, OSError) as e:
            self.buffer = ""
            self.say(f"error: {e}")

    def run(self, text: str) -> None:
        at = time.time()
        for r in self.db.execute(text):
            self.say(f"{r.tag} ({r.rows_affected})" if isinstance(r, Command) else table(r.columns, r.rows))
        if self.timer:
            self.say(f"time: {(time.time() - at) * 1000:.1f} ms")

    def command(self, name: str, argument: str) -> None:
        db = self.db
        if name in (".quit", ".exit"):
            self.done = True
        elif name == ".help":
            self.say(HELP)
        elif name == ".tutorial":
            self.say(TUTORIAL)
        elif name == ".tables":
            self.say("\n".join(db.list_tables()))
        elif name == ".schema":
            self.say(table(["column", "type", "nullable", "unique"], [(c.name, str(c.type), c.nullable, c.unique) for c in db.schema(argument)]))
        elif name == ".indexes":
            self.say(table(["index", "column"], db.list_indexes(argument)))
        elif name == ".checkpoint":
            db.checkpoint()
            self.say("checkpoint written")
        elif name == ".save":
            db.save(argument)
            self.say(f"saved {argument}")
        elif name == ".open":
            self.db = Database.open(db.spark, argument)
            db.close()
            self.say(f"opened {argument}")
        elif name == ".read":
            self.run(Path(argument).read_text())
        elif name == ".timer":
            self.timer = argument.lower() == "on"
        elif name == ".cancel":
            self.buffer = ""


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quarry-shell").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shell = Shell(Database.open_persistent(spark, sys.argv[1]) if len(sys.argv) > 1 else Database(spark))
    while not shell.done:
        try:
            shell.feed(input("quarry> " if not shell.buffer else "   ...> "))
        except EOFError:
            break
    shell.db.close()


if __name__ == "__main__":
    main()
