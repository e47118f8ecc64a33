"""An interactive shell over a catalogue."""

from __future__ import annotations

import cmd
import itertools

from weirflow import statement
from weirflow.engine import Engine

VERSION = "0.1"
#: Rows of a SELECT that the shell keeps.
ROWS = 5000


class Shell(cmd.Cmd):
    """SHOW TABLES, SHOW FUNCTIONS, DESCRIBE, SELECT, INSERT INTO, EXECUTE, LS, STOP, RM, SET, HELP, CLEAR, VERSION, EXIT, QUIT."""

    prompt = "weirflow> "

    def __init__(self, engine: Engine, **kw):
        super().__init__(**kw)
        self.engine, self.settings, self.runs = engine, {}, {}
        self._next = itertools.count(1)
        self.last: list[dict] = []

    def say(self, *lines: object) -> None:
        print(*lines, sep="\n", file=self.stdout)

    def onecmd(self, line: str) -> bool:
        word, _, rest = line.strip().rstrip(";").partition(" ")
        try:
            return super().onecmd(f"{word.lower()} {rest}".strip())
        except Exception as e:  # a shell says what went wrong and goes on
            self.say(f"{type(e).__name__}: {str(e).splitlines()[0]}")
            return False

    def emptyline(self) -> bool:
        return False

    def do_show(self, arg: str) -> None:
        if arg.lower() == "tables":
            self.say(*sorted(self.engine.catalog.entries))
        elif arg.lower() == "functions":
            self.say(*sorted({"flatten", "getnestedfield", "getsqlfield", "buildoutputrecord", "regexmatch", "converttostring", *self.engine.registry.functions}))
        else:
            self.say("SHOW TABLES or SHOW FUNCTIONS")

    def do_describe(self, arg: str) -> None:
        df = self.engine.catalog.frame(self.engine.spark, arg.strip())
        self.say(*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))

    def do_select(self, arg: str) -> None:
        self.last = [r.asDict(True) for r in self.engine.query(f"SELECT {arg}").take(ROWS)]
        self.say(*self.last)

    def do_insert(self, arg: str) -> None:
        self._run([f"INSERT {arg}"])

    def do_execute(self, arg: str) -> None:
        with open(arg.strip()) as f:
            self._run(statement.from_file(f.read()))

    def _run(self, statements: list[str]) -> None:
        for s in statements:
            n = next(self._next)
            self.runs[n] = (s, self.engine.run(s))
            self.say(f"{n}: {s}")

    def do_ls(self, arg: str) -> None:
        self.say(*(f"{n} {'running' if getattr(r, 'isActive', False) else 'done'} {s}" for n, (s, r) in self.runs.items()))

    def do_stop(self, arg: str) -> None:
        run = self.runs[int(arg)][1]
        if getattr(run, "isActive", False):
            run.stop()

    def do_rm(self, arg: str) -> None:
        self.do_stop(arg)
        del self.runs[int(arg)]

    def do_set(self, arg: str) -> None:
        if not arg:
            self.say(*(f"{k}={v}" for k, v in sorted(self.settings.items())))
            return
        key, _, value = arg.partition("=")
        self.settings[key.strip()] = value.strip()

    def do_clear(self, arg: str) -> None:
        self.say("\033[2J\033[H")

    def do_version(self, arg: str) -> None:
        self.say(VERSION)

    def do_exit(self, arg: str) -> bool:
        for _, r in self.runs.values():
            if getattr(r, "isActive", False):
                r.stop()
        return True

    do_quit = do_exit
