"""Runs statements: plan the SELECT over the catalogue, validate it, and write it to its sink."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import dialect, statement, validate
from weirflow.catalog import DELETE, KEY, OP, Catalog
from weirflow.functions.builtin import REGISTRY, Registry


@dataclass
class Engine:
    """Statements over a catalogue, in a session."""

    spark: SparkSession
    catalog: Catalog
    registry: Registry = field(default_factory=lambda: REGISTRY)
    check_output: bool = True
    #: Whether only the joins of the strict mode are planned.
    strict: bool = False

    def plan(self, sql: str) -> tuple[statement.Statement, DataFrame]:
        """The statement and its rows, not yet run."""
        s = statement.parse(sql)
        if self.strict:
            for left, right, how, condition in statement.joins(s.select):
                validate.strict_join(self.catalog, left, right, how, condition)
        return s, self.query(s.select)

    def query(self, select: str) -> DataFrame:
        """The rows of a bare SELECT over catalogue names."""
        text, sources = statement.folded(dialect.tokens(select.strip().rstrip(";")))
        self.registry.register(self.spark)
        for name in sources:
            # a name may also be that of a common table expression
            if name.removesuffix(".$table") in self.catalog.entries:
                self.catalog.frame(self.spark, name).createOrReplaceTempView(f"`{name}`")
        sql = dialect.rewrite(_functions(text))
        df = self._analysed(sql)
        if "/" in dialect.tokens(sql) and (spans := _integer_divisions(df)):
            df = self._analysed(dialect.divided(sql, spans))
        return without_duplicates(df)

    def _analysed(self, sql: str) -> DataFrame:
        """The rows of Spark SQL; an error tells where in it, by carets."""
        try:
            return self.spark.sql(sql)
        except AnalysisException as e:
            for c in e.getQueryContext():
                if 0 <= c.startIndex() <= c.stopIndex() < len(sql):
                    line = sql.count("\n", 0, c.startIndex()) + 1
                    column = c.startIndex() - sql.rfind("\n", 0, c.startIndex())
                    e.add_note(validate.underline(sql, line, column, column + c.stopIndex() - c.startIndex()))
                    break
            raise

    def run(self, sql: str) -> object:
        """Run one statement; gives what the sink's writer gives."""
        s, df = self.plan(sql)
        sink = self.catalog.get(s.sink)
        if self.check_output:
            validate.output(df.schema, sink, s.sink)
        if sink.write is None:
            raise validate.ValidationError(f"{s.sink} cannot be written")
        return sink.write(tombstones(df) if OP in df.columns else df)

    def run_all(self, statements: list[str]) -> list[object]:
        """Run several statements; those with one sink are one write (fan-in)."""
        plans: dict[str, list[DataFrame]] = {}
        for sql in statements:
            s, df = self.plan(sql)
            if self.check_output:
                validate.output(df.schema, self.catalog.get(s.sink), s.sink)
            plans.setdefault(s.sink, []).append(tombstones(df) if OP in df.columns else df)
        out = []
        for sink, frames in plans.items():
            both = frames[0]
            for f in frames[1:]:
                both = both.unionByName(f, allowMissingColumns=True)
            out.append(self.catalog.get(sink).write(both))
        return out


def without_duplicates(df: DataFrame) -> DataFrame:
    """Of two columns with one name the first stays; three are an error."""
    if len(set(df.columns)) == len(df.columns):
        return df
    if worst := next((c for c in df.columns if df.columns.count(c) > 2), None):
        raise dialect.DialectError(f"{worst} is selected more than twice")
    names = [f"{c}__{i}" for i, c in enumerate(df.columns)]
    first = {c: n for c, n in reversed(list(zip(df.columns, names, strict=True)))}
    return df.toDF(*names).select(*(F.col(f"`{first[c]}`").alias(c) for c in dict.fromkeys(df.columns)))


def tombstones(df: DataFrame) -> DataFrame:
    """Rows of a delete: the key with a NULL payload; other operations are rejected when they run."""
    ok = F.when(F.col(OP) == DELETE, F.col(OP)).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.col(OP))))
    return df.select(KEY, ok.alias(OP))


#: Types whose division truncates.
_INTEGERS = frozenset("tinyint smallint int bigint".split())


def _integer_divisions(df: DataFrame) -> list[tuple[int, int]]:
    """First and last character, in the SQL, of every division of two integers."""
    found = []

    def listed(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def walk_expression(e) -> None:
        if e.nodeName() == "Divide":
            # the analyser casts integers to doubles for a division; what it cast is of the types as written
            sides = [c.child() if c.nodeName() == "Cast" else c for c in listed(e.children())]
            at = e.origin()
            if all(x.dataType().simpleString() in _INTEGERS for x in sides) and at.startIndex().isDefined():
                found.append((int(at.startIndex().get()), int(at.stopIndex().get())))
        for c in listed(e.children()):
            walk_expression(c)
        if hasattr(e, "plan") and e.nodeName().lower().endswith(("subquery", "exists")):
            walk_plan(e.plan())

    def walk_plan(p) -> None:
        for e in listed(p.expressions()):
            walk_expression(e)
        for c in [*listed(p.children()), *(x for x in listed(p.innerChildren()) if hasattr(x, "expressions"))]:
            walk_plan(c)

    walk_plan(df._jdf.queryExecution().analyzed())
    return found


def _check_flattens(toks: list[str]) -> None:
    """One Flatten a SELECT."""
    counts = [0]
    for i, t in enumerate(toks):
        if t == "(":
            counts.append(-1)
        elif t == ")" and len(counts) > 1:
            counts.pop()
        elif t.upper() == "SELECT":
            counts[-1] = 0
        elif t.lower() == "flatten" and (nxt := dialect._solid(toks, i, 1)) < len(toks) and toks[nxt] == "(":
            at = max(k for k, n in enumerate(counts) if n >= 0)
            counts[at] += 1
            if counts[at] > 1:
                raise dialect.DialectError("one Flatten a SELECT")


def _functions(sql: str) -> str:
    """Built-in functions of the dialect as Spark expressions."""
    toks = dialect.tokens(sql)
    _check_flattens(toks)
    i = 0
    while i < len(toks):
        name = toks[i].lower()
        nxt = dialect._solid(toks, i, 1)
        if name in ("regexmatch", "converttostring", "flatten", "getnestedfield", "getsqlfield", "buildoutputrecord") and nxt < len(toks) and toks[nxt] == "(":
            end = dialect._group_end(toks, nxt, "(", ")")
            args = [_functions(a) for a in dialect.split_arguments(toks[nxt + 1 : end])]
            if name == "regexmatch":
                new = f"regexp({args[1]}, concat('^(?:', {args[0]}, ')$'))"
            elif name == "converttostring":
                new = f"cast({args[0]} as string)"
            elif name == "flatten":
                new = f"explode(coalesce({args[0]}, array(null)))"
            elif name == "buildoutputrecord":
                new = f"named_struct({', '.join(a for a in args if a)})"
            else:
                new = _walk(args[0], args[1].strip("'"))
                new = f"cast({new} as string)" if name == "getsqlfield" else new
            toks[i : end + 1] = [new]
        i += 1
    return "".join(toks)


def _walk(column: str, path: str) -> str:
    for name, index in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        column += f"[{index}]" if index else f".{name}"
    return column
