"""Programs: declared, partitioned variables and statements over them, lowered to DataFrame operations.

A program is built by calls in order. ``transform`` makes new contents of the variables it writes,
``scatter`` makes messages (dst, payload columns) for the gather that follows it in the text, ``gather``
folds each partition's inbox into a variable. ``loop`` and ``while_`` nest. Statements see only the variables
they name; a variable named for writing can be read too. Variables that meet in a statement form a
group and have the same number of partitions, which is inferred where it wasn't given.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import checkpoint


class ProgramError(ValueError):
    """A program that can't run as it is written."""


@dataclass(frozen=True)
class Var:
    """A handle of a declared variable: rows with a ``part`` column."""

    name: str
    schema: str
    parallelism: int = -1


@dataclass
class Statement:
    kind: str
    fn: Callable | None = None
    reads: tuple[Var, ...] = ()
    writes: tuple[Var, ...] = ()
    count: int = 0
    tracked: bool = False
    pair: int = -1


@dataclass
class Program:
    name: str = "program"
    params: dict = field(default_factory=dict)
    variables: dict[str, Var] = field(default_factory=dict)
    statements: list[Statement] = field(default_factory=list)
    parallelism: dict[str, int] = field(default_factory=dict)
    groups: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self._reads: list[Var] = []
        self._writes: list[Var] = []
        self._tracked = False

    # declarations

    def declare(self, name: str, schema: str, parallelism: int = -1) -> Var:
        if name in self.variables:
            raise ProgramError(f"variable {name} is declared twice")
        if parallelism != -1 and parallelism < 1:
            raise ProgramError(f"variable {name}: the number of partitions is -1 (inferred) or at least 1")
        self.variables[name] = Var(name, schema, parallelism)
        return self.variables[name]

    def param(self, name: str, default):
        """A parameter by name, as the default's type; the default if it wasn't given."""
        return type(default)(self.params[name]) if name in self.params else default

    def reading(self, *variables: Var) -> Program:
        self._reads += [v for v in variables if v not in self._reads and v not in self._writes]
        return self

    def writing(self, *variables: Var) -> Program:
        self._writes += [v for v in variables if v not in self._writes]
        self._reads = [v for v in self._reads if v not in self._writes]
        return self

    def tracked(self) -> Program:
        self._tracked = True
        return self

    def _add(self, kind: str, fn=None, count: int = 0) -> Program:
        self.statements.append(Statement(kind, fn, tuple(self._reads), tuple(self._writes), count, self._tracked))
        self._reads, self._writes, self._tracked = [], [], False
        return self

    # statements; functions take a dict of DataFrames by variable name

    def transform(self, fn: Callable[[dict], dict]) -> Program:
        """fn(frames) returns new frames of the written variables."""
        return self._add("TRANSFORM", fn)

    def scatter(self, fn: Callable[[dict], DataFrame]) -> Program:
        """fn(frames) returns messages with ``dst``."""
        return self._add("SCATTER", fn)

    def gather(self, fn: Callable[[dict, DataFrame], dict], expect: int | None = None) -> Program:
        """fn(frames, inbox) returns new frames; the inbox has a row for every partition (``part``, ``messages``).

        ``messages`` is an array of payload structs, empty where none came. With ``expect``, another number raises.
        """
        return self._add("GATHER", fn, -1 if expect is None else expect)

    def loop(self, trips: int) -> Program:
        return self._add("LOOP", count=trips)

    def end_loop(self) -> Program:
        return self._add("END_LOOP")

    def while_(self, test: Callable[[dict], bool]) -> Program:
        """test(frames) is over variables of one partition."""
        return self._add("WHILE", test)

    def end_while(self) -> Program:
        return self._add("END_WHILE")

    # validation

    def validate(self) -> Program:
        """Infer groups and numbers of partitions, pair loops and scatters; raises ProgramError."""
        root = {v: v for v in self.variables}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for s in self.statements:
            names = [v.name for v in s.reads + s.writes]
            for n in names:
                if n not in self.variables:
                    raise ProgramError(f"{n} isn't a variable of this program")
            for n in names[1:]:
                root[max(find(names[0]), find(n))] = min(find(names[0]), find(n))
        self.groups = {v: sorted({find(x) for x in self.variables}).index(find(v)) for v in self.variables}
        by_group: dict[int, int] = {}
        for v, g in self.groups.items():
            n = self.variables[v].parallelism
            if n != -1 and by_group.setdefault(g, n) != n:
                raise ProgramError(f"variable {v} has {n} partitions, others of its group have {by_group[g]}")
        for v, g in self.groups.items():
            if g not in by_group:
                raise ProgramError(f"the number of partitions of {v} can't be inferred")
            self.parallelism[v] = by_group[g]
        open_ = []
        for i, s in enumerate(self.statements):
            if s.kind in ("LOOP", "WHILE"):
                open_.append(i)
                if s.kind == "WHILE" and any(self.parallelism[v.name] != 1 for v in s.reads + s.writes):
                    raise ProgramError("a while's test is over variables of one partition")
            elif s.kind in ("END_LOOP", "END_WHILE"):
                if not open_ or self.statements[open_[-1]].kind != s.kind[4:]:
                    raise ProgramError("Loops unpaired!")
                s.pair = open_.pop()
                self.statements[s.pair].pair = i
            elif s.kind == "SCATTER":
                if i + 1 == len(self.statements) or self.statements[i + 1].kind != "GATHER":
                    raise ProgramError("a scatter must be followed by a gather")
                s.pair, self.statements[i + 1].pair = i + 1, i
            elif s.kind == "GATHER" and s.pair == -1:
                raise ProgramError("a gather must follow a scatter")
            if s.kind in ("SCATTER", "GATHER") and not s.reads + s.writes:
                raise ProgramError(f"a {s.kind.lower()} must name a variable, whose partitions it runs over")
        if open_:
            raise ProgramError("Loops unpaired!")
        return self

    def explain(self) -> str:
        self.validate()
        out = [f"program {self.name}"]
        out += [f"  variable {v.name}: {v.schema}, group {self.groups[v.name]}, {self.parallelism[v.name]} partitions" for v in self.variables.values()]
        for i, s in enumerate(self.statements):
            access = ", ".join([f"reads {v.name}" for v in s.reads] + [f"writes {v.name}" for v in s.writes])
            out.append(f"  {i} {s.kind}{f' {s.count}' if s.kind == 'LOOP' else ''}{f' with {s.pair}' if s.pair >= 0 else ''}{': ' + access if access else ''}{' (tracked)' if s.tracked else ''}")
        return "\n".join(out)

    # execution

    def run(self, spark: SparkSession, inputs: dict[str, DataFrame] | None = None, most_trips: int = 10_000, cut_every: int = 4, control: Callable[[int], None] | None = None) -> dict[str, DataFrame]:
        """Run to the end; returns the variables' frames. ``inputs`` are first contents (else one empty row a partition).

        Loop state is checkpointed every ``cut_every`` trips. ``control`` is called between trips, never
        between a scatter and its gather; it may block, or raise to stop.
        """
        self.validate()
        frames: dict[str, DataFrame] = {}
        for v in self.variables.values():
            given = (inputs or {}).get(v.name)
            frames[v.name] = given if given is not None else spark.createDataFrame([], f"part long, {v.schema}")
        self.tracks: list[tuple[int, int]] = []
        at, stage, trips, messages = 0, 0, {}, None
        while at < len(self.statements):
            s = self.statements[at]
            seen = {v.name: frames[v.name] for v in s.reads + s.writes}
            if s.kind == "TRANSFORM":
                self._bind(frames, s, s.fn(seen))
            elif s.kind == "SCATTER":
                messages = s.fn(seen)
            elif s.kind == "GATHER":
                n = self.parallelism[(s.reads + s.writes)[0].name]
                self._bind(frames, s, s.fn(seen, self._inbox(spark, messages, n, s.count)))
            elif s.kind in ("LOOP", "WHILE"):
                k = trips.get(at, 0)
                if k > most_trips:
                    raise ProgramError(f"statement {at} ran more than {most_trips} trips")
                if k and control:
                    control(stage)
                if k and (k % cut_every == 0 or s.kind == "WHILE"):
                    changed = {v.name for x in self.statements[at : s.pair] for v in x.writes}
                    frames.update({v: checkpoint(frames[v]) for v in changed})
                if k < s.count if s.kind == "LOOP" else s.fn(seen):
                    trips[at] = k + 1
                else:
                    trips[at], at = 0, s.pair
            else:
                at = s.pair - 1
            if s.tracked:
                self.tracks.append((stage, at))
            stage += 1
            at += 1
        return frames

    def _bind(self, frames, s: Statement, new):
        new = new or {}
        for name in new:
            if name not in {v.name for v in s.writes}:
                raise ProgramError(f"{name} isn't written by this statement")
        frames.update(new)

    @staticmethod
    def _inbox(spark, messages: DataFrame, n: int, expect: int) -> DataFrame:
        payload = [c for c in messages.columns if c != "dst"]
        got = messages.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct(*payload))).alias("messages"))
        all_ = spark.range(n).withColumnRenamed("id", "part").join(got, F.col("part") == F.col("dst"), "left").drop("dst")
        box = F.coalesce("messages", F.array().cast(got.schema["messages"].dataType))
        if expect >= 0:
            box = F.when(F.size(box) == expect, box).otherwise(F.raise_error(F.concat(F.lit(f"a partition waits for {expect} messages, got "), F.size(box).cast("string"))))
        return all_.withColumn("messages", box)


_registry: dict[str, Callable[[dict], Program]] = {}


def application(name: str):
    """Decorator: a function from parameters to a Program, under a name."""

    def put(fn):
        _registry[name] = fn
        return fn

    return put


def load(name: str, params: dict | None = None) -> Program:
    """A registered application's program, validated. ``module:name`` imports the module first."""
    if ":" in name:
        module, name = name.split(":")
        importlib.import_module(module)
    if name not in _registry:
        raise ProgramError(f"no application {name}")
    return _registry[name](params or {}).validate()
