"""Composable steps: functions on DataFrames or SQL text, chained by the names of their results."""

from __future__ import annotations

import re
import string
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Step:
    """A named step. ``body`` is SQL text with ``{placeholders}`` for its inputs, or a function of DataFrames by placeholder."""

    name: str
    body: str | Callable[..., DataFrame]
    inputs: dict[str, str] = field(default_factory=dict)
    description: str = ""
    #: A direct step runs at once, before the others, for what it does.
    direct: bool = False

    def __post_init__(self):
        if not self.name or not self.body:
            raise ValueError("a step needs a name and a body")
        if isinstance(self.body, str):
            wanted = {f for _, f, _, _ in string.Formatter().parse(self.body) if f}
            if wanted - set(self.inputs):
                raise ValueError(f"step {self.name!r} has no input for {sorted(wanted - set(self.inputs))}")

    def sql(self) -> str:
        if not isinstance(self.body, str):
            raise TypeError(f"step {self.name!r} is not SQL")
        return self.body.format(**self.inputs)


class Pipeline:
    """Steps in order; the last one's result is the pipeline's. Nothing runs until the result is used, but direct steps."""

    def __init__(self, steps: list[Step] | None = None):
        self.steps: list[Step] = []
        for s in steps or []:
            self.add(s)

    def add(self, step: Step, at: int | None = None) -> Pipeline:
        if any(s.name == step.name for s in self.steps):
            raise ValueError(f"there is a step {step.name!r} already")
        self.steps.insert(len(self.steps) if at is None else at, step)
        return self

    def remove(self, name: str) -> Pipeline:
        kept = [s for s in self.steps if s.name != name]
        if len(kept) == len(self.steps):
            raise KeyError(name)
        self.steps = kept
        return self

    def sql(self) -> str:
        """One statement of common table expressions, if all steps that aren't direct are SQL."""
        own = [s for s in self.steps if not s.direct]
        if not own:
            raise ValueError("the pipeline has no steps")
        if len(own) == 1:
            return own[0].sql()
        parts = [f"{s.name} AS (\n{s.sql()}\n)" for s in own[:-1]]
        return "WITH " + ",\n".join(parts) + "\n" + own[-1].sql()

    def run(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, verbose: bool = False, args: dict | None = None) -> DataFrame:
        """The last step's DataFrame. ``tables`` are inputs by name; ``args`` are named SQL parameters."""
        known = dict(tables or {})
        if not self.steps:
            raise ValueError("the pipeline has no steps")
        out = None
        for step in sorted(self.steps, key=lambda s: not s.direct):
            if verbose:
                print(f"{step.name}: {step.description}")
            if isinstance(step.body, str):
                frames = {n: known[n] for n in step.inputs.values() if n in known}
                named = {n: f"v_{re.sub(r'[^A-Za-z0-9_]', '_', n)}_{id(self)}" for n in frames}
                for n, df in frames.items():
                    df.createOrReplaceTempView(named[n])
                query = step.body.format(**{k: named.get(n, n) for k, n in step.inputs.items()})
                df = spark.sql(query, args=args) if args else spark.sql(query)
            else:
                df = step.body(**{k: known[n] for k, n in step.inputs.items()})
            if step.direct:
                if isinstance(df, DataFrame):
                    df.count()
            else:
                out = df
            if isinstance(df, DataFrame):
                known[step.name] = df
        return out

    def save_as_table(self, spark: SparkSession, name: str, **how) -> DataFrame:
        """Runs and writes the result as a table; replaces one of that name."""
        self.run(spark, **how).write.mode("overwrite").saveAsTable(name)
        return spark.table(name)

    def explain(self, spark: SparkSession, **how) -> None:
        self.run(spark, **how).explain("formatted")


_READ = re.compile(r"\s*(select|with)\b", re.I)


def read_only(spark: SparkSession, query: str) -> DataFrame:
    """A query that only reads: one statement that begins with SELECT or WITH and plans as a query."""
    if not _READ.match(query):
        raise ValueError("only SELECT and WITH are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    if re.search(r"Insert|Command|Create|Drop|Alter", plan.getClass().getSimpleName()) or "InsertIntoStatement" in plan.toString():
        raise ValueError("only queries are allowed")
    return spark.sql(query)
