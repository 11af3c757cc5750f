"""Ordered table functions applied one after the other, with a report per step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

TableFunction = Callable[..., "DataFrame | tuple[DataFrame, object]"]


@dataclass
class Step:
    function: TableFunction
    name: str
    description: str = ""
    arguments: dict = field(default_factory=dict)


@dataclass
class Outcome:
    """What became of one step; ``rows`` is known once an action ran on the result."""
    name: str
    status: str
    seconds: float
    error: str | None = None
    detail: object = None
    observed: Observation | None = None


class StepChain:
    """A chain only builds a plan: Spark optimises all steps together and runs them in one job."""

    def __init__(self, name: str = "chain"):
        self.name, self.steps = name, []

    def add(self, function: TableFunction, name: str | None = None, description: str = "", **arguments) -> "StepChain":
        self.steps.append(Step(function, name or function.__name__, description, arguments))
        return self

    def problems(self) -> list[str]:
        names = [s.name for s in self.steps]
        found = [] if names else ["no steps"]
        return found + [f"duplicate step {n}" for n in dict.fromkeys(names) if names.count(n) > 1]

    def run(self, df: DataFrame, stop_on_error: bool = True, count_rows: bool = False) -> tuple[DataFrame, list[Outcome]]:
        """Apply the steps.  A failing step stops the chain or is left out.

        ``count_rows`` observes the rows after each step while the result is computed.
        """
        outcomes = []
        for step in self.steps:
            start = perf_counter()
            try:
                result = step.function(df, **step.arguments)
                new, detail = result if isinstance(result, tuple) else (result, None)
                if not isinstance(new, DataFrame):
                    raise TypeError(f"step {step.name} returned no DataFrame")
                df = new
                outcomes.append(Outcome(step.name, "completed", perf_counter() - start, detail=detail))
            except Exception as error:
                outcomes.append(Outcome(step.name, "failed", perf_counter() - start, str(error)))
                if stop_on_error:
                    raise RuntimeError(f"step {step.name} failed: {error}") from error
                continue
            if count_rows:
                seen = Observation(f"{self.name}:{len(outcomes)}:{step.name}")
                df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
                outcomes[-1].observed = seen
        return df, outcomes


def report(spark: SparkSession, outcomes: list[Outcome]) -> DataFrame:
    """``position, step, status, seconds, rows, error``; call it after an action on the result."""
    rows = [(i, o.name, o.status, float(o.seconds), o.observed.get["rows"] if o.observed else None, o.error)
            for i, o in enumerate(outcomes)]
    return spark.createDataFrame(
        rows, "position int, step string, status string, seconds double, rows bigint, error string")


def by_partition(function, schema) -> TableFunction:
    """A step from a pandas function that maps each Arrow batch of rows."""
    def step(df: DataFrame) -> DataFrame:
        return df.mapInPandas(lambda batches: (function(b) for b in batches), schema)
    return step
