"""Loops whose state is a table, and which go on where they were when a driver was lost.

Each step's state is written to the loop's folder; a file next to it commits the step. Once a step is committed the state before it is deleted,
so one is left at any time, and a new driver that is given the same folder starts from the last one committed. What
a step that wasn't committed has left is deleted, not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidParameter
from ..runtime import files_of, shared_folder


class Loop:
    """A folder with the states and commits of one loop."""

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place.rstrip("/")
        self.files = files_of(spark, self.place)

    def _state(self, step: int) -> str:
        return f"{self.place}/state-{step}"

    def committed(self) -> list[int]:
        """Steps that are committed, the last one last."""
        return sorted(int(n.removeprefix("commit-")) for n in self.files.names(self.place) if n.startswith("commit-"))

    def states(self) -> list[int]:
        return sorted(int(n.removeprefix("state-")) for n in self.files.names(self.place) if n.startswith("state-"))

    def read(self, step: int) -> DataFrame:
        """The state of a committed step, with the schema that it was written with."""
        told = json.loads(self.files.read(f"{self.place}/commit-{step}"))
        return self.spark.read.schema(told["schema"]).parquet(self._state(step))

    def commit(self, step: int, state: DataFrame) -> DataFrame:
        """Write a step's state, commit it, and delete the states before."""
        self.files.delete(self._state(step))
        state.write.parquet(self._state(step))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
        self.files.write(f"{self.place}/commit-{step}", json.dumps({"step": step, "schema": schema}))
        self.clean()
        return self.read(step)

    def clean(self) -> None:
        """Delete all states but the last committed one, and then the commits of those."""
        done = self.committed()
        for step in self.states():
            if not done or step != done[-1]:
                self.files.delete(self._state(step))
        for step in done[:-1]:
            self.files.delete(f"{self.place}/commit-{step}")


def iterate(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], steps: int, place: str | None = None, write_every: int = 1) -> DataFrame:
    """``start`` after ``steps`` steps; ``step`` gets the state and the step's number, from 1 on.

    ``place``: the loop's folder. If it has a committed step, the loop goes on from there and ``start`` isn't read. ``write_every``: steps
    that one plan takes. The last state stays in the folder, and is what's returned."""
    if steps < 0 or write_every <= 0:
        raise InvalidParameter("steps are numbered from 1")
    spark = start.sparkSession
    loop = Loop(spark, place or shared_folder(spark, "loop"))
    done = loop.committed()
    at = done[-1] if done else 0
    if at > steps:
        raise InvalidParameter(f"the loop in {loop.place} is at step {at} already")
    loop.clean()
    state = loop.read(at) if done else start
    while at < steps:
        upto = min(at + write_every, steps)
        for k in range(at + 1, upto + 1):
            state = step(state, k)
        state, at = loop.commit(upto, state), upto
    return state
