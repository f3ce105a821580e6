"""Stages of a run, kept until it ends, so that a run that broke off goes on at its first unfinished stage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from siftworks.context import RunContext
from siftworks.sources.ledger import digest
from siftworks.sources.store import TableStore


class StepLimit(RuntimeError):
    """A run took more steps than it may."""


class Stages:
    """keep() gives the rows of a stage from the store's folder of the run, made only if they are not there.

    A stage's name has a digest of the tables that the run began with and of the stages before it, so a run that is
    repeated on other rows or by other parameters makes all of them anew. A table that a failing write left is not complete and not read.
    """

    def __init__(self, store: TableStore, ctx: RunContext, *inputs: DataFrame) -> None:
        self.store, self.ctx, self.last = store, ctx, digest(*inputs)

    def keep(self, name: str, make: Callable[[], DataFrame], *parameters: object) -> DataFrame:
        self.ctx.steps.append(name)
        if len(self.ctx.steps) > self.ctx.max_steps:
            raise StepLimit(f"more than {self.ctx.max_steps} steps, the last of them {name}")
        now = hashlib.sha256(f"{self.last}/{name}/{parameters}".encode()).hexdigest()
        rows = self.store.stage(self.ctx.run_id, f"{name}-{now[:16]}", make)
        self.last = now  # a stage that failed and is left out is no part of what follows
        return rows
