"""What a run knows of itself."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXTS = {"daily": ("daily",), "weekly": ("daily", "weekly")}


@dataclass(frozen=True)
class RunContext:
    """Ids and times are made once, on the driver, so that a plan that runs twice gives the same rows."""

    context: str = "daily"
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    run_ts: datetime = field(default_factory=lambda: datetime.now(UTC))
    dry_run: bool = False
    #: Stages that a run may have.
    max_steps: int = 50
    steps: list = field(default_factory=list, compare=False, repr=False)
    #: Summaries of the run's nodes so far; written when the run ends.
    nodes: list = field(default_factory=list, compare=False, repr=False)

    def __post_init__(self) -> None:
        if self.context not in CONTEXTS:
            raise ValueError(f"unknown context {self.context}")

    @property
    def buckets(self) -> tuple[str, ...]:
        """The source buckets of the context: the weekly one has the daily one's too."""
        return CONTEXTS[self.context]

    def now(self) -> Column:
        return F.lit(self.run_ts)

    def now_iso(self) -> str:
        return self.run_ts.isoformat()
