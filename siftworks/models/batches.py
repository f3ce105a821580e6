"""A scorer that asks a function about a batch at a time, in the executors (L3)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

SAID = "batch int, index int, keep boolean, reasoning string, tags array<string>, error string"


class BatchScorer:
    """ask gets the rows of a batch as dicts, in order, and gives dicts of index, keep, reasoning and tags.

    A batch for which it raises, or of which an answer has another shape, has one row with the error and no answers;
    the other batches keep theirs. A task that is run again asks again, so a batch may be asked twice where an executor is lost.
    """

    def __init__(self, ask: Callable[[list[dict]], list[dict]]) -> None:
        self.ask = ask

    def score(self, batches: DataFrame) -> DataFrame:
        ask, names = self.ask, [c.split()[0] for c in SAID.split(", ")]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("index")
            batch, places = int(rows["batch"].iloc[0]), set(rows["index"])
            try:
                said = []
                for a in ask(rows.to_dict("records")):
                    if a["index"] not in places or not isinstance(a["keep"], bool):
                        raise ValueError(f"no answer to a row of the batch: {a}")
                    said.append((batch, a["index"], a["keep"], a["reasoning"], list(a["tags"]), None))
            except Exception as e:  # this batch's failure leaves the others
                said = [(batch, None, None, None, None, str(e)[:500] or type(e).__name__)]
            return pd.DataFrame(said, columns=names)

        return batches.groupBy("batch").applyInPandas(run, SAID)
