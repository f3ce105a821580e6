"""A message service's updates as a streaming source, read from an offset."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "update_id long, message_id string, text string, reply_to string"


def rows_of(updates: list[dict]) -> list[tuple]:
    """Updates as rows; those without a message are left out."""
    out = []
    for u in updates:
        m = u.get("message") or u.get("channel_post")
        if m:
            to = (m.get("reply_to_message") or {}).get("message_id")
            out.append((u["update_id"], str(m.get("message_id")), m.get("text"), None if to is None else str(to)))
    return out


class UpdateReader(SimpleDataSourceStreamReader):
    """Offsets live in the stream's checkpoint; a read that fails is made again from the same one."""

    def __init__(self, options: dict) -> None:
        self.url = options["url"]

    def _fetch(self, offset: int) -> list[dict]:
        with urllib.request.urlopen(f"{self.url}{'&' if '?' in self.url else '?'}offset={offset}") as r:
            answer = json.loads(r.read())
        if not answer.get("ok"):
            raise RuntimeError(f"updates: {answer}")
        return answer["result"]

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        got = self._fetch(start["offset"])
        return iter(rows_of(got)), {"offset": got[-1]["update_id"] + 1 if got else start["offset"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(rows_of([u for u in self._fetch(start["offset"]) if u["update_id"] < end["offset"]]))


class UpdateSource(DataSource):
    """spark.dataSource.register(UpdateSource); spark.readStream.format("message_updates").option("url", ...)."""

    @classmethod
    def name(cls) -> str:
        return "message_updates"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> UpdateReader:  # noqa: ANN001
        return UpdateReader(dict(self.options))
