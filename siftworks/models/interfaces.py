"""Interfaces of the models and services that a run calls."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, rows: DataFrame, text: str, out: str = "embedding_vector") -> DataFrame:
        """rows with a vector and n_tokens for each text. Called in Arrow batches."""


class Scorer(Protocol):
    def score(self, batches: DataFrame) -> DataFrame:
        """batch, index, keep, reasoning and tags for batched items; a batch that failed may have a row with its error instead."""


class Matcher(Protocol):
    def match(self, items: DataFrame, cards: DataFrame) -> DataFrame:
        """item_id, matched_card_id and pos."""


class Classifier(Protocol):
    def classify(self, items: DataFrame) -> DataFrame:
        """item_id, classification, proposal_type, classification_reasoning and pos."""


class Prioritizer(Protocol):
    def select(self, items: DataFrame, cards: DataFrame, movements: DataFrame) -> DataFrame:
        """matched_card_id, source, item_url, priority_reasoning, movement_note and pos."""


class Sentiment(Protocol):
    def classify(self, feedback: DataFrame) -> DataFrame:
        """feedback with direction and magnitude."""


class ReplyParser(Protocol):
    def parse(self, replies: DataFrame, item_map: DataFrame) -> DataFrame:
        """message_id, item_number, feedback_text and sentiment."""


class Rewriter(Protocol):
    def rewrite(self, profile: str, feedback: DataFrame) -> str:
        """The new profile."""


class Notifier(Protocol):
    """key, where it is given, names what is sent or made once for all: find tells what has it, or None."""

    def send(self, text: str, markup: str | None = "HTML", key: str | None = None) -> str:
        """Sends a message and gives its id."""

    def find(self, key: str) -> str | None: ...


class Board(Protocol):
    def create(self, title: str, list_id: str, description: str, key: str | None = None) -> dict: ...

    def update(self, card_id: str, description: str) -> dict: ...

    def find(self, key: str) -> dict | None: ...
