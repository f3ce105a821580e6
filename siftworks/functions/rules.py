"""Validation, predicates and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tags an item may have, and the words that decide a proposal.
TAGS = ("agentic-engineering", "memory-systems", "llm-tooling", "evals", "learning-resource", "distributed-systems", "new-tool-launch", "noise", "course")
APPROVE = ("approve", "approved", "yes", "y", "ok", "okay", "go", "do it")
REJECT = ("reject", "rejected", "no", "n", "nope", "skip", "pass", "don't", "dont")
#: What marks a customer story, and what a nudge of each strength adds.
CASE_STUDY = ("case study", "success story", "customer story", "how [company]", "partners with", "chose langchain", "chose langgraph")
MAGNITUDES = {"mild": 0.05, "moderate": 0.10, "strong": 0.20}


def valid_tags(tags: Column, allowed: tuple[str, ...] = TAGS) -> Column:
    """A struct of kept, the allowed tags in their order, and rejected, the distinct others."""
    known = F.array(*map(F.lit, allowed))
    return F.struct(F.filter(tags, lambda t: F.array_contains(known, t)).alias("kept"), F.array_except(tags, known).alias("rejected"))


def valid_classification(classification: Column, proposal_type: Column, reasoning: Column) -> Column:
    """A struct with any fault put right: unknown classes become plan items, plan items have no type, proposals of unknown type are new."""
    known = classification.isin("plan_item", "project_proposal")
    proposal = F.coalesce(classification == "project_proposal", F.lit(False))
    kind = F.when(proposal, F.when(proposal_type.isin("extend", "new"), proposal_type).otherwise(F.lit("new")))
    why = F.coalesce(reasoning, F.when(F.coalesce(known, F.lit(False)), F.lit("")).otherwise(F.lit("fallback: invalid classification")))
    return F.struct(F.when(proposal, F.lit("project_proposal")).otherwise(F.lit("plan_item")).alias("classification"), kind.alias("proposal_type"), why.alias("classification_reasoning"))


def decision(text: Column) -> Column:
    """approve, reject or null, by exact words."""
    word = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(word.isin(*APPROVE), F.lit("approve")).when(word.isin(*REJECT), F.lit("reject"))


def is_roundup(source: Column, title: Column, sources: tuple[str, ...] = ("TLDR AI",), prefix: str = "[AINews]") -> Column:
    """Whether an item sums up many stories, and so never counts as the copy of one."""
    return F.coalesce(source.isin(*sources), F.lit(False)) | F.coalesce(F.startswith(title, F.lit(prefix)), F.lit(False))


def is_welcome(subject: Column) -> Column:
    return F.rlike(F.coalesce(subject, F.lit("")), F.lit(r"(?i)^welcome\b|^thanks for subscribing\b"))


def is_case_study(title: Column, text: Column) -> Column:
    """By literal words in title and text."""
    hay = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))
    found = F.lit(False)
    for m in CASE_STUDY:
        found |= F.contains(hay, F.lit(m))
    return found


def sender_address(header: Column) -> Column:
    """The bare address of a From header, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(header, F.lit("")), r"[\w.+-]+@[\w.-]+", 0))


def section(tags: Column, matched: Column, selected: Column) -> Column:
    """courses before reading before project work; a matched item that was not selected is in none."""
    return F.when(F.array_contains(tags, "course"), F.lit("courses")).when(matched.isNull(), F.lit("reading")).when(selected, F.lit("existing_project_work"))


def nudge_delta(direction: Column, magnitude: Column) -> Column:
    """What a classified reply adds; null for an answer that is none."""
    size = F.create_map(*[F.lit(x) for kv in MAGNITUDES.items() for x in kv])[magnitude]
    return F.when(direction == "neutral", F.when(size.isNotNull(), F.lit(0.0))).when(direction == "up", size).when(direction == "down", -size)


def cost_a(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars at 0.25 and 1.25 a million tokens, to six places."""
    return F.round((tokens_in * 0.00025 + tokens_out * 0.00125) / 1000, 6)


def cost_b(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars at 0.15 and 0.60 a million tokens, to six places."""
    return F.round(tokens_in * 0.15e-6 + tokens_out * 0.60e-6, 6)


def cost_embedding(tokens: Column, rate: float = 0.0) -> Column:
    return F.round(tokens * rate, 8)


def dollars(c: Column, places: int = 4) -> Column:
    return F.format_string(f"$%.{places}f", c.cast("double"))
