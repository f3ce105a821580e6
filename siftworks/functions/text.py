"""Text, HTML and JSON functions."""

from __future__ import annotations

import html as _html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What a page says that stands in for a feed.
CHALLENGE = ("sgcaptcha", "cf-chl", "cdn-cgi/challenge-platform", "checking your browser before accessing", "attention required! | cloudflare", "just a moment...")
ELLIPSIS = "…"


def escape_html(c: Column) -> Column:
    """& first, then < and >; quotes stay (F2)."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_markdown(c: Column) -> Column:
    """A backslash before each of the eighteen characters that mean something."""
    return F.regexp_replace(c, r"([_*\[\]()~`>#+\-=|{}.!])", r"\\$1")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def html_text(c: Column) -> Column:
    """Text between tags, white space collapsed; entities stay as they are (native form of F4)."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<!--.*?-->|<[^>]+>", " "))


def visible_length(c: Column) -> Column:
    """Length of the text without style and script blocks."""
    return F.length(html_text(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(style|script)\b.*?</\1>", " ")))


@F.pandas_udf(StringType())
def unescape(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities as characters, in Arrow batches."""
    for s in rows:
        yield s.map(_html.unescape, na_action="ignore")


def clean_inline(c: Column) -> Column:
    """Tags out, entities decoded, ends trimmed."""
    return F.regexp_replace(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")), r"^\s+|\s+$", "")


def make_title(c: Column, most: int = 80) -> Column:
    """The text if short; else cut at the last space within most characters, with an ellipsis."""
    head = F.substring(c, 1, most)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)^(.*) ", 1)).otherwise(head)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("(no text)")).when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit(ELLIPSIS)))


def truncate(c: Column, most: int) -> Column:
    """Cut to most characters, white space at the cut off, an ellipsis on (F8). Before escaping, never after."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most), r"\s+$", ""), F.lit(ELLIPSIS)))


def strip_illegal_xml(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def repair_ampersands(c: Column) -> Column:
    """Escapes each & that begins no entity XML knows."""
    return F.regexp_replace(c, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);)", "&amp;")


def is_challenge(content_type: Column, body: Column) -> Column:
    """Whether a body that isn't declared as XML is a bot challenge, by its first 2000 characters."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    marked = F.rlike(F.lower(F.substring(body, 1, 2000)), F.lit("|".join(r"\Q" + m + r"\E" for m in CHALLENGE)))
    return ~F.rlike(kind, F.lit("xml|rss")) & marked


def video_url(c: Column) -> Column:
    """A struct of has_video and video_url: the link around the first marker, from the last http before it."""
    def around(marker: str) -> Column:
        before = F.substring_index(c, marker, 1)
        at = F.length(before) - F.locate("ptth", F.reverse(before)) - 2
        link = F.regexp_extract(F.substr(c, at), r"""^[^ "'<>)\n\t]*""", 0)
        return F.when(F.contains(c, F.lit(marker)), F.struct(F.lit(True).alias("has_video"), F.when(F.contains(before, F.lit("http")), link).alias("video_url")))

    none = F.struct(F.lit(False).alias("has_video"), F.lit(None).cast("string").alias("video_url"))
    return F.coalesce(around("youtube.com/watch"), around("youtu.be/"), none)


def fenced_json(c: Column, schema: str) -> Column:
    """JSON with or without a code fence around it, by schema; null if it does not parse."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?s)^```[^\n]*\n", ""), r"(?s)```\s*$", "")
    return F.from_json(F.trim(body), schema, {"mode": "PERMISSIVE"})


def file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def embedding_text(title: Column, text: Column, most: int = 8000) -> Column:
    """What is embedded of an item."""
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))), 1, most)


def proposal_id(url: Column) -> Column:
    """A stable id of a proposal."""
    return F.concat(F.lit("proposal-"), F.substring(F.sha2(url.cast("binary"), 256), 1, 16))
