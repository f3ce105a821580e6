"""Article blocks of fetched pages, read by the standard library's HTML parser in pandas batches."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd

#: What the pages' class names hold, and the words at the ends of titles.
SNIPPET_CLASS, POST_CLASS, DATE_CLASS = "newsletter-html", "__article", "__date"
SPONSOR, READING_TIME = "(sponsor)", "minute read)"


@dataclass
class Article:
    kind: str
    links: list[str] = field(default_factory=list)
    #: Text of each h3, and the link that it is in.
    headings: list[list] = field(default_factory=list)
    #: Class and text of each div, as far as the first end of one.
    blocks: list[list] = field(default_factory=list)


class Articles(HTMLParser):
    """Collects the page's articles. Text and links stay as they are written, entities too."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[Article] = []
        self.inside: Article | None = None
        self.link: str | None = None
        self.filling: list[list] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag == "article" and self.inside is None:
            self.inside, self.link, self.filling = Article(given.get("class", "")), None, []
        elif self.inside is None:
            return
        elif tag == "a" and "href" in given:
            raw = self.get_starttag_text()
            self.link = raw.split('href="', 1)[1].split('"', 1)[0] if 'href="' in raw else given["href"]
            self.inside.links.append(self.link)
        elif tag == "h3":
            self.inside.headings.append(["", self.link])
            self.filling.append(self.inside.headings[-1])
        elif tag == "div":
            self.inside.blocks.append(["", given.get("class", "")])
            self.filling.append(self.inside.blocks[-1])

    def handle_endtag(self, tag: str) -> None:
        if self.inside is None:
            return
        if tag == "article":
            self.found.append(self.inside)
            self.inside = None
        elif tag == "a":
            self.link = None
        elif tag in ("h3", "div"):
            done = self.inside.headings if tag == "h3" else self.inside.blocks
            self.filling = [x for x in self.filling if all(x is not y for y in done)]

    def handle_data(self, data: str) -> None:
        for x in self.filling:
            x[0] += data

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def without_reading_time(title: str) -> str:
    """The title without "(4 minute read)" at its end."""
    if title.lower().endswith(READING_TIME) and "(" in title:
        head, _, tail = title.rpartition("(")
        if tail[: -len(READING_TIME)].strip().isdigit():
            return head.strip()
    return title


def story(article: Article) -> tuple | None:
    """href, title and text of a roundup's article; none without a title that links, or for a sponsor's."""
    linked = next(((t, a) for t, a in article.headings if a), None)
    title = html.unescape(linked[0]).strip() if linked else ""
    if not title or title.lower().endswith(SPONSOR):
        return None
    text = next((t for t, kind in article.blocks if SNIPPET_CLASS in kind), "")
    return linked[1], without_reading_time(title), html.unescape(text).strip()


def post(article: Article, prefix: str) -> tuple | None:
    """href, title and date of a listing's article; none without a title and a link under prefix."""
    href = next((a for a in article.links if a.startswith(prefix) and len(a) > len(prefix)), None)
    title = article.headings[0][0].strip() if article.headings else ""
    if not href or not title:
        return None
    return href, title, next((t.strip() for t, kind in article.blocks if kind.endswith(DATE_CLASS)), "")


def rows_of(pick: Callable[[Article], tuple | None], only: Callable[[Article], bool] = lambda a: True) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over name, fetched_at and body: the first two, place among the articles that count, and what pick gives."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, at, body in zip(batch["name"], batch["fetched_at"], batch["body"], strict=True):
                for place, article in enumerate(filter(only, Articles(body or "").found)):
                    if got := pick(article):
                        rows.append((name, at, place, *got))
            yield pd.DataFrame(rows, columns=["name", "fetched_at", "place", "href", "title", "more"])

    return run


FOUND = "name string, fetched_at string, place int, href string, title string, more string"
