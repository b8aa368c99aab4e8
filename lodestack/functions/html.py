"""HTML to Markdown on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that hold no content, and class names of what is cleaned away.
DROPPED = frozenset("script style noscript nav footer header aside iframe svg".split())
ROLES = frozenset("navigation banner contentinfo".split())
JUNK = frozenset("reflist references refbegin catlinks mw-authority-control".split())
MARKS = frozenset("reference noprint".split())  # of sup elements
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
MAIN = ("article", "main")
LONGEST_LINK = 200


class _Builder(HTMLParser):
    def __init__(self, base: str, only: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.only, self.out = base, only, []
        self.stack: list[tuple[str, bool]] = []
        self.inside, self.hidden, self.links, self.lists = 0, 0, [], []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        main = tag == self.only or (self.only == "role" and a.get("role") == "main")
        classes = set(a.get("class", "").split())
        marked = bool(JUNK & classes) or a.get("id") == "References" or (tag == "sup" and bool(MARKS & classes))
        unseen = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I) is not None or "hidden" in a or a.get("aria-hidden") == "true"
        hide = tag in DROPPED or a.get("role") in ROLES or marked or unseen
        if tag not in VOID:
            self.stack.append((tag, hide, main))
            self.hidden += hide
            self.inside += main
        if self.hidden or (self.only and not self.inside):
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "table", "blockquote", "pre"):
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n")
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.out.append("\n" + "  " * (len(self.lists) - 1) + ("- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("_")
        elif tag == "code":
            self.out.append("`")
        elif tag == "tr":
            self.out.append("\n| ")
        elif tag == "a":
            self.links.append((len(self.out), a.get("href", "")))
        elif tag == "img":
            source = a.get("src", "")
            if source and not source.startswith("data:") and "badge" not in source and len(urljoin(self.base, source)) < LONGEST_LINK:
                self.out.append(f"![{a.get('alt', '')}]({urljoin(self.base, source)})")

    def handle_endtag(self, tag):
        if not any(t == tag for t, *_ in self.stack):
            return
        shown = not self.hidden and (not self.only or self.inside)
        if shown and tag == "a" and self.links:
            at, target = self.links.pop()
            label = "".join(self.out[at:]).strip()
            url = urljoin(self.base, target)
            del self.out[at:]
            self.out.append(f"[{label}]({url})" if label and target and not target.startswith("data:") and len(url) < LONGEST_LINK else label)
        elif shown and tag in ("strong", "b"):
            self.out.append("**")
        elif shown and tag in ("em", "i"):
            self.out.append("_")
        elif shown and tag == "code":
            self.out.append("`")
        elif shown and tag in ("td", "th"):
            self.out.append(" | ")
        elif tag in ("ul", "ol") and self.lists and shown:
            self.lists.pop()
            self.out.append("\n")
        elif shown and re.fullmatch(r"h[1-6]|p|div|section|table|blockquote|pre", tag):
            self.out.append("\n\n")
        while self.stack:
            t, hide, main = self.stack.pop()
            self.hidden -= hide
            self.inside -= main
            if t == tag:
                break

    def handle_data(self, data):
        if not self.hidden and (not self.only or self.inside):
            self.out.append(data if any(t == "pre" for t, *_ in self.stack) else re.sub(r"\s+", " ", data))


def to_markdown(html: str, base: str = "") -> str:
    """Markdown of the article, else the main part, else the page; no navigation, hidden nodes, citations or data images."""
    only = next((t for t in MAIN if re.search(rf"<{t}[\s>]", html, re.I)), "role" if re.search(r"role=[\"']?main\b", html, re.I) else None)
    builder = _Builder(base, only)
    builder.feed(html)
    builder.close()
    text = re.sub(r"\[(?:\d+|edit|citation needed)\]", "", "".join(builder.out))
    text = re.sub(r"[ \t]+\n", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+(?=\n)", "\n", text)).strip()


def html_to_markdown(column: str) -> Column:
    """Markdown of a column of pages; null stays null."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: None if h is None else to_markdown(h))

    return run(F.col(column))
