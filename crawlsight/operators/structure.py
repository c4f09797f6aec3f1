"""The structure of a page by one walk over its tags, where patterns over the source can't follow nesting."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements that say what a part of a page is, how many of a page are read, how much of each.
SEMANTIC, ELEMENTS, CHARACTERS = ("main", "article", "section", "address", "time", "header"), 100, 2000
_EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("semantic_elements", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))),
    ("twitter", pa.map_(pa.string(), pa.string())),
])


class _Walk(HTMLParser):
    """Texts of the semantic elements of one page, each with what is nested in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.twitter: dict[str, str] = {}
        self.found: list[list] = []  # tag, pieces, characters without blanks
        self.open: list[tuple[str, int | None]] = []  # tag and its place in ``found``

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            said = {k: v for k, v in reversed(attrs)}  # the first of repeated attributes counts
            if (said.get("name") or "").startswith("twitter:") and said.get("content") is not None:
                self.twitter[said["name"]] = " ".join(said["content"].split())
        if tag in _EMPTY:
            return
        place = None
        if tag in SEMANTIC and len(self.found) < ELEMENTS:
            place = len(self.found)
            self.found.append([tag, [], 0])
        self.open.append((tag, place))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, max(-1, len(self.open) - 1 - 512), -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        words = data.split()
        if words:
            n = sum(map(len, words))
            for _, place in self.open:
                if place is not None and self.found[place][2] < CHARACTERS:
                    self.found[place][1].extend(words)
                    self.found[place][2] += n

    def elements(self) -> list[dict[str, str]]:
        read = ((tag, " ".join(words)[:CHARACTERS]) for tag, words, _ in self.found)
        return [{"tag": tag, "text": text} for tag, text in read if text]


def page_structure(pages: DataFrame) -> DataFrame:
    """(page_id, semantic_elements, twitter) of ``pages`` (page_id, html): one walk per page, in Arrow batches.

    semantic_elements: tag and text of the first hundred such elements, in the order in which they open, empty ones left
    out; an element's text holds that of the elements nested in it, cut at 2,000 characters, and one that is never closed
    goes on to the end of what holds it. twitter: the ``twitter:`` metadata, the last of repeated names. A null source is an
    empty page; repeated rows give a row each.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements, cards = [], []
            for source in batch["html"].to_pylist():
                w = _Walk()
                w.feed(source)
                w.close()
                elements.append(w.elements())
                cards.append(list(w.twitter.items()))
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(elements, _SCHEMA.field(1).type), pa.array(cards, _SCHEMA.field(2).type)], schema=_SCHEMA)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html"))
    return source.mapInArrow(walk, "page_id long, semantic_elements array<struct<tag:string,text:string>>, twitter map<string,string>")
