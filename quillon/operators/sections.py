"""Articles from HTML: their text, without boilerplate, and its partition into sections by headings."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What is no part of an article, by tag and by class.
SKIPPED_TAGS = frozenset("script style template noscript nav header footer aside form head".split())
SKIPPED_CLASSES = frozenset(
    "navbox references reflist refbegin mw-references-wrap reference mw-editsection hatnote noprint metadata mbox ambox mw-empty-elt shortdescription seealso see-also"
    " external-links external-Links".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article blockquote br caption dd div dl dt figcaption h1 h2 h3 h4 h5 h6 hr li main ol p pre section table td th tr ul".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
SCHEMA = "title string, text string, sections array<struct<heading_path:array<string>,level:int,char_start:int,char_end:int>>"


class Outline(HTMLParser):
    """Blocks of a page's text in order, each with the level of its heading (0: none)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.title, self.level, self.words, self.skipped, self.in_title = "", 0, [], [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipped:
            self.skipped += [] if tag in VOID else [tag]
        elif tag in SKIPPED_TAGS - {"head"} or SKIPPED_CLASSES & set((dict(attrs).get("class") or "").split()):
            self.end_block()
            self.skipped += [] if tag in VOID else [tag]
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            self.end_block()
            self.level = HEADINGS.get(tag, 0)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS and not self.skipped:
            self.end_block()

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.skipped:
            self.words.append(data)

    def end_block(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.blocks.append((self.level, text))
        self.words, self.level = [], 0


def article_of(html: str) -> tuple[str, str, list[dict]]:
    """Title, text (blocks, one a line) and sections of a page. A section begins at its heading and ends at the next; what stands before
    the first belongs to none. Without headings the text is one section of level 0."""
    page = Outline()
    page.feed(html)
    page.close()
    page.end_block()
    at, path, sections = 0, [], []
    for level, text in page.blocks:
        if level:
            path = [(k, t) for k, t in path if k < level] + [(level, text)]
            sections.append({"heading_path": [t for _, t in path], "level": level, "char_start": at})
        at += len(text) + 1
    end = max(at - 1, 0)
    if not sections:
        sections = [{"heading_path": [], "level": 0, "char_start": 0}]
    for own, following in zip(sections, [*sections[1:], {"char_start": end}], strict=True):
        own["char_end"] = following["char_start"]
    return " ".join(page.title.split()), "\n".join(t for _, t in page.blocks), sections


def articles(pages: DataFrame) -> DataFrame:
    """zim_id, path, title, text and sections of pages (zim_id, path, title, html); a page's own title where none is given."""
    kind = pa.list_(pa.struct([("heading_path", pa.list_(pa.string())), ("level", pa.int32()), ("char_start", pa.int32()), ("char_end", pa.int32())]))

    def run(batches):
        for batch in batches:
            found = [article_of(h or "") for h in batch.column(3).to_pylist()]
            titles = [given or own or path for given, (own, _, _), path in zip(batch.column(2).to_pylist(), found, batch.column(1).to_pylist(), strict=True)]
            columns = [pa.array(titles, pa.string()), pa.array([t for _, t, _ in found], pa.string()), pa.array([s for _, _, s in found], kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["zim_id", "path", "title", "text", "sections"])

    rows = pages.select(F.col("zim_id").cast("int"), "path", "title", F.col("html").cast("string"))
    return rows.mapInArrow(run, f"zim_id int, path string, {SCHEMA}")
