"""HTML main text by consensus host paths.

Each page's containers are scored by the text of the paragraphs straight inside them, less their links. A page votes,
with the score, for the generalised path of its best container: the tags and classes on the way down, digits
taken out. Votes are summed per host in Spark; each host's winning path is where its pages' text is then taken from.
A page without the winning path falls back on the best container of its own. From there the text is that of the whole
article around it (see `climbed`), so that headings, leads and sibling sections stay.

Boilerplate is left out wherever it stands: by tag (menus, headers, footers, asides, forms, scripts, styles) and by
words in class, id or role of boxes, never of headings, paragraphs and inline tags (adverts, notices, sidebars, comments and the like).
Within an article an id alone, which may be the slug of a heading, or a class such as search or related only casts doubt: such a box goes if
it is half links, or less than half prose. Formulas and the texts of drawings stay. Character references are decoded, white
space within a block becomes one space, and blocks are joined in page order by one space.

Parsing takes time and memory in proportion to the page, whatever it holds: tags are matched where they stand, within
TAG_CHARS first and up to the next > if their quotes do not end there; containers are numbered and know their parents, so
that a path is written out for the winner only. An element whose content is skipped (a script, a list to choose from, a
drawing) and that is never closed ends at the next block.

Winning paths are joined on by host with salt, as one host may hold a third of all pages; up to
`MAX_BROADCAST` paths are broadcast instead.

Defined cases: a null or empty html gives an empty text; a page without any container that has text gives the text of its
body less boilerplate; null urls form a host of their own; repeated rows and an empty table are as any; other columns
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import checkpointed

#: Tags by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea iframe select canvas title annotation annotation-xml".split())
SKIP = frozenset("nav header footer aside form button dialog menu head label fieldset".split()) | RAW
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 blockquote pre".split())
CONTAINER = frozenset("article main section div td body blockquote center".split())
JUNK = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|notification|newsletter|subscribe|popup|modal|sidebar|menu|nav\w*"
    r"|breadcrumbs?|footer|header|masthead|share|social|related|recommended|comments?|comment-?list|disqus|replies|respond|widget|pagination|pager|login|signup|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Words that a section of an article may be called by as well: there the links and prose of what it holds decide.
WEAK = re.compile(r"(?<![^\s_-])(?:social|share|related|recommended|search)(?![^\s_-])", re.IGNORECASE)
#: Ids that mark boilerplate in an article too; others there may be the slugs of headings.
STRONG_ID = re.compile(r"(?:comments?|comment-?list|disqus(?:_thread)?|replies|respond|sidebar|newsletter|cookies?(?:-\w+)?|ads?(?:-\w+)?)", re.IGNORECASE)
#: Characters of prose that a box of such a class has to hold.
SENTENCE = 40
#: Tags whose class or id may mark boilerplate; headings, paragraphs, list items and inline tags are content whatever they are called.
BOXES = frozenset("section div td th table ul ol dl blockquote center details figure nav aside header footer".split())
JUNK_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Articles that are a reader's comment.
COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|disqus)(?:$|[\s_-])", re.IGNORECASE)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
TAG_CHARS = 1 << 16
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
NEXT_BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.IGNORECASE)
SALTS, MAX_BROADCAST = 32, 50_000
#: Path of what stands outside of any container; steps of a path are divided by a space, which no class holds.
ROOT = "~"
#: How far out a block counts for the containers around it.
NEAREST = 32
#: An opening tag that ends an open element of these tags first.
CLOSES = {
    "li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
    "option": {"option"},
} | {t: {"p"} for t in BLOCK - {"br", "li", "dt", "dd", "tr", "td", "th", "p", "html", "body", "hr"}}


def _named(attributes: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}


def _step(tag: str, names: dict[str, str]) -> str:
    """One step of a generalised path: the tag and its classes, digits taken out."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in names.get("class", "").lower().split()} - {""})])


@dataclass(frozen=True)
class Block:
    """A block of text: the container it stands in, whether it is prose (in a paragraph or heading), and its characters in links."""

    box: int
    text: str
    prose: bool
    links: int


class Page:
    """Blocks of text in page order, outside of boilerplate, and the containers around them.

    Containers with the same parent and step are one, numbered after their parent; number 0 is outside of any."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.parents, self.steps = [-1], [ROOT]
        self._known: dict[tuple[int, str], int] = {}
        _Reader(self, html).read()

    def parts(self) -> tuple[list, ...]:
        """What `of` makes the page from again: boxes, texts, prose and links of the blocks; parents and steps of the containers."""
        return *([getattr(b, f) for b in self.blocks] for f in ("box", "text", "prose", "links")), self.parents, self.steps

    @classmethod
    def of(cls, boxes: list, texts: list, prose: list, links: list, parents: list, steps: list) -> Page:
        page = cls("")
        page.blocks = [Block(*b) for b in zip(boxes, texts, prose, links, strict=True)]
        page.parents, page.steps = parents, steps
        page._known = {(parent, step): i for i, (parent, step) in enumerate(zip(parents, steps, strict=True)) if i}
        return page

    def box(self, parent: int, step: str) -> int:
        found = self._known.setdefault((parent, step), len(self.steps))
        if found == len(self.steps):
            self.parents.append(parent)
            self.steps.append(step)
        return found

    def path(self, box: int) -> str:
        steps = []
        while box >= 0:
            steps.append(self.steps[box])
            box = self.parents[box]
        return " ".join(reversed(steps))

    def find(self, path: str) -> int | None:
        """The container with a path, if there is one and it holds a block."""
        box = 0
        for step in path.split(" ")[1:]:
            found = self._known.get((box, step))
            if found is None:
                return None
            box = found
        return box if any(self.inside(box)) else None

    def inside(self, box: int) -> list[bool]:
        """Which blocks stand in a container or in one within it."""
        held = [False] * len(self.steps)
        for i, parent in enumerate(self.parents):
            held[i] = i == box or (parent >= 0 and held[parent])
        return [held[b.box] for b in self.blocks]

    def best(self) -> tuple[int, float] | None:
        """The best container and its score: each block counts in full for the nearest one and by halves further out. Of equal ones
        that which begins first."""
        scores: dict[int, float] = {}
        for b in self.blocks:
            worth, box = (len(b.text) - 2 * b.links) * (1.0 if b.prose else 0.5), b.box
            for _ in range(NEAREST):
                if box < 0:
                    break
                scores[box] = scores.get(box, 0.0) + worth
                box, worth = self.parents[box], worth / 2
        if not scores:
            return None
        return max(scores.items(), key=lambda s: (s[1], -s[0]))

    def climbed(self, box: int) -> int:
        """The container of the whole article around a winning one: the outermost article, else the outermost main; else the way
        out goes on, short of the body, while the further blocks are at least half prose and less than half links."""
        around = [box]
        while self.parents[around[-1]] >= 0:
            around.append(self.parents[around[-1]])
        for tag in ("article", "main"):
            own = [i for i in around if self.steps[i].split(".")[0] == tag]
            if own:
                return own[-1]
        sums: dict[int, list[int]] = {}  # characters, in links, in prose: of the blocks straight inside each container
        for b in self.blocks:
            own = sums.setdefault(b.box, [0, 0, 0])
            for k, n in enumerate((len(b.text), b.links, len(b.text) if b.prose else 0)):
                own[k] += n
        whole = [sums.get(i, [0, 0, 0])[:] for i in range(len(self.steps))]
        for i in range(len(whole) - 1, 0, -1):
            whole[self.parents[i]] = [x + y for x, y in zip(whole[self.parents[i]], whole[i], strict=True)]
        for inner, outer in zip(around, around[1:], strict=False):
            if outer == 0 or self.steps[outer].split(".")[0] == "body":
                return inner
            size, links, prose = (x - y for x, y in zip(whole[outer], whole[inner], strict=True))
            if size and (2 * links >= size or 2 * prose < size):
                return inner
        return around[-1]

    def text(self, path: str | None) -> str:
        """The text of the article around the container at `path`, or around the page's own best one."""
        box = self.find(path) if path else None
        if box is None:
            best = self.best()
            box = best[0] if best else 0
        return " ".join(b.text for b, held in zip(self.blocks, self.inside(self.climbed(box)), strict=True) if held)


class _Reader:
    """One pass over a page's tags."""

    def __init__(self, page: Page, html: str):
        self.page, self.html = page, html
        self.stack: list[tuple[str, bool, int]] = []  # tag, whether it or one around it is boilerplate, container
        self.open: dict[str, list[int]] = {}  # places of each tag in the stack
        self.open_blocks: list[int] = []
        self.words: list[str] = []
        self.links, self.in_link, self.unclosed = 0, 0, set()
        self.suspects: list[tuple[int, int, int]] = []  # open boxes that may be boilerplate: depth in the stack, number of the first block, least prose
        self.doubted: list[tuple[int, int, int]] = []  # and closed ones: numbers of the first block and of that after the last, least prose

    def read(self) -> None:
        html, at, last = self.html, 0, self.html.rfind(">")
        while at < len(html):
            mark = html.find("<", at)
            while mark >= 0 and mark < last and not html[mark + 1].isalpha() and html[mark + 1] not in "/!?":
                mark = html.find("<", mark + 1)  # a sign in the text
            if mark < 0 or mark > last:
                self.said(html[at:])
                break
            self.said(html[at:mark])
            at = self.tag(mark)
        self.flush()
        self.cut(0)
        self.judge()

    def judge(self) -> None:
        """Strike out doubtful boxes of an article that are half links, or less than half prose, or (by their class) hold hardly any."""
        blocks, gone = self.page.blocks, set()
        for first, end, least in self.doubted:
            own = blocks[first:end]
            size, prose = sum(len(b.text) for b in own), sum(len(b.text) for b in own if b.prose)
            if 2 * sum(b.links for b in own) >= size or 2 * prose < size or prose < least:
                gone.update(range(first, end))
        if gone:
            self.page.blocks = [b for i, b in enumerate(blocks) if i not in gone]

    def said(self, piece: str) -> None:
        if piece and not (self.stack and self.stack[-1][1]):
            self.words.append(piece)
            if self.in_link:
                self.links += len(piece)

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.words)).split())
        if text:
            tag, _, box = self.stack[-1] if self.stack else ("", False, 0)
            self.page.blocks.append(Block(box, text, tag in PROSE, min(self.links, len(text))))
        self.words.clear()
        self.links = 0

    def tag(self, mark: int) -> int:
        """Deal with the tag at `mark`; where to go on."""
        html = self.html
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 2)
            return end + 3 if end >= 0 else len(html)
        m = TAG.match(html, mark, mark + TAG_CHARS) or LOOSE.match(html, mark)
        if m is None:  # a declaration or the like
            return html.find(">", mark) + 1
        name = m[2].lower()
        drawn = name == "title" and bool(self.open.get("svg"))  # the title of a drawing is a block of its own
        if drawn:
            self.flush()
        if m[1]:
            self.close(name)
            return m.end()
        if name in BLOCK:
            self.flush()
        if name in VOID:
            return m.end()
        if name in RAW and not drawn:
            return m.end() if m[3].endswith("/") else self.past(name, m.end())
        self.start(name, _named(m[3]) if len(m[3]) > 2 else {})
        return m.end()

    def past(self, name: str, at: int) -> int:
        """Where the content of a skipped element ends."""
        if name not in self.unclosed:
            close = re.compile(rf"</{re.escape(name)}\s*+>", re.IGNORECASE).search(self.html, at)
            if close:
                return close.end()
            self.unclosed.add(name)
        following = NEXT_BLOCK.search(self.html, at) if "" not in self.unclosed else None
        if following is None:
            self.unclosed.add("")
            return len(self.html)
        return following.start()

    def start(self, name: str, names: dict[str, str]) -> None:
        closes = CLOSES.get(name, ())
        while closes and self.stack and (self.stack[-1][0] in closes or (self.stack[-1][0] not in BLOCK and any(s[0] in closes for s in self.stack[-4:]))):
            self.cut(len(self.stack) - 1)
        if name == "a":
            self.in_link += 1
        _, above, box = self.stack[-1] if self.stack else ("", False, 0)
        junk = above or (name in SKIP and not (name == "title" and self.open.get("svg"))) or "hidden" in names or names.get("aria-hidden") == "true" or names.get("role", "").lower() in JUNK_ROLE
        called, slug = names.get("class", ""), names.get("id", "")
        if not junk and name in BOXES and JUNK.search(f"{called} {slug}"):
            within = self.open.get("article") or self.open.get("main")
            junk = not within or bool(STRONG_ID.fullmatch(slug)) or bool(JUNK.search(WEAK.sub("", called)))
            if not junk and not (self.suspects and self.suspects[-1][1] == len(self.page.blocks)):
                self.suspects.append((len(self.stack), len(self.page.blocks), SENTENCE if JUNK.search(called) else 0))
        junk = junk or (name == "article" and bool(COMMENT.search(f"{called} {slug}")))
        self.open.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append((name, junk, self.page.box(box, _step(name, names)) if name in CONTAINER and not junk else box))

    def close(self, name: str) -> None:
        if name == "a":
            self.in_link = max(0, self.in_link - 1)
        if not self.open.get(name):
            if name in BLOCK:
                self.flush()
            return
        depth, block = self.open[name][-1], self.open_blocks[-1] if self.open_blocks else -1
        if name not in BLOCK and block > depth:
            return
        if block >= depth:
            self.flush()
        self.cut(depth)

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.stack.pop()[0]
            self.open[name].pop()
            if self.suspects and self.suspects[-1][0] == len(self.stack):
                _, first, least = self.suspects.pop()
                self.doubted.append((first, len(self.page.blocks), least))
            if name in BLOCK:
                self.open_blocks.pop()


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARTS = {"boxes": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "prose": pa.list_(pa.bool_()), "links": pa.list_(pa.int32()), "parents": pa.list_(pa.int32()), "steps": pa.list_(pa.string())}


def _read(batches):
    """From rows (page_id, url, host, html): the page's vote, path and score, and its parts in place of the html."""
    for batch in batches:
        votes, parts = [], []
        for html in batch.column(3).to_pylist():
            page = Page(html or "")
            best = page.best()
            votes.append((page.path(best[0]), best[1]) if best else ("", 0.0))
            parts.append(page.parts())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*parts, strict=True) if parts else [()] * len(PARTS), PARTS.values(), strict=True)]
        vote = [pa.array([p for p, _ in votes], pa.string()), pa.array([s for _, s in votes], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *vote, *columns], ["page_id", "url", "host", "path", "score", *PARTS])


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path and score (the page's vote), and the parts of each page."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    kinds = "boxes array<int>, texts array<string>, prose array<boolean>, links array<int>, parents array<int>, steps array<string>"
    return rows.mapInArrow(_read, f"page_id long, url string, host string, path string, score double, {kinds}")


def winning_paths(read: DataFrame) -> DataFrame:
    """host and path: the generalised path with the largest sum of scores on each host of pages read."""
    sums = read.where("path <> ''").groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("score"), F.count("*").alias("pages"))
    first = F.max_by("path", F.struct("score", "pages", "path"))
    return sums.groupBy("host").agg(first.alias("path"))


def _taken(batches):
    for batch in batches:
        paths, parts = batch.column(2).to_pylist(), [batch.column(c).to_pylist() for c in PARTS]
        texts = [Page.of(*own).text(path) for path, *own in zip(paths, *parts, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page. Pages are parsed once: votes and texts come from the parts written then."""
    read = checkpointed(read_pages(pages))
    winners = checkpointed(winning_paths(read))
    rows = read.drop("path", "score")
    if winners.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "path", *PARTS).mapInArrow(_taken, "page_id long, url string, text string, n_chars long")
