"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at its block-level tags. The first pass decides blocks by their stop-word density, length and
link density, and by where they stand: menus, footers, forms and the like are named by elements, roles and class names.
The second pass lets short and middling blocks inherit from the nearest decided neighbours, and headings from what they
stand above. A page is one row of one task; nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import sub_batches

#: Blocks under LOW characters are short, those over HIGH are long.
LOW, HIGH = 70, 200
#: Shares of stop words from which a block may be, and is, prose.
STOP_LOW, STOP_HIGH = 0.08, 0.20
#: Greatest share of characters in links, outside of an article element and in it.
LINKS, LINKS_INSIDE = 0.2, 0.5
#: So many characters lie between a heading and the text that it heads, at most.
HEADING_REACH = 200
#: A page with a smaller share of stop words is in none of their languages: only length and links decide there.
KNOWN_LANGUAGE = 0.04
#: Common function words.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you we "  # English
    "der die das und ist von den mit sich des auf für ein eine dem nicht im zu es auch an als bei sind wird "  # German
    "le la les des et est en que un une du dans qui par pour au sur pas plus ne se ce son avec il elle "  # French
    "el los las y del que se por con para una su al lo como más pero sus ha este es no "  # Spanish
    "di che il per non sono della i del con una si da o os as um uma dos das em não het een van te dat op zijn voor met".split())  # Italian, Portuguese, Dutch

# Elements of HTML by what they do to the text.
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes noscript object script style svg template textarea title xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = _BLOCKS - _HEADINGS - {"p", "hr", "caption", "legend", "summary", "option", "optgroup"}
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_NOT_TEXT = frozenset("nav footer aside button select dialog menu search".split())
_ROLES_NOT_TEXT = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
# Words of class names and ids that tell what is not the article.
_NOT_TEXT_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar topbar trending widget widgets".split())
_COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
_COMMENT_PARTS = frozenset("area block body box container item list node post reader section the thread user wrap wrapper".split())
_NEGATIONS = frozenset("no not without has with".split())
_COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))\b\W*(?:\(?\d+\)?)?\W*", re.I)

_START = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|(!--)|[!?/])")
_STOPPER = re.compile(r"[>\"']")
_VALUE = re.compile(r"=\s*$")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|$)", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    heading: int  # level, 0 for none
    main: int  # number of the article or main element around, 0 for none
    parent: int  # number of the innermost container
    doubt: int  # 2: not the article by its elements; 1: by a form, class name or place; 0: no sign of it
    tree: list[int] = field(repr=False, compare=False, default_factory=list)  # of each container the one around it, -1 for the page's own


@dataclass
class _Open:
    name: str
    number: int
    main: int
    doubt: int
    level: int = 0  # of a heading that says that comments follow


@lru_cache(4096)
def _doubt_of_names(names: str, whole: bool = False) -> int:
    """2 for names of comments, 1 for others that aren't the article's; ``whole`` asks for whole names, not for their parts."""
    doubt = 0
    for name in names.split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if _COMMENT_WORDS & set(words) and set(words) <= _COMMENT_WORDS | _COMMENT_PARTS:
            return 2
        found = any(w in _NOT_TEXT_WORDS and (k == 0 or words[k - 1] not in _NEGATIONS) for k, w in enumerate(words))
        doubt = max(doubt, int((found or "site" in words and "header" in words) and not (whole and len(words) > 1)))
    return doubt


@lru_cache(4096)
def _attributes(tag: str, whole: bool = False) -> tuple[int, bool]:
    """(doubt, the role is main) of a start tag's attributes."""
    doubt, main = 0, False
    for m in _ATTRIBUTE.finditer(tag):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            doubt = max(doubt, _doubt_of_names(value, whole))
        elif name == "hidden" and value.lower() != "until-found" or name == "role" and value.lower() in _ROLES_NOT_TEXT or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            doubt = 2
        elif name == "role":
            main = main or value.lower() == "main"
    return doubt, main


def _plain(text: str) -> str:
    """With character references decoded and white space as single blanks."""
    return " ".join((entities.unescape(text) if "&" in text else text).split())


@dataclass
class _Reader:
    """Cuts a page into blocks; time and memory are in proportion to its length."""

    page: str
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", 0, 0, 0)])
    opened: dict[str, int] = field(default_factory=dict)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    absent: set[str] = field(default_factory=set)
    number: int = 0
    link: bool = False
    heading: int = 0
    own_doubt: int = 0
    breaks: int = 0
    tree: list[int] = field(default_factory=lambda: [-1])

    def read(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            m = _START.search(page, at)
            self._text(page[at : m.start() if m else len(page)])
            if not m:
                break
            if m[3]:
                at = self._comment(m.end())
            elif not m[2]:
                at = self._find(">", m.end()) + 1 or len(page)
            else:
                end = self._tag_end(m.end())
                if end < 0:
                    break
                name = m[2].lower()
                at = end + 1
                if m[1]:
                    self._closes(name)
                elif name in _RAW and (ended := self._raw_end(name, at)) is not None:
                    at = ended
                else:
                    self._opens(name, page[m.end() : end])
        self._flush()
        return self.blocks

    def _find(self, what: str, at: int) -> int:
        """Where ``what`` comes next, -1 if no more; it is looked for in vain once only."""
        if what in self.absent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _comment(self, at: int) -> int:
        if self.page.startswith(">", at) or self.page.startswith("->", at):
            return self.page.index(">", at) + 1
        end = self._find("-->", at)
        return end + 3 if end >= 0 else len(self.page)

    def _tag_end(self, at: int) -> int:
        """Where the tag's > is; one inside a quoted value isn't it."""
        page, k = self.page, at
        near = page.find(">", at, at + 512)
        if near >= 0 and page.count('"', at, near) % 2 == 0 and page.find("'", at, near) < 0:
            return near
        while True:
            m = _STOPPER.search(page, k)
            if not m:
                return -1
            if m[0] == ">":
                return m.start()
            end = self._find(m[0], m.end()) if _VALUE.search(page, max(at, m.start() - 64), m.start()) else -1
            k = end + 1 if end >= 0 else m.end()

    def _raw_end(self, name: str, at: int) -> int | None:
        """Where the text goes on behind an element whose content is no text of the page."""
        m = None if name in self.absent else _RAW_END[name].search(self.page, at)
        if m:
            return m.end()
        self.absent.add(name)
        return len(self.page) if name in ("script", "style") else None

    def _text(self, text: str) -> None:
        if text:
            self.parts.append((text, self.link))
            if self.breaks and not text.isspace():
                self.breaks = 0

    def _flush(self) -> None:
        if self.parts:
            whole = _plain("".join([t for t, _ in self.parts]))
            linked = "".join([t for t, in_link in self.parts if in_link])
            linked = len(_plain(linked)) if linked else 0
            if whole:
                top = self.stack[-1]
                self._comments_follow(whole)
                self.blocks.append(Block(whole, linked, self.heading, top.main, top.number, max(top.doubt, self.own_doubt, int(top.level > 0)), self.tree))
            self.parts = []
        self.breaks = 0

    def _comments_follow(self, text: str) -> None:
        """A heading that says so puts what follows it in its container in doubt, up to a heading of its level."""
        top = self.stack[-1]
        if self.heading:
            if _COMMENTS.fullmatch(text[:80]):
                top.level = self.heading
            elif self.heading <= top.level:
                top.level = 0

    def _opens(self, name: str, tag: str) -> None:
        if name == "a":
            self.link = True
        elif name == "br":
            self.breaks += 1
            self._flush() if self.breaks > 1 else self.parts.append((" ", False))
        if name not in _BLOCKS:
            return
        self._flush()
        self.heading, self.own_doubt = (int(name[1]) if name in _HEADINGS else 0), 0
        doubt, is_main = _attributes(tag, name in ("article", "main")) if tag.strip() else (0, False)
        if name not in _CONTAINERS:
            self.own_doubt = doubt
            return
        for open_name in _ENDED_BY.get(name, ()):
            while self.stack[-1].name == open_name:
                self._pop()
        top = self.stack[-1]
        main, self.number = top.main, self.number + 1
        if name in ("html", "body"):
            doubt = 0
        elif name in ("article", "main") or is_main:
            nested = name == "article" and any(o.name == "article" for o in self.stack[-64:])
            doubt = max(doubt, int(nested))
            main = main or self.number
        elif name in _NOT_TEXT or name == "header" and not top.main:
            doubt = 2
        elif name == "form":
            doubt = max(doubt, 1)
        inherited = max(top.doubt, int(top.level > 0))
        # What a wrapper's class name says doesn't hold for an article in it.
        inherited = 0 if inherited == 1 and main and not top.main and not doubt else inherited
        self.tree.append(-1 if name in ("html", "body") else top.number)
        self.stack.append(_Open(name, self.number, main, max(doubt, inherited)))
        self.opened[name] = self.opened.get(name, 0) + 1

    def _pop(self) -> None:
        self.opened[self.stack.pop().name] -= 1
        self.link = False

    def _closes(self, name: str) -> None:
        if name == "a":
            self.link = False
        elif name == "br":
            self._opens(name, "")
        if name not in _BLOCKS:
            return
        self._flush()
        self.heading, self.own_doubt = 0, 0
        if self.opened.get(name):
            while self.stack[-1].name != name:
                self._pop()
            self._pop()


def page_blocks(page: str) -> list[Block]:
    """The blocks of text of a page in turn, without empty ones."""
    return _Reader(page).read()


def around_headline(blocks: list[Block], wide: bool = False) -> list[Block]:
    """Without an article element, the container of the first headline that has text beside it counts as one.

    ``wide``: the least container around a headline that has text in it, at any depth.
    """
    if any(b.main for b in blocks):
        return blocks
    heads = [b for b in blocks if b.heading == 1 and not b.doubt]
    plain = {b.parent for b in blocks if not (b.heading or b.linked or b.doubt)}
    if not wide:
        found = next((b.parent for b in heads if b.parent in plain), None)
        return blocks if found is None else [replace(b, main=found or -1) if b.parent == found else b for b in blocks]  # -1: in no container
    if not heads:
        return blocks
    tree, level, at = heads[0].tree, {}, heads[0].parent
    while at > 0 and tree[at] >= 0:  # not the page's own
        level[at] = len(level)
        at = tree[at]
    known: dict[int, int] = {}

    def reached(n: int) -> int:
        """How far up from the headline the first container around ``n`` and it is."""
        path = []
        while n not in known and n not in level and n > 0 and tree[n] >= 0:
            path.append(n)
            n = tree[n]
        known.update(dict.fromkeys(path, known[n] if n in known else level.get(n, len(level))))
        return known[path[0]] if path else known[n] if n in known else level.get(n, len(level))

    least = min((reached(n) for n in plain), default=len(level))
    return [replace(b, main=heads[0].parent or 1) if least < len(level) and reached(b.parent) <= least else b for b in blocks]


def outside_article(blocks: list[Block], doubts: int) -> set[int]:
    """The blocks outside of article elements, if these hold at least as much plain text as the rest, or a long block's worth."""
    inside = outside = 0
    for b in blocks:
        if b.doubt < doubts:
            plain = len(b.text) - b.linked
            inside, outside = inside + plain * bool(b.main), outside + plain * (not b.main)
    marked = inside >= outside or inside > HIGH
    return {k for k, b in enumerate(blocks) if marked and inside and not b.main}


GOOD, NEAR, SHORT, BAD = "good", "near", "short", "bad"


def first_pass(blocks: list[Block], stop_words: frozenset[str] = STOP_WORDS, doubts: int = 1) -> list[str]:
    """What each block is by itself: good, near (may be good), short, bad. Signs under ``doubts`` aren't believed."""
    asked = [_WORD.findall(b.text.lower()) if len(b.text) >= LOW and not b.main and b.doubt < doubts else [] for b in blocks]
    stops = [len([w for w in ws if w in stop_words]) for ws in asked]
    known = sum(stops) >= KNOWN_LANGUAGE * sum(map(len, asked))
    out, elsewhere = [], outside_article(blocks, doubts)
    for k, (b, ws, stop) in enumerate(zip(blocks, asked, stops)):
        size = len(b.text)
        share = stop / len(ws) if ws else 0.0
        if k in elsewhere or b.doubt >= doubts or b.linked > (LINKS_INSIDE if b.main else LINKS) * size or "©" in b.text and size < HIGH and not b.main:
            out.append(BAD)
        elif size < LOW:
            out.append(BAD if b.linked and not b.main else SHORT)
        elif b.main or not known or share >= STOP_HIGH:
            out.append(GOOD if size > HIGH else NEAR)
        else:
            out.append(NEAR if share >= STOP_LOW or size > HIGH and not b.linked else BAD)
    return out


def _decided(blocks: list[Block], kinds: list[str], order: range) -> list[int]:
    """The nearest decided block before each block in ``order``, -1 for none; in an article element, of that only."""
    out, last = [-1] * len(blocks), -1
    for k in order:
        out[k] = last if last >= 0 and (not blocks[k].main or blocks[last].main == blocks[k].main) else -1
        if kinds[k] in (GOOD, BAD):
            last = k
        elif last >= 0 and blocks[k].main != blocks[last].main and blocks[k].main:
            last = -1
    return out


def second_pass(blocks: list[Block], kinds: list[str]) -> list[bool]:
    """Which blocks are of the main text.

    Middling blocks go with a good neighbour, else with bad ones. Short blocks follow the nearest decided blocks on both sides;
    where these differ, the one in their own container. In an article element the decided blocks are those of the element, and
    without any a block is kept. A heading goes with the text that it heads.
    """
    for wanted in (NEAR, SHORT):
        before, after = _decided(blocks, kinds, range(len(blocks))), _decided(blocks, kinds, range(len(blocks) - 1, -1, -1))
        new = kinds.copy()
        for k, (b, kind) in enumerate(zip(blocks, kinds)):
            if kind != wanted:
                continue
            sides = [j for j in (before[k], after[k]) if j >= 0]
            found = {kinds[j] for j in sides}
            if not found:
                new[k] = GOOD if b.main or wanted == NEAR else BAD
            elif len(found) == 1:
                new[k] = found.pop()
                if wanted == NEAR and b.main:
                    new[k] = GOOD
            elif wanted == NEAR or b.main:
                new[k] = GOOD
            else:
                own = {kinds[j] for j in sides if blocks[j].parent == b.parent}
                new[k] = GOOD if own == {GOOD} else BAD
        settled, kinds = kinds, new
        if wanted == SHORT:
            reach = None  # characters since the last good text, going up the page
            for k in range(len(blocks) - 1, -1, -1):
                if settled[k] == SHORT and blocks[k].heading and reach is not None and reach <= HEADING_REACH:
                    kinds[k] = GOOD
                reach = 0 if kinds[k] == GOOD else None if reach is None else reach + len(blocks[k].text)
    return [k == GOOD for k in kinds]


def main_text(page: str | None, stop_words: frozenset[str] = STOP_WORDS) -> str:
    """The main text of a page, a line for each block; empty for null, empty and pages without any.

    Where nothing is left, the container around the headline is taken for the article; where that leaves nothing, class
    names, forms and nested articles are no longer believed.
    """
    blocks = page_blocks(page) if page else []
    for wide, doubts in ((False, 1), (True, 1), (False, 2)):
        around = around_headline(blocks, wide)
        kept = second_pass(around, first_pass(around, stop_words, doubts))
        if any(kept):
            return "\n".join(b.text for b, keep in zip(around, kept) if keep)
    return ""


def extract_text(pages: DataFrame, *, html: str = "html", result: str = "main_text", carry: list[str] | None = None,
                 stop_words: frozenset[str] = STOP_WORDS) -> DataFrame:
    """The columns ``carry`` (all by default) of ``pages`` and the text ``result``.

    Null and empty pages give an empty text. A very long page is read whole, in time in proportion to its length. Repeated
    rows and null keys are rows like others; no rows give none. A carried column that is named like ``result`` is replaced.
    """
    carry = [c for c in (carry or pages.columns) if c != result]
    schema = T.StructType([*(pages.schema[c] for c in carry), T.StructField(result, T.StringType())])
    own = html if html in carry else "_html"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, own):
            texts = pa.array([main_text(p, stop_words) for p in batch.column(own).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), texts], schema.names)

    return pages.select(*carry, *([] if own == html else [F.col(html).alias(own)])).mapInArrow(run, schema)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), carry=["page_id", "url"], result="text")
    return out.withColumn("n_chars", F.length("text").cast("long"))


# The given pages mark their main text by an article element, so SQL can say what the rules must find.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'), '') AS body FROM pages),
b AS (SELECT page_id, url, string_split_regex(body, '</?(?:p|h1)>') AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;?', chr(1), 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(x, chr(1), '&'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
