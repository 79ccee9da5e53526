"""Main text of web pages by composite text density.

Every element gets its characters per tag, lowered for characters and tags in links. The element whose children
have the largest sum of densities is the centre of the page; the least density on its path up to the body is
the threshold. From the body down, every element at or above the threshold contributes its subtree of maximum density sum.

Sparser parts (titles, leads, short sections) come with it: of every article element that holds a chosen subtree, all is returned, and of
the main element around the centre if no article is. Without either, the highest element around the centre in which no
other block of blocks is dense gives every block that is not mostly links. Headings beside a chosen subtree are returned, too.

Elements that are boilerplate by their tag or role (menus, footers, forms) are left out before densities are computed. So are those whose
class name or id is made of the words of NAMES, unless they hold the article or, but for words such as comments and adverts, text that is
dense and poor in links (see _cut_named). A page is read in one pass inside a task; pages are never shuffled.
"""

import html
import re
from collections import Counter
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import binary, bound_batches, text_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rb rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
LEFT_OUT = frozenset(
    "head title script style noscript template nav footer aside form button input select option textarea menu dialog iframe object embed "
    "applet canvas svg math audio video map frameset noframes datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# what class names and ids of boilerplate are made of
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer footnav masthead toolbar pagination pager comment comments commentlist respond reply replies disqus discussion "
    "share sharing social related recommended recommendations skip skiplink hidden".split()
)
# names of what is never part of an article, however long it is
FIRM = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr popup modal newsletter subscribe signup login "
    "breadcrumb breadcrumbs footer footnav pagination pager comment comments commentlist respond reply replies disqus skiplink hidden".split()
)
# names that parts of an article may have as well
OPEN = frozenset(
    "notice notices overlay subscription widget widgets promotion social share sharing related recommended recommendations discussion consent skip".split()
)
# words that leave the meaning of a name beside them as it is
NEUTRAL = frozenset(
    "area list box block section container wrap wrapper item items link links bar form button buttons icon icons title row inner text left right top "
    "bottom primary secondary site post posts entry stories thread wp count".split()
)
PARTIAL, OPEN_NAME, LAYOUT_NAME, FIRM_PART, FIRM_NAME = 1, 2, 3, 4, 5
# a start tag of the key ends an open element of these tags, up to the nearest element of the bounds
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPE = frozenset("table td th caption button html body".split())

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _name_of(token: str) -> int:
    """What a class name or id says: 0 nothing, FIRM_PART or PARTIAL if only a part of it is a name of boilerplate, else the firmest of its names."""
    parts = {p.lower() for p in PARTS.findall(token)}
    names = parts & NAMES
    if not names:
        return 0
    if parts - names - NEUTRAL:
        return FIRM_PART if names & FIRM else PARTIAL
    return FIRM_NAME if names & FIRM else LAYOUT_NAME if names - OPEN else OPEN_NAME


def _boilerplate(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is boilerplate whatever it holds, and what its names say."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return True, 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, 0
    found = {}
    for name, value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True, 0
    if found.get("role", "").lower() in ROLES:
        return True, 0
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    return False, max(map(_name_of, names), default=0)


class _Page:
    """Elements in page order: parents come before children, and a subtree is a run of elements."""

    def __init__(self, source: str):
        self.tags, self.parents, self.ends, self.out, self.own = ["#page"], [0], [0], [False], [0]
        self.named, self.inside = [0], [False]  # what names say, and whether an article or main is around
        self.pieces = []  # (element, text) and (element, None) at the edge of a block
        self.stack = [0]
        self.open = Counter()  # elements on the stack by tag, so that stray tags need no walk
        self._read(source)
        self._pop_to(0)
        self.ends[0] = len(self.tags)
        if any(self.named):
            self._cut_named()

    def _pop_to(self, depth: int):
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            self.open[self.tags[node]] -= 1
            self.ends[node] = len(self.tags)
            if self.tags[node] not in INLINE:
                self.pieces.append((node, None))

    def _text(self, raw: str):
        if raw:
            self.pieces.append((self.stack[-1], html.unescape(raw) if "&" in raw else raw))

    def _open(self, tag: str, attributes: str):
        stack, tags = self.stack, self.tags
        if tag in ("html", "body") and self.open[tag]:
            return
        closes, bounds = ({"p"}, SCOPE) if tag in CLOSE_P else ENDS.get(tag, ((), ()))
        if any(self.open[c] for c in closes):
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] in closes:
                    self._pop_to(depth - 1)
                    break
                if tags[stack[depth]] in bounds:
                    break
        parent = stack[-1]
        node = len(tags)
        in_article = self.inside[parent] or tags[parent] in ("article", "main")
        tags.append(tag)
        self.parents.append(parent)
        self.ends.append(node + 1)
        out, named = _boilerplate(tag, attributes, in_article)
        self.out.append(self.out[parent] or out)
        self.named.append(named)
        self.inside.append(in_article)
        if tag not in INLINE:
            self.pieces.append((node, None))
        if tag not in VOID:
            stack.append(node)
            self.open[tag] += 1

    def _close(self, tag: str):
        if not self.open[tag]:
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == tag:
                self._pop_to(depth - 1)
                return
            if self.tags[self.stack[depth]] in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "table", "div", "body", "html"):
                return

    def _read(self, source: str):
        at = 0
        while True:
            found = TAG.search(source, at)
            if not found:
                break
            self._text(source[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if not name:
                continue
            tag = name.lower()
            if found[1] or found[4]:
                self._close(tag)
                continue
            attributes = found[3] if found[2] else found[6]
            self._open(tag, attributes)
            if tag in RAW and not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                self._text(source[at : end.start()] if end else source[at:])
                at = end.start() if end else len(source)
        self._text(source[at:])

    def _counts(self) -> tuple[list[int], list[int], list[int], list[int], int]:
        """Of every element its characters, those in links, its tags and links, and which element is the body."""
        n = len(self.tags)
        chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        for node in range(1, n):
            in_link[node] = self.tags[node] == "a" or in_link[self.parents[node]]
        for node, text in self.pieces:
            if text and not self.out[node]:
                size = len("".join(text.split()))
                chars[node] += size
                if in_link[node]:
                    links[node] += size
        for node in range(n - 1, 0, -1):
            if not self.out[node]:
                parent = self.parents[node]
                chars[parent] += chars[node]
                links[parent] += links[node]
                tags[parent] += tags[node] + 1
                link_tags[parent] += link_tags[node] + (self.tags[node] == "a")
        body = next((i for i, t in enumerate(self.tags) if t == "body"), 0)
        if not chars[body]:
            body = 0
        return chars, links, tags, link_tags, body

    def _cut_named(self):
        """Leave out what its names call boilerplate, unless what it holds tells otherwise."""
        n = len(self.tags)
        chars, links, tags, _, body = self._counts()
        plain = [c - x for c, x in zip(chars, links)]
        articles, mains = [0] * n, [0] * n  # inside each
        for node in range(n - 1, 0, -1):
            if not self.out[node] and chars[node]:
                parent = self.parents[node]
                articles[parent] += articles[node] + (self.tags[node] == "article")
                mains[parent] += mains[node] + (self.tags[node] == "main")

        def is_cut(node: int) -> bool:
            named, light = self.named[node], 2 * links[node] <= chars[node]
            most = 2 * plain[node] > plain[body]
            # as many characters per tag as a half of the page's, a quarter inside an article
            share = 4 if self.inside[node] else 2
            dense = share * chars[node] * max(tags[body], 1) >= chars[body] * max(tags[node], 1)
            if mains[node] or articles[node] and (named == PARTIAL or named < FIRM_NAME and most or articles[node] == articles[0]):
                return False
            if self.tags[node] in HEADINGS:
                return named in (LAYOUT_NAME, FIRM_NAME)
            if named == FIRM_PART:
                return not most
            if named == PARTIAL:
                return not most and not (light and (dense or self.inside[node]))
            if named == OPEN_NAME:
                return not (light and dense)
            return named == FIRM_NAME or not (light and most)

        for node in range(1, n):
            self.out[node] = self.out[node] or self.out[self.parents[node]] or self.named[node] > 0 and is_cut(node)

    def _enclosing(self, tag: str) -> list[int]:
        """For every element the outermost of this tag around it, itself included; 0 if there is none."""
        found = [0] * len(self.tags)
        for node in range(1, len(found)):
            found[node] = found[self.parents[node]] or (node if self.tags[node] == tag else 0)
        return found

    def _root(self, top: int, body: int, candidate: list[bool], total: list[float]) -> int:
        """The highest element around the centre in which no other block of blocks is dense."""
        before = [0]  # such blocks among the elements before each
        for node in range(len(self.tags)):
            before.append(before[-1] + (candidate[node] and total[node] > 0.0))
        node = top
        while node != body and node:
            parent = self.parents[node]
            if before[node] - before[parent + 1] or before[self.ends[parent]] - before[self.ends[node]]:
                break
            node = parent
        return node

    def _light(self, root: int) -> list[bool]:
        """Which elements below the root stand in a block whose own text is not mostly links."""
        n = len(self.tags)
        block, in_link, own, linked = list(range(n)), [False] * n, [0] * n, [0] * n
        for node in range(root + 1, self.ends[root]):
            parent = self.parents[node]
            in_link[node] = self.tags[node] == "a" or in_link[parent]
            if self.tags[node] in INLINE:
                block[node] = block[parent]
        for node, text in self.pieces:
            if text and root <= node < self.ends[root] and not self.out[node]:
                size = len("".join(text.split()))
                own[block[node]] += size
                linked[block[node]] += size * in_link[node]
        return [root <= b < self.ends[root] and 2 * linked[b] <= own[b] for b in block]

    def content(self) -> list[bool]:
        """Which elements belong to the article."""
        n = len(self.tags)
        chars, links, tags, link_tags, body = self._counts()
        link_share = links[body] / max(chars[body], 1)
        density = [0.0] * n
        for node in range(n):
            c, lc, t, lt = chars[node], links[node], max(tags[node], 1), max(link_tags[node], 1)
            if c and not self.out[node]:
                base = log(c / max(c - lc, 1) * lc + link_share * c + e)
                inside = max(c / max(lc, 1) * t / lt, 1.0)
                density[node] = c / t * (log(inside) / log(base) if base > 1.0 else log(inside))
        # phrases belong to the block they stand in: only blocks add to a sum and can be chosen
        total = [0.0] * n
        for node in range(1, n):
            if self.tags[node] not in INLINE:
                total[self.parents[node]] += density[node]
        best = list(range(n))
        for node in range(n - 1, 0, -1):
            parent = self.parents[node]
            if not self.out[node] and total[best[node]] > total[best[parent]]:
                best[parent] = best[node]
        top = best[body]
        least, node = density[top], top
        while node != body and node:
            node = self.parents[node]
            least = min(least, density[node])
        candidate = [False] * n
        chosen = [False] * n
        for node in range(body, self.ends[body]):
            if not self.out[node] and chars[node] and density[node] >= least and self.tags[node] not in INLINE:
                candidate[node] = True
                chosen[best[node]] = True
        # parts that are less dense belong to the article, too: an article that holds a chosen element comes whole
        around, main = self._enclosing("article"), self._enclosing("main")[top]
        for node in range(n):
            if chosen[node]:
                chosen[around[node] or node] = True
        light = [False] * n
        if main and not around[top]:
            chosen[main] = True
        elif not around[top]:
            light = self._light(self._root(top, body, candidate, total))
        beside = {self.parents[node] for node in range(1, n) if chosen[node]}
        for node in range(1, n):
            if self.tags[node] in HEADINGS and self.parents[node] in beside and 2 * links[node] <= chars[node]:
                chosen[node] = True
        for node in range(1, n):
            chosen[node] = chosen[node] or chosen[self.parents[node]]
        chosen = [c or x for c, x in zip(chosen, light)]
        return chosen

    def text(self) -> str:
        chosen = self.content()
        blocks, block = [], []
        for node, piece in self.pieces:
            if piece is None or self.tags[node] == "br":
                blocks.append("".join(block))
                block = []
            elif chosen[node] and not self.out[node]:
                block.append(piece)
        blocks.append("".join(block))
        return " ".join(" ".join(blocks).split())


def article_text(raw: bytes | None) -> str:
    """The main text of one page; empty for null and empty pages."""
    return _Page(raw.decode("utf-8")).text() if raw else ""


def extract_articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but its html, then ``text`` and ``n_chars`` (its code points), which replace columns of those names.

    Character references are decoded, white space inside a block becomes one space, and blocks follow in page order, joined by
    one space. Null, empty and blank pages, and pages of boilerplate alone, have an empty text. Unclosed and
    misplaced tags are read as browsers do for the common cases. Repeated rows and rows without an id are read like others.
    """
    bound_batches(pages.sparkSession)
    rows = text_rows(pages, id_col, html_col)
    schema = T.StructType([T.StructField("_id", T.LongType()), rows.schema["_rest"], T.StructField("_main", T.StringType())])

    def read(batches):
        for batch in batches:
            texts = [article_text(p) for p in binary(batch["_text"])]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_rest"], pa.array(texts, pa.string())], schema.names)

    out = rows.mapInArrow(read, schema)
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kind = pages.schema[id_col].dataType
    columns = [F.col("_id").cast(kind).alias(c) if c == id_col else F.col("_rest").getField(c).alias(c) for c in names]
    return out.select(*columns, F.col("_main").alias("text"), F.length("_main").cast("long").alias("n_chars"))
