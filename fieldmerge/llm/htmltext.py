"""Main text of web pages by tag-path ratios.

Blocks of text are gathered by their path of tags from the root. A path's ratios are its text and its punctuation
per block; smoothed along the page, multiplied and cut at a threshold they tell which paths carry the content, and the
smallest element around these is the article. Its blocks are the result, less those in elements that mark themselves as
something else. Within an article a name alone is a mark only where the ratios of what it names are weak beside the content's.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Neighbouring paths count with these weights; a path is content if its fused ratio is at least CUT standard deviations.
KERNEL, CUT = (0.25, 0.5, 0.25), 0.5
#: Ratios below this part of the content's: within an article, a name that may be its subject is a mark only on such text.
WEAK = 0.25
#: Text right in an element around the content is content too if its ratios reach this part of the content's.
LIKE = 0.1

# Elements and names of the HTML standard and of common page templates.
RAW = frozenset("script style template noscript textarea title svg math iframe object audio video canvas select option".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot ul ol dl pre blockquote figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
LEFT_OUT_TAGS = frozenset("nav footer aside form button dialog menu head".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot adbox banner banners breadcrumb breadcrumbs comment comments comentarios commentaires kommentare"
    " consent cookie cookies disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination"
    " popup privacy promo promotion related recommended recommendations replies respond share sharing sidebar sidebars signup social sponsor sponsored sponsors"
    " subscribe subscription teaser toolbar topbar widget widgets".split()
)

#: How an element is left out; a mark doesn't hold on an element with a main element or more than this part of the page's content.
NO, MARK, SURE, MOST = 0, 1, 2, 0.5
COMMENT_NAMES = frozenset("comment comments comentarios commentaires kommentare disqus replies respond feedback discussion guestbook reactions userposts".split())
#: Names that tell what an element is wherever it stands, alone or with another word.
PLAIN_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements adsense adslot adbox breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead nav navbar sidebar sidebars".split())
COMPANIONS = frozenset("articles bar box buttons content form icons links list media news popup post posts stories wrapper".split())
#: A single article needs no more than this part of the content, or the page's h1.
LONE = 0.1
TITLE_NAMES = frozenset("article entry post story".split())
#: A name such as with-sidebar or no-comments tells what its element holds or lacks, not what it is.
QUALIFIERS = frozenset("no not without with has".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、—¿¡»«]")


def _left_out(tag: str, attributes: str, in_article: bool) -> tuple[int, str]:
    """How an element marks itself as something other than the article (NO, by a MARK of its name or as a form, SURE by
    other tags and roles), and its name in a path."""
    names: list[str] = []
    if attributes.strip():
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                for name in value.split():
                    parts = re.split(r"[^a-z]+", name)
                    names += parts if QUALIFIERS.isdisjoint(parts) else ["-".join(parts)]
                    if {"user", "posts"} <= set(parts):
                        names.append("userposts")
            elif key == "role" and value in LEFT_OUT_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return SURE, tag
    if tag in LEFT_OUT_TAGS and tag != "form" or tag == "header" and not in_article:
        out = SURE
    else:
        out = MARK if tag == "form" or tag not in ("html", "body", "article", "main") and not (LEFT_OUT_NAMES | COMMENT_NAMES).isdisjoint(names) else NO
    return out, ".".join([tag, *sorted({n for n in names if n})])


class _Page:
    """A page's text blocks, its tag paths and its marked elements. Paths and marks are numbered after their parents (-1: none),
    so what holds for an element or for all within it is found in one pass over the numbers."""

    def __init__(self) -> None:
        self.blocks: list[tuple[int, str, int, bool]] = []  # path, text, innermost mark, surely left out
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.number: dict[tuple[int, str], int] = {}
        self.mark_parent: list[int] = []
        self.comments, self.heads, self.subjects = set(), set(), set()  # marks: of comments, of an article's head, names within an article
        self.lifted, self.holders = set(), set()  # marks with a main element, with an article

    def path(self, parent: int, name: str) -> int:
        found = self.number.setdefault((parent, name), len(self.parent))
        if found == len(self.parent):
            self.parent.append(parent)
            self.tag.append(name.split(".")[0])
        return found

    def within(self, tags: set[str]) -> list[bool]:
        """For each path, whether an element of these tags is on it."""
        out: list[bool] = []
        for parent, tag in zip(self.parent, self.tag, strict=True):
            out.append(tag in tags or parent >= 0 and out[parent])
        return out

    def below(self, path: int) -> list[bool]:
        out: list[bool] = []
        for i, parent in enumerate(self.parent):
            out.append(i == path or path < 0 or parent >= 0 and out[parent])
        return out


def _up(values: list[list[float]], parents: list[int]) -> None:
    """Add each number's values to its parent's, from the last on."""
    for i in range(len(parents) - 1, -1, -1):
        if parents[i] >= 0:
            for k, v in enumerate(values[i]):
                values[parents[i]][k] += v


def _spread(marks: set[int], mark: int, parents: list[int]) -> None:
    """Add a mark and those around it."""
    while mark >= 0 and mark not in marks:
        marks.add(mark)
        mark = parents[mark]


def _read(page: str) -> _Page:
    """The page's blocks in order. Text is decoded, its white space single spaces."""
    out = _Page()
    path: list[tuple[str, int, int, bool]] = []  # tag, path, innermost mark, surely left out
    open_: dict[str, int] = {}
    text: list[str] = []
    at = 0

    def flush():
        if text:
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                out.blocks.append((path[-1][1], whole, *path[-1][2:]) if path else (out.path(-1, ""), whole, -1, False))

    def close(i: int) -> None:
        for tag, *_ in path[i:]:
            open_[tag] -= 1
        del path[i:]

    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            text.append(entities.unescape(page[at:]))
            flush()
            return out
        if token.start() > at:
            text.append(entities.unescape(page[at : token.start()]))
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), token[1] or token[4], token[3] or token[6] or ""
        if closing:
            if tag in INLINE:
                continue
            flush()
            if open_.get(tag):
                close(next(i for i in range(len(path) - 1, -1, -1) if path[i][0] == tag))
            continue
        if tag in RAW:
            if tag not in ("select", "option"):
                flush()
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        ends = {"p"} if tag not in CLOSED_BY else CLOSED_BY[tag] | {"p"}
        if any(open_.get(t) for t in ends):
            for i in range(len(path) - 1, -1, -1):
                if path[i][0] in ends:
                    close(i)
                    break
                if path[i][0] not in LEAF or path[i][0] in ("ul", "ol", "dl", "tbody", "thead", "tfoot"):
                    break
        if tag == "body" and open_.get("head"):
            close(next(i for i, p in enumerate(path) if p[0] == "head"))
        inside = bool(open_.get("article") or open_.get("main"))
        left, name = _left_out(tag, attributes, inside)
        _, above, mark, sure = path[-1] if path else ("", -1, -1, False)
        if tag == "main" and not sure:
            _spread(out.lifted, mark, out.mark_parent)
        if tag == "article" and not sure:
            _spread(out.holders, mark, out.mark_parent)
        if left == MARK:
            names = set(name.split(".")[1:])
            listed = names & (LEFT_OUT_NAMES | COMMENT_NAMES)
            out.mark_parent.append(mark)
            mark = len(out.mark_parent) - 1
            if listed & COMMENT_NAMES:
                out.comments.add(mark)
            elif listed == {"header"} and (names & TITLE_NAMES or inside):
                out.heads.add(mark)
            if inside and listed and not listed & (PLAIN_NAMES | COMMENT_NAMES) and not names & COMPANIONS:
                out.subjects.add(mark)
        path.append((tag, out.path(above, name), mark, sure or left == SURE))
        open_[tag] = open_.get(tag, 0) + 1


def _ratio(text: float, signs: float, blocks: float) -> float:
    """Text a block, more for its punctuation."""
    return text / blocks * (1 + signs / blocks) if blocks else 0.0


def _kept(page: _Page) -> list[tuple[int, str]]:
    """(path, text) of the blocks that aren't left out, surely or by a mark that holds. A mark doesn't hold on an element with a
    main element or more than MOST of the text in content paths outside of comments (on a page with an unmarked article: one
    that holds an article), a name within an article not on text whose ratios aren't WEAK beside the content's, and that of
    an article's head not on its h1."""
    parents, lifted = page.mark_parent, set(page.lifted)

    def chain(holds) -> list[bool]:
        """For each mark, whether one that holds is at it or around it; the last is for none."""
        out: list[bool] = []
        for m, parent in enumerate(parents):
            out.append(holds(m) or parent >= 0 and out[parent])
        return [*out, False]

    if parents:
        comment = chain(lambda m: m in page.comments and m not in lifted)
        rest = [(path, text, mark) for path, text, mark, sure in page.blocks if not sure and not comment[mark]]
        if rest and any(mark >= 0 for _, _, mark in rest):
            content = set(content_paths([(path, text) for path, text, _ in rest]))
            sums = [[0.0] * 4 for _ in parents]  # text in content paths, text, punctuation, blocks
            whole, main = [0.0] * 4, [0.0] * 3
            marked, in_article = chain(lambda m: m not in lifted), page.within({"article", "main"})
            plain = False
            for path, text, mark in rest:
                own = [len(text) if path in content else 0, len(text), len(_PUNCTUATION.findall(text)), 1]
                for k, v in enumerate(own):
                    whole[k] += v
                    if mark >= 0:
                        sums[mark][k] += v
                if path in content and not marked[mark]:
                    main = [x + v for x, v in zip(main, own[1:], strict=True)]
                    plain = plain or in_article[path]
            _up(sums, parents)
            plain = plain or any(in_article[path] and not marked[mark] for path, _, mark in rest)
            lifted |= {m for m, s in enumerate(sums) if s[0] > MOST * whole[0] and (m in page.holders or not plain)}
            lifted |= {m for m in page.subjects if _ratio(*sums[m][1:]) >= WEAK * _ratio(*main) > 0}
    out = chain(lambda m: m not in lifted)
    headed = chain(lambda m: m not in lifted and m not in page.heads)
    return [(path, text) for path, text, mark, sure in page.blocks if not sure and not (headed if page.tag[path] == "h1" else out)[mark]]


def _sums(kept: list[tuple[int, str]]) -> dict[int, list[int]]:
    """Text, punctuation and blocks of each path, in order of its first block."""
    order: dict[int, list[int]] = {}
    for path, text in kept:
        sums = order.setdefault(path, [0, 0, 0])
        sums[0] += len(text)
        sums[1] += len(_PUNCTUATION.findall(text))
        sums[2] += 1
    return order


def content_paths(kept: list[tuple[int, str]]) -> list[int]:
    """The paths whose smoothed, fused ratios reach the threshold, in order of their first block."""
    order = _sums(kept)
    sums = np.array(list(order.values()), float)
    ratios = sums[:, :2] / sums[:, 2:]
    padded = np.pad(ratios, ((1, 1), (0, 0)), mode="edge")
    smooth = sum(w * padded[i : i + len(ratios)] for i, w in enumerate(KERNEL))
    fused = smooth[:, 0] * (1 + smooth[:, 1]) * sums[:, 0] / sums[:, 0].sum()
    return [p for p, f in zip(order, fused, strict=True) if f >= min(CUT * fused.std(), fused.max())]


def _root(page: _Page, kept: list[tuple[int, str]]) -> int:
    """The path of the smallest element around the content: the deepest with nearly all of its text; an article or main
    element needs half of it only, and a single one LONE or the h1."""
    chosen = set(content_paths(kept))
    weight = [[0.0] for _ in page.parent]
    for path, text in kept:
        if path in chosen:
            weight[path][0] += len(text)
    total = sum(w[0] for w in weight)
    _up(weight, page.parent)
    depth: list[int] = []
    for parent in page.parent:
        depth.append(depth[parent] + 1 if parent >= 0 else 0)
    root = max((p for p, w in enumerate(weight) if w[0] >= 0.9 * total), key=lambda p: depth[p], default=-1)
    articles = [p for p, tag in enumerate(page.tag) if tag in ("article", "main")]
    named = [p for p in articles if weight[p][0] >= 0.5 * total]
    if named:
        root = min(named, key=lambda p: depth[p])
    elif articles:
        inside = page.within({"article", "main"})
        outer = [p for p in articles if page.parent[p] < 0 or not inside[page.parent[p]]]
        heads = page.within({"h1"})
        own = page.below(outer[0])
        if len(outer) == 1 and any(own[p] for p, _ in kept) and (weight[outer[0]][0] >= LONE * total or any(own[p] and heads[p] for p, _ in kept)):
            root = outer[0]
    # text that stands right in an element around it, headings aside, with ratios like the content's, is content as well
    container: list[int] = []
    for p, tag in enumerate(page.tag):
        container.append(p if tag not in LEAF or page.parent[p] < 0 else container[page.parent[p]])
    sums = {path: s for path, s in _sums(kept).items() if page.tag[path] not in HEADINGS}
    main = [sum(x) for x in zip(*(s for path, s in sums.items() if path in chosen), strict=True)] or [0.0] * 3
    like = {container[path] for path, s in sums.items() if _ratio(*s) >= LIKE * _ratio(*main)}
    found = root = container[root] if root >= 0 else root
    while root >= 0 and page.tag[root] not in ("article", "main"):
        root = page.parent[root]
        if root in like:
            found = root
    return found


def main_text(page: str) -> str:
    """The text of the page's article, or the empty string."""
    read = _read(page)
    kept = _kept(read)
    if not kept:
        return ""
    inside, heads = read.below(_root(read, kept)), read.within({"h1"})
    titled = any(inside[path] and heads[path] for path, _ in kept)
    return " ".join(text for path, text in kept if inside[path] or not titled and read.tag[path] == "h1")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for each row of pages (page_id, url, html); null html has empty text.

    Markup without text, and pages all of whose text is surely something else (nav, footer, ...), give the empty text. Broken markup
    is read as far as it goes; a page is worked on whole, by itself. An empty table gives no rows."""

    def read(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                own = b.slice(i, 500)
                texts = [main_text(x or "") for x in own.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
