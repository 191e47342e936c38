"""Main text of web pages by tree scoring.

A page is read into a tree (tags, parents, text in page order; ends of paragraphs, list items and cells implied as browsers imply them).
Branches that are navigation, headers, footers, asides, notices, adverts, forms, scripts, styles, comments or hidden, by tag, role or a word of
class or id, take no part (names alone don't count against a box that holds the article, the main part or the page's h1, nor where nothing else would be left; inside an article
or main part a name counts only if it says nothing else, so "related-posts" goes and "social-history" stays; inside program text names don't count). A box whose name says readers'
comments and nothing else is none of these exceptions, whatever it holds. An article element with text is the article; of several, the one with most.
Without one, the main element is. Without either, paragraphs are scored: each earns points, 1 and one for each comma and up to 3 for length; it passes them to its ancestors, whole to
the parent, half to the next, then a third of that distance. A container's points are discounted by its link density; the best one (the first of
ties) is kept, with those siblings that score near it or read as text, and those boxes beside it or beside its ancestors that hold a part as good as half of it. There, lists and boxes
of links are left out; in an article or main part they stay.

Blocks are the text between block tags, character references decoded, white space one space, trimmed, joined by an empty line.

Results by case. Null and empty pages, and pages without text, give an empty text with 0 characters. A page is worked on whole, alone, however long; loops, not recursion, so depth is no
limit. Broken markup is read as far as it goes. Repeated rows and ids, and rows without an id, are pages each. An empty table gives no rows. Columns beyond the three are not read,
whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from decafix.llm.text import pieces

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption".split())
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "tr", "li", "dd", "dt"}
JUNK_TAGS = frozenset("head script style textarea title noscript iframe noframes template nav footer aside form button select object embed svg canvas audio video dialog menu map input label".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
JUNK_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related recommended recommendations pagination pager footer masthead toolbar widget widgets skip search copyright legal disclaimer paywall teaser teasers trending".split())
#: Of the junk words, those that don't count inside an article; and words that say nothing beside a junk word.
PART_WORDS = frozenset("legal copyright disclaimer teaser teasers".split())
NEUTRAL_WORDS = frozenset("box block list section area container wrapper wrap inner outer bar link links post posts button buttons panel item items article content top bottom left right page site module unit heading title card cards row col column group in text".split())
#: Readers' comments, and words that say nothing beside them ("comments-open" says something about the post).
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
READER_WORDS = NEUTRAL_WORDS | frozenset("reader readers user users visitor visitors body meta author thread threads form".split())
PAGE_WORDS = frozenset(["header", "topbar", "bottom"])
CONTENT_WORDS = frozenset("article post entry content story main body text".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """Nodes by number in page order, so that a parent's number is below its children's; texts as (node, text)."""

    def __init__(self) -> None:
        self.tag, self.parent, self.junk, self.items = ["#root"], [0], [0], []
        self.inside = [False]  # an article or main part
        self.code = [False]  # preformatted or program text

    def add(self, tag: str, parent: int, junk: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.junk.append(junk)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        self.code.append(self.code[parent] or tag in ("pre", "code"))
        return len(self.tag) - 1


HARD, SOFT = 1, 2


def is_junk(tag: str, attrs: str, tree: Tree, parent: int) -> int:
    """HARD by tag, role, being hidden or a name of readers' comments; SOFT by another word of class or id; else 0."""
    if tag in JUNK_TAGS:
        return HARD
    inside = tag == "header" and tree.inside[parent]
    if tag == "header" and not inside:
        return HARD
    if not attrs or tag in ("html", "body", "main"):
        return 0
    part = tag == "article" or tree.inside[parent] or tag in PARAGRAPHS or tag in HEADINGS
    if "hidden" in attrs and (re.search(r"""(^|\s)hidden(\s|$|=(?!["']?until-found))""", re.sub(r'"[^"]*"|\'[^\']*\'', '""', attrs)) or re.search(r"aria-hidden\s*=\s*[\"']?true", attrs)):
        return HARD
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.lower() in JUNK_ROLES or name == "style" and HIDDEN.search(value):
            return HARD
        if name not in ("class", "id") or tree.code[parent]:
            continue
        named = [{w.lower() for w in WORDS.findall(token)} for token in value.split()]
        if any(words & COMMENT_WORDS and words <= COMMENT_WORDS | READER_WORDS for words in named):
            return HARD
        if part:
            for words in named:
                if (said := words & JUNK_WORDS - PART_WORDS) and words <= said | NEUTRAL_WORDS:
                    return SOFT
        else:
            words = set().union(*named)
            if words & JUNK_WORDS or words & PAGE_WORDS and not words & CONTENT_WORDS and not inside:
                return SOFT
    return 0


def parse(page: str) -> Tree:
    tree, stack, at, opened = Tree(), [0], 0, Counter()

    def close(to: int) -> None:
        opened.subtract(tree.tag[i] for i in stack[to:])
        del stack[to:]
        tree.items.append((stack[-1], None))

    while at < len(page):
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            tree.items.append((stack[-1], html.unescape(text) if "&" in text else text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                tree.items.append((stack[-1], m[0][9:].removesuffix("]]>")))
            continue
        if m[1] or m[4]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[k]] == tag:
                    if tag in BLOCK or tag in PARAGRAPHS:
                        close(k)
                    else:
                        opened[tag] -= 1
                        del stack[k]
                    break
                if tag not in BLOCK and tree.tag[stack[k]] in BLOCK:
                    break  # an inline end doesn't reach out of its block
            continue
        ends = IMPLIED.get(tag, ()) if tag != "p" else ()
        scope = SCOPE.get(tag, ())
        for k in range(len(stack) - 1, 0, -1):
            own = tree.tag[stack[k]]
            if own in ends:
                close(k)
                break
            if own in scope or not ends:
                break
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                own = tree.tag[stack[k]]
                if own == "p":
                    close(k)
                    break
                if own in BLOCK or own in ("td", "th", "button"):
                    break
        parent, attrs = stack[-1], m[3] if m[2] else m[6]
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                tree.items.append((parent, None if tag == "hr" else "" if tag == "wbr" else " "))
            continue
        node = tree.add(tag, parent, is_junk(tag, attrs, tree, parent))
        if tag in BLOCK:
            tree.items.append((node, None))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not attrs.endswith("/"):
            opened[tag] += 1
            stack.append(node)
    return tree


def clean(text: str) -> str:
    return " ".join(text.split())


def main_blocks(page: str) -> list[str]:
    tree = parse(page)
    return _blocks(tree, [bool(x) for x in _spared(tree)]) or _blocks(tree, [x == HARD for x in tree.junk])


def _spared(tree: Tree) -> list[int]:
    """Junk without those boxes that are so by their names only, but hold the article, the main part or the heading of the page."""
    junk, seen = tree.junk[:], [False] * len(tree.junk)
    for i in range(1, len(junk)):
        if tree.tag[i] in ("article", "main", "h1") and not tree.junk[i]:
            at = tree.parent[i]
            while at and not seen[at]:
                seen[at] = True
                if junk[at] == SOFT:
                    junk[at] = 0
                at = tree.parent[at]
    return junk


def _blocks(tree: Tree, junk: list[bool]) -> list[str]:
    n, tag, parent = len(tree.tag), tree.tag, tree.parent
    link = [False] * n
    for i in range(1, n):
        junk[i] = junk[i] or junk[parent[i]]
        link[i] = link[parent[i]] or tag[i] == "a"
    size, linked, commas = [0] * n, [0] * n, [0] * n
    for i, text in tree.items:
        if text and not junk[i] and (length := len(clean(text))):
            size[i] += length
            linked[i] += length * link[i]
            commas[i] += text.count(",") + text.count("、") + text.count("，")
    own = [size[i] - linked[i] for i in range(n)]
    inner, inner_commas = own[:], commas[:]  # text of a node and its inline descendants
    for i in range(n - 1, 0, -1):
        p = parent[i]
        size[p] += size[i]
        linked[p] += linked[i]
        if tag[i] not in BLOCK and tag[i] not in PARAGRAPHS:
            inner[p] += inner[i]
            inner_commas[p] += inner_commas[i]
    points = [0.0] * n
    for i in range(1, n):
        if not junk[i] and inner[i] >= 1 and (tag[i] in PARAGRAPHS or tag[i] in BLOCK and tag[i] not in HEADINGS and own[i] >= 25):
            score, at, level = 1 + inner_commas[i] + min(inner[i] // 100, 3), parent[i] if tag[i] in PARAGRAPHS else i, 0
            while level < 6:
                points[at] += score / (1 if not level else 2 if level == 1 else 3 * level)
                if not at:
                    break
                at, level = parent[at], level + 1
    density = [linked[i] / size[i] if size[i] else 0.0 for i in range(n)]
    points = [p * (1 - d) for p, d in zip(points, density, strict=True)]
    text = [size[i] - linked[i] for i in range(n)]
    named = next((found for kind in ("article", "main") if (found := [i for i in range(1, n) if tag[i] == kind and not junk[i] and size[i]])), None)
    keep = [False] * n
    if named:
        best = max(named, key=lambda i: (text[i], size[i], -i))
    else:
        best = max((i for i in range(n) if not junk[i]), key=lambda i: (points[i], -i), default=0)
        best = best if points[best] > 0 else 0
        _beside(keep, best, tag, parent, junk, points, density, size, linked)
    keep[best] = True
    drop = junk
    for i in range(1, n):
        keep[i] = keep[i] or keep[parent[i]]
        if not named and keep[i] and i != best and size[i] and density[i] > 0.5 and tag[i] in ("ul", "ol", "dl", "div", "section", "table", "header"):
            drop[i] = True
        drop[i] = drop[i] or drop[parent[i]]
    blocks, part = [], []
    for i, text in tree.items:
        if text is None:
            if part:
                blocks.append(clean("".join(part)))
                part = []
        elif keep[i] and not drop[i]:
            part.append(text if tag[i] not in ("td", "th") else f" {text} ")
    blocks.append(clean("".join(part)))
    return [b for b in blocks if b]


def _beside(keep: list[bool], best: int, tag: list[str], parent: list[int], junk: list[bool], points: list[float], density: list[float], size: list[int], linked: list[int]) -> None:
    """Marks what else belongs to the best container: siblings, and at each level above it boxes that hold a part as good as half of it."""
    if not best or tag[best] == "body":
        return
    good, kids = points[:], [[] for _ in tag]
    for i in range(len(tag) - 1, 0, -1):
        kids[parent[i]].append(i)
        if not junk[i]:
            good[parent[i]] = max(good[parent[i]], good[i])
    at, before = best, None
    while at and tag[at] not in ("body", "html"):
        for i in reversed(kids[parent[at]]):
            if i == at or junk[i]:
                continue
            alike = density[i] < 0.25 and good[i] >= 0.5 * points[best]
            if at == best:
                alike = alike or points[i] >= max(10, 0.2 * points[best]) or tag[i] in PARAGRAPHS and density[i] < 0.25 and (size[i] > 80 or size[i] and not linked[i])
                before = i if i < best else before
            keep[i] = keep[i] or alike
        at = parent[at]
    if before and tag[before] in HEADINGS and density[before] < 0.25:
        keep[before] = True


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 2):
                texts = ["\n\n".join(main_blocks(h)) if h else "" for h in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
