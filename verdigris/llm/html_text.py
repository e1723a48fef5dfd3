"""Main text of web pages by composite text density.

A page becomes a tree by one pass over its tags (implied ends, void and raw-text elements,
unclosed tags to the end). What is never article text (scripts, forms, menus, notices, adverts,
comments by readers; by element, role or the words of class and id) is cut off. Every node then
has its characters C, those in links LC, its tags T and link tags LT, and the density

    C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LC_body / C_body * C + e),

where a zero below a line counts as one. The node with the largest sum of its children's
densities is the core; the smallest density from it up to the body is the threshold. From the
body down, each node that reaches the threshold marks its own subtree of largest sum. An
article or main element around the core is taken as a whole, since short blocks of it have
little density; else what lies between marked nodes in their smallest common parent, but for
parts that are mostly links; in the body itself only marked nodes and headings.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by a line feed in page order; nothing is capped.

Defined cases: null or empty html, and pages without text outside of what is cut off, give an
empty text; pages whose every part would be cut off by a class name are read again by elements
alone; line breaks (br) are white space; rows that repeat, and null ids, stay rows; an empty
table gives none; extra columns, whatever their names, are not read. Time is linear in the
page's length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import workers_ready

# Fixed values of the language of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset("body caption dd dt head html legend tbody td tfoot th thead tr".split()) | {"dd", "dt"}
#: What the start of an element ends, up to the nearest of the other names.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "body": (("head",), ("html",))}
#: Elements that are no article text.
CUT = frozenset("nav aside footer form button dialog menu label fieldset object audio video canvas map head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that tell other parts of a page.
NAMES = frozenset("""
ad ads adbox adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies cookiebar copyright disqus
disclaimer footer gdpr header login masthead menu modal nav navbar navigation navi newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion recommended
recommendations related replies reply respond search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola tagcloud teaser toolbar topbar widget widgets
""".split())  # fmt: skip
#: Before such a name these say that a part only knows of it.
ABOUT = frozenset("with no has without hide hides show is".split())
KEPT = frozenset(("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6", "p"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!(?!--)[^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|(\Z))|</(?:>|[^a-zA-Z][^>]*+(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Tree:
    """Nodes in page order: parents come before their children."""

    def __init__(self):
        self.tag, self.parent, self.attributes, self.text = ["#"], [0], [""], []

    def add(self, tag: str, parent: int, attributes: str = "") -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        return len(self.tag) - 1


def parsed(page: str) -> Tree:
    """The page's tree; ``text`` has (node, undecoded text) and (node, None) for a break, in page order."""
    tree, stack, at = Tree(), [0], defaultdict(list)
    blocks, place, n = [0], 0, len(page)

    def close(to: int) -> None:
        while len(stack) > to:
            tag = tree.tag[stack.pop()]
            at[tag].pop()
            if blocks and blocks[-1] >= len(stack):
                blocks.pop()

    def ends(names, until) -> None:
        low = max((at[x][-1] for x in until if at[x]), default=0)
        open_ = max((at[x][-1] for x in names if at[x]), default=0)
        if open_ > low:
            close(open_)

    while place < n:
        less = page.find("<", place)
        m = TOKEN.match(page, less) if less >= 0 else None
        if not m:
            # Text up to and with a sign that begins no tag.
            end = n if less < 0 else less + 1
            tree.text.append((stack[-1], page[place:end]))
            place = end
            continue
        if less > place:
            tree.text.append((stack[-1], page[place:less]))
        place = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[4] is not None:
                break
            if tag in RAW:
                close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, place)
                place = close_at.end() if close_at else n
                continue
            if tag in ENDS_P and at["p"]:
                ends(("p",), ("table", "td", "th", "button", "object", "caption"))
            if tag in ENDS:
                ends(*ENDS[tag])
            if tag in HEADINGS and tree.tag[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            if tag in ("html", "body") and at[tag]:
                continue
            if tag in VOID:
                tree.text.append((tree.add(tag, stack[-1]), None) if tag == "hr" else (stack[-1], " ") if tag == "br" else (tree.add(tag, stack[-1]), ""))
                continue
            node = tree.add(tag, stack[-1], m[3])
            at[tag].append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
                tree.text.append((node, None))
            stack.append(node)
        elif m[1]:
            tag = m[1].lower()
            if tag == "br":
                tree.text.append((stack[-1], " "))
            elif at[tag] and tag not in ("html", "body") and (tag in BLOCK or at[tag][-1] > blocks[-1]):
                close(at[tag][-1])
                if tag in BLOCK:
                    tree.text.append((stack[-1], None))
    return tree


def names(attributes: str) -> tuple[list[str], str, bool]:
    """(class and id values, role, whether hidden)."""
    found, role, hidden = [], "", False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            found += value.split()
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden":
            hidden |= m[0].lower() == "hidden" or "=" in m[0]
        elif name == "aria-hidden":
            hidden |= value.strip().lower() == "true"
        else:
            hidden |= bool(HIDDEN.search(value))
    return found, role, hidden


def names_other(value: str) -> bool:
    """Whether a class or id names another part than the article."""
    parts = [p.lower() for p in PARTS.findall(value)]
    return any(p in NAMES and (i == 0 or parts[i - 1] not in ABOUT) for i, p in enumerate(parts))


def cut_off(tree: Tree, by_name: bool) -> list[bool]:
    """Which nodes are no article text, or lie in such."""
    n = len(tree.tag)
    inside, holds = [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] |= holds[i] or tree.tag[i] in ("article", "main")
    gone = [False] * n
    for i in range(1, n):
        up, tag = tree.parent[i], tree.tag[i]
        inside[i] = inside[up] or tag in ("article", "main")
        if gone[up]:
            gone[i] = True
            continue
        gone[i] = tag in CUT and not (tag == "form" and holds[i]) or tag == "header" and not inside[i]
        if not gone[i] and tree.attributes[i].strip():
            values, role, hidden = names(tree.attributes[i])
            gone[i] = hidden and tag not in ("html", "body") or role in ROLES and tag not in KEPT
            if by_name and not gone[i] and not holds[i]:
                reader = any(p.lower() in ("comment", "comments", "reply", "replies", "related", "teaser", "promo", "ad", "ads", "advert", "sponsored") for v in values for p in PARTS.findall(v))
                gone[i] = any(map(names_other, values)) and (tag not in KEPT and not (inside[i] and any("header" in v.lower() for v in values)) or reader and tag == "article" or tag == "p")
    return gone


def densities(tree: Tree, gone: list[bool], chars: list[int]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Density and the sum of the children's densities of every node, and its characters and those in links."""
    n = len(tree.tag)
    c, lc, t, lt = chars[:], [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if gone[i]:
            c[i] = 0
            continue
        up, link = tree.parent[i], tree.tag[i] == "a"
        if link:
            lc[i] = c[i]
        c[up] += c[i]
        lc[up] += lc[i]
        t[up] += t[i] + 1
        lt[up] += lt[i] + link
    share = lc[0] / max(c[0], 1)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if c[i] and not gone[i]:
            plain = (c[i] / max(lc[i], 1)) * (max(t[i], 1) / max(lt[i], 1))
            base = math.log(c[i] / max(c[i] - lc[i], 1) * lc[i] + share * c[i] + math.e)
            density[i] = c[i] / max(t[i], 1) * math.log(plain) / math.log(base) if base > 1 else c[i] / max(t[i], 1) * math.log(plain)
        if i:
            total[tree.parent[i]] += density[i]
    return density, total, c, lc


def chosen(tree: Tree, gone: list[bool], chars: list[int]) -> list[bool]:
    """Which nodes are the article's."""
    n = len(tree.tag)
    density, total, c, lc = densities(tree, gone, chars)
    if not c[0]:
        return [False] * n
    # A text that stands in the page without any element around it has the page as its core.
    core = max(range(n), key=lambda i: (total[i], -i))
    if total[core] <= 0:
        core = 0
    threshold, up = density[core], core
    while up:
        up = tree.parent[up]
        if density[up] > 0:
            threshold = min(threshold, density[up])
    best = list(range(n))
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not gone[i] and total[best[i]] >= total[best[up]] and total[best[i]] > 0:
            best[up] = best[i]
    marks = {core} | {best[i] for i in range(1, n) if not gone[i] and tree.tag[i] not in ("html", "body") and density[i] >= threshold > 0}
    whole = core
    while whole and tree.tag[whole] not in ("article", "main"):
        whole = tree.parent[whole]
    is_article = whole > 0
    if not is_article:
        # The deepest node that holds all marks.
        held = [int(i in marks) for i in range(n)]
        for i in range(n - 1, 0, -1):
            held[tree.parent[i]] += held[i]
        whole = max(i for i in range(n) if held[i] == len(marks))
    # Below the body, only what is marked and headings belong together.
    loose = tree.tag[whole] in ("#", "html", "body") and whole not in marks
    marked, within, linked, found = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(n):
        up, tag = tree.parent[i], tree.tag[i]
        marked[i] = i in marks or (i > 0 and marked[up])
        within[i] = i == whole or (i > 0 and within[up])
        linked[i] = not is_article and not marked[i] and ((i > 0 and linked[up]) or tag in BLOCK and 2 * lc[i] > c[i])
        found[i] = not gone[i] and within[i] and not linked[i] and (not loose or marked[i] or tag in HEADINGS or found[up])
    return found


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    if not page:
        return ""
    tree = parsed(page)
    chars = [0] * len(tree.tag)
    for node, text in tree.text:
        if text:
            chars[node] += len(text.strip())
    for by_name in (True, False):
        found = chosen(tree, cut_off(tree, by_name), chars)
        lines, own = [], []
        for node, text in [*tree.text, (0, None)]:
            if text is None:
                line = " ".join(entities.unescape("".join(own)).split())
                if line:
                    lines.append(line)
                own = []
            elif found[node]:
                own.append(text)
        if lines:
            return "\n".join(lines)
    return ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    workers_ready(pages.sparkSession)

    def run(batches):
        for b in batches:
            # Slices, so that the texts of a batch of long pages are not all held twice.
            for part in (b.slice(k, 100) for k in range(0, b.num_rows, 100)):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
