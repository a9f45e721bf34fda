"""Main text of web pages by tree scoring.

A page becomes a light element tree. Parts that are never article text (menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden parts) are cut
off by tag, role, class and id, unless an element holds the page's article or most of its unlinked
text, as layout wrappers do, or is a form of text rather than of controls; comments and notices come back
for an article element inside them only. Each text block then earns
points for its length and its commas and passes them to its ancestors, the nearer the more; a
container's sum is discounted by the share of its text that is in links. The best container is widened to the article or main element around it,
and from an article to a main element around it whose other text reads like the article. Lists of nothing but links stay
where a heading or paragraph introduces them. Without an article or main element it is widened for as long as the unlinked text of its parent is mostly sentences, headings,
lists and tables; beside it everything is kept that is not mostly links.

Defined results: a null page is empty; a page of nothing but menus, footers and the like gives ''. If no
block earns points, everything that was not cut off is the text. Markup that is cut off in the middle
ends the page. Character references are decoded after the markup is read; every run of white space,
no-break spaces included, becomes one space; blocks are joined in page order by one space. Nesting
of any depth is read without recursion. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import deque
from heapq import heapify, heappop, heappush
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to the end tag, and never article text.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CUT_TAGS = frozenset(
    "head nav footer aside form button select dialog menu object audio video canvas map datalist".split()
)
#: Cut off whatever they hold.
NEVER_TEXT = frozenset("button select dialog object audio video canvas map datalist annotation annotation-xml".split())
NEVER_ROLES = frozenset("dialog alertdialog alert".split())
CUT_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split()
)
CUT_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adbox adslot banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies cookiebar disqus footer gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notification overlay pagination paywall popup promo promotion "
    "related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription "
    "toolbar topbar widget".split()
)
#: Words of parts that no size brings back: only an article or main element inside does.
NOTICE_WORDS = frozenset(
    "comment comments commentlist consent cookie cookies cookiebar disqus gdpr login modal newsletter notice notification "
    "paywall popup replies respond signup subscribe subscription".split()
)
#: Say that a part holds readers' comments whatever stands beside them, but for words of a switch.
COMMENT_WORDS = frozenset("comments commentlist disqus".split())
SWITCH_WORDS = frozenset("closed disabled enabled has no off open with without".split())
#: Cut off as whole tokens.
PART_NAMES = frozenset("about-author author-bio author-box author-card skip-link skip-links skip-to-content".split())
#: What a class or id may say besides a cut word and still name such a part.
AFFIXES = frozenset(
    "area author avatar bar block blocks bottom box btn button buttons col column container desktop external fixed floating form "
    "global google group icons id inner item items left link links list main mobile module outer panel primary reader readers region right "
    "secondary section site slot sticky text thread title top trail unit user users wrap wrapper".split()
)
ARTICLE_WORDS = frozenset("article articles content entry page post posts story".split())
#: Beside an article word these name a part of the article or the layout around it.
LAYOUT_WORDS = frozenset("banner header masthead navbar overlay promo promotion sidebar social topbar widget".split())
#: Never cut off by class or id.
SAFE = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: An open paragraph is not looked for beyond these.
P_SCOPE = frozenset("table td th caption button object html".split())
#: Blocks that are text of an article whatever their length.
TEXT_TAGS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary".split())
#: Kept beside the best container, if they are not mostly links.
BESIDE = TEXT_TAGS | frozenset("ul ol dl table figure address details hgroup header".split())
#: Kept beside an article element.
OWN_TEXT = frozenset("p pre blockquote h1 h2 h3 article".split())
#: Ancestors that a block passes points to, and the share each gets.
SHARES = (1.0, 0.5, 1 / 3, 0.25, 0.2)
LEAST_LENGTH = 25
MOSTLY_LINKS = 0.5
#: Characters of text for each control that make a form a container.
FORM_TEXT = 100
#: Why an element is cut off: whatever it holds; by its tag or role; by its class or id; as a form; as notice or comments.
NEVER, PART, NAMED, FORM, NOTICE = 1, 2, 3, 4, 5


class Node:
    __slots__ = (
        "tag", "parent", "kids", "why", "cut", "own", "commas", "controls", "points", "length", "linked", "links",
        "reads",
    )

    def __init__(self, tag: str, parent: Node | None, why: int) -> None:
        self.tag, self.parent, self.why, self.cut = tag, parent, why, False
        self.kids: list[Node | str] = []
        self.own, self.commas, self.controls = 0, 0, 0
        self.points, self.length, self.linked, self.links, self.reads = 0.0, 0, 0, 0, 0


def names_part(value: str) -> int:
    """Why a class or id cuts its element off: a token of it names such a part, and nothing else."""
    why = 0
    for token in value.split():
        said = {w for w in re.split(r"[^a-z]+", token) if len(w) > 1}
        if said & COMMENT_WORDS and said.isdisjoint(SWITCH_WORDS):
            return NOTICE
        cut = said & CUT_WORDS
        if token.strip("-_") in PART_NAMES:
            why = NAMED
        elif cut and said <= CUT_WORDS | AFFIXES | ARTICLE_WORDS and (said.isdisjoint(ARTICLE_WORDS) or not cut <= LAYOUT_WORDS):
            if cut & NOTICE_WORDS:
                return NOTICE
            why = NAMED
    return why


def cut_off(tag: str, attrs: str, in_article: bool, in_quote: bool = False) -> int:
    """Why an element is cut off, 0 if it is not."""
    if tag in NEVER_TEXT:
        return NEVER
    why = 0
    if tag == "footer" and in_quote:
        pass  # who is quoted
    elif tag in CUT_TAGS or (tag == "header" and not in_article):
        why = FORM if tag == "form" else NAMED if tag == "head" else PART
    if not attrs or attrs.isspace():
        return why
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            if tag == "header" and not ARTICLE_WORDS.isdisjoint(re.split(r"[^a-z]+", value)) and why == PART:
                why = 0  # the article's own header
            if tag == "article" and value.split() and names_part(value) == NOTICE:
                return NEVER  # a reader's comment
            if tag not in SAFE and why in (0, FORM, NAMED):
                why = names_part(value) or why
        elif name == "role":
            if value in NEVER_ROLES:
                return NEVER
            if value in CUT_ROLES and not (tag == "form" and value == "form"):
                why = PART
        elif name == "hidden" and tag not in ("html", "body"):
            return NEVER
        elif name == "aria-hidden":
            if value == "true":
                return NEVER
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
    return why


def tree(page: str) -> list[Node]:
    """All elements in page order, the root first."""
    root = Node("html", None, 0)
    nodes, stack, open_tags = [root], [root], {"html": 1}

    def pop_to(index: int) -> None:
        for node in stack[index:]:
            open_tags[node.tag] -= 1
        del stack[index:]

    def close(tags: set[str], scope: set[str] | frozenset[str]) -> None:
        """Close the topmost open one of ``tags`` that is not beyond ``scope``."""
        if any(open_tags.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    pop_to(i)
                    return
                if stack[i].tag in scope:
                    return

    at = 0
    while (found := MARKUP.search(page, at)) is not None:
        if found.start() > at:
            stack[-1].kids.append(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["end"]:
            if tag in ("html", "body") or not open_tags.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    pop_to(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break  # the element was closed with its block
            continue
        if tag in ("html", "body"):
            continue
        if tag in RAW:
            if not found["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
                stack[-1].controls += tag == "textarea"
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK and tag != "br" and open_tags.get("p"):
            close({"p"}, P_SCOPE)
        parent = stack[-1]
        inside, quoted = (any(open_tags.get(t) for t in tags) for tags in (("article", "main"), ("blockquote", "figure")))
        node = Node(tag, parent, cut_off(tag, found["attrs"], inside, quoted))
        if tag in ("button", "select") or (tag == "input" and "hidden" not in found["attrs"].lower()):
            node.controls = 1
        parent.kids.append(node)
        nodes.append(node)
        if tag not in VOID:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    if at < len(page):
        stack[-1].kids.append(page[at:])
    settle(nodes)
    return nodes


def settle(nodes: list[Node]) -> None:
    """Mark what is cut off, and bring back the parts that hold the article."""
    place = {id(n): k for k, n in enumerate(nodes)}
    up = [0] + [place[id(n.parent)] for n in nodes[1:]]
    size = len(nodes)
    never, inside = [False] * size, [-1] * size  # the next part around an element that is cut off
    parts: dict[int, list[int]] = {}
    for k, node in enumerate(nodes):
        if k:
            above = up[k]
            never[k] = never[above] or node.why == NEVER
            inside[k] = above if nodes[above].why else inside[above]
        if node.why and not never[k]:
            parts.setdefault(inside[k], []).append(k)
        if not never[k]:
            own = " ".join(unescape("".join(x for x in node.kids if isinstance(x, str))).split())
            node.own, node.commas = len(own), own.count(",") + own.count("，") + own.count("、")
    # unlinked text; the most in one article or main; whether there is a main: of all, and of what is not cut off
    text, seen = [n.own for n in nodes], [n.own for n in nodes]
    most, shown = [0] * size, [0] * size
    main, main_shown, controls = [False] * size, [False] * size, [n.controls for n in nodes]
    for k in range(size - 1, -1, -1):
        node, above = nodes[k], up[k]
        if never[k]:
            text[k] = seen[k] = most[k] = shown[k] = 0
            main[k] = main_shown[k] = False
        elif node.tag == "a":
            text[k] = seen[k] = 0
        elif node.tag in ("article", "main"):
            most[k], shown[k] = max(most[k], text[k]), max(shown[k], seen[k])
            main[k] = main[k] or node.tag == "main"
            main_shown[k] = main_shown[k] or node.tag == "main"
        if k:
            controls[above] += controls[k]
            text[above] += text[k]
            most[above] = max(most[above], most[k])
            main[above] = main[above] or main[k]
            if not node.why:
                seen[above] += seen[k]
                shown[above] = max(shown[above], shown[k])
                main_shown[above] = main_shown[above] or main_shown[k]
    all_text, rest, best, has_main = text[0], seen[0], shown[0], main_shown[0]
    todo = [(-text[k], k) for k in parts.get(-1, ())]
    heapify(todo)
    while todo:
        _, k = heappop(todo)
        why = nodes[k].why
        if (
            (main[k] and not has_main)
            or (most[k] > best and 2 * most[k] > rest)
            or (why in (NAMED, FORM) and not best and 2 * text[k] > all_text and 4 * rest < all_text)
            or (why == FORM and text[k] > FORM_TEXT * (controls[k] + 1))
        ):
            nodes[k].why = 0
            rest, best, has_main = rest + seen[k], max(best, shown[k]), has_main or main_shown[k]
            for below in parts.get(k, ()):
                heappush(todo, (-text[below], below))
    for node in nodes:
        node.cut = node.why > 0 or (node.parent is not None and node.parent.cut)


def blocks(top: Node, skip: set[int] = frozenset()) -> list[str]:
    """Texts of the blocks below ``top`` in page order."""
    out: list[str] = []
    parts: list[str] = []

    def end() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(text)
            parts.clear()

    todo: list[Node | str | None] = [top]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.cut and id(item) not in skip:
            if item.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(item.kids))
    end()
    return out


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def measure(nodes: list[Node]) -> None:
    """Points, text lengths and link lengths, children before parents."""
    for node in reversed(nodes):
        if node.cut:
            continue
        inline = [k for k in node.kids if isinstance(k, Node) and k.tag not in BLOCK]
        node.length += node.own
        if node.tag == "a":
            node.linked, node.links = node.length, 1
        if node.tag in BLOCK and (node.own or inline):
            run = node.own + sum(k.length for k in inline)
            points = node.commas + min(run / 100, 3) + (run >= LEAST_LENGTH) if run else 0
            points *= 1 - min(density(node), 1.0)
            if density(node) < MOSTLY_LINKS and (run >= LEAST_LENGTH or node.tag in TEXT_TAGS):
                node.reads += max(run - sum(k.linked for k in inline), 0)
            above = node if node.tag not in ("p", "pre", "li", "td", "blockquote") and node.parent is None else node.parent
            above = above or node
            for share in SHARES:
                above.points += points * share
                above = above.parent
                if above is None:
                    break
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.links += node.links
            node.parent.reads += node.reads


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes = tree(page)
    measure(nodes)
    skip = menus(nodes)
    score = lambda n: n.points * (1 - density(n))
    best = max((n for n in nodes if not n.cut), key=score, default=nodes[0])
    if score(best) <= 0:
        return " ".join(blocks(nodes[0], skip))
    around = best
    while around.parent is not None and around.tag not in ("article", "main"):
        around = around.parent
    if around.tag in ("article", "main"):
        best = wider(around)
    if best.parent is None:
        return " ".join(blocks(best, skip))
    least, kept, inner = 0.2 * score(best), deque(blocks(best, skip)), best
    tagged = best.tag in ("article", "main")
    while inner.parent is not None:
        outer = inner.parent
        # whether the parent's unlinked text, but for the part reached so far, mostly reads like an article
        article = 2 * (inner.length - inner.linked + outer.reads - inner.reads) >= outer.length - outer.linked
        at = outer.kids.index(inner)
        for before, kids in ((True, outer.kids[:at]), (False, outer.kids[at + 1 :])):
            texts: list[str] = []
            for part in runs(kids):
                scores = inner is best and score(part) >= max(least, 1e-9)
                # right below the page itself a short line beside an article is more often an imprint
                text = part.tag in OWN_TEXT and density(part) < 0.25 and (outer.parent is not None or part.length > 80)
                if not part.cut and (scores or text or (not tagged and (article or stands_beside(part)) and density(part) < MOSTLY_LINKS)):
                    texts += blocks(part, skip)
            if before:
                kept.extendleft(reversed(texts))
            else:
                kept.extend(texts)
        if tagged or not article:
            break
        inner = outer
    return " ".join(kept)


def menus(nodes: list[Node]) -> set[int]:
    """Lists of nothing but links that no heading or paragraph of the text introduces."""
    out = set()
    for node in nodes:
        if node.tag not in ("ul", "ol") or node.cut or node.links < 3 or node.linked != node.length:
            continue
        before = None
        for kid in node.parent.kids:
            if kid is node:
                break
            if isinstance(kid, Node) and kid.length and not kid.cut:
                before = kid
        introduced = before is not None and before.tag in ("p", "h2", "h3", "h4", "h5", "h6") and before.linked < before.length
        if not introduced:
            out.add(id(node))
    return out


def wider(inner: Node) -> Node:
    """The main element around an article if the rest of its unlinked text reads like one."""
    outer = inner.parent
    while inner.tag == "article" and outer is not None:
        if outer.tag == "main":
            rest = outer.length - outer.linked - (inner.length - inner.linked)
            return outer if 0 < rest <= 2 * (outer.reads - inner.reads) else inner
        outer = outer.parent
    return inner


def stands_beside(part: Node) -> bool:
    """Text, a heading, list or table, or an element that mostly holds such."""
    return part.tag in BESIDE or part.tag == "" or 0 < part.length - part.linked <= 2 * part.reads


def runs(kids: list[Node | str]) -> list[Node]:
    """Block elements as they are, and each run of text and inline elements as one element."""
    out: list[Node] = []
    for kid in kids:
        if isinstance(kid, Node) and kid.tag in BLOCK:
            out.append(kid)
            continue
        if not out or out[-1].tag != "":
            out.append(Node("", None, 0))
        out[-1].kids.append(kid)
        if isinstance(kid, Node):
            if not kid.cut:
                out[-1].length += kid.length
                out[-1].linked += kid.linked
        else:
            out[-1].length += len(" ".join(unescape(kid).split()))
    return out


def extract(html: Column) -> Column:
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return texts(F.coalesce(html.cast("string"), F.lit("")))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = pages.select("page_id", "url", extract(F.col("html")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
