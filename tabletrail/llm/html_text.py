"""Main text of web pages by composite text density.

A page is read into a tree of elements (scripts, styles, comments and what their names or roles mark as menus, footers,
adverts, forms, notices, sidebars or reader comments stay out, unless an element so marked holds most of the text). Every node gets its characters per tag, adjusted for links:
text in links counts against it. A node's density sum adds its children's densities. The node with the greatest sum is the
core; the least density on its path to the body is the threshold. The text is that of the article element around the core,
or, without one, of every subtree whose density reaches the threshold, beginning at the body.

Character references are decoded, white space inside a block (also a line break element) becomes one space, blocks are
trimmed and joined by one newline in page order. A page is one row and its tree is in one task's memory. Null pages are
empty; pages without a body, cut off anywhere or nested wrongly are read as far as they go. Nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabletrail.llm.tasks import by_batch, dealt

# Elements by what HTML says of them, and names that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template iframe svg math textarea title object canvas"
OUT = frozenset("head nav footer aside menu dialog select option fieldset".split()) | frozenset(RAW.split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption tbody td tfoot th thead tr body html".split())
ITEM_OF = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|breadcrumbs?|footer|masthead|topbar|"
    r"comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"pagination|pager|toolbar|skip|copyright)(?:$|[\s_-])",
    re.I,
)
#: Names that also stand on wrappers of the main text, as in "has-sidebar": they count unless the element holds most of the page.
LAYOUT = re.compile(
    r"(?:^|[\s_-])(?:sidebar|side|aside|menu|nav|navbar|navigation|header|search|share|sharing|social|related|recommended|widget)(?:$|[\s_-])", re.I
)
_ARTICLE_NOT_MAIN = re.compile(r"(?:^|[\s_-])(?:comments?|reply|ad|ads|advert\w*|related|promo\w*)(?:$|[\s_-])", re.I)
MOST = 0.6
HEADS = frozenset(("article", "main", "h1"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + RAW.replace(" ", "|") + r")(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(?P<end2>/?)(?P<name2>[a-z][^\s/>]*)[^>]*>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*\Z",
    re.I | re.S,
)
#: Controls: out, but for those within running text.
CONTROLS = frozenset(("button", "label"))
RUNNING = ("p", "li", "td", "dd", "blockquote")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _attributes(rest: str) -> dict[str, str]:
    """Names in lower case with their values; of a name given twice the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), a or b or c)
    return found


def _is_hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or "display:none" in re.sub(r"\s", "", given.get("style", "").lower())


class Tree:
    """Elements in page order; a parent comes before its children. `pieces` holds texts and elements in order."""

    def __init__(self, page: str):
        self.name, self.parent, self.out, self.layout, self.apart = ["#page"], [-1], [False], [False], [False]
        self.pieces: list[tuple[int, str | int]] = []
        stack, at = [0], 0
        self.open: dict[str, int] = {}  # how many of a name are open, so that a deep stack is not searched in vain
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self.pieces.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name, rest = name.lower(), m["rest"] or ""
            if m["end"] or m["end2"]:
                self._close(stack, name)
            else:
                self._open(stack, name, rest)
        if at < len(page):
            self.pieces.append((stack[-1], page[at:]))
        self._settle_layout()

    def _settle_layout(self) -> None:
        """Elements named for the layout, or for what is not main text, and hidden ones go out unless they hold most of the text
        that is left.
        Of the latter kind (`apart`) they go too when an article, main or h1 element stands outside them and none within."""
        if not any(self.layout):
            return
        size = [0] * len(self.name)
        for owner, piece in self.pieces:
            if isinstance(piece, str) and not self.out[owner]:
                size[owner] += len(piece.strip())
        for i in range(len(size) - 1, 0, -1):
            size[self.parent[i]] += size[i]
        heads = [int(self.name[i] in HEADS and not self.out[i] and not self.layout[i]) for i in range(len(size))]
        above = [0] * len(size)
        for i in range(1, len(size)):
            above[i] = above[self.parent[i]] + heads[self.parent[i]]
        within = heads.copy()
        for i in range(len(size) - 1, 0, -1):
            within[self.parent[i]] += within[i]
        for i in range(1, len(size)):
            goes = size[i] < MOST * size[0] or self.apart[i] and not within[i] and within[0] > above[i]
            self.out[i] = self.out[i] or self.out[self.parent[i]] or self.layout[i] and goes

    def _cut(self, stack: list[int], depth: int) -> None:
        for node in stack[depth:]:
            self.open[self.name[node]] -= 1
        del stack[depth:]

    def _close(self, stack: list[int], name: str) -> None:
        if not self.open.get(name):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if self.name[stack[depth]] == name:
                self._cut(stack, depth)
                return
            if self.name[stack[depth]] in ("article", "main", "table") and name not in ("body", "html") and name not in BLOCK:
                return  # a stray inline end tag closes nothing outside

    def _open(self, stack: list[int], name: str, rest: str) -> None:
        if name in CLOSES_P:
            self._end_open(stack, "p", ("article", "main", "section", "div", "table", "td", "li", "blockquote", "body"))
        if name in ITEM_OF:
            self._end_open(stack, name, ITEM_OF[name])
        parent = stack[-1]
        given = _attributes(rest) if rest else {}
        named = f"{given.get('class', '')} {given.get('id', '')}".strip()
        layout, apart = _is_hidden(given), False
        out = self.out[parent] or name in OUT or name in CONTROLS and not self._within(RUNNING)
        out = out or name == "header" and not self._within(("article", "main"))
        if not out and name not in ("html", "body", "article", "main"):
            apart = name == "form" or bool(named and NOT_MAIN.search(named))
            layout = layout or apart or given.get("role", "").strip().lower() in ROLES
            layout = layout or bool(named and LAYOUT.search(named)) and not self._within(("article",))
        elif not out and name == "article":
            layout = layout or bool(named and _ARTICLE_NOT_MAIN.search(named))
        node = len(self.name)
        self.name.append(name)
        self.parent.append(parent)
        self.out.append(out)
        self.layout.append(layout and not out)
        self.apart.append(apart)
        self.pieces.append((parent, node))
        if name not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
            self.open[name] = self.open.get(name, 0) + 1

    def _within(self, names: tuple[str, ...]) -> bool:
        return any(self.open.get(name) for name in names)

    def _end_open(self, stack: list[int], name: str, up_to: tuple[str, ...]) -> None:
        if not self.open.get(name):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if self.name[stack[depth]] == name:
                self._cut(stack, depth)
                return
            if self.name[stack[depth]] in up_to:
                return


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    if not chars:
        return 0.0
    plain = max(chars - link_chars, 1)
    base = math.log(chars * link_chars / plain + body_links * chars + math.e)
    weight = math.log(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1) + 1)
    return chars / max(tags, 1) * weight / max(math.log(base), 0.1)


def main_text(page: str) -> str:
    tree = Tree(page)
    n = len(tree.name)
    chars, tags, links, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = tree.name[i] == "a" or in_link[tree.parent[i]]
    for owner, piece in tree.pieces:
        if isinstance(piece, str) and not tree.out[owner]:
            size = len(piece.strip())
            chars[owner] += size
            links[owner] += size if in_link[owner] else 0
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if not tree.out[i]:
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tree.name[i] == "a")
    body = next((i for i in range(n) if tree.name[i] == "body"), 0)
    body_links = links[body] / max(chars[body], 1)
    density = [_density(*x, body_links) for x in zip(chars, tags, links, link_tags, strict=True)]
    sums = [0.0] * n
    for i in range(1, n):
        if not tree.out[i]:
            sums[tree.parent[i]] += density[i]
    inside = [False] * n
    for i in range(n):
        inside[i] = i == body or i > 0 and inside[tree.parent[i]]
    core = max((i for i in range(n) if inside[i] and not tree.out[i]), key=lambda i: (sums[i], -i), default=body)
    path, i = [core], core
    while i != body and i > 0:
        i = tree.parent[i]
        path.append(i)
    article = next((i for i in reversed(path) if tree.name[i] == "article"), None)
    if article is not None:
        roots = {article}
    else:
        threshold = min((density[i] for i in path), default=0.0)
        roots = _reaching(tree, body, core, path, density, threshold)
    return _text(tree, roots)


def _reaching(tree: Tree, body: int, core: int, path: list[int], density: list[float], threshold: float) -> set[int]:
    """Below the body and beside the path to the core: the subtrees that reach the threshold, and headings; the core itself."""
    on_path, roots = set(path), {core}
    for i in range(1, len(tree.name)):
        if tree.name[i] == "h1" and not tree.out[i] and i < core:
            roots.add(i)  # the title, wherever it stands before the core
        if not tree.out[i] and tree.parent[i] in on_path and i not in on_path and tree.parent[i] != core:
            if density[i] >= threshold or re.fullmatch("h[1-6]", tree.name[i]):
                roots.add(i)
    return roots


def _text(tree: Tree, roots: set[int]) -> str:
    blocks: list[str] = []
    run: list[str] = []
    n = len(tree.name)
    chosen, block_of = [False] * n, [0] * n
    for i in range(n):
        chosen[i] = not tree.out[i] and (i in roots or i > 0 and chosen[tree.parent[i]])
        block_of[i] = i if i == 0 or tree.name[i] in BLOCK or tree.out[i] else block_of[tree.parent[i]]

    def end() -> None:
        block = " ".join(html.unescape("".join(run)).split())
        if block:
            blocks.append(block)
        run.clear()

    last = -1
    for owner, piece in tree.pieces:
        if isinstance(piece, int):
            if tree.name[piece] == "br" and chosen[owner]:
                run.append(" ")
            elif tree.name[piece] in BLOCK:
                end()
                last = -1
            continue
        if not chosen[owner]:
            continue
        if block_of[owner] != last:
            end()
            last = block_of[owner]
        run.append(piece)
    end()
    return "\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [main_text(page.as_py() or "") for page in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return by_batch(dealt(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html")), work, "page_id long, url string, text string, n_chars long")
