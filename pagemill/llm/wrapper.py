"""HTML extraction by wrapper induction.

Pages are parsed to trees leniently. A bounded sample of the pages of each host is aligned by simple tree matching, a
large mapping that keeps order and tags and prefers equal texts. Aligned nodes whose text is the same on nearly all pages
are template; nodes whose text varies are slots. The content root of a host is the deepest node, an article or main element
at most, that holds all the varying text outside menus, headers, footers, sidebars, notices, adverts, forms and comments.
Its path, the template texts beside it and those inside it are the wrapper.

The wrapper is applied to all pages of the host: template blocks inside the root go, all others are content. Where a page has
other texts beside the root than those of the template, the root is moved up until it holds them. Constant blocks that make
up the larger part of the root are taken for copies of one article, not for template. A page that the wrapper does not fit,
or of a host without one, is wrapped by its own tree. What varies and yet is no article, as menus and adverts do, is told by
its element, or by a word in its class, id or role; within an article only words that can mean nothing else count.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import map_batches, saved

#: Bound of the pages that are aligned for a host; hosts with fewer different pages than LEAST have no wrapper.
SAMPLE_PAGES, LEAST = 8, 2
#: Pages that a template block must be on, as a share of the sample and at least; template inside the root is at most this
#: share of its text.
TEMPLATE_SHARE, TEMPLATE_PAGES, TEMPLATE_TEXT = 0.8, 3, 0.5
#: Children up to which the largest mapping is sought over all pairs. Of more, equal ones are paired first and the mapping is
#: sought between them.
MATCH_CHILDREN = 64
#: Deeper pages are no samples; they are extracted like any other.
SAMPLE_DEPTH = 200
#: Hosts whose wrappers are broadcast; with more they are joined.
BROADCAST_HOSTS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never content, whole.
DROPPED = frozenset("script style noscript template iframe head title nav footer header aside form button select option textarea input label menu dialog svg canvas object embed audio video map".split())
#: Words in class, id or role, alone or with others, that mark such parts everywhere.
MARKS = frozenset(
    "nav navbar navigation breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus reply replies respond pagination pager".split()
)
#: Words that mark them outside articles if they are a whole class, id or role; inside they may be the article's own.
WEAK = frozenset("menu menubar header masthead topbar footer foot side aside complementary banner contentinfo alert form search login widget skip".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[a-z]+")
_STARTS = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: A tag that the end of the page has cut off: nothing but attributes.
_CUT = re.compile(r"</?[a-zA-Z][\w:-]*(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"?|'[^']*'?|[^\s\"'>]*))*\s*/?\Z")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_CLOSES = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


@dataclass
class Node:
    tag: str
    marks: frozenset[str] = frozenset()
    kids: list["Node | str"] = field(default_factory=list)
    hidden: bool = False
    weak: bool = False

    @property
    def boilerplate(self) -> bool:
        return self.hidden or self.tag in DROPPED or ((self.weak or not self.marks.isdisjoint(MARKS)) and self.tag not in ("html", "body", "article", "main"))

    def elements(self) -> list["Node"]:
        return [k for k in self.kids if isinstance(k, Node)]


def _attributes(raw: str) -> tuple[frozenset[str], bool, bool]:
    """The words of class, id and role, whether the element is hidden, and whether one of them is a weak mark as a whole."""
    marks: set[str] = set()
    hidden = weak = False
    for name, value in _ATTR.findall(raw):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
        elif name in ("class", "id", "role"):
            marks.update(_PART.findall(value))
            weak |= not WEAK.isdisjoint(value.split())
    return frozenset(marks), hidden, weak


def parse(html: str | None) -> Node:
    """The tree of a page, of any depth: unclosed and stray tags are mended, character references decoded; null is an empty
    tree. A tag whose quote does not end is taken to end at its first ``>``; a ``<`` without any is text, unless only
    attributes follow up to the end of the page.
    """
    root = Node("#root")
    stack = [root]
    within = 0  # open article and main elements
    html = html or ""
    at, size = 0, len(html)

    def text(raw: str) -> None:
        if raw:
            stack[-1].kids.append(unescape(raw))

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = _TOKEN.match(html, lt)
        if not m or (m[2] is not None and not m.group().endswith(">")):
            m = _STARTS.match(html, lt)
        if not m and _CUT.match(html, lt):
            text(html[at:lt])
            break
        if not m:  # a lone <
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if m.re is _TOKEN and m[2] is None:
            if m.group().startswith("<![CDATA["):
                stack[-1].kids.append(m.group()[9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    within -= sum(n.tag in ("article", "main") for n in stack[i:])
                    del stack[i:]
                    break
            continue
        while len(stack) > 1 and tag in _CLOSES.get(stack[-1].tag, ()):
            stack.pop()
        if tag in BLOCK:  # an open paragraph ends with the block that follows, also below inline elements
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        marks, hidden, weak = _attributes(m[3]) if m[3] else (frozenset(), False, False)
        node = Node(tag, marks, [], hidden, weak and not within)
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            body = html[at : end.start()] if end else html[at:]
            node.kids.append(body if tag in ("script", "style") else unescape(body))
            at = end.end() if end else size
            continue
        stack.append(node)
        within += tag in ("article", "main")
    return root


def blocks(node: Node, skip: bool = True, template: frozenset[str] = frozenset()) -> list[str]:
    """Texts of the blocks below ``node`` in page order, white space made single; empty ones and those whose mark is in
    ``template`` are left out.
    """
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line and (not template or _mark(line) not in template):
            out.append(line)

    todo: list[Node | str | None] = list(reversed(node.kids))  # None: the end of a block
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            run.append(k)
        elif k.tag == "br":
            run.append(" ")
        elif not (skip and k.boilerplate):
            if k.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(k.kids))
    flush()
    return out


def _size(node: Node) -> int:
    total, todo = 0, [node]
    while todo:
        for k in todo.pop().kids:
            if isinstance(k, str):
                total += len(k)
            elif not k.boilerplate:
                todo.append(k)
    return total


def _depth(node: Node) -> int:
    deepest, todo = 0, [(node, 1)]
    while todo:
        n, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(k, d + 1) for k in n.elements()]
    return deepest


#: What an equal text counts beside a pair of nodes: it only decides between mappings of the same size.
_EQUAL = 1e-6


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of a largest order-keeping mapping of equal tags, and its pairs; of mappings of one
    size one with the most equal texts.
    """
    got, pairs = _match(a, b)
    return int(got + 0.5), pairs


def _match(a: Node, b: Node) -> tuple[float, list[tuple[Node, Node]]]:
    if a.tag != b.tag:
        return 0, []
    own = _own(a)
    total, pairs = 1 + (_EQUAL if own and own == _own(b) else 0), [(a, b)]
    for x, y in _stretches(a.elements(), b.elements()):
        best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
        below = {}
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                got = below[i, j] = _match(p, q)
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + got[0])
        i, j = len(x), len(y)
        total += best[i][j]
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs += below[i - 1, j - 1][1]
                i, j = i - 1, j - 1
    return total, pairs


def _stretches(x: list[Node], y: list[Node]) -> Iterator[tuple[list[Node], list[Node]]]:
    """The children to be mapped: all at once if they are few; else equal ones one by one, and what stands between them."""
    if len(x) <= MATCH_CHILDREN and len(y) <= MATCH_CHILDREN:
        yield x, y
        return
    keys = [[(n.tag, n.marks, " ".join(blocks(n, False))) for n in side] for side in (x, y)]
    at = to = 0
    for i, j, n in SequenceMatcher(None, *keys, autojunk=False).get_matching_blocks():
        yield from _between(x[at:i], y[to:j])
        for k in range(n):
            yield [x[i + k]], [y[j + k]]
        at, to = i + n, j + n


def _between(x: list[Node], y: list[Node]) -> Iterator[tuple[list[Node], list[Node]]]:
    """Long stretches without equal nodes: in order, those with the same number among those of their tag and marks."""
    if len(x) <= MATCH_CHILDREN and len(y) <= MATCH_CHILDREN:
        yield x, y
        return
    held: dict[tuple[str, frozenset[str]], list[Node]] = defaultdict(list)
    for q in reversed(y):
        held[q.tag, q.marks].append(q)
    for p in x:
        if held[p.tag, p.marks]:
            yield [p], [held[p.tag, p.marks].pop()]


def step(node: Node, among: list[Node]) -> str:
    """How a child is named in a path: tag, its sorted marks, and its number among like ones."""
    like = [n for n in among if n.tag == node.tag and n.marks == node.marks]
    return f"{node.tag}.{'.'.join(sorted(node.marks))}#{next(i for i, n in enumerate(like) if n is node)}"


def induce(pages: list[str | None]) -> list[str]:
    """The wrapper of pages of one host: the path of the content root, then the marks of the template texts beside it (``=``
    and a hash) and of the template blocks inside it (``-=`` and a hash); empty if fewer than LEAST different pages.
    """
    trees = [t for t in (parse(p) for p in dict.fromkeys(pages)) if _depth(t) <= SAMPLE_DEPTH]
    if len(trees) < LEAST:
        return []
    first = trees[0]
    seen: dict[int, set[str]] = defaultdict(set)  # by node of the first tree: its own texts on all pages
    aligned: dict[int, int] = defaultdict(int)
    same: dict[int, int] = defaultdict(int)  # pages that have the same lines in the node's place
    for other in trees[1:]:
        for a, b in tree_match(first, other)[1]:
            aligned[id(a)] += 1
            seen[id(a)].update((_own(a), _own(b)))
            if a.tag in BLOCK and not any(k.tag in BLOCK for k in a.elements()):
                same[id(a)] += blocks(a) == blocks(b)
    varying: dict[int, int] = {}

    def weigh(n: Node) -> int:
        """Varying text at and below a node: a node without partners belongs to a slot, so all of it varies."""
        if n.boilerplate:
            return 0
        texts = seen.get(id(n), ())
        own = len(_own(n)) if not aligned[id(n)] or len(texts) > 1 else 0
        varying[id(n)] = own + sum(weigh(k) for k in n.elements())
        return varying[id(n)]

    total = weigh(first)
    path, node, beside = [], first, []
    while total and node.tag not in ("article", "main"):
        kids = node.elements()
        down = next((k for k in kids if varying.get(id(k), 0) == total and k.tag in BLOCK and k.tag not in ("p", "li", "td", "h1")), None)
        if down is None:
            break
        path.append(step(down, kids))
        beside += _beside(node, down)
        node = down
    if not path:
        return []
    return path + sorted({_mark(t) for t in beside}) + sorted({f"-{_mark(t)}" for t in _constant(node, same, len(trees))})


def _constant(root: Node, same: dict[int, int], pages: int) -> list[str]:
    """Lines of the blocks below ``root`` that are the same on nearly all pages; none if they are most of its text."""
    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * pages)
    lines, todo = [], [root]
    while todo:
        for k in todo.pop().elements():
            if not k.boilerplate:
                todo.append(k)
                if 1 + same[id(k)] >= least:
                    lines += blocks(k)
    return lines if sum(map(len, lines)) <= TEMPLATE_TEXT * sum(map(len, blocks(root))) else []


def _beside(node: Node, down: Node | None) -> list[str]:
    """The texts at ``node`` and below it, without those of boilerplate and of its child ``down``."""
    own = _own(node)
    return ([own] if own.strip() else []) + [t for k in node.elements() if k is not down and not k.boilerplate for t in _beside(k, None)]


def _mark(text: str) -> str:
    import xxhash

    return f"={xxhash.xxh3_64_hexdigest(text.encode('utf-8', 'surrogatepass'))}"


def _own(node: Node) -> str:
    return _SPACE.sub(" ", "".join(k for k in node.kids if isinstance(k, str))).strip(" ")


def extract(html: str | None, path: list[str] | None) -> str:
    """The main text of a page by the wrapper ``path``; null and empty pages have none.

    The root is the deepest node of the path beside and above which all texts are of the template; template blocks inside
    it are left out.
    """
    root = parse(html)
    node = _follow(root, path) if path else None
    if node is None or not _size(node):
        return "\n".join(blocks(_main(root)))
    return "\n".join(blocks(node, True, frozenset(m[1:] for m in path if m.startswith("-="))))


def _follow(root: Node, path: list[str]) -> Node | None:
    known = {name for name in path if name.startswith("=")}
    node, held = root, None
    for name in path:
        if name in known or name.startswith("-="):
            break
        kids = node.elements()
        nxt = next((k for k in kids if k.tag == name.partition(".")[0] and step(k, kids) == name), None)
        if nxt is None:
            return None
        if held is None and any(_mark(t) not in known for t in _beside(node, nxt)):
            held = node
        node = nxt
    return held or node


def _main(root: Node) -> Node:
    """Of a page without wrapper: its article or main element with most text, else all of it."""
    found, todo = [], [root]
    while todo:
        for k in todo.pop().elements():
            if k.tag in ("article", "main"):
                found.append(k)
            elif not k.boilerplate:
                todo.append(k)
    return max(found, key=_size, default=root)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """(host, path) of the hosts with a wrapper, from ``sample_pages`` pages of each, those with the smallest hash.

    Only hashes are ranked: a host that holds a third of all pages is cut down within each task (the smallest hashes of a
    partition are candidates), so no task gets more than a few pages of it from each other task.
    """
    keyed = pages.select(host_of(F.col("url")).alias("host"), "html").filter("host <> '' and html is not null")
    per_task = saved(map_batches(keyed, _smallest(sample_pages), "host string, h bigint, html string"))
    # in two steps, so that what many tasks have of a host does not meet in one place
    least = F.expr(f"slice(array_sort(collect_set(h)), 1, {sample_pages})").alias("hs")
    parts = per_task.groupBy("host", F.pmod("h", F.lit(1024)).alias("part")).agg(least).select("host", F.explode("hs").alias("h"))
    few = parts.groupBy("host").agg(least).select("host", F.explode("hs").alias("h"))
    chosen = per_task.join(few, ["host", "h"], "left_semi").dropDuplicates(["host", "h"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["h"].to_pylist(), table["html"].to_pylist(), strict=True))
        return pa.table({"host": pa.array([key[0].as_py()], pa.string()), "path": pa.array([induce([h for _, h in rows])], pa.list_(pa.string()))})

    return chosen.groupBy("host").applyInArrow(run, "host string, path array<string>").filter("size(path) > 0")


def _smallest(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[str, dict[int, str]] = {}
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = html.as_py()
                h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1
                own = held.setdefault(host, {})
                if len(own) < n or h < max(own):
                    own[h] = text
                    if len(own) > n:
                        del own[max(own)]
        rows = [(host, h, text) for host, own in held.items() for h, text in own.items()]
        for at in range(0, len(rows), 500):
            cut = rows[at : at + 500]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in cut], pa.string()), pa.array([r[1] for r in cut], pa.int64()), pa.array([r[2] for r in cut], pa.string())], names=["host", "h", "html"])

    return run


def main_text(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page by the wrapper of its host.

    Null or empty html and pages without main text: empty text, 0 characters. Null urls have no host and no wrapper.
    Wrappers are broadcast after their number is checked, else they are joined on the host.
    """
    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    held = found.limit(BROADCAST_HOSTS + 1).collect()
    if len(held) <= BROADCAST_HOSTS:
        paths = pages.sparkSession.sparkContext.broadcast({r.host: list(r.path) for r in held})
        return map_batches(keyed, _apply(paths), "page_id bigint, url string, text string, n_chars bigint")
    joined = keyed.join(found, "host", "left").select("page_id", "url", "html", "host", "path")
    return map_batches(joined, _apply(None), "page_id bigint, url string, text string, n_chars bigint")


def _apply(paths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = paths.value if paths is not None else None
        for b in batches:
            hosts = b.column(3).to_pylist()
            path = [known.get(h) for h in hosts] if known is not None else b.column(4).to_pylist()
            text = [extract(h.as_py(), p) for h, p in zip(b.column(2), path, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run
