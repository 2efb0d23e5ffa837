"""Main text of web pages, with wrappers inferred as union-free regular expressions.

A page becomes a stream of tags and texts, nested as elements. The wrapper of a host is a union-free regular expression over that stream: tags, text slots, optional
parts and repeated groups, and nothing else. It begins as the first page and is aligned with one page after another: texts that differ become slots; children that
only one side has become optional; neighbours of equal shape become repeated groups. Aligning two wrappers is the same operation, so each
task folds its own pages into a wrapper per host, and hosts' wrappers are aligned in two more levels; pages are not shuffled for it.

The article's slots are derived from a host's expression, once for all of its pages: those under an article (or main element), without parts that are named as navigation, adverts, forms, comments
and the like, and without constants, which are texts that stand at the same place of all pages: the host's template. A page's main text is what it has in these slots. A page without an article has the
slots outside; there, blocks that are mostly links are menus. A block that holds constants only is left out; a block with a slot stays whole.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of, written

#: Evidence: a constant text counts as the host's template once pages of so many different main texts have it.
ENOUGH_PAGES = 5
#: An element's children beyond this number of places are one repeated group of optional kinds, in no order; nothing is left out of a wrapper but what lies deeper than DEPTH elements,
#: where a page's own path decides by the same rules.
DEPTH, CHILDREN = 200, 48
#: Wrappers up to this size in all are sent to all executors; more are joined by host.
SMALL_BYTES = 32 << 20

# Element names by their role in the HTML standard, and names by which pages mark what is not the article.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
LEFT_OUT = RAW | {"nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "menu", "dialog", "head", "object", "canvas", "audio", "video", "datalist"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "br",
}
NAMED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "alert", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "related", "recommended", "recommendations", "share", "sharing", "social", "comment", "comments",
    "commentlist", "disqus", "replies", "reply", "respond", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "popup", "modal", "overlay", "toolbar", "pagination", "pager", "widget",
    "complementary", "contentinfo", "search", "form", "skip",
}
NAMED_OUTSIDE = {"header", "masthead", "topbar", "banner", "logo"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Blocks that are an article's own text: in an article they are no template, and are left out by their names only where all words name an advert or the like.
TEXT_LEVEL = {"p", "li", "dd", "dt", "td", "th", "caption", "figcaption", "blockquote", "pre", *HEADINGS}
#: Words of NAMED that an article's own paragraphs have in their class as well.
COMMON_WORDS = {"form", "notice", "notices", "alert", "notification", "search", "skip", "reply", "related", "login", "promotion"}
CLOSES_P = {"p", "div", "ul", "ol", "li", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "main", "form", "blockquote", "pre", "figure", "hr", "address", "fieldset", "details", *HEADINGS}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<(?:[!?])|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))""", re.I)
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match((url or "").strip())
    return m[1].lower() if m else ""


def events(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): ("open", tag, attributes), ("close", tag, ""), ("text", "", raw text). Raw elements come without content; comments do not come."""
    at, n = 0, len(source)
    last = source.rfind(">")  # a tag that begins behind it has no end, and none is looked for again and again
    while at < n:
        m = _TOKEN.search(source, at) if at < last else None
        if m is None:
            yield "text", "", source[at:]
            return
        if m.start() > at:
            yield "text", "", source[at : m.start()]
        sign = m[0]
        if sign == "<!--":
            end = source.find("-->", m.end())
            at = n if end < 0 else end + 3
        elif sign == "<![CDATA[":
            end = source.find("]]>", m.end())
            yield "text", "", html.escape(source[m.end() : n if end < 0 else end])
            at = n if end < 0 else end + 3
        elif m[2] is None and m[5] is None:
            end = source.find(">", m.end())
            at = n if end < 0 else end + 1
        else:
            closing, name, rest = (m[1], m[2], m[3]) if m[2] is not None else (m[4], m[5], m[6])
            name, at = name.lower(), m.end()
            if closing:
                yield "close", name, ""
                continue
            yield "open", name, rest
            if name in RAW and not rest.endswith("/"):
                end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(source, at)
                at = n if end is None else end.start()


def names_of(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role; whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for m in _NAME.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
        elif key in ("class", "id", "role"):
            words |= {w.lower() for w in _PART.findall(value)} | {w.lower() for w in re.split(r"[^A-Za-z0-9]+", value)}
    return words, hidden


def parts(source: str) -> list[tuple]:
    """The page in order: ("open", shape, name, words, hidden), ("close",), ("text", text), with implied ends made plain.

    shape is the tag (with "!" where it is hidden) with the words of its class, id and role.
    """
    out: list[tuple] = []
    stack: list[str] = []
    held: Counter = Counter()  # how many elements of a name are open

    def pop(to: int) -> None:
        while len(stack) > to:
            held[stack.pop()] -= 1
            out.append(("close",))

    def last(name: str) -> int:
        at = len(stack) - 1
        while stack[at] != name:
            at -= 1
        return at

    for kind, name, value in events(source):
        if kind == "text":
            out.append(("text", value))
        elif kind == "open":
            if name in CLOSES_P and held["p"]:
                pop(last("p"))
            for same in SAME_CLOSES.get(name, ()):
                if held[same]:
                    at = len(stack) - 1
                    while stack[at] != same and stack[at] not in ("ul", "ol", "table", "dl", "select"):
                        at -= 1
                    if stack[at] == same:
                        pop(at)
            words, hidden = names_of(value) if value and not value.isspace() else (set(), False)
            out.append(("open", ".".join([name + "!" * hidden, *sorted(w for w in words if w and not w.isdigit())]), name, words, hidden))
            if name in VOID or value.endswith("/"):
                out.append(("close",))
            else:
                stack.append(name)
                held[name] += 1
        elif held[name]:
            pop(last(name))
    pop(0)
    return out


# ---- wrappers: [shape, optional, repeated, text or None, children]; shape "#" is a text, "()" a group ----

VARIES = None
#: Marks the group of an element's children that have no place of their own.
REST = "..."


def mark(text: str) -> str:
    """Stands for the whole text: the text itself, or its beginning, length and digest where it is long. A text has no line break, so no two texts share a mark."""
    return text if len(text) <= 200 else f"{text[:80]}\n{len(text)} {hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"


def key(node: list) -> str:
    return node[0] if node[0] != "()" else REST if node[3] == REST else "(" + " ".join(key(k) for k in node[4]) + ")"


def wrapper_of(page: list[tuple]) -> list:
    """The wrapper of one page."""
    root = ["", False, False, None, []]
    stack = [root]
    extra = 0
    for part in page:
        if part[0] == "text":
            text = " ".join(html.unescape(part[1]).split())
            if text:
                stack[-1][4].append(["#", False, False, mark(text), []])
        elif part[0] == "open":
            if len(stack) > DEPTH:
                extra += 1
            else:
                node = [part[1], False, False, None, []]
                stack[-1][4].append(node)
                stack.append(node)
        elif extra:
            extra -= 1
        else:
            done = stack.pop()
            done[4] = folded(done[4])
    root[4] = folded(root[4])
    return root


def folded(children: list[list]) -> list[list]:
    """Neighbours of equal shape as repeated groups: single elements, then groups of up to three."""
    for period in (1, 2, 3):
        out: list[list] = []
        keys: list[str] = []
        for child in children:
            out.append(child)
            keys.append(key(child))
            while len(keys) >= 2 * period and keys[-period:] == keys[-2 * period : -period]:
                first, second = out[-2 * period : -period], out[-period:]
                merged = [align(a, b) for a, b in zip(first, second)]
                del out[-2 * period :], keys[-2 * period :]
                if period == 1:
                    merged[0][2] = True
                    out.append(merged[0])
                else:
                    out.append(["()", False, True, None, merged])
                keys.append(key(out[-1]))
            if period > 1 and len(out) > period and out[-period - 1][0] == "()" and keys[-period - 1] == "(" + " ".join(keys[-period:]) + ")":
                group = out[-period - 1]
                group[4] = [align(a, b) for a, b in zip(group[4], out[-period:])]
                del out[-period:], keys[-period:]
        children = out
    return children


def grouped(children: list[list], other: list[list]) -> list[list]:
    """``children`` with sequences that the other side has as a repeated group put into such a group."""
    wants = {tuple(key(k) for k in o[4]) for o in other if o[0] == "()" and o[3] != REST}
    if not wants:
        return children
    lengths, keys, out, at = sorted({len(w) for w in wants}), [key(c) for c in children], [], 0
    while at < len(children):
        n = next((n for n in lengths if tuple(keys[at : at + n]) in wants), 0)
        out.append(["()", False, True, None, children[at : at + n]] if n else children[at])
        at += n or 1
    return out


#: Stretches of children up to this product of lengths are compared by a table.
TABLE = 10_000


def common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places (in x, in y) of a common subsequence, ascending: the longest of short stretches; longer ones are first cut where a key occurs once on both sides.

    Work is linear in the lengths but for sorting, memory too, however many children there are.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= TABLE:
            longest = [[0] * (n - j + 1) for _ in range(m - i + 1)]
            for p in range(m - i - 1, -1, -1):
                for q in range(n - j - 1, -1, -1):
                    longest[p][q] = longest[p + 1][q + 1] + 1 if x[i + p] == y[j + q] else max(longest[p + 1][q], longest[p][q + 1])
            p = q = 0
            while p < m - i and q < n - j:
                if x[i + p] == y[j + q]:
                    out.append((i + p, j + q))
                    p, q = p + 1, q + 1
                elif longest[p + 1][q] >= longest[p][q + 1]:
                    p += 1
                else:
                    q += 1
            continue
        ones, others = Counter(x[i:m]), Counter(y[j:n])
        place = {k: q for q, k in enumerate(y[j:n], j) if others[k] == 1}
        pairs = [(p, place[x[p]]) for p in range(i, m) if ones[x[p]] == 1 and x[p] in place]
        tops: list[int] = []
        links: list[tuple[int, int]] = []
        for k, (_, q) in enumerate(pairs):  # the longest ascending run of places
            at = bisect_left(tops, q)
            tops[at : at + 1] = [q]
            links[at : at + 1] = [(k, at)]
            pairs[k] = (*pairs[k], links[at - 1][0] if at else -1)
        if pairs:
            k, before = links[-1][0], (m, n)
            while k >= 0:
                p, q, k = pairs[k]
                out.append((p, q))
                todo.append((p + 1, before[0], q + 1, before[1]))
                before = (p, q)
            todo.append((i, before[0], j, before[1]))
        else:  # no key to cut at: each takes the next place that is left
            places: dict[str, deque] = {}
            for q in range(j, n):
                places.setdefault(y[q], deque()).append(q)
            for p in range(i, m):
                own = places.get(x[p])
                while own and own[0] < j:
                    own.popleft()
                if own:
                    j = own.popleft() + 1
                    out.append((p, j - 1))
    return sorted(out)


def align(a: list, b: list) -> list:
    """The least wrapper that has both, which are of equal shape."""
    out = [a[0], a[1] or b[1], a[2] or b[2], a[3] if a[3] == b[3] else VARIES, []]
    if a[3] == REST and b[3] == REST:
        return rest_of([*a[4], *b[4]])
    left, right = grouped(a[4], b[4]), grouped(b[4], a[4])
    x, y = [key(k) for k in left], [key(k) for k in right]
    if x == y:
        out[4] = [align(p, q) for p, q in zip(left, right)]
        return out
    i = j = 0
    children: list[list] = []
    for p, q in [*common(x, y), (len(x), len(y))]:
        children += [[k[0], True, *k[2:]] for k in (*left[i:p], *right[j:q])]
        if p < len(x):
            children.append(align(left[p], right[q]))
        i, j = p + 1, q + 1
    children = folded(children)
    if len(children) > CHILDREN:
        # optional children that come last lose their places
        optional = [k for k, c in enumerate(children) if c[1]]
        moved = set(optional[-(len(children) - CHILDREN + 1) :])
        if moved:
            children = [*(c for k, c in enumerate(children) if k not in moved), rest_of([children[k] for k in sorted(moved)])]
    out[4] = children
    return out


def rest_of(nodes: list[list]) -> list:
    """The repeated group of optional kinds that has all of ``nodes``, one of each kind."""
    kinds: dict[str, list] = {}
    todo = deque(nodes)
    while todo:
        node = todo.popleft()
        if node[0] == "()":
            todo.extendleft(reversed(node[4]))
        elif node[0] in kinds:
            kinds[node[0]] = align(kinds[node[0]], node)
        else:
            kinds[node[0]] = node
    return ["()", True, True, REST, [[k[0], True, *k[2:]] for k in kinds.values()]]


def expression(node: list) -> str:
    """A wrapper as text: <tag> ... </tag>, #slot, ( )?, ( )+."""
    inner = " ".join(expression(k) for k in node[4])
    body = ("#slot" if node[3] is VARIES else json.dumps(node[3], ensure_ascii=False)) if node[0] == "#" else inner if node[0] in ("", "()") else f"<{node[0]}> {inner} </{node[0].split('.')[0]}>"
    sign = "*" if node[1] and node[2] else "?" if node[1] else "+" if node[2] else ""
    return f"( {body} ){sign}" if sign else body


@lru_cache(maxsize=100_000)
def traits(shape: str) -> tuple[str, bool, bool, bool, bool, bool, bool]:
    """Of an element's shape: tag, whether it is a block, is left out by its tag, name or being hidden, is left out outside articles, begins an article, is shown, is left out inside articles."""
    tag, *words = shape.split(".")
    name, hidden, named = tag.rstrip("!"), tag.endswith("!"), set(words)
    plain = name not in ("body", "html")
    starts = name in ("article", "main") or (name in ("div", "section") and "main" in named and "content" in named)
    out = hidden or name in LEFT_OUT or (bool(named & NAMED) and plain and name not in ("article", "main"))
    within = hidden or name in LEFT_OUT or (bool(named) and named <= NAMED - COMMON_WORDS) if name in TEXT_LEVEL else out
    return name, name not in INLINE, out, bool(named & NAMED_OUTSIDE) and plain, starts, not hidden, within


#: What is known of a place from the elements above it: left out, in an article, in an article's header, in a link.
NOWHERE = (False, False, False, False)


def below(place: tuple[bool, bool, bool, bool], shape: str) -> tuple[bool, bool, bool, bool]:
    """The place inside an element of ``shape`` that stands at ``place``."""
    out, inside, header, link = place
    name, block, left_out, left_outside, starts, _, left_within = traits(shape)
    within = (inside or (starts and not out)) and not starts
    inside = inside or (starts and not out)
    out = out or (left_within if inside else left_out or left_outside)
    if name == "header":
        header, out = header or within, out or not within
    elif header and within and block and name not in HEADINGS and name not in ("div", "hgroup"):
        out = True
    return out, inside, header, link or name == "a"


def slots_of(wrapper: list, different: int) -> tuple[dict[str, tuple[bool, bool, bool, bool]], set[tuple[str, str]]]:
    """A host's decisions: what is known of each place of its expression by path, and the constants as (path, mark).

    Constants are texts that stand at the same place of every page, once ``different`` pages show that, but for an article's headings, paragraphs, list items and cells.
    """
    places: dict[str, tuple[bool, bool, bool, bool]] = {}
    constants: set[tuple[str, str]] = set()
    todo = [(wrapper, "", NOWHERE, different >= ENOUGH_PAGES, False)]
    while todo:
        node, path, place, always, own = todo.pop()
        places[path] = place
        for k in node[4]:
            if k[0] == "#":
                if always and not own and not k[1] and k[3] is not VARIES:
                    constants.add((path, k[3]))
            elif k[0] == "()":
                todo.append((k, path, place, always and not k[1], own))
            else:
                name, block, inner = *traits(k[0])[:2], below(place, k[0])
                todo.append((k, f"{path}/{k[0]}", inner, always and not k[1], (name in TEXT_LEVEL and inner[1]) if block else own))
    return places, constants


def main_text(page: list[tuple], slots: tuple[dict, set] | None = None) -> str:
    """The page's main text: what stands in the slots of its host, blocks joined by newlines. Without slots, and below the depth of wrappers, a path is decided by itself."""
    places, constants = slots or ({}, set())
    has_main = any(p[0] == "open" and traits(p[1])[4] and traits(p[1])[5] for p in page)
    blocks: list[str] = []
    words: list[str] = []
    size = linked = 0
    varies = False

    def flush() -> None:
        nonlocal size, linked, varies
        text = " ".join("".join(words).split())
        if text and varies and (has_main or not linked or linked <= 0.6 * size):
            blocks.append(text)
        words.clear()
        size = linked = 0
        varies = False

    path, place = "", NOWHERE
    stack: list[tuple] = []
    for part in page:
        if part[0] == "text":
            out, inside, _, link = place
            if not out and (inside or not has_main):
                text = html.unescape(part[1])
                flat = " ".join(text.split())
                words.append(text)
                varies = varies or bool(flat and not (constants and (path, mark(flat)) in constants))
                size += len(flat)
                linked += len(flat) if link else 0
        elif part[0] == "open":
            shape = part[1]
            stack.append((path, place, shape))
            if traits(shape)[1]:
                flush()
            elif traits(shape)[0] == "br":
                words.append(" ")
            if len(stack) <= DEPTH:
                path = f"{path}/{shape}"
                place = places[path] if path in places else below(place, shape)
            else:
                place = below(place, shape)
        else:
            path, place, shape = stack.pop()
            if traits(shape)[1]:
                flush()
    flush()
    return "\n".join(blocks)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", groups: int = 32) -> DataFrame:
    """(host, pages, wrapper, different): a wrapper per host, as JSON, from all of its pages, and how many different main texts they have, counted up to ENOUGH_PAGES."""

    def digest(page: list[tuple]) -> str:
        return hashlib.blake2b(main_text(page).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, list] = {}
        part = TaskContext.get().partitionId() % groups
        for batch in slices(batches):
            for url, source in zip(batch.column("_url").to_pylist(), batch.column("_html").to_pylist()):
                host, page = host_of(url), parts(source)
                known, one = hosts.get(host), wrapper_of(page)
                seen = set() if known is None else known[2]
                if len(seen) < ENOUGH_PAGES:
                    seen.add(digest(page))
                hosts[host] = [1, one, seen] if known is None else [known[0] + 1, align(known[1], one), seen]
            if len(hosts) > 5000:
                yield rows(hosts, part)
                hosts = {}
        yield rows(hosts, part)

    def rows(hosts: dict[str, list], part: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(hosts), pa.string()), pa.array([part] * len(hosts), pa.int32()), pa.array([h[0] for h in hosts.values()], pa.int64()), pa.array([json.dumps(h[1]) for h in hosts.values()], pa.string()), pa.array([sorted(h[2])[:ENOUGH_PAGES] for h in hosts.values()], pa.list_(pa.string()))],
            ["host", "part", "pages", "wrapper", "seen"],
        )

    def merge(keys: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, known = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    k = tuple(r[c] for c in keys)
                    if k != last:
                        if known:
                            yield rows({last[0]: known}, last[-1] if len(keys) > 1 else 0)
                        last, known = k, None
                    one = json.loads(r["wrapper"])
                    known = [r["pages"], one, set(r["seen"])] if known is None else [known[0] + r["pages"], align(known[1], one), known[2] | set(r["seen"])]
            if known:
                yield rows({last[0]: known}, last[-1] if len(keys) > 1 else 0)

        return run

    schema = "host string, part int, pages long, wrapper string, seen array<string>"
    own = pages.select(F.col(url_col).alias("_url"), text_of(html_col).alias("_html")).mapInArrow(first, schema)
    own = own.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").mapInArrow(merge(["host", "part"]), schema)
    return own.repartition("host").sortWithinPartitions("host", "part").mapInArrow(merge(["host"]), schema).select("host", "pages", "wrapper", F.size("seen").alias("different"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points of text).

    Character references are decoded, white space inside a block becomes one space, blocks are joined by newlines in page order. A null or empty page has an
    empty text; a page whose URL has no host belongs to the host "". Rows that repeat are extracted each; an empty table gives no rows. Broken markup is read as
    browsers do: what is not closed ends with its parent. Other columns are ignored.
    """
    found = written(wrappers(pages, url_col, html_col), "wrappers")
    size = found.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).head()[0]
    host = F.lower(F.regexp_extract(F.coalesce(F.trim(url_col), F.lit("")), r"^(?i)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_of(html_col).alias("_html"), host.alias("host"))
    rows = rows.join(F.broadcast(found) if size <= SMALL_BYTES else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[str, tuple] = {}
        for batch in slices(batches):
            texts = []
            for host, n, wrapper, source in zip(*(batch.column(c).to_pylist() for c in ("host", "different", "wrapper", "_html"))):
                if host not in slots:
                    if len(slots) > 2000:
                        slots.clear()
                    slots[host] = slots_of(json.loads(wrapper), n) if wrapper else ({}, set())
                texts.append(main_text(parts(source), slots[host]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["_id", "_url", "text", "n_chars"])

    schema = T.StructType([rows.schema["_id"], rows.schema["_url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = rows.select("_id", "_url", "_html", "host", "different", "wrapper").mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias("url"), "text", "n_chars")
