"""Main text of web pages: rules for page furniture, and site templates found by counting element subtrees for each host.

A task parses a page into blocks of text. Each block knows the subtrees around it that could be template: containers outside
the article, but not one that holds over half of the page's text. Nothing inside an article is template. Spark counts, for
each host, on how many different main texts each subtree stands, so that copies of a page count once; blocks inside a subtree
found on ``min_pages`` of them or more, and on at least the share ``min_share`` of all of the host's, go.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import batch_of, written

# Element names and words in class, id and role that mark page furniture.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "head", "optgroup",
}
FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "datalist", "math"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar", "status"}
WORDS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "sidebar", "widget", "widgets", "footer", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "disqus", "reply", "replies", "respond", "related", "recommended", "toolbar", "pagination", "pager", "adsbygoogle", "feedback",
}
HEADER_WORDS = {"header", "topbar", "alert", "side"}
OTHERS = {"comment", "comments", "disqus", "feedback", "reply", "replies", "respond", "related", "recommended"}  # may be longer than the article
COMMENTS = {"comment", "comments", "disqus"}  # name what readers say, whatever stands beside them
# Words that may stand beside a furniture word in a compound ("related-posts"); beside others ("related-work") it says something else.
BESIDE = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "fixed", "form", "global", "group", "header",
    "heading", "inner", "item", "items", "left", "level", "link", "links", "list", "main", "mobile", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section",
    "site", "slot", "sticky", "stories", "sub", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
DEEPEST = 64  # elements nested deeper are no template of their own, only parts of one
LAYOUT, STATES = {"has", "no", "with", "without", "allow"}, {"open", "opened", "closed", "enabled", "disabled", "allowed", "on", "off"}  # has-sidebar, menu-open: about the page's layout
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "dl", "figure"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
CLOSES_P = BLOCK - {"html", "body", "head", "option", "optgroup", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
# Open elements that an element ends, up to the nearest of the second table.
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
FENCES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}} | {
    name: {"table"} for name in ("tr", "td", "th", "thead", "tbody", "tfoot")
}

BROADCAST_ROWS = 1_000_000

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[a-z]+")
# Words that are written together with "comment" or "comments", before it or after.
_TOGETHER = re.compile("(?:user|reader|visitor|guest|blog|post|article|page|site|fb|facebook)?comments?(?:author|body|box|area|block|bubble|content|count|entry|form|item|list|meta|node|section|text|thread|wrap|wrapper|s)?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def host_of(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m and m[1] else None


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(raw):
        out.setdefault(k.lower(), unescape(v.strip("\"'")) if v else "")
    return out


def _is_furniture(name: str, attrs: dict[str, str], in_main: bool) -> bool:
    if name in FURNITURE or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if attrs.get("role", "").strip().lower() in ROLES:
        return True
    return name == "article" and bool(_parts(attrs) & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored"})


def _parts(attrs: dict[str, str]) -> set[str]:
    """Furniture words of class and id: those of names in which every word of some length is one, or may stand beside one.

    A comment word decides alone ("reader-comments", "commentList"). Names that say how the page is laid out ("has-sidebar",
    "menu-open") have none.
    """
    out: set[str] = set()
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = _PART.findall(_CAMEL.sub(" ", name).lower())
        if not parts or LAYOUT & set(parts) or (len(parts) > 1 and parts[-1] in STATES):
            continue
        parts = ["comment" if _TOGETHER.fullmatch(x) else x for x in parts]
        known = [x for x in parts if x in WORDS or x in HEADER_WORDS]
        if COMMENTS & set(parts):
            out.update(COMMENTS & set(parts))
        elif all(x in known or x in BESIDE or len(x) <= 3 for x in parts):
            out.update(known)
    return out


def _furniture_words(name: str, attrs: dict[str, str], in_main: bool) -> set[str]:
    """Furniture words an element is named by. What it holds decides whether it goes, once the page is read."""
    if name in MAIN or name in HEADINGS or name in ("html", "body") or not ("class" in attrs or "id" in attrs):
        return set()
    return _parts(attrs) & (WORDS if in_main else WORDS | HEADER_WORDS)


class _Open:
    """An element; what lies in it is added up and hashed from below, so nesting costs nothing."""

    __slots__ = ("name", "dropped", "main", "in_main", "key", "chars", "parent", "words", "named", "kept", "prose", "content", "depth", "near", "level", "inline")

    def __init__(self, name, dropped, main, in_main, parent, words, tag):
        self.name, self.dropped, self.main, self.in_main, self.parent = name, dropped, main, in_main, parent
        outer = parent is not None and parent.dropped
        self.inline = dropped and (parent.inline if outer else name not in BLOCK)  # what goes lies inside a line of the page
        self.key, self.chars, self.words, self.kept, self.prose, self.level = None, 0, words, 0, False, None
        self.named = bool(words) or (parent is not None and parent.named)
        self.content = xxhash.xxh64(tag)
        self.depth = parent.depth + 1 if parent is not None else 0
        self.near = self if self.depth <= DEEPEST else parent.near  # the nearest that can be a template of its own


def parse(html: str | None) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """Blocks of the main part in page order, each with the keys of possible template around it; keys of all possible template subtrees."""
    pieces: list[tuple[str, _Open | None, bool, int, int]] = []  # text as it stands, where, in the main part, block, characters
    stack: list[_Open] = []
    closed: list[_Open] = []
    opened: Counter = Counter()  # open elements of each name
    buf: list[str] = []
    html = html or ""
    at, size = 0, len(html)

    line = [0]  # number of the block

    def cut() -> None:
        """What has been read belongs to the innermost element; the block goes on."""
        if buf:
            raw = unescape("".join(buf))
            text = " ".join(raw.split())
            buf.clear()
            top = stack[-1] if stack else None
            if top is not None and text:
                top.content.update("\x1f" + text)
                top.chars += len(text)
                top.kept += 0 if top.dropped else len(text)
            if top is None or not top.dropped:
                pieces.append((raw, top, top is not None and top.in_main, line[0], len(text)))

    def flush() -> None:
        """The block ends, unless we are inside something inline that goes."""
        cut()
        if not (stack and stack[-1].inline):
            line[0] += 1

    def close(n: int) -> None:
        """Closes all but the first n open elements."""
        while len(stack) > n:
            if stack[-1].name not in BLOCK or stack[-1].inline:
                cut()
            else:
                flush()
            e = stack.pop()
            opened[e.name] -= 1
            digest = e.content.intdigest()
            if e.parent is not None:
                e.parent.content.update(f"\x1e{digest}")
                e.parent.chars += e.chars
                e.parent.kept += e.kept
            keyed = e.name in BLOCK and (e.name not in PROSE or e.name == "h1") and e.name not in ("html", "body", "head")
            if keyed and not e.main and not e.in_main and e.near is e:
                e.key = digest - (1 << 63)
                closed.append(e)

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            buf.append(html[at:])
            break
        if m.start() > at:
            buf.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, end = name.lower(), (m[1] or m[4]) == "/"
        if end:
            if name == "p" or name in BLOCK:
                flush()
            if name == "br":
                buf.append(" ")
                continue
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
                if (name not in BLOCK and stack[k].name in BLOCK) or (name == "p" and stack[k].name in ("article", "section", "div", "td", "body", "main")):
                    break
            continue
        if name == "br":
            buf.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES_P and opened["p"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == "p":
                        close(k)
                        break
                    if stack[k].name in BLOCK:
                        break
            if name in SIBLINGS and any(opened[x] for x in SIBLINGS[name]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name in FENCES[name]:
                        break
                    if stack[k].name in SIBLINGS[name]:
                        close(k)
                        if not any(opened[x] for x in SIBLINGS[name]):
                            break
        if name in VOID:
            continue
        raw = m[3] if m[2] else m[6]
        if name in RAW:
            gone = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = gone.end() if gone else size
            continue
        if raw.endswith("/") and name in ("svg", "path", "use", "g", "rect", "circle"):
            continue
        attrs = _attributes(raw) if raw and not raw.isspace() else {}
        top = stack[-1] if stack else None
        inside = top is not None and top.in_main
        dropped = (top is not None and top.dropped) or _is_furniture(name, attrs, inside)
        main = not dropped and not inside and (name in MAIN or attrs.get("role", "").lower() == "main" or "articlebody" in attrs.get("itemprop", "").lower())
        if name in PROSE:
            e = top
            while e is not None and not e.prose:
                e.prose, e = True, e.parent
        if name not in BLOCK:
            cut()
        opened[name] += 1
        words = set() if dropped else _furniture_words(name, attrs, inside)
        stack.append(_Open(name, dropped, main, inside or main, top, words, f"<{name} {attrs.get('class', '')}"))
    flush()
    close(0)
    whole = sum(x[4] for x in pieces)

    def depth(e: _Open | None) -> int:
        """Elements named as furniture around a block; one with prose and over half of the page's text is none, unless the article is elsewhere."""
        path = []
        while e is not None and e.named and e.level is None:
            path.append(e)
            e = e.parent
        n = e.level if e is not None and e.named else 0
        for x in reversed(path):
            n += bool(x.words) and not (x.prose and 2 * x.kept > whole and not x.words & OTHERS and (x.in_main or not clear))
            x.level = n
        return n

    # Whether an article stands outside all elements named as furniture.
    clear = any(in_main and not top.named for _, top, in_main, _, _ in pieces)
    depths = [depth(x[1]) for x in pieces]
    least = min((d for x, d in zip(pieces, depths, strict=True) if x[2] and x[4]), default=None)
    bare = _blocks(x for x, d in zip(pieces, depths, strict=True) if not d)
    main = _blocks(x for x, d in zip(pieces, depths, strict=True) if x[2] and d == least)
    # A wrapper named as furniture may hold the page's article, or the teasers beside a longer text.
    if main and (not least or sum(len(x[0]) for x in main) >= sum(len(x[0]) for x in bare)):
        blocks = _titles(bare, main) + main
    else:
        blocks = bare
    total = sum(len(x[0]) for x in blocks)
    out = []
    for text, top, _ in blocks:
        keys, e = [], top.near if top is not None else None
        while e is not None:
            if e.key is not None and 2 * e.chars <= total:
                keys.append(e.key)
            e = e.parent
        out.append((text, keys))
    return out, list({e.key for e in closed if 2 * e.chars <= total or e.dropped or depth(e)})


def _blocks(pieces: Iterator[tuple]) -> list[tuple[str, _Open | None, bool]]:
    """Pieces of one block put together, white space as one space; blocks without text go."""
    out: list[list] = []
    for raw, top, in_main, line, _ in pieces:
        if out and out[-1][3] == line:
            out[-1][0].append(raw)
        else:
            out.append([[raw], top, in_main, line])
    texts = [(" ".join("".join(raws).split()), top, in_main) for raws, top, in_main, _ in out]
    return [x for x in texts if x[0]]


def _within(e: _Open | None, name: str) -> bool:
    while e is not None and e.name not in BLOCK:
        e = e.parent
    return e is not None and e.name == name


def _titles(bare: list, main: list) -> list:
    """A main heading right before an article that has none of its own."""
    if any(_within(top, "h1") for _, top, _ in main):
        return []
    first = next((k for k, x in enumerate(bare) if x[2]), 0)
    return [x for x in bare[max(0, first - 1) : first] if _within(x[1], "h1")]


def _parse_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = pa.struct([("text", pa.string()), ("keys", pa.list_(pa.int64()))])
    schema = pa.schema([
        ("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("main", pa.int64()), ("blocks", pa.list_(block)),
        ("plain", pa.bool_()), ("keys", pa.list_(pa.int64())),
    ])
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        rows = []
        for html, url in zip(batch.column(2), batch.column(1).to_pylist(), strict=True):
            host = host_of(url)
            blocks, keys = parse(html.as_py())
            plain = host is None or not any(k for _, k in blocks)
            main = xxhash.xxh64_intdigest("\n".join(t for t, _ in blocks)) - (1 << 63)
            rows.append((row, host, main, [{"text": t, "keys": k} for t, k in blocks], plain, keys if host else []))
            row += 1
        if rows:
            numbers, *others = zip(*rows, strict=True)
            yield batch_of(schema, numbers, batch.column(0), batch.column(1), *others)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.1) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page.

    Text without main text, and null html, is the empty string. Pages without a host take part in no template. Repeated
    rows are pages of their own; null ids stay; an empty table gives an empty result; other columns are ignored.
    """
    col = lambda n, t: F.col(f"`{n}`").cast(t)
    rows = pages.select(col(id_col, "long").alias("page_id"), col(url_col, "string").alias("url"), col(html_col, "string").alias("html"))
    kind = "row long, page_id long, url string, host string, main long, blocks array<struct<text: string, keys: array<long>>>, plain boolean, keys array<long>"
    parsed = written(rows.mapInArrow(_parse_task, kind), "html-blocks")
    # A host with a third of all pages is no burden: its rows are dealt by key and main text before they are counted.
    hosts = parsed.filter("host IS NOT NULL").select("host", "main").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    large = written(hosts.filter(F.col("pages") * min_share > min_pages), "html-hosts")  # elsewhere min_pages decides
    seen = parsed.select("host", "main", F.explode("keys").alias("key")).distinct().groupBy("host", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    seen = seen.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "host", "left")
    template = seen.filter(F.col("n") >= F.coalesce(F.col("pages") * min_share, F.lit(0.0))).select("host", "key")
    # Written, so that pages around one site's footer can be split over tasks in the join.
    template = written(template, "html-template")
    template = F.broadcast(template) if template.count() <= BROADCAST_ROWS else template
    around = parsed.filter("NOT plain").select("row", "host", F.explode(F.array_distinct(F.flatten("blocks.keys"))).alias("key"))
    gone = around.join(template, ["host", "key"]).groupBy("row").agg(F.collect_set("key").alias("gone"))
    text = lambda b: F.array_join(F.transform(b, lambda x: x["text"]), "\n")
    plain = parsed.filter("plain").select("page_id", "url", text(F.col("blocks")).alias("text"))
    left = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["keys"], F.col("gone")), F.lit(False)))
    rest = parsed.filter("NOT plain").drop("keys").join(gone, "row", "left").select("page_id", "url", text(left).alias("text"))
    return plain.unionByName(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
