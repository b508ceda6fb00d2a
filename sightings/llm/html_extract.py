"""Main text of pages by equivalence-class templates (operator 5).

Pages of a host come from a few templates. A token is a tag or a run of text together with its path
of open elements (its role). Tokens that occur equally often on each page of a host share their
occurrence vector and form an equivalence class; large, frequent classes are what the template wrote,
and the rest is what was filled in. Vectors are never gathered: a token's vector is summed up by an
order-free hash of its (page, count) pairs, combined map-side, so a host with a third of all pages is
spread like any other. Equal pages count once. A class is valid if its paths nest: each lies on, or
below, a path of the class around it. Valid classes nested by path are the host's template; their
text tokens are the template's own words, and all other text sits in slots.

A slot is main text unless an element around it says otherwise: navigation, header, footer, aside,
form, script, style, an advert, notice, comment or the like, by tag, role, class or id. If a page marks
its article (article, main, role=main, itemprop=articleBody), only slots within count. The template's
words are left out: outside an article each of them, within one those in a box (div, section, list,
table or the like) that holds no other text. A line that the host repeats in the article's own flow,
or in a box with text of the page, is kept.

White space within a block becomes one space, blocks are trimmed, empty ones left out, the rest
joined by one line break. Inline tags and line breaks (br) don't end a block.

Rules for odd rows: a null or empty html has no text; html without tags is one block; a url without a
host is a host of its own kind (empty); tags that are never closed are closed by their parent;
repeated rows each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.llm.common import stage

MIN_PAGES = 3
MIN_SHARE = 0.5  # of a host's distinct pages
MIN_TOKENS = 2

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                    "small span strike strong sub sup time tt u var wbr".split())
#: elements that a template fills as a whole within an article
_BOXES = frozenset("div section ul ol dl table figure blockquote details fieldset center address hgroup".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
#: elements whose text is never main text
_DROP = frozenset("script style noscript template textarea title head iframe nav footer aside form button select option svg "
                  "dialog menu object canvas audio video noembed noframes".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: words of a class or id that say the same
_DROP_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer ad ads adbox advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations comment comments respond disqus "
    "pagination pager login search widget toolbar skip".split())
_P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                       "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[^a-z0-9]+")


def events(source: str) -> Iterator[tuple[str, str, str]]:
    """("text", its raw content, ""), ("open", tag, attributes), ("raw", content, "") after a tag like
    script, and ("close", tag, "") in page order."""
    at, look, low = 0, 0, None
    while at < len(source):
        spot = source.find("<", look)
        m = _TOKEN.match(source, spot) if spot >= 0 else None
        if m is None and spot >= 0:  # a bare <
            look = spot + 1
            continue
        end = spot if m else len(source)
        if end > at:
            yield "text", source[at:end], ""
        if m is None:
            return
        at = look = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, m[3] or ""
        if tag in _RAW:
            low = source.lower() if low is None and len(source.lower()) == len(source) else low
            found = (low or source).find(f"</{tag}", at)
            found = len(source) if found < 0 else found
            if found > at:
                yield "raw", source[at:found], ""
            at = look = found


@lru_cache(maxsize=1 << 14)
def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool, str]:
    """(excluded, only excluded outside an article, marks the article, name in paths) of an element."""
    found = {}
    for k, v in _ATTR.findall(attrs):
        found.setdefault(k.lower(), html.unescape(v.strip("\"'")).lower())
    words = {w for k in ("class", "id") for w in _WORDS.split(found.get(k, "")) if w}
    role = found.get("role", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
    drop = tag in _DROP or role in _DROP_ROLES or bool(words & _DROP_WORDS) or hidden
    article = not drop and (tag in ("article", "main") or role == "main" or "articlebody" in found.get("itemprop", ""))
    name = ".".join([tag, *sorted(words)])
    return drop and tag not in ("html", "body"), tag == "header" or "header" in words, article, name


def walk(source: str) -> Iterator[tuple[str, str, str, bool, bool, bool]]:
    """(kind, path, content, excluded, in an article, ends a block) for each tag and run of text."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, excluded, in an article

    def close_to(depth: int):
        while len(stack) > depth:
            tag, path, drop, article = stack.pop()
            yield "close", path, tag, drop, article, tag not in _INLINE

    for kind, what, attrs in events(source):
        path, drop, article = stack[-1][1:] if stack else ("", False, False)
        if kind == "text":
            yield "text", path, what, drop, article, False
        elif kind == "raw":
            yield "raw", path, what, True, article, False
        elif kind == "open":
            if what in _P_CLOSERS or what == "li":
                # a paragraph, or an item of the same list, ends here
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == ("li" if what == "li" else "p"):
                        yield from close_to(depth)
                        break
                    if stack[depth][0] not in _INLINE and stack[depth][0] != "p":
                        break
                path, drop, article = stack[-1][1:] if stack else ("", False, False)
            own, outside, marks, name = _marks(what, attrs)
            article = article or (marks and not drop)
            drop = drop or own or (outside and not article)
            here = f"{path}/{name}"
            yield "open", here, what, drop, article, what not in _INLINE
            if what not in _VOID and not attrs.rstrip().endswith("/"):
                stack.append((what, here, drop, article))
        else:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == what:
                    yield from close_to(depth)
                    break
    yield from close_to(0)


def _name(raw: str) -> str:
    """A run of text as a token: its hash, as only equality counts."""
    return xxhash.xxh64_hexdigest(raw.strip().encode("utf-8", "surrogatepass"))


def main_text(source: str | None, constants: frozenset[tuple[str, str]] | set = frozenset()) -> str:
    """The slots that are main text, block by block. ``constants``: (path, text) of the template's words."""
    if not source:
        return ""
    blocks: list[tuple[list[str], bool]] = []  # pieces, in an article
    cur: list[str] = []
    marked = False
    state = False
    root = None  # path of the element that marks the article
    boxes: list[list] = []  # path, blocks before it, has words of the template, has other text

    def flush() -> None:
        if cur:
            blocks.append((list(cur), state))
            cur.clear()

    def close_box(path: str) -> None:
        while boxes:
            at, first, words, other = boxes.pop()
            if at == path and words and not other:
                del blocks[first:]
            if boxes:
                boxes[-1][2] |= words
                boxes[-1][3] |= other
            if at == path:
                return

    for kind, path, what, drop, article, ends in walk(source):
        if kind in ("open", "close"):
            marked |= kind == "open" and article
            if ends:
                flush()
            elif what == "br":
                cur.append(" ") if cur else None
            if article and root is None and kind == "open" and what not in _VOID:
                root = path
            elif path == root:
                root = None if kind == "close" else root
            elif constants and article and kind == "open" and what in ("article", "main") and boxes:
                boxes[-1][3] = True
            elif constants and article and what in _BOXES:
                if kind == "open":
                    boxes.append([path, len(blocks), False, False])
                elif any(b[0] == path for b in boxes):
                    close_box(path)
        elif kind == "text" and not drop:
            if article != state:
                flush()
                state = article
            own = not constants or (path, _name(what)) not in constants
            if article and boxes and what.strip():
                boxes[-1][3 if own else 2] = True
            if article or own:
                cur.append(html.unescape(what))
    flush()
    out = (" ".join("".join(pieces).split()) for pieces, article in blocks if article or not marked)
    return "\n".join(t for t in out if t)


def tokens(source: str | None) -> Counter:
    """(kind, path, text) of a page's tokens and how often each occurs; text is a hash, empty for tags."""
    out: Counter = Counter()
    for kind, path, what, _, _, _ in walk(source or ""):
        if kind in ("open", "close"):
            out[kind, path, ""] += 1
        elif kind == "text" and what.strip():
            out["text", path, _name(what)] += 1
    return out


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#\s]*)", 1)), F.lit(""))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, classes) of pages (host, html): the valid classes of each host, outermost first.

    A class is (pages, path, paths, words): on how many pages, its outermost path, the paths of its
    tags, and its (path, text) tokens. Per host there are at most 1/min_share as many frequent tokens
    as a page has on average, which bounds the lists."""
    known = pages.select("page_id", "host", F.xxhash64("html").alias("page"), "html").filter("html is not null and html <> ''")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host, page, source in zip(b["host"].to_pylist(), b["page"].to_pylist(), b["html"].to_pylist()):
                rows += [(host, page, kind, path, text, n) for (kind, path, text), n in tokens(source).items()]
            for at in range(0, len(rows), 1 << 15):
                cols = list(zip(*rows[at:at + (1 << 15)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))],
                                                 names=["host", "page", "kind", "path", "text", "n"])

    # equal pages but the first are left out, by their ids, so that no html is moved for it
    first = known.groupBy("host", "page").agg(F.min("page_id").alias("first_id"))
    size = first.groupBy("host").agg(F.count("*").alias("host_pages"))
    spare = stage(known.select("page_id", "host", "page").join(first, ["host", "page"]).filter("page_id > first_id")
                  .select("page_id", "page").distinct(), "html-copies")
    distinct = known.join(spare, ["page_id", "page"], "left_anti")
    found = distinct.select("host", "page", "html").mapInArrow(emit, "host string, page bigint, kind string, path string, text string, n bigint")
    # the occurrence vector of a token, as order-free sums over two hashes of its (page, count) pairs
    low = F.lit((1 << 31) - 1)
    per_token = found.withColumn("h", F.xxhash64("page", "n")).groupBy("host", "kind", "path", "text").agg(
        F.struct(F.sum(F.col("h").bitwiseAND(low)), F.sum(F.shiftright("h", 31).bitwiseAND(low))).alias("vector"),
        F.count("*").alias("on_pages"), F.sum("n").alias("total"))
    frequent = per_token.join(size, "host").filter((F.col("on_pages") >= min_pages) & (F.col("on_pages") >= min_share * F.col("host_pages")))
    token = F.struct(F.length("path").alias("depth"), "path", "kind", "text")
    classes = (frequent.groupBy("host", "vector", "on_pages", "total").agg(F.sort_array(F.collect_list(token)).alias("tokens"))
               .filter(F.size("tokens") >= MIN_TOKENS))
    top = F.col("tokens")[0]["path"]
    tags = F.array_distinct(F.transform(F.filter("tokens", lambda t: t["kind"] != "text"), lambda t: t["path"]))
    words = F.transform(F.filter("tokens", lambda t: t["kind"] == "text"), lambda t: F.struct(t["path"].alias("path"), t["text"].alias("text")))
    balanced = F.forall(tags, lambda p: F.size(F.filter("tokens", lambda t: (t["path"] == p) & (t["kind"] != "text"))) == 2)
    # sound: each tag of the class is opened and closed, or (void tags, words) only stands inside it
    sound = classes.select("host", "on_pages", top.alias("path"), tags.alias("paths"), words.alias("words"), balanced.alias("balanced"))
    listed = sound.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(
        F.length("path").alias("depth"), "path", "on_pages", "balanced", "paths", "words"))).alias("classes"))

    # nested: its outermost path lies on a path of a class before it (or it has none before it)
    def nest(acc, c):
        inside = (F.size(acc["paths"]) == 0) | F.exists(acc["paths"], lambda p: (c["path"] == p) | c["path"].startswith(F.concat(p, F.lit("/"))))
        return F.when(inside, F.struct(
            F.array_union(acc["paths"], c["paths"]).alias("paths"), F.concat(acc["kept"], F.array(c)).alias("kept"))).otherwise(acc)

    kind = listed.schema["classes"].dataType.simpleString()
    start = F.struct(F.array().cast("array<string>").alias("paths"), F.array().cast(kind).alias("kept"))
    return listed.select("host", F.aggregate("classes", start, nest)["kept"].alias("classes"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    made = stage(templates(rows, min_pages, min_share), "html-templates")
    words = made.select("host", F.flatten(F.transform("classes", lambda c: c["words"])).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[str, frozenset] = {}
            texts = []
            for host, source, w in zip(b["host"].to_pylist(), b["html"].to_pylist(), b["words"]):
                if host not in sets:
                    sets[host] = frozenset((x["path"], x["text"]) for x in (w.as_py() or ()))
                texts.append(main_text(source, sets[host]))
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return rows.join(words, "host", "left").select("page_id", "url", "host", "html", "words").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")


def op5(pages: DataFrame) -> DataFrame:
    return extract(pages)
