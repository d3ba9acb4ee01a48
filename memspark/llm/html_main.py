"""HTML extraction by site template removal: subtrees of elements are hashed, Spark counts on how many pages of a host
each hash occurs, and subtrees that recur across many pages of their host are deleted.

A subtree has two hashes. One is of its tags and text: what recurs word for word is a template. One is of its shape, tags
and names without text: what recurs in shape beside the articles of a host (a menu, an advert, a footer, the readers'
comments) is a template too, though its words change.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .url_cascade import parts

MARKUP = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)

# Names of HTML elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var nobr wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dl dt dd blockquote pre figure figcaption ul ol table tbody thead tr td th body html article main".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav aside footer form button select textarea "
    "dialog menu title".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
SLOTS = frozenset("nav aside footer header form section menu dialog".split())
# Whole classes, ids and roles, without a number at their end, that mark what is not the article. The first
# mark adverts and comments inside an article as well, the others beside it alone.
ASIDE = frozenset(
    "ad ads advert adverts advertisement advertisements adsense ad-banner ad-container ad-slot sponsor sponsored "
    "comment comments comment-list comment-body comment-form comments-area comments-section disqus disqus_thread "
    "share sharing share-buttons social-share sharedaddy".split()
)
NOT_ARTICLE = ASIDE | frozenset(
    "respond reply banner promo promotion cookie cookies cookie-notice cookie-banner cookie-consent cookie-bar consent gdpr notice notices "
    "alert popup modal overlay newsletter newsletter-signup subscribe subscription signup login sidebar widget widgets "
    "widget-area nav navbar navigation nav-menu menu main-menu breadcrumb breadcrumbs header page-header site-header footer "
    "page-footer site-footer social social-links related related-posts related-articles recommended pagination pager toolbar "
    "masthead contentinfo complementary search search-form search-box skip skip-link".split()
)
COMMENT = frozenset("comment comments comment-body reply".split())
NUMBER = re.compile(r"[-_]?\d+$")


@dataclass
class Page:
    """Elements of a page in the order they open, and its text with the element that holds it."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    why: list[int] = field(default_factory=list)  # as `unwanted` says
    named: list[bool] = field(default_factory=list)  # has a class, id or role
    mains: list[bool] = field(default_factory=list)  # lies in an article or main element
    main_roles: list[int] = field(default_factory=list)
    hashes: list[int] = field(default_factory=list)
    shapes: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str]] = field(default_factory=list)

    def below(self, chosen: set[int]) -> list[bool]:
        """Which elements are chosen or lie in a chosen one."""
        out: list[bool] = []
        for i, above in enumerate(self.parents):
            out.append(i in chosen or above >= 0 and out[above])
        return out

    def around(self, chosen: set[int]) -> list[bool]:
        """Which elements are chosen or hold a chosen one."""
        out = [i in chosen for i in range(len(self.tags))]
        for i in range(len(self.tags) - 1, 0, -1):
            if out[i]:
                out[self.parents[i]] = True
        return out

    def sizes(self, kept: list[tuple[int, str]]) -> list[int]:
        """Characters of text in each element."""
        out = [0] * len(self.tags)
        for i, raw in kept:
            out[i] += len(raw.strip())
        for i in range(len(self.tags) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out


def unwanted(tag: str, attributes: str, in_main: bool, in_pre: bool) -> tuple[int, str]:
    """Why an element is no article: 0 for no reason, 1 for its tag or as it is hidden, 2 for a name that holds inside an
    article too, 3 for one that holds outside alone; and its names."""
    why = int(tag in DROPPED or tag == "header" and not in_main)
    if not attributes or tag in ("html", "body", "main"):
        return why, ""
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            why = 1
        elif name in ("class", "id", "role"):
            names |= {NUMBER.sub("", x) for x in value.split()}
    if not why and not in_pre and tag not in INLINE:
        if tag == "article":
            why = 2 * (not COMMENT.isdisjoint(names))
        elif not ASIDE.isdisjoint(names):
            why = 2
        elif not NOT_ARTICLE.isdisjoint(names):
            why = 3
    return why, " ".join(sorted(names))


def by_names(page: Page) -> list[bool]:
    """Which elements their tags and names drop, on every host alike.

    A name drops nothing that holds the page's main or article: its main elements, else, if no article is outside of named
    elements, its articles. Of what it holds, only these stay. One that holds outside alone drops nothing in an article, or
    in a main without articles."""
    tags, why, n = page.tags, page.why, len(page.tags)
    if not any(w > 1 for w in why):
        return [w == 1 for w in why]
    hard = page.below({i for i in range(n) if why[i] == 1})
    filled = page.around({i for i, raw in page.pieces if not hard[i] and raw.strip()})
    named = page.below({i for i in range(n) if why[i] > 1})
    live = [filled[i] and not hard[i] for i in range(n)]
    articles = {i for i in range(n) if tags[i] == "article" and live[i] and not why[i]}
    mains = {i for i in range(n) if tags[i] == "main" and live[i]} | {i for i in page.main_roles if live[i]}
    core = articles if not mains and articles and all(named[i] for i in articles) else mains
    held, kept = page.around(core), page.below(core)
    busy = page.around(articles)
    inner = page.below({i for i in range(n) if tags[i] == "article" and not why[i]} | {i for i in mains if not busy[i]})
    inside = [page.parents[i] >= 0 and inner[page.parents[i]] for i in range(n)]
    beside = page.below({i for i in range(n) if why[i] > 1 and held[i] and not kept[i]})
    return [w == 1 or w > 1 and not held[i] and not (w == 3 and inside[i]) or beside[i] and not held[i] and not kept[i] for i, w in enumerate(why)]


def parse(html: str) -> Page:
    page = Page()
    tags, parents, mains, hashes, pieces = page.tags, page.parents, page.mains, page.hashes, page.pieces
    stack: list[int] = []
    signs: list[list[bytes]] = []
    outlines: list[tuple[str, set[int]]] = []
    places: dict[str, list[int]] = {}  # by tag, where in the stack its open elements are
    blocks: list[int] = []  # where those are that are not inline

    def opens(tag: str, attributes: str) -> None:
        above = stack[-1] if stack else -1
        is_main = 'role="main"' in attributes
        in_main = above >= 0 and mains[above] or tag in ("article", "main") or is_main
        if is_main and tag != "main":
            page.main_roles.append(len(tags))
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            blocks.append(len(stack))
        stack.append(len(tags))
        signs.append([tag.encode()])
        why, names = unwanted(tag, attributes, in_main, bool(places.get("pre")))
        outlines.append((f"{tag} {names}", set()))
        tags.append(tag)
        parents.append(above)
        page.why.append(why)
        page.named.append(bool(names))
        mains.append(in_main)
        hashes.append(0)
        page.shapes.append(0)

    def closes() -> None:
        own = xxhash.xxh3_64_intdigest(b"\x1f".join(signs.pop()))
        i = stack.pop()
        places[tags[i]].pop()
        if tags[i] not in INLINE:
            blocks.pop()
        hashes[i] = own
        head, inner = outlines.pop()
        shape = page.shapes[i] = xxhash.xxh3_64_intdigest(f"{head} {sorted(inner)}".encode("utf-8", "surrogatepass"))
        if signs:
            signs[-1].append(own.to_bytes(8, "little"))
            if tags[i] not in INLINE:
                outlines[-1][1].add(shape)

    def cut(k: int) -> None:
        while len(stack) > k:
            closes()

    def last(names) -> int:
        """Where in the stack the innermost open element with one of these tags is, 0 if there is none."""
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def text(raw: str) -> None:
        if raw and stack:
            raw = unescape(raw) if "&" in raw else raw
            pieces.append((stack[-1], raw))
            signs[-1].append(" ".join(raw.split()).encode("utf-8", "surrogatepass"))

    opens("html", "")
    at = 0
    while True:
        m = MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if k := last((tag,)):
                cut(k)
                pieces.append((stack[-1], "" if tag in INLINE else " "))
            continue
        if tag == "html":
            continue
        if tag in VOID:
            pieces.append((stack[-1], "" if tag in ("img", "wbr") else " "))
            signs[-1].append(tag.encode())
            continue
        if tag == "body":
            while len(stack) > 1 and tags[stack[-1]] == "head":
                closes()
        elif tag in CLOSES_P and tags[stack[blocks[-1]]] == "p":
            cut(blocks[-1])
        if tag in SIBLINGS:
            scope = last(SCOPE[tag])
            k = last((tag,)) if tag == "tr" else 0
            k = k if k > scope else last(SIBLINGS[tag])
            if k > scope:
                cut(k)
        if tag not in INLINE:
            pieces.append((stack[-1], " "))
        opens(tag, m[3])
        if m[3].endswith("/") and tag in ("svg", "math", "path", "use", "circle", "rect"):
            closes()
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
            signs[-1].append(html[at : end.start()].encode("utf-8", "surrogatepass"))
            at = end.end()
            closes()
    while stack:
        closes()
    return page


def gather(page: Page, templates: frozenset[int] = frozenset()) -> str:
    """The page's text without what tags and names drop and without templates. A template that holds half of the text or
    more stays, with all below it, unless it lies beside an article."""
    n = len(page.tags)
    dropped = by_names(page)
    gone = page.below({i for i in range(n) if dropped[i]})
    kept = [(i, raw) for i, raw in page.pieces if not gone[i]]
    if templates:
        hits = {i for i in range(n) if page.hashes[i] in templates and countable(page, i)}
        shaped = {i for i in slots_of(page) if page.shapes[i] in templates}
        if hits or shaped:
            sizes = page.sizes(kept)
            framed = any(page.mains[i] and sizes[i] for i in range(n))  # then what lies beside it may be any size
            spared = page.below({i for i in hits | shaped if 2 * sizes[i] >= sizes[0] and not (framed and not page.mains[i])})
            cut = page.below({i for i in hits | shaped if not spared[i]})
            kept = [(i, raw if spared[i] or not cut[i] else " ") for i, raw in kept]
    return " ".join("".join(raw for _, raw in kept).split())


def slots_of(page: Page) -> list[int]:
    """Elements beside the page's article or main, not around it, whose shape may be a template: containers with a name,
    and those whose tag says that they are a part of the frame."""
    held = page.around({i for i, t in enumerate(page.tags) if t in ("article", "main") or i in page.main_roles})
    return [
        i
        for i, t in enumerate(page.tags)
        if not page.mains[i] and not held[i] and (page.named[i] or t in SLOTS) and t not in PROSE and t not in INLINE and t != "head"
    ]


def countable(page: Page, i: int) -> bool:
    """Whether an element may be a template: of those in a main or article, containers alone, never prose."""
    tag = page.tags[i]
    if tag in ("html", "body", "head", "article", "main") or tag in INLINE and tag != "ins":
        return False
    return not (page.mains[i] and tag in PROSE)


CONTAINER, PROSE_BLOCK, SLOT = 0, 1, 2
ALL_PAGES, FRAMED_PAGES = 0, 1  # hashes that every page, and every page with an article or main, has


def subtree_rows(host: str, page: Page) -> list[tuple[str, int, int, int]]:
    """(host, hash, context, kind) of each element that may be a template, and a row or two for the page.

    The context is a hash of the page's text: copies of a page count as one page, so that what recurs with its whole
    page is not taken for a template."""
    context = signed(xxhash.xxh3_64_intdigest(gather(page).encode("utf-8", "surrogatepass")))
    found = {page.hashes[i]: PROSE_BLOCK if page.tags[i] in PROSE else CONTAINER for i in range(len(page.tags)) if countable(page, i)}
    rows = [(host, ALL_PAGES, context, CONTAINER), *((host, signed(h), context, kind) for h, kind in found.items())]
    if any(page.mains):
        rows += [(host, FRAMED_PAGES, context, SLOT), *((host, signed(h), context, SLOT) for h in {page.shapes[i] for i in slots_of(page)})]
    return rows


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def templates_of(pages: DataFrame, least: int, share: float, slot_share: float) -> DataFrame:
    """(host, hash) of the subtrees that recur: on the share of a host's pages of different text, and on `least` of them
    at least, or 5 if they are prose outside of any article; shapes on slot_share of its pages with an article."""

    def run(batches):
        for b in batches:
            rows = []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += subtree_rows(parts(url)[0], parse(html or ""))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "hash", "context", "kind"])

    rows = pages.select("url", "html").mapInArrow(run, "host string, hash long, context long, kind int")
    counts = rows.distinct().groupBy("host", "hash", "kind").agg(F.count(F.lit(1)).alias("pages"))
    of_pages = F.col("hash").isin(ALL_PAGES, FRAMED_PAGES)
    recurring = materialize(counts.where((F.col("pages") >= least) | of_pages), "subtrees")  # read twice
    totals = recurring.where(of_pages).groupBy("host").agg(
        F.max(F.when(F.col("hash") == ALL_PAGES, F.col("pages"))).alias("total"),
        F.max(F.when(F.col("hash") == FRAMED_PAGES, F.col("pages"))).alias("framed"),
    )
    held = recurring.where(~of_pages).join(totals, "host")
    floor = (
        F.when(F.col("kind") == SLOT, F.greatest(F.lit(least), slot_share * F.col("framed")))
        .when(F.col("kind") == PROSE_BLOCK, F.greatest(F.lit(5), share * F.col("total")))
        .otherwise(F.greatest(F.lit(least), share * F.col("total")))
    )
    return held.where(F.col("pages") >= floor).select("host", "hash")


def main_text(pages: DataFrame, least: int = 3, share: float = 0.3, slot_share: float = 0.05, broadcast_rows: int = 200_000) -> DataFrame:
    """Extract the main text of every page from its whole html.

    Returns page_id, url, text, n_chars. The text is what the host's templates, the tags of menus, forms, scripts and the
    like, and elements whose class, id or role says that they are no article leave of the page. Tags and names are judged
    alike on a host of any size, so other pages change a page's text by what recurs on them alone.
    References are decoded, white space in a block becomes one space, blocks are joined by one space. Null and empty html
    give an empty text; a null url is a page of host "". Repeated rows are handled alike and count as one page; an empty
    table gives an empty table. Broken and deeply nested html takes time in proportion to its length.

    Counting is a partial aggregate over (host, hash, page text), so a host with a third of all pages is no one task's.
    The templates are broadcast if there are at most broadcast_rows; beyond, each page's own are joined to it.
    """
    slim = pages.select("page_id", "url", "html")
    templates = materialize(templates_of(slim, least, share, slot_share), "templates")
    schema = T.StructType([slim.schema["page_id"], slim.schema["url"], *T._parse_datatype_string("text string, n_chars long").fields])

    def result(b, texts):
        arrays = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    if templates.limit(broadcast_rows + 1).count() <= broadcast_rows:
        known: dict[str, set[int]] = {}
        for host, h in templates.collect():
            known.setdefault(host, set()).add(h % (1 << 64))
        sets = {host: frozenset(hs) for host, hs in known.items()}

        def run(batches):
            for b in batches:
                rows = zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True)
                yield result(b, [gather(parse(html or ""), sets.get(parts(url)[0], frozenset())) for url, html in rows])

        return slim.mapInArrow(run, schema)

    def own(batches):
        for b in batches:
            rows = set()
            for key, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                host = parts(url)[0]
                rows |= {(key, host, h) for _, h, _, _ in subtree_rows(host, parse(html or ""))}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["key", "host", "hash"])

    keyed = slim.withColumn("__ms_key", F.xxhash64("url", "html"))
    hits = keyed.select("__ms_key", "url", "html").mapInArrow(own, "key long, host string, hash long").join(templates, ["host", "hash"])
    held = hits.groupBy(F.col("key").alias("__ms_key")).agg(F.collect_set("hash").alias("__ms_hashes"))

    def apply(batches):
        for b in batches:
            rows = zip(b.column("html").to_pylist(), b.column("__ms_hashes").to_pylist(), strict=True)
            yield result(b, [gather(parse(html or ""), frozenset(h % (1 << 64) for h in hs or ())) for html, hs in rows])

    return keyed.join(held, "__ms_key", "left").mapInArrow(apply, schema)
