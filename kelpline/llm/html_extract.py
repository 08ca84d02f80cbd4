"""Main text of web pages by template deduction over the pages of a host.

1. Each page is read as a tree of block elements.  A node's role is the hash of its
   path of elements, with classes, ids or places; a text belongs to the role that holds it.
2. For each host and tag, or text of a role, the occurrence vector (how often it
   occurs on each page) is summed up as a fingerprint, which combines before the
   shuffle.  Tokens of a host with one fingerprint are an equivalence class; a class
   is valid if it holds a tag and enough of the host's pages.
3. Valid classes nest as their tags do and are the host's template: its texts are
   fixed, its tags are nodes with the measures of the slots below them: their share
   of a page's text, their unlinked characters a page, their links.
4. On each page the template is walked from the root into the node that holds most of
   its host's text, as long as one does.  The article is the outermost node of that way
   that is an article, else main, else named as content, else the innermost that also
   holds the page's title, else the way's end.  All its slots are content, whatever their
   share, but those beside the way that are mostly links.  A slot outside it is content
   if it holds as much as LEAST_SHARE of the article and isn't mostly links; a title (h1)
   that isn't fixed is content, too.
5. Fixed texts outside the article go; inside it those that stand bare in a container,
   and containers of fixed texts alone, unless these are headings.  Fixed headings,
   paragraphs and cells beside texts that vary stay: they are the author's.
6. Names only support this: elements that HTML marks as no content (nav, footer, aside,
   forms and the like) are left out, and so are containers named as menus, adverts or
   comments: beside the main slot by any part of a class, id or role, inside it by
   whole ones; paragraphs, lists and headings are never judged by names.

Pages of a host with too few pages share one template, deduced over the tags of all
hosts.  A page of which fixed texts leave nothing (copies of one page look like a
template) keeps them.  If there are fewer pages than LEAST_PAGES in all, nothing is
known of templates, and only what HTML marks as no content goes.

No host is gathered in a task: a host's table holds a row a token that at least
SUPPORT of its pages have, so it is bounded by a page's size divided by SUPPORT.
Reading takes time in proportion to a page's length, however broken it is.

Defined cases: a null or empty page has no text; a page whose url has no host shares
the host ''; unclosed and misplaced tags are read as browsers do, roughly; an element
such as video or select that isn't closed anywhere is taken as empty.
"""

from __future__ import annotations

import html
import re
import struct
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.text import require, slices
from kelpline.plans.checkpoints import checkpointed

# No alternative can go back over what it has read, and none reads past a "<" before it has matched.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))|(?<![a-zA-Z-])(hidden)(?![a-zA-Z-])""")
UNSEEN, DIGITS = re.compile(r"display\s*+:\s*+none", re.I), re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that don't end a block of text.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page; that of the first has no tags, the head's ends before other elements.
UNTAGGED = frozenset("script style textarea title".split())
RAW = frozenset("noscript template iframe object svg math head select canvas audio video".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
NOT_CONTENT = frozenset("nav footer aside form button menu dialog fieldset".split())
#: Elements that end an open one of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")} | {k: ("p",) for k in "div section article aside nav header footer main ul ol dl table form h1 h2 h3 h4 h5 h6 blockquote pre figure hr fieldset".split()}
#: Elements that a p or li can't close through.
SCOPE = frozenset("html body div section article aside nav header footer main ul ol dl table td th form blockquote figure".split())
#: Containers without a name that are told apart by their place.
PLACED = frozenset("div section table td".split())
#: Containers whose names are looked at.
NAMED = frozenset("div section aside header ul ol dl table".split())
WORDS = r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|sidebar|side|menu|nav\w*|breadcrumbs?|toolbar|topbar|header|masthead|footer|foot|copyright|legal|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|comments?|respond|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search|pagination|pager|skip|widget|complementary|contentinfo|navigation)"
PART, WHOLE_NAME = re.compile(rf"(?:^|[\s_-]){WORDS}(?:$|[\s_-])", re.I), re.compile(WORDS, re.I)

CONTENT_NAME = re.compile(r"(?:main|page|post|entry|article|story)?[_-]?(?:content|article|post|entry|story|body)|main", re.I)

#: What an element itself tells: no content by HTML; a header, which is content inside the main slot; a part of a name; a whole one.
NO_CONTENT, HEADER, NAME_PART, NAME = 1, 2, 4, 8
#: An article; main; named as content; a title; any heading; a container; the page itself.
ARTICLE, MAIN, CONTENT, TITLE, HEADING, CONTAINER, PAGE = 16, 32, 64, 128, 256, 512, 1024
OF_ELEMENT = {"article": ARTICLE, "main": MAIN, "html": PAGE, "body": PAGE, "h1": TITLE | HEADING} | dict.fromkeys("h2 h3 h4 h5 h6".split(), HEADING)
#: Share of its host's text that a node must hold to be walked into; of the main slot's text that another slot must hold.
MOST_TEXT, LEAST_SHARE = 0.6, 0.1
#: Share of a slot's text in links up to which it is content.
MOST_LINKS = 0.5
#: Pages, and share of a host's pages, that a valid class covers.
LEAST_PAGES, SUPPORT = 5, 0.1
#: Size of all templates up to which they are broadcast, and parts of a host beyond.
BROADCAST_BYTES, SALTS = 16 << 20, 64

#: Whether it is a text, role, text, share, characters.
ENTRY = "<Bqqff"


@lru_cache(maxsize=1 << 16)
def role_of(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, parent) >> 1


def judged(element: str, named: dict) -> int:
    """The flags of an element."""
    if element in NOT_CONTENT or "hidden" in named or UNSEEN.search(named.get("style") or ""):
        return NO_CONTENT
    flags = (HEADER if element == "header" else 0) | OF_ELEMENT.get(element, 0)
    if element in NAMED:
        flags |= CONTAINER
    if (named.get("role") or "").lower() == "main":
        flags |= MAIN
    if element in PLACED and any(CONTENT_NAME.fullmatch(x) for x in f"{named.get('class') or ''} {named.get('id') or ''}".split()):
        flags |= CONTENT
    if element in NAMED and named:
        names = " ".join(filter(None, (named.get("class"), named.get("id"), named.get("role"))))
        if names and PART.search(names):
            whole = f"{named.get('class') or ''} {named.get('role') or ''}".split()
            flags |= NAME_PART | (NAME if any(WHOLE_NAME.fullmatch(x) for x in whole) else 0)
    return flags


def read(page: str):
    """(nodes, texts): nodes as (parent, role, flags), the root first; texts as (node, text, characters in links)."""
    nodes: list[tuple[int, int, int]] = [(-1, 0, 0)]
    stack: list[tuple[str, int]] = []  # element, node; -1 where nothing is seen
    opened: dict[str, int] = {}
    ends: dict[str, int] = {}
    places: dict[tuple[int, str], int] = {}
    texts: list[tuple[int, str, int]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                texts.append((stack[-1][1] if stack else 0, text, min(linked, len(text))))
        linked = 0

    def close(to: int):
        for element, _ in stack[to:]:
            opened[element] -= 1
        del stack[to:]

    at, n, match = 0, len(page), TOKEN.match
    while at < n:
        m = match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if page.startswith(("<!", "<?"), m.start()):
                continue
            if not stack or stack[-1][1] >= 0:
                s = m[0]
                parts.append(s)
                if in_link:
                    linked += len(s)
            continue
        name = name.lower()
        closing = (m[1] or m[4]) == "/"
        if name in INLINE:
            if name == "a":
                in_link = not closing
            continue
        if name in VOID:
            flush()
            continue
        if name in UNTAGGED:
            if not closing:
                end = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        flush()
        in_link = False
        if closing:
            if opened.get(name):
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close(k)
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        attrs = m[3] or m[6] or ""
        if name in RAW:
            if name not in ends:
                ends[name] = max((x.start() for x in re.finditer(rf"</{name}\b", page, re.I)), default=-1)
            if (name == "head" or ends[name] >= at) and not attrs.endswith("/"):
                stack.append((name, -1))
                opened[name] = opened.get(name, 0) + 1
            continue
        if stack and stack[-1][1] < 0:
            continue
        gone = CLOSES.get(name, ())
        if any(opened.get(x) for x in gone):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in gone:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        named = {(a or e).lower(): b or c or d for a, b, c, d, e in ATTRIBUTE.findall(attrs)} if attrs and not attrs.isspace() else {}
        parent = stack[-1][1] if stack else 0
        # Of its kind by class or id; without them containers are told apart by their place among their like.
        label = name
        if kind := named.get("class") or named.get("id"):
            label = f"{name}.{'.'.join(DIGITS.sub('0', kind).split())}"
        elif name in PLACED:
            places[parent, name] = place = places.get((parent, name), 0) + 1
            label = f"{name}#{place}"
        nodes.append((parent, role_of(nodes[parent][1], label), judged(name, named)))
        stack.append((name, len(nodes) - 1))
        opened[name] = opened.get(name, 0) + 1
    flush()
    return nodes, texts


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, role, text, n, chars, links, total): for each page a row without a role; one for each role with how often
    it opens, its unlinked and linked characters and those of the page; one for each text of a role, as its hash.  Rows of
    tags come once more with a null host, for the template of all."""
    shape = "host string, page long, role long, text long, n long, chars long, links long, total long"

    def run(batches):
        for batch in slices(batches, "html"):
            rows = []
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html")), strict=True):
                nodes, texts = read(source or "")
                below = [[0, 0] for _ in nodes]
                of_text: dict = {}
                for i, t, links in texts:
                    below[i][0] += len(t) - links
                    below[i][1] += links
                    key = (nodes[i][1], text_hash(t))
                    of_text[key] = of_text.get(key, 0) + 1
                roles: dict = {}
                for i in range(len(nodes) - 1, 0, -1):
                    parent, role, flags = nodes[i]
                    chars, links = below[i]
                    r = roles.setdefault(role, [0, 0, 0])
                    r[0], r[1], r[2] = r[0] + 1, r[1] + chars, r[2] + links
                    if not flags & NO_CONTENT:
                        below[parent][0] += chars
                        below[parent][1] += links
                total = below[0][0]
                rows += [(h, page, None, None, 1, 0, 0, total) for h in (host, None)]
                rows += [(h, page, role, None, *r, total) for role, r in roles.items() for h in (host, None)]
                rows += [(host, page, role, t, k, 0, 0, 0) for (role, t), k in of_text.items()]
            names = ["host", "page", "role", "text", "n", "chars", "links", "total"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if x == "host" else pa.int64()) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    return pages.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html").mapInArrow(run, shape)


def templates(pages: DataFrame) -> DataFrame:
    """(host, nodes: array<struct<role, share, chars>>, fixed: array<struct<role, text>>) of hosts with enough pages, and of a
    null host for all; share is null for a node that a page may have several times, chars negative if mostly links.

    Runs a job while it is called: the sums by token are kept in the shared checkpoint folder.
    """
    # One page's part of an occurrence vector's fingerprint; parts add up in any order.
    part = F.xxhash64("page", "n").cast("decimal(38,0)")
    total = lambda c: F.sum(c).alias(c)
    sums = tokens(pages).groupBy("host", "role", "text").agg(F.sum(part).alias("vector"), F.count(F.lit(1)).alias("pages"), *map(total, ("n", "chars", "links", "total")))
    sums = checkpointed(sums.where(F.col("pages") >= LEAST_PAGES))
    sizes = sums.where("role is null").select(F.col("host").alias("h"), F.col("pages").alias("all"))
    # Classes: tokens of a host with one vector.  A class is valid if it holds a tag and covers enough pages.
    same = F.col("host").eqNullSafe(F.col("h"))
    valid = sums.where("role is not null").join(sizes, same).where(F.col("pages") >= F.col("all") * SUPPORT)
    tags = valid.where("text is null")
    share = F.when(F.col("n") == F.col("pages"), F.col("chars") / F.greatest(F.lit(1), "total"))
    chars = F.col("chars") / F.col("pages") * F.when(F.col("links") > (F.col("chars") + F.col("links")) * MOST_LINKS, -1).otherwise(1)
    nodes = tags.groupBy("host").agg(F.collect_list(F.struct("role", share.alias("share"), chars.alias("chars"))).alias("nodes"))
    # A text on every page that a class's tag is on, as often as the tag.
    fixed = valid.where("text is not null").join(tags.select("host", "vector").distinct(), ["host", "vector"])
    fixed = fixed.groupBy("host").agg(F.collect_list(F.struct("role", "text")).alias("fixed"))
    out = nodes.join(fixed.select(F.col("host").alias("h"), "fixed"), F.col("host").eqNullSafe(F.col("h")), "left")
    return out.select("host", "nodes", "fixed")


def packed(t: DataFrame) -> DataFrame:
    """(h, template): a host's template as bytes, small beside a page and read once a host."""

    def run(batches):
        for batch in batches:
            out = []
            for nodes, fixed in zip(batch.column("nodes").to_pylist(), batch.column("fixed").to_pylist(), strict=True):
                rows = [struct.pack(ENTRY, 0, x["role"], 0, -1.0 if x["share"] is None else x["share"], x["chars"]) for x in nodes or ()]
                rows += [struct.pack(ENTRY, 1, x["role"], x["text"], 0.0, 0.0) for x in fixed or ()]
                out.append(b"".join(rows))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.binary())], ["h", "template"])

    return t.mapInArrow(run, "h string, template binary")


@lru_cache(maxsize=64)
def unpacked(template: bytes) -> tuple[dict, set]:
    """(role -> (share, chars), fixed (role, text) pairs)"""
    nodes, fixed = {}, set()
    for kind, role, text, share, chars in struct.iter_unpack(ENTRY, template):
        if kind:
            fixed.add((role, text))
        else:
            nodes[role] = (share, chars)
    return nodes, fixed


def main_text(page: str, template: bytes | None) -> str:
    """The text of a page's content slots by its host's template."""
    nodes, texts = read(page)
    if not template:
        seen = [True] * len(nodes)
        for i, (parent, _, flags) in enumerate(nodes[1:], 1):
            seen[i] = seen[parent] and not flags & (NO_CONTENT | HEADER)
        return " ".join(t for i, t, _ in texts if seen[i])
    known, fixed = unpacked(template)
    # Down from the root while one node holds most of its host's text.
    children: dict[int, dict[int, list[int]]] = {}
    for i, (parent, role, flags) in enumerate(nodes[1:], 1):
        if not flags & NO_CONTENT and known.get(role, (-1,))[0] >= MOST_TEXT:
            children.setdefault(parent, {}).setdefault(role, []).append(i)
    way, end, usual = [0], 0, 0.0
    while once := [c[0] for c in children.get(end, {}).values() if len(c) == 1]:
        end = max(once, key=lambda i: known[nodes[i][1]])
        usual = known[nodes[end][1]][1]
        way.append(end)
    own = [0] * len(nodes)
    titled = [bool(flags & TITLE) for _, _, flags in nodes]
    is_fixed = [(nodes[i][1], text_hash(t)) in fixed for i, t, _ in texts]
    varying, plain = [0] * len(nodes), [0] * len(nodes)  # texts that aren't fixed; fixed ones that aren't headings
    for (i, t, links), same in zip(texts, is_fixed, strict=True):
        own[i] += len(t) - links
        varying[i] += not same
        plain[i] += same and not nodes[i][2] & HEADING
    for i in range(len(nodes) - 1, 0, -1):
        parent, _, flags = nodes[i]
        own[parent] += own[i]
        varying[parent] += varying[i]
        plain[parent] += plain[i]
        titled[parent] |= titled[i] and not flags & (NO_CONTENT | HEADER)
    main = article_of(nodes, way, titled)
    usual = abs(usual) or own[0]
    on_way = set(way)
    above = set(way[: way.index(main) + 1])  # the way into the article
    content, inside, barred = ([False] * len(nodes) for _ in range(3))
    content[main] = inside[main] = True
    for i, (parent, role, flags) in enumerate(nodes):
        if i in above:
            continue
        inside[i] = inside[parent]
        if inside[i]:
            gone = flags & (NO_CONTENT | NAME)
            if parent in on_way and i not in on_way and flags & CONTAINER:  # a slot beside the way
                gone = gone or not titled[i] and (flags & NAME_PART and parent != end or known.get(role, (0, 1))[1] <= 0)
            content[i] = content[parent] and not gone and not (flags & CONTAINER and plain[i] and not varying[i] and i not in on_way)
            continue
        barred[i] = barred[parent] or bool(flags & (NO_CONTENT | HEADER | NAME_PART))
        if barred[i]:
            content[i] = False
        elif parent in above:  # a slot outside the article
            content[i] = known.get(role, (0, own[i]))[1] >= LEAST_SHARE * usual
        else:
            content[i] = content[parent]
        content[i] = content[i] or bool(flags & TITLE) and not barred[i]
    for i in above - {main}:  # texts beside the way's elements
        content[i] = sum(len(t) for j, t, _ in texts if j == i) >= LEAST_SHARE * usual
    kept = [(i, t, same) for (i, t, _), same in zip(texts, is_fixed, strict=True) if content[i]]
    slots = [t for i, t, same in kept if not same or inside[i] and not (i == main or nodes[i][2] & (CONTAINER | PAGE))]
    return " ".join(slots or [t for _, t, _ in kept])


def article_of(nodes: list, way: list[int], titled: list[bool]) -> int:
    """The node of the way that is the page's article."""
    for kind in (ARTICLE, MAIN, CONTENT):
        if named := [i for i in way if nodes[i][2] & kind]:
            return named[0]
    with_title = [i for i in way[1:] if titled[i] and not nodes[i][2] & PAGE]
    return with_title[-1] if with_title else way[-1]


def with_template(pages: DataFrame, t: DataFrame) -> DataFrame:
    """Pages with their host's template, or that of all.  Templates of up to BROADCAST_BYTES are sent to all executors, so
    pages aren't shuffled; beyond that, both sides are dealt by host and one of SALTS parts, so a large host is many tasks'
    work.  The template of all is one row, bounded by SUPPORT."""
    size = t.agg(F.sum(F.octet_length("template") + F.coalesce(F.octet_length("h"), F.lit(0)) + 64)).first()[0] or 0
    common = t.where("h is null").select(F.col("template").alias("common"))
    pages, t = pages.join(F.broadcast(common), F.lit(True), "left"), t.where("h is not null")
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(t), F.col("host") == F.col("h"), "left")
    t = t.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return pages.join(t, (F.col("host") == F.col("h")) & (F.col("salt") == F.col("part")), "left")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each page.

    Runs jobs while it is called: the templates are kept in the shared checkpoint folder.
    """
    require(df, id_col, url_col, html_col)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    joined = with_template(pages, checkpointed(packed(templates(pages))))
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "html"):
            given = zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)
            texts = [main_text(page or "", template) for page, template in given]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = joined.select("page_id", "url", "html", F.coalesce("template", "common").alias("template")).mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
