"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens. Element tokens are block elements, each with the role that its path of
enclosing elements gives it; content tokens are the whole text of an element that stands once on
the page, in its role; line tokens are the blocks of text in elements that repeat. Over the pages of a host each token has an occurrence vector, its count on
every page; tokens with equal vectors are an equivalence class. Vectors are kept as sums of hashes
of (page, count), so that they add up in any order and no list grows with a host. Classes on a
large enough share of the pages are valid; nested by their elements' paths they are the host's
template:

* elements of classes that stand once on a page are its frame. Where one or a few content tokens
  account for an element's pages, its text is the template's own (menus, notices, footers), and so
  are lines in plain paragraphs that all pages begin with;
* classes of several nested elements that repeat on a page are records (remarks, teasers);
* what is left open are the slots. The main text's slot is the frame's article or main element;
  a host without one has it in the lowest element that holds all running text left.

Names of classes and elements' kinds (nav, footer) mark what is no article on any page; words that
articles use for their own parts too, as `warning`, mark nothing inside an article. A host whose
pages are mostly copies of each other shows no template, nor does a single page: they go by marks.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akzentor.llm.common import keep, slices

#: Share of a host's pages that a template token stands on, and the fewest pages of a host.
SUPPORT, LEAST_PAGES = 0.5, 2
#: An element's text is the template's if contents that each stand on a SHARE of its pages account for
#: COVER of them; within an article a single one has to, on at least LEAST_SAME pages.
SHARE, COVER, LEAST_SAME = 0.25, 0.9, 3
#: Texts of elements that repeat on a page are the template's from this share of pages, and so many, on, if they come first.
LINE_SUPPORT, LEAST_LINE_PAGES = 0.8, 4
#: Share of pages from which on common contents of a whole page mean copies, not a template.
COPIES = 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes xmp template svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("article body center div dl form main section table tbody td tr".split())
#: Elements that a record can be.
RECORDS = frozenset("article blockquote dd div dl fieldset figure li section table tr".split())
NO_TEXT = frozenset("head nav footer header aside button select option input textarea label fieldset menu dialog object canvas audio video".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "tfoot", "thead", "caption", "option", "optgroup", "legend"}
#: Words in a class, id or role that mark what is no part of an article.
CHROME = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|pagination|pager|toolbar|sidebar|side|rail|widget\w*|footer|foot|header|masthead|topbar|comments?|commentlist|reply|replies|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|signup|login|search\w*|tags|navigation|complementary|contentinfo|copyright|skip\w*|adbox|adslot|adwrap\w*)",
    re.I,
)
#: Words that do so outside of an article only.
OUTSIDE = re.compile(r"(?:notice\w*|alert|warning|discussion|disclaimer|announcement\w*)", re.I)
#: Words that such names are made of besides; a name with any other word, as has-sidebar, marks nothing.
BESIDES = frozenset("area bar block blocks bottom box btn button buttons col column container entries foot form global group head inner item items left link links list local main mobile outer page panel policy post posts primary right row secondary section site slot stories text title top unit wrap wrapper 9".split())
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
_MARKS = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_MASK = (1 << 64) - 1


class Node:
    """An open element."""

    __slots__ = ("tag", "up", "role", "chrome", "hard", "named", "main", "link", "block", "text", "form", "said", "skip")

    def __init__(self, tag: str, up: Node | None, marks: str, hard: bool, named: bool, main: int) -> None:
        self.tag, self.up, self.block = tag, up, tag in BLOCK
        self.role = xxhash.xxh3_64_intdigest(f"{tag} {marks}", seed=up.role if up else 0) >> 1 if self.block else (up.role if up else 0)
        self.main = max(main, up.main if up else 0)  # 1: within a main element, 2: within an article
        self.hard = hard or (up.hard if up else False)  # no part of an article by an element's kind
        self.named = max(self.main if named else -1, up.named if up else -1)  # the same by a name: `main` where it stands, -1 for none
        self.chrome = self.hard or self.named >= 0
        self.link = tag == "a" or (up.link if up else False)
        self.skip = not self.block and (hard or (up.skip if up else False))  # a control in running text
        self.form = self if tag == "form" else up.form if up else None
        self.text = self.said = 0


class Block:
    __slots__ = ("text", "node", "linked")

    def __init__(self, text: str, node: Node, linked: int) -> None:
        self.text, self.node, self.linked = text, node, linked


def is_chrome(names: str, inside: bool = False) -> bool:
    """If any of the names, as a whole, marks what is no part of an article; `inside` one, fewer do."""
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+", _DIGITS.sub("9", name).lower()) if p]
        found = [bool(CHROME.fullmatch(p) or (not inside and OUTSIDE.fullmatch(p))) for p in parts]
        if any(found) and all(f or p in BESIDES for f, p in zip(found, parts, strict=True)):
            return True
    return False


def _forms(nodes: list[Node], blocks: list[Block]) -> None:
    """A form is no part of an article, unless the page stands in it: it holds an article or main
    element, or more running text than what is outside of it."""
    sizes: dict[Node | None, int] = {}
    for b in blocks:
        if not b.node.chrome:
            sizes[b.node.form] = sizes.get(b.node.form, 0) + len(b.text) - b.linked
    wraps = {x.form for x in nodes if x.form is not None and x.main > x.form.main and not x.hard}
    total = sum(sizes.values())
    wraps |= {f for f, n in sizes.items() if f is not None and 2 * n > total}
    for x in nodes:
        if x.form is not None and x.form not in wraps:
            x.hard = x.chrome = True


def _lift(nodes: list[Node], blocks: list[Block]) -> None:
    """An article or main element stays whatever the names of what encloses it, unless the page has
    more text elsewhere (comments and teasers can be articles too)."""
    others = sum(len(b.text) for b in blocks if not b.node.chrome)
    for level in (2, 1):
        fits = lambda x: x.main == level and x.chrome and not x.hard and x.named < level  # noqa: B023, E731
        if sum(len(b.text) for b in blocks if fits(b.node)) > others:
            for x in [x for x in nodes if fits(x)]:
                x.chrome = False
            return


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The block elements of a page in order, and its blocks of text, white space made single."""
    top = Node("", None, "", False, False, 0)
    nodes: list[Node] = []
    blocks: list[Block] = []
    here, parts, linked, at, n = top, [], 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                own = here
                while not own.block and own.up is not None:
                    own = own.up
                blocks.append(Block(text, own, min(linked, len(text))))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if here.skip:
            return
        text = html_module.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if here.link:
            linked += len(text)

    def leave(to: Node) -> None:
        """Close all elements down to `to`, which closes too."""
        nonlocal here
        x = here
        while x is not to.up:
            if x.block:
                flush()
                here = x.up
            x = x.up
        here = to.up

    while at < n:
        i = page.find("<", at)
        if i < 0:
            i = n
        if i > at:
            add(page[at:i])
        if i >= n:
            break
        m = _TAG.match(page, i)
        if m is None:
            add("<")
            at = i + 1
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            x = here
            while x.up is not None and x.tag != tag:
                if x.block and tag not in BLOCK:
                    break  # an inline element's end closes no block
                x = x.up
            if x.up is not None and x.tag == tag:
                leave(x)
            elif tag == "p" or tag == "br":
                flush() if tag == "p" else parts.append(" ")
            continue
        attrs = m[3] if m[2] else m[6]
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at) if not attrs.endswith("/") else None
            if not attrs.endswith("/"):
                at = end.end() if end else n
            if tag in ("iframe", "textarea", "svg"):
                parts.append(" ")
            continue
        if tag in VOID:
            if tag == "br":
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in ENDS_P or tag in CLOSED_BY:
            x, ends = here, (*CLOSED_BY.get(tag, ()), *(("p",) if tag in ENDS_P else ()))
            found = None
            while x.up is not None and not (x.block and x.tag not in ends):
                if x.tag in ends:
                    found = x
                x = x.up
            if found is not None:
                leave(found)
        marks = {a.lower(): b or c or d or "" for a, b, c, d in _MARKS.findall(attrs)} if attrs else {}
        if tag in BLOCK:
            flush()
        names = " ".join(v for k, v in marks.items() if k in ("class", "id", "role"))
        hard = tag in NO_TEXT or marks.get("aria-hidden") == "true"
        main = 2 if tag == "article" or marks.get("itemprop") == "articleBody" else 1 if tag == "main" or marks.get("role") == "main" else 0
        named = bool(names) and not main and tag not in ("html", "body") and is_chrome(names, here.main > 0)
        here = Node(tag, here, _DIGITS.sub("9", names), hard, named, main)
        if here.block:
            nodes.append(here)
    flush()
    if any(x.form is not None for x in nodes):
        _forms(nodes, blocks)
    if any(b.node.named >= 0 and b.node.main for b in blocks):
        _lift(nodes, blocks)
    for b in blocks:
        if not b.node.chrome:
            b.node.text += len(b.text) - b.linked
            b.node.said = (b.node.said + xxhash.xxh3_64_intdigest(b.text, seed=b.node.role)) & _MASK
    for x in reversed(nodes):  # an element comes before those inside of it
        x.up.text += x.text
        x.up.said = (x.up.said + x.said) & _MASK
    return nodes, blocks


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def line_token(b: Block) -> int:
    return xxhash.xxh3_64_intdigest(b.text, seed=b.node.role ^ 1) >> 1


def page_tokens(page: str) -> list[tuple[int, int, str, int, int, int, int]]:
    """(token, parent, kind, count, place, text, main) of a page's tokens. An element's kind is its
    name and its parent the role around it; a content's kind is "", a line's "=", and the parent
    of both the element."""
    nodes, blocks = parse(page)
    seen: dict[int, list] = {}
    for i, x in enumerate(nodes):
        if x.chrome:
            continue
        if (own := seen.get(x.role)) is not None:
            own[3] += 1
            own[5] += x.text
            own[7] = 0
        else:
            seen[x.role] = [x.role, x.up.role, x.tag, 1, i, x.text, x.main if x.main != x.up.main else -x.main, x.said]
    said = [(xxhash.xxh3_64_intdigest(x[7].to_bytes(8), seed=x[0]) >> 1, x[0], "", 1, x[4], x[5], 0) for x in seen.values() if x[7]]
    lines: dict[int, list] = {}
    for b in blocks:
        if not b.node.chrome and not b.node.main and (b.node.role not in seen or seen[b.node.role][3] > 1):
            own = lines.setdefault(line_token(b), [line_token(b), b.node.role, "=", 0, len(nodes), len(b.text) - b.linked, 0])
            own[3] += 1
    return [tuple(x[:7]) for x in seen.values()] + said + [tuple(x) for x in lines.values()]


def deduce_templates(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The tokens on at least LEAST_PAGES pages of a host: host, token, parent, kind, class (tokens with
    one occurrence vector share it), pages, host_pages, most (on a page), place, text, main (of the
    first element of an article 2, of a main element 1; below zero for those within).

    Null html is an empty page. Keys only tell pages apart: rows of one key add to the counts as pages
    do. Pages without a host form a host "". An empty table gives none. A token that few pages have
    goes once all are counted; elements kept stand on a SUPPORT share of the pages and contents on
    a SHARE of that, so what is kept of a host grows with a page's structure, not with its pages.
    """
    own = pages.select(F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.coalesce(F.xxhash64(F.col(key)), F.lit(0)).alias("page"))
    schema = "host string, page long, token long, parent long, kind string, n int, place int, text long, main int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for u, h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                host = host_of(u)
                rows.append((host, p, -1, 0, "page", 1, 0, 0, 0))
                rows += [(host, p, *t) for t in page_tokens(h)]
            cols = list(zip(*rows, strict=True)) or [()] * 9
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["host", "page", "token", "parent", "kind", "n", "place", "text", "main"])

    tokens = own.mapInArrow(run, schema)
    sums = tokens.groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.min("kind").alias("kind"), F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), F.avg("place").alias("place"), F.sum("text").alias("text"), F.max("main").alias("main"),
        *(F.sum(F.xxhash64(F.lit(i), "page", "n").bitwiseAND(F.lit(0x7FFFFFFF))).alias(f"v{i}") for i in (0, 1)),
    )
    sums = keep(sums.filter(F.col("pages") >= LEAST_PAGES), "tokens")
    size = sums.filter("token = -1").select("host", F.col("pages").alias("host_pages"))
    least = F.col("host_pages") * F.when(F.col("kind") == "", SUPPORT * SHARE).otherwise(SUPPORT)
    valid = sums.filter("token <> -1").join(size, "host").filter(F.col("pages") >= least)
    return valid.select("host", "token", "parent", "kind", F.concat_ws("-", F.hex("v0"), F.hex("v1")).alias("class"), "pages", "host_pages", "most", "place", "text", "main")


def template_parts(tokens: DataFrame) -> DataFrame:
    """(host, slot, fixed, records, lines): what a page needs of its host's template: the role of the frame's
    article or main element (null if none), the roles whose text is the template's own, and the roles of
    records, the lines of all pages. A host without a template has no row."""
    elements = tokens.filter("kind not in ('', '=')").select("host", F.col("token").alias("role"), "parent", "kind", "class", "pages", "host_pages", "most", "place", "text", "main")
    said = tokens.filter("kind = ''").select("host", F.col("parent").alias("role"), F.col("pages").alias("same"))
    covers = elements.select("host", "role", "pages").join(said, ["host", "role"]).filter(F.col("same") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * SHARE))
    covers = covers.groupBy("host", "role").agg((F.sum("same") / F.first("pages")).alias("cover"), F.max("same").alias("same"))
    known = elements.join(covers, ["host", "role"], "left").withColumn("cover", F.coalesce("cover", F.lit(0.0)))
    # The whole page: its largest text, and how far pages are copies of each other, as a whole or by their article.
    whole = known.groupBy("host").agg(F.max("text").alias("all"), F.max_by("cover", F.struct("text", -F.col("place"))).alias("page_cover"), F.max(F.when(F.col("main") > 0, F.struct("main", F.col("cover").alias("c"))))["c"].alias("main_cover"))
    known = known.join(whole, "host").filter(F.greatest("page_cover", F.coalesce("main_cover", F.lit(0.0))) < COPIES)
    outside = (F.col("cover") >= COVER) & (F.col("main") == 0) & (2 * F.col("text") <= F.col("all"))
    inside = (F.col("same") >= F.greatest(F.lit(LEAST_SAME), F.col("pages") * COVER)) & (F.col("main") < 0)
    known = known.withColumn("is_fixed", F.coalesce((F.col("most") == 1) & (outside | inside), F.lit(False)))
    # Nesting within a class: an element and one right inside of it that always stand together, more than once on some page.
    inner = known.select("host", F.col("parent").alias("role"), "class").distinct()
    records = known.filter((F.col("most") > 1) & (F.col("main") == 0) & F.col("kind").isin(*RECORDS)).join(inner, ["host", "role", "class"], "left_semi").groupBy("host").agg(F.collect_set("role").alias("records"))
    frame = known.filter((F.col("most") == 1) & (F.col("main") > 0) & F.col("kind").isin(*CONTAINERS))
    slots = frame.groupBy("host").agg(F.max(F.struct("main", "place", F.col("role").alias("slot")))["slot"].alias("slot"))
    lines = tokens.filter("kind = '=' and most = 1").filter((F.col("pages") >= LEAST_LINE_PAGES) & (F.col("pages") >= F.col("host_pages") * LINE_SUPPORT))
    lines = lines.groupBy("host").agg(F.collect_set("token").alias("lines"))
    fixed = known.groupBy("host").agg(F.collect_set(F.when(F.col("is_fixed"), F.col("role"))).alias("fixed"))
    return fixed.join(slots, "host", "left").join(records, "host", "left").join(lines, "host", "left").select("host", "slot", "fixed", "records", "lines")


def lowest(blocks: list[Block]) -> Node | None:
    """The lowest container that holds all running text of the blocks, all their text if none runs."""
    running = [b for b in blocks if len(b.text) > b.linked] or blocks
    path, x = [], running[0].node
    while x is not None:
        path.append(x)
        x = x.up
    place, at = {x: i for i, x in enumerate(path)}, 0
    for b in running:
        x = b.node
        while x not in place:
            x = x.up
        at = max(at, place[x])
    return next((x for x in path[at:] if x.tag in CONTAINERS), None)


def _inside(blocks: list[Block], test) -> list[Block]:
    """The blocks with an element around them that passes the test."""
    known: dict[Node, bool] = {}

    def inside(x: Node | None) -> bool:
        path = []
        while x is not None and x not in known and not test(x):
            path.append(x)
            x = x.up
        found = x is not None and known.get(x, True)
        if x is not None:
            known[x] = found
        for y in path:
            known[y] = found
        return found

    return [b for b in blocks if inside(b.node)]


def _without_records(blocks: list[Block], records: frozenset[int]) -> list[Block]:
    """Blocks but for records that follow the main text in an element of their own, if they are less."""
    listed = set(map(id, _inside(blocks, lambda x: x.block and x.role in records)))
    if not listed:
        return blocks
    sizes: dict[Node, int] = {}
    for b in blocks:
        if id(b) not in listed:
            holder = b.node.up if b.node.tag not in CONTAINERS and b.node.up is not None else b.node
            sizes[holder] = sizes.get(holder, 0) + len(b.text) - b.linked
    if not sizes or sum(sizes.values()) <= sum(len(b.text) for b in blocks if id(b) in listed):
        return blocks
    leader = max(sizes, key=sizes.__getitem__)
    around, x = set(), leader
    while x is not None:
        around.add(x)
        x = x.up
    last = max(i for i, b in enumerate(blocks) if id(b) not in listed and (b.node is leader or b.node.up is leader))

    def apart(b: Block) -> bool:
        x, box = b.node, None
        while x is not None and x is not leader:
            if x.role in records and x.block:
                box = x.up
            x = x.up
        return x is None and box is not None and box not in around

    return [b for i, b in enumerate(blocks) if not (id(b) in listed and i > last and apart(b))]


def main_text(page: str, slot: int | None = None, fixed: frozenset[int] = frozenset(), records: frozenset[int] = frozenset(), lines: frozenset[int] = frozenset()) -> str:
    """The main text of a page: its blocks within the slot's element if it has one, else within its
    articles, its main elements, or the lowest element with all of its running text that neither is
    the template's nor stands in records after it."""
    _, blocks = parse(page)
    blocks = [b for b in blocks if not b.node.chrome]
    if fixed:
        own = set(map(id, _inside(blocks, lambda x: x.block and x.role in fixed)))
        blocks = [b for b in blocks if id(b) not in own] or blocks
    chosen: list[Block] = []
    if slot is not None:
        chosen = _inside(blocks, lambda x: x.role == slot and x.block)
    if not chosen:
        most = max((b.node.main for b in blocks), default=0)
        if most:
            chosen = [b for b in blocks if b.node.main == most]
    if not chosen and blocks:
        first = next((i for i, b in enumerate(blocks) if line_token(b) not in lines), 0) if lines else 0
        blocks = _without_records(blocks[first:], records) if records else blocks[first:]
        whole = lowest(blocks)
        chosen = _inside(blocks, lambda x: x is whole) if whole is not None else blocks
    return "\n".join(b.text for b in chosen)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row; text is empty where a page has none.

    Null html is an empty page; null or hostless urls share a host "". Repeated rows give a row
    each; an empty table gives none; other columns aren't read.
    """
    parts = keep(template_parts(deduce_templates(pages, key, url, html)), "template")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9_+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    met = own.join(parts, "host", "left").select("k", "url", "html", "slot", "fixed", "records", "lines")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h or "", s, *(frozenset(x or ()) for x in sets)) for h, s, *sets in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["k", "url", "text", "n_chars"])

    return met.mapInArrow(run, f"k {kinds['k']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("k", key)
