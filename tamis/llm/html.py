"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements and its text segments, told apart by the path of elements that
they stand under. Over the distinct pages of a host, tokens with the same occurrence vector (how
often each occurs on each page) form an equivalence class. A class is valid if it has two tokens
or more and, by the lower end of a confidence interval, stands on a large enough share of the
host's pages; an odd page or a second layout therefore voids no class, and no number of pages is
a switch. Vectors are compared by a fingerprint that adds up page by page (the exclusive or of a
hash of page and count), so a host's pages are never gathered. Classes whose tokens hang under
different classes are split; what is left, nested, is the host's template, and on a page a class
counts only if its tokens stand there in the template's order.

The template cuts a page into slots. Of each it knows how much running text (outside links and
apart from words that the template repeats) it holds on the host's pages; the main slot is found
by going down from the page as long as one slot holds most of the text. A page without template
goes by its own text. What elements and their names say (an article, a menu) only weighs those
figures. Within the main slot, texts of the template go, and so do elements that HTML itself sets
apart (forms, scripts, asides) and boxes named for comments, adverts and the like.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm._shared import save
from tamis.llm.urls import host
from tamis.session import ship

NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
INSIDE = re.compile(r"[^<>\"']*")
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
NUMBERED = re.compile(r"\d{3,}")  # an article's own number in a name

#: HTML's own sets of elements; fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body button caption div footer form header html main nav section table td th".split())
LISTS = frozenset("ul ol dl table".split())
#: Elements that may be the main slot, and those of an article's own blocks.
BOXES = frozenset("article aside body center div fieldset footer form header html main menu nav section td".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements that HTML itself sets apart from the article's text.
ASIDE = frozenset("aside button canvas dialog footer form frameset head iframe input map menu nav noembed noframes noscript object script select style svg template textarea title xmp".split())

#: Words that name boxes which aren't the article, and words that only qualify such a name. A hint, by its whole words.
NAMED = frozenset("ad ads adbox adslot adsbygoogle advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies dialog disclaimer discussion disqus footer footnav form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies respond search share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription subnav toolbar topbar topnav widget widgets".split())
QUALIFY = frozenset("area bar bottom box block body bottom container global group head inner item left lg link links list main md mobile outer page panel primary reader readers right row secondary section site sm slot the thread top unit user users wide wrap wrapper xs".split())
MAIN = frozenset("article main".split())
MAIN_NAMED = frozenset("main article articlebody article-body post-body entry-content post-content article-content".split())
#: How much these hints weigh the text of a slot.
TOWARDS, AGAINST = 10.0, 0.1
MOST = 0.5  # share of a slot's text that one within must hold to be gone into
REMEMBERED = 256  # hosts' templates that a worker keeps at hand
PAGE = "page"


@dataclass
class Page:
    """Elements in document order (each under an earlier one; the first is the page), and text segments."""

    name: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [-1])
    hint: list[int] = field(default_factory=lambda: [0])  # 1: main, -1: aside by its classes or role, -2: by its id, 0: neither
    apart: list[bool] = field(default_factory=lambda: [False])  # within an element that HTML sets apart
    link: list[bool] = field(default_factory=lambda: [False])
    texts: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, block
    squeezed: list[str] = field(default_factory=list)  # of each text, with single spaces


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open" or "close", name, the tag); comments and declarations go. One pass, in linear time.

    A tag without an end stops at the next bracket, or is text if the page ends first; a quote that is never closed is a character.
    """
    at, n, raw = 0, len(page), ""
    closed = {'"': True, "'": True}
    while at < n:
        if raw:  # inside script, style and the like only the closing tag counts
            m = _closing(raw).search(page, at)
            at, raw = (m.start() if m else n), ""
            continue
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        close = page.startswith("</", lt)
        m = NAME.match(page, lt + 1 + close)
        if m is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        end = m.end()
        while True:
            end = INSIDE.match(page, end).end()
            quote = page[end : end + 1]
            if quote not in ("'", '"') or not quote:
                break
            shut = page.find(quote, end + 1) if closed[quote] else -1
            closed[quote] = shut >= 0
            end = shut + 1 if shut >= 0 else end + 1
        if end >= n:
            yield "text", page[lt:], ""
            return
        name = m.group().lower()
        yield "close" if close else "open", name, page[m.end() : end]
        at = end + (page[end] == ">")
        if not close and name in RAW:
            raw = name


@lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?![a-zA-Z0-9])", re.I)


@lru_cache(4096)
def _hint(name: str, classes: str, ids: str, role: str) -> int:
    """What an element's kind and names say of it: classes and roles if all their words are of one sort, ids with less weight."""
    words = [w for text in (classes, role) for w in text.split()]
    if name in MAIN or any(w in MAIN_NAMED for w in (*words, *ids.split())):
        return 1
    if name in ("html", "body"):
        return 0
    known = lambda w: any(p in NAMED for p in w.split("-")) and all(p in NAMED or p in QUALIFY or not p for p in w.split("-"))
    plain = lambda w: all(p in QUALIFY or not p for p in w.split("-"))
    if any(map(known, words)) and all(known(w) or plain(w) for w in words):
        return -1
    return -2 if not words and ids and all(map(known, ids.split())) else 0


def parse(page: str) -> Page:
    """The page's elements and text segments; unclosed elements and stray end tags are taken as browsers take them, roughly."""
    out = Page()
    stack = [0]
    places: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a name
    scopes, lists = [0], [0]
    block = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            where = len(stack) - 1
            places[out.name[stack.pop()]].pop()
            for held in (scopes, lists):
                if held[-1] == where:
                    held.pop()

    for kind, name, rest in pieces(page):
        top = stack[-1]
        if kind == "text":
            if not out.apart[top]:
                text = entities.unescape(name) if "&" in name else name
                out.texts.append((top, text, block))
                out.squeezed.append(_squeezed(text))
            continue
        if name not in INLINE:
            block += 1
        if kind == "close":
            at = places.get(name)
            if at and (at[-1] >= scopes[-1] or name not in INLINE and name != "p"):
                cut(at[-1])
            continue
        if name in VOID:
            continue
        edge = max(scopes[-1], lists[-1])
        if name in ENDS_P and places["p"] and places["p"][-1] > scopes[-1]:
            cut(places["p"][-1])
        for shut in CLOSES.get(name, ()):
            edge = scopes[-1] if shut in ("td", "th") else max(scopes[-1], lists[-1])
            if places[shut] and places[shut][-1] >= edge:
                cut(places[shut][-1])
        above = stack[-1]
        named, hint = _named(name, tuple(NAMES.findall(rest)) if "=" in rest else ())
        i = len(out.name)
        out.name.append(name)
        out.path.append(_path(out.path[above], name, named))
        out.above.append(above)
        within = out.hint[above] == 1 or out.hint[above] == 2
        out.hint.append(hint or (2 if within else 0))  # 2: within a main element
        out.apart.append(out.apart[above] or name in ASIDE or name == "header" and not within)
        out.link.append(out.link[above] or name == "a")
        places[name].append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        if name in LISTS:
            lists.append(len(stack))
        stack.append(i)
    return out


@lru_cache(1 << 14)
def _named(name: str, found: tuple[tuple[str, str], ...]) -> tuple[str, int]:
    """An element's names, for its path, and what they hint at."""
    words = {"class": "", "id": "", "role": ""}
    for key, value in found:
        words[key.lower()] = value.strip("\"'").lower()
    named = NUMBERED.sub("0", " ".join([*sorted(words["class"].split()), words["id"], words["role"]])) if found else ""
    return named, _hint(name, words["class"], words["id"], words["role"])


@lru_cache(1 << 16)
def _path(above: int, name: str, named: str) -> int:
    return _hash(f"{above}/{name}.{named}")


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def _squeezed(text: str) -> str:
    return " ".join(text.split())


@lru_cache(1 << 16)
def element_token(path: int) -> int:
    return _hash("element", str(path))


def text_token(path: int, squeezed: str) -> int:
    return _hash("text", str(path), squeezed)


def _weights(page: Page, static: frozenset[int] | set[int] = frozenset()) -> list[int]:
    """For each element the characters of text under it that are outside links and aren't the template's."""
    own = [0] * len(page.name)
    for (i, _, _), text in zip(page.texts, page.squeezed, strict=True):
        if not page.link[i] and (not static or text_token(page.path[i], text) not in static):
            own[i] += len(text)
    for i in range(len(own) - 1, 0, -1):
        own[page.above[i]] += own[i]
    return own


def page_tokens(page: str) -> list[tuple[int, int, int, int, int, bool]]:
    """Each token's (token, count, the token above, place, characters of running text under it, whether it is text); one stands for the page."""
    p = parse(page)
    weight = _weights(p)
    count: Counter = Counter(p.path[1:])
    out: dict[int, list] = {_hash(PAGE): [1, 0, 0, weight[0], False]}
    for i in range(1, len(p.name)):
        token = element_token(p.path[i])
        if token not in out:
            out[token] = [count[p.path[i]], element_token(p.path[p.above[i]]) if p.above[i] else _hash(PAGE), i, 0, False]
        out[token][3] += weight[i]
    for (i, _, _), text in zip(p.texts, p.squeezed, strict=True):
        if text:
            token = text_token(p.path[i], text)
            if token not in out:
                out[token] = [0, element_token(p.path[i]) if i else _hash(PAGE), i, 0, True]
            out[token][0] += 1
    return [(token, *rest) for token, rest in out.items()]


@dataclass
class Template:
    """Of a host: its elements' class, place and mean running text, and its texts."""

    cls: dict[int, int] = field(default_factory=dict)
    order: dict[int, float] = field(default_factory=dict)
    weight: dict[int, float] = field(default_factory=dict)
    texts: frozenset[int] = frozenset()


NONE = Template()


def nested(tokens: list[int], vectors: list[int], above: list[int], least_tokens: int = 2) -> dict[int, tuple[int, int]]:
    """{token: class} of the valid classes nested in one another: tokens of one vector whose slots lie in different classes are different classes.

    A class is named by its vector and that of the class whose slot it lies in; classes of under
    ``least_tokens`` tokens go, and what hangs under them hangs under the next class above.
    """
    vector, parent = dict(zip(tokens, vectors, strict=True)), dict(zip(tokens, above, strict=True))
    alive = set(tokens)
    while True:
        outer: dict[int, int] = {}

        def around(t: int) -> int:
            """The vector of the nearest element above that is of another class."""
            trail = []
            while t not in outer:
                trail.append(t)
                up = parent.get(t)
                while up is not None and up not in alive:
                    up = parent.get(up)
                if up is None:
                    outer[t] = 0
                elif vector[up] != vector[t]:
                    outer[t] = vector[up]
                else:
                    t = up
                    continue
                break
            for x in trail:
                outer[x] = outer[t]
            return outer[t]

        found = {t: (vector[t], around(t)) for t in sorted(alive)}
        sizes = Counter(found.values())
        kept = {t for t, c in found.items() if sizes[c] >= least_tokens}
        if kept == alive:
            return found
        alive = kept


def _class_name(pair: tuple[int, int]) -> int:
    return xxhash.xxh64_intdigest(f"{pair[0]}/{pair[1]}") - (1 << 63)


def _in_order(page: Page, template: Template) -> set[int]:
    """The classes whose tokens stand on the page in the template's order (each by its first place)."""
    last: dict[int, float] = {}
    seen: set[int] = set()
    bad: set[int] = set()
    for path in page.path[1:]:
        token = element_token(path)
        if token in seen or token not in template.cls:
            continue
        seen.add(token)
        c, place = template.cls[token], template.order[token]
        if place < last.get(c, place):
            bad.add(c)
        last[c] = place
    return set(template.cls.values()) - bad


def main_text(html: str, template: Template = NONE) -> str:
    """The main slot's text: white space inside a block as one space, trimmed, blocks joined by one space."""
    page = parse(html)
    good = _in_order(page, template) if template.cls else set()
    tokens = [0, *map(element_token, page.path[1:])] if good else []
    here = [template.cls.get(t) in good for t in tokens] if good else [False] * len(page.name)
    own = _weights(page, template.texts)
    weight: list[float] = []
    for i in range(len(page.name)):
        w = max(template.weight[tokens[i]], own[i] * 0.01) if here[i] else float(own[i])
        weight.append(w * (AGAINST if page.apart[i] or page.hint[i] < 0 else TOWARDS if page.hint[i] == 1 else 1.0))
    boxes: dict[int, list[int]] = defaultdict(list)  # the boxes right under each box
    nearest = [0] * len(page.name)
    for i in range(1, len(page.name)):
        up = page.above[i]
        nearest[i] = up if up == 0 or page.name[up] in BOXES else nearest[up]
        if page.name[i] in BOXES:
            boxes[nearest[i]].append(i)
    direct = [0.0] * len(page.name)  # text of a box that is in no box within
    prose = [False] * len(page.name)
    for (i, _, _), text in zip(page.texts, page.squeezed, strict=True):
        if not page.link[i] and text and (not template.texts or text_token(page.path[i], text) not in template.texts):
            box = i if i == 0 or page.name[i] in BOXES else nearest[i]
            direct[box] += len(text)
            prose[box] |= _block_name(page, i) in PROSE
    main = 0
    while boxes[main]:
        best = max(boxes[main], key=lambda i: (weight[i], -i))
        if weight[best] <= 0 or weight[best] < MOST * (direct[main] + sum(weight[i] for i in boxes[main])):
            break
        if (page.hint[main] == 1 or prose[main] and page.name[main] not in ("", "html", "body")) and page.hint[best] != 1:
            break  # its own headings and paragraphs belong to it
        main = best
    inside = [False] * len(page.name)
    inside[main] = True
    for i in range(main + 1, len(page.name)):
        named = page.hint[i] == -1 or page.hint[i] == -2 and (here[i] or page.hint[page.above[i]] < 1)
        inside[i] = inside[page.above[i]] and not page.apart[i] and not (named and page.name[i] in BOXES)
    blocks: dict[int, list[str]] = {}
    for (i, text, block), words in zip(page.texts, page.squeezed, strict=True):
        if inside[i] and not (template.texts and text_token(page.path[i], words) in template.texts):
            blocks.setdefault(block, []).append(text)
    return " ".join(t for parts in blocks.values() if (t := _squeezed("".join(parts))))


def _block_name(page: Page, i: int) -> str:
    while i and page.name[i] in INLINE:
        i = page.above[i]
    return page.name[i]


def sure_share(count: Column, of: Column, z: float = 1.96) -> Column:
    """The lower end of Wilson's interval for the share count / of."""
    share = count / of
    return (share + z * z / (2 * of) - z * F.sqrt((share * (1 - share) + z * z / (4 * of)) / of)) / (1 + z * z / of)


def deduce_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = 0.3, text_share: float = 0.8, least_tokens: int = 2) -> DataFrame:
    """(host, tokens, classes, places, weights, texts): each host's template.

    Elements count from a sure ``share`` of the host's distinct pages on (the lower end of a 95 %
    interval), texts from ``text_share`` on. Equal pages of a host count once. A template holds at
    most 1 / share times the tokens of a mean page, whatever the number of pages.
    """
    fields = "host string, page long, token long, n int, above long, place int, weight long, is_text boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, page in enumerate(batch.column("html")):
                rows += [(i, *t) for t in page_tokens(page.as_py())]
            at, token, n, above, place, weight, is_text = zip(*rows, strict=True) if rows else ((),) * 7
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("host").take(take), batch.column("page").take(take), pa.array(token, pa.int64()), pa.array(n, pa.int32()), pa.array(above, pa.int64()), pa.array(place, pa.int32()), pa.array(weight, pa.int64()), pa.array(is_text, pa.bool_())], names=["host", "page", "token", "n", "above", "place", "weight", "is_text"])

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = nested([x["token"] for x in row["found"]], [x["vector"] for x in row["found"]], [x["above"] for x in row["found"]], least_tokens)
                kept = [x for x in row["found"] if x["token"] in made]
                elements = [x for x in kept if not x["is_text"]]
                out.append((row["host"], [x["token"] for x in elements], [_class_name(made[x["token"]]) for x in elements], [x["place"] for x in elements], [x["weight"] for x in elements], [x["token"] for x in kept if x["is_text"] and x["sure"]]))
            host_, tokens, classes, places, weights, texts = zip(*out, strict=True) if out else ((),) * 6
            longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(host_, pa.string()), pa.array(tokens, longs), pa.array(classes, longs), pa.array(places, doubles), pa.array(weights, doubles), pa.array(texts, longs)], names=["host", "tokens", "classes", "places", "weights", "texts"])

    ship(pages.sparkSession)
    here = pages.select(host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("page", F.xxhash64("html"))
    each = here.mapInArrow(run, fields).distinct()
    vectors = each.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.max("is_text").alias("is_text"), F.max("above").alias("above"), F.avg("place").alias("place"), (F.sum("weight") / F.sum("n")).alias("weight")
    )
    vectors = save(vectors.where("pages > 1 OR NOT is_text"))  # a text of one page is no template's
    whole = vectors.where(F.col("token") == _hash(PAGE)).select("host", F.col("pages").alias("of"))
    sure = sure_share(F.col("pages"), F.col("of"))
    covering = vectors.where("pages > 1").join(whole, "host").withColumn("sure", sure >= text_share).where((sure >= share) & (~F.col("is_text") | F.col("sure")))
    found = covering.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "above", "place", "weight", "is_text", "sure")).alias("found"))
    return save(found.mapInArrow(nest, "host string, tokens array<long>, classes array<long>, places array<double>, weights array<double>, texts array<long>"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.3, text_share: float = 0.8) -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``.

    Null html counts as empty and gives an empty text; pages of a null or hostless address belong
    to the host "". Repeated rows each get their answer. Unclosed elements, stray brackets and
    unknown character references are taken as browsers take them, roughly. Other columns aren't
    read; an empty table gives no rows.
    """
    templates = deduce_templates(pages, url_col, html_col, share, text_share).withColumnRenamed("host", "of_host")
    id_kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_kind), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            hosts = batch.column("of_host").to_pylist()
            texts = []
            for i, (page, name) in enumerate(zip(batch.column("html"), hosts, strict=True)):
                if name is not None and name not in known:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    tokens, classes, places, weights, fixed = (batch.column(c)[i].as_py() for c in ("tokens", "classes", "places", "weights", "texts"))
                    known[name] = Template(dict(zip(tokens, classes, strict=True)), dict(zip(tokens, places, strict=True)), dict(zip(tokens, weights, strict=True)), frozenset(fixed))
                texts.append(main_text(page.as_py() or "", NONE if name is None else known[name]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    here = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return here.join(templates, host(F.col("url")) == F.col("of_host"), "left").select("id", "url", "html", "of_host", "tokens", "classes", "places", "weights", "texts").mapInArrow(run, schema)
