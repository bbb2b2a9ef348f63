"""Main text of web pages by wrapper inference.

Pages of one host are token streams. Within a page, equal neighbouring groups of tokens become a
repeated group. The streams of all pages of the host are then aligned with the wrapper so far, block by block
and the blocks' wrappers with each other, a union-free regular expression: what only one side has becomes optional, text that
differs becomes a slot. Beside it the wrapper counts, for each place of the layout, which share of a page's text
its slots hold, and how much of that is links.

The wrapper then decides what the article is: the place that holds most of the pages' text, from the
outside to the inside, as long as one place holds over half. Names of elements count as PRIOR pages
that vote for or against a place, so they decide on hosts of a page or two, and are a tie-break on others. A page is
read by aligning it with its host's wrapper: the slots of the article's place go out, but for
groups that are links, parts that their markup declares to be something else, and template text.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm.common import id_type, kept, table, written

#: Pages of a host that one task aligns, and wrappers that one task merges.
BLOCK, MERGED = 64, 16
#: With fewer pages, nothing counts as template text. Pages that an element's name counts as.
ENOUGH, PRIOR = 4, 4.0
#: A group with more of its text in links is a menu.
LINKED = 0.6
LONGEST_GROUP = 12

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_OUT = frozenset(
    "nav footer aside form script style noscript template iframe object svg math canvas audio video button select datalist textarea dialog menu head title".split()
)
_UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video select datalist textarea head title".split())
_MAIN = frozenset(["article", "main"])
#: Whole class and id names that declare something else than the article.
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising ad-slot sponsor sponsored promo promotion banner cookie cookies cookie-notice cookie-banner consent gdpr notice notices "
    "alert popup modal overlay sidebar side-bar rail menu main-menu nav main-nav navbar navigation breadcrumb breadcrumbs footer site-footer header site-header masthead topbar "
    "comment comments comment-list reply replies discussion disqus related related-posts recommended recommendations share sharing share-buttons social social-links "
    "subscribe subscription newsletter signup login search pagination pager toolbar widget hidden".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Which open elements a start tag closes.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div td th table ul ol dl body html nav aside header footer form blockquote figure button".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|title|svg|math|canvas|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|</?[a-zA-Z][^>]*\Z"
    r"|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements that can be the article's place, or a menu.
_PLACES = frozenset("html body div section main article center table tbody tr td".split())
_PLAIN = frozenset("div section center table tbody tr td".split())
_FIRST = re.compile(r"\s*(?:<!--.*?-->\s*)*+(?:</?([a-zA-Z][^\s/>]*)|[^<])", re.DOTALL)
_GROUPS = _PLACES | frozenset("ul ol dl".split())


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw.strip(" /\t\n\r") else {}


def _is_out(tag: str, attributes: dict[str, str], inside_main: bool) -> bool:
    """Whether an element's markup declares it to be something else than the article."""
    if tag in _OUT or (tag == "header" and not inside_main):
        return True
    if not attributes:
        return False
    names = {x.lower() for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split()}
    if tag in ("html", "body", "main"):
        names = set()
    return bool(names & _OUT_NAMES) or attributes.get("role") in _OUT_ROLES


def _is_hidden(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _UNSEEN:
        return True
    return bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", ""))


class Text:
    """A text of a page: its block, its place (the elements around it, but for inline ones), how deep the
    last of these is that is declared to be something else (0: none), whether a link, whether unseen."""

    __slots__ = ("block", "linked", "marked", "place", "raw", "unseen")

    def __init__(self, raw: str, block: int, place: tuple, marked: int, linked: bool, unseen: bool) -> None:
        self.raw, self.block, self.place, self.marked, self.linked, self.unseen = raw, block, place, marked, linked, unseen


class Open:
    """An open element: its tag, and what is inside of it."""

    __slots__ = ("linked", "main", "marked", "place", "tag", "unseen")

    def __init__(self, tag: str, place: tuple, marked: int, main: bool, linked: bool, unseen: bool) -> None:
        self.tag, self.place, self.marked, self.main, self.linked, self.unseen = tag, place, marked, main, linked, unseen


def parse(html: str | None):
    """(texts, signs, places): the token stream's signs are a tag, or # for text with its number in
    texts; places: of each place, how often it is there and its votes by markup (1, 0 or -1). Text
    between two block tags is one block."""
    texts: list[Text] = []
    signs: list[tuple[str, int]] = []
    places: dict[tuple, list[int]] = {}
    root = Open("", (), 0, False, False, False)
    stack: list[Open] = []
    block = 0
    for m in _TOKEN.finditer(html or ""):
        around = stack[-1] if stack else root
        if (raw := m[8]) is not None:
            if texts and signs[-1][0] == "#" and texts[-1].block == block:  # a "<" within text, or a comment
                texts[-1].raw += raw
                continue
            if raw.strip() or (texts and texts[-1].block == block):
                texts.append(Text(raw, block, around.place, around.marked, around.linked, around.unseen))
                signs.append(("#", len(texts) - 1))
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            if texts and texts[-1].block == block:
                texts[-1].raw += " "
            signs.append(("br", -1))
            continue
        if tag not in _INLINE:
            block += 1
        if closing:
            signs.append((f"/{tag}", -1))
            if any(x.tag == tag for x in stack):
                while stack.pop().tag != tag:
                    pass
            continue
        closes = _CLOSES.get(tag) or (set() if tag in _INLINE else {"p"})
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in closes:
                del stack[i:]
                break
            if stack[i].tag in _SCOPE and not (stack[i].tag in ("td", "th") and tag == "tr"):
                break
        found = _attributes(attributes)
        kind = found.get("class", "").split()
        sign = f"{tag}.{kind[0]}" if kind else tag
        signs.append((sign, -1))
        if tag in _VOID:
            continue
        around = stack[-1] if stack else root
        main = tag in _MAIN or found.get("role") == "main" or found.get("itemprop") == "articleBody"
        out, place = _is_out(tag, found, around.main), around.place
        if tag not in _INLINE:
            if not kind and tag in _PLAIN:  # without a name, what it begins with tells it from its neighbours
                first = _FIRST.match(html, m.end())
                sign = f"{tag}#{found['id'].split()[0]}" if found.get("id", "").strip() else f"{tag}>{(first[1] or '#').lower() if first else ''}"
            place = (*place, sign)
            seen = places.setdefault(place, [0, -1 if out else int(main)])
            seen[0] += 1
        stack.append(Open(tag, place, len(place) if out and tag not in _INLINE else around.marked, around.main or main, around.linked or tag == "a", around.unseen or _is_hidden(tag, found)))
    return texts, signs, places


class Item:
    """A part of a stream or wrapper: its sign, and the numbers of its texts or its template text; of a
    wrapper, how many pages have it, the votes for its text (pages with it less those with another), and
    the characters of its texts."""

    __slots__ = ("chars", "const", "pages", "sign", "texts", "votes")

    def __init__(self, sign: str, texts: list[int], const: str | None = None, pages: int = 1, votes: int = 0, chars: int = 0) -> None:
        self.sign, self.texts, self.const, self.pages, self.votes, self.chars = sign, texts, const, pages, votes, chars


def repeats(items: list[Item]) -> list[Item]:
    """Equal neighbouring groups, short ones first, become one repeated group."""
    for size in range(1, LONGEST_GROUP + 1):
        signs, out, i = [x.sign for x in items], [], 0
        while i < len(items):
            k = 1
            while signs[i + k * size : i + (k + 1) * size] == signs[i : i + size] and i + (k + 1) * size <= len(items):
                k += 1
            if k > 1 and "#" in "".join(signs[i : i + size]):
                out.append(Item(f"({' '.join(signs[i : i + size])})+", [t for x in items[i : i + k * size] for t in x.texts]))
                i += k * size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def fold(items: list[Item], others: list[Item]) -> list[Item]:
    """A group that repeats in `others` and stands once in items becomes a repeated group."""
    for group in {x.sign for x in others if x.sign.endswith(")+")}:
        inner = group[1:-2]
        signs, out, i = [x.sign for x in items], [], 0
        size = next((n for n in range(1, min(LONGEST_GROUP, len(signs)) + 1) if any(" ".join(signs[j : j + n]) == inner for j in range(len(signs) - n + 1))), 0)
        if not size:
            continue
        while i < len(items):
            if " ".join(signs[i : i + size]) == inner:
                part = items[i : i + size]
                consts = [x.const for x in part if "#" in x.sign]
                const = " ".join(consts) if consts and None not in consts else None
                out.append(Item(group, [t for x in part for t in x.texts], const, part[0].pages, min((x.votes for x in part if "#" in x.sign), default=0) if const else 0, sum(x.chars for x in part)))
                i += size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _tag(sign: str) -> str:
    return re.split(r"[.#>]", sign, maxsplit=1)[0]


def stream(html: str | None) -> tuple[list[Text], list[Item], dict[str, list]]:
    """(texts, items, places). Of each place that can be the article or a menu: pages, times there,
    votes by markup, the share of the page's text, characters, and those in links."""
    texts, signs, found = parse(html)
    total = sum(len(x.raw) for x in texts if not x.unseen and not x.linked)
    held: dict[tuple, list] = {place: [1, n, vote, 0.0, 0, 0] for place, (n, vote) in found.items() if _tag(place[-1]) in _GROUPS}
    for x in texts:
        if x.unseen:
            continue
        for k in range(1, len(x.place) + 1):
            if (own := held.get(x.place[:k])) is not None:
                own[3] += 0 if x.linked else len(x.raw) / total
                own[4] += len(x.raw)
                own[5] += len(x.raw) * x.linked
    return texts, repeats([Item(s, [t] if t >= 0 else []) for s, t in signs]), {" ".join(p): v for p, v in held.items()}


def article(places: dict[str, list], pages: int) -> tuple[str, list[str]]:
    """(the article's place, the places of menus in it): from the outside to the inside, as long as one
    place that is there once a page, or is declared to be the article, has most of the votes: the shares of
    the pages' text, and PRIOR pages for or against it by markup."""
    inner: dict[str, list[str]] = {}
    for place in places:
        inner.setdefault(place.rpartition(" ")[0], []).append(place)
    at, votes, declared = "", float(pages), False
    while True:
        best, most = "", 0.0
        for place in inner.get(at, []):
            own, times, vote, share, _, _ = places[place]
            prior = PRIOR * vote / own
            if _tag(place.rpartition(" ")[2]) in _PLACES and (vote > 0 or times <= 1.5 * own) and (share + prior, place) > (most, best):
                best, most = place, share + prior
        if not best or 2 * most <= votes + PRIOR * max(0.0, places[best][2] / places[best][0]):
            break
        at, votes = best, max(places[best][3], 1e-9)
        declared |= places[best][2] > 0
    begin = f"{at} " if at else ""
    menus = [] if declared else [p for p, v in places.items() if p.startswith(begin) and v[4] and v[5] > LINKED * v[4]]
    return at, menus


def _text(texts: list[Text], numbers: list[int]) -> str:
    return " ".join(" ".join(unescape(texts[t].raw) for t in numbers).split())


def _matches(a: list[Item], b: list[Item]):
    return SequenceMatcher(None, [x.sign for x in a], [x.sign for x in b], autojunk=False)


def _const(texts: list[Text], numbers: list[int]) -> str:
    """A text as wrappers hold it: a long one by its digest."""
    text = _text(texts, numbers)
    return text if len(text) <= 64 else "\0" + blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def page_items(html: str | None) -> dict:
    """The wrapper of one page: items [sign, text or null, pages, votes, characters], and
    places."""
    texts, items, places = stream(html)
    made = [[x.sign, _const(texts, x.texts) if x.texts else None, 1, int(bool(x.texts)), sum(len(texts[t].raw) for t in x.texts if not texts[t].unseen)] for x in items]
    return {"items": made, "places": places}


def _both(x: Item, y: Item) -> Item:
    """Majority votes: a text in over half of the pages of both stays, whatever their order."""
    chars = x.chars + y.chars
    if x.const == y.const:
        return Item(x.sign, [], x.const, x.pages + y.pages, x.votes + y.votes, chars)
    most, least = (x, y) if (x.votes, x.const or "") >= (y.votes, y.const or "") else (y, x)
    votes = most.votes - least.votes
    return Item(x.sign, [], most.const if votes else None, x.pages + y.pages, votes, chars)


def merge(parts: list[dict]) -> dict:
    """The wrapper of some wrappers. Those of equal signs are taken together first."""
    alike: dict[tuple, list[Item]] = {}
    places: dict[str, list] = {}
    for part in parts:
        for place, counts in part["places"].items():
            places[place] = [x + y for x, y in zip(places[place], counts, strict=True)] if place in places else counts
        signs, items = tuple(x[0] for x in part["items"]), [Item(s, [], c, n, v, z) for s, c, n, v, z in part["items"]]
        alike[signs] = [_both(x, y) for x, y in zip(alike[signs], items, strict=True)] if signs in alike else items
    wrapper: list[Item] | None = None
    for items in alike.values():
        if wrapper is None:
            wrapper = items
            continue
        items, wrapper = fold(items, wrapper), fold(wrapper, items)
        merged = []
        for op, a, b, c, d in _matches(wrapper, items).get_opcodes():
            if op == "equal":
                merged += [_both(x, y) for x, y in zip(wrapper[a:b], items[c:d], strict=True)]
            else:
                merged += wrapper[a:b] + items[c:d]
        wrapper = merged
    return {"items": [[x.sign, x.const, x.pages, x.votes, x.chars] for x in wrapper or []], "places": places}


def closed(wrapper: dict, pages: int, least: int = 0) -> dict:
    """Items as [sign, template text or null, optional], how many pages, and the places of the article and
    of menus. Template text has votes of over half of the pages: it stands in more than half, and all text in
    over three quarters is. Where it holds over half of all text, or there are few pages, they are copies of one article and none is."""
    alike = [c is not None and 2 * v > pages for _, c, _, v, _ in wrapper["items"]]
    sizes = [z for *_, z in wrapper["items"]]
    copies = pages < ENOUGH or 2 * sum(z for z, a in zip(sizes, alike, strict=True) if a) > sum(sizes)
    found = [[s, c if a and not copies else None, int(n < pages)] for (s, c, n, _, _), a in zip(wrapper["items"], alike, strict=True) if n > least]
    main, menus = article(wrapper["places"], pages)
    return {"main": main, "menus": menus, "items": found}


def infer(pages: list[str]) -> dict:
    """The wrapper of some pages."""
    return closed(merge([page_items(x) for x in pages]), len(pages))


@lru_cache(maxsize=256)
def _loaded(wrapper: str) -> tuple[dict, list[Item]]:
    found = json.loads(wrapper)
    return found, [Item(s, [], c) for s, c, _ in found["items"]]


def _within(text: Text, main: tuple, menus: list[tuple]) -> bool:
    return not text.unseen and text.place[: len(main)] == main and text.marked <= len(main) and not any(text.place[: len(p)] == p for p in menus)


def _parts(place: str) -> tuple:
    return tuple(place.split())


def extract(html: str | None, wrapper: str | None) -> str:
    """The main text: the blocks of the article's place, without those of template text. A page that has no text
    there, or no wrapper, is its own wrapper."""
    texts, items, places = stream(html)
    own: list[int] = []
    template: set[int] = set()
    if wrapper:
        found, known = _loaded(wrapper)
        main, menus = _parts(found["main"]), [_parts(p) for p in found["menus"]]
        own = [t for t, x in enumerate(texts) if _within(x, main, menus)]
        if own and any(x.const for x in known):
            items = fold(items, known)
            for a, b, n in _matches(known, items).get_matching_blocks():
                for x, y in zip(known[a : a + n], items[b : b + n], strict=True):
                    if x.const and y.texts and x.const == _const(texts, y.texts):
                        template.update(y.texts)
    if not own:
        main, menus = article(places, 1)
        main, menus = _parts(main), [_parts(p) for p in menus]
        own = [t for t, x in enumerate(texts) if _within(x, main, menus)]
    # A block goes as a whole or not at all: a phrase that varying sentences share is no template text.
    varied = {texts[t].block for t in own if t not in template and texts[t].raw.strip()}
    blocks: dict[int, list[str]] = {}
    for t in own:
        if texts[t].block in varied:
            blocks.setdefault(texts[t].block, []).append(unescape(texts[t].raw))
    return " ".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def wrappers(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper as JSON) from all distinct pages of each host: of blocks of pages, which are merged
    as a tree. Only what stands in over half of a host's pages is kept in the end, as no other text counts."""
    import pandas as pd
    import pyarrow as pa

    pages = df.select(host(url_col).alias("host"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).where("html IS NOT NULL")

    def parsed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = pa.array([json.dumps(page_items(x), ensure_ascii=False) for x in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["host", "h", "items"])

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("h")
        found = merge([json.loads(v) for v in x["items"]])
        return pd.DataFrame({"host": [x.host.iloc[0]], "h": [x.part.iloc[0]], "n": [x.n.iloc[0]], "items": [json.dumps(found, ensure_ascii=False)]})

    def last(items, n):
        return json.dumps(closed(json.loads(items), n, n // 2), ensure_ascii=False)

    each = written(pages.mapInArrow(parsed, "host string, h bigint, items string").groupBy("host", "h").agg(F.first("items").alias("items")), "streams")
    sizes = written(each.groupBy("host").agg(F.count("*").alias("n")), "sizes")
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    level = each.join(sizes, "host").withColumn("part", F.pmod("h", F.ceil(F.col("n") / BLOCK)))
    parts = -(-most // BLOCK)
    while True:
        level = written(level.groupBy("host", "part").applyInPandas(run, "host string, h bigint, n bigint, items string"), "partial")
        if parts <= 1:
            return level.select("host", F.udf(last, "string")("items", "n").alias("wrapper"))
        parts = -(-parts // MERGED)
        level = level.withColumn("part", F.floor(F.col("h") / MERGED))


def main_text(df: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`keep` and text, the main text of every whole page ('' if none).

    Null pages are empty. Pages without a host share one wrapper. Character references are decoded,
    white space within a block becomes one space, blocks are joined by one space in page order.
    Repeated rows are read one by one, and count once for the wrapper. A kept column named text gives
    way to the text made here; other columns play no part. Pages of any length are read whole; of an empty
    table there are no rows.
    """
    import pyarrow as pa

    keep = tuple(kept(keep, ("text",)))
    known = written(wrappers(df, url_col, html_col), "wrappers").select(F.col("host").alias("__host"), "wrapper")
    rows = df.select(*keep, F.col(html_col).alias("__html"), host(url_col).alias("__h")).join(known, F.col("__h") == F.col("__host"), "left")
    rows = rows.select(*keep, "__html", "wrapper")
    types = ", ".join(f"`{c}` {id_type(rows, c)}" for c in keep)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                pages, own = (part.column(len(keep) + i).to_pylist() for i in (0, 1))
                text = pa.array([extract(p, w) for p, w in zip(pages, own, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), text], names=[*keep, "text"])

    return rows.mapInArrow(run, f"{types}, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of every row of pages."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLES: dict[str, str] = {}
