"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of tokens, its text blocks, each known by the path of its block elements. Adjacent repetitions
of a run of tokens are candidates for a repeated group, so pages of one template have few distinct skeletons however
long their texts are. The skeletons of a host are aligned one after the other. Each mismatch is resolved: tokens that
only some pages have become optional, tokens that pages hold in different numbers a repeated group, and a token whose
text differs between pages a text slot. What stays the same on all of its pages is template, inside an article too.

The wrapper then reads each page: its slots, optional ones and repeated groups as well, without the template. Elements
that can't be the article (menus, asides, forms, scripts and the like) and classes that name one wholly are out of the
wrapper. A word inside a class name says little (`share` may stand in share-prices), so it only counts where a wrapper
has met too few pages to tell. Skeletons and slots are aggregated over all pages before any wrapper is made.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomkit.llm.common import broadcast_if_small, cut

# Elements without content; elements that break text into blocks; elements and words of class, id or role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
OUTSIDE = frozenset("aside button canvas dialog fieldset footer form head iframe input label menu nav noscript object option script select style svg template textarea title".split())
MARKS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
HOLDS = frozenset("comment comments disqus promo promoted related respond sponsor sponsored".split())  # hold an article inside them outside wherever they stand in a name
HEADS = frozenset("banner header masthead".split())
LAYOUT = frozenset("has have hide is no not show with without".split())
MAIN = frozenset(["article", "main"])
RAW = frozenset(["script", "style"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header html main nav ol section table td th ul li".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LONGEST_GROUP = 8  # blocks in a repeated group
LONGEST_PATH = 200  # characters; of a longer one the hash stands for its beginning
FEWEST_PAGES = 3  # different ones that have a block, before an unchanging block counts as part of the template
GROUP, MOST_ITEMS = 500, 20_000  # wrappers that are aligned in one task, and items of a wrapper before another one is begun

# What a block is: the article's by its element, by its element but named like something else, other, other but named, outside.
MAIN_BLOCK, NAMED_MAIN, OTHER, NAMED, OUT = "+*.~-"


def tokens(page: str) -> Iterator[tuple[int, re.Match | None]]:
    """Where each tag starts, and its match; (length, None) ends the page. A quotation mark without its partner makes
    the rest be read without regard to them, so broken markup costs no more than time in proportion to its length."""
    at, last, pattern = 0, page.rfind(">"), TAG
    while 0 <= (at := page.find("<", at)) < last:
        found = pattern.match(page, at)
        if found is None and pattern is TAG and PLAIN_TAG.match(page, at):
            pattern = PLAIN_TAG
            continue
        if found is None:
            at += 1
            continue
        yield at, found
        at = found.end()
        if found[2] and not found[1] and (tag := found[2].lower()) in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else len(page)
    tail = page.find("<!--", max(at, last)) if at >= 0 else -1  # a comment that is left open hides the rest
    yield (tail if tail >= 0 else len(page)), None


def blocks(page: str | None) -> list[tuple[str, str, str]]:
    """The text blocks of a page in order: what each is, its path, its text."""
    out: list[tuple[str, str, str]] = []
    # tag, path, main, outside, whether articles inside are outside too, whether a word in a name marks it
    stack: list[tuple[str, str, bool, bool, bool, bool]] = [("", "", False, False, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, path, main, outside, _, named = stack[-1]
                out.append((OUT if outside else (NAMED_MAIN if named else MAIN_BLOCK) if main else NAMED if named else OTHER, path, text))
            parts.clear()

    def close(depth: int) -> None:
        if any(e[0] in BLOCKS for e in stack[depth:]) or stack[depth - 1][2:] != stack[-1][2:]:
            flush()
        for e in stack[depth:]:
            opened[e[0]] -= 1
        del stack[depth:]

    page = page or ""
    at, raw = 0, False
    for start, found in tokens(page):
        if start > at and not raw:
            parts.append(page[at:start])
        if found is None:
            break
        at, raw = found.end(), False
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if opened[tag]:
                close(next(d for d in range(len(stack) - 1, 0, -1) if stack[d][0] == tag))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        gone = CLOSES.get(tag, frozenset()) | ({"p"} if tag in BLOCKS else frozenset())
        if any(opened[g] for g in gone):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in gone:
                    close(depth)
                    break
                if stack[depth][0] in SCOPES:
                    break
        if tag in VOID:
            continue
        _, path, main, outside, held, named = stack[-1]
        values = [(m[2] or m[3] or m[4] or "").lower() for m in NAMES.finditer(found[3])]
        parted = [[w for w in re.split(r"[^a-z0-9]+", t) if w] for v in values for t in v.split()]
        words = {w for ws in parted for w in ws}
        # What a compound name is, its last word says (site-footer), unless the first makes it a layout (has-sidebar).
        whole = {ws[-1] for ws in parted if ws and ws[0] not in LAYOUT}
        is_main = tag in MAIN or "main" in words and re.search(r"role\s*=\s*[\"']?main", found[3], re.I) is not None
        if is_main:
            # A word inside a name (has-sidebar) or a form may be of the whole page's layout, so an article in it counts.
            outside, named = held, False
        elif tag not in ("html", "body"):
            held = held or tag in OUTSIDE - {"fieldset", "form"} or not main and tag == "header" or bool(words & HOLDS or {t for v in values for t in v.split()} & MARKS)
            outside = outside or tag in OUTSIDE or bool(whole & MARKS) or not main and (tag == "header" or bool(whole & HEADS)) or bool(words & HOLDS)
            named = named or tag in BLOCKS and (bool(words & MARKS) or not main and bool(words & HEADS))
        inner = path
        if tag in BLOCKS:
            inner = f"{path}/{tag}{''.join('.' + n for n in sorted(words))}"
            if len(inner) > LONGEST_PATH:
                inner = f"{xxhash.xxh3_64_hexdigest(inner)}/{tag}"
        if (main or is_main, outside, held, named) != stack[-1][2:]:
            flush()
        stack.append((tag, inner, main or is_main, outside, held, named))
        opened[tag] += 1
        raw = tag in RAW
    flush()
    return out


def fold(symbols: list[str]) -> tuple[list[str], list[int]]:
    """Collapses adjacent repetitions of groups of up to LONGEST_GROUP symbols; says which leaf each symbol went to."""
    leaves, sources = list(symbols), [[i] for i in range(len(symbols))]
    for size in range(1, LONGEST_GROUP + 1):
        kept: list[str] = []
        held: list[list[int]] = []
        for symbol, source in zip(leaves, sources, strict=True):
            kept.append(symbol)
            held.append(source)
            if kept[-size:] == kept[-2 * size : -size]:
                for j in range(size):
                    held[j - 2 * size] += held[j - size]
                del kept[-size:], held[-size:]
        leaves, sources = kept, held
    owner = [0] * len(symbols)
    for leaf, source in enumerate(sources):
        for i in source:
            owner[i] = leaf
    return leaves, owner


def skeleton(page: str | None) -> tuple[list[str], list[int], list[str]]:
    """Leaves of the folded page (what a block is, then the path), each block's leaf, each block's text."""
    found = blocks(page)
    leaves, owner = fold([kind + path for kind, path, _ in found])
    return leaves, owner, [text for *_, text in found]


def signature(leaves: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(leaves)) - (1 << 63)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def slots(pages: DataFrame) -> DataFrame:
    """(host, sig, place, leaf, pages, fixed, least, most) of each leaf of each distinct skeleton: its pages, those of
    equal texts counted once, the hash of its text if that is the same on all, and how many blocks they hold there."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                leaves, owner, texts = skeleton(page)
                held: list[list[str]] = [[] for _ in leaves]
                for leaf, text in zip(owner, texts, strict=True):
                    held[leaf].append(text)
                host, sig, whole = host_of(url), signature(leaves), xxhash.xxh3_64_intdigest("\n".join(texts)) - (1 << 63)
                rows += [(host, sig, i, leaf, xxhash.xxh3_64_intdigest("\n".join(t)) - (1 << 63), whole, len(t)) for i, (leaf, t) in enumerate(zip(leaves, held, strict=True))]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "sig", "place", "leaf", "slot", "page", "blocks"])

    found = pages.select("url", "html").mapInArrow(parse, "host string, sig long, place long, leaf string, slot long, page long, blocks long")
    # A row for each different page first, so that a host's many copies of one are combined before they meet.
    found = found.distinct()
    same = F.when(F.min("slot") == F.max("slot"), F.min("slot"))
    return found.groupBy("host", "sig", "place", "leaf").agg(F.count("*").alias("pages"), same.alias("fixed"), F.min("blocks").alias("least"), F.max("blocks").alias("most"))


def longest_common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two token lists; memory follows the shorter one, not their product."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    out = [(i, i) for i in range(start)]
    x, y = np.array(a[start : len(a) - stop], dtype=np.int64), np.array(b[start : len(b) - stop], dtype=np.int64)
    out += [(start + i, start + j) for i, j in common_pairs(x, y)]
    return out + [(len(a) - k, len(b) - k) for k in range(stop, 0, -1)]


def common_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of x and each beginning of y."""
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for v in x:
        row[1:] = np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0))
        np.maximum.accumulate(row, out=row)
    return row


def common_pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """By halving x: y is cut where the halves' common lengths add up to the most."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            found = np.flatnonzero(y[c:d] == x[a])
            if len(found):
                out.append((a, c + int(found[0])))
            continue
        middle = (a + b) // 2
        both = common_lengths(x[a:middle], y[c:d]) + common_lengths(x[middle:b][::-1], y[c:d][::-1])[::-1]
        split = c + int(np.argmax(both))
        todo += [(a, middle, c, split), (middle, b, split, d)]
    return sorted(out)


def joined(item: dict, new: dict) -> None:
    """Resolves what two aligned tokens differ in: other texts make a slot, other numbers of blocks a repeated group."""
    item["pages"] += new["pages"]
    item["fixed"] = new["fixed"] if item["fixed"] == new["fixed"] else None
    item["least"], item["most"] = min(item["least"], new["least"]), max(item["most"], new["most"])


def align(children: list[tuple[int, list[dict]]], most_items: int = MOST_ITEMS) -> list[tuple[list[dict], dict[int, list[int]]]]:
    """Aligns wrappers (id, items of leaf, pages, fixed, least and most) one after the other, those of the most pages
    first. Returns (wrapper of them, places there of each one's items by its id); a child that would make a wrapper
    longer than `most_items` begins another, so that layouts without anything in common can't pile up in one."""
    out: list[tuple[list[dict], dict[int, list[dict]]]] = []
    symbols: dict[str, int] = {}
    coded = lambda items: [symbols.setdefault(i["leaf"], len(symbols)) for i in items]
    for key, items in sorted(children, key=lambda c: (-max((i["pages"] for i in c[1]), default=0), c[0])):
        if not out or len(out[-1][0]) + len(items) > most_items:
            out.append(([], {}))
        wrapper, own = out[-1]
        pairs = longest_common(coded(wrapper), coded(items))
        merged: list[dict] = []
        own[key] = []
        i = j = 0
        for a, b in [*pairs, (len(wrapper), len(items))]:
            beside = [dict(item) for item in items[j:b]]  # only this one has them
            merged += wrapper[i:a] + beside
            own[key] += beside
            if b < len(items):
                joined(wrapper[a], items[b])
                merged.append(wrapper[a])
                own[key].append(wrapper[a])
            i, j = a + 1, b + 1
        out[-1] = (merged, own)
    placed = []
    for wrapper, own in out:
        place = {id(item): i for i, item in enumerate(wrapper)}
        placed.append((wrapper, {key: [place[id(item)] for item in items] for key, items in own.items()}))
    return placed


def shown(items: list[dict], total: int) -> str:
    """A wrapper as text: (path) for unchanging text, (path #TEXT) for a slot, then + for a group that pages repeat
    differently and ? for what not every page has."""
    each = lambda i: "(" + i["leaf"][1:] + (" #TEXT" if i["fixed"] is None else "") + ")" + ("+" if i["least"] < i["most"] else "") + ("?" if i["pages"] < total else "")
    return " ".join(map(each, items))


def leaves_to_read(leaves: Column, template: Column, total: Column) -> Column:
    """Which leaves of a page are the article: those of main elements if it has any, else all that no element marks as
    outside; not what the wrapper knows as template, unless nothing else is there. What a word inside a name marks is
    left to the wrapper if that has met pages enough, and else only read if there is nothing else."""
    kind = lambda leaf: F.substring(leaf, 1, 1)
    some = lambda flags: F.exists(flags, lambda f: f)
    main = F.transform(leaves, lambda leaf: kind(leaf).isin(MAIN_BLOCK, NAMED_MAIN))
    inside = F.transform(leaves, lambda leaf, i: (kind(leaf) != OUT) & (main[i] | ~some(main)))
    plain = F.transform(leaves, lambda leaf, i: inside[i] & ~kind(leaf).isin(NAMED_MAIN, NAMED))
    may = F.when((total >= FEWEST_PAGES) | ~some(plain), inside).otherwise(plain)
    varied = F.transform(may, lambda m, i: m & ~template[i])
    return F.when(some(varied), varied).otherwise(may)


ITEMS = "array<struct<leaf:string,pages:long,fixed:long,least:long,most:long>>"
ITEM_TYPE = pa.list_(pa.struct([("leaf", pa.string()), ("pages", pa.int64()), ("fixed", pa.int64()), ("least", pa.int64()), ("most", pa.int64())]))


def aligned(wrappers_: DataFrame) -> DataFrame:
    """Aligns groups of wrappers (host, id, items) of bounded number and length: a row for each, (host, id, parent,
    at), and its parent's items on the first one."""

    most_items = MOST_ITEMS

    def merge(key, table):
        out: dict[str, list] = {name: [] for name in ("host", "id", "parent", "at", "items")}
        for items, at in align([(r["id"], r["items"]) for r in table.to_pylist()], most_items):
            for n, (own, places) in enumerate(at.items()):
                for name, value in zip(out, (key[0].as_py(), own, next(iter(at)), places, None if n else items), strict=True):
                    out[name].append(value)
        types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), ITEM_TYPE]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    counts = wrappers_.groupBy("host").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum(F.size("items")) / max(1, 4 * most_items))).alias("groups"))
    dealt = wrappers_.join(broadcast_if_small(counts.filter("groups > 1")), "host", "left")
    dealt = dealt.withColumn("part", F.pmod("id", F.coalesce("groups", F.lit(1)))).select("host", "id", "part", "items")
    return cut(dealt.groupBy("host", "part").applyInArrow(merge, f"host string, id long, parent long, at array<int>, items {ITEMS}"))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, sig, read): the wrapper of each skeleton and whether to read each of the skeleton's leaves.

    Skeletons are aligned in groups, the groups' wrappers again, until no two of a host can be joined: no task holds
    more than a group, however many layouts a host has. What is template is then told down to the skeletons, a row for
    each item, so that no row carries a whole wrapper.
    """
    item = F.struct("place", "leaf", "pages", "fixed", "least", "most")
    first = slots(pages).groupBy("host", F.col("sig").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    first = cut(first.select("host", "id", F.transform("items", lambda i: F.struct(*[i[n].alias(n) for n in ("leaf", "pages", "fixed", "least", "most")])).alias("items")))
    levels = [aligned(first)]
    size = first.count()
    while True:
        above = levels[-1].filter("items IS NOT NULL").select("host", F.col("parent").alias("id"), "items")
        before, size = size, above.count()
        if size == before or not above.groupBy("host").count().filter("count > 1").take(1):
            break
        levels.append(aligned(above))

    @F.pandas_udf("string")
    def text(items: pd.Series) -> pd.Series:
        return pd.Series([shown(list(i), max(x["pages"] for x in i)) for i in items], dtype=object)

    top = above.select("host", F.col("id").alias("root"), text("items").alias("wrapper"), F.array_max(F.transform("items", lambda i: i["pages"])).alias("total"))
    told = above.select("host", "id", F.col("id").alias("root"), F.posexplode("items").alias("at", "item"))
    told = told.select("host", "id", "root", "at", (F.col("item.fixed").isNotNull() & (F.col("item.pages") >= FEWEST_PAGES)).alias("template"))
    for level in reversed(levels):
        below = level.select("host", "id", "parent", F.posexplode("at").alias("place", "at"))
        told = below.join(told.withColumnRenamed("id", "parent"), ["host", "parent", "at"]).select("host", "id", "root", F.col("place").alias("at"), "template")
    known = told.groupBy("host", "id", "root").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "template"))), lambda t: t["template"]).alias("template"))
    held = first.join(known, ["host", "id"]).join(top, ["host", "root"])
    read = leaves_to_read(F.transform("items", lambda i: i["leaf"]), F.col("template"), F.col("total"))
    return held.select("host", "wrapper", F.col("id").alias("sig"), read.alias("read"))


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of each page by its host's wrapper: page_id, url, text, n_chars (code points of text).

    Takes page_id, url and html; other columns are left out. The text is what the wrapper reads of the page: slots,
    optional and repeated blocks of article or main elements if the page has any, else of all blocks that aren't
    outside by their element or class; never a block whose text is the same on all pages of the wrapper that have it,
    if these are at least FEWEST_PAGES different ones (a page of nothing else keeps it). Character references are
    decoded, white space inside a block becomes one space, blocks are joined by a line feed. Nothing else is dropped
    and nothing is capped, however long a page is; reading takes time in proportion to its length, on broken markup
    too. Null or empty html, and pages without text, give an empty text. A null url, or one without ://, belongs to
    the host "". Repeated rows come out alike and ids may be null. An empty table gives an empty table.
    """
    reads = cut(wrappers(pages).select("host", "sig", "read"))

    @F.pandas_udf("struct<host:string,sig:long,owner:array<int>,texts:array<string>>")
    def parsed(urls: pd.Series, sources: pd.Series) -> pd.DataFrame:
        rows = []
        for url, page in zip(urls, sources, strict=True):
            leaves, owner, texts = skeleton(page)
            rows.append((host_of(url), signature(leaves), owner, texts))
        return pd.DataFrame(rows, columns=["host", "sig", "owner", "texts"])

    rows = pages.select("page_id", "url", parsed.asNondeterministic()("url", "html").alias("p")).select("page_id", "url", "p.*")
    joined_ = rows.join(broadcast_if_small(reads), ["host", "sig"], "left")
    chosen = F.expr("filter(texts, (t, i) -> read[owner[i]])")
    text = F.coalesce(F.array_join(chosen, "\n"), F.lit(""))
    return joined_.withColumn("text", text).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
