"""HTML extraction by wrappers.

A host's wrapper is a regular expression without unions over tags and text slots, inferred from all pages of the host.
Token streams are aligned element by element: what stands under the same path of elements meets. Children that some
occurrence of their parent lacks are optional; children that follow each other in either order, or themselves, make a
repeated group; text that differs between pages is a slot, text that never does belongs to the wrapper. Which child
follows which, and what a path's text is, adds up over pages in any order, so a host's pages may be anywhere and no task
holds a host. The wrapper decides what of a page is main text: its region is the smallest element that holds all slots
which neither the page's marks nor the wrapper (text that is the same on all pages, repeated groups of links) tell to be
surroundings. Every page is matched against the part of the expression that half of the host's pages share; a page that
doesn't match isn't of the wrapper's making, so its own marks decide alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .urls import host_of

#: Elements whose end or start parts blocks of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text; and those whose content is no markup.
OUTSIDE = frozenset("head title nav footer aside form script style noscript template button select textarea svg iframe object menu dialog canvas audio video map".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
#: Words of class, id and role that mark what is around the main text, and those that mark the main text.
AROUND = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments respond reply replies discussion cookie cookies consent notice notices alert warning popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations widget toolbar pagination pager skip complementary contentinfo search".split())
MAIN = frozenset("article main content post entry story body text".split())
#: Words before a mark that tell a state of the element instead ("has-sidebar"), and marks that a main word before them turns into the main text's own ("entry-header").
STATES, HEADS = frozenset("has no not is with without hide show".split()), frozenset(("header", "masthead", "banner"))
#: A path's text is the wrapper's own if it is the same on so many different pages at least, and on half of the host's.
FIXED_PAGES = 3
#: Share of a repeated group's text that is links if the group is a menu.
LINKS = 0.8
#: Elements deeper than this, and longer labels, share the path of what stands above them.
DEPTH, LABEL = 48, 40
#: Bytes of all hosts' regions up to which they go to every task; beyond, they are joined by host.
SHIPPED = 16 << 20

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|([^<]+)|<(?![a-zA-Z/!?])", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Of a wrapper's paths: of each child, its place in the expression, whether it may come again, whether it must come.
Frame = dict[str, dict[str, tuple[int, bool, bool]]]

_CUT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, more): start and end tags with their attributes, and texts. Comments, declarations and raw content are left out."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        if m is None:  # no tag name after </, which goes up to the next >; a tag that never ends has no text after it
            at = page.find(">", at) + 1
            if not at:
                return
            continue
        at = m.end()
        if m[4] is not None:
            yield "text", "", m[4]
        elif m[2] is not None:
            name = m[2].lower()
            yield ("end" if m[1] else "start"), name, m[3]
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
                yield "end", name, ""
        elif m[0] == "<":
            yield "text", "", "<"


@lru_cache(20_000)
def marked(word: str) -> tuple[frozenset[str], bool]:
    """The marks of surroundings that a word of class, id or role has, and whether it marks the main text. Words are cut at hyphens, underscores and capitals."""
    parts = [p.lower() for p in _CUT.findall(word)]
    if not parts or parts[0] in STATES:
        return frozenset(), False
    around, main = AROUND.intersection((parts[0], parts[-1])), not MAIN.isdisjoint(parts)
    if main and around <= HEADS:
        return frozenset(), not around
    return around, main and not around


def marks(name: str, more: str) -> tuple[frozenset[str], bool, str]:
    """The marks of surroundings in an element's own attributes, whether they mark the main text, and its class as its name goes on with.

    What holds the whole page, or is the main text by its name, is marked by whole words at most: an article may be a comment.
    """
    around: frozenset[str] = frozenset()
    main, label = False, ""
    if "=" in more or "hidden" in more.lower():
        for attr, a, b, c in _ATTR.findall(more):
            attr, value = attr.lower(), a or b or c
            if attr == "hidden":
                around |= {"hidden"}
            elif attr in ("class", "id", "role"):
                for word in value.split():
                    off, here = marked(word)
                    around, main = around | (off if name != "article" or word.lower() in AROUND else off - off), main or here
                if attr == "class" and value:
                    label = ("." + ".".join(_DIGITS.sub("", value.replace("/", "")).split()))[:LABEL]
    return frozenset() if name in ("html", "body", "main") else around, main, label


class Page:
    """What one walk over a page gives: ``blocks``, the texts with path, roles and how much of them is links, and the
    children of each element: ``follows`` (path, one child, the next), ``holds`` (path, child): occurrences of the path
    that have the child, and ``seen``: occurrences of the path. # is a text, ^ and $ are an element's begin and end."""

    def __init__(self, source: str, structure: bool = False, frame: Frame | None = None):
        self.fits = True  # what matches ``frame``
        self.blocks: list[tuple[str, bool, bool, str, int]] = []  # path, main, around, text, characters in links
        self.shape: list[str] = []
        self.follows: set[tuple[str, str, str]] = set()
        self.holds: dict[tuple[str, str], int] = {}
        self.seen: dict[str, int] = {"": 1}
        self.several: set[str] = set()  # paths with more than one occurrence in one parent
        # of each open element: name, path, main, around, last child, children so far, place in the frame
        stack: list[list] = [["", "", False, False, "^", set(), 0]]
        opened: dict[str, int] = {}
        run: list[str] = []
        links = linked = 0

        def child(key: str) -> None:
            top = stack[-1]
            if structure:
                self.follows.add((top[1], top[4], key))
                if key not in top[5]:
                    self.holds[top[1], key] = self.holds.get((top[1], key), 0) + 1
                self.shape.append(key)
            if frame is not None and (rule := frame.get(top[1], {}).get(key)):
                place, again, _ = rule
                self.fits = self.fits and place >= top[6] and (again or key not in top[5])
                top[6] = place
            if key in top[5]:
                self.several.add(f"{top[1]}/{key}")
            top[4] = key
            top[5].add(key)

        def close() -> None:
            nonlocal linked
            text = " ".join(html.unescape("".join(run)).split()) if run else ""
            run.clear()
            if text:
                top = stack[-1]
                if top[4] != "#":
                    child("#")
                self.blocks.append((top[1], top[2], top[3], text, min(linked, len(text))))
            linked = 0

        def whole(path: str, children: set[str]) -> None:
            if frame is not None and self.fits:
                self.fits = all(k in children for k, (_, _, must) in frame.get(path, {}).items() if must)

        def leave() -> None:
            name, path, _, _, last, children, _ = stack.pop()
            opened[name] -= 1
            whole(path, children)
            if structure:
                self.follows.add((path, last, "$"))
                self.shape.append("/")

        for kind, name, more in tokens(source):
            if kind == "text":
                run.append(more)
                linked += len(more) if links else 0
                continue
            if name not in BLOCKS and name not in OUTSIDE:
                if name == "br":
                    run.append(" ")
                elif name == "a":
                    links = int(kind == "start")
                continue  # inline elements are part of their text
            close()
            if kind == "end":
                if opened.get(name):
                    while stack[-1][0] != name:
                        leave()
                    leave()
                continue
            words, here, label = marks(name, more)
            if name in ("p", "li", "dd", "dt", "td", "th", "tr", "option") and stack[-1][0] == name or name in BLOCKS and stack[-1][0] == "p":
                leave()  # an end tag that may be left out
            _, path, main, around, *_ = stack[-1]
            off = around or name in OUTSIDE or bool(words - HEADS if main else words) or (name == "header" and not main)
            here = main or name in ("article", "main") or (name in ("div", "section", "td") and here and not words)
            key = name + label
            deep = path if len(stack) > DEPTH else f"{path}/{key}"
            child(key)
            if name not in VOID:
                self.seen[deep] = self.seen.get(deep, 0) + 1
                stack.append([name, deep, here, off, "^", set(), 0])
                opened[name] = opened.get(name, 0) + 1
            elif structure:
                self.shape.append("/")
        close()
        while len(stack) > 1:
            leave()
        whole("", stack[0][5])
        if structure:
            self.follows.add(("", stack[0][4], "$"))


def arranged(follows: Iterable[tuple[str, str]]) -> list[tuple[list[str], bool]]:
    """An element's children in the order of its expression, from which child may follow which (^ begins, $ ends): groups, and whether they repeat.

    Children that can be reached from each other make a repeated group, a child that follows itself a repeated one.
    """
    after: dict[str, set[str]] = {}
    for a, b in follows:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())
    groups = [sorted(group - {"^", "$"}) for group in components(after)]
    return [(g, len(g) > 1 or g[0] in after[g[0]]) for g in groups if g]


def pattern(follows: Iterable[tuple[str, str]], always: set[str], inner) -> str:
    """A regular expression without unions for one element's children, as ``arranged``.

    Children of a repeated group, and those that aren't in ``always``, are optional. ``inner`` gives a child's own text.
    """
    out = []
    for group, again in arranged(follows):
        if len(group) > 1:
            out.append(f"(?:{''.join(f'(?:{inner(k)})?' for k in group)})+" + "?" * (not any(k in always for k in group)))
        else:
            (k,) = group
            out.append(f"(?:{inner(k)})" + ("+" if again else "") if k in always else f"(?:{inner(k)})" + ("*" if again else "?"))
    return "".join(out)


def components(after: dict[str, set[str]]) -> list[set[str]]:
    """The strongly connected components of a graph, each before those that can be reached from it; equal ones by name."""
    order: list[str] = []
    seen: set[str] = set()
    for root in sorted(after, reverse=True):
        stack = [(root, iter(sorted(after[root], reverse=True)))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if nxt not in seen:
                    seen.add(nxt)
                    stack.append((nxt, iter(sorted(after[nxt], reverse=True))))
                    break
            else:
                order.append(node)
                stack.pop()
    before: dict[str, set[str]] = {n: set() for n in after}
    for a, bs in after.items():
        for b in bs:
            before[b].add(a)
    out, taken = [], set()
    for root in reversed(order):
        if root in taken:
            continue
        group, todo = set(), [root]
        while todo:
            n = todo.pop()
            if n not in taken:
                taken.add(n)
                group.add(n)
                todo += [m for m in before[n] if m not in taken]
        out.append(group)
    return out


def expression(pages: list[Page], path: str = "") -> str:
    """The wrapper of pages (walked with ``structure``) below a path, as a Python regular expression over ``shape`` joined by spaces."""
    follows = {(a, b) for p in pages for at, a, b in p.follows if at == path}
    seen = sum(p.seen.get(path, 0) for p in pages)
    always = {b for _, b in follows if sum(p.holds.get((path, b), 0) for p in pages) == seen}

    def inner(key: str) -> str:
        if key == "#":
            return "# "
        return f"{re.escape(key)} " + ("" if key.partition(".")[0] in VOID else expression(pages, f"{path}/{key}")) + "/ "

    return pattern(follows, always, inner)


def hash_text(text: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


_NODE = "host string, path string, n bigint, pages array<bigint>, least bigint, most bigint, chars bigint, links bigint, main boolean, several boolean"
_EDGE = "host string, path string, a string, b string"


class Nodes:
    """For each path of a host: pages that have it, the least FIXED_PAGES hashes of different ones, the least and largest hash of its text, its characters, and those in links."""

    def __init__(self):
        self.held: dict[tuple[str, str], list] = {}

    def add(self, host: str, source: str) -> None:
        page, texts = Page(source), {}
        for path, main, around, text, links in page.blocks:
            if not around:
                texts.setdefault(path, [main, [], 0])[1].append(text)
                texts[path][2] += links
        digest = hash_text(source)
        for path, (main, parts, links) in [("", (False, [], 0)), *texts.items()]:
            value = "\n".join(parts)
            h, chars = hash_text(value), len(value)
            had = self.held.get((host, path))
            several = path in page.several
            if had is None:
                self.held[host, path] = [1, [digest], h, h, chars, links, main, several]
                continue
            had[0] += 1
            if len(had[1]) < FIXED_PAGES or digest < had[1][-1]:
                had[1] = sorted({*had[1], digest})[:FIXED_PAGES]
            had[2], had[3] = min(had[2], h), max(had[3], h)
            had[4], had[5] = had[4] + chars, had[5] + links
            had[6], had[7] = had[6] or main, had[7] or several

    def rows(self) -> pa.RecordBatch:
        cols = list(zip(*((*k, *v) for k, v in self.held.items()), strict=True))
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * 4, pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in _NODE.split(", ")])


def infer(pages: DataFrame) -> DataFrame:
    """The slots of every host's wrapper: host, path, n (pages that have it; of path "" all), pages, least, most, chars, links, main, several.

    ``pages``: host, html; null html counts as empty. ``least`` and ``most`` differ if the path's text does between pages.
    Tasks add up before anything is exchanged; a host's pages needn't meet. No rows for an empty table.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = Nodes()
        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                nodes.add(host, source.as_py() or "")
                if len(nodes.held) > 50_000:
                    yield nodes.rows()
                    nodes = Nodes()
        if nodes.held:
            yield nodes.rows()

    parts = pages.select(F.coalesce("host", F.lit("")).alias("host"), "html").mapInArrow(fold, _NODE)
    least = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(c))), 1, FIXED_PAGES)
    # A path of a hot host comes from every task: two steps keep what one group collects small.
    some = parts.groupBy("host", "path", F.pmod(F.hash("least", "n", "chars"), F.lit(64)).alias("salt")).agg(*_added(least))
    return some.groupBy("host", "path").agg(*_added(least))


def _added(least) -> list[Column]:
    return [F.sum("n").alias("n"), least(F.collect_list("pages")).alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.max("main").alias("main"), F.max("several").alias("several")]


def _edges(pages: DataFrame) -> DataFrame:
    """Which child follows which below each path of a host: host, path, a, b; with b empty, how many occurrences of the path hold a, and pages; with a empty too, of the path itself."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str, str], list[int]] = {}
        for batch in batches:
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = Page(source.as_py() or "", True)
                for path, a, b in page.follows:
                    held.setdefault((host, path, a, b), [0, 0, 0])
                for (path, key), n in page.holds.items():
                    add = held.setdefault((host, path, key, ""), [0, 0, 0])
                    add[0], add[2] = add[0] + n, add[2] + 1
                for path, n in page.seen.items():
                    add = held.setdefault((host, path, "", ""), [0, 0, 0])
                    add[1], add[2] = add[1] + n, add[2] + 1
                if len(held) > 50_000:
                    yield rows(held)
                    held = {}
        if held:
            yield rows(held)

    def rows(held: dict) -> pa.RecordBatch:
        cols = list(zip(*((*k, *v) for k, v in held.items()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 4 else pa.int64()) for i, c in enumerate(cols)], names=["host", "path", "a", "b", "holds", "seen", "pages"])

    parts = pages.select(F.coalesce("host", F.lit("")).alias("host"), "html").mapInArrow(fold, _EDGE + ", holds bigint, seen bigint, pages bigint")
    return parts.groupBy("host", "path", "a", "b").agg(*[F.sum(c).alias(c) for c in ("holds", "seen", "pages")])


def _always(found: list[dict]) -> set[str]:
    seen = sum(r["seen"] for r in found)
    return {r["a"] for r in found if r["a"] and not r["b"] and r["holds"] == seen}


def grammar(pages: DataFrame) -> DataFrame:
    """host, path, pattern: the children of every element of a host's wrapper as a regular expression without unions. ``pages``: host, html."""

    def one(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        shown = pattern([(r["a"], r["b"]) for r in found if r["b"]], _always(found), lambda k: f"{k} ")
        return pa.table({"host": table["host"][:1], "path": table["path"][:1], "pattern": pa.array([shown], pa.string())})

    return _edges(pages).groupBy("host", "path").applyInArrow(one, "host string, path string, pattern string")


def frames(pages: DataFrame, slots: DataFrame) -> DataFrame:
    """host and frame: the rules (path, key, place, again, must) of the host's expression for the children that half of its pages have.

    ``pages``: host, html; ``slots``: ``infer``'s rows of them. A frame is no more than twice as large as a page.
    """
    kinds = {"host": pa.string(), "path": pa.string(), "key": pa.string(), "place": pa.int32(), "again": pa.bool_(), "must": pa.bool_(), "pages": pa.int64()}

    def one(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        always, on = _always(found), {r["a"]: r["pages"] for r in found if r["a"] and not r["b"]}
        made = [(found[0]["host"], found[0]["path"], k, place, again, k in always, on[k]) for place, (group, again) in enumerate(arranged((r["a"], r["b"]) for r in found if r["b"])) for k in group]
        return pa.table([pa.array([m[i] for m in made], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    rules = _edges(pages).groupBy("host", "path").applyInArrow(one, "host string, path string, key string, place int, again boolean, must boolean, pages bigint")
    whole = slots.where("path = ''").select("host", F.col("n").alias("all"))
    return rules.join(whole, "host").where("pages * 2 >= all").groupBy("host").agg(F.collect_list(F.struct("path", "key", "place", "again", "must")).alias("frame"))


def regions(slots: DataFrame) -> DataFrame:
    """host, region (a path) and off (paths that are the wrapper's own text, or menus) of every host, from ``infer``'s rows.

    The region is the smallest element that holds all other slots, of main elements if the host has some. ``off`` are on
    half of the host's pages at least, so they are no more than twice as many as a page's paths.
    """
    whole = slots.where("path = ''").select("host", F.col("n").alias("all"))
    own = slots.where("path <> ''").join(whole, "host")
    varies = F.col("least") != F.col("most")
    often = F.col("n") * 2 >= F.col("all")
    fixed = ~varies & (F.size("pages") >= FIXED_PAGES) & often
    menu = F.col("several") & (F.col("links") >= LINKS * F.col("chars")) & often
    told = own.select("host", "path", "main", varies.alias("varies"), (~F.col("main") & (fixed | menu)).alias("off"))
    data = lambda also: F.when(~F.col("off") & also, F.col("path"))
    by = told.groupBy("host").agg(
        *[f(data(F.col("main"))).alias(f"{n}_main") for f, n in ((F.min, "low"), (F.max, "high"))],
        *[f(data(F.lit(True))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))],
        F.max("varies").alias("varies"), F.array_sort(F.collect_list(F.when(F.col("off"), F.col("path")))).alias("off"),
    )
    low, high = F.coalesce("low_main", "low", F.lit("")), F.coalesce("high_main", "high", F.lit(""))
    # All paths between the least and the largest begin with what these two have in common.
    a, b = F.split(low, "/"), F.split(high, "/")
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    until = F.coalesce(F.array_position(same, False) - 1, F.size(a)).cast("int")
    region = F.array_join(F.slice(a, 1, F.when(F.array_position(same, False) > 0, until).otherwise(F.least(F.size(a), F.size(b)))), "/")
    return by.select("host", region.alias("region"), F.when(F.col("varies"), F.col("off")).otherwise(F.array().cast("array<string>")).alias("off"))


def main_text(source: str | None, region: str = "", off: frozenset[str] = frozenset(), frame: Frame | None = None) -> str:
    """The main text of a page: blocks in their order, a line each.

    Blocks that aren't surroundings, under the host's region; of these the ones in main elements if there are some. A
    page without blocks in the region has all that aren't surroundings. Blocks of the paths ``off`` go first. ``region``
    and ``off`` say nothing of a page that doesn't match ``frame``.
    """
    if not source:
        return ""
    page = Page(source, frame=frame)
    if not page.fits:
        region, off = "", frozenset()
    blocks = [b for b in page.blocks if not b[2] and b[0] not in off]
    within = [b for b in blocks if b[0] == region or b[0].startswith(f"{region}/")] or blocks
    return "\n".join(b[3] for b in [b for b in within if b[1]] or [b for b in blocks if b[1]] or within)


_RULES = "array<struct<path:string,key:string,place:int,again:boolean,must:boolean>>"


def _frame(rules: list[dict] | None) -> Frame | None:
    if rules is None:
        return None
    out: Frame = {}
    for r in rules:
        out.setdefault(r["path"], {})[r["key"]] = (r["place"], r["again"], r["must"])
    return out


def extract(pages: DataFrame, hosts: DataFrame, shipped: int = SHIPPED, salts: int = 16) -> DataFrame:
    """page_id, url, text and n_chars of every row of page_id, url, html and host, by ``regions``' or ``wrappers``' rows.

    Null and empty pages, and pages without text of their own, have an empty text. Pages of hosts without a region are
    judged by their own marks, and so are pages that don't match their host's frame, if ``hosts`` has one. Repeated rows
    each get their row; other columns are not read.
    """
    if "frame" not in hosts.columns:
        hosts = hosts.withColumn("frame", F.lit(None).cast(_RULES))
    hosts = hosts.where((F.size("off") > 0) | (F.col("region") != "")).select("host", "region", "off", "frame")
    long = F.aggregate("off", F.lit(0), lambda a, x: a + F.octet_length(x) + 8) + F.coalesce(F.aggregate("frame", F.lit(0), lambda a, x: a + F.octet_length(x["path"]) + F.octet_length(x["key"]) + 16), F.lit(0))
    size = hosts.agg(F.sum(F.octet_length("region") + long + F.octet_length("host"))).first()[0] or 0
    known = {r["host"]: (r["region"], frozenset(r["off"]), _frame(r["frame"])) for r in hosts.collect()} if size <= shipped else None
    rows = pages.select("page_id", "url", "html", F.coalesce("host", F.lit("")).alias("host"))
    if known is None:  # a hot host's pages are dealt to all salts, so no task has them all
        many = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(many, ["host", "salt"], "left").select("page_id", "url", "html", "host", "region", "off", "frame")
    else:
        rows = rows.select("*", F.lit("").alias("region"), F.lit(None).cast("array<string>").alias("off"), F.lit(None).cast(_RULES).alias("frame"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for source, host, region, off, frame in zip(batch.column("html"), batch.column("host").to_pylist(), batch.column("region").to_pylist(), batch.column("off").to_pylist(), batch.column("frame"), strict=True):
                own = known.get(host, ("", frozenset(), None)) if known is not None else (region or "", frozenset(off or ()), _frame(frame.as_py()))
                out.append(main_text(source.as_py(), *own))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, region, off and frame of every host of ``pages`` (host, html)."""
    slots = written(infer(pages), "slots")
    out = written(regions(slots).join(frames(pages, slots), "host", "left"), "wrappers")
    forget(slots)
    return out


def main_texts(pages: DataFrame) -> DataFrame:
    """``extract`` by wrappers inferred from the same pages. Pages of null urls, or without ://, are one host's."""
    known = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    return extract(known, wrappers(known))
