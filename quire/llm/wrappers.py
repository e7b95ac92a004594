"""HTML main text by wrappers: union-free regular expressions inferred from the pages of a host."""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, stored, tidy

#: Comments; elements whose content is no markup, to their end; other tags, quotes in attributes closed or not; the rest.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b(?:[^>"']|"[^"]*"|'[^']*')*+(?<!/)>.*?(?:</\1\s*>|\Z)|<(iframe|textarea)\b(?:[^>"']|"[^"]*"|'[^']*')*+(?<!/)>.*?</\2\s*>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S | re.I,
)
#: Elements that show no text of the article, to the place where they or what holds them ends.
_HIDDEN = frozenset("svg select button noscript template script style iframe textarea".split())
_MARK = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements that a new element of the same family ends.
_ENDS = {t: frozenset({t}) for t in ("li", "tr", "option")} | {t: frozenset({"td", "th"}) for t in ("td", "th")} | {t: frozenset({"dt", "dd"}) for t in ("dt", "dd")}
_SCOPES = frozenset("ul ol dl table article main section nav aside header footer form body html div".split())
#: Elements, and words of a class, id or role, of regions that aren't the article.
_OUT_TAGS = frozenset("head nav footer aside form menu dialog".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice alert popup modal newsletter subscribe signup comment comments reply replies disqus share social related recommended widget toolbar pagination pager complementary contentinfo search skip legal masthead".split()
)
_HEAD_WORDS = frozenset({"header"})
_MAIN_TAGS = frozenset({"article", "main"})
#: A slot varies or stays the same only over different pages, two at least: one that stays, outside an article, is taken
#: for part of the frame.
_SEEN = 2


def host_of(url):
    """The lower-cased host of a URL column, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _sign(name: str, attributes: str) -> str:
    """An element in a token stream: its name, and its class, id and role without digits."""
    marks = sorted({w for m in _MARK.finditer(attributes) for w in re.sub(r"\d+", "", m[2] or m[3] or m[4] or "").replace("/", " ").split()}) if attributes else []
    return ".".join([name, *marks])


def _outside(sign: str) -> int:
    """2 for an element that is surely no part of an article: by its tag, or a class, id or role that is one such word; 1 if
    such a word is a part of a longer name (`share-price`), which the text it holds may outweigh; else 0."""
    name, *marks = sign.split(".")
    if name in _OUT_TAGS:
        return 2
    if name in ("html", "body", "article", "main"):
        return 0
    found = 0
    for mark in marks:
        if mark.lower() in _OUT_WORDS:
            return 2
        if any(w.lower() in _OUT_WORDS for w in _PARTS.findall(mark)):
            found = 1
    return found


def _page_head(sign: str) -> bool:
    name, *marks = sign.split(".")
    return name == "header" or name not in ("html", "body", "article", "main") and any(w.lower() in _HEAD_WORDS for m in marks for w in _PARTS.findall(m))


def _is_main(sign: str) -> bool:
    name, *marks = sign.split(".")
    return name in _MAIN_TAGS or name not in ("html", "body") and "main" in marks


def tokens(page: str) -> tuple[list[tuple[int, str | None]], list[tuple[int, str]]]:
    """(place, text) of each text of a page in order, and (place, None) where a block or line ends; and the places' parents
    and signs.

    A place is the open elements, without inline ones (unless they mark a region), numbered as they are met: 0 is none
    open. Elements that are left open end where HTML ends them; one that closes itself holds nothing. Comments, scripts, styles,
    drawings, buttons and the like give nothing; math and what objects hold is text. Character references are decoded.
    """
    out: list[tuple[int, str | None]] = []
    places: list[tuple[int, str]] = [(-1, "")]
    number: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int]] = []  # (name, place up to here)
    opened: Counter[str] = Counter()
    signs: dict[tuple[str, str], str] = {}
    path, at, met = 0, 0, False

    def hidden() -> bool:
        return met and any(opened[x] > 0 for x in _HIDDEN)

    def text(part: str) -> None:
        if part and not hidden():
            out.append((path, entities.unescape(part) if "&" in part else part))

    def close_to(name: str) -> None:
        while True:
            last = stack.pop()[0]
            opened[last] -= 1
            if last == name:
                return

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m[4] or m[7]
        if not name:
            if m[1] or m[2]:
                out.append((path, None))
            continue
        name, attributes, closing = name.lower(), (m[5] or m[8] or ""), bool(m[3] or m[6])
        inline = name in _INLINE
        if not closing and (name in _HIDDEN or hidden()):
            met = True
            if not attributes.endswith("/") and name not in _VOID:
                stack.append((name, path))
                opened[name] += 1
            if name in _HIDDEN:
                out.append((path, None))
            continue
        if closing:
            if opened[name] > 0:
                close_to(name)
                path = stack[-1][1] if stack else 0
        elif name not in _VOID:
            if name == "body":
                while stack and stack[-1][0] != "html":
                    opened[stack.pop()[0]] -= 1
            elif not inline and opened["p"] > 0:
                close_to("p")
            elif name in _ENDS and any(opened[x] > 0 for x in _ENDS[name]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _ENDS[name]:
                        for x, _ in stack[i:]:
                            opened[x] -= 1
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPES:
                        break
            path = stack[-1][1] if stack else 0
            sign = signs.get((name, attributes)) or signs.setdefault((name, attributes), _sign(name, attributes))
            if not inline or _outside(sign):
                key = (path, sign)
                if key not in number:
                    number[key] = len(places)
                    places.append(key)
                path = number[key]
            if not attributes.endswith("/"):
                stack.append((name, path))
                opened[name] += 1
        if not inline:
            out.append((path, None))
    text(page[at:])
    return out, places


def path_names(places: list[tuple[int, str]]) -> list[str]:
    """A short name for each place: a digest of its parent's and its sign."""
    out = [""]
    for parent, sign in places[1:]:
        out.append(hashlib.blake2b(f"{out[parent]}/{sign}".encode("utf-8", "surrogatepass"), digest_size=9).hexdigest())
    return out


def _digest(words: str) -> str:
    return hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Wrapper:
    """A union-free regular expression over the token streams of a host.

    A node is an element with its children in groups: a group of one child matches it once, or often where it repeats; a
    group of several is a repeated group of optional children. Children that some page lacks are optional. A text is a
    slot, with the number of pages that have it, their characters in it, and, as long as all pages agree, a digest of its
    words and the least digests of the pages that have it, _SEEN at most: copies of a page count once.
    """

    __slots__ = ("pages", "groups", "children", "repeats", "slot", "mass", "fixed", "seen")

    def __init__(self, pages: int = 0):
        self.pages, self.groups, self.children = pages, [], {}
        self.repeats, self.slot, self.mass, self.fixed, self.seen = set(), 0, 0, None, []

    @classmethod
    def of_page(cls, page: tuple[list[tuple[int, str | None]], list[tuple[int, str]]]) -> Wrapper:
        """The expression that one page's stream is aligned as: a child met again after others pulls all between into one
        repeated group."""
        stream, places = page
        nodes, depth = [cls(1)], [0]
        for parent, sign in places[1:]:
            node = nodes[parent].children[sign] = cls(1)
            nodes.append(node)
            depth.append(depth[parent] + 1)
        texts: dict[int, list[str]] = {}
        last = 0
        for place, text in stream:
            if place != last and place:
                # Elements from the one both are in down to this one begin anew.
                a, b, begun = place, last, []
                while depth[a] > depth[b]:
                    begun.append(a)
                    a = places[a][0]
                while depth[b] > depth[a]:
                    b = places[b][0]
                while a != b:
                    begun.append(a)
                    a, b = places[a][0], places[b][0]
                for x in reversed(begun):
                    nodes[places[x][0]]._meet(places[x][1])
            last = place
            if text and not text.isspace():
                texts.setdefault(place, []).append(text)
        words = {place: " ".join(" ".join(parts).split()) for place, parts in texts.items()}
        names = path_names(places)
        page_name = _digest("\n".join(x for both in sorted((names[place], own) for place, own in words.items()) for x in both))
        for place, own in words.items():
            node = nodes[place]
            node.slot, node.mass, node.fixed, node.seen = 1, len(own), _digest(own), [page_name]
        return nodes[0]

    def _meet(self, sign: str) -> None:
        i = next((i for i, g in enumerate(self.groups) if sign in g), None)
        if i is None:
            self.groups.append([sign])
            return
        self.repeats.add(sign)
        if i < len(self.groups) - 1:
            self.groups[i:] = [[s for g in self.groups[i:] for s in g]]

    def merge(self, other: Wrapper) -> Wrapper:
        """Aligns another expression with this one, node by node. A group of the other that isn't here is inserted after the
        last match as optional; one that comes earlier here than the last match closes all between into a repeated group."""
        pairs = [(self, other)]
        while pairs:
            here, there = pairs.pop()
            here._align(there.groups)
            for sign, child in there.children.items():
                if sign in here.children:
                    pairs.append((here.children[sign], child))
                else:
                    here.children[sign] = child
            if there.slot:
                here.fixed = there.fixed if not here.slot else here.fixed if here.fixed == there.fixed else None
                here.seen = sorted({*here.seen, *there.seen})[:_SEEN] if here.fixed else []
            here.slot += there.slot
            here.mass += there.mass
            here.pages += there.pages
            here.repeats |= there.repeats
        return self

    def _align(self, groups: list[list[str]]) -> None:
        at = -1
        for group in groups:
            found = [i for i, g in enumerate(self.groups) if set(g) & set(group)]
            fresh = [s for s in group if s not in self.children]
            if not found:
                at += 1
                self.groups.insert(at, list(fresh))
                continue
            low, high = min(found), max(*found, at) if min(found) < at else max(found)
            self.groups[low : high + 1] = [[s for g in self.groups[low : high + 1] for s in g] + fresh]
            at = low

    def nodes(self) -> list[tuple[int, str, Wrapper]]:
        """(parent's number, sign, node) of all nodes, parents first; the root is number 0."""
        out = [(-1, "", self)]
        for i, (_, _, node) in enumerate(out):
            out.extend((i, sign, child) for sign, child in node.children.items())
        return out

    def __str__(self) -> str:
        bodies: list[str] = []
        every = self.nodes()
        numbers = {id(node): i for i, (_, _, node) in enumerate(every)}
        bodies = [""] * len(every)

        def one(node: Wrapper, sign: str, alone: bool) -> str:
            child = node.children[sign]
            body = f"<{sign}>{'#text' if child.slot else ''}{bodies[numbers[id(child)]]}</{sign.split('.')[0]}>"
            return f"({body})+" if alone and sign in node.repeats else f"({body})?" if not alone or child.pages < node.pages else body

        for i in range(len(every) - 1, -1, -1):
            node = every[i][2]
            bodies[i] = "".join(one(node, g[0], True) if len(g) == 1 else "(" + "".join(one(node, s, False) for s in g) + ")+" for g in node.groups)
        return bodies[0]

    def dump(self) -> list:
        return [[parent, sign, n.pages, n.groups, sorted(n.repeats), n.slot, n.mass, n.fixed, n.seen] for parent, sign, n in self.nodes()]

    @classmethod
    def load(cls, data: list) -> Wrapper:
        made: list[Wrapper] = []
        for parent, sign, pages, groups, repeats, slot, mass, fixed, seen in data:
            node = cls(pages)
            node.groups, node.repeats, node.slot, node.mass, node.fixed, node.seen = groups, set(repeats), slot, mass, fixed, seen
            if parent >= 0:
                made[parent].children[sign] = node
            made.append(node)
        return made[0]

    def roles(self) -> dict[str, int]:
        """For each slot, by its path's name: 2 in the article, 1 on a page without one, 0 outside, and -1 for slots without
        an article that _SEEN different pages or more fill with the same words: part of the frame, unless a page has
        nothing else.

        Elements with an article's tag or name hold it. Tags and names of regions (_outside) are out. Where such a word
        is only part of a name, the slots decide: if the element holds half or more of the host's text that varies over
        pages and isn't surely out, it is no region. On one or two pages all text counts as varying.
        """
        every = self.nodes()
        main, out, weak = [False] * len(every), [False] * len(every), [False] * len(every)
        for i, (parent, sign, _) in enumerate(every[1:], 1):
            main[i] = main[parent] or _is_main(sign)
            outside = _outside(sign)
            out[i] = out[parent] or outside == 2 or (_page_head(sign) and not main[parent] and not _is_main(sign))
            weak[i] = outside == 1
        own = [0 if out[i] or (n.fixed and len(n.seen) >= _SEEN) else n.mass for i, (_, _, n) in enumerate(every)]
        under = list(own)
        for i in range(len(every) - 1, 0, -1):
            under[every[i][0]] += under[i]
        names, roles = path_names([(parent, sign) for parent, sign, _ in every]), {}
        for i, (parent, _, node) in enumerate(every):
            if i:
                out[i] = out[i] or out[parent] or (weak[i] and 2 * under[i] < max(under[0], 1))
            if node.slot:
                agreed = bool(node.fixed) and len(node.seen) >= _SEEN
                roles[names[i]] = 0 if out[i] else 2 if main[i] else -1 if agreed else 1
        return roles


def main_text(page: tuple[list[tuple[int, str | None]], list[tuple[int, str]]], roles: dict[str, int]) -> str:
    """The texts of the article's slots; where the page has none with text, of those of pages without an article; where it
    has none of them either, of those in which pages agree."""
    stream, places = page
    role_of = [roles.get(name) for name in path_names(places)]
    for role in (2, 1, -1):
        parts = [" " if text is None else text if role_of[place] == role else "" for place, text in stream]
        if found := " ".join("".join(parts).split()):
            return found
    return ""


def infer(pages: DataFrame) -> DataFrame:
    """host and wrapper (JSON) for every host of pages(host, html).

    Each task folds its pages of a host into one wrapper, whose size follows the host's distinct paths and not its
    number of pages; then wrappers are merged by (host, a salt of 32) and by host. So no task gets all pages of a host.
    """
    kinds = "host string, salt int, wrapper string"

    def fold(batches):
        from pyspark import TaskContext

        salt, held = TaskContext.get().partitionId() % 32, {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                made = Wrapper.of_page(tokens(page.as_py() or ""))
                held[host] = held[host].merge(made) if host in held else made
            if len(held) > 20_000:
                yield batch(held, salt)
                held = {}
        if held:
            yield batch(held, salt)

    def batch(held, salt):
        return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(w.dump(), ensure_ascii=False) for w in held.values()])], names=["host", "salt", "wrapper"])

    def merge(table: pa.Table) -> pa.Table:
        whole = None
        for part in table["wrapper"]:
            part = Wrapper.load(json.loads(part.as_py()))
            whole = part if whole is None else whole.merge(part)
        return pa.table({"host": [table["host"][0].as_py()], "salt": pa.array([table["salt"][0].as_py()], pa.int32()), "wrapper": [json.dumps(whole.dump(), ensure_ascii=False)]})

    parts = pages.select("host", "html").mapInArrow(tidy(fold), kinds)
    salted = parts.groupBy("host", "salt").applyInArrow(merge, kinds)
    return salted.groupBy("host").applyInArrow(merge, kinds).select("host", "wrapper")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages(page_id, url, html).

    White space within a block becomes one blank, blocks are joined by one blank, inline elements part nothing. Null or
    empty html gives the empty text; a null url belongs to the empty host. Repeated rows each get their result; an empty
    table gives an empty one; other columns are ignored, whatever their names. Pages of any length and markup of any depth
    are read whole. The slots' roles are broadcast if all hosts' take
    BROADCAST_BYTES at most, and joined by host otherwise (where adaptive execution splits a hot host).
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def decide(batches):
        for b in batches:
            roles = [json.dumps(Wrapper.load(json.loads(w)).roles(), ensure_ascii=False, sort_keys=True) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(roles, pa.string())], names=["host", "roles"])

    roles = stored(infer(rows).mapInArrow(decide, "host string, roles string"), "roles")
    size = roles.agg(F.sum(F.length("roles") + F.length("host") + 40)).first()[0] or 0
    known: dict[str, dict] = {}

    def run(batches):
        for b in batches:
            out = []
            for page, role in zip(b.column(2), b.column(3).to_pylist(), strict=True):
                if role not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[role] = json.loads(role) if role else {}
                out.append(main_text(tokens(page.as_py() or ""), known[role]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(F.broadcast(roles) if size <= BROADCAST_BYTES else roles, "host", "left").select("page_id", "url", "html", "roles")
    return joined.mapInArrow(tidy(run), f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
