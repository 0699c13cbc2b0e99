"""Main text of web pages by wrappers that are inferred per host.

A page is a stream of tags and texts. Streams of one host are aligned step by step: where they
differ, what only some have becomes optional, what repeats becomes a group, and texts become
slots. The result is a regular expression without alternatives, the host's wrapper. Pages are
matched against it, and its slots are judged once for the host: by the path and the place where
they stand, on how many pages, in a repeated group or not, and by whether their text ever changes.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
_DROPPED = set(
    "nav footer header aside form script style noscript template button select option textarea input iframe svg math "
    "canvas object head title menu dialog audio video map xmp".split()
)
_MAIN = {"article", "main"}
_LINKS = "@"  # the last part of the path of a block whose text is all in links
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
# Texts, lists, tables and quotes: an article may stand around these, not in them.
_TEXTS = {_LINKS} | set(
    "p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre address "
    "figure figcaption details summary".split()
)
_ALL = "#"  # no path: in the counts of a host's slots, all its pages without a mark
_WORDS = re.compile(r"[a-z]+")
_NOISE = set(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar comment comments "
    "reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login search share sharing social related recommended recommendations pagination "
    "pager widget widgets copyright legal toolbar skip".split()
)
# A name like "top-ad" is noise; "has-sidebar" or "comments-open" only tells the layout.
_BESIDE = set("site top bottom list box bar links buttons slot unit container area x".split())
_TALK = set("comment comments reply replies respond disqus".split())
_NEVER = {"main", "html", "body"}
# Ids of these are anchors, often made of a heading's words.
_ANCHORED = _HEADINGS | set("p dt dd tr th td caption figure figcaption blockquote pre details summary".split())
_BOXES = set("div section ul ol".split())
# A start tag ends an open element of the same kind, or of these.
_ENDS = {t: {"p"} for t in "article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
_ENDS |= {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form"}


@dataclass(frozen=True)
class WrapperParams:
    """A host's rules are sent to all tasks up to ``broadcast`` bytes of rules in all, else they
    meet the pages by a join, a host's pages dealt over ``salts`` tasks. Repeats are looked for
    in groups of up to ``longest`` tokens."""

    broadcast: int = 8 << 20
    salts: int = 32
    longest: int = 8


def _is_told(tag: str, kind: str, value: str, inside: bool) -> bool:
    """Whether a name that is made of noise words tells anything about this element.

    An article is nothing else but a reader's comment, which has such a class or a numbered id.
    Ids are anchors on headings and paragraphs, and inside an article: there they tell comments
    and adverts only."""
    words = set(_WORDS.findall(value))
    if tag == "article":
        return bool(words & _TALK) and (kind == "class" or any(c.isdigit() for c in value))
    if kind != "id":
        return True
    if tag in _ANCHORED:
        return False
    return not inside or (tag in _BOXES and bool(words & (_TALK | {"ad", "ads"})))


def _label(tag: str, rest: str, inside: bool = False) -> str:
    """A tag with what its class, id and role say, if a whole name among these marks it as not the
    article's: "!" before it, and for readers' comments also "!" behind it. ``inside``: an article
    or main element is open."""
    if tag in _DROPPED:
        return "!" + tag
    for attribute, a, b, c in _ATTRIBUTE.findall(rest):
        kind = attribute.lower()
        if kind not in ("class", "id", "role"):
            continue
        value = (a or b or c).lower()
        if value in ("main", "article") and tag not in _TEXTS:
            return tag if tag in _MAIN else tag + ".main"
        for name in value.split() if tag not in _NEVER else ():
            words = set(_WORDS.findall(name))
            if words & _NOISE and words <= _NOISE | _BESIDE and _is_told(tag, kind, name, inside):
                return "!" + tag + ("!" if words & _TALK else "")
    return tag


def blocks_of(page: str) -> Iterator[tuple[str, str]]:
    """(path, text) of every block: its open block tags, and its characters as they stand, with
    references decoded. Inline tags leave no trace, but that the path of a block whose text is
    all in links tells so, unless it is a heading; a line break is a blank."""
    stack: list[tuple[str, str]] = []
    path, held, at = "", [], 0
    link = plain = False

    def place() -> str:
        if plain or (stack and stack[-1][0] in _HEADINGS):
            return path
        return f"{path}/{_LINKS}" if path else _LINKS

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            held.append(html.unescape(page[at : m.start()]))
            plain |= not link and not held[-1].isspace()
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in _INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link = not m[1]
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is None:
                continue
            new = stack[:depth]
        else:
            ends, new = _ENDS.get(tag, ()), stack
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends:
                    new = stack[:i]
                elif stack[i][0] in _SCOPE:
                    break
        if held:
            text = "".join(held)
            if text and not text.isspace():
                yield place(), text
            held = []
        link = plain = False
        stack = list(new)
        if not m[1] and tag not in _VOID:
            if tag in _RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif not m[3].endswith("/") or tag not in ("path", "g"):
                inside = any(x[1] in _MAIN or x[1].endswith(".main") for x in stack)
                stack.append((tag, _label(tag, m[3], inside)))
        path = "/".join(x[1] for x in stack)
    if at < len(page):
        tail = page[at:]
        cut = re.search(r"<[a-zA-Z/!]", tail)  # a tag that never ends is no text
        held.append(html.unescape(tail[: cut.start()] if cut else tail))
        plain |= not link and not held[-1].isspace()
    text = "".join(held)
    if text and not text.isspace():
        yield place(), text


# --- wrappers: lists of nodes. A slot is a path; a group is (body, optional, repeated) ----------

Node = tuple  # (kind, value): ("slot", path), ("opt", [nodes]), ("rep", [nodes])


def _key(node: Node) -> str:
    return node[1] if node[0] == "slot" else _key(node[1][0])


def _body(node: Node) -> list[Node]:
    return [node] if node[0] == "slot" else node[1]


def fold(nodes: list[Node], longest: int) -> list[Node]:
    """Runs of equal stretches become one repeated group, shortest stretches first."""
    for size in range(1, longest + 1):
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            n = 1
            while nodes[i : i + size] == nodes[i + n * size : i + (n + 1) * size] and i + n * size < len(nodes):
                n += 1
            if n > 1 and i + size <= len(nodes):
                body = nodes[i : i + size]
                out.append(body[0] if size == 1 and body[0][0] == "rep" else ("rep", body))
                i += n * size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list[Node], b: list[Node], longest: int) -> list[Node]:
    """One wrapper for whatever either matches. Nodes that agree in their first slot are joined,
    repeated if either is; what only one has becomes optional."""
    if a == b:
        return a
    out: list[Node] = []
    for what, i, j, k, n in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:n]):
                if x == y:
                    out.append(x)
                    continue
                bodies = _body(x), _body(y)
                body = align(*bodies, longest) if len(bodies[0]) + len(bodies[1]) < len(a) + len(b) else bodies[0] + bodies[1]
                kinds = {x[0], y[0]}
                out.append(("rep", body) if "rep" in kinds else ("opt", body) if "opt" in kinds else body[0])
        else:
            out += [x if x[0] != "slot" else ("opt", [x]) for x in a[i:j] + b[k:n]]
    return fold(out, longest)


def slots(nodes: list[Node]) -> Iterator[str]:
    for kind, value in nodes:
        if kind == "slot":
            yield value
        else:
            yield from slots(value)


class Matcher:
    """A wrapper as it is matched against pages: its slots in order (``paths``), and for each the
    repeated groups around it, innermost first, as (first slot, slot behind the last)."""

    def __init__(self, wrapper: list[Node]):
        self.paths: list[str] = []
        self.loops: list[tuple[list[int], ...]] = []
        self._places: dict[str, list[int]] = {}
        self._add(wrapper, ())

    def _add(self, nodes: list[Node], around: tuple[list[int], ...]) -> None:
        for kind, value in nodes:
            if kind == "slot":
                self._places.setdefault(value, []).append(len(self.paths))
                self.paths.append(value)
                self.loops.append(around)
                continue
            group = [len(self.paths), 0]
            self._add(value, (group, *around) if kind == "rep" else around)
            group[1] = len(self.paths)

    def _after(self, path: str, low: int, high: int) -> int | None:
        places = self._places.get(path, ())
        i = bisect_right(places, low)
        return places[i] if i < len(places) and places[i] < high else None

    def match(self, paths: Iterable[str]) -> list[int]:
        """The slot of each block of a page; -1 where the wrapper has none. A repeated group goes on
        as long as it can, the innermost first; then the nearest slot behind it is taken."""
        out: list[int] = []
        at = -1
        for path in paths:
            slot = None
            for start, end in self.loops[at] if at >= 0 else ():
                slot = self._after(path, at, end)
                slot = self._after(path, start - 1, at + 1) if slot is None else slot
                if slot is not None:
                    break
            if slot is None:
                slot = self._after(path, at, len(self.paths))
            out.append(-1 if slot is None else slot)
            at = at if slot is None else slot
        return out


@lru_cache(4096)
def _is_main(path: str) -> bool:
    return any(x in _MAIN or x.endswith(".main") for x in path.split("/"))


@lru_cache(4096)
def _is_noise(path: str) -> bool:
    """Under a menu, header, form or the like; a header inside the article is the article's."""
    inside = False
    for x in path.split("/"):
        inside |= x in _MAIN or x.endswith(".main")
        if x.startswith("!") and not (inside and x == "!header"):
            return True
    return False


@lru_cache(4096)
def _marked(path: str) -> str:
    """The path to the outermost element whose class, id or role marks it; empty without one, or
    under a tag that is never the article's."""
    parts = path.split("/")
    if any(x[1:] in _DROPPED for x in parts if x.startswith("!")):
        return ""
    at = next((i for i, x in enumerate(parts) if x.startswith("!")), None)
    return "" if at is None else "/".join(parts[: at + 1])


def _bare(path: str, holders: Iterable[str]) -> str:
    """The path with the marks of ``holders``, outermost first, taken away."""
    for h in holders:
        if path == h or path.startswith(h + "/"):
            head, _, last = h.rpartition("/")
            path = (head + "/" if head else "") + last.strip("!") + path[len(h) :]
    return path


def holders_of(chars: dict[str, int]) -> list[str]:
    """Marked elements that hold most of the text (characters by path, in all), and so the article:
    their marks tell a layout. Readers' comments count only where nothing else is left."""
    holders: list[str] = []
    open_ = {p: n for p, n in chars.items() if not _is_noise(p) or _marked(p)}
    while True:
        mass: dict[str, int] = {}
        for p, n in open_.items():
            mass[_marked(p)] = mass.get(_marked(p), 0) + n
        best = max((h for h in mass if h), key=lambda h: (mass[h], h), default="")
        if not best or 2 * mass[best] <= sum(mass.values()) or (best.endswith("!") and mass.get("")):
            return holders
        holders.append(best)
        moved: dict[str, int] = {}
        for p, n in open_.items():
            p = _bare(p, [best])
            moved[p] = moved.get(p, 0) + n
        open_ = moved


def _by_path(path: str) -> str:
    return "noise" if _is_noise(path) else "main" if _is_main(path) else "text"


def judge(wrapper: list[Node], facts: dict[str, tuple[int, int, bool]]) -> dict:
    """What each of the wrapper's slots holds: ``noise``; on pages that mark an article, that
    (``main``); on the others text that is the ``same`` on most pages, ``links`` in a repeated
    group, or ``text``. Also the elements that are not noise whatever their class says
    (``holders``). facts: different pages without a mark, characters and whether the text ever
    changes, by number of the slot; under ``_ALL`` the number of these pages.
    """
    matcher = Matcher(wrapper)
    chars: dict[str, int] = {}
    for i, path in enumerate(matcher.paths):
        if str(i) in facts:
            chars[path] = chars.get(path, 0) + facts[str(i)][1]
    holders = holders_of(chars)
    pages = facts.get(_ALL, (0, 0, True))[0]
    verdicts = []
    for i, path in enumerate(matcher.paths):
        verdict = _by_path(_bare(path, holders))
        n, _, changes = facts.get(str(i), (0, 0, True))
        if verdict == "text" and n > 1 and 2 * n > pages and not changes:
            verdict = "same"
        elif verdict == "text" and path.endswith(_LINKS) and matcher.loops[i]:
            verdict = "links"
        verdicts.append(verdict)
    return {"wrapper": wrapper, "slots": verdicts, "holders": holders}


def _home(blocks: list[tuple[str, str]]) -> str:
    """The innermost container that holds most of the blocks' text; lists, tables and quotes are
    no containers."""
    mass: dict[str, int] = {}
    for path, text in blocks:
        parts = path.split("/") if path else []
        end = next((i for i, x in enumerate(parts) if x in _TEXTS), len(parts))
        for n in range(end + 1):
            home = "/".join(parts[:n])
            mass[home] = mass.get(home, 0) + len(text)
    total = sum(len(t) for _, t in blocks)
    return max((h for h, n in mass.items() if 2 * n > total), key=lambda h: h.count("/") + bool(h), default="")


def without_mark(clean: list[tuple[str, str, str]]) -> list[str]:
    """The article of a page that marks none, from its clean blocks (path, text, verdict): all text
    but what the host repeats, and lists of links, outside of the container with most of the
    page's own text.

    The rest is not narrowed to that container: an article may stand in several. Where repeated
    text is at least half of the page, the host's pages are copies of each other, and it is kept.
    """
    own = [(p, t) for p, t, v in clean if v == "text"]
    if 2 * sum(len(t) for _, t, v in clean if v != "same") <= sum(len(t) for _, t, _ in clean):
        own += [(p, t) for p, t, v in clean if v == "same"]
        clean = [(p, t, "text" if v == "same" else v) for p, t, v in clean]
    home = _home(own)
    return [t for p, t, v in clean if v == "text" or not home or p == home or p.startswith(home + "/")]


def extract(page: str, rules: dict, matcher: Matcher) -> str:
    """The page's blocks are read by the slots that they match; a block without one by its path. A
    page without clean text looks for its article under its own marked elements."""
    blocks = list(blocks_of(page))
    holders, verdicts = rules["holders"], rules["slots"]
    found = []
    for (path, text), slot in zip(blocks, matcher.match(p for p, _ in blocks)):
        bare = _bare(path, holders)
        found.append((bare, " ".join(text.split()), verdicts[slot] if slot >= 0 else _by_path(bare)))
    kept = [t for _, t, v in found if v == "main"]
    if not kept:
        if all(v == "noise" for _, _, v in found):
            chars: dict[str, int] = {}
            for path, text in blocks:
                chars[path] = chars.get(path, 0) + len(text)
            holders = holders_of(chars)
            bare = [(_bare(p, holders), " ".join(t.split())) for p, t in blocks]
            found = [(p, t, "noise" if _is_noise(p) else "text") for p, t in bare]
        kept = without_mark([x for x in found if x[2] != "noise"])
    return "\n\n".join(t for t in kept if t)


# --- the job --------------------------------------------------------------------------------

_SEEN = "kind string, host string, what string, chars bigint, least bigint, most bigint"


class _Seen:
    """Rows (kind, host, what) of one task, each once, with summed characters and the least and
    the greatest digest of their text."""

    def __init__(self):
        self._rows: dict[tuple[str, str, str], list[int]] = {}

    def add(self, kind: str, host: str, what: str, chars: int = 0, digest: int = 0) -> None:
        x = self._rows.setdefault((kind, host, what), [0, digest, digest])
        x[0] += chars
        x[1], x[2] = min(x[1], digest), max(x[2], digest)

    def batch(self) -> pa.RecordBatch:
        keys = list(zip(*self._rows)) or [(), (), ()]
        numbers = list(zip(*self._rows.values())) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [*[pa.array(k, pa.string()) for k in keys], *[pa.array(n, pa.int64()) for n in numbers]],
            ["kind", "host", "what", "chars", "least", "most"],
        )


def _unmarked(blocks: list[tuple[str, str]]) -> bool:
    """Whether the page has text that may be an article's, and marks none."""
    some = False
    for path, _ in blocks:
        if not _is_noise(path):
            if _is_main(path):
                return False
            some = True
        elif not some:
            some = bool(_marked(path))
    return some


def _streaming(params: WrapperParams) -> Callable:
    """Per batch: the folded streams of each host, each once, and hosts with pages without a mark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            seen = _Seen()
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                found = list(blocks_of(page))
                seen.add("stream", host, json.dumps(fold([("slot", p) for p, _ in found], params.longest)))
                if _unmarked(found):
                    seen.add("open", host, "")
            yield seen.batch()

    return run


def _observing(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: of pages without a mark the facts of the slots that they match, and each page's
    digest with its slots, each once."""
    known: dict[str, Matcher] = {}
    for batch in small_batches(batches, "html"):
        seen = _Seen()
        for host, page, text in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "wrapper"))):
            found = list(blocks_of(page))
            if not _unmarked(found):
                continue
            matcher = _remembered(known, text, lambda: Matcher(_nodes(text)))
            matched = [(i, p, t) for i, (p, t) in zip(matcher.match(p for p, _ in found), found) if i >= 0]
            open_ = [x for x in matched if not _is_noise(x[1]) or _marked(x[1])]
            clean = [x for x in open_ if not _is_noise(x[1])]
            texts: dict[int, list[str]] = {}
            for slot, _, t in open_:
                texts.setdefault(slot, []).append(t)
            for slot, parts in texts.items():
                joined = "\n".join(parts)
                seen.add("slot", host, str(slot), len(joined), xxhash.xxh64_intdigest(joined) >> 1)
            digest = xxhash.xxh128_hexdigest(json.dumps(clean or open_))
            seen.add("page", host, "\n".join([digest, *map(str, sorted({x[0] for x in clean or open_}))]))
        yield seen.batch()


def _remembered(known: dict, key: str, make: Callable):
    if key not in known:
        if len(known) > 1000:
            known.clear()
        known[key] = make()
    return known[key]


def _nodes(text: str) -> list[Node]:
    def build(x):
        return (x[0], x[1] if x[0] == "slot" else [build(y) for y in x[1]])

    return [build(x) for x in json.loads(text)]


def _aligning(params: WrapperParams) -> Callable:
    """Over rows sorted by (host, salt): streams are aligned one after the other, so a task
    holds one wrapper however many streams a host has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, wrapper, out = None, [], []
        for batch in batches:
            for host, salt, stream in zip(*(batch.column(c).to_pylist() for c in ("host", "salt", "what"))):
                if (host, salt) != now:
                    if now is not None:
                        out.append((now[0], json.dumps(wrapper)))
                    now, wrapper = (host, salt), _nodes(stream)
                else:
                    wrapper = align(wrapper, _nodes(stream), params.longest)
        if now is not None:
            out.append((now[0], json.dumps(wrapper)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["host", "what"]
        )

    return run


def _judging(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, rules = batch.column("host").to_pylist(), []
        for text, facts in zip(batch.column("wrapper").to_pylist(), batch.column("facts").to_pylist()):
            known = {f["what"]: (f["pages"], f["chars"], f["changes"]) for f in facts or ()}
            rules.append(json.dumps(judge(_nodes(text), known)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), batch.column("wrapper"), pa.array(rules, pa.string())],
            ["host", "wrapper", "rules"],
        )


def infer_wrappers(pages: DataFrame, params: WrapperParams = WrapperParams()) -> DataFrame:
    """(host, wrapper, rules) of ``pages(host, html)``. All pages are looked at; equal streams
    are counted together before the shuffle, and a host's different streams are aligned in 16
    parts whose wrappers are then aligned with each other. The pages of hosts that leave articles
    unmarked are then matched against the wrapper for the facts by which its slots are judged."""

    def once(rows: DataFrame) -> DataFrame:
        chars, least, most = F.sum("chars").alias("chars"), F.min("least").alias("least"), F.max("most").alias("most")
        return write_and_read(rows.groupBy("kind", "host", "what").agg(chars, least, most), "page-facts")

    streams = once(pages.mapInArrow(_streaming(params), _SEEN))
    parts = streams.where("kind = 'stream'").select("host", F.pmod(F.xxhash64("what"), F.lit(16)).alias("salt"), "what")

    def aligned(streams: DataFrame) -> DataFrame:
        dealt = streams.repartition("host", "salt").sortWithinPartitions("host", "salt", "what")
        return dealt.mapInArrow(_aligning(params), "host string, what string")

    wrappers = aligned(aligned(parts).withColumn("salt", F.lit(0))).withColumnRenamed("what", "wrapper")
    wrappers = write_and_read(wrappers, "aligned")
    asked = wrappers.join(streams.where("kind = 'open'").select("host"), "host", "left_semi")
    facts = once(_with_host(pages, asked, ["wrapper"], params).mapInArrow(_observing, _SEEN))
    paths = F.slice(F.split("what", "\n"), 2, 1 << 30)
    counted = (
        facts.where("kind = 'page'")  # copies are one row
        .select("host", F.explode(F.concat(F.array(F.lit(_ALL)), paths)).alias("what"))
        .groupBy("host", "what")
        .agg(F.count(F.lit(1)).alias("pages"))
    )
    texts = facts.where("kind = 'slot'").select("host", "what", "chars", (F.col("least") != F.col("most")).alias("changes"))
    per_host = (
        texts.join(counted, ["host", "what"], "full")
        .na.fill({"pages": 0, "chars": 0, "changes": True})
        .groupBy("host")
        .agg(F.collect_list(F.struct("what", "pages", "chars", "changes")).alias("facts"))  # a row for each slot
    )
    joined = wrappers.join(per_host, "host", "left").select("host", "wrapper", "facts")
    return write_and_read(joined.mapInArrow(_judging, "host string, wrapper string, rules string"), "wrappers")


def _extracting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[dict, Matcher]] = {}

    def built(text: str) -> tuple[dict, Matcher]:
        rules = json.loads(text)
        return rules, Matcher(rules["wrapper"])

    for batch in small_batches(batches, "html"):
        out = []
        for page, text in zip(batch.column("html").to_pylist(), batch.column("rules").to_pylist()):
            out.append(extract(page, *_remembered(known, text, lambda: built(text))))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"]
        )


def _with_host(pages: DataFrame, table: DataFrame, columns: list[str], params: WrapperParams) -> DataFrame:
    """``pages`` with ``columns`` of their host's row in ``table``, a written table."""
    size = table.agg(F.sum(sum((F.octet_length(c) for c in ("host", *columns)), F.lit(64)))).first()[0] or 0
    if size <= params.broadcast:
        return pages.join(F.broadcast(table.select("host", *columns)), "host")
    salts = F.explode(F.sequence(F.lit(0), F.lit(params.salts - 1))).alias("salt")
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(params.salts)).cast("int"))
    return salted.join(table.select("host", *columns, salts), ["host", "salt"]).drop("salt")


def extract_pages(pages: DataFrame, params: WrapperParams = WrapperParams()) -> DataFrame:
    """(page_id, url, text): the main text of every page, its blocks in page order, two line
    breaks between them.

    Null html is an empty page; pages without article text have empty text. Pages with null or
    unreadable urls share one host. Repeated rows stay; copies count as one page. Long pages are
    read whole, one at a time. Empty tables give no rows. Other columns are not looked at.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    source = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")
    )
    rules = infer_wrappers(source.select("host", "html"), params)
    joined = _with_host(source, rules, ["rules"], params)
    return joined.select("page_id", "url", "html", "rules").mapInArrow(
        _extracting, "page_id bigint, url string, text string"
    )
