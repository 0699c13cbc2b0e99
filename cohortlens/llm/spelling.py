"""Spelling variants of words, found with bidirectional FM-indexes.

Two words are near if one inserted, deleted or replaced code point leads from one to the other.
The error lies in one half of the word, so the other half occurs exactly: a search matches that
half from the middle outwards up to the word's edge, then turns round and extends across the
other half with one error. Both directions work on suffix-rank intervals of the vocabulary's
text, in which every word stands between two delimiters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_and_read
from .common import ascii_lower


@dataclass(frozen=True)
class SpellingParams:
    """Words have at least ``length`` code points and occur at least ``occurrences`` times; a form
    occurs at least ``ratio`` times as often as its variant. In one run of letters out of
    ``damaged`` (0: none), chosen by the CRC of document id and run, a code point is left out. An index
    holds about ``block`` words, and ``ask`` words are searched at a time."""

    length: int = 7
    occurrences: int = 2
    ratio: int = 10
    damaged: int = 31
    block: int = 20_000
    ask: int = 20_000


# --- the index --------------------------------------------------------------------------------

END, EDGE = 0, 1  # symbols of the text's end and of the delimiter; letters follow


def suffix_order(codes: np.ndarray, n_symbols: int) -> np.ndarray:
    """Starts of the suffixes in sorted order, by prefix doubling. The last code is the only END."""
    n, bits = len(codes), n_symbols.bit_length()
    k = min(62 // bits, n)
    key = np.zeros(n, np.int64)
    for i in range(k):
        key <<= bits
        key[: n - i] |= codes[i:]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
        if rank[-1] == n - 1:
            return order
        own = np.empty(n, np.int64)
        own[order] = rank
        key = own * (n + 1)
        key[: n - k] += own[k:] + 1
        k *= 2


class Wavelet:
    """A sequence of symbols by bits, from the highest: counts in any range, in a step per bit."""

    def __init__(self, codes: np.ndarray, n_symbols: int) -> None:
        self.levels = []
        for shift in reversed(range(n_symbols.bit_length())):
            one = ((codes >> shift) & 1).astype(bool)
            zeros = np.zeros(len(codes) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((shift, zeros, zeros[-1]))
            codes = np.concatenate([codes[~one], codes[one]])

    def narrow(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the range's occurrences of a symbol end up, and how many smaller ones it has."""
        less = np.zeros(len(lo), np.int64)
        for shift, zeros, cut in self.levels:
            one = (symbol >> shift) & 1 == 1
            lo0, hi0 = zeros[lo], zeros[hi]
            less += np.where(one, hi0 - lo0, 0)
            lo, hi = np.where(one, cut + lo - lo0, lo0), np.where(one, cut + hi - hi0, hi0)
        return lo, hi, less

    def symbols(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """(range, symbol, lo, hi) for every different symbol in every range."""
        of, symbol = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for _, zeros, cut in self.levels:
            lo0, hi0 = zeros[lo], zeros[hi]
            of = np.concatenate([of, of])
            symbol = np.concatenate([2 * symbol, 2 * symbol + 1])
            lo, hi = np.concatenate([lo0, cut + lo - lo0]), np.concatenate([hi0, cut + hi - hi0])
            some = np.flatnonzero(hi > lo)
            of, symbol, lo, hi = of[some], symbol[some], lo[some], hi[some]
        return of, symbol, lo, hi


class FmIndex:
    """Suffix-rank intervals of a text; ``step`` puts a symbol in front of what an interval holds."""

    def __init__(self, codes: np.ndarray, n_symbols: int) -> None:
        codes = np.r_[codes, END]
        self.order = suffix_order(codes, n_symbols)
        self.wavelet = Wavelet(codes[self.order - 1], n_symbols)
        counts = np.bincount(codes, minlength=n_symbols)
        none, every = np.zeros(n_symbols, np.int64), np.arange(n_symbols)
        self.base = np.cumsum(counts) - counts - self.wavelet.narrow(none, none, every)[0]

    def step(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, ...]:
        lo, hi, less = self.wavelet.narrow(lo, hi, symbol)
        return lo + self.base[symbol], hi + self.base[symbol], less

    def steps(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """(interval, symbol, lo, hi) for every symbol that can be put in front."""
        of, symbol, lo, hi = self.wavelet.symbols(lo, hi)
        return of, symbol, lo + self.base[symbol], hi + self.base[symbol]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Vocabulary:
    """Different words, searchable in both directions. ``alphabet`` holds the code points of the words and
    of all that will be asked."""

    def __init__(self, words: list[str], alphabet: np.ndarray) -> None:
        self.letters = alphabet
        codes = np.r_[EDGE, self._codes("\n".join(words)), EDGE]
        n_symbols = len(alphabet) + 2
        self.size = len(codes)
        self.owner = np.cumsum(codes == EDGE) - 2  # of the delimiter behind a word
        self.ahead = FmIndex(codes, n_symbols)  # puts symbols to the left of a match
        self.back = FmIndex(codes[::-1], n_symbols)  # and to the right of it

    def _codes(self, text: str) -> np.ndarray:
        points = _points(text)
        codes = np.searchsorted(self.letters, points) + 2
        return np.where(points == ord("\n"), EDGE, codes).astype(np.int64)

    def search(self, asked: list[str], exact: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asked, word) for the words that agree with the first ``exact`` code points of what is
        asked and come from the rest by one error: one point more, one less (``longer`` 1, -1) or
        one replaced (0). Each pair comes once: equal letters in a row count as one place."""
        size = np.array([len(a) for a in asked], np.int64)
        begin = np.cumsum(size + 1) - size - 1
        text = np.r_[self._codes("\n".join(asked)), EDGE]  # behind every word there is a delimiter
        # from the middle to the left edge, with the interval of either direction
        lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), self.size + 1)
        other = np.zeros(len(asked), np.int64)
        for t in range(int(exact.max(initial=0)) + 1):
            on = np.flatnonzero((exact >= t) & (hi > lo))
            symbol = np.where(t < exact[on], text[begin[on] + np.maximum(exact[on] - 1 - t, 0)], EDGE)
            lo[on], hi[on], less = self.ahead.step(lo[on], hi[on], symbol)
            other[on] += less
        # and from the middle to the right edge: first without an error, then behind it
        of = np.flatnonzero(hi > lo)
        clean = (of, begin[of] + exact[of], other[of], other[of] + hi[of] - lo[of])
        spent = tuple(np.zeros(0, np.int64) for _ in range(4))
        found = []
        while len(clean[0]) or len(spent[0]):
            symbol = text[spent[1]]
            lo, hi, _ = self.back.step(spent[2], spent[3], symbol)
            done = np.flatnonzero((hi > lo) & (symbol == EDGE))
            found.append((spent[0][done], lo[done]))
            on = np.flatnonzero((hi > lo) & (symbol != EDGE))
            spent = (spent[0][on], spent[1][on] + 1, lo[on], hi[on])
            more = [spent, *self._errors(clean, text, begin, exact, longer)]
            spent = tuple(np.concatenate(x) for x in zip(*more))
            of, at, lo, hi = clean
            lo, hi, _ = self.back.step(lo, hi, text[at])
            on = np.flatnonzero((hi > lo) & (text[at] != EDGE))
            clean = (of[on], at[on] + 1, lo[on], hi[on])
        of, row = (np.concatenate(x) for x in zip(*found)) if found else (clean[0], clean[0])
        return of, self.owner[self.size - 1 - self.back.order[row]]

    def _errors(self, clean: tuple, text: np.ndarray, begin: np.ndarray, exact: np.ndarray, longer: np.ndarray):
        of, at, lo, hi = clean
        kind, left = longer[of], text[at] != EDGE
        first = at == begin[of] + exact[of]
        skip = np.flatnonzero((kind == -1) & left & (first | (text[at] != text[at - 1])))
        yield of[skip], at[skip] + 1, lo[skip], hi[skip]
        put = np.flatnonzero((kind == 1) | (kind == 0) & left)
        # many have the same interval: its symbols are found once
        spans, same = np.unique(lo[put] * (self.size + 2) + hi[put], return_inverse=True)
        span, symbol, to, until = self.back.steps(spans // (self.size + 2), spans % (self.size + 2))
        order = np.argsort(span, kind="stable")
        n = np.bincount(span, minlength=len(spans))
        start = np.cumsum(n) - n
        each = np.repeat(np.arange(len(put)), n[same])
        pick = order[np.arange(len(each)) - np.repeat(np.cumsum(n[same]) - n[same], n[same]) + start[same][each]]
        who = put[each]
        fits = np.flatnonzero((symbol[pick] > EDGE) & (symbol[pick] != text[at[who]]))
        who, pick = who[fits], pick[fits]
        yield of[who], at[who] + (kind[who] == 0), to[pick], until[pick]


# --- the job ------------------------------------------------------------------------------------

_ROUTED = ["side", "size", "key", "chunk", "indexed", "asked", "spelled", "n"]
_NEAR = "word string, n_near bigint, near_n bigint, near string"


def _nearest(
    vocabulary: Vocabulary, words: list[str], n: np.ndarray, place: np.ndarray, asks: list[tuple[str, int]], side: int
) -> list[tuple]:
    """Per asked word: how many near words there are here, and the most frequent of them."""
    asked = [a for a, _ in asks]
    size = np.array([len(a) for a in asked], np.int64)
    half = size // 2
    of, found = vocabulary.search(asked, half if side == 0 else size - half, np.array([x for _, x in asks]) - size)
    if side == 1:  # what the other side finds as well: words that share their other half too
        tails = [asked[a][int(size[a] - half[a]) :] for a in of.tolist()]
        alone = [not words[w].endswith(t) for w, t in zip(found.tolist(), tails)]
        of, found = of[alone], found[alone]
    order = np.lexsort((place[found], -n[found], of))
    of, found = of[order], found[order]
    firsts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    counts = np.diff(np.r_[firsts, len(of)])
    turn = slice(None, None, -1 if side else 1)
    return [
        (asked[a][turn], c, int(n[w]), words[w][turn])
        for a, c, w in zip(of[firsts].tolist(), counts.tolist(), found[firsts].tolist())
    ]


class _Block:
    """Some groups of routed words, with one index for all of them."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.n: list[int] = []
        self.asks: list[tuple[str, int]] = []

    def answer(self, side: int) -> pa.RecordBatch:
        turn = slice(None, None, -1 if side else 1)
        rows = []
        if self.words and self.asks:
            letters = np.unique(_points("".join(self.words) + "".join({a for a, _ in self.asks})))
            place = np.empty(len(self.words), np.int64)
            place[sorted(range(len(self.words)), key=lambda i: self.words[i][turn])] = np.arange(len(self.words))
            vocabulary = Vocabulary(self.words, letters)
            rows = _nearest(vocabulary, self.words, np.array(self.n, np.int64), place, self.asks, side)
        self.asks = []
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * len(types)
        names = [field.split()[0] for field in _NEAR.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def _matching(params: SpellingParams) -> Callable:
    """Over rows sorted by group, indexed words first. What a task holds are about ``block`` words and
    ``ask`` questions: a group with more questions answers them in turns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _ROUTED)))
        block, at_side = _Block(), 0
        for (side, size, _, chunk), group in groupby(rows, key=lambda r: r[:4]):
            full = len(block.words) >= params.block or len(block.asks) >= params.ask
            # two chunks of one group are asked the same, so they can't share an index
            if full or chunk or side != at_side:
                yield block.answer(at_side)
                block = _Block()
            at_side, before = side, len(block.words)
            for *_, indexed, asked, spelled, n in group:
                if indexed:
                    block.words.append(spelled)
                    block.n.append(n)
                if asked and len(block.words) > before:
                    block.asks.append((spelled, size))
                    if not indexed and len(block.asks) >= params.ask:
                        yield block.answer(side)
        yield block.answer(at_side)

    return run


def vocabulary_of(documents: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n): the words of all texts with their occurrences."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    # a run of fewer letters than a word needs can't become one
    letters = F.lit(rf"[A-Za-zÀ-ÿ]{{{params.length},}}")
    who = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    runs = documents.select(who.alias("who"), F.explode(F.regexp_extract_all(text, letters, F.lit(0))).alias("run"))
    word = F.col("run")
    if params.damaged:
        h = F.crc32(F.concat("who", "run").cast("binary"))
        at = (F.pmod(h, F.char_length("run")) + 1).cast("int")
        word = F.when(h % params.damaged == 0, F.overlay("run", F.lit(""), at, F.lit(1))).otherwise(word)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= params.length)
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= params.occurrences)


def _routes(words: DataFrame, params: SpellingParams) -> DataFrame:
    """Every word goes to where the words of its own length are indexed that begin (side 0) or
    end (side 1, spelled backwards) like it, and is asked there and at the lengths next to it. The
    beginning that decides is never longer than the half that must agree."""
    ways = []
    for side, spelled in enumerate((F.col("word"), F.reverse("word"))):
        for longer in (-1, 0, 1):
            size = F.char_length("word") + longer
            key = spelled.substr(F.lit(1), ((size - 1) / 2).cast("int"))
            ways.append(
                F.struct(
                    F.lit(side).alias("side"), size.alias("size"), key.alias("key"),
                    F.lit(longer == 0).alias("own"), spelled.alias("spelled"), F.col("n").alias("n"),
                )
            )
    routed = words.select(F.inline(F.array(*ways))).where(F.col("size") >= params.length)
    group = ["side", "size", "key"]
    sizes = routed.where("own").groupBy(*group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > params.block)
    large = write_and_read(sizes.select(*group, F.ceil(F.col("m") / params.block).cast("int").alias("chunks")), "large")
    # Words of a large group are dealt to chunks, each an index of its own that all are asked.
    one = F.array(F.struct(F.lit(0).alias("chunk"), F.col("own").alias("indexed"), F.lit(True).alias("asked")))
    dealt = F.struct(
        F.pmod(F.xxhash64("spelled"), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(True).alias("indexed"),
        F.lit(False).alias("asked"),
    )
    every = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda c: F.struct(c.alias("chunk"), F.lit(False).alias("indexed"), F.lit(True).alias("asked")),
    )
    many = F.when(F.col("own"), F.concat(F.array(dealt), every)).otherwise(every)
    places = F.when(F.col("chunks").isNull(), one).otherwise(many)
    return routed.join(large, group, "left").select(*group, "spelled", "n", F.inline(places)).select(*_ROUTED)


def near_words(words: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, n_near, near_n, near) for those of ``words(word, n)`` that have near words: their
    number, and the most frequent one; of equals the first in code-point order."""
    group = ["side", "size", "key", "chunk"]
    dealt = _routes(words, params).repartition(*group).sortWithinPartitions(*group, F.desc("indexed"))
    found = dealt.mapInArrow(_matching(params), _NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return summed.select("word", "n_near", (-F.col("best.m")).alias("near_n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the last of the forms from a word on. Every round
    doubles the steps taken; forms grow by their ratio, so there are few."""
    reached = forms.withColumnRenamed("form", "root")
    while True:
        reached = write_and_read(reached, "roots")
        beyond = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        on = reached.join(beyond, "root")
        if on.isEmpty():
            return reached
        reached = reached.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(documents: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``documents``: its most frequent near
    word if that occurs ``ratio`` times as often (else null), and the last word of the chain of
    forms, the word itself if there is none.

    Words are maximal runs of letters; A-Z are lower-cased, nothing else. Null text has no words;
    a null id takes part as empty text. Ties go to the smaller word in code-point order. Repeated
    rows count as often as they occur, and lose the same letters. Long texts and long words are
    taken whole. An empty table gives no rows. Other columns are not looked at.
    """
    words = write_and_read(vocabulary_of(documents, params), "words")
    near = near_words(words, params)
    often = F.col("near_n") >= F.lit(params.ratio) * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word",
        F.when(often, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(often, F.col("near_n")).alias("form_n"),
    )
    judged = write_and_read(judged, "judged")
    roots = _roots(judged.where(F.col("form").isNotNull()).select("word", "form"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
