"""SentencePiece BPE ids by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

SPACE = "▁"  # stands for a blank
_NORMAL, _BYTE = 1, 6  # kinds of pieces in the model file
_NONE = np.iinfo(np.int64).max
_OPEN = -1  # no wall
_LONG = 64  # characters of a word that is cut into stretches

_SLOT_BITS = 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _slots_of(keys: np.ndarray) -> list[np.ndarray]:
    """The two places in the pair table where a key may be."""
    shift = np.uint64(64 - _SLOT_BITS)
    return [((keys.view(np.uint64) * f) >> shift).astype(np.int64) for f in _FACTORS]


def _pair_table(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and pieces in a table in which every key is at one of its two places: a new key takes
    its first place and sends whoever was there to the other one of theirs."""
    keys = np.array(list(pairs), np.int64)
    places = np.stack(_slots_of(keys), 1).tolist()
    at: dict[int, int] = {}
    for n in range(len(keys)):
        slot = places[n][0]
        for _ in range(1000):
            n, at[slot] = at.get(slot, -1), n
            if n < 0:
                break
            slot = places[n][0] if places[n][1] == slot else places[n][1]
        else:
            raise ValueError("the pair table is too small for this model")
    table = np.full(1 << _SLOT_BITS, -2, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)
    for slot, n in at.items():
        table[0][slot] = keys[n]
        table[1][slot] = pairs[int(keys[n])]
    return table


class PieceModel:
    """Vocabulary and merge ranks of a BPE model with identity normalisation.

    Symbols are numbered: the pieces by id, then characters outside the vocabulary. A pair of
    symbols merges if together they are a normal piece; the better the piece's score, the lower
    its rank. ``across`` is, for two characters side by side, the least rank of any piece that
    holds them so: no merge of a lower rank goes across that place.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        if (
            proto.trainer_spec.model_type != 2
            or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not norm.add_dummy_prefix
            or not norm.escape_whitespaces
            or proto.trainer_spec.treat_whitespace_as_suffix
            or not proto.trainer_spec.byte_fallback
            or any(p.type not in (1, 2, 3, 6) for p in proto.pieces)
            or any(SPACE in p.piece.lstrip(SPACE) for p in proto.pieces if p.type == _NORMAL)
        ):
            raise ValueError("only byte-fallback BPE models with blanks in front of words are read")
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.size = len(proto.pieces)
        scores = [-p.score for p in proto.pieces]
        order = {s: r for r, s in enumerate(sorted(set(scores)))}
        self.rank = np.array([order[s] for s in scores], np.int64)
        pairs = {}
        across: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
                left, right = self.ids.get(piece[cut - 1]), self.ids.get(piece[cut])
                if left is not None and right is not None:
                    key, rank = left * self.size + right, int(self.rank[i])
                    across[key] = min(rank, across.get(key, rank))
        self.across = np.array(sorted(across.items()), np.int64).reshape(-1, 2)
        self.blanks = self._blanks()
        self.slots = _pair_table(pairs)

    def _blanks(self) -> int:
        """Blanks that a long run of them is merged to at a time, from the left: the most that any
        piece starts with, if all pieces of blanks have one rank and the leftmost merges make such
        a piece before they touch what is behind it. Else 0."""
        most = max(len(p) - len(p.lstrip(SPACE)) for p in self.ids)
        sizes = {len(p): i for p, i in self.ids.items() if len(p) > 1 and not p.strip(SPACE)}
        if len({int(self.rank[i]) for i in sizes.values()}) != 1:
            return 0
        run = [1] * (2 * most)
        while run[0] < most:
            n = next((n for n in range(len(run) - 1) if run[n] + run[n + 1] in sizes), None)
            if n is None:
                return 0
            run[n : n + 2] = [run[n] + run[n + 1]]
        return most if run[1:] == [1] * most else 0

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes and its rank; no piece has the last rank of all."""
        key = left * self.size + right
        key[(left >= self.size) | (right >= self.size)] = -1
        piece = np.zeros(len(key), np.int64)
        hit = np.zeros(len(key), bool)
        for slot in _slots_of(key):
            here = self.slots[0][slot] == key
            piece[here] = self.slots[1][slot[here]]
            hit |= here
        return piece, np.where(hit, self.rank[piece], _NONE)

    def _walls(self, sym: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Per character what parts it from the one before: nothing in short words, in long ones
        the least rank that goes across, and ``_NONE`` where no piece does or a word starts."""
        out = np.full(len(sym), _OPEN)
        long = np.flatnonzero(np.repeat(lengths > _LONG, lengths))
        if len(long) and len(self.across):
            before = sym[np.maximum(long - 1, 0)]
            key = before * self.size + sym[long]
            key[(before >= self.size) | (sym[long] >= self.size)] = -1
            place = np.minimum(np.searchsorted(self.across[:, 0], key), len(self.across) - 1)
            out[long] = np.where(self.across[place, 0] == key, self.across[place, 1], _NONE)
        elif len(long):
            out[long] = _NONE
        begin = np.cumsum(lengths) - lengths
        mark = self.ids.get(SPACE, -1)
        for n in np.flatnonzero(lengths > _LONG).tolist() if self.blanks else ():
            of_word = sym[begin[n] : begin[n] + lengths[n]] != mark
            marks = int(np.argmax(of_word)) if of_word.any() else len(of_word)
            # what follows the blanks can take some of the last ones only
            out[begin[n] : begin[n] + max(0, marks - 2 * self.blanks) : self.blanks] = _NONE
        out[begin[lengths > 0]] = _NONE
        return out

    def _merged_now(self, best: np.ndarray, made: np.ndarray, rank, sym: np.ndarray, wall: np.ndarray, of) -> np.ndarray:
        """Which of the chosen pairs merge in one round: in each stretch, from the left, up to and
        with the first whose piece makes a pair of a rank not above its own with a neighbour. The
        neighbour on the left has already been merged, the one on the right has not."""
        before = sym[best - 1]
        touching = np.flatnonzero(np.diff(best) == 2) + 1
        before[touching] = made[touching - 1]
        left = self._pair(before, made)[1]
        left[wall[best] != _OPEN] = _NONE
        after = np.minimum(best + 2, len(sym) - 1)
        right = self._pair(made, sym[after])[1]
        right[(best + 2 >= len(sym)) | (wall[after] != _OPEN)] = _NONE
        stops = np.minimum(left, right) <= rank
        earlier = np.cumsum(stops) - stops
        first = np.r_[True, of[1:] != of[:-1]]
        return earlier == earlier[np.flatnonzero(first)[np.cumsum(first) - 1]]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as the bytes of 32-bit numbers, all words at once.

        Round by round: the least pair rank of every stretch; its pairs are merged from the left,
        as many as leave that rank the least; merged symbols are compacted; stretches without a
        pair are done. A short word is one stretch. A long one starts as many, between walls: a
        stretch goes on by itself while its least rank is below those of its walls, and a wall
        falls when both sides have come up to its rank. What stretches do before is independent,
        so the order of merges that the model asks for is kept, in rounds that hardly depend on
        the length of a word.
        """
        chars = "".join(words)
        extra: dict[str, int] = {}
        table = {c: self.ids.get(c, -1) for c in set(chars)}
        for c, i in table.items():
            if i < 0:
                table[c] = self.size + extra.setdefault(c, len(extra))
        sym = np.fromiter(map(table.__getitem__, chars), np.int64, len(chars))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        wall = self._walls(sym, lengths)
        at = np.arange(len(sym))
        done_sym, done_at = [sym[:0]], [at[:0]]
        while len(sym):
            starts = np.flatnonzero(wall != _OPEN)
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(sym)]))
            # the last symbol of a stretch starts no pair
            inside = wall[1:] == _OPEN
            piece, rank = self._pair(sym[:-1], sym[1:])
            rank[~inside] = _NONE
            least = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            walls = np.r_[wall[starts], _NONE]
            lower = np.minimum(walls[:-1], walls[1:])
            idle = (least == _NONE) & (lower == _NONE)
            if idle.any():
                out = idle[of]
                done_sym.append(sym[out])
                done_at.append(at[out])
                keep = ~out
                sym, wall, at = sym[keep], wall[keep], at[keep]
                continue
            ready = least < lower
            # a wall is the lower one on both sides, and neither has anything below it
            falls = (lower[1:] == lower[:-1]) & (walls[1:-1] == lower[1:]) & (lower[1:] != _NONE) & ~ready[1:] & ~ready[:-1]
            best = np.flatnonzero(inside & (rank == least[of[:-1]]) & ready[of[:-1]])
            wall[starts[1:][falls]] = _OPEN
            if not len(best):
                continue
            # of pairs in a row that overlap, every second one
            run = np.r_[True, np.diff(best) != 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(best)), 0))
            best = best[(np.arange(len(best)) - first) % 2 == 0]
            best = best[self._merged_now(best, piece[best], rank[best], sym, wall, of[best])]
            sym[best] = piece[best]
            keep = np.ones(len(sym), bool)
            keep[best + 1] = False
            sym, wall, at = sym[keep], wall[keep], at[keep]
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        order = np.argsort(at)
        flat, word = sym[order], np.repeat(np.arange(len(words)), lengths)[at[order]]
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        raw = flat.astype(np.int32).tobytes()
        out = [raw[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]
        if extra:
            spare = {self.size + n: [self.bytes[b] for b in c.encode()] for c, n in extra.items()}
            for n in np.unique(word[flat >= self.size]).tolist():
                ids = [x for i in np.frombuffer(out[n], np.int32).tolist() for x in spare.get(i, (i,))]
                out[n] = np.array(ids, np.int32).tobytes()
        return out


_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_MOST_WORDS, _MOST_CHARS = 500_000, 32 << 20


class _Known(dict):
    """A model, and the words met lately: each word has a number, under which ``ids`` has its
    ids as 32-bit numbers and ``text`` has them as decimals with commas. Both are plain bytes
    and text, which cost little memory and no garbage collection."""

    def __init__(self, proto: bytes) -> None:
        super().__init__()
        self.model = PieceModel(proto)
        self.decimals = [str(i) for i in range(self.model.size)]
        self.chars = 0
        self.new: list[str] = []
        self.ids: list[bytes] = []
        self.text: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        self.chars += len(word)
        return number

    def learn(self) -> None:
        """Encodes the words that were new."""
        if self.new:
            found = self.model.encode_words([SPACE + w for w in self.new])
            self.ids += found
            self.text += [
                ",".join([self.decimals[i] for i in np.frombuffer(x, np.int32).tolist()]) for x in found
            ]
            self.new = []

    def forget(self) -> None:
        self.clear()
        self.ids, self.text, self.chars = [], [], 0


_models: dict[str, _Known] = {}


def _known(proto: bytes) -> _Known:
    key = hashlib.sha256(proto).hexdigest()
    if key not in _models:
        _models[key] = _Known(proto)
    return _models[key]


def split_words(text: str) -> list[str]:
    """Words, each without the mark in front of it. Blanks become marks, one more goes in front
    of the text, and it is cut before every mark that follows something else: no piece goes
    across. Where blanks stand alone, that is a plain split."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]


def encode_texts(texts: list[str], proto: bytes) -> Iterator[tuple[np.ndarray, str]]:
    """Ids of each text, and the same as decimals joined by commas."""
    known = _known(proto)
    numbers = [list(map(known.__getitem__, split_words(t))) for t in texts]
    known.learn()
    for words in numbers:
        ids = np.frombuffer(b"".join(map(known.ids.__getitem__, words)), np.int32)
        yield ids, ",".join(map(known.text.__getitem__, words))
    if len(known) > _MOST_WORDS or known.chars > _MOST_CHARS:
        known.forget()


def _encoding(proto) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = proto.value
        decode = _known(model).model.decoder.decode
        for batch in small_batches(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts, shas, back = [], [], []
            for ids, joined in encode_texts(texts, model):
                counts.append(len(ids))
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                back.append(hashlib.sha256((decode(ids.tolist()) if len(ids) else "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(shas), pa.array(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def _tokens(proto) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [ids.tolist() for ids, _ in encode_texts(texts, proto.value)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
            )

    return run


def _read(path: str) -> bytes:
    with open(path, "rb") as file:  # a model file of the program, read where the program starts
        return file.read()


def encode_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids): every text as piece ids, no begin or end ids.

    Null and empty texts have no ids. Repeated rows and null ids stay as they are. Characters
    outside the vocabulary become byte pieces. A text of any length is one row; a word of any
    length, blank or not, takes memory in proportion and about as much time. Empty tables give no rows. Other columns are not looked at.
    """
    proto = documents.sparkSession.sparkContext.broadcast(_read(model_path))
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return docs.mapInArrow(_tokens(proto), "doc_id bigint, ids array<int>")


def round_trip_digests(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids that ``encode_documents`` gives
    and of the text that they decode to. The same cases are defined in the same way."""
    proto = documents.sparkSession.sparkContext.broadcast(_read(model_path))
    docs = documents.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return docs.mapInArrow(
        _encoding(proto), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
