"""Token ids in bit-packed files.

A file holds ids of ``bits`` bits each in blocks of ``block`` ids, then an index:

    magic, blocks, index (block offsets, document ids, null marks, document ends), index size

Every block but the last has the same size, and the offsets are written all the same, so a reader
can fetch any stretch of ids by the blocks it touches. Ids are packed little-endian: id i of
a block starts at bit i * bits.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, write_and_read
from .common import small_batches, texts

MAGIC = b"IDPACK01"
_LANES = 64  # so many ids fill a whole number of 64-bit words, whatever their width


@dataclass(frozen=True)
class TokenFileParams:
    """``end_id`` closes every document; ``block`` ids (a multiple of 64) to a block."""

    end_id: int = 2
    block: int = 1 << 16


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids, lane by lane of 64, as 64-bit words."""
    groups = -(-len(ids) // _LANES)
    padded = np.zeros(groups * _LANES, np.uint64)
    padded[: len(ids)] = ids
    lanes = padded.reshape(groups, _LANES)
    words = np.zeros((groups, bits), "<u8")
    for lane in range(_LANES):
        word, shift = divmod(lane * bits, 64)
        words[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            words[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return words.tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), _LANES), np.uint64)
    for lane in range(_LANES):
        word, shift = divmod(lane * bits, 64)
        out[:, lane] = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, lane] |= words[:, word + 1] << np.uint64(64 - shift)
    return (out.ravel()[:n] & np.uint64((1 << bits) - 1)).astype(np.uint32)


class TokenFileWriter:
    """Takes documents one by one; holds one block."""

    def __init__(self, sink, bits: int, params: TokenFileParams) -> None:
        self.sink, self.bits, self.block = sink, bits, params.block
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets, self.ids, self.ends = [len(MAGIC)], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, tokens: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.n_ids += len(tokens)
        self.ends.append(self.n_ids)
        self.held.append(tokens)
        self.n_held += len(tokens)
        if self.n_held >= self.block:
            self._flush(self.n_held // self.block * self.block)

    def _flush(self, n: int) -> None:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for start in range(0, n, self.block):
            data = pack(every[start : min(start + self.block, n)], self.bits)
            self.sink.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.held, self.n_held = [every[n:]], len(every) - n

    def close(self) -> None:
        self._flush(self.n_held)
        head = np.array([self.bits, self.block, self.n_ids, len(self.ids), len(self.offsets)], "<i8")
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        nulls = np.array([i is None for i in self.ids], np.uint8)
        index = b"".join(
            x.tobytes() for x in (head, np.array(self.offsets, "<i8"), ids, np.array(self.ends, "<i8"), nulls)
        )
        self.sink.write(index + np.array([len(index)], "<i8").tobytes())
        self.sink.close()


class TokenFile:
    """A file opened for reading: the index is read, blocks only when asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 8)
        length = int(np.frombuffer(source.read(8), "<i8")[0])
        source.seek(size - 8 - length)
        index = source.read(length)
        self.bits, self.block, self.n_ids, n_docs, n_offsets = np.frombuffer(index, "<i8", 5).tolist()
        numbers = np.frombuffer(index, "<i8", 5 + n_offsets + 2 * n_docs)[5:]
        self.offsets, self.ids, self.ends = np.split(numbers, [n_offsets, n_offsets + n_docs])
        self.nulls = np.frombuffer(index[len(index) - n_docs :], np.uint8)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end``, from no more blocks than they lie in."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        return unpack(data, n, self.bits)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of each document, some blocks at a time."""
        begin, have, base = 0, np.zeros(0, np.uint32), 0
        for doc_id, null, end in zip(self.ids.tolist(), self.nulls.tolist(), self.ends.tolist()):
            if end > base + len(have):
                upto = min(max(-(-end // self.block), begin // self.block + 16) * self.block, self.n_ids)
                have, base = self.read(begin, upto), begin
            yield None if null else doc_id, begin, have[begin - base : end - base]
            begin = end


class _Words(dict):
    """Ids by stretch of text without blanks, as bytes of 32-bit numbers."""

    MOST = 500_000

    def __init__(self, tokenizer) -> None:
        super().__init__()
        self.tokenizer, self.new, self.ids, self.chars = tokenizer, [], [], 0

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        self.chars += len(word)
        return number

    def learn(self) -> None:
        if self.new:
            found = self.tokenizer.encode_batch_fast(self.new, add_special_tokens=False)
            self.ids += [np.array(x.ids, np.uint32).tobytes() for x in found]
            self.new = []

    def forget_some(self) -> None:
        if len(self) > self.MOST or self.chars > 32 << 20:
            self.clear()
            self.ids, self.chars = [], 0


_words: dict[int, _Words] = {}


def _known(model: str) -> _Words:
    key = hash(model)
    if key not in _words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
        from tokenizers import Tokenizer

        _words[key] = _Words(Tokenizer.from_str(model))
    return _words[key]


def encode_texts(texts: list[str], model: str, end: bytes) -> Iterator[np.ndarray]:
    """Ids of each text. The model drops white space and never joins across it, so a text's ids
    are those of its stretches between blanks, tabs and line breaks."""
    known = _known(model)
    numbers = []
    for text in texts:
        flat = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        numbers.append(list(map(known.__getitem__, flat.split(" "))))
    known.learn()
    for words in numbers:
        yield np.frombuffer(b"".join(map(known.ids.__getitem__, words)) + end, np.uint32)
    known.forget_some()


_MANIFEST = "path string, first_null boolean, first_id bigint, first_hash bigint, n_docs bigint, n_ids bigint"


def _writing(model, vocabulary: int, folder: str, params: TokenFileParams) -> Callable:
    end = np.array([params.end_id], np.uint32).tobytes()
    bits = bits_for(max(vocabulary, params.end_id + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first, path = None, None, ""
        for batch in small_batches(batches, "text", 2 << 20):
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("_th").to_pylist()
            if writer is None:
                # Every attempt of a task has a file of its own; only what the manifest lists counts.
                path = f"{folder}/{uuid.uuid4().hex}.ids"
                store, place = fs.FileSystem.from_uri(path)
                writer = TokenFileWriter(store.open_output_stream(place), bits, params)
                first = (ids[0], hashes[0])
            for doc_id, tokens in zip(ids, encode_texts(batch.column("text").to_pylist(), model.value, end)):
                writer.add(doc_id, tokens)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path]),
                    pa.array([first[0] is None]),
                    pa.array([first[0]], pa.int64()),
                    pa.array([first[1]], pa.int64()),
                    pa.array([len(writer.ids)], pa.int64()),
                    pa.array([writer.n_ids], pa.int64()),
                ],
                ["path", "first_null", "first_id", "first_hash", "n_docs", "n_ids"],
            )

    return run


def write_token_files(
    documents: DataFrame, tokenizer_path: str, folder: str | None = None, params: TokenFileParams = TokenFileParams()
) -> DataFrame:
    """Write all documents by ascending doc_id and return the manifest, one row a file.

    Documents are dealt to tasks by ranges of (doc_id, hash of the text), so a repeated id does
    not fill one task, and each task writes one file block by block. Null ids come first; null
    text is empty text, which leaves the end id alone. Repeated rows are documents of their
    own. An empty table gives no files. Other columns are not looked at. ``folder`` (a path or
    URI that all executors share) is a new one in the session's shared folder unless given.
    """
    spark = documents.sparkSession
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        text = file.read()
    vocabulary = Tokenizer.from_str(text).get_vocab_size()
    folder = folder or new_path(spark, "token-files")
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    docs = texts(documents).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    dealt = docs.repartitionByRange("doc_id", "_th").sortWithinPartitions("doc_id", "_th")
    model = spark.sparkContext.broadcast(text)
    return write_and_read(dealt.mapInArrow(_writing(model, vocabulary, folder, params), _MANIFEST), "manifest")


def _reading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    for files in batches:
        for path, before in zip(files.column("path").to_pylist(), files.column("before").to_pylist()):
            store, place = fs.FileSystem.from_uri(path)
            rows = []
            with store.open_input_file(place) as source:
                for doc_id, start, ids in TokenFile(source).documents():
                    rows.append((doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)


def read_token_digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files.

    One row a file passes through the driver, which adds up how many ids come before each.
    """
    rows, before = [], 0
    for r in manifest.orderBy(F.col("first_null").desc(), "first_id", "first_hash").collect():
        rows.append((r["path"], before))
        before += r["n_ids"]
    files = spark.createDataFrame(rows, "path string, before bigint").repartition(max(1, len(rows)))
    return files.mapInArrow(_reading, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
