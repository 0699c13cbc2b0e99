"""Piece ids against the library whose model it is."""

import hashlib
import random

import pytest

from cohortlens.llm.pieces import encode_documents, encode_texts, round_trip_digests
from cohortlens.llm.queries import tokenizer

spm = pytest.importorskip("sentencepiece")
PATH = tokenizer("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", "a  b   c ", "\x00", "▁x ▁▁y", "<s></s><0x41>", "日本語😀 é", "abab" * 900, "the" * 700, " " * 99]


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


def texts(library):
    rng = random.Random(8)
    vocabulary = [library.id_to_piece(i) for i in range(300, 32000, 7)]
    letters = list("abcdehinrst \n\té日") + ["  ", "tion", "membres"]
    some = ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(3000)]
    return TEXTS + some + ["".join(rng.choices(vocabulary, k=12)) for _ in range(3000)]


def test_ids_equal_the_library(library):
    some = texts(library)
    with open(PATH, "rb") as file:
        proto = file.read()
    got = [ids.tolist() for ids, _ in encode_texts(some, proto)]
    assert got == library.encode(some)
    assert [j for _, j in encode_texts(some, proto)] == [",".join(map(str, x)) for x in got]


def test_long_words_equal_the_library(library):
    """Words without blanks, of one unit again and again, and long runs of blanks."""
    rng = random.Random(9)
    letters = [library.id_to_piece(i).replace("▁", "") for i in range(300, 32000, 5)]
    some = ["".join(rng.choices("abcdehinrstouél日", k=rng.randrange(50, 300))) for _ in range(500)]
    some += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz=-_.", k=rng.randrange(1, 7))) * 60 for _ in range(500)]
    some += ["".join(rng.choices(letters, k=rng.randrange(5, 100))) for _ in range(500)]
    some += [" " * n + w for n in range(30, 140) for w in ("", "t", "the", "-", "日", "the  a", "(")]
    some += ["x " * n + " " * 200 + "e" * n for n in range(50, 90)]
    with open(PATH, "rb") as file:
        proto = file.read()
    assert [ids.tolist() for ids, _ in encode_texts(some, proto)] == library.encode(some)


def test_a_word_of_a_megabyte(library):
    """Takes seconds; in time that grows with the square of its length it would take hours."""
    rng = random.Random(10)
    most = 1 << 20
    letters = [library.id_to_piece(i).replace("▁", "") for i in range(300, 32000, 5)]
    with open(PATH, "rb") as file:
        proto = file.read()
    for text in ("".join(rng.choices(letters, k=most // 5)), " " * most, "=" * most, "日本" * (most // 2)):
        assert next(encode_texts([text], proto))[0].tolist() == library.encode(text)


def test_digests_and_awkward_rows(spark, library):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    got = sorted(map(str, map(tuple, round_trip_digests(docs, PATH).collect())))
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append(str((i, len(ids), *sha)))
    assert got == sorted(want)
    ids = {r["doc_id"]: r["ids"] for r in encode_documents(docs, PATH).collect()}
    assert ids[8] == library.encode(TEXTS[8])
    assert round_trip_digests(docs.limit(0), PATH).count() == 0
