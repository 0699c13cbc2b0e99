"""Jaccard groups, spelling variants and resampling against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from cohortlens.llm.jaccard import JaccardParams, _parities, jaccard_groups, prefix_size
from cohortlens.llm.resample import PayloadScanner, ResampleParams, compose, feature_crcs, resample
from cohortlens.llm.spelling import SpellingParams, Vocabulary, near_words, spelling_variants, vocabulary_of

# columns that the operators use for themselves
DOCS = "doc_id bigint, text string, key string, n int, word string, `group` int, rank int, _th string"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(UPPER, UPPER.lower())


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "w", 2, 3, "h") for i, t in rows], DOCS)


# --- Jaccard ------------------------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def near_copies(seed):
    """Clusters of near copies, chains of them, texts of common passages, and awkward rows."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rows = [(None, None), (None, "no id at all here"), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "é É")]
    for cluster in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 30, 90, 200]))] + common[: rng.randrange(30)]
        for _ in range(rng.choice([2, 5, 25])):
            rows.append((10 * len(rows) + cluster, " ".join(edited(base, rng, rng.randrange(4)))))
    chain = [f"x{i}" for i in range(200)]
    for step in range(12):  # neighbours are similar, the ends are not
        rows.append((5000 - step, "\t".join(chain)))
        chain = edited(chain, rng, 2)
    rows += [rows[8], rows[8], (None, rows[9][1]), (9999, rows[10][1].upper().lower())]
    rng.shuffle(rows)
    return rows


def jaccard_brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= 85 * (len(sets[a]) + len(sets[b]) - same):
                group[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least[find(a)], math.inf if i is None else i)
    ids = [least[find(a)] for a in range(len(rows))]
    return sorted(
        (str(i), len(s), str(None if c == math.inf else c)) for (i, _), s, c in zip(rows, sets, ids)
    )


@pytest.mark.parametrize(
    ("seed", "params"),
    [(0, JaccardParams()), (1, JaccardParams(counters=1, cells=(2, 4), salted=3)), (2, JaccardParams(cells=(), parts=1, broadcast=0))],
)
def test_jaccard_groups(spark, seed, params):
    rows = near_copies(seed)
    got = jaccard_groups(docs_of(spark, rows), params).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == jaccard_brute(rows)


def test_parities_of_two_sets_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 127, 128, 129, 1000, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for m in (0, 1, n // 20, n // 8):
            b = np.unique(np.concatenate([a[m:], rng.integers(0, 1 << 63, m).astype(np.uint64)]))
            x, y = sorted((_parities(a), _parities(b)), key=len)
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            flips = sum(int(w).bit_count() for w in (x ^ y).view(np.uint64))
            assert flips <= len(np.setxor1d(a, b)) and (m or not flips)


def test_jaccard_at_the_threshold(spark):
    """20 shingles, of which 17 are shared and 3 are the one text's own: 85 of 100."""
    words = [f"a{i}" for i in range(23)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(words[:19]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs_of(spark, rows[:2])).collect()}
    assert got == {1: 1, 2: 1}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs_of(spark, [rows[0], rows[2]])).collect()}
    assert got == {1: 1, 3: 3}
    assert [prefix_size(n, 85) for n in (0, 1, 6, 7, 20)] == [0, 1, 1, 2, 4]


def test_jaccard_without_rows_and_with_long_texts(spark):
    assert jaccard_groups(docs_of(spark, [])).collect() == []
    long = " ".join(f"t{i % 70001}" for i in range(150_000))
    got = jaccard_groups(docs_of(spark, [(2, long), (1, long + " end"), (3, "x" * 1_000_000)])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}


# --- spelling -----------------------------------------------------------------------------------


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def some_words(seed, n=200):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(7, 12))) for _ in range(n)})


def test_search_finds_each_near_word_once():
    words = some_words(3)
    index = Vocabulary(words, np.unique(np.array([ord(c) for c in "abéz"], np.uint32)))
    asked = words + ["zzzzzzz", words[0] + "z", "z" + words[1]]
    for longer in (-1, 0, 1):
        half = np.array([len(a) // 2 for a in asked])
        of, found = index.search(asked, half, np.full(len(asked), longer))
        got = sorted((asked[a], words[w]) for a, w in zip(of.tolist(), found.tolist()))
        assert got == sorted(
            (a, w)
            for a in asked
            for w in words
            if len(w) == len(a) + longer and are_near(a, w) and w[: len(a) // 2] == a[: len(a) // 2]
        )


@pytest.mark.parametrize("params", [SpellingParams(), SpellingParams(block=7, ask=5)])
def test_near_words(spark, params):
    words = {w: random.Random(w).randrange(2, 9) for w in some_words(4)}
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in near_words(table, params).collect()}
    want = {}
    for w in words:
        near = [v for v in words if are_near(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want[w] = (len(near), words[best], best)
    assert got == want


def spelling_brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if are_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def test_spelling_variants(spark):
    rng = random.Random(6)
    rows = [(None, None), (None, "Wonderful wonderful"), (1, ""), (2, "aĀbcdefgh ÀÉtéééés x" * 3)]
    chain = ["Abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]  # each form has a form
    for i in range(3, 60):
        text = " ".join(rng.choice(["Telephone", "telephone", "élégance", "WONDERFUL"]) for _ in range(30))
        rows.append((i, text + ", " + "-".join(chain[0:1] * 40 + chain[1:2] * 3)))
    rows += [(100, " ".join(["telephne"] * 2 + ["telepphone"] * 3 + ["tElephone"] * 2)), (101, f"{chain[2]} " * 14)]
    rows += [(102, f"{chain[3]} {chain[3]}"), (103, ("x" * 40_000 + " ") * 2 + "x" * 39_999 + "y " + "x" * 39_999 + "y")]
    rows += [rows[5], rows[5]]
    got = [tuple(r) for r in spelling_variants(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == spelling_brute(rows)
    assert any(root not in (word, form) for word, form, root, *_ in got)


def test_spelling_without_words(spark):
    assert spelling_variants(docs_of(spark, [])).collect() == []
    assert spelling_variants(docs_of(spark, [(1, None), (2, "short words only")])).collect() == []
    assert vocabulary_of(docs_of(spark, [(1, "longword " * 2)]), SpellingParams(damaged=0)).collect() == [("longword", 2)]


# --- resampling ---------------------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text):
    words = words_of(text)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resample_brute(rows, target, percent=25):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(f.encode()) % 10000 for f in features_of(text))
    for text in target:
        t.update(zlib.crc32(f.encode()) % 10000 for f in features_of(text))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)
    ]
    out = []
    for i, text in rows:
        found = features_of(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // max(1, len(found))
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words_of(text)), len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100]):
        row[5] = rank + 1
    return sorted(map(tuple, out), key=str)


def texts_for_drawing(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "été", "ÉTÉ", "x9", "9", "naïve", "a", "あい", "W" * 70, "don't", "e-mail", "\x85", "ſ"]
    rows = [(None, None), (None, "no id " * 12), (1, ""), (2, " ,;\n"), (3, "y" * 500_000)]
    for i in range(4, 120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.randrange(60)))
        rows.append((i, text))
    return rows + [rows[20], rows[20], (7, rows[21][1])]


@pytest.mark.parametrize("dictionary", [0, 3, 200_000])
def test_resampling(spark, dictionary):
    rows = texts_for_drawing(8)
    target = ["été naïve the", None, "a the x9 x9 " * 20, ""]
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resample(docs_of(spark, rows), goal, ResampleParams(dictionary=dictionary)).collect()
    assert sorted(map(tuple, got), key=str) == resample_brute(rows, target)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "text string")
    assert resample(docs_of(spark, []), none).collect() == []
    rows = texts_for_drawing(9)
    got = resample(docs_of(spark, rows), none).collect()
    assert sorted(map(tuple, got), key=str) == resample_brute(rows, [])


def test_scanned_payloads_compose():
    rng = random.Random(10)
    for words in (["ab", "b", "été", "bab"], []):
        scan = PayloadScanner(words)
        text = "".join(rng.choice(["AB", "b", "Été", "bab", "unknown", " ", ",", "\n"]) for _ in range(500))
        crcs, lengths = scan(text.encode())
        found = words_of(text)
        assert crcs.tolist() == [zlib.crc32(w.encode()) for w in found]
        assert lengths.tolist() == [len(w.encode()) for w in found]
        runs = [" ".join(found[i : i + n]) for n in (1, 2, 3) for i in range(len(found) - n + 1)]
        assert feature_crcs(crcs, lengths, 3).tolist() == [zlib.crc32(r.encode()) for r in runs]
    long = [rng.randbytes(n) for n in (0, 1, 255, 256, 70_000)]
    left = np.array([zlib.crc32(b"left")] * len(long), np.uint32)
    right = np.array([zlib.crc32(x) for x in long], np.uint32)
    sizes = np.array([len(x) for x in long])
    assert compose(left, right, sizes).tolist() == [zlib.crc32(b"left" + x) for x in long]
