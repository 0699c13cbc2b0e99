"""Quality, near-duplicates, lines, contamination and chats against plain Python."""

import random
import re

import pytest
import xxhash

from cohortlens.llm import components as cc
from cohortlens.llm.chat import format_chats, read_chats
from cohortlens.llm.decontaminate import WinnowParams, decontaminate
from cohortlens.llm.lines import line_dedup
from cohortlens.llm.quality import QualityParams, quality_rules
from cohortlens.llm.simhash import SimHashParams, ball_masks, simhash_groups

DOCS = "doc_id bigint, text string, n_words string, component_id int, _th int, pos int"
LABELS = "doc_id bigint, quality int, toxic int"
BLANKS = " \t\n\x0b\f\r"


def awkward(seed=0, n=60):
    """Random texts over a small vocabulary, with nulls, empties, copies, ties and odd blanks."""
    rng = random.Random(seed)
    vocabulary = ["The", "the", "ÉTÉ", "été", "a#b", "x|y", "don't", " ", "W2", "zz", "\x1c", "ǅ"]
    rows = [(None, None), (None, "no id here"), (1, ""), (2, " \t\n"), (3, "\n\n\n")]
    for i in range(4, n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 9, 10, 11, 40, 90]))]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t", "  "]) for w in words)))
    rows += [rows[10], rows[10], (n, rows[11][1]), (n + 1, "word " * 5000), (n + 1, "word " * 4999)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, 7, 7) for i, t in rows], DOCS)


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def base_rules(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 200 else len(set(grams)) == 1:
            hit |= set(range(i, i + 8))
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
    )


def test_quality_facts_and_verdicts(spark):
    rows = awkward()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4, 30)] + [(None, 1, 0), (31, 0, 0)], LABELS)
    out = quality_rules(table(spark, rows), labels, QualityParams(buckets=256)).collect()
    got = sorted(
        (str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        for r in out
    )
    assert got == sorted((str(i), *base_rules(t)) for i, t in rows)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    by_text = {}
    for r in out:
        assert by_text.setdefault(r["text_hash"], r["kept"]) == r["kept"]


def test_quality_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    out = quality_rules(table(spark, awkward()), none).collect()
    assert all(r["kept"] != r["base_failed"] for r in out)
    assert quality_rules(table(spark, []), none).count() == 0


def test_quality_tells_trusted_from_junk(spark):
    rng = random.Random(5)
    good = [f"g{rng.randrange(300)}" for _ in range(40_000)]
    bad = [f"b{rng.randrange(300)}!!" for _ in range(40_000)]
    rows = [(i, " ".join((good if i % 4 else bad)[i * 50 : i * 50 + 50])) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 800, 3)], LABELS)
    out = quality_rules(table(spark, rows), labels).collect()
    assert sum(r["kept"] for r in out if r["doc_id"] % 4) >= 0.97 * 600  # the threshold is a sample's
    assert not any(r["kept"] for r in out if r["doc_id"] % 4 == 0)


def print_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(low)
    n = min(3, len(words))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {p: find(p) for p in root}


def test_simhash_groups_equal_all_pairs(spark):
    rows = awkward(1)
    base = ("many words stand here so that one change moves few bits of the whole print " * 12).split()
    for i in range(100, 160):
        changed = list(base)
        changed[i % 90] = f"w{i % 7}"
        rows.append((i, " ".join(changed)))
    prints = [print_of(t) for _, t in rows]
    root = linked(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    want = sorted((str(i), f"{p:016x}", str(least.get(root[p]))) for (i, _), p in zip(rows, prints))
    out = simhash_groups(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in out) == want
    assert len(set(least.values())) < len(set(prints)) < len(rows)
    assert simhash_groups(table(spark, [])).count() == 0


def test_ball_masks():
    assert len(ball_masks(SimHashParams())) == 65
    assert len(ball_masks(SimHashParams(distance=4))) == 1 + 64 + 64 * 63 // 2


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(-5, i) for i in range(100)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (-5, 3)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in cc.components(edges).collect()}
    assert {got.get(i, i) for i in range(200, 261)} == {200}
    assert {got.get(i, i) for i in range(100)} == {-5}
    assert cc.components(edges.limit(0)).count() == 0


def deduped(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        first = {k: min((x for x in h if x is not None), default=None) for k, h in holders.items() if len(h) > 1}
        kept = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    shared = "A Line that several share"
    rows = awkward(2) + [
        (500, f"{shared}\nown\n{shared.upper()} "), (501, f"x\n\t{shared}"), (502, shared), (None, shared), (503, "short\nshort"),
        (504, "Ünd gleiche Zeile\nend"), (505, "ünd gleiche Zeile\nend"), (505, "Ünd gleiche Zeile"), (501, "other"),
    ]
    out = line_dedup(table(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in out) == deduped(rows)
    wide = line_dedup(table(spark, rows), with_columns=True)
    assert wide.columns == table(spark, rows).columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in wide.collect()) == sorted((a, d) for a, _, _, d in deduped(rows))
    assert line_dedup(table(spark, [])).count() == 0


def found_in(rows, items):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]

    passages = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else []:
            passages.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, of = words(t), set(), set()
        for n in {len(p) for p in passages}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in passages:
                    hit |= set(range(at, at + n))
                    of |= {str(x) for x in passages[tuple(w[at : at + n])] if x is not None}
        out.append((str(i), len(w), len(hit), sorted(of), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [200_000, 20])
def test_decontaminate(spark, block):
    rows = awkward(3, 40)
    passage = "One two, three-four five six SEVEN eight nine ten eleven twelve Élan"
    rows += [(900, f"pre {passage.lower()} post"), (901, "seven eight nine"), (902, passage[:40]), (903, passage * 3)]
    items = [(1, passage), (2, "seven Eight"), (3, None), (4, "..."), (1, passage), (None, "zz W2"), (5, passage)]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, fp int")
    out = decontaminate(table(spark, rows), benchmark, WinnowParams(block=block)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out)
    assert got == found_in(rows, items)
    clean = decontaminate(table(spark, rows), benchmark.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)
    assert decontaminate(table(spark, []), benchmark).count() == 0


def test_chats_read_back(spark):
    marks = ["<|im_end|>", "<|im_start|>", "<^|im_end|>", "<^^|im_start|>", "<|im_", "end|>", "<", "\n", "|", "^", "ok é"]
    rng = random.Random(4)
    rows = [
        (c, t, rng.choice(["user", "assistant", "assist<|im_end|>", None, "a\nb"]), "".join(rng.choices(marks, k=rng.randrange(9))))
        for c in range(60) for t in range(rng.randrange(1, 6))
    ]
    rows += [(None, 0, "user", None), (70, None, "assistant", "b"), (70, 1, "assistant", ""), (70, None, "assistant", "a"), (70, 1, "assistant", "")]
    talks = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string, begin int")
    made = format_chats(talks)
    out = {r["conv_id"]: r for r in read_chats(made).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, (r[2] or "").replace("\n", " "), r[3] or "")):
        want.setdefault(c, []).append(((role or "").replace("\n", " "), text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in out[c]["turns"]] == turns
        assert out[c]["trained"] == "".join(x for r, x in turns if r == "assistant")
    one = {r["conv_id"]: r["formatted"] for r in made.collect()}
    assert one[70].startswith("<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert format_chats(talks.limit(0)).count() == 0
