"""The whole pipeline, and the score of its first stage, against a plain Python chain."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from test_pair_operators import DOCS as PLAIN
from test_pair_operators import LABELS, deduped, found_in, linked, print_of, words_of

import corpus_pipeline
from cohortlens.llm.quality import QualityParams, _of_ids, _percentile, quality_rules
from cohortlens.llm.queries import tokenizer

spm = pytest.importorskip("sentencepiece")
# names that the stages use themselves
DOCS = "doc_id bigint, text string, n_chars bigint, _kept_id int, _th int, text_hash string, `group` int, fp int, n_words int"
BENCHMARK = "item_id bigint, text string, doc_id int"


def signed(data):
    h = xxhash.xxh64_intdigest(data, 42)
    return h - (1 << 64) if h >> 63 else h


def grams(text, buckets):
    """Buckets of all words and word pairs, hashed with plain integers."""
    odd, full = 0x9E3779B97F4A7C15, (1 << 64) - 1
    one = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().split()]
    two = []
    for a, b in zip(one, one[1:]):
        a = a * odd & full
        two.append((a ^ a >> 29) + b & full)
    return [((h + n & full) * odd & full) % (1 << 64) // (1 << 32) % buckets for n, hs in ((1, one), (2, two)) for h in hs]


def quality(rows, labels, params=QualityParams()):
    """(score, kept) of every row."""
    good = sorted({i for i, q, toxic in labels if i is not None and q == 1 and not toxic}, key=lambda i: (signed(i.to_bytes(8, "little", signed=True)), i))
    good = good[: params.sample]
    fit, check = set(good[::2]), set(good[1::2] if len(good) > 1 else good)
    raw, target = Counter(), Counter()
    found = [grams(t, params.buckets) for _, t in rows]
    for (i, _), g in zip(rows, found):
        raw.update(g)
        if i in fit:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + params.buckets, sum(target.values()) + params.buckets
    ratio = {b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in raw}
    scores = [sum(map(ratio.__getitem__, g)) / len(g) if g and good else 0.0 for g in found]
    held = sorted(s for s, (i, t) in zip(scores, rows) if i in check and len(words_of(t)) >= 20)
    threshold = -math.inf
    if held:
        at = params.lost * (len(held) - 1)
        low = int(at)
        threshold = held[low] + (held[min(low + 1, len(held) - 1)] - held[low]) * (at - low)
    out = []
    for (_, t), score in zip(rows, scores):
        words = words_of(t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often, hit = Counter(windows), set()
        for i, w in enumerate(windows):
            if often[w] > 1:
                hit |= set(range(i, i + 8))
        failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
        out.append((score, not failed and score >= threshold - 1e-9))
    return out


def chain(rows, labels, items):
    """What is left after each stage."""
    left = [[r for r, (_, kept) in zip(rows, quality(rows, labels)) if kept]]
    left.append([(None if i == "None" else int(i), t) for i, _, _, t in deduped(left[-1])])
    root = linked([print_of(t) for _, t in left[-1]])
    first = {}
    for i, t in left[-1]:
        mine = (i is None, i or 0, signed((t or "").encode()), i, t)
        group = root[print_of(t)]
        first[group] = min(first.get(group, mine), mine, key=lambda m: m[:3])
    left.append([m[3:] for m in first.values()])
    marked = {(i, t) for i, t in left[-1] if found_in([(i, t)], items)[0][4]}
    left.append([r for r in left[-1] if r not in marked])
    return left


def corpus():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ta", "Mo", "ri", "Sé", "lu", "pen", "go", "ka") for b in ("ra", "lin", "x", "de", "mé", "so", "ti")]

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n))

    shared = "This notice stands in several documents"
    passage = prose(14)
    rows = [(i, prose(rng.randrange(15, 120))) for i in range(120)]
    rows += [(200 + i, f"{prose(40)}\n{shared}\n{prose(30)}") for i in range(6)]
    rows += [(300 + i, f"{prose(25)} {passage.upper() if i % 2 else passage} {prose(25)}") for i in range(5)]
    base = prose(200)
    rows += [(400 + i, base + (f" end{i}" if i % 2 else "")) for i in range(8)]
    rows += [(None, prose(60)), (None, base), (None, None), (500, None), (501, ""), (502, "\n \n"), (503, "word " * 90)]
    rows += [(504, prose(60) + " 日本😀 ▁x\x00  y"), (505, prose(9000)), (505, prose(40)), rows[3], rows[3], rows[205 - 80]]
    rows += [(600 + i, " ".join(f"zz{rng.randrange(40)}##" for _ in range(60))) for i in range(20)]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(1, 1, 1), (600, 0, 0), (None, 1, 0), (3, None, None), (2, 1, None)]
    items = [(1, passage), (2, None), (3, ""), (None, "nothing such"), (1, passage)]
    return rows, labels, items


def save(spark, folder, rows, labels, items):
    tables = {
        "documents": spark.createDataFrame([(i, t, None if t is None else len(t), 7, 7, "x", 7, 7, 7) for i, t in rows], DOCS),
        "labels": spark.createDataFrame(labels, LABELS),
        "benchmark": spark.createDataFrame([(*r, 0) for r in items], BENCHMARK),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_scores_and_verdicts(spark):
    rows, labels, _ = corpus()
    docs = spark.createDataFrame([(i, t, "x", 7, 7, 7) for i, t in rows], PLAIN)
    for params in (QualityParams(), QualityParams(buckets=97, sample=30)):
        out = quality_rules(docs, spark.createDataFrame(labels, LABELS), params).collect()
        got = sorted((str(r["doc_id"]), r["text_hash"], round(r["llr"], 9), r["kept"]) for r in out)
        want = [
            (str(i), signed((t or "").encode()), round(score, 9), kept)
            for (i, t), (score, kept) in zip(rows, quality(rows, labels, params))
        ]
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in sorted(want)]
        assert all(abs(g[2] - w[2]) < 1e-8 for g, w in zip(got, sorted(want)))


def test_stages_and_rows(spark, tmp_path):
    rows, labels, items = corpus()
    folder = save(spark, tmp_path / "in", rows, labels, items)
    left = chain(rows, labels, items)
    sizes = [len(rows), *map(len, left)]
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] > 50
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for n, ((name, stage), want) in enumerate(zip(corpus_pipeline.STAGES, left)):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / f"stage-{n}"))
        docs = spark.read.parquet(str(tmp_path / f"stage-{n}"))
        got = docs.collect()
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == sorted((str(i), t or "") for i, t in want), name
        assert all(r["_kept_id"] == 7 and r["text_hash"] == "x" and r["group"] == 7 for r in got), name
        assert all(r["n_chars"] == len(r["text"]) for r in got), name
    library = spm.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    want = []
    for i, t in left[-1]:
        ids = library.encode(t or "")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        want.append((str(i), len(ids), *sha))
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, out.collect())) == sorted(want)


def test_empty_tables(spark, tmp_path):
    rows, labels, items = corpus()
    assert corpus_pipeline.run(spark, save(spark, tmp_path / "a", [], labels, items)).count() == 0
    rows = [r for r in rows[:40]]
    got = corpus_pipeline.run(spark, save(spark, tmp_path / "b", rows, [], [])).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in chain(rows, [], [])[-1])
    blank = corpus_pipeline.run(spark, save(spark, tmp_path / "c", [(1, None), (None, None)], [], []))
    assert blank.count() == 0


def test_all_trusted_rows_count(spark):
    """More trusted ids than the 20,000 of which the former default took no more."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=21))) for i in range(20_400)]
    rows += [rows[7], (None, rows[8][1]), (20_400, "zz " * 30)]
    labels = [(i, 1, 0) for i in range(20_390)]
    docs = spark.createDataFrame([(i, t, "x", 7, 7, 7) for i, t in rows], PLAIN)
    out = quality_rules(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = sorted((str(r["doc_id"]), r["text_hash"], r["kept"], r["llr"]) for r in out)
    want = sorted((str(i), signed((t or "").encode()), kept, score) for (i, t), (score, kept) in zip(rows, quality(rows, labels, QualityParams(sample=None))))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-8 for g, w in zip(got, want))


def test_percentile_is_exact(spark):
    rng = random.Random(4)
    for numbers in ([], [2.5], [1.0, 2.0], [rng.choice([0.5, rng.random()]) for _ in range(3001)]):
        df = spark.createDataFrame([(x,) for x in numbers], "x double").repartition(5)
        for share in (0.0, 0.001, 0.37, 0.5, 1.0):
            assert _percentile(df, share) == df.agg(F.percentile("x", F.lit(share))).first()[0]


def test_documents_of_ids(spark):
    """Where the bits say yes to many other ids, the ids decide."""
    docs = spark.range(4000).selectExpr("if(id % 50 = 0, null, id % 3000) doc_id", "concat('t', id) text")
    ids = spark.range(0, 3000, 7).selectExpr("id doc_id")
    want = sorted(map(tuple, docs.join(ids, "doc_id").collect()))
    assert len(want) > 500
    for n in (0, 429):
        assert sorted(map(tuple, _of_ids(docs, ids, n).collect())) == want
