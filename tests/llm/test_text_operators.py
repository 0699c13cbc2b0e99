"""Pages, token files, placement and suffixes against plain Python."""

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm.html_wrappers import Matcher, WrapperParams, align, extract_pages, fold, slots
from cohortlens.llm.queries import op9_sharding, tokenizer
from cohortlens.llm.sharding import ShardParams, fill_table, place, read_shards, write_shards
from cohortlens.llm.suffixes import (
    SuffixParams, blind_trie_order, deep_shallow_order, samples, shared_offsets, suffix_dedup,
)
from cohortlens.llm.token_files import (
    TokenFile, TokenFileParams, bits_for, encode_texts, pack, read_token_digests, unpack, write_token_files,
)

WIDE = "doc_id bigint, text string, slot int, start int, spans int, host int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1) for i, t in rows], WIDE)


# --- suffixes


def cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(r)]
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(r), int(gone.sum()), runs, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def pieces_of(seed, n=60):
    rng = random.Random(seed)
    blocks = ["".join(rng.choices("abé ", k=rng.choice([5, 20, 45, 60, 100]))) for _ in range(8)]
    rows = [(None, None), (None, "ab" * 80), (1, ""), (2, "short")]
    rows += [(i, "".join(rng.choice(blocks) if rng.random() < 0.6 else "".join(rng.choices("xyz", k=9)) for _ in range(rng.randrange(1, 8)))) for i in range(3, n)]
    return rows + [rows[9], rows[9], (n, "z" * 300), (n, "ab" * 70), (n + 1, rows[12][1])]


@pytest.mark.parametrize("length, head, group", [(40, 16, 1000), (40, 16, 3), (33, 33, 1000), (50, 5, 2)])
def test_suffix_dedup(spark, length, head, group):
    rows = pieces_of(length + head)
    out = suffix_dedup(table(spark, rows), SuffixParams(length, head, 4, group)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in out)
    assert got == sorted((str(i), *c) for (i, _), c in zip(rows, cut([t for _, t in rows], length)))


def test_suffix_dedup_of_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    out = sorted(suffix_dedup(docs).collect(), key=lambda r: r["doc_id"])
    want = cut([r["text"] for r in rows], 400)
    assert [(r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in out] == want
    assert sum(w[1] for w in want) > 0
    assert suffix_dedup(docs.limit(0)).count() == 0


def test_orders_equal_sorting():
    rng = random.Random(2)
    for _ in range(200):
        strings = [bytes(rng.choices(b"ab", k=rng.randrange(30))) for _ in range(rng.randrange(1, 40))]
        for order in (deep_shallow_order(strings, rng.randrange(8)), blind_trie_order(strings, range(len(strings)), 0)):
            assert sorted(order) == list(range(len(strings)))
            assert [strings[i] for i in order] == sorted(strings)


def test_samples_cover_every_string_once():
    rng = random.Random(3)
    raw = bytes(rng.choices(b"abc", k=700)) + b"q" * 200
    for part in samples(raw, SuffixParams(50, 20)):
        starts = [s for a, lo, hi in zip(part[0], part[1], part[2]) for s in range(a - hi, a - lo + 1)]
        assert starts == list(range(len(raw) - 49))


def test_shared_offsets_equal_all_pairs():
    rng, p = random.Random(6), SuffixParams(20, 6, 2)
    for _ in range(300):
        n = rng.randrange(2, 9)
        lefts = [bytes(rng.choices(b"ab", k=rng.randrange(12))) for _ in range(n)]
        rights = [bytes(rng.choices(b"ab", k=14)) for _ in range(n)]
        got = [{o for lo, hi in r for o in range(lo, hi + 1)} for r in shared_offsets(lefts, rights, p)]
        want = [
            {o for o in range(len(a) + 1) if any(
                i != j and len(lefts[j]) >= o and lefts[j][:o] == a[:o] and rights[j][: 14 - o] == rights[i][: 14 - o] for j in range(n))}
            for i, a in enumerate(lefts)
        ]
        assert got == want


# --- token files


def test_packing():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 8, 13, 16, 17, 31):
        for n in (0, 1, 63, 64, 65, 1000):
            ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
            assert (unpack(pack(ids, bits), n, bits) == ids).all()
            assert len(pack(ids, bits)) == -(-n // 64) * bits * 8
    assert (bits_for(49_408), bits_for(65_536), bits_for(65_537)) == (16, 16, 17)


TEXTS = ["", "Hello world's end\n\nx", "a\tb c  d", "İ ﬁ é é ²3 don't", "\x1c \x85 z", "<|endoftext|> a<|startoftext|>b", "日本 語" * 50, "é" * 3000]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 3 % 8, t) for i, t in enumerate(TEXTS)] + [(None, "none"), (None, None), (2, "two"), (2, "two"), (99, "w " * 5000)]
    manifest = write_token_files(table(spark, rows), path, str(tmp_path / "ids"), TokenFileParams(block=128))
    got = read_token_digests(spark, manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want, start = [], 0
    for i, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((str(i), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    one = manifest.first()["path"]
    with __import__("pyarrow").fs.LocalFileSystem().open_input_file(one) as source:
        file = TokenFile(source)
        every = file.read(0, file.n_ids)
        for a, b in [(0, 1), (5, 5), (3, min(300, file.n_ids)), (file.n_ids - 1, file.n_ids)]:
            assert (file.read(a, b) == every[a:b]).all()
    assert read_token_digests(spark, write_token_files(table(spark, []), path)).count() == 0


def test_stretches_encode_like_whole_texts(spark, sf_dir):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        model = file.read()
    rng = random.Random(4)
    letters = list("abz \n\t\rÉ'’日²½१ ́.!<|>") + ["<|endoftext|>", "'ll", " ", "\xa0", "\x1f"]
    some = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(4000)]
    some += [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    want = [x.ids for x in Tokenizer.from_str(model).encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in encode_texts(some, model, b"")] == want


# --- placement


def test_table_is_filled_in_turns():
    for n, size in [(1, 2), (3, 7), (5, 101), (7, 7)]:
        filled = fill_table([f"s{i}" for i in range(n)], size)
        counts = Counter(filled)
        assert len(filled) == size and max(counts.values()) - min(counts.values()) <= 1
    before, after = fill_table("abcdefghij", 10_007), fill_table("abcdefghi", 10_007)
    assert sum(a != b for a, b in zip(before, after) if a != 9) < 0.1 * 10_007
    for bad in ((["a"], 8), (["a", "a"], 7), ([], 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            fill_table(*bad)


def test_place(spark):
    rows = [(i, "x") for i in range(5000)] + [(None, "a"), (None, "b"), (7, "again")]
    params = ShardParams(tuple("abc"), 101)
    placed = place(table(spark, rows), params=params)
    assert placed.columns == [*table(spark, rows).columns, "slot_", "shard"]
    got = placed.collect()
    filled = fill_table(params.shards, 101)
    assert len(got) == len(rows) and all(r["shard"] == params.shards[filled[r["slot_"]]] for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert min(Counter(r["shard"] for r in got).values()) > 1300
    assert place(table(spark, []), params=params).count() == 0


def test_shards_hold_whole_rows_and_split_hot_keys(spark, sf_dir, tmp_path):
    rows = [(None if i % 3 else i, f"text {i % 700}") for i in range(3000)] + [(None, "copy")] * 900
    placed = place(table(spark, rows), params=ShardParams(tuple("012"), 101))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small parts are joined
    try:
        write_shards(placed, str(tmp_path / "out"), rows=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = read_shards(spark, str(tmp_path / "out"), placed.schema)
    assert Counter(map(tuple, back.select(*placed.columns).collect())) == Counter(map(tuple, placed.collect()))
    sizes = Counter(r[0] for r in back.where("doc_id is null").select(F.input_file_name()).collect())
    assert len(sizes) >= 3 and len({f.split("shard=")[1][0] for f in sizes}) == 1
    found = op9_sharding(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert all("/shard=shard-" in f for f in found.inputFiles()) and found.columns == ["doc_id", "slot", "shard"]
    assert sorted(found.collect()) == sorted(place(documents.select("doc_id")).collect())
    stored = spark.read.parquet(found.inputFiles()[0].split("/shard=")[0])
    assert set(documents.columns) < set(stored.columns) and stored.select(documents.columns).exceptAll(documents).isEmpty()


# --- pages


def test_pages_of_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for params in (WrapperParams(), WrapperParams(broadcast=0)):
        got = {r["page_id"]: r["text"] for r in extract_pages(pages, params).collect()}
        for r in pages.collect():
            body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
            blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
            assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><div class="cookie-notice">We use
cookies</div><nav><ul><li>Home<li>More</ul></nav><div id=wrap><div class="story"><h2>Title {n} &amp; more</h2><p>First&nbsp;<b>bold</b>er
 para {n}<p>Second<br>{n} &lt;x&gt;</div><div class='side-bar sidebar'><p>Aside {n}</p></div><form><input>Mail</form>
<section id="comments"><p>Nice! {n}</p></section></div><footer>&copy; {n}</footer><script>if (a<b) "</p>"</script></body></html>"""


def test_pages_without_marks_and_awkward_pages(spark):
    rows = [(i, f"http://A.example/{i}", PAGE.format(n=i)) for i in range(12)]
    rows += [(50, None, None), (51, None, ""), (52, "nonsense", "<p>just a text that is longer &#8364;"), (None, "http://b/", "<<p>>1 < 2 <b"), (0, rows[0][1], rows[0][2])]
    rows += [(60, "http://c/1", "<main><header><h1>H</h1></header>A<!-- p --> b<aside>no</aside><div>c</div></main>"), (61, "http://c/1", "<article>" + "<p>x</p>" * 500 + "<ul><li>y</ul>")]
    pages = spark.createDataFrame([(*r, 1, 1) for r in rows], "page_id bigint, url string, html string, host int, rules int")
    got = {(r["page_id"], r["url"]): r["text"] for r in extract_pages(pages).collect()}
    for i in range(12):
        assert got[i, f"http://A.example/{i}"] == f"Title {i} & more\n\nFirst bolder para {i}\n\nSecond {i} <x>"
    assert got[50, None] == got[51, None] == ""
    assert got[52, "nonsense"] == "just a text that is longer €"
    assert got[60, "http://c/1"] == "H\n\nA b\n\nc"
    assert got[61, "http://c/1"] == "\n\n".join(["x"] * 500 + ["y"])
    assert extract_pages(pages).count() == len(rows) and extract_pages(pages.limit(0)).count() == 0


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in extract_pages(pages).collect()}


def test_pages_of_several_layouts_and_long_lists(spark):
    a = "<body><div><section><h1>Head {n}</h1><p>" + "long text {n} " * 9 + "</p></section></div></body>"
    b = "<body><table><tr><td><h1>Cell {n}</h1><p>short text {n}</td></tr></table></body>"
    c = "<body><div><h1>List {n}</h1><p>Before {n}</p><ul><li>" + "item {n} " * 50 + "</li></ul><p>After {n}</p></div></body>"
    want = {"a": lambda n: f"Head {n}\n\n" + " ".join(f"long text {n}" for _ in range(9)), "b": lambda n: f"Cell {n}\n\nshort text {n}"}
    want["c"] = lambda n: f"List {n}\n\nBefore {n}\n\n" + " ".join(f"item {n}" for _ in range(50)) + f"\n\nAfter {n}"
    kinds = [(n, "aaabb"[n % 5]) for n in range(20)]
    rows = [(n, url and f"{url}/{n}", {"a": a, "b": b}[k].format(n=n + at)) for at, url in ((0, "http://h"), (100, None)) for n, k in kinds]
    rows = [(i, url, page) for i, (_, url, page) in enumerate(rows)] + [(40, "http://one/", c.format(n=40))]
    got = extracted(spark, rows)
    for at in (0, 100):
        for n, k in kinds:
            assert got[n + at // 5] == want[k](n + at)
    assert got[40] == want["c"](40)


def test_repeated_text_is_no_boilerplate_in_an_article_or_among_copies(spark):
    page = "<body><h4>Our site</h4><div><h2>Abstract</h2><p>own text of page {n}, long enough</p>{more}</div></body>"
    quote = "<blockquote><p>Twice the same quote.</p></blockquote>"
    few = "<body><h4>Our site</h4><div><p>own text of page {n}, long enough</p></div>{more}</body>"
    dated = "<body><section><p>{n} May</p></section><div><h1>One</h1><p>article on all pages of the host</p></div></body>"
    rows = [(n, f"http://q/{n}", page.format(n=n, more=quote if n < 2 else "")) for n in range(9)]
    rows += [(10 + n, f"http://d/{n}", dated.format(n=n)) for n in range(5)]
    rows += [(20 + n, f"http://f/{n}", few.format(n=n, more=quote if n < 2 else "")) for n in range(9)]
    rows += [(30 + n, f"http://f/copy{n}", few.format(n=0, more=quote)) for n in range(20)]  # copies of one page
    got = extracted(spark, rows)
    for n in range(9):
        more = "\n\nTwice the same quote." if n < 2 else ""
        assert got[n] == f"Abstract\n\nown text of page {n}, long enough{more}"
        assert got[20 + n] == f"own text of page {n}, long enough{more}"
    for n in range(5):
        assert got[10 + n] == f"{n} May\n\nOne\n\narticle on all pages of the host"


def test_layout_classes_do_not_hide_articles(spark):
    text = "<h1>Head {n}</h1><p>text of page {n}, longer than what stands beside it</p>"
    side = "<div class='sidebar'><p>aside {n}</p></div><div class='top-ad'>ad {n}</div><div id=comments><p>nice {n}</p></div>"
    pages = {
        "a": "<body class='has-sidebar'>" + text + side,
        "b": "<body><div id='content' class='with-sidebar'>" + text + side + "</div>",
        "c": "<body><article class='post comments-open share'>" + text + "</article>" + side,
        "d": "<body><section class='sidebar'>" + text + side + "</section><p>x{n}</p>",  # a mark on the article's container
        "e": "<body><section class='widgets'><article>" + text + "</article></section>" + side,
        "f": "<body class='sidebar'><main class='search'>" + text + "</main>" + side,
    }
    rows = [(10 * k + n, f"http://{h}/{n}", page.format(n=n)) for k, (h, page) in enumerate(pages.items()) for n in range(4)]
    rows += [(90, "http://a/one", "<body><section class='sidebar'>" + text.format(n=9) + "</section>")]  # unlike the host's others
    rows += [(91, "http://a/ad", "<body><div class=ad>an ad that is longer than the text</div><p>short</p>")]
    got = extracted(spark, rows)
    for k, h in enumerate(pages):
        for n in range(4):
            want = f"Head {n}\n\ntext of page {n}, longer than what stands beside it"
            assert got[10 * k + n] == want + (f"\n\nx{n}" if h == "d" else "")
    assert got[90] == "Head 9\n\ntext of page 9, longer than what stands beside it"
    assert got[91] == "short"


def test_wrappers_cover_both_streams():
    a, b = ([("slot", x) for x in s] for s in ("abbbc", "adbc"))
    folded = fold(a, 4)
    assert folded == [("slot", "a"), ("rep", [("slot", "b")]), ("slot", "c")]
    both = align(folded, b, 4)
    assert both == [("slot", "a"), ("opt", [("slot", "d")]), ("rep", [("slot", "b")]), ("slot", "c")]
    rng = random.Random(1)
    wrapper = [("slot", "a")]
    for _ in range(50):
        stream = [("slot", x) for x in rng.choices("abcdef", k=rng.randrange(12))]
        wrapper = align(wrapper, fold(stream, 4), 4)
        assert {s for _, s in stream} <= set(slots(wrapper))


def test_ids_are_anchors_inside_articles_and_comments_may_be_articles(spark):
    text = "<p>text of page {n}, longer than what stands beside it</p>"
    pages = {
        "a": "<article><h2 id='search'>Search</h2>" + text + "<h3 id=comments>Comments</h3><p data-id=share>shared</p></article>",
        "b": "<main><section id='legal'><h2>Legal</h2>" + text + "</section><div id=comments><p>nice</p></div><div id=ads>buy</div></main>",
        "c": "<main>" + text + "</main><article class='comment'><p>first {n}</p></article><article id='comment-{n}'>me too</article>",
        "d": "<article class='post'>" + text + "<article class='comment even'><p>first {n}</p></article></article>",
        "e": "<body><h2 id='sidebar'>Sidebar</h2>" + text + "<ul id='menu'><li>Home</ul>",
        "f": "<body><h2 id='main'>Main</h2>" + text + "<p title=\"x class='ad'\">also</p>",
        "g": "<article class='comment'>" + text + "</article>",  # nothing but comments
    }
    own = "text of page {n}, longer than what stands beside it"
    want = {
        "a": "Search\n\n" + own + "\n\nComments\n\nshared",
        "b": "Legal\n\n" + own,
        "e": "Sidebar\n\n" + own,
        "f": "Main\n\n" + own + "\n\nalso",
    }
    for number in (1, 4):  # pages of a host
        rows = [(10 * k + n, f"http://{h}/{n}", page.replace("{n}", str(n))) for k, (h, page) in enumerate(pages.items()) for n in range(number)]
        got = extracted(spark, rows)
        for k, h in enumerate(pages):
            for n in range(number):
                assert got[10 * k + n] == want.get(h, own).replace("{n}", str(n)), (h, n)


def test_slots_of_one_path_are_judged_by_their_place(spark):
    """A welcome that every page repeats, and a date that changes, stand in the same path on either side of the text."""
    page = "<body><p>Welcome to our site</p><div><h1>Head {n}</h1><p>own text of page {n}, longer than the rest of it</p></div><p>Seen on day {n}</p></body>"
    box = "<body><div><section><h1>Head {n}</h1><p>own text of page {n}, <a href=x>with a link</a> and more of it</p><ul><li><a>kept {n}</a></ul></section>"
    box += "<table>{more}</table></div></body>"
    rows = [(n, f"http://p/{n}", page.format(n=n)) for n in range(5)]
    for n in range(5):  # an unmarked box of links, of a changing number
        more = "".join(f"<tr><td><a href='{i}'>Read on {n} {i}</a></td></tr>" for i in range(2 + n % 3))
        rows.append((10 + n, f"http://q/{n}", box.format(n=n, more=more)))
    got = extracted(spark, rows)
    for n in range(5):
        assert got[n] == f"Head {n}\n\nown text of page {n}, longer than the rest of it\n\nSeen on day {n}"
        assert got[10 + n] == f"Head {n}\n\nown text of page {n}, with a link and more of it\n\nkept {n}"


def test_wrappers_match_what_they_were_made_from():
    rng = random.Random(2)
    for _ in range(30):
        streams = [rng.choices("abcd", k=rng.randrange(1, 10)) for _ in range(6)]
        wrapper = fold([("slot", x) for x in streams[0]], 4)
        for s in streams[1:]:
            wrapper = align(wrapper, fold([("slot", x) for x in s], 4), 4)
        matcher = Matcher(wrapper)
        assert matcher.paths == list(slots(wrapper))
        for s in streams:
            for x, slot in zip(s, matcher.match(s)):
                assert slot < 0 or matcher.paths[slot] == x
    wrapper = [("slot", "a"), ("rep", [("slot", "b"), ("opt", [("slot", "c")])]), ("slot", "a"), ("opt", [("slot", "d")])]
    assert Matcher(wrapper).match("abcbbcax") == [0, 1, 2, 1, 1, 2, 3, -1]
    assert Matcher(wrapper).match("bad") == [1, 3, 4]
    assert Matcher(wrapper).match("") == []


def test_a_long_page(spark):
    many = "".join(f"<p>line {i} &amp; more</p>" for i in range(60_000))
    assert len(many) > 1 << 20
    got = extracted(spark, [(1, "http://l/1", f"<body><nav>x</nav><div>{many}</div></body>"), (2, "http://l/2", f"<article>{many}</article>")])
    assert got[1] == got[2] == "\n\n".join(f"line {i} & more" for i in range(60_000))
