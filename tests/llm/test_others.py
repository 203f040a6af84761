import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from tessel.llm import byte_cnn, html_extract, outliers, shuffle_shards, token_counts, url_filter
from tessel.llm.html_blocks import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- token counts
@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_pieces(P.path(token_counts.VOCABULARY)))


def library():
    from tokenizers import Tokenizer, models

    pieces = token_counts.read_pieces(P.path(token_counts.VOCABULARY))
    vocab = [("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + pieces
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    return lambda s: len(t.encode("▁" + s.replace(" ", "▁"), add_special_tokens=False).ids) if s else 0


def test_pieces_equal_the_library_s():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path(token_counts.VOCABULARY))
    want = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    assert token_counts.read_pieces(P.path(token_counts.VOCABULARY)) == want


def test_counts_equal_the_library(counter):
    want, rng = library(), random.Random(5)
    parts = ["the ", " ", "  ", "   ", "\n", "e", "er", "in", "é", "😀", "中", "ß", "12", "▁", "a▁", "http://", "\t", "ing ", "ThE"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert counter.count(s)[0] == want(s)
        assert counter.apart and (not s or counter.search("▁" + s.replace(" ", "▁")) == counter.count(s))


def test_ties_go_to_the_longest_piece():
    c = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0), ("▁", 0.0)])
    assert c.count("abc") == (2, -3.0)


def test_token_table(spark, docs, rows, nothing):
    want = library()
    got = token_counts.count_tokens(docs).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(r[0]), want(r[1] or "")) for r in rows)
    assert token_counts.count_tokens(nothing).count() == 0


# ---- shards
def test_large_populations_are_drawn_like_small_ones():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 7 * 10**9, 10**6
    got = np.array([shuffle_shards.hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(got.mean() - 0.3 * n) < 5 * math.sqrt(n * 0.21 / 400) and 0.8 < got.std() / math.sqrt(n * 0.21) < 1.2


def test_matrix_has_exact_sums():
    before = np.array([0, 5, 5, 105, 300, 301])
    sizes = shuffle_shards.shard_sizes(301, 8)
    rows = np.array([shuffle_shards.matrix_row(before, sizes, p, 9) for p in range(5)])
    assert rows.sum(0).tolist() == sizes.tolist() and rows.sum(1).tolist() == np.diff(before).tolist() and rows.min() >= 0


def test_all_places_are_equally_likely(spark):
    seen = collections.Counter()
    df = spark.range(6, numPartitions=3)
    for seed in range(60):
        for r in shuffle_shards.shuffle_shards(df, 2, seed, block=2).collect():
            seen[r.id, r.shard, r.slot] += 1
    expected = 60 * 6 / 36
    chi = sum((seen[i, s, k] - expected) ** 2 / expected for i in range(6) for s in range(2) for k in range(3))
    assert len(seen) == 36 and chi < 60  # 25 degrees of freedom


def test_shards(spark, docs, rows, nothing):
    for block in (16384, 7, 1):
        got = shuffle_shards.shuffle_shards(docs.drop("shard_"), 8, block=block).collect()
        assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter((r[0], r[1]) for r in rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 8
    assert shuffle_shards.shuffle_shards(nothing, 8).count() == 0


def test_shards_of_columns_with_clashing_names(spark):
    columns = ["shard", "SLOT_", "slot", "shard_", "pid", "at", "order", "range", "first", "c0", "n"]
    df = spark.createDataFrame([tuple(f"{c}{i}" for c in columns) for i in range(9)], ", ".join(f"`{c}` string" for c in columns))
    out = shuffle_shards.shuffle_shards(df, 2)
    assert out.columns == ["shard__", "SLOT_", "slot__", "shard_", *columns[4:], "shard", "slot"]
    got = sorted(tuple(r)[: len(columns)] for r in out.collect())
    assert got == [tuple(f"{c}{i}" for c in columns) for i in range(9)]


def brute_shards(places, shards, seed, block):
    """Shard and slot of each (partition, place), by the whole matrix and whole shards at once."""
    parts = sorted({p for p, _ in places})
    sizes = [sum(p == q for q, _ in places) for p in parts]
    before = np.concatenate([[0], np.cumsum(sizes)])
    whole = shuffle_shards.shard_sizes(len(places), shards)
    out = {}
    for i, p in enumerate(parts):
        row = shuffle_shards.matrix_row(before, whole, i, seed)
        to = np.repeat(np.arange(shards), row)[np.random.default_rng([seed, i]).permutation(sizes[i])]
        out |= {(p, k): int(t) for k, t in enumerate(to)}
    return out


def test_shards_equal_brute_force(spark):
    """Every row's shard is the one its partition's permutation deals it, and a shard is in the order of its rows' hashes."""
    from pyspark.sql import functions as F

    df = spark.range(1000, numPartitions=7).withColumn("p", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    df = df.withColumn("h", F.xxhash64(F.lit(11), "p", "k"))
    for block in (16384, 50):
        got = shuffle_shards.shuffle_shards(df, 8, seed=11, block=block).collect()
        want = brute_shards([(r.p, r.k) for r in got], 8, 11, block)
        assert all(want[r.p, r.k] == r.shard for r in got)
        for s in range(8):
            own = sorted((r.slot, r.h) for r in got if r.shard == s)
            assert [x for x, _ in own] == list(range(len(own))) and [h for _, h in own] == sorted(h for _, h in own)


# ---- outliers
def test_counts_equal_brute_force(spark, docs, rows, nothing):
    got = outliers.judge(docs).collect()
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        g = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {j for p in range(len(w) - 2) if g[tuple(w[p : p + 3])] > 1 for j in (p, p + 1, p + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(not r.kept for r in got if r.base_failed)
    assert outliers.judge(nothing).count() == 0


def plain_mcd(x):
    """The estimate of one group by plain numpy: the same starts, exact shares, steps until the determinant stands still."""
    floor, n = np.diag([f * f for f in outliers.FLOOR.values()]), len(x)
    h = math.ceil(outliers.SHARE * n)
    lo, mid, hi = (np.quantile(x, q, axis=0) for q in (0.25, 0.5, 0.75))
    starts = [(mid, floor), (mid, np.diag(((hi - lo) / 1.349) ** 2) + floor), (x.mean(0), np.cov(x.T, bias=True) + floor)]
    found = []
    for m, c in starts:
        det = math.inf
        while True:
            d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d2, kind="stable")[:h]]
            m, c = near.mean(0), np.cov(near.T, bias=True) * outliers.consistency(outliers.SHARE) + floor
            old, det = det, np.linalg.det(c)
            if not det < old * (1 - 1e-9):
                break
        found.append((det, m, c))
    return min(found, key=lambda f: f[0])


def test_estimates_equal_plain_ones(spark):
    """Groups with a cloud of outliers apart, which a start from all rows is drawn to."""
    rng = np.random.default_rng(3)
    groups = {}
    for g in range(4):
        mix = rng.normal(size=(4, 4)) * 0.2
        x = rng.normal(size=(600, 4)) @ mix + rng.uniform(0.5, 2, 4)
        x[: 60 * g] = rng.normal(size=(60 * g, 4)) * 0.05 + 6
        groups[f"g{g}"] = x
    rows = spark.createDataFrame([(k, *map(float, r)) for k, x in groups.items() for r in x], "key string, x0 double, x1 double, x2 double, x3 double").repartition(5)
    for r in outliers.determinants(rows).collect():
        det, m, c = plain_mcd(groups[r.key])
        low = np.array([[r[f"l_{i}{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        # A bin's edge may hold a few rows more than the exact share.
        assert abs(r.det / det - 1) < 0.05
        assert np.abs(np.array([r[f"m_{i}"] for i in range(4)]) - m).max() < 0.02 * math.sqrt(np.trace(c))
        assert np.abs(low @ low.T - c).max() < 0.02 * np.trace(c)


def test_verdicts_equal_plain_ones(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(900):
        w = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(int(rng.expovariate(0.3))):
            w[rng.randrange(len(w))] += rng.choice("#*$%")
        w = [x + "###" for x in w] if i % 50 < 2 else w
        rows.append((i, "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)), "en", f"s{i % 3}"))
    got = outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    vector = lambda r: (math.log(max(r.word_chars / r.n_words, 0.1)), math.sqrt(r.n_symbols / max(r.word_chars, 1)), 0.0, math.sqrt(r.n_repeat_words / r.n_words))
    assert not any(r.n_dup_lines for r in got)
    for g in range(3):
        own = [r for r in got if r.doc_id % 3 == g and not r.base_failed]
        x = np.array([vector(r) for r in own])
        _, m, c = plain_mcd(x)
        d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
        # Ends of steps from other starts may lie close to the least one, so distances near the cutoff are left open.
        assert all(r.kept == (d <= outliers.CUTOFF) for r, d in zip(own, d2, strict=True) if abs(d / outliers.CUTOFF - 1) > 0.3)
        assert sum(r.distance <= outliers.CUTOFF for r in own) == sum(r.kept for r in own)
        assert any(r.kept for r in own) and not all(r.kept for r in own)


def test_estimates_of_nothing(spark):
    assert outliers.determinants(spark.createDataFrame([], "key string, x0 double, x1 double, x2 double, x3 double")).count() == 0


def test_junk_is_rejected_and_prose_kept(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["alpha", "to", "of", "river", "mountain", "the", "is", "running", "x"]) + rng.choice(["", "s", "ing", "ed", "er"]) for _ in range(n))
    rows = [(i, prose(rng.randint(60, 300)), "en", f"s{i % 2}") for i in range(600)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(80).split()), "en", "s1") for i in range(30)]
    rows += [(2000 + i, " ".join("x" * 80 for _ in range(1)) + " " + " ".join("y" * 60 + str(j) for j in range(60)), "en", "rare") for i in range(3)]
    got = {r.doc_id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(v for k, v in got.items() if k < 1000) and not any(v for k, v in got.items() if k >= 1000)


def test_each_kind_of_repetition_is_rejected_alone(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    words = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, "\n".join(words(10) for _ in range(rng.randint(6, 30)))) for i in range(600)]
    rows += [(1000 + i, "\n".join(f"{words(4)}\nthe\nof" for _ in range(20))) for i in range(3)]
    rows += [(2000 + i, f"{words(26)} {p} {words(26)} {p}") for i, p in enumerate(words(24) for _ in range(3))]
    got = {r.doc_id: r for r in outliers.judge(spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[1000 + i].n_repeat_words == 0 and got[1000 + i].n_dup_lines == 38 for i in range(3))
    assert all(got[2000 + i].n_repeat_words == 48 and got[2000 + i].n_dup_lines == 0 for i in range(3))
    assert not any(r.base_failed for r in got.values()) and {k for k, r in got.items() if not r.kept} == {k for k in got if k >= 1000}


def test_consistency_factor():
    rng = np.random.default_rng(0)
    d = np.sort((rng.normal(size=(200_000, 4)) ** 2).sum(1))
    x = rng.normal(size=(200_000, 4))
    near = x[np.argsort((x**2).sum(1))[: int(0.75 * len(x))]]
    assert abs(outliers.consistency(0.75) * near.var() - 1) < 0.02 and len(d)


def test_outliers_plan_is_native(spark, docs):
    seen = []
    keep, outliers_stash = outliers.stash, lambda df, name: seen.append(df) or keep(df, name)
    outliers.stash = outliers_stash
    try:
        seen.append(outliers.judge(docs))
    finally:
        outliers.stash = keep
    assert len(seen) > 6
    assert not any(re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString()) for df in seen)


# ---- classifier
def test_classifier_learns_and_handles_odd_rows(spark, docs, rows, nothing):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["alpha", "to", "of", "river", "the", "is"]) + rng.choice(["", "s"]) for _ in range(rng.randint(20, 80)))
    table = [(i, good() if i % 3 else " ".join(w + "&&&" for w in good().split())) for i in range(600)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5, None, 1), (10**6, 1, 0)]
    t, lab = spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = byte_cnn.fit(t, lab)
    got = byte_cnn.classify(t, net).collect()
    held = [r for r in got if r.held_out]
    assert [r.held_out for r in got] == [zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    odd = byte_cnn.classify(docs, net).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    same = collections.defaultdict(set)
    for r in byte_cnn.classify(docs.selectExpr("coalesce(text, '') AS doc_id", "text"), net).collect():
        same[r.doc_id].add(r.score)
    assert all(max(v) - min(v) < 1e-6 for v in same.values())
    assert byte_cnn.classify(nothing, net).count() == 0
    assert byte_cnn.fit(t, lab.where("quality = 1")) == 1.0 and byte_cnn.fit(t, lab.where("false")) == 0.5
    assert byte_cnn.classify(docs, 0.5).where("score <> 0.5").count() == 0


def test_whole_text_counts():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    net = byte_cnn.Net(*[x.astype(np.float32) for x in (rng.normal(size=(256, 8)), rng.normal(size=(6, 8, 16)), rng.normal(size=16), np.zeros(16), rng.normal(size=16), np.zeros(1))])
    tables = byte_cnn._tables(net)
    texts = ["x" * 5000, "x" * 4990 + "y" * 10, "", None]
    one = byte_cnn.score(net, tables, pa.array(texts))
    assert one[0] != one[1] and one[2] == one[3]
    assert np.allclose(one, np.concatenate([byte_cnn.score(net, tables, pa.array([t], pa.string())) for t in texts]), atol=1e-6)


# ---- pages
def test_blocks_repair_markup():
    got = blocks('<body><nav class="Top menu"><ul><li><a href=x>One<li>Two &amp; 2</ul></nav><article><h1>T</h1><p><b>bold<br><p>next  <i>x</i>y</p><script>no</script>tail<!-- c --></article><footer>f')
    assert [b.text for b in got] == ["One", "Two & 2", "T", "bold", "next xy", "tail", "f"]
    assert got[0].path[:3] == ("body", "nav", ".top") and got[0].linked == 3 and got[4].path == ("body", "article", "p")
    assert blocks("") == [] and blocks("a < b") [0].text == "a < b" and blocks("<p>x</p") [0].text.startswith("x")


def test_labeller_on_held_out_pages():
    rng, net = random.Random(77), html_extract.trained()
    right = total = 0
    pages, marks = [], []
    for _ in range(150):
        text, m = html_extract.synthetic_page(rng)
        found = blocks(text)
        assert len(found) == len(m)
        if found:
            pages.append(html_extract.Page(found))
            marks.append(m)
    for p, m in zip(html_extract.label(pages, net), marks):
        right, total = right + int(((p >= 0.5) == np.array(m)).sum()), total + len(m)
    assert right / total > 0.97


def test_extract(spark):
    page = '<html><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy this now</div><article><h1>Title of it</h1>{}</article><footer>&copy; example</footer></body></html>'
    body = "".join(f"<p>Paragraph {i} &amp; more  words\n of text here.</p>" for i in range(5))
    rows = [(1, "u", page.format(body)), (1, "u", page.format(body)), (2, None, None), (3, "u", ""), (4, "u", page.format("".join(f"<p>p{i} words of text</p>" for i in range(3000)))), (None, "u", "<p>")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
        assert r.n_chars == len(r.text)
    want = "Title of it\n" + "\n".join(f"Paragraph {i} & more words of text here." for i in range(5))
    assert [r.text for r in by[1]] == [want, want] and by[2][0].text == "" and by[3][0].text == ""
    assert by[4][0].text.count("\n") == 3000 and len(got) == len(rows)


def test_lstm_slopes_equal_differences():
    rng = np.random.default_rng(0)
    w, b = rng.normal(0, 0.3, (html_extract.INPUT + html_extract.HIDDEN, 4 * html_extract.HIDDEN)), rng.normal(0, 0.1, 4 * html_extract.HIDDEN)
    x, mask = rng.normal(size=(4, 2, html_extract.INPUT)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    pull = rng.normal(size=(4, 2, html_extract.HIDDEN))
    value = lambda x, w, b: (html_extract._lstm(x, mask, w, b)[0] * pull).sum()
    to_x, to_w, to_b = html_extract._lstm_back(pull, html_extract._lstm(x, mask, w, b)[1], w)
    for at in ((0, 0, 3), (1, 1, 5), (3, 0, 0)):
        step = np.zeros_like(x)
        step[at] = 1e-5
        assert abs((value(x + step, w, b) - value(x - step, w, b)) / 2e-5 - to_x[at]) < 1e-6
    for at in ((2, 7), (html_extract.INPUT + 1, 50)):
        step = np.zeros_like(w)
        step[at] = 1e-5
        assert abs((value(x, w + step, b) - value(x, w - step, b)) / 2e-5 - to_w[at]) < 1e-5


# ---- urls
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y", "http://a.net", "x://u@b.co.uk:80/es/#", "http://example.net/es/", "http://net/fr/", "http://xnet/fr/\nq", "a?://b.com/", "://", "http://com", "http://com/", "http://EXAMPLE.com/en/", "https://É.com/x", "a://b://c.net/es/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] + [(3, urls[3], "x", "y")], "page_id long, url string, host string, n string")
    outcomes = spark.createDataFrame([(f"http://bad.site.org/{i}", 0) for i in range(50)] + [(f"http://good.net/{i}", 1) for i in range(50)] + [("http://q.net/", None), (None, 1)], "url string, good int")
    got = url_filter.judge(pages, outcomes, RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    more = spark.createDataFrame([(1, "http://bad.site.org/z"), (2, "http://new.site.org/z"), (3, "http://good.net/q"), (4, "http://fresh.info/")], "page_id long, url string")
    by = {r.page_id: r for r in url_filter.judge(more, outcomes, []).collect()}
    assert by[1].verdict == "block" and by[3].verdict == "allow" and by[4].verdict == "allow" and by[1].rate < by[2].rate < by[3].rate
    assert url_filter.judge(pages.where("false"), outcomes, RULES).count() == 0
    assert url_filter.judge(pages, outcomes.where("false"), RULES).where("verdict is null").count() == 0


def brute_reputation(counts):
    """(rate, upper) of each host by plain loops. counts: host to (suffix, domain, good, all)."""

    def strength(rows):  # (good, all, parent's rate)
        over = sum(n * (s / n - p) ** 2 - p * (1 - p) for s, n, p in rows if n)
        room = sum(p * (1 - p) * (n - 1) for s, n, p in rows if n)
        rho = over / room if room > 0 else 0.0
        rho = min(max(rho, 1 / (url_filter.STRONG + 1)), 1 / (url_filter.WEAK + 1))
        return (1 - rho) / rho

    s0, n0 = sum(x[2] for x in counts.values()), sum(x[3] for x in counts.values())
    p0 = (s0 + 1) / (n0 + 2)
    parent = dict.fromkeys(counts, p0)
    for unit in (0, 1):
        groups = collections.defaultdict(lambda: [0, 0, 0.0])
        for h, x in counts.items():
            g = groups[x[unit]]
            g[0], g[1], g[2] = g[0] + x[2], g[1] + x[3], parent[h]
        k = strength(list(map(tuple, groups.values())))
        parent = {h: (k * groups[x[unit]][2] + groups[x[unit]][0]) / (k + groups[x[unit]][1]) for h, x in counts.items()}
    k = strength([(x[2], x[3], parent[h]) for h, x in counts.items()])
    out = {}
    for h, x in counts.items():
        a, b = k * parent[h] + x[2], k * (1 - parent[h]) + x[3] - x[2]
        out[h] = (a / (a + b), min(1.0, a / (a + b) + url_filter.BOUND * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))))
    return out, p0


def test_reputations_equal_brute_force_and_decide(spark):
    rng = random.Random(4)
    hosts = {f"h{i}.d{i % 9}.{('com', 'org', 'net')[i % 3]}": (0.15 if i % 11 == 0 else 0.9) for i in range(60)} | {"unseen.d1.org": None}
    outcomes = [(f"http://{h}/{j}", int(rng.random() < p)) for h, p in hosts.items() if p is not None for j in range(rng.randint(1, 60))]
    counts = {h: (h.split(".")[2], ".".join(h.split(".")[1:]), sum(g for u, g in outcomes if f"//{h}/" in u), sum(f"//{h}/" in u for u, _ in outcomes)) for h in hosts}
    want, p0 = brute_reputation(counts)
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(hosts)], "page_id long, url string")
    got = {r.host: r for r in url_filter.judge(pages, spark.createDataFrame(outcomes, "url string, good int"), []).collect()}
    level = p0 / (p0 + url_filter.WORSE * (1 - p0))
    for h, (rate, upper) in want.items():
        assert abs(got[h].rate - rate) < 1e-9 and abs(got[h].upper - upper) < 1e-9
        assert got[h].verdict == ("block" if upper < level else "allow")
    assert 1 < sum(r.verdict == "block" for r in got.values()) < 8


def test_ties_among_rules_go_to_the_first(spark):
    rules = [("block", "a.com", "/x"), ("allow", "com", "/xyzzy"), ("allow", "a.com", "/x")]
    pages = spark.createDataFrame([(1, "http://a.com/xyzzy"), (2, "http://a.com/x"), (3, "http://b.com/xyzzy"), (4, "http://b.com/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, spark.createDataFrame([], "url string, good int"), rules).collect()}
    assert got == {1: ("com/xyzzy", "allow"), 2: ("a.com/x", "block"), 3: ("com/xyzzy", "allow"), 4: (None, "allow")}


def test_sites(spark):
    cases = {"www.a.co.uk": ("a.co.uk", "co.uk"), "a.com": ("a.com", "com"), "x.y.b.org": ("b.org", "org"), "com": ("com", "com"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "u@q.net:8080": ("q.net", "net"), "co.uk": ("co.uk", "uk")}
    df = spark.createDataFrame([(f"http://{h}/",) for h in cases], "url string")
    for r in url_filter.with_site(df).collect():
        assert (r.domain, r.suffix) == cases[r.host]
