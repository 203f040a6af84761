import collections

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as C  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """Tables of the pipeline's inputs, with an extra column and odd rows."""
    d = tmp_path_factory.mktemp("sf")
    text_of = {r[0]: r[1] for r in rows if r[1]}
    junk = [(900 + i, " ".join(f"{w}###" for w in text_of[i].split()), "en", "s", 3, "x") for i in range(12)]
    docs = [(r[0], r[1], r[2], r[3], r[4], "x") for r in rows] + junk
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None and r[0] < 303] + [(r[0], 0, 0) for r in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(text_of[2].split()[:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, docs.count()
    seen = {}
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == names
        seen[name] = docs.collect()
    good, unique, cut, clean = seen.values()
    assert before > len(good) and not any(r.text and "###" in r.text for r in good)
    assert sum(r.doc_id in (0, 300, 301, 302) for r in unique) <= 1
    assert max(collections.Counter((r.doc_id, r.text) for r in unique).values()) == 1
    assert all(r.n_chars == len(r.text) for r in cut if r.text and r.doc_id not in (307,))
    assert len(cut) == len(unique) and len(clean) <= len(cut)
    out = C.STAGES[-1][1](spark, docs, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == len(clean)


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in C.STAGES:
        out = stage(spark, docs, folder)
        docs = spark.createDataFrame(out.collect(), out.schema)
    key = lambda df: collections.Counter(tuple(r) for r in df.collect())
    assert key(C.run(spark, folder)) == key(docs)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in C.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_rows_that_share_an_id(spark, folder):
    rows = [(None, "a b", None, None, 3), (None, "c d e f g h", None, None, 3), (5, None, "en", "x", 3), (5, "zz y x w", "en", "x", 4), (5, "zz y x w", "en", "x", 4), (6, "zz y x w", "en", "x", 4), (7, "", "a", "b", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in C.near_copies(spark, t, folder).collect())
    assert got == collections.Counter([(None, "a b"), (None, "c d e f g h"), (5, None), (5, "zz y x w"), (7, "")])


def test_columns_of_any_name_come_back(spark, folder):
    names = ["_row_key", "_n", "_kept", "kept_text", "rid", "tk", "row", "gid", "gtk", "id", "a.b", "n_removed", "class_id", "predicted"]
    plain = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "n_chars").collect()
    rows = [(r.doc_id, r.text, r.n_chars, *[f"{c} {i}" for c in names]) for i, r in enumerate(plain)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    known = {tuple(r[3:]) for r in rows}
    for (_, stage), slim in zip(C.STAGES[:-1], [spark.createDataFrame(plain, "doc_id long, text string, n_chars long")] * 4, strict=True):
        out = stage(spark, wide, folder)
        got, want = out.collect(), stage(spark, slim, folder).collect()
        assert collections.Counter((r[0], r[1], r[2]) for r in got) == collections.Counter((r[0], r[1], r[2]) for r in want)
        assert all(tuple(r)[3:] in known for r in got) and out.columns == wide.columns


def words(text):
    return (text or "").encode().split()


def brute_pipeline(spark, rows, folder):
    """Stages 2 to 4 by plain comparison of all pairs, all windows and all items."""
    import re

    rows = list(dict.fromkeys((r.doc_id, r.text) for r in rows))
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w) for w in (words(t) for _, t in rows)]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                up[top(i)] = top(j)
    order = lambda i: (rows[i][0] is not None, rows[i][0] or 0)
    classes = collections.defaultdict(list)
    for i in range(len(rows)):
        classes[top(i)].append(i)
    size = [len(v) for v in classes.values()]
    least = [[i for i in v if order(i) == min(map(order, v))] for v in classes.values()]
    assert all(len(x) == 1 for x in least), "the case has one row of the least id in each class"
    kept = [rows[x[0]] for x in least]
    assert sum(size) == len(rows)
    count = collections.Counter(tuple(w[p : p + 35]) for w in (words(t) for _, t in kept) for p in range(len(w) - 34))
    cut = []
    for i, t in kept:
        w, gone = words(t), set()
        for p in range(len(w) - 34):
            if count[tuple(w[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        cut.append((i, " ".join(x.decode() for p, x in enumerate(w) if p not in gone) if gone else t))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = find(r.text)
        windows |= {tuple(w[p : p + 13]) for p in range(max(1, len(w) - 12)) if w}
    clean = []
    for i, t in cut:
        w, hit = find(t), set()
        for p in range(len(w)):
            for n in {len(x) for x in windows}:
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    return clean


def test_stages_equal_brute_force(spark, folder):
    """What the classifier keeps goes through the other stages as plain Python has it, down to the tokens' counts."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null and doc_id not in (5, 105) and text is not null")
    docs = spark.createDataFrame(C.STAGES[0][1](spark, docs, folder).collect(), docs.schema)
    want = brute_pipeline(spark, docs.collect(), folder)
    for _, stage in C.STAGES[1:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    assert collections.Counter((r.doc_id, r.text) for r in docs.collect()) == collections.Counter(want)
    import public_tokenizers as P
    import tiktoken
    from tessel.llm import bpe

    ranks = bpe.coder(*bpe.resolve(None)).ranks
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = C.STAGES[-1][1](spark, docs, folder).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == collections.Counter((i, len(library.encode_ordinary(t or ""))) for i, t in want)
