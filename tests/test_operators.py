"""Rules of single operators on small tables, against plain restatements and laws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.functions import udfs
from tessel.operators import containment, dedup, intervals, rules, select, stats, tasks
from tessel.operators import sequence as sq
from tessel.sources import tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_and_text(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([4, 4, 4, 2, 4, 4])] + [("b", 0, 3)], "k string, i int, v int")
    assert rows(sq.run_length_text(x, ["k"], ["i"], "v")) == [("a", "4x3 2 4x2"), ("b", "3")]


def test_prefix_sum_starts_at_zero(spark):
    x = spark.createDataFrame([("a", i, v) for i, v in enumerate([16, 8, 16])], "k string, i int, v int")
    assert [r.s for r in sq.prefix_sum(x, ["k"], ["i"], "v", "s").orderBy("i").collect()] == [0, 16, 24]


def test_first_flag_opens_no_session(spark):
    x = spark.createDataFrame([("a", i, f) for i, f in enumerate([True, False, True, False, True])], "k string, i int, f boolean")
    assert [r.session for r in sq.flag_sessions(x, ["k"], ["i"], F.col("f")).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_rest_over_the_gap_opens_a_session(spark):
    x = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.5, 2.0), ("a", 2.7, 3.0), ("a", 3.7, 4.0)], "k string, s double, e double")
    assert [r.session for r in sq.gap_sessions(x, ["k"], ["s"], F.col("s"), F.col("e"), 0.6).orderBy("s").collect()] == [0, 0, 1, 2]


def test_ngrams_of_short_lists_are_none(spark):
    x = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r.g for r in x.select(sq.ngrams(F.col("w"), 2).alias("g")).collect()] == [[["a", "b"], ["b", "c"]], [], []]


def test_longest_common_subsequence(spark):
    assert udfs.lcs(list("abcde"), list("axcye")) == 3
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for _ in range(50)]
    for a, b in pairs:
        m = udfs.lcs_pairs(list(a), list(b))
        assert len(m) == udfs.lcs(list(a), list(b)) and all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))
    x = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = x.select("i", sq.lcs_length(F.col("a"), F.col("b")).alias("n"), udfs.lcs_length("a", "b").alias("m")).collect()
    assert all(r.n == r.m == udfs.lcs(list(pairs[r.i][0]), list(pairs[r.i][1])) for r in got)


def test_asof_equals_a_scan(spark):
    rng = random.Random(2)
    left = [(rng.choice("ab"), rng.randint(0, 30), i) for i in range(40)]
    right = [(rng.choice("ab"), t, 100 + t) for t in rng.sample(range(30), 12)]
    got = intervals.asof_backward(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int"), ["k"], "t", ["v"])
    for r in got.collect():
        before = [(t, v) for k, t, v in right if k == r.k and t <= r.t]
        assert (r.last_t, r.last_v) == (max(before) if before else (None, None))
    assert got.count() == 40


def test_half_open_range_join_equals_a_scan(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.randint(-20, 50), i) for i in range(60)]
    spans = [(rng.choice("ab"), s := rng.randint(-20, 40), s + rng.randint(0, 25), i) for i in range(20)]
    p, s = spark.createDataFrame(points, "k string, t int, i int"), spark.createDataFrame(spans, "k string, a int, b int, j int")
    want = sorted((i, j) for k, t, i in points for q, a, b, j in spans if k == q and a <= t < b)
    assert rows(intervals.range_join(p, s, ["k"], "t", "a", "b", 7).select("i", "j")) == want
    outer = intervals.range_join(p, s, ["k"], "t", "a", "b", 7, "left").select("i", "j").collect()
    assert sorted((r.i, r.j) for r in outer if r.j is not None) == want and {r.i for r in outer} == set(range(60))


def test_equal_parts_round_half_to_even(spark):
    x = spark.createDataFrame([(0, 32, 192.0)], "s long, n long, span double")
    got = intervals.split_equal(x, "s", "n", "span", 46.55).orderBy("part").collect()
    assert [r.units for r in got] == [6, 7, 6, 7, 6] and [r.first for r in got] == [0, 6, 13, 19, 26]


def test_normalized_segments_tile(spark):
    x = spark.createDataFrame([("s", 0, "G", 0), ("s", 0, "C", 1), ("s", 8, "C", 2), ("s", 16, "D", 3), ("s", 99, "E", 4)], "k string, t int, c string, o int")
    assert rows(intervals.normalize(x, ["k"], "t", "c", F.lit(32), "o")) == [("s", 0, "C", 16), ("s", 16, "D", 16)]


def test_sweep_ends_before_starts(spark):
    x = spark.createDataFrame([("s", 0, 4, "a"), ("s", 4, 8, "b")], "k string, a int, b int, n string")
    got = intervals.sweep(x, ["k"], "a", "b").orderBy("seq").collect()
    assert [(r.n, r.at, r.on, r.since) for r in got] == [("a", 0, 1, 0), ("a", 4, 0, 4), ("b", 4, 1, 0), ("b", 8, 0, 4)]


@pytest.fixture(scope="module")
def leaky(spark):
    words = lambda a, n=30: " ".join(f"{a}{i}" for i in range(n))
    table = [
        ("t1", "train", words("x")), ("t2", "train", words("y")), ("e1", "test", words("x")), ("e2", "test", words("z") + " " + words("y", 20)), ("e3", "test", words("q")),
        ("v1", "validation", words("q")), ("v2", "validation", words("x")), ("v3", "validation", words("fresh")), ("e4", "test", "one two"), ("t3", "train", "one two"),
    ]
    return spark.createDataFrame(table, "id string, split string, text string")


def test_leaks_by_rank(leaky):
    want = [("e1", "exact_duplicate_of_train", "t1"), ("e2", "near_duplicate_of_train", "t2"), ("v1", "exact_duplicate_of_test", "e3"), ("v2", "exact_duplicate_of_train", "t1")]
    for n in (1, 3, 7):  # any order and layout
        got = dedup.resolve_leakage(leaky.repartition(n), "id", "split", "text", 6, 0.3)
        assert sorted((r.id, r.reason, r.match) for r in got.collect()) == want


def test_frequent_shingles_count_in_the_size_only(spark):
    held = spark.createDataFrame([("h", s) for s in (1, 2, 3, 4)], "h string, shingle long")
    other = spark.createDataFrame([(f"o{i}", 1) for i in range(5)] + [("o0", 2), ("o1", 2), ("o1", 3)], "o string, shingle long")
    assert rows(dedup.best_match(held, other, "h", "o", max_df=4)) == [("h", "o1", 2, 4, 0.5)]
    assert rows(dedup.best_match(held, other, "h", "o", max_df=5)) == [("h", "o1", 3, 4, 0.75)]


def test_groups_of_many_copies_lose_no_pair(spark):
    rows = [(i, s) for i in range(25) for s in range(10)]  # equal sets
    rows += [(100 + i, s) for i in range(30) for s in [*range(1000, 1020), 2000 + i]]  # near copies
    rows += [(200 + i, s) for i in range(150) for s in [7, 8, 9, *range(5000 + 10 * i, 5007 + 10 * i)]]  # a shared passage, too short
    sh = spark.createDataFrame(rows, "id long, shingle long")
    got = {tuple(r) for r in dedup.containment_classes(sh, "id", 0.5).collect()}
    want = {("equal", 0, i, 10, 1.0) for i in range(1, 25)} | {("near", 100 + i, 100 + j, 20, 20 / 21) for i in range(30) for j in range(i + 1, 30)}
    assert got == want
    assert dedup.containment_pairs(sh, "id", 20, 0.5).count() == 0  # what the cut loses


def test_classes_of_texts_send_little_and_equal_all_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.choice([4, 6, 30, 120]))] for _ in range(60)]
    texts = [(i, " ".join(t)) for i, t in enumerate(base)]
    for i in range(60, 300):  # copies, near copies, parts
        t = list(rng.choice(base))
        kind = i % 4
        if kind == 1:
            for _ in range(1 + len(t) // 20):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9999)}"
        texts.append((i, (" \n" if kind else " ").join(t[: len(t) // 2 + 3] if kind == 2 else t + t[:9] if kind == 3 else t)))
    texts += [(None, texts[7][1]), (400, None), (401, ""), (402, " ".join(base[3])), (402, " ".join(base[8])), (403, " ".join(base[8] + base[3]))]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    sets = {}
    for i, t in texts:
        w = (t or "").split()
        if i is not None and len(w) >= 6:
            sets.setdefault(i, set()).update(tuple(w[k : k + 6]) for k in range(len(w) - 5))
    rep = {}
    for i in sorted(sets):
        rep.setdefault(frozenset(sets[i]), i)
    want = {("equal", rep[frozenset(s)], i, len(s), 1.0) for i, s in sets.items() if rep[frozenset(s)] != i}
    reps = sorted(rep.values())
    for k, i in enumerate(reps):
        for j in reps[k + 1 :]:
            common, least = len(sets[i] & sets[j]), min(len(sets[i]), len(sets[j]))
            if common / least >= 0.5:
                want.add(("near", i, j, common, common / least))
    sent, write = [], containment.stash
    monkeypatch.setattr(containment, "stash", lambda df, name: sent.append((name, out := write(df, name))) or out)
    for group in (2000, 3):  # 3: least members of many sets have groups of their own
        monkeypatch.setattr(containment, "GROUP", group)
        got = [tuple(r) for r in dedup.text_classes(docs, "id", "text", 6, 0.5).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len({x[0] for x in want}) == 2
    ranked = next(df for name, df in sent if name == "ranked")
    often = {}
    for s in sets.values():
        for x in s:
            often[x] = often.get(x, 0) + 1
    # Only shingles of two texts or more are left to join.
    assert ranked.select(F.explode("members")).count() <= sum(often[x] > 1 for i in reps for x in sets[i]) < sum(len(sets[i]) for i in reps)


def test_packed_sets_come_back():
    places = np.array([0, 0, 3, 300, 555, 70000])
    members = np.array([1, (1 << 48) - 1, 7, 0, 5, 9], np.uint64)
    more = np.arange(6, dtype=np.uint8)
    assert [x.tolist() for x in containment.decode(containment.encode(places, members, more), 1)] == [places.tolist(), members.tolist(), more.tolist()]


def test_rules(spark):
    x = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "i int, v int")
    named = {"small": F.col("v") < 10, "odd": F.col("v") % 2 == 1}
    assert [r.f for r in x.select(rules.failed(named).alias("f")).collect()] == [[], ["small", "odd"], ["small", "odd"]]
    assert rows(rules.failure_counts(x, named)) == [("odd", 2), ("small", 2)]
    good, bad = rules.quarantine(x, {"none": F.col("v").isNull(), "big": F.col("v") > 10})
    assert rows(good) == [(1, 5)] and [(r.i, r.reason) for r in bad.orderBy("i").collect()] == [(2, "none"), (3, "big")]


def test_percentile_rules_differ(spark):
    x = spark.createDataFrame([("m", float(v)) for v in range(1, 21)] + [("m", float("nan")), ("m", None), ("e", None)], "metric string, value double")
    got = stats.summary(x).collect()
    assert [(r.metric, r.n, r.median, r.p05, r.p95) for r in got] == [("m", 20, 11.0, 1.0, 19.0)]
    a = F.array(*[F.lit(v) for v in (1, 2, 3, 4)])
    r = spark.range(1).select(stats.upper_median(a).alias("m"), stats.count_percentile(a, 0.95).alias("c"), stats.index_percentile(a, 0.95).alias("i")).first()
    assert (r.m, r.c, r.i) == (3, 4, 3)


def test_divergence_of_a_distribution_to_itself_is_zero(spark):
    x = spark.createDataFrame([(0.5, 0.5, 1.0, 0.0), (0.5, 0.5, 0.0, 0.0)], "p double, q double, r double, s double")
    r = x.agg(stats.js_divergence("p", "q").alias("a"), stats.js_divergence("p", "r").alias("b"), stats.js_divergence("p", "s").alias("c")).first()
    assert r.a == 0 and 0.3 < r.b < 0.32 and r.c is None


def test_best_of_n_rules(spark):
    x = spark.createDataFrame([("s", 0, False, 0.9), ("s", 1, False, 0.9), ("s", 2, True, 0.1), ("s", 3, True, 0.1)], "k string, seed int, ok boolean, a double")
    assert select.best_of_n(x, ["k"], [F.col("ok")], "seed").first().seed == 2
    assert select.best_of_n(x, ["k"], [], "seed").first().seed == 0
    with pytest.raises(ValueError, match="distance"):
        select.guarded(["distance"], frozenset({"ok"}))


def test_ranks_are_gapless(spark):
    got = select.ranked(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), ["v"])
    assert got.where("rank <> v").count() == 0 and got.count() == 1000


def test_update_plan_is_the_same_for_all_workers(spark):
    got = tasks.update_plan(spark.createDataFrame([(1,), (2,), (4,), (8,)], "world long"), 1528, 524288, 16384, 2).collect()
    assert {(r.per_update, r.steps_per_epoch, r.total_steps) for r in got} == {(32, 48, 96)} and [r.grad_accum for r in got if r.world == 4] == [8]


def test_packing_covers_all_rows_within_the_budget(spark):
    rng = random.Random(5)
    x = spark.createDataFrame([("g", i, rng.randint(100, 4000)) for i in range(300)], "g string, i int, n int")
    got = tasks.pack(x, "g", "i", "n", 16384).collect()
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r.n)
    assert len(got) == 300 and all(max(v) * len(v) <= 16384 for v in by.values())


def test_files(spark, tmp_path):
    (tmp_path / "a_b_s3.json").write_text('{"v": 1}')
    (tmp_path / "a_sX.json").write_text('{"v": 2}')
    got = tables.seeds_in_names(tables.read_entities(spark, str(tmp_path / "*.json"), "v int")).collect()
    assert [(r.name, r.seed, r.v) for r in got] == [("a_b", 3, 1)]
    (tmp_path / "x.jsonl").write_text('{"v": 1}\n\n{"v": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "v int").count() == 2
    (tmp_path / "ids").write_text("a\n\n b\na\n")
    assert rows(tables.read_ids(spark, str(tmp_path / "ids"))) == [("a",), ("b",)]
    logs = tables.key_values(spark.createDataFrame([("exit=0 seconds=12",), ("none",)], "t string"), "t", ["exit", "seconds"])
    assert rows(logs.where("exit is not null").select("exit", "seconds")) == [(0, 12)]
    df = spark.createDataFrame([(1, "train"), (2, "test")], "i int, split string")
    tables.write_splits(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="exists"):
        tables.write_splits(df, str(tmp_path / "out"))
    assert tables.content_digest(df) == tables.content_digest(df.repartition(5)) != tables.content_digest(df.limit(1))
    tables.write_report(df, str(tmp_path / "r.json"))
    assert tables.markdown(df).startswith("| i | split |")
