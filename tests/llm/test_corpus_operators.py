import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import common, components, katz, minhash, packing, quality, registry, toxicity, url_rules, wavelet
from tests.llm.helpers import DOCS, docs
from tests.oracle import same

EMPTY = []


# quality rules


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_statistics_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "b", "é😀", " ", "\n", "\t", "#", "\x0b", "\u00a0", "c d c d"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(-1, None, None, None, None)], DOCS)
    for r in quality.text_statistics(df).collect():
        assert tuple(r[c] for c in quality.BASE) == by_hand(r["text"] or ""), r["text"]


def test_base_rules_and_odd_cases(spark):
    got = {r["doc_id"]: r for r in quality.judge(docs(spark)).collect()}
    assert got[2]["base_failed"] and got[2]["n_words"] == 0 and not got[2]["kept"] and got[4]["base_failed"] and got[8]["n_words"] == 1
    assert got[0]["kept"] and quality.judge(docs(spark)).count() == 12 and quality.judge(docs(spark, EMPTY)).count() == 0
    kept = quality.stage(spark, docs(spark), None)
    assert kept.columns == docs(spark).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def rank(v, q):
    return np.sort(v)[max(0, math.ceil(q * len(v)) - 1)]


def factor(c):
    p = len(c)
    low = np.zeros((p, p))
    for i in range(p):
        for j in range(i + 1):
            rest = c[i, j] - low[i, :j] @ low[j, :j]
            low[i, j] = math.sqrt(max(rest, quality.FLOOR[i] ** 2)) if i == j else rest / low[j, j]
    return low


def distances(x, m, low):
    return (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)


def logdet(low):
    return np.log(np.diag(low)).sum()


def step(x, m, low):
    d = distances(x, m, low)
    near = x[d <= rank(d, quality.SUBSET)]
    return near.mean(axis=0), factor(np.cov(near.T, bias=True))


def to_the_end(x, m, low, tries=quality.TRIES):
    for _ in range(tries):
        m, low = step(x, m, low)
    for _ in range(quality.MOST):
        new = step(x, m, low)
        fell = logdet(new[1]) < logdet(low) - quality.STILL
        if logdet(new[1]) < logdet(low):
            m, low = new
        if not fell:
            break
    return m, low


def first_by_hand(x):
    """Medians with MADs and with the two robust correlations."""
    p = x.shape[1]
    m = np.array([rank(x[:, i], 0.5) for i in range(p)])
    s = np.maximum([1.4826 * rank(np.abs(x[:, i] - m[i]), 0.5) for i in range(p)], quality.FLOOR)
    z = (x - m) / s
    outer = np.outer(s, s)
    return [(m, factor(np.diag(s * s))), (m, factor(np.corrcoef(np.tanh(z).T) * outer)), (m, factor(np.corrcoef((z / np.linalg.norm(z, axis=1)[:, None]).T) * outer))]


def vectors_of(spark, groups):
    return spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, x0 double, x1 double, x2 double, x3 double, x4 double")


def of_row(r, scale=1):
    p = len(quality.VECTOR)
    low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    return np.array([r[f"m{i}"] for i in range(p)]), low


@pytest.mark.parametrize("small", [common.SMALL_TABLE, 0])
def test_robust_estimates_against_numpy(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_TABLE", small)
    rng = np.random.default_rng(2)
    mixing = np.array([[1, 0.5, 0, 0, 0], [0, 1, 0.3, 0, 0], [0, 0, 1, 0, 0], [0, 0, 0, 1, 0.2], [0, 0, 0, 0, 1]])
    groups = {}
    for g in range(3):
        x = rng.normal(size=(300, 5)) @ mixing
        x[: 30 * g] += 9
        groups[f"g{g}"] = x
    df = vectors_of(spark, groups)
    first = quality.starts(df, ["g"], quality.VECTOR).collect()
    fit = {r["g"]: r for r in quality.estimates(df, ["g"]).collect()}
    for g, x in groups.items():
        own = {r["start"]: of_row(r) for r in first if r["g"] == g}
        assert len(own) == 3 + quality.ELEMENTAL
        for n, (m, low) in enumerate(first_by_hand(x)):
            assert own[n][0] == pytest.approx(m) and own[n][1] == pytest.approx(low)
        for n in range(3, len(own)):  # means of six rows that are there
            assert (x.min(axis=0) <= own[n][0]).all() and (own[n][0] <= x.max(axis=0)).all()
        tried = {}
        for n, (m, low) in own.items():
            for _ in range(quality.TRIES):
                m, low = step(x, m, low)
            tried[n] = logdet(low), n, m, low
        _, n, m, low = min(tried.values(), key=lambda t: t[:2])
        m, low = to_the_end(x, m, low, 0)
        assert fit[g]["start"] == n and fit[g]["raw_logdet"] == pytest.approx(logdet(low))
        gm, glow = of_row(fit[g])
        assert gm == pytest.approx(m) and glow == pytest.approx(factor(low @ low.T * quality._consistency(5, quality.SUBSET)))
        bad = np.arange(len(x)) < 30 * int(g[1])
        assert (distances(x, gm, glow)[bad] > quality.CUTOFF).all() and (distances(x, gm, glow)[~bad] < quality.CUTOFF).mean() > 0.98


def hidden(seed):
    """Clusters of unlike shapes, so that concentration steps end at different subsets."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, 5)) @ rng.normal(size=(5, 5)) * 2 + rng.normal(size=5) * 8 for n in (170, 130, 100)]
    return np.concatenate(parts)


def test_where_one_start_fails_another_is_taken(spark):
    x = hidden(24)
    alone = to_the_end(x, *first_by_hand(x)[0])[1]
    fit = quality.estimates(vectors_of(spark, {"g": x}), ["g"]).first()
    assert fit["raw_logdet"] < logdet(alone) - 0.01 and fit["start"] != 0


def test_cutoff_is_the_quantile():
    rng = np.random.default_rng(3)
    assert quality.chi2_quantile(0.999, 5) == pytest.approx(20.515, abs=1e-3) and quality.CUTOFF == quality.chi2_quantile(quality.TAIL, 5)
    assert (rng.chisquare(5, 10**6) < 20.515).mean() == pytest.approx(0.999, abs=2e-4)


def test_quality_stage_odd_cases(spark):
    rng = random.Random(10)
    words = [f"word{i}" for i in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(80 + i), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else "", 1) for i in range(150)]
    odd = [(None, prose(90), "en", "lone", 1), (None, prose(90), None, None, 1), (200, rows[7][1], "en", "s1", 1), (200, rows[7][1], "en", "s1", 1), (201, prose(30000), "xx", "yy", 1), (202, "# # # $ " + " # $ ".join(prose(60).split()), "en", "s1", 1), (203, None, None, None, 1), (204, "", "", "", 1)]
    df = docs(spark, rows + odd)
    for name in ("_doc", "_lang", "_source", "_group", "distance", "n_words", "base_failed", "level", "start"):
        df = df.withColumn(name, F.lit("x"))
    kept = quality.stage(spark, df, None)
    assert kept.columns == df.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    want = collections.Counter((r[0], r[1]) for r in rows + odd if r[0] not in (202, 203, 204))
    assert got == want
    assert quality.stage(spark, df.limit(0), None).count() == 0


# toxicity


def test_toxicity_learns_and_stands_odd_cases(spark):
    rng = random.Random(3)
    plain, bad = [f"word{i}" for i in range(60)], ["nasty", "vilestuff", "vileness"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words), "en", "s", 1))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    truth = {r[0]: any(b in r[1] for b in bad) for r in rows}
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs(spark, rows), lab).collect()
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum((r["predicted"] == 1) == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.judge(docs(spark), lab.limit(0)).where("predicted = 1").count() == 0 and toxicity.judge(docs(spark), lab).count() == 12
    assert toxicity.judge(docs(spark, EMPTY), lab).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    rows = [(i, f"plain text number{i} " + ("marker" if i % 3 == 0 else ""), "en", "s", 1) for i in range(200)]
    label = lambda flip: spark.createDataFrame([(i, 1, int(i % 3 == 0) if zlib.crc32(str(i).encode()) % 4 != 2 else flip) for i in range(200)], "doc_id long, quality int, toxic int")
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.judge(docs(spark, rows), label(f)).collect()) for f in (0, 1)]
    assert scores[0] == scores[1]


def dense(sets, width):
    x = np.zeros((len(sets), width + 1))
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, s] = 1
    return x


@pytest.mark.parametrize("loss, value", [(toxicity.sigmoid_loss, lambda m: 1 / (1 + np.exp(m))), (toxicity.logistic_loss, lambda m: np.log1p(np.exp(-m)))])
def test_risk_and_its_gradient_by_hand(loss, value):
    rng, width = np.random.default_rng(9), 5
    sets = lambda n, share: [np.flatnonzero(rng.random(width) < share) for _ in range(n)]
    sparse = lambda s: toxicity.Sparse.of([np.array(x, "<u2").tobytes() for x in s], width)
    corrected = 0
    for prior in (0.05, 0.4, 0.9):
        p, u = sets(7, 0.7), sets(11, 0.3)
        for _ in range(5):
            w = rng.normal(size=width + 1) * 2
            xp, xu = dense(p, width), dense(u, width)
            first = lambda w: prior * value(xp @ w).mean()
            rest = lambda w: value(-(xu @ w)).mean() - prior * value(-(xp @ w)).mean()
            a, b, g = toxicity.risk(sparse(p), sparse(u), w, prior, loss)
            assert a == pytest.approx(first(w)) and b == pytest.approx(rest(w))
            whole = (lambda w: first(w) + rest(w)) if b >= 0 else (lambda w: -rest(w))
            corrected += b < 0
            slope = [(whole(w + e) - whole(w - e)) / 2e-5 for e in 1e-5 * np.eye(width + 1)]
            assert g == pytest.approx(slope, abs=1e-6)
    assert corrected
    # A small step along the direction lowers the corrected risk, or lifts a negative part that is below 0.
    x = toxicity.Lone(np.array([1.0, -2.0, 3.0]))
    assert x @ np.array([2.0, 1.0]) == pytest.approx([3, -3, 7]) and x.back(np.array([1.0, 2.0, 3.0])) == pytest.approx([6, 6])


def test_chosen_features_by_hand():
    p, u = np.array([90, 2, 50, 100, 30, 80]), np.array([100, 2, 5000, 9000, 40, 300])
    best, lift = toxicity.choose(p, u, 100, 10000, kept=2)
    z = [(a / 100 - b / 10000) / math.sqrt((a + b) / 10100 * (1 - (a + b) / 10100) * (1 / 100 + 1 / 10000)) for a, b in zip(p, u)]
    assert set(best) == set(sorted((i for i in range(6) if p[i] >= 3), key=lambda i: -z[i])[:2])
    assert lift == pytest.approx([math.log((p[i] + 0.5) / 101) - math.log((u[i] + 2) / 10004) for i in best])


def test_scores_do_not_depend_on_how_rows_lie(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    bad = [word() for _ in range(12)]
    rows = []
    for i in range(400):
        toxic = i % 5 == 0
        rows.append((i, " ".join([word() for _ in range(8)] + (rng.sample(bad, 4) if toxic else [])), "en", "s", 0))
    rows += [(1000 + i, "one text that is copied", "en", "s", 0) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    by = {n: {r["doc_id"]: r["score"] for r in toxicity.judge(df.orderBy(F.xxhash64("doc_id", F.lit(n))).repartition(n), labels, chunk=60).collect()} for n in (1, 7)}
    assert by[1] == by[7] and len(set(by[1].values())) > 50
    got = toxicity.dealt(df.select(F.col("text").cast("binary").alias("f")), 9).groupBy("chunk").agg(F.sum("times").alias("n")).collect()
    assert len(got) == 9 and sum(r["n"] for r in got) == 550 and max(r["n"] for r in got) < 100


def test_counts_and_chunks_cover_every_text(spark):
    rows = [(i, f"plain text {'vile' if i % 4 == 0 else ''} number{i % 7}", "en", "s", 1) for i in range(120)]
    df = docs(spark, rows).repartition(5)
    names = ["wnumber3", "wvile", "pvil", "wplain"]
    assert {r["at"]: r["u"] for r in toxicity.unlabelled_counts(df, names).collect()} == {0: 17, 1: 30, 2: 30, 3: 120}
    blobs = sorted(r["f"] for r in toxicity.numbered(df, names).collect())
    assert len(blobs) == 120 and sum(len(b) for b in blobs) == 2 * (17 + 30 + 30 + 120)
    positive = [np.array([1, 2, 3], "<u2").tobytes()] * 9
    lift = np.array([0.1, 2.0, 2.0, 0.1])
    one = toxicity.fit(toxicity.numbered(df, names), 1, positive, lift, 0.25)
    assert one == pytest.approx(toxicity.fit_chunk(positive, blobs, lift, 0.25), abs=1e-8)
    many = toxicity.fit(toxicity.numbered(df, names), 3, positive, lift, 0.25)
    assert len(many) == 5 and many[1] > 0 and many == pytest.approx(toxicity.fit(toxicity.numbered(df, names), 3, positive, lift, 0.25))


def test_toxicity_stage_odd_cases(spark, tmp_path):
    clean = [(i, f"plain words number{i} of a text", "en", "s", 1) for i in range(80)]
    bad = [(100 + i, f"vile nasty text{i} of words", "en", "s", 1) for i in range(40)]
    rows = [*clean, *bad, (None, "vile nasty words", "en", "s", 1), (None, None, None, None, None), (500, "", "", "", 0), (501, "", "", "", 0), (501, "", "", "", 0), (502, "clean " * 5000, "en", "s", 1)]
    labels = [(i, 1, 0) for i in range(0, 80, 2)] + [(100 + i, 1, 1) for i in range(30)] * 2 + [(None, 1, 1), (3, 1, None), (99999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    df = docs(spark, rows).withColumn("positive", F.lit(1)).withColumn("names", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("_judged", F.lit(1))
    kept = toxicity.stage(spark, df, str(tmp_path))
    assert kept.columns == df.columns
    got = kept.collect()
    assert {r["doc_id"] for r in got if r["doc_id"] is not None} == {*range(80), 500, 501, 502} and sum(r["doc_id"] == 501 for r in got) == 2
    assert [r["text"] for r in got if r["doc_id"] is None] == [None]
    assert toxicity.stage(spark, df.limit(0), str(tmp_path)).count() == 0
    # Half of the labels toxic, and nothing tells them apart: what nothing is known of stays.
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/even/labels.parquet")
    assert toxicity.stage(spark, docs(spark, [(i, "the same words", "en", "s", 1) for i in range(40)]), f"{tmp_path}/even").count() == 40


def test_one_positive_text_an_id(spark):
    df = docs(spark, [(1, "vile text", "en", "s", 1)] * 500 + [(2, "other", "en", "s", 1)])
    labels = spark.createDataFrame([(1, 1)] * 3 + [(2, 0)], "doc_id long, toxic int")
    assert [r["names"] for r in toxicity.positive_names(df, labels, 10).collect()] == [["ptex", "ptext", "pvil", "pvile", "wtext", "wvile"]]


def test_tables_go_when_unused_and_clusters_need_a_shared_folder(spark):
    import os

    df = common.written(spark.range(3), "t")
    path = df._written_to.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    common.discard(df)
    assert not os.path.exists(path)

    class Other:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "_jsc": type("J", (), {"sc": staticmethod(lambda: type("X", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))})})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Other)


# near-duplicates


def by_pairs(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = set(zip(*(w[j:] for j in range(k)))) if len(w) >= k else {tuple(w)} if w else set()
    low = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low[a] = low[b] = min(low[a], low[b])
    return {i: (len(s), low[i]) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_all_pairs(spark, k):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 3, 5, 8])):
                words[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    rows += [(1000, None, "en", "s", 1), (1001, " ", "en", "s", 1), (1002, "one", "en", "s", 1), (1003, "ONE", "en", "s", 1), (1003, "ONE", "en", "s", 1)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(docs(spark, rows), k).collect()}
    assert got == by_pairs(rows, k, 80)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(80)]
    for i in range(40):  # a chain: neighbours are alike, distant ones aren't
        words[i * 2 % 80] = f"n{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(docs(spark, rows), 2).collect()}
    assert got == by_pairs(rows, 2, 80)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "en", "s", 1), (5, b, "en", "s", 1), (3, a, "en", "s", 1), (3, c, "en", "s", 1), (9, c + " end", "en", "s", 1), (7, b + " end", "en", "s", 1), (7, b + " end", "en", "s", 1)]
    got = sorted(tuple(r) for r in minhash.groups(docs(spark, rows), 2).collect())
    assert got == [(3, 39, 3, True), (3, 39, 3, True), (5, 39, 3, False), (5, 39, 5, True), (7, 40, 5, False), (7, 40, 5, False), (9, 40, 3, False)]
    kept = sorted((r["doc_id"], r["text"][:1]) for r in minhash.stage(spark, docs(spark, rows), None).collect())
    assert kept == [(3, "a"), (3, "c"), (5, "b")]


def test_near_duplicates_odd_cases(spark):
    assert minhash.groups(docs(spark, EMPTY)).count() == 0
    got = minhash.groups(docs(spark), 2).collect()
    assert len(got) == 12 and {r["doc_id"]: r["component_id"] for r in got}[5] == 0
    kept = minhash.stage(spark, docs(spark), None)
    assert kept.columns == docs(spark).columns and kept.where("doc_id = 8").count() == 1 and kept.where("doc_id = 5").count() == 0


def test_near_duplicates_keep_rows_without_an_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda i: " ".join([*base[:-1], f"z{i}"])
    plain = [(None, f"text number {i} of its own", "en", "s", 1) for i in range(20)]
    alone = [(None, " ".join(base).upper() + " more", "en", "s", 1), (None, "", "en", "s", 1), (None, None, "en", "s", 1)]
    group = [(None, " ".join(f"v{i}" for i in range(60)) + e, "en", src, 1) for e in ("", " end") for src in ("s", "t", "t")]
    rows = [*plain, *group, (7, near(1), "en", "s", 1), (9, near(2), "en", "s", 1), (None, near(3), "en", "s", 1), (None, near(1), "en", "t", 1), *alone]
    got = minhash.stage(spark, docs(spark, rows), None).collect()
    texts = collections.Counter(r["text"] for r in got)
    assert all(texts[r[1]] == 1 for r in plain) and texts[""] == 1 and texts[None] == 1
    assert sum((r["text"] or "").startswith("v0 v1 ") for r in got) == 1
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == [7] and len(got) == 20 + 1 + 1 + 2
    found = minhash.groups(docs(spark, rows), 5).collect()
    assert len(found) == len(rows) and all(r["kept"] is not None for r in found) and sum(r["component_id"] == 7 for r in found) == 5
    kept = minhash.stage(spark, docs(spark), None)
    assert kept.where("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("hub, small", [(components.HUB, common.SMALL_TABLE), (2, common.SMALL_TABLE), (2, 0)])
def test_components(spark, monkeypatch, hub, small):
    monkeypatch.setattr(components, "HUB", hub)
    monkeypatch.setattr(common, "SMALL_TABLE", small)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in low.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# packing


def test_bounds_are_optimal():
    rng = random.Random(7)
    for _ in range(200):
        lengths = rng.sample(range(1, 60), rng.randint(1, 9))
        counts, k = [rng.randint(1, 9) for _ in lengths], rng.randint(1, 4)
        cost = lambda bs: sum(c * (min(b for b in bs if b >= n) - n) for n, c in zip(lengths, counts))
        got = packing.bounds(lengths, counts, k)
        assert len(got) <= k and cost(got) == min(cost((*s, max(lengths))) for r in range(k) for s in itertools.combinations(lengths, r))


def test_packing_covers_everything(spark):
    got = packing.pack(docs(spark), longest=400, buckets=3, budget=2000).toPandas()
    sizes = collections.Counter()
    for _, t, *_ in [tuple(r) for r in docs(spark, clash=False).collect()]:
        n = len((t or "").encode()) + 1
        for w in range(0, n, 400):
            sizes[min(400, n - w)] += 1
    assert collections.Counter(got["length"]) == sizes and (got["padding"] == got["bucket"] - got["length"]).all() and (got["padding"] >= 0).all()
    for (bucket, *_), g in got.groupby(["bucket", "slice", "batch"]):
        assert sorted(g["position"]) == list(range(len(g))) and len(g) * bucket <= max(2000, bucket)
    assert packing.pack(docs(spark, EMPTY)).count() == 0


def test_packing_counts_tokens_and_fills_batches(spark, monkeypatch):
    tokenizer = wavelet.Encoder(wavelet.model_path()).tokenizer
    sizes = collections.Counter()
    for _, t, *_ in [tuple(r) for r in docs(spark, clash=False).collect()]:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
        for w in range(0, n, packing.LONGEST):
            sizes[min(packing.LONGEST, n - w)] += 1
    assert collections.Counter(r["length"] for r in packing.stage(spark, docs(spark), None).collect()) == sizes
    monkeypatch.setattr(packing, "SLICE_ROWS", 10)
    rows = [(i, "a" * (3 if i < 400 else 99), "en", "s", 1) for i in range(500)]
    got = packing.pack(docs(spark, rows), buckets=2, budget=200).toPandas()  # bounds 4 and 100: 50 and 2 a batch
    batches = got.groupby(["bucket", "slice", "batch"]).size()
    for bound, fits in ((4, 50), (100, 2)):
        own = batches.loc[bound]
        assert (own < fits).sum() <= own.index.get_level_values("slice").nunique() and len(own) * fits <= 1.3 * own.sum()
    assert got[got["bucket"] == 100]["slice"].nunique() > 1


# Katz


def katz_by_hand(rows):
    tokens = {i: [katz.BEGIN, *(t or "").encode().lower().split(), katz.END] for i, t, *_ in rows}
    train = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    uni = collections.Counter(x for w in train for x in w[1:])
    bi = collections.Counter(p for w in train for p in zip(w, w[1:]))
    d1, d2 = (katz.discounts(collections.Counter(c.values())) for c in (uni, bi))
    cut = lambda c, d: c * d[c - 1] if c <= katz.K else c
    total = sum(uni.values())
    mass = sum(cut(c, d1) for c in uni.values()) / total
    unknown = max(1 - mass, 1 / (total + 1))
    p1 = {w: cut(c, d1) / total * (1 - unknown) / mass for w, c in uni.items()}
    contexts = {}
    for v in {v for v, _ in bi}:
        n = sum(c for (x, _), c in bi.items() if x == v)
        kept = {w: cut(c, d2) for (x, w), c in bi.items() if x == v and c >= katz.LEAST}
        size = n + 1 if n - sum(kept.values()) < 1e-9 * n else n
        contexts[v] = ({w: c / size for w, c in kept.items()}, (1 - sum(kept.values()) / size) / (1 - sum(p1[w] for w in kept)))
    p = lambda v, w: contexts.get(v, ({}, 1.0))[0].get(w) or contexts.get(v, ({}, 1.0))[1] * p1.get(w, unknown)
    for v in contexts:  # exactly normalised
        assert abs(sum(p(v, w) for w in uni) + p(v, None) - 1) < 1e-9
    base = lambda w: math.log10((uni[w] + 0.5) / (total + 0.5 * (len(uni) + 1)))
    return {i: (len(w) - 1, sum(x in uni for x in w[1:]), total, sum(map(base, w[1:])), sum(math.log10(p(a, b)) for a, b in zip(w, w[1:]))) for i, w in tokens.items()}


@pytest.mark.parametrize("sizes", [{}, {"tokens": 60, "keys": 100}])
def test_katz_against_brute_force(spark, sizes):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    rows = [(i, " ".join(words[i * 40 : i * 40 + 40]) if i % 9 else None, "en", "s", 1) for i in range(100)]
    want = katz_by_hand(rows)
    got = {r["doc_id"]: tuple(r)[2:] for r in katz.judge(docs(spark, rows), **sizes).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i] == pytest.approx(w, abs=1e-8)


@pytest.mark.parametrize("sizes", [{}, {"tokens": 60, "keys": 100}])
def test_katz_stored_model_scores_new_texts(spark, sizes):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(n))
    train = [(i, text(30), "en", "s", 1) for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:80]
    new = [(i, text(25) + " unseen words", "en", "s", 1) for i in range(300, 500) if zlib.crc32(str(i).encode()) % 5 == 1][:20] + [(next(i for i in range(600, 700) if zlib.crc32(str(i).encode()) % 5 == 1), None, "en", "s", 1)]
    found = common.written(katz.blocks(docs(spark, train).select("doc_id", "text", F.lit(False).alias("held_out")), **({"tokens": sizes["tokens"]} if sizes else {})), "blocks")
    _, ngrams, held, n, known = katz.fit(found, **({"keys": sizes["keys"]} if sizes else {}))
    want = katz_by_hand(train + new)
    for rows in (new, train):
        got = {r["doc_id"]: r for r in katz.score_texts(docs(spark, rows), ngrams, held, known, n, **({"tokens": 50} if sizes else {})).collect()}
        assert got.keys() == {r[0] for r in rows}
        for i, r in got.items():
            assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == pytest.approx((want[i][0], want[i][1], want[i][3], want[i][4]), abs=1e-8)
    assert katz.score_texts(docs(spark, EMPTY), ngrams, held, known, n).count() == 0


def test_katz_once_seen_bigrams_count(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1][:30]
    rows = [(i, f"u{i} v{i} " + "common words here", "en", "s", 1) for i in ids]
    got = {r["doc_id"]: r["score"] for r in katz.judge(docs(spark, rows)).collect()}
    texts = {i: [katz.BEGIN, *t.encode().split(), katz.END] for i, t, *_ in rows}
    uni = collections.Counter(x for w in texts.values() for x in w[1:])
    bi = collections.Counter(p for w in texts.values() for p in zip(w, w[1:]))
    context = uni + collections.Counter({katz.BEGIN: len(rows)})
    d = katz.discounts(collections.Counter(bi.values()))
    cut = lambda c: c * d[c - 1] if c <= katz.K else c
    # Every bigram of these texts was seen, and each context's seen bigrams leave something: the discounted shares alone.
    extra = {v: sum(c for (x, _), c in bi.items() if x == v) - sum(cut(c) for (x, _), c in bi.items() if x == v) < 1e-9 * context[v] for v in context}
    for i, w in texts.items():
        assert got[i] == pytest.approx(sum(math.log10(cut(bi[p]) / (context[p[0]] + extra[p[0]])) for p in zip(w, w[1:])), abs=1e-8)


def test_katz_odd_cases(spark):
    assert katz.judge(docs(spark, EMPTY)).count() == 0
    got = {r["doc_id"]: r for r in katz.judge(docs(spark)).collect()}
    assert got[3]["n_tokens"] == 1 and got[2]["n_tokens"] == 1
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    alone = katz.judge(docs(spark, [(held, "a b", "en", "s", 1)])).first()
    assert alone["train_tokens"] == 0 and alone["score"] == 0 and alone["n_known"] == 0


# URL rules


@pytest.mark.parametrize("in_plan", [url_rules.IN_PLAN, 0])
def test_url_parts_and_stated_rules(spark, monkeypatch, in_plan):
    monkeypatch.setattr(url_rules, "IN_PLAN", in_plan)
    urls = ["https://A.Example.com/en/7?x#y", "http://example.com/en/", "x://b.example.net/de/81", "http://net/de/", "http://notorg/es/", "http://ORG/es/1", "no url", None, "http://example.com", "a://?q", "http://x.com/EN/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, block boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, none).collect()}
    assert got == {
        0: ("a.example.com", "/en/7", "example.com/en/7", "allow"), 1: ("example.com", "/en/", "com/en/", "block"), 2: ("b.example.net", "/de/81", "example.net/de/8", "block"),
        3: ("net", "/de/", "net/de/", "allow"), 4: ("notorg", "/es/", None, "allow"), 5: ("org", "/es/1", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"),
        8: ("example.com", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("x.com", "/EN/", None, "allow"),
    }


def test_mined_rules(spark):
    rows = [(f"http://ads.site{i % 5}.example/promo/{i}", True) for i in range(40)] + [(f"http://www.site{i % 5}.example/news/{i}", i % 10 == 0) for i in range(60)]
    labelled = spark.createDataFrame(rows + [(None, True)], "url string, block boolean")
    items = labelled.select(url_rules.tokens(F.col("url")).alias("items"), "block")
    mined = {v for r in url_rules.mine(items, 0.05).collect() for v in itertools.product(*r["choices"])}
    assert ("host:ads",) in mined and ("path:promo",) in mined and ("host:ads", "path:promo") not in mined
    pages = spark.createDataFrame([(1, "http://ads.new.example/x/9"), (2, "http://www.new.example/x/9"), (2, "http://www.new.example/x/9")], "page_id long, url string")
    assert sorted((r["page_id"], r["verdict"]) for r in url_rules.judge(pages, labelled, support=0.05).collect()) == [(1, "block"), (2, "allow"), (2, "allow")]
    assert url_rules.judge(pages.limit(0), labelled).count() == 0


def test_rules_of_any_length_against_brute_force(spark):
    parts = ("a", "b", "c", "d")
    rows = []
    for held in itertools.product((0, 1), repeat=4):  # only all four together mean block
        rows += [([p for p, x in zip(parts, held) if x] + ["base"], all(held))] * (20 if all(held) else 10)
    labelled = spark.createDataFrame(rows, "items array<string>, block boolean")
    want = {}
    for n in range(1, 6):
        for s in itertools.combinations(sorted((*parts, "base")), n):
            hit = [b for items, b in rows if set(s) <= set(items)]
            if sum(hit) >= 10 and sum(hit) / len(hit) >= 0.8 and not any(set(x) < set(s) and c >= sum(hit) / len(hit) for x, c in want.items()):
                want[s] = sum(hit) / len(hit)
    assert want == {parts: 1.0}
    assert {tuple(r["items"]): r["confidence"] for r in url_rules.mine(labelled).collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_on_random_baskets_against_brute_force(spark, seed):
    """Tokens that come together, on all or on some pages; a rule's variants are its choices."""
    rng = random.Random(seed)
    rows = []
    for _ in range(70):
        held = {c for c in "abcde" if rng.random() < 0.5}
        held |= {"a2", "a3"} if "a" in held else set()
        held |= {"b2"} if "b" in held and rng.random() < 0.9 else set()
        rows.append((sorted(held), rng.random() < (0.95 if {"a", "b"} <= held else 0.3 if "c" in held else 0.1)))
    rows += [([], True), ([], False), (["rare"], True)]
    want = {}
    for n in range(1, 9):
        for s in itertools.combinations(sorted({t for items, _ in rows for t in items}), n):
            hit = [b for items, b in rows if set(s) <= set(items)]
            if sum(hit) >= 5 and sum(hit) / len(hit) >= 0.7 and not any(set(x) < set(s) and c >= sum(hit) / len(hit) for x, c in want.items()):
                want[s] = sum(hit) / len(hit)
    got = url_rules.mine(spark.createDataFrame(rows, "items array<string>, block boolean"), 0.0, 5, 0.7).collect()
    assert {tuple(sorted(v)): r["confidence"] for r in got for v in itertools.product(*r["choices"])} == want and want


def test_repeated_long_urls_are_mined_at_once(spark):
    long = "http://" + ".".join(f"h{c}" for c in "abcdefghijklmno") + "/" + "/".join(f"p{c}" for c in "abcdefghijklmno")
    rows = [(f"{long}/{i % 7}", True) for i in range(40)] + [(f"http://other.example/x{i}", False) for i in range(60)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(1, f"{long}/99"), (2, "http://other.example/y"), (3, "http://hc.elsewhere/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labelled).collect()} == {1: "block", 2: "allow", 3: "block"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, data, name):
    same(registry.queries()[name](spark, data), registry.oracle_sql()[name], data)


# pipeline


def test_pipeline(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "packing"]
    all_ = spark.read.parquet(f"{data}/documents.parquet")
    kept = all_
    for _, f in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, f(spark, kept, data)
        assert kept.columns == all_.columns and kept.join(before, "doc_id", "left_anti").count() == 0
    got = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}
    texts = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert all(c == i for i, (_, c) in by_pairs(texts, 5, 80).items())


def test_pipeline_odd_cases(spark, tmp_path):
    rng = random.Random(14)
    words = [f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, prose(90), "en", "s", 1) for i in range(30)] + [(40, prose(12000), "en", "s", 1), (None, prose(90), "en", "s", 1), (None, None, None, None, None), (50, "", "", "", 0)]
    rows += [(60, rows[0][1], "en", "t", 1), (0, *rows[0][1:])]
    df = docs(spark, rows).withColumn("length", F.lit(1)).withColumn("window", F.lit(1)).withColumn("toxic", F.lit(1))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {int(i) for i in got["doc_id"].dropna()} == {*range(30), 40} and got["doc_id"].isna().sum() == 1
    assert (got["doc_id"] == 40).sum() == len({w for i, w in zip(got["doc_id"], got["window"]) if i == 40}) > 1
    (tmp_path / "none").mkdir()
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
