import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, bank, evidence, identity, leakage, reconcile, rules, scoring
from quern.sources import banks, stores

ITEM = f"id string, stem string, options {banks.OPTIONS}, answer string, quality_flags array<string>, source_urls array<string>, subject string, source_type string, has_answer boolean, topic_tags array<string>, difficulty string, bank_rank int, pos long"


def item(i="q1", stem="What is it", texts=("one", "two", "three", "four"), answer="A", flags=(), urls=("https://a.b",), subject="1", kind="main_bank", keys="ABCD", tags=(), difficulty="easy", pos=0, rank=0):
    return (i, stem, [(k, t) for k, t in zip(keys, texts)], answer, list(flags), list(urls), subject, kind, answer is not None, list(tags), difficulty, rank, pos)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    "changed, rule",
    [
        ({}, []),
        ({"texts": ("one", "two", "three")}, ["options_shape"]),
        ({"keys": "ABBC"}, ["options_shape"]),
        ({"keys": "BACD"}, ["options_shape"]),
        ({"answer": "Z"}, ["answer_not_in_options"]),
        ({"answer": None}, ["missing_answer"]),
        ({"answer": None, "flags": ["ambiguous"]}, []),
        ({"flags": ["ambiguous"]}, ["ambiguous_must_have_no_answer"]),
        ({"stem": "a\rb"}, ["embedded_newline"]),
        ({"stem": "Page 3 of 10"}, ["pdf_furniture"]),
        ({"stem": "12. What"}, ["source_site_residue"]),
        ({"stem": " "}, ["empty_stem"]),
        ({"texts": ("one", "", "three", "four")}, ["empty_option"]),
        ({"urls": ["ftp://x"]}, ["source_not_url"]),
        ({"flags": ["time_sensitive"], "urls": []}, ["time_sensitive_without_source"]),
        ({"answer": "Z", "stem": "", "urls": ["x"]}, ["answer_not_in_options", "empty_stem", "source_not_url"]),
    ],
)
def test_structure_rules(spark, changed, rule):
    found = rules.check_items(items(spark, item(**changed)))
    assert sorted(r["rule"] for r in found.collect()) == rule


def test_flag_rules(spark):
    schema = "id string, flags array<string>, has_primary boolean, valid_as_of string, prior_answer string"
    rows = [("ok", ["time_sensitive"], True, "2024-01-01", None), ("typo", ["time_sensitve"], None, None, None), ("secondary", ["time_sensitive"], False, "2024-01-01", None), ("undated", ["time_sensitive"], True, "", None), ("dated", [], None, "2024-01-01", None), ("changed", None, None, None, "B"), ("settled", [], None, None, "B")]
    got = rules.check_flags(spark.createDataFrame(rows, schema), spark.createDataFrame([("settled",)], "id string"))
    assert {(r["id"], r["rule"]) for r in got.collect()} == {("typo", "unknown_flag"), ("secondary", "time_sensitive_without_primary_source"), ("undated", "time_sensitive_without_valid_as_of"), ("dated", "valid_as_of_without_time_sensitive"), ("changed", "corrected_but_unwatched")}


def test_gate(spark):
    none = rules.check_items(items(spark))
    assert rules.gate(items(spark), none).first()["passed"] is False
    good = items(spark, item())
    assert rules.gate(good, rules.check_items(good)).first()["passed"] is True
    rules.enforce(rules.check_items(good))
    with pytest.raises(ValueError, match="and 2 more"):
        rules.enforce(rules.check_items(items(spark, *(item(f"q{i:02}", answer="Z") for i in range(12)))))


def test_pool_rules(spark):
    rows = spark.createDataFrame([("a", "s", [("A", "x"), ("B", "y"), ("C", "z"), ("D", "w")], "A", None, None, None, "easy", ("ai_generated", None, None, "AMBIGUOUS", None), [], ["unmapped_subject"], None)], banks.POOL)
    got = {r["rule"] for r in rules.check_pool(rows).collect()}
    assert got == {"flag_domain", "ambiguous_verdict_without_flag", "ambiguous_verdict_with_answer", "ai_without_metadata"}


def test_other_gates(spark):
    calc = spark.createDataFrame([("q1", "15", ["1,000", "3"]), ("gone", "1", []), ("q2", "7", ["8"])], "id string, expected string, inputs array<string>")
    data = items(spark, item("q1", "1,000 over 3", ("15 kg", "2", "3", "4")), item("q2", "none"))
    assert {(r["id"], r["rule"]) for r in rules.check_calculations(data, calc).collect()} == {("gone", "unknown_id"), ("q2", "other_answer"), ("q2", "input_missing")}
    pins = spark.createDataFrame([("q1", "A"), ("q2", "B"), ("q3", "C")], "id string, answer string")
    assert {(r["id"], r["rule"]) for r in rules.check_unchanged(data, pins, "id", "answer").collect()} == {("q2", "pin_changed"), ("q3", "pin_missing")}
    facts = spark.createDataFrame([("f", "(?i)over 3", "never"), ("g", "absent thing", "(?i)15 kg")], "fact string, support string, contradiction string")
    with_text = data.withColumn("explanation", F.lit(None).cast("string"))
    assert {tuple(r) for r in rules.check_facts(with_text, facts).collect()} == {("g", "unsupported", "no supporter"), ("g", "contradicted", "q1")}
    swapped = items(spark, item("q1", "1,000 over 3", ("2", "15 kg", "3", "4"), answer="B"), item("q2", "none", answer="C"))
    assert {(r["id"], r["rule"]) for r in rules.check_reorder(data, swapped).collect()} == {("q2", "answer_changed")}
    assert {(r["id"], r["rule"], r["detail"]) for r in rules.check_reorder(data.where("id = 'q1'"), data.where("id = 'q2'")).collect()} == {("q1", "one_sided", "removed"), ("q2", "one_sided", "added")}
    meta = spark.createDataFrame([("a", {"verified_by_human": "x"}), ("b", {"ok": "x"}), ("c", None)], "id string, metadata map<string,string>")
    assert ids(rules.check_metadata(meta)) == ["a"]


def test_query_layer(spark):
    df = items(spark, item("a", "Carbon price 100%", pos=0), item("b", "carbon  price: 100%!", texts=("two", "ONE", "four", "three"), pos=1), item("c", "Other", answer=None, flags=["ambiguous"], subject=None, pos=2), item("d", "carbon tax", subject="2", flags=["unmapped_subject"], kind="ai_generated", tags=["Carbon Market"], pos=3))
    assert ids(bank.dedupe(df)) == ["a", "c", "d"]
    assert ids(bank.search(df, " CARBON ")) == ["a", "b", "d"] and ids(bank.search(df, "  ")) == [] and ids(bank.search(df, "100%")) == ["a", "b"]
    assert ids(bank.pool_filter(df, subjects=[None, "2"])) == ["c", "d"] and ids(bank.pool_filter(df, subjects=[])) == []
    assert ids(bank.pool_filter(df, tags=["carbon-market"])) == ["d"] and ids(bank.pool_filter(df, exclude_flags=["ambiguous"])) == ["a", "b", "d"]
    assert ids(bank.admissible(df, "2")) == [] and ids(bank.admissible(df)) == ["a", "b", "c", "d"]
    assert len(ids(bank.draw(df, 10, answerable=True, seed=3))) == 2 and bank.draw(df, 1, seed=3).collect() == bank.draw(df.repartition(5), 1, seed=3).collect()
    assert [r["id"] for r in bank.draw(df, 2, shuffled=False).collect()] == ["a", "c"]
    assert [(r["id"], r["score"]) for r in bank.similar(df, "a").collect()] == [("b", 4)]
    assert [(r["id"], r["score"]) for r in retrieval.similar_to(df, spark.createDataFrame([("b",)], "id string")).collect()] == [("a", 4), ("d", 1)]


def test_scoring(spark):
    schema = "session_id string, question_id string, selected_answer string, correct_answer string, is_correct boolean, time_spent long, timestamp long, source_category string, seq long"
    a = spark.createDataFrame([("s", "1", "A", "B", False, 5, 1, None, 0), ("s", "1", "B", "B", True, 7, 9, None, 3), ("s", "2", None, "C", False, 1, 3, "ai_generated", 1), ("s", "3", "A", None, None, 1, 4, "x", 2)], schema)
    last = scoring.latest_answers(a)
    assert {(r["question_id"], r["selected_answer"], r["seq"]) for r in last.collect()} == {("1", "B", 0), ("2", None, 1), ("3", "A", 2)}
    asked = spark.createDataFrame([("s", str(i), i != 3) for i in range(1, 5)] + [("t", "1", False)], "session_id string, question_id string, has_answer boolean")
    got = {r["session_id"]: r.asDict() for r in scoring.session_scores(last, asked).collect()}
    assert got["s"] | {"session_id": 0} == {"session_id": 0, "correct": 1, "wrong": 1, "answerable": 3, "skipped": 1, "score": 33, "total_time": 9}
    assert got["t"]["score"] == 0 and got["t"]["skipped"] == 1
    assert [tuple(r) for r in scoring.breakdown(last).collect()] == [("main_bank", 1, 1, 100, False), ("ai_generated", 1, 0, 0, True)]
    assert [tuple(r) for r in scoring.attempts(last).collect()] == [("1", 1, 1, 9)]
    stats = spark.createDataFrame([("a", 4, 1, 5), ("b", 8, 2, 1), ("c", 4, 1, 6), ("d", 2, 0, 1), ("e", 4, 2, 1)], "id string, attempts long, correct long, last_tried_at long")
    assert [r["id"] for r in scoring.weakest(stats).collect()] == ["b", "c", "a"]
    assert ids(scoring.weakest_named(stats, spark.createDataFrame([("c", "x"), ("zz", "y")], "id string, stem string"), limit=2)) == ["c"]
    saved = spark.createDataFrame([("s", i, q, 1) for i, q in enumerate("abc")], "session_id string, pos long, question_id string, current long")
    left = lambda *q: {(r["question_id"], r["new_pos"], r["new_current"]) for r in scoring.resumed(saved, spark.createDataFrame([(x,) for x in q], "id string")).collect()}
    assert left("b", "c") == {("b", 0, 0), ("c", 1, 0)} and left("a") == {("a", 0, 0)}


def test_stores(spark):
    good = '{"version":1,"items":{"q":{"attempts":2,"correct":1,"lastTriedAt":5}}}'
    bad = ['{"version":2,"items":{}}', "nonsense", '{"version":1,"items":{"q":{"attempts":1,"correct":2,"lastTriedAt":5},"r":{"attempts":1,"correct":1,"lastTriedAt":5}}}', None]
    blobs = spark.createDataFrame([("x", good), *((f"b{i}", b) for i, b in enumerate(bad))], "owner string, json string")
    stats = stores.load_stats(blobs)
    assert [tuple(r) for r in stats.collect()] == [("x", "q", 2, 1, 5)]
    assert stores.dump_stats(stats).first()["json"] == good
    p = lambda j: spark.createDataFrame([(j,)], "j string").select(stores.progress(F.col("j")).alias("p")).first()["p"]
    active = '{"version":1,"savedAt":5,"state":{"isActive":true,"startTime":1,"config":{"n":"1"},"currentIndex":%s,"questions":["a"],"answers":[]}}'
    assert p(active % 0) is not None and p(active % 1) is None and p(active % -1) is None and p("x") is None
    assert all(p((active % 0).replace(a, b)) is None for a, b in (('"savedAt":5,', ""), ('"version":1', '"version":2'), ('"isActive":true,', ""), ('"startTime":1,', ""), ('"config":{"n":"1"},', ""), (',"answers":[]', "")))
    assert p('{"version":1,"savedAt":5,"state":{"isActive":false,"currentIndex":0,"questions":[],"answers":[]}}') is not None
    old = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "owner string, json string")
    sessions = spark.createDataFrame([("a", 1, (True,)), ("b", 1, (False,)), ("c", 1, None), ("d", 1, (True,))], "owner string, saved_at long, state struct<isActive: boolean>")
    assert {r["owner"]: r["json"] for r in stores.saved_progress(old, sessions).collect()} == {"a": '{"version":1,"savedAt":1,"state":{"isActive":true}}', "b": "old", "d": '{"version":1,"savedAt":1,"state":{"isActive":true}}'}


def test_identity(spark):
    main = items(spark, item("m1", "Same stem", pos=0), item("m2", "same stem", pos=1), item("m3", "at 5 pay 20", ("100", "1", "2", "3"), pos=2))
    pool = items(spark, item("p1", "SAME STEM!", ("four", "three", "two", "one")), item("p2", "20 paid for each of 5", ("3", "2", "1", "100")), item("p3", "unlike"))
    assert [tuple(r) for r in identity.same_content(pool, main).collect()] == [("p1", "m2")]
    assert [tuple(r) for r in identity.same_calculation(pool, main).collect()] == [("p2", "m3")]
    twin = items(spark, item("a", "x"), item("b", "X!", answer="B"), item("c", "x", answer="B"))
    assert {(r["id"], r["n"]) for r in identity.conflicting(twin).collect()} == {("a", 1), ("b", 2)}
    pair = lambda *p: identity.conflicting(twin, spark.createDataFrame([p], "id_a string, id_b string")).count()
    assert pair("a", "c") == 0 and pair("b", "c") == 2 and pair("a", "zz") == 2
    assert {tuple(r) for r in identity.equal_options(items(spark, item("a", "x", ("1,000", "1000", "2", "b"))) ).collect()} == {("a", "text"), ("a", "value")}
    old = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", 2), (2, "b", None), (4, "d", 4)], "k int, x string, y int")
    assert {tuple(r) for r in identity.field_diff(old, new, ["k"]).collect()} == {(1, "y", "1", "2"), (3, "*", "removed", None), (4, "*", None, "added")}
    have = spark.createDataFrame([("s", 1), ("s", 3)], "src string, no int")
    assert [tuple(r) for r in identity.missing_numbers(have, "src", "no", spark.createDataFrame([("s", 4)], "src string, total int")).orderBy("no").collect()] == [("s", 2), ("s", 4)]


def test_evidence(spark):
    rows = spark.createDataFrame([("m", "1", ["https://gov.x/a", "https://blog.y"], [("https://gov.x/a", "text")]), ("m", "2", ["https://gov.x/b"], [("https://gov.x/b", " "), ("https://blog.y", "t")])], "bank string, qid string, urls array<string>, evidence array<struct<url: string, quote: string>>")
    m = evidence.evidence_manifest(rows, spark.createDataFrame([("gov.x", "primary")], "host string, tier string"))
    assert {(r["qid"], r["authority"], r["has_quote"], r["tier1"]) for r in m.collect()} == {("1", "primary", True, True), ("1", "unknown", False, False), ("2", "primary", False, False)}
    assert {(r["authority"], r["urls"], r["tier1_questions"]) for r in evidence.tier_summary(m).collect()} == {("primary", 2, 1), ("unknown", 1, 1)}
    docs = spark.createDataFrame([("README", "There are 1,234 items")], "path string, text string")
    claims = banks.claims_in(docs, {"items": r"are ([0-9,]+) items", "pages": r"([0-9]+) pages"})
    metrics = spark.createDataFrame([("items", 1234), ("pages", 3)], "name string, n long")
    assert {(r["name"], r["status"]) for r in evidence.claim_diffs(claims, metrics).collect()} == {("items", "ok"), ("pages", "dead")}
    seen = spark.createDataFrame([("2024-05-01",), ("2023-01-01",), (None,)], "reviewed_on string")
    assert tuple(evidence.coverage(seen, "2024-01-01").first()) == (3, 1, 1, 2)


def test_leakage(spark):
    df = items(spark, item("a", "x", ("long one", "b", "c", "d")), item("b", "x", ("aa", "bb", "c", "d"), answer="B"), item("c", "x", ("a", "b" * 60, "c", "d"), answer="B"), item("d", "x", answer=None))
    assert tuple(leakage.longest_option_score(df).first())[1:] == (2, 3, 2 / 3)
    assert ids(leakage.blatant_tells(df)) == ["c"]
    assert ids(leakage.blatant_tells(items(spark, item("e", "x", ("a", "b" * 60, "c"), answer="B")))) == []
    assert tuple(leakage.position_chi2(df).first()) == (3, 4 / 3 * ((1 - .75) ** 2 + (2 - .75) ** 2 + 2 * .75 ** 2), 2 / 3)
    ladder = lambda *t: items(spark, item("a", "x", t)).select(leakage.sorted_ladder(F.col("options")).alias("x")).first()["x"]
    assert ladder("1 kg", "2", "3", "40") is True and ladder("4", "3", "2", "1") is True and ladder("1", "3", "2", "4") is False and ladder("1", "b", "2", "4") is None


def test_best_match_loses_nothing(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(11)
    left = ["ab1cd", "ab", "abcd", "a1bc2de3f", "", "x", "日本語"] + ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    right = ["ab2cd", "abc", "abXcd", "abcdef", "", "x", "日本語1"] + ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(40)]
    src = spark.createDataFrame(list(enumerate(left)), "source_no int, stem string")
    data = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(right)], "id string, stem string, pos long")
    for threshold in (0.5, 0.8):
        want = {}
        for n, a in enumerate(left):
            ratio, pos = max((SequenceMatcher(None, a, b).ratio(), -i) for i, b in enumerate(right))
            if ratio >= threshold:
                want[n] = (str(-pos), ratio)
        assert {r["source_no"]: (r["id"], r["similarity"]) for r in reconcile.best_match(src, data, threshold).collect()} == want
    assert reconcile.best_match(src.where("source_no < 3"), data).count() == 3


def test_best_match_of_long_and_hot_stems(spark):
    """A beginning that all share, repeated stems, and edits; against all pairs."""
    import random
    from difflib import SequenceMatcher

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    right = [f"the question of the exam is about {word()} and {word()}" for _ in range(40)] + ["the question of the exam is about"] * 30 + [None]
    left = [t.replace("exam", "test") if i % 2 else t + " now" for i, t in enumerate(right[:40])] + ["the question of the exam is about"] * 20 + [None, "aaaaaaaaaaaa", "xy"]
    right += ["aaaaaaaaaaaaa", "yx", "xy"]
    src = spark.createDataFrame(list(enumerate(left)), "source_no int, stem string")
    data = spark.createDataFrame([(str(i), t, i) for i, t in enumerate(right)], "id string, stem string, pos long")
    want = {}
    for n, a in enumerate(left):
        if a is not None:
            ratio, pos = max((SequenceMatcher(None, a, b).ratio(), -i) for i, b in enumerate(right) if b is not None)
            if ratio >= 0.85:
                want[n] = (str(-pos), ratio)
    assert {r["source_no"]: (r["id"], r["similarity"]) for r in reconcile.best_match(src, data, 0.85).collect()} == want and len(want) > 50


def test_common_grams_hardly_take_part(spark):
    """A thousand stems with one beginning and rare ends: their pairs would be a million."""
    import random

    rng = random.Random(13)
    stems = spark.createDataFrame([(i, "the common beginning " + "".join(chr(rng.randrange(0x4E00, 0x6E00)) for _ in range(20))) for i in range(1000)], "key long, stem string")
    assert reconcile._candidates(stems, stems, 0.9).count() < 2000


def test_reconcile(spark):
    src = spark.createDataFrame([(1, "the emission factor of coal"), (2, "unrelated words here")], "source_no int, stem string")
    data = spark.createDataFrame([("a", "the emission factor of cole", 0), ("b", "a tax", 1)], "id string, stem string, pos long")
    assert [(r["source_no"], r["id"]) for r in reconcile.best_match(src, data).collect()] == [(1, "a")]
    scores = spark.createDataFrame([("x", "A", .9), ("x", "B", .85), ("y", "A", .9), ("y", "B", .2), ("z", "A", .5)], "q string, candidate string, score double")
    assert {(r["q"], r["candidate"]) for r in reconcile.decided_by_margin(scores, ["q"]).collect()} == {("x", None), ("y", "A"), ("z", None)}
    pair = spark.createDataFrame([("q", [("A", "coal"), ("B", "wind")], [("A", "winds"), ("B", "charcoal")])], "id string, left array<struct<key: string, text: string>>, right array<struct<key: string, text: string>>")
    assert {(r["left_key"], r["right_key"]) for r in reconcile.assigned_options(pair).collect()} == {("A", "B"), ("B", "A")}
    tied = spark.createDataFrame([("q", [("A", "x"), ("B", "x")], [("C", "x"), ("D", "x"), ("E", "y")]), ("none", [], [("A", "x")])], pair.schema)
    assert [tuple(r) for r in reconcile.assigned_options(tied).collect()] == [("q", "B", "D", 1.0), ("q", "A", "C", 1.0)]
    v = lambda *a: spark.range(1).select(reconcile.key_verdict(*map(F.lit, a)).alias("v")).first()["v"]
    assert [v(False, "A", True, 1.0, "A", "A", False), v(True, "A", False, 1.0, "A", "A", False), v(True, "A", True, .1, "A", "A", False), v(True, "A", True, 1.0, "A", "A", False), v(True, "A", True, 1.0, "B", "B", True), v(True, "A", True, 1.0, "B", "B", False)] == ["FETCH_FAIL", "NOT_FOUND", "NOT_SAMPLE_Q", "AGREE", "DOCUMENTED_OVERRIDE", "MISMATCH"]
    pages = spark.createDataFrame([("u", "xxwhatisthefactorofcoalxx")], "url string, text string")
    qs = spark.createDataFrame([("q", "whatisthefactorofcoal"), ("r", "short"), ("s", "somethingelse")], "id string, stem string")
    assert ids(reconcile.pages_with(qs, pages)) == ["q"]
    cards = spark.createDataFrame([("u", "1. (B) text\n2 C\nAnswer 3: d")], "url string, text string")
    assert {(r["number"], r["letter"].upper()) for r in reconcile.key_letters(cards).collect()} == {(1, "B"), (2, "C"), (3, "D")}


def test_sources(spark, tmp_path):
    (tmp_path / "bank.json").write_text('{"items": [{"index": 4, "stem": "s", "options": [{"key": "A", "text": "t"}], "answer": "A", "source": "gist", "exam_subject": "1", "metadata": {"sources": ["https://a.b", "x", "https://a.b"]}}]}')
    a = banks.from_variant_a(banks.read_items(spark, str(tmp_path / "bank.json"), "items", banks.VARIANT_A))
    pool = banks.from_pool(spark.createDataFrame([("p", "s", [], None, "why", "科目12", [], None, None, ["ftp://x"], None, None), ("q", "s", [], "A", None, None, [], None, None, None, None, None)], banks.POOL))
    rows = {r["id"]: r for r in banks.union(a, pool).collect()} if "pos" in pool.columns else {r["id"]: r for r in banks.union(a.drop("pos"), pool).collect()}
    assert rows["gist-4"]["sources"] == ["https://a.b"] and rows["gist-4"]["source_type"] == "gist" and rows["p"]["sources"] is None
    assert rows["p"]["subject"] == "subject 1" and rows["q"]["subject"] == "subject 2" and rows["q"]["quality_flags"] == ["unmapped_subject"]
    html = '<p>A &amp; b</p><script>var t="</p>"</script>'
    assert " ".join(spark.range(1).select(banks.html_text(F.lit(html)).alias("t")).first()["t"].split()) == "A & b"
    law = spark.createDataFrame([("L", "Act", '<title>Act</title><a name="10"></a><pre>ten x</pre><a name="2"></a><pre>two</pre>')], "code string, expected string, html string")
    assert [(r["article_no"], r["text"]) for r in banks.law_articles(law).collect()] == [("2", "two"), ("10", "tenx")]
    with pytest.raises(Exception, match="another law"):
        banks.law_articles(law.withColumn("expected", F.lit("Other"))).collect()
    words = [("d", 1, float(x), float(y), t) for x, y, t in ((10, 5, "HEAD"), (10, 50, "1."), (30, 50.4, "What"), (10, 62, "(A)"), (30, 62, "one"), (10, 74, "(B)"), (30, 74, "two"), (300, 50, "2."), (320, 50, "Why"))]
    lines = banks.laid_out_lines(spark.createDataFrame(words, "document string, page int, x0 double, top double, text string"), 292, 40, 800)
    got = {r["number"]: (r["stem"], [tuple(o) for o in r["options"]]) for r in banks.numbered_items(lines).collect()}
    assert got == {1: ("What", [("A", "one"), ("B", "two")]), 2: ("Why", [])}


def test_quote_splice_against_all_pairs(spark, data):
    from quern.functions import text
    from quern.plans import catalog

    quotes = {r["item_id"]: r["q"] for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", text.quote_form(F.col("text")).alias("q")).collect()}
    pages = {r["doc_id"]: r["p"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", text.quote_form(F.col("text")).alias("p")).collect()}
    want = {(i, d, "verbatim" if q in p else "reordered") for i, q in quotes.items() for d, p in pages.items() if q and (q in p or text.spliced(q, p))}
    assert {tuple(r) for r in catalog.queries()["quote_splice"](spark, data).collect()} == want and want


def test_metadata_names_what_it_is(spark):
    rows = [("a", {"answer_verified": "true", "confidence": "high", "x": "1"}), ("b", {"verification_source": " research_agent "}), ("c", {"verification_source": "said so"}), ("d", {"verification_source": "ISO 14067"}), ("e", None), ("f", {"verification_source": " "})]
    df = spark.createDataFrame(rows, "id string, metadata map<string,string>")
    got = {(r["id"], r["rule"], r["detail"]) for r in rules.check_honesty(df, "ISO|Art").collect()}
    assert got == {("a", "banned_field", "answer_verified,confidence"), ("b", "no_source", "research_agent"), ("c", "not_a_citation", "said so")}
    assert {(r["id"], r["rule"]) for r in rules.check_honesty(df.where("id = 'e'"), "ISO").collect()} == {("*", "no_metadata"), ("*", "no_sources")}


def test_replaced_options_say_why(spark):
    now, old, why = [("A", "x"), ("B", "y")], [("A", "p"), ("B", "y")], "the options were copied from another question altogether"
    rows = [("a", now, None), ("b", now, ("2026-07-19", old, "A", "https://gov/1", why)), ("c", now, ("19.7.2026", [], None, "https://blog/1", "short")), ("d", now, (None, None, "A", None, why)), ("e", now, ("2026-07-19", now, "A", "https://gov/1", why))]
    df = spark.createDataFrame(rows, f"id string, options {banks.OPTIONS}, replaced struct<on: string, prior_options: {banks.OPTIONS}, prior_answer: string, source_url: string, why: string>")
    got = {(r["id"], r["rule"]) for r in rules.check_replaced(df, F.contains("replaced.source_url", F.lit("gov"))).collect()}
    assert got == {("c", "replaced_without_date"), ("c", "replaced_without_reason"), ("c", "replaced_by_other_than_primary"), ("c", "replaced_without_prior_options"), ("c", "replaced_without_prior_answer"),
                   ("d", "replaced_without_date"), ("d", "replaced_without_source"), ("d", "replaced_without_prior_options"), ("e", "replaced_by_the_same")}


def test_numeric_questions_are_registered(spark):
    df = items(spark, item("a", "how many", ("60 t", "2", "3", "4")), item("b", "how much", ("1,500,000 元", "2", "3", "4")), item("c", "which", ("x", "y", "z", "w")), item("d", "when", ("1", "2", "3", "4")))
    registry = spark.createDataFrame([("a", "60", "worked", None), ("b", "1500 000", "looked_up", " "), ("x", "1", "worked", None), ("c", "q", "guessed", None)], "id string, expected string, kind string, basis string")
    got = {(r["id"], r["rule"]) for r in rules.check_numeric_registry(df, registry, F.regexp_like(F.col("options")[1]["text"], F.lit("[0-9]"))).collect()}
    assert got == {("b", "no_basis"), ("x", "unknown_id"), ("c", "other_answer"), ("c", "unknown_kind"), ("d", "unregistered")}


def test_containment(spark):
    probes = spark.createDataFrame([(i, f"w{i} x y z") for i in range(4)] + [(9, "")], "probe_id int, text string")
    pages = spark.createDataFrame([(1, "a w1 x y z b"), (2, "w2 x y"), (3, "w3 x y z"), (4, None)], "page_id int, text string")
    for most in (1, 100):
        assert sorted(map(tuple, bank.containment(probes, pages, most).collect())) == [(1, 1), (3, 3)]


def test_results_and_pool(spark, tmp_path):
    (tmp_path / "r1.json").write_text('[{"id": "a", "n": 1}, {"id": "b"}]')
    (tmp_path / "r2.json").write_text("not json")
    (tmp_path / "r3.json").write_text('{"id": "c"}')
    results, bad = banks.read_results(spark, f"{tmp_path}/r*.json")
    assert sorted(r["result"] for r in results.collect()) == ['{"id":"a","n":1}', '{"id":"b"}']
    assert sorted(r["file"].rsplit("/", 1)[1] for r in bad.collect()) == ["r2.json", "r3.json"]
    reads = []
    pool = banks.Pool(lambda: reads.append(1) or spark.range(3))
    assert pool.prefetch().count() == 3 and pool.get().count() == 3 and len(reads) == 1
    pool.release()
    assert pool.get().count() == 3 and len(reads) == 2
    pool.release()


def test_assignments_are_dealt_to_all_tasks(spark):
    many = spark.range(50, numPartitions=1).select(F.col("id").cast("string").alias("id"), F.expr("array(named_struct('key', 'A', 'text', 'coal'), named_struct('key', 'B', 'text', 'wind'))").alias("left"), F.expr("array(named_struct('key', 'A', 'text', 'winds'), named_struct('key', 'B', 'text', if(id % 2 = 0, 'charcoal', 'wind')))").alias("right"))
    dealt = reconcile.assigned_options(many)
    assert {(int(r["id"]) % 2, r["left_key"], r["right_key"], round(r["similarity"], 3)) for r in dealt.collect()} == {(0, "A", "B", 0.667), (0, "B", "A", 0.889), (1, "A", "A", 0.0), (1, "B", "B", 1.0)}
    assert dealt.rdd.getNumPartitions() > 1  # a file of one part isn't the work of one task
