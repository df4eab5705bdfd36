import pytest
from pyspark.sql import functions as F

from quern.functions import scalars, text
from quern.operators import bank, identity, metrics
from quern.streaming import events

ITEMS = "bank string, id string, answer string, prior_answer string, flags array<string>, sources array<string>, primary int, evidence array<struct<url: string, quote: string, primary: boolean>>, audit string, key_checked boolean, valid_as_of string"
ROWS = [
    ("main", "a", "A", "B", ["time_sensitive"], ["u"], 1, [("u", "q", True)], "supported", True, "2026-07-14"),
    ("main", "b", "A", "A", ["time_sensitive"], [], 0, [("u", " ", True)], "citation_replaced", None, None),
    ("main", "c", None, "B", None, None, None, None, None, False, "2026-07-12"),
    ("main", "d", "", None, [], ["u"], 0, [("u", "q", False)], "no_quote", None, "2026-07-13"),
    ("pool", "e", "A", "B", ["time_sensitive"], ["u"], 2, [("u", "q", True)], "citation_disputed", True, None),
    ("pool", "f", "A", None, None, None, None, None, "dead", None, "2026-07-20"),
    ("other", "g", "A", "B", None, ["u"], 1, None, "supported", True, "2026-07-20"),
]


def test_every_metric(spark):
    got = {r["name"]: r["n"] for r in metrics.counted(spark.createDataFrame(ROWS, ITEMS), "2026-07-13").collect()}
    assert got == {
        "total": 4, "with_answer": 2, "time_sensitive": 2, "corrections": 2, "main_quote": 1, "main_primary": 1, "main_nosource": 2, "pool_total": 2, "pool_quote": 1, "pool_primary": 1,
        "corr_with_url": 1, "corr_no_url": 1, "akc_confirmed": 2, "ca_supported": 1, "ca_replaced": 1, "ca_disputed": 1, "ca_no_quote": 1, "ca_dead": 1, "ca_wrong": 2, "reverified": 2, "carried_over": 1, "not_reviewed": 2,
    }


def test_review_gate(spark):
    declared = spark.createDataFrame([("total", "R", 4), ("reverified", "R", 3), ("odd", "R", 1), ("ca_dead", "R", None)], "name string, path string, claimed long")
    got = metrics.review_gate(spark.createDataFrame(ROWS, ITEMS), declared, "2026-07-13").collect()
    assert {(r["name"], r["status"]) for r in got} == {("reverified", "wrong"), ("odd", "unknown"), ("ca_dead", "dead")}


def test_numbers_are_put_into_texts(spark):
    texts = spark.createDataFrame([("R", "12 in all, of which 1,234 items are checked (12)."), ("S", "nothing"), ("T", "of which 7 items")], "path string, text string")
    n = spark.createDataFrame([("checked", 1235), ("last", 12), ("gone", 1)], "name string, n long")
    got = {r["path"]: (r["text"], r["changed"], r["dead"]) for r in metrics.synced(texts, {"checked": r"of which ([0-9,]+) items", "last": r"\(([0-9]+)\)"}, n).collect()}
    assert got == {"R": ("12 in all, of which 1235 items are checked (12).", ["checked"], []), "S": ("nothing", [], ["checked", "last"]), "T": ("of which 1235 items", ["checked"], ["last"])}


@pytest.mark.parametrize(
    ("said", "hits"),
    [("A、D 為 Scope 1", ["A、D"]), ("前句才剛說 A 屬 Category 1", [" A", "A "]), ("故 A 為不正確之敘述", ["A "]), ("優惠費率 A 為最低", []), ("費率A是", []), ("升溫 1.5°C 是上限", []), ("故選 B", ["選 B"]), ("正確答案為（C）", ["正確答案為（C）"]), ("以 D 為最佳解", ["D "]), ("ABCD 是", []), ("CO2 是", [])],
)
def test_chinese_letter_references(spark, said, hits):
    got = spark.range(1).select(text.letter_references(F.lit(said), **text.CHINESE_LETTERS).alias("x")).first()["x"]
    assert bool(got) == bool(hits) and (not hits or any(h.strip() in g for g in got for h in hits)), got


def test_english_letter_references(spark):
    one = lambda t: spark.range(1).select(text.letter_references(F.lit(t)).alias("x")).first()["x"]
    assert one("The answer is B.") == ["answer is B"] and one("A, C are wrong")[0] == "A, C" and one("so pick D") == [" D"] and one("rate A is low") == [] and one("Cats are") == []


def test_law_quotes(spark):
    aliases = {"氣候法": "O1", "氣候變遷因應法": "O1", "碳費辦法": "O2"}
    long = "中央主管機關應擬訂國家因應氣候變遷行動綱領，報請行政院核定"
    rows = [(0, f"依氣候法及碳費辦法「{long}」"), (1, f"「{long}」"), (2, "氣候法「國家因應氣候變遷行動綱領計畫書草案全文」"), (3, "氣候法「An English sentence of some length，not a law」"), (4, "氣候法『短，句』"), (5, None), (6, f"氣候變遷因應法與氣候法『{long}』")]
    got = spark.createDataFrame(rows, "id int, t string").select("id", F.explode(text.law_quotes(F.col("t"), aliases)).alias("q")).select("id", "q.code", "q.quote").collect()
    assert sorted(map(tuple, got)) == [(0, "O1", long), (0, "O2", long), (6, "O1", long)]


def test_missing_articles(spark):
    texts = spark.createDataFrame([("a", "氣候法第十二條與氣候法 § 99"), ("b", "碳費辦法第 3 條"), ("c", None)], "id string, text string")
    corpus = spark.createDataFrame([("O1", "12"), ("O2", "1")], "code string, article string")
    assert sorted(map(tuple, identity.missing_references(texts, corpus, {"氣候法": "O1", "碳費辦法": "O2"}).collect())) == [("a", "O1", "99"), ("b", "O2", "3")]


def test_source_labels(spark):
    laws, acts, paths, sites = {"law.example.tw": {"O1": "Climate act"}}, {"eur-lex.example.eu": "EUR"}, {"code.example": [("/discussions/", "Discussion"), ("/issues/", "Issue"), ("", "Code")]}, {"iso.example": "ISO"}
    cases = {
        "https://law.example.tw/a?pcode=O1&flno=28": "Climate act §28", "https://law.example.tw/a?flno=3&pcode=X": "law §3", "https://law.example.tw/": "law", "https://eur-lex.example.eu/x?uri=CELEX%3A32018R0066": "EU Reg 2018/66", "https://eur-lex.example.eu/x?uri=32018R000": "EU Reg 2018/0",
        "https://www.eur-lex.example.eu/x": "EUR", "https://code.example/o/r/issues/4": "Issue", "https://code.example/o/r": "Code", "https://WWW.ISO.example/1": "ISO", "https://iso.example.evil.com/": "iso.example.evil.com", "https://www.other.org/x": "other.org", "no url": "no url", "": "",
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u string")
    got = {r["u"]: r["l"] for r in df.select("u", scalars.source_label(F.col("u"), sites, laws, acts, paths).alias("l")).collect()}
    assert got == {**cases, None: None}


def test_samples_and_picks(spark):
    df = spark.createDataFrame([(f"q{i}", 0, 50 - i) for i in range(20)], "id string, bank_rank int, pos long")
    order = [r["id"] for r in df.orderBy("pos").collect()]
    assert [r["id"] for r in bank.sample(df, 20).collect()] == order == [r["id"] for r in bank.sample(df, 99).collect()]
    five = [r["id"] for r in bank.sample(df, 5, 3).collect()]
    assert len(set(five)) == 5 and five == [r["id"] for r in bank.sample(df.repartition(7), 5, 3).collect()] and five != [r["id"] for r in bank.sample(df, 5, 4).collect()]
    pool = df.withColumns({"source_type": F.when(F.col("pos") % 2 == 0, "mock").otherwise("ai"), "subject": F.lit("1"), "quality_flags": F.array().cast("array<string>")})
    got = bank.pick(pool, 4, lambda d: d.select(F.upper("id").alias("x"), "source_type"), source_types=["ai"]).collect()
    assert len(got) == 4 and {r["source_type"] for r in got} == {"ai"} and all(r["x"].startswith("Q") for r in got)


def test_dispositions(spark):
    rows = spark.createDataFrame([("s", 1, "kept"), ("s", 2, "duplicate"), ("s", 3, "kept"), ("t", 1, "kept"), ("t", 1, "kept"), ("t", 9, "kept")], "source string, number int, status string")
    totals = spark.createDataFrame([("s", 3), ("t", 3), ("u", 1)], "source string, total int")
    got = {r["source"]: (r["statuses"], r["accounted"], r["missing"], r["repeated"], r["complete"]) for r in identity.disposition_summary(rows, totals).collect()}
    assert got == {"s": ({"kept": 2, "duplicate": 1}, 3, 0, 0, True), "t": ({"kept": 3}, 3, 2, 2, False), "u": ({}, 0, 1, 0, False)}


def test_feed_into_a_table(spark, tmp_path):
    feed = [(1, "a", "x"), (2, "b", "y"), (3, None, None), (5, "b", "z"), (4, "b", "late"), (6, "c", None), (7, "a", "w"), (2, "d", "before the clearing")]
    sink = events.feed_sink(spark, str(tmp_path / "f"), fan=2)
    for batch, row in enumerate(feed):
        for _ in range(2):
            sink(spark.createDataFrame([row], events.FEED), batch)
    want = sorted(map(tuple, events.latest_change(spark.createDataFrame(feed, events.FEED)).collect()), key=str)
    assert sorted(map(tuple, events.current(spark, str(tmp_path / "f")).collect()), key=str) == want == [("a", "w"), ("b", "z"), ("c", None)]
