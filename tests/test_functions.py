from pyspark.sql import functions as F

from quern.functions import scalars as s
from quern.functions import text as t


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def lit(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*texts):
    return F.array(*map(F.lit, texts))


def test_forms(spark):
    assert lit(spark, t.content_form(F.lit("Ａ-b  C_d!"), True)) == lit(spark, t.content_form(F.lit("a b—cd"), True)) == "abcd"
    assert lit(spark, t.content_form(F.lit("a × b"))) != lit(spark, t.content_form(F.lit("a ÷ b")))
    assert lit(spark, t.content_form(F.lit(None).cast("string"))) == ""
    assert lit(spark, t.quote_form(F.lit("◼ Ab, c×d "))) == "Abc×d"
    assert lit(spark, t.listed_form(F.lit("a (b)，c"), "()，")) == "abc"
    assert lit(spark, t.folded(F.lit("台北"), {"台": "臺"})) == "臺北"
    assert lit(spark, t.tag_form(F.lit(" Carbon-Market ／x"))) == "carbonmarketx"


def test_signatures(spark):
    a = t.content_signature(F.lit("What?"), arr("one", "Two"))
    assert lit(spark, a == t.content_signature(F.lit("what"), arr("two", "one")))
    assert lit(spark, t.content_signature(F.lit("Ｗhat"), arr("Ｔwo", "one"), True)) == lit(spark, a)
    c = t.calc_signature(F.lit("Burn 1,500 kg at 2.50 a kg"), arr("3,750 kg", "10 kg"))
    assert lit(spark, c) == "2.5,1500||10;3750"
    assert lit(spark, t.calc_signature(F.lit("2.5 for each of 1500"), arr("10", "3750"))) == lit(spark, c)
    assert lit(spark, t.calc_signature(F.lit("1 and 2"), arr("year 2024 law", "3"))) is None
    assert lit(spark, t.option_value(F.lit("(30,000 − 25,000) × 300 × 1"))) == lit(spark, t.option_value(F.lit("1,500,000"))) == 1.5e6
    assert lit(spark, t.option_value(F.lit("1 or 2"))) is None


def test_prefix(spark):
    assert lit(spark, t.redundant_prefix(F.lit("the scope is"), arr("scope: one", "scope: two"))) == "scope"
    assert lit(spark, t.redundant_prefix(F.lit("the scope is"), arr("scope", "scope two"))) is None
    assert lit(spark, t.redundant_prefix(F.lit("nothing"), arr("scope: one", "scope: two"))) is None


def test_lines(spark):
    assert lit(spark, t.joined_lines(F.lit("碳排\n放 and\nmore"))) == "碳排放 and more"


def test_references(spark):
    assert lit(spark, F.size(t.letter_references(F.lit("The answer is B, while C is wrong; see A, B and more")))) == 3
    assert lit(spark, F.size(t.letter_references(F.lit("Vitamin C, 25°C and ABC")))) == 0
    assert lit(spark, t.letters_agree(F.lit("answer: B"), F.lit("B"))) is True
    assert lit(spark, t.letters_agree(F.lit("answer: B, answer: C"), F.lit("B"))) is False
    assert lit(spark, t.letters_agree(F.lit("none"), F.lit("B"))) is None
    assert lit(spark, t.has_bracket_citation(F.lit("so [1, 2]"))) and not lit(spark, t.has_bracket_citation(F.lit("[a]")))
    assert lit(spark, t.undeclared_urls(F.lit("see https://a.b/c and http://x.y"), arr("http://x.y"))) == ["https://a.b/c"]


def test_claims(spark):
    got = lit(spark, t.unsupported_claims(F.lit("It grew 12% in 2019, Section 9"), arr("12 percent", "in 2019")))
    assert [(g["kind"], g["claim"]) for g in got] == [("section", "Section9")]


def test_confidence(spark):
    assert lit(spark, t.confidence(F.lit("short"), ())) == 0.3
    long = "A and B, carbon and more. " * 5
    assert abs(lit(spark, t.confidence(F.lit(long), ("carbon", "x"))) - 0.78) < 1e-9
    assert abs(lit(spark, t.confidence(F.lit(long + "not sure"), ("carbon",))) - 0.63) < 1e-9


def test_quotes(spark):
    page = "Article 1. The holder of a permit shall report each year. Heading. Reports are kept for five years by the holder."
    q = lambda x: lit(spark, t.quote_status(F.lit(x), F.lit(page)))
    assert q("The holder of a permit shall report each year") == "verbatim"
    assert q("The holder of a permit shall report each year. Reports are kept for five years") == "reordered"
    assert q("The owner of a licence must never report") == "absent"
    assert q("") == "absent"
    assert lit(spark, t.is_verbatim(F.lit("The holder of a permit...five years by the holder"), F.lit(page)))
    assert not lit(spark, t.is_verbatim(F.lit("The holder, if asked, of a permit"), F.lit(page)))
    assert lit(spark, t.quotes_in(F.lit("x「" + "字" * 16 + "」y「短」"))) == ["字" * 16]


def test_numerals_and_ratio(spark):
    for text, n in (("五", 5), ("十", 10), ("十二", 12), ("九十九", 99), ("二十", 20), ("x", None), ("十十", None)):
        assert lit(spark, t.chinese_number(F.lit(text))) == n
    assert lit(spark, t.similarity(F.lit("abcd"), F.lit("bcde"))) == 0.75


def test_hashes(spark):
    options = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(x).alias("text")) for k, x in (("B", "two x"), ("A", "one"))))
    import hashlib

    assert lit(spark, t.item_hash(F.lit("st em"), options)) == hashlib.sha256(b"stem||A:one|B:twox").hexdigest()
    rows = spark.createDataFrame([("2", "b"), ("1", "a")], "n string, t string")
    assert rows.agg(t.corpus_hash(F.col("n"), F.col("t")).alias("h")).first()["h"] == hashlib.sha256(b"1\ta\n2\tb").hexdigest()


def test_scalars(spark):
    assert [lit(spark, s.half_up(F.lit(x))) for x in (0.5, 1.49, 2.5)] == [1, 1, 3]
    assert lit(spark, s.percent(F.lit(1), F.lit(8))) == 13 and lit(spark, s.percent(F.lit(1), F.lit(0))) == 0
    assert lit(spark, s.score_label(F.lit(70))) == "good" and lit(spark, s.score_label(F.lit(59))) == "fail"
    assert lit(spark, s.duration(F.lit(125900))) == "2:05"
    assert [lit(spark, s.relative_time(F.lit(10**9), F.lit(10**9 - x))) for x in (-5, 59999, 60000, 7200000, 172800000)] == ["now", "now", "1 min", "2 h", "2 d"]
    assert [lit(spark, s.clamped_count(F.lit(x))) for x in (" 12 ", "0", "999", "1.5", "99999999999999999999")] == [12, None, 100, None, 100]
    assert lit(spark, s.host(F.lit("HTTPS://u:p@A.Example.com:80/x?y"))) == "a.example.com" and lit(spark, s.host(F.lit("no url"))) is None
    assert lit(spark, s.feedback_url("https://x/f", F.lit("a b"), F.lit("y" * 101))) == "https://x/f?id=a+b&stem=" + "y" * 100 + "%E2%80%A6"
    assert lit(spark, s.markdown_to_html(F.lit("**b** *i* <x>"))) == "<strong>b</strong> <em>i</em> &lt;x&gt;"
    assert lit(spark, s.redacted(F.create_map(F.lit("userEmail"), F.lit("a"), F.lit("page"), F.lit("b")))) == {"userEmail": "[redacted]", "page": "b"}
    for json in ('{"message": {"content": "hi"}}', '{"message": {"content": [{"text": "hi"}]}}', '{"text": "hi"}', '{"response": "hi"}', "hi"):
        assert lit(spark, s.reply_text(F.lit(json))) == "hi", json
    assert lit(spark, s.is_iso_date(F.lit("2024-01-31"))) and not lit(spark, s.is_iso_date(F.lit("2024-1-31")))
    assert not lit(spark, s.not_before(F.lit(None).cast("string"), "2020-01-01"))


def test_redacted_json(spark):
    assert lit(spark, s.redacted_json(F.lit('{"a": [{"AuthToken": {"x": 1}}], "b": {"c": {"d": {"e": {"f": 1}}}}}'))) == '{"a":[{"AuthToken":"[redacted]"}],"b":{"c":{"d":{"e":{"f":"[truncated]"}}}}}'
    assert lit(spark, s.redacted_json(F.lit("no json"))) is None and lit(spark, s.redacted_json(F.lit(None).cast("string"))) is None


def test_splices_against_all_cuts():
    import random

    rng = random.Random(3)

    def longest_runs(q, page, least, most):  # from the definition: longest prefix of what is left, again and again
        runs = 0
        while q:
            n = max((k for k in range(1, len(q) + 1) if q[:k] in page), default=0)
            runs += 1
            if not n or runs > most or n < least and n < len(q):
                return False
            q = q[n:]
        return True

    for _ in range(3000):
        page = "".join(rng.choice("ab") for _ in range(rng.randint(0, 25)))
        quote = "".join(rng.choice([page[(i := rng.randint(0, len(page))) : i + rng.randint(1, 8)], rng.choice("abc")]) for _ in range(rng.randint(1, 5)))
        if quote:
            assert t.spliced(quote, page, 3, 3) == longest_runs(quote, page, 3, 3), (quote, page)


def test_authority(spark):
    urls = spark.createDataFrame([("https://a.gov.x/1",), ("http://gov.x",), ("http://notgov.x",), ("http://blog.y/",), (None,)], "url string")
    rules = spark.createDataFrame([("gov.x", "primary"), ("a.gov.x", "secondary"), ("blog.y", "secondary")], "host string, tier string")
    got = {r["url"]: r["tier"] for r in s.authority(urls, rules).collect()}
    assert got == {"https://a.gov.x/1": "primary", "http://gov.x": "primary", "http://notgov.x": None, "http://blog.y/": "secondary", None: None}
