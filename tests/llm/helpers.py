"""Small documents with the odd cases every operator must stand: nulls, blanks, ties, repeats, long texts, clashing columns."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(extra=()):
    words = "the quick brown fox jumps over a lazy dog near some river bank while seven wise owls watch from old oak trees at dusk".split()
    prose = " ".join(words[i * 7 % len(words)] + ("" if i % 2 else str(i)) for i in range(80))
    rows = [
        (0, prose, "en", "a", 1),
        (1, prose + " end", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "", "", 0),
        (4, " \n\t ", "en", None, 3),
        (5, prose.upper(), "en", "b", 1),
        (7, "日本語 テキスト 😀😀 ñandú", "ja", "b", 1),
        (8, "one", "en", "b", 1),
        (8, "one", "en", "b", 1),
        (9, "x" * 3000 + " " + prose * 30, "en", "a", 1),
        (12, "a | b | # $ % & * < >\n" * 30, "en", "b", 1),
        (None, "no id at all", "en", "b", 1),
    ]
    return rows + list(extra)


def docs(spark, rows=None, clash=True):
    df = spark.createDataFrame(odd() if rows is None else rows, DOCS)
    if clash:  # further columns whose names the operators use themselves
        for name in ("score", "kept", "bucket", "key", "v", "w", "n", "fingerprint", "component_id", "batch", "_text", "_key"):
            df = df.withColumn(name, df["lang"])
    return df
