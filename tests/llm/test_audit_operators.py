import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import byte_bpe, centroids, divergence
from tests.llm.helpers import docs
from tests.oracle import same

EMPTY = []


# source divergence


def brute_divergence(rows, least):
    """All terms of a language for all its groups, zeros too."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def terms(text):
        out, held = [], ""
        for c in text.translate(lower) + " ":
            if "a" <= c <= "z" or ord(c) > 127:
                held += c
            elif held:
                out.append(held)
                held = ""
        return out

    cut = [(lang or "", source or "", terms(text or "")) for _, text, lang, source, _ in rows]
    out = []
    for lang in {x[0] for x in cut}:
        own = [x for x in cut if x[0] == lang]
        in_docs = Counter(t for x in own for t in set(x[2]))
        kept = [t for t, n in in_docs.items() if n >= least]
        counts = {s: Counter(t for x in own if x[1] == s for t in x[2]) for s in {x[1] for x in own}}
        whole = Counter(t for x in own for t in x[2])

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in counts:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            best = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < 10]
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least", [1, 2, 10])
def test_divergence_against_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(divergence, "HELD", 20)
    rng = random.Random(least)
    words = ["alpha", "Beta", "GAMMA", "ñandú", "Ñandú", "日本", "x1y", "it's", "a_b", "😀", "É", "é"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), 1) for i in range(60)]
    rows += [(99, "only here", "xx", "lonely", 1), (100, None, "yy", "a", 1), (101, "", "yy", "b", 1), (101, "", "yy", "b", 1), (None, "x\0y Z" + "z" * 5000, "en", "s1", 1)]
    got = divergence.audit(docs(spark, rows), least)
    assert collected(got) == brute_divergence(rows, least)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "string", "bigint", "int"]


def test_divergence_when_groups_are_not_broadcast(spark, monkeypatch):
    from quern.llm import common

    monkeypatch.setattr(common, "SMALL_TABLE", 1)
    rows = [(i, f"shared word{chr(97 + i % 7)}", "en", f"s{i % 4}", 1) for i in range(40)]
    assert collected(divergence.audit(docs(spark, rows), 2)) == brute_divergence(rows, 2)


def test_divergence_on_odd_cases(spark):
    rows = [tuple(r) for r in docs(spark, clash=False).collect()]
    assert collected(divergence.audit(docs(spark), 1)) == brute_divergence(rows, 1)
    assert divergence.audit(docs(spark, EMPTY)).count() == 0


def test_divergence_equals_sql(spark, data):
    same(divergence.query(spark, data), divergence.ORACLE, data)


# byte-level BPE


def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_library():
    own, lib, rng = byte_bpe.coder(byte_bpe.vocabulary_path()), library(), random.Random(4)
    odd = list("ab 'stre\n\t\r  \x00\x1c\x85\xa0　日é😀՘࢏12٣") + ["'re", "<|endoftext|>", "́", "▁", "\U000323b0"]
    texts = ["", " ", "x" * 20000, "ab" * 9000, "日本" * 900, " " * 3000, "\n" * 999 + "a"]
    texts += ["".join(rng.choice(odd) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_code_points_newer_than_the_library(spark):
    """Every code point, between letters, so that a class read otherwise would show."""
    own, lib = byte_bpe.coder(byte_bpe.vocabulary_path()), library()
    for start in range(0, 0x110000, 64):
        t = "".join(f"a{chr(c)}1" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode_ordinary(t), hex(start)


def test_every_token_is_reached():
    own, ranks = byte_bpe.coder(byte_bpe.vocabulary_path()), byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    forms = ["".join(byte_bpe.LETTERS[b] for b in t) for t in ranks]
    assert own.model.encode(forms, num_threads=1) == [[r] for r in ranks.values()]
    assert own.bytes_ == sorted(ranks, key=ranks.get)


def test_other_vocabulary(spark, tmp_path):
    """A small vocabulary, whose joins must go by rank and not by length; a bad one is refused."""
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"aa": 258}
    path = tmp_path / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items()))
    own = byte_bpe.Coder(str(path), r"\S+|\s+")
    assert np.frombuffer(own.encode(["abc aaab"])[0], "<u4").tolist() == [97, 256, 32, 258, 257]
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})


def test_memo_forgets_and_long_words_stay_out():
    small, lib = byte_bpe.Coder(byte_bpe.vocabulary_path(), byte_bpe.coder(byte_bpe.vocabulary_path()).cut.pattern.pattern, 20), library()
    for i in range(60):
        t = f"w{i} " * 5 + "y" * (40 + i)
        assert np.frombuffer(small.encode([t])[0], "<u4").tolist() == lib.encode_ordinary(t)
    assert len(small.memo.young) <= 40 and max(map(len, [*small.memo.young, *small.memo.old])) <= byte_bpe.LONGEST_KEPT


def test_byte_bpe_of_documents(spark):
    lib = library()
    got = byte_bpe.encode(docs(spark)).select("doc_id", "ids", byte_bpe.decode(F.col("ids")).alias("decoded")).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    assert len(got) == 12
    for r in got:
        t = texts[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
    assert byte_bpe.encode(docs(spark, EMPTY)).count() == 0


def test_byte_bpe_query(spark, data):
    lib = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = byte_bpe.query(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.asarray(lib.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


# centroids


def brute_clusters(rows, k, rounds):
    """Every vector against every centroid, in Python's whole numbers."""
    import math

    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in starts]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        mine = [nearest(v)[1] for _, v in kept]
        for n in range(len(cs)):
            own = [v for (_, v), m in zip(kept, mine) if m == n]
            if own:
                cs[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, n in found:
        sums[n] += d
    return sorted(((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for i, d, n in found), key=str)


def vectors(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")
    for name in ("v", "cluster", "distance", "e", "fits", "label"):
        df = df.withColumn(name, F.lit("x"))
    return df


def clustered(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


@pytest.mark.parametrize(("k", "rounds", "spread"), [(8, 10, 1.0), (8, 3, 0.003), (5, 0, 1.0), (1, 2, 1.0), (30, 2, 0.05)])
def test_clusters_against_brute_force(spark, k, rounds, spread):
    rng = random.Random(k + rounds)
    as_float = lambda x: float(np.float32(x))
    rows = [(i, [as_float(rng.gauss(rng.choice([0, 0.3]) * (i % 5), spread)) for _ in range(64)]) for i in range(150)]
    rows += rows[:20] + [(None, rows[3][1]), (None, rows[4][1]), (500, [0.0] * 64), (501, [-0.0] * 64), (502, [1e-30] * 64), (503, [-1e-30] * 64)]
    rows += [(600, None), (601, []), (602, [0.5] * 63), (603, [0.5] * 65), (604, [float("nan")] * 64), (605, [0.1] * 63 + [float("inf")]), (606, [None] + [0.1] * 63)]
    for parts in (1, 7):
        got = centroids.clusters(vectors(spark, rows).repartition(parts), k=k, rounds=rounds)
        assert clustered(got) == brute_clusters(rows, k, rounds)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_scan_leaves_out_only_what_cannot_win():
    """Ties at exactly twice the distance: a centroid of smaller number there must still win."""
    cs = np.array([[4] * 64, [0] * 64, [100] * 64], np.int64)
    x = np.array([[2] * 64, [0] * 64, [90] * 64], np.int64)
    best, least = centroids.scan(x, np.array([1, 1, 2]), cs)
    assert best.tolist() == [0, 1, 2] and least.tolist() == [256, 0, 6400]


def test_clusters_of_few_equal_or_no_vectors(spark):
    one = [(i, [0.25] * 64) for i in range(20)]
    assert clustered(centroids.clusters(vectors(spark, one))) == brute_clusters(one, 8, 10)
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clustered(centroids.clusters(vectors(spark, few))) == brute_clusters(few, 8, 10)
    assert centroids.clusters(vectors(spark, [])).count() == 0
    assert centroids.clusters(vectors(spark, [(1, None)])).count() == 0


def test_vectors_out_of_range_take_no_part(spark):
    rows = [(i, [i / 10] * 64) for i in range(12)]
    far = [(90, [3e38] * 64), (91, [-2e5] + [0.0] * 63)]
    got = clustered(centroids.clusters(vectors(spark, rows + far)))
    assert [r for r in got if r[0] < 90] == brute_clusters(rows, 8, 10)
    assert [r for r in got if r[0] >= 90] == [(90, None, None, None, None, None), (91, None, None, None, None, None)]


def test_clusters_of_the_query(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    assert clustered(centroids.query(spark, data)) == brute_clusters(rows, 8, 10)
