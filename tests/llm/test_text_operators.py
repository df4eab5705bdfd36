import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import simhash, token_counts, unigram, wavelet
from tests.llm.helpers import docs

os.environ["TOKENIZERS_PARALLELISM"] = "false"
EMPTY = []


def rows_by_id(df, *order):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


# fingerprints


def test_fingerprint_properties():
    a = simhash.fingerprint("the quick brown fox jumps over the dog")
    assert a == simhash.fingerprint("THE quick  brown fox\njumps over the dog") and len(a) == 32
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == bytes(32)
    assert simhash.likeness(a, a) == 1.0


def test_compare_against_brute_force(spark):
    for n in ("1", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = simhash.compare(docs(spark)).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        texts = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
        order = sorted((i for i in texts if i is not None), reverse=True) + [None]
        # doc 8 is there twice, so its own copy follows the first of the two.
        seq = [(i, texts[i]) for i in order for _ in range(2 if i == 8 else 1)]
        want = []
        for k, (i, t) in enumerate(seq):
            e = simhash.edited(t, seq[(k + 1) % len(seq)][1])
            want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest()))
        assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)
        assert all(0 <= r["near_edited"] <= 1 and r["fingerprint"] == simhash.fingerprint(texts[r["doc_id"]]).hex() for r in got)
    assert simhash.compare(docs(spark, EMPTY)).count() == 0
    alone = simhash.compare(docs(spark, [(1, "a b c d", "en", "s", 1)])).first()
    assert alone["near_next"] == 1.0


@pytest.mark.parametrize("keyed", [1, 2])
def test_block_tables_find_all(spark, keyed):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {f"{b ^ sum(1 << k for k in rng.sample(range(64), d)):016x}" for b in base for d in (0, 1, 2, 3, 4, 5)}
    df = spark.createDataFrame([(p,) for p in prints for _ in range(2)] + [(None,)], "fingerprint string")
    got = {(r["a"], r["b"], r["distance"]) for r in simhash.within(df, 3, 64, keyed).collect()}
    want = {(a, b, d) for a in prints for b in prints if a < b and (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and want


# token counts


def test_prefix_counts_against_library(spark):
    counter = token_counts.PrefixCounter(token_counts.model_path(), memo_size=50)
    rng = random.Random(2)
    texts = ["", " ", "\n", "a\n\nb  c", "▁x ▁▁ y", "日本語😀", "<s> </s>", "x" * 150, "thequickbrownfox" * 9, "é" * 70] + ["".join(rng.choice("ab \n▁thein日😀") for _ in range(rng.randint(1, 120))) for _ in range(60)]
    for text, deltas in zip(texts, counter.deltas(texts)):
        assert list(np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)) == [len(counter.model.encode(text[:i])) for i in range(1, len(text) + 1)], text


def test_token_counts_of_documents(spark):
    found = token_counts.prefix_counts(docs(spark))
    model = token_counts.PrefixCounter(token_counts.model_path()).model
    texts = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    got = found.select("*", token_counts.tokens_at("deltas", F.lit(9)).alias("at9"), token_counts.longest_within("deltas", F.lit(5)).alias("cut")).collect()
    assert len(got) == 12
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(model.encode(t)))
        assert r["at9"] == len(model.encode(t[:9]))
        short = t[:300]
        fits = [i for i in range(1, len(short) + 1) if len(model.encode(t[:i])) <= 5]
        assert r["cut"] == (fits[-1] if fits else 0)
    assert token_counts.prefix_counts(docs(spark, EMPTY)).count() == 0


# token ids


def test_encoder_equals_library():
    e = wavelet.Encoder(wavelet.model_path(), memo_size=50)
    rng = random.Random(3)
    texts = ["", " ", "x \n y", "a <|endoftext|> b", "don't we'll", "\t\ttab nb　wide", "a 123 b1 12.5%"] + ["".join(rng.choice("ab \n thein日😀' 1. 　\t") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_encoder_looks_up_each_distinct_chunk_once():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    e = wavelet.Encoder(wavelet.model_path())
    e.memo.young, e.memo.old = Counted(), Counted()
    texts = ["the quick brown fox, and\nthe lazy dog"] * 500
    want = e.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert all(ids.tolist() == want for ids in e.encode(texts))
    assert Counted.asked < 50  # 9 chunks a text, and 4,500 in all


def test_encoder_cuts_within_texts(monkeypatch):
    """Several slices; white space beyond ASCII beside spaces; special strings across two texts; long chunks, which aren't kept."""
    monkeypatch.setattr(wavelet, "SLICE", 200)
    e = wavelet.Encoder(wavelet.model_path(), memo_size=50)
    rng = random.Random(5)
    bits = ["a", "b", " ", " ", "\n", "the", "日", "é", "1", "'s", "\u0085", "\u00a0", "\u1680", "\u2003", "\u2028", "\u205f", "\u3000", "\x1c", "\r", "\0", "😀", "<|endoftext|>"]
    texts = ["<|endofte", "xt|> a b", " ", "a", " b", "\n", "", "x" * 700 + " y", "é" * 300, "\u00a0"] + ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(2000)]
    for text, ids in zip(texts, e.encode(iter(texts)), strict=True):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert all(len(c) <= 256 for c in [*e.memo.young, *e.memo.old])
    assert wavelet.Encoder(wavelet.model_path(), memo_size=5).slice == 50  # few chunks kept: short slices
    assert list(e.encode([])) == [] and [len(x) for x in e.encode(["", ""])] == [0, 0]


def test_shard_queries():
    ids = np.random.default_rng(4).zipf(1.3, 70000) % 50000
    s = wavelet.Shard(wavelet.pack(ids, np.array([1, 2]), np.array([10, 70000])))
    assert (s.ids() == ids).all() and list(s.ends) == [10, 70000]
    assert all(s.access(i) == ids[i] for i in (0, 9, 32767, 32768, 69999))
    for token in (1, 2, 7, 4999, 49999, 65535):
        at = np.flatnonzero(ids == token)
        assert s.count(token) == len(at) and s.count(token, 40000) == (at < 40000).sum()
        assert all(s.locate(token, k) == at[k] for k in range(0, len(at), max(1, len(at) // 5)))
    with pytest.raises(IndexError):
        s.locate(65535, 0)
    empty = wavelet.Shard(wavelet.pack(np.empty(0, np.int64), np.empty(0), np.empty(0)))
    assert len(empty) == 0 and empty.count(3) == 0 and len(empty.ids()) == 0


def test_written_and_read_back(spark, tmp_path):
    path = str(tmp_path / "ids")
    df = docs(spark)
    wavelet.write(df, path, shard=500)
    e = wavelet.Encoder(wavelet.model_path())
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for i, t in rows:
        ids = np.append(e.tokenizer.encode(t, add_special_tokens=False).ids, 0).astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_by_id(wavelet.read(spark, path)) == want
    assert spark.read.parquet(path).count() > 3
    token = int(e.tokenizer.encode(" river", add_special_tokens=False).ids[0])
    found = {(r["doc_id"], r["position"]) for r in wavelet.find(spark, path, token).collect()}
    assert found == {(i, k) for i, t in rows for k, x in enumerate(e.tokenizer.encode(t, add_special_tokens=False).ids) if x == token}
    wavelet.write(docs(spark, EMPTY), str(tmp_path / "none"))
    assert wavelet.read(spark, str(tmp_path / "none")).count() == 0


# unigram pieces


def test_viterbi_against_brute_force():
    m = unigram.Unigram(unigram.model_path())
    pieces = {b.decode("utf-8", "replace"): i for i, b in m.bytes_of.items() if i in m.score}

    def best(text):
        top = {0: (0.0, 0)}
        for end in range(1, len(text) + 1):
            top[end] = max((top[s][0] + (m.score[pieces[text[s:end]]] if text[s:end] in pieces else m.lowest if end == s + 1 else float("-inf")), 0) for s in range(max(0, end - 16), end))
        return top[len(text)][0]

    rng = random.Random(5)
    for _ in range(150):
        text = "".join(rng.choice("thein aerson日😀") for _ in range(rng.randint(1, 25)))
        form = "▁" + text.replace(" ", "▁")
        ids = m.encode([text])[0].tolist()
        total, k = 0.0, 0
        while k < len(ids):
            if ids[k] in m.score:
                total += m.score[ids[k]]
                k += 1
            else:  # the bytes of one character
                lead = m.bytes_of[ids[k]][0]
                k += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += m.lowest
        assert abs(total - best(form)) < 1e-6, text
        assert m.decode(ids) == text


def test_round_trip_of_documents(spark):
    encoded = unigram.encode(docs(spark))
    assert all(r["round_trip"] for r in encoded.collect())
    texts = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in unigram.decode(encoded).collect())
    assert unigram.encode(docs(spark, EMPTY)).count() == 0
