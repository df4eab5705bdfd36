"""Many literal patterns against many texts in one pass over the texts, whatever the number of patterns.

Every pattern is known by one window of ``WINDOW`` characters: of its windows the one that the fewest patterns have, so a beginning that
all share is not looked for. Windows, places, lengths and digests of the patterns, some 50 bytes each, go to the tasks in one sorted array, if there are
at most ``MOST``. A task hashes all windows of a text at once, looks these up, and for each
hit compares the digest of what stands there. What is left is true but for collisions of 128 bits, and is compared character by character with the patterns
in their own table, so no pattern's text is sent anywhere.

Of a larger set only a filter of at most ``FILTER`` bits is sent, whatever its size: windows of texts that pass it are joined with those of the patterns,
and what they find is compared with the texts.

Joins here are merges by hint: what comes out of a task or an aggregate is estimated by the size of the files below it, however many rows it has, so
the optimizer would send all windows, patterns or texts through the driver.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

WINDOW, MOST, FILTER = 8, 100_000, 1 << 27
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _windows(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of k code points."""
    n = len(points) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ points[i : i + n]) * _STEP
        out ^= out >> np.uint64(29)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _described(patterns: DataFrame) -> DataFrame:
    """pattern -> pattern, size, at, window (signed hash of the window at ``at``), digest: of each distinct pattern, its rarest window."""

    def windows(parts):
        for pdf in parts:
            own, sizes = pdf["pattern"].to_numpy(object), pdf["pattern"].map(len).to_numpy(np.int64)
            for k in np.unique(np.minimum(sizes, WINDOW)).tolist():
                kind = np.flatnonzero(np.minimum(sizes, WINDOW) == k)
                # A row has its pattern's text, so what is put out at once is bounded by the squares of the sizes.
                for some in np.split(kind, np.flatnonzero(np.diff((sizes[kind] ** 2).cumsum() >> 25)) + 1):
                    texts, size = own[some], sizes[some]
                    # These patterns end to end; windows over an end are left out.
                    of, at = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(size.cumsum() - size, size)
                    whole = np.flatnonzero(at + k <= size[of])
                    window = _windows(_points("".join(texts)), k)[whole].view(np.int64)
                    yield pd.DataFrame({"pattern": texts[of[whole]], "k": k, "at": at[whole], "window": window})

    each = patterns.select("pattern").where(F.length("pattern") > 0).distinct().mapInPandas(windows, "pattern string, k int, at int, window long")
    # One row a pattern and window, so a window's count is the number of patterns (and places) that have it.
    counted = each.join(each.groupBy("k", "window").agg(F.count("*").alias("times")).hint("merge"), ["k", "window"])
    return counted.groupBy("pattern", "k").agg(F.min(F.struct("times", "at", "window")).alias("r")).select("pattern", "k", "r.at", "r.window")


class Index:
    """The patterns' windows by length (WINDOW, or the whole of a shorter pattern), in arrays."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["k", "window"], kind="stable")
        self.kinds = []
        for k, own in rows.groupby("k"):
            window = own["window"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(window, kind="stable")
            window = window[order]
            bits = max(10, int(np.ceil(np.log2(len(window)))) + 4)
            seen = np.zeros(1 << bits, bool)
            seen[window >> np.uint64(64 - bits)] = True
            columns = (own[c].to_numpy()[order] for c in ("number", "at", "size", "digest"))
            self.kinds.append((int(k), window, np.uint64(64 - bits), seen, *columns))

    def places(self, text: str) -> dict[int, list[int]]:
        """number of a pattern -> where it begins in the text, overlaps included."""
        found: dict[int, list[int]] = {}
        points = _points(text)
        for k, window, shift, seen, number, at, size, digest in self.kinds:
            have = _windows(points, k)
            hits = np.flatnonzero(seen[have >> shift])
            if not len(hits):
                continue
            first, last = np.searchsorted(window, have[hits], "left"), np.searchsorted(window, have[hits], "right")
            for h, a, b in zip(hits[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist()):
                for i in range(a, b):
                    start = h - int(at[i])
                    if start >= 0 and start + int(size[i]) <= len(text) and _digest(text[start : start + int(size[i])]) == digest[i]:
                        found.setdefault(int(number[i]), []).append(start)
        return found


def occurrences(texts: DataFrame, patterns: DataFrame, most: int = MOST) -> DataFrame:
    """texts (text_id, text), patterns (pattern_id, pattern) -> text_id, pattern_id, places (array<int>, from 0, ascending, overlaps
    included): a row for every pattern that a text holds. Equal patterns and ids are each themselves; null and empty texts and patterns hold nothing and stand
    nowhere. Rows of one text_id are texts of their own."""
    described = _described(patterns)
    numbered = described.withColumn("number", F.xxhash64("pattern", F.lit(1)))
    kind = texts.schema["text_id"].dataType.simpleString()
    many = patterns.select("pattern").where(F.length("pattern") > 0).distinct().count()
    if not many:
        return texts.select("text_id").limit(0).crossJoin(patterns.select("pattern_id").limit(0)).withColumn("places", F.array().cast("array<int>"))
    if many > most:
        return _joined(texts, patterns, described, many)
    # A bounded set: at most ``most`` rows of some 50 bytes.
    held = numbered.select("pattern", "number", "k", "at", "window").mapInPandas(_digests, "number long, k int, at int, window long, size int, digest binary").toPandas()
    # The last word is the patterns' own text.
    known = patterns.join(numbered.select("pattern", "number").hint("merge"), "pattern")
    return _hits(texts, held, kind).join(known.hint("merge"), "number").where(F.col("found") == F.col("pattern")).select("text_id", "pattern_id", "places")


def _joined(texts: DataFrame, patterns: DataFrame, described: DataFrame, many: int) -> DataFrame:
    """``occurrences`` of many patterns: equal texts are read once, their windows that pass a filter meet the patterns' windows in a join."""
    spark = texts.sparkSession
    bits = min(FILTER, max(1 << 15, 1 << (16 * many - 1).bit_length()))
    # Two bits a pattern, collected as a bounded bitmap.
    bit = F.explode(F.array(F.col("window").bitwiseAND(bits - 1), F.shiftrightunsigned("window", 32).bitwiseAND(bits - 1)))
    marked = described.select("k", bit.alias("bit")).select("k", (F.col("bit") + 1).alias("bit"))
    parts = marked.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"), F.collect_set("k").alias("ks")).collect()
    map_, size = np.zeros(bits // 8, np.uint8), 4096
    for r in parts:
        map_[(r["bucket"] - 1) * size : r["bucket"] * size] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    sent, ks = spark.sparkContext.broadcast(map_.tobytes()), sorted({k for r in parts for k in r["ks"]})

    def run(frames):
        have, mask = np.frombuffer(sent.value, np.uint8), np.uint64(bits - 1)
        is_set = lambda at: have[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        def table(met):
            sizes = [len(x[3]) for x in met]
            key, k = (np.repeat(np.array([x[i] for x in met], kind), sizes) for i, kind in enumerate((object, np.int32)))
            return pd.DataFrame({"key": key, "k": k, "window": np.concatenate([x[2] for x in met]), "place": np.concatenate([x[3] for x in met])})

        for pdf in frames:
            met, size = [], 0
            for key, text in zip(pdf["key"], pdf["text"]):
                points = _points(text)
                for k in ks:
                    w = _windows(points, k)
                    at = np.flatnonzero(is_set(w & mask))
                    at = at[is_set(w[at] >> np.uint64(32) & mask).astype(bool)]
                    if len(at):
                        met.append((key, k, w[at].view(np.int64), at))
                        size += len(at)
                    if size > 100_000:
                        yield table(met)
                        met, size = [], 0
            if met:
                yield table(met)

    own = texts.select("text_id", "text").where(F.length("text") > 0).withColumn("key", F.sha2("text", 256))
    distinct = own.groupBy("key").agg(F.first("text").alias("text"))
    begins = (F.col("place") - F.col("at")).cast("int")
    met = distinct.mapInPandas(run, "key string, k int, window long, place long").join(described.hint("merge"), ["k", "window"]).where(begins >= 0).select("key", "pattern", begins.alias("begin"))
    stands = F.substring(F.col("text"), F.col("begin") + 1, F.length("pattern")) == F.col("pattern")
    held = met.join(distinct.hint("merge"), "key").where(stands).groupBy("key", "pattern").agg(F.array_sort(F.collect_list("begin")).alias("places"))
    return own.select("text_id", "key").join(held.hint("merge"), "key").join(patterns.select("pattern_id", "pattern").hint("merge"), "pattern").select("text_id", "pattern_id", "places")


def _digests(parts):
    for pdf in parts:
        yield pd.DataFrame({"number": pdf["number"], "k": pdf["k"], "at": pdf["at"], "window": pdf["window"], "size": pdf["pattern"].map(len), "digest": pdf["pattern"].map(_digest)})


def _hits(texts: DataFrame, held: pd.DataFrame, kind: str) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(held)

    def run(parts):
        index, sizes = Index(sent.value), dict(zip(sent.value["number"].tolist(), sent.value["size"].tolist()))
        for pdf in parts:
            out = []
            for i, text in zip(pdf["text_id"], pdf["text"]):
                out += [(i, n, text[at[0] : at[0] + sizes[n]], sorted(at)) for n, at in index.places(text).items()]
            yield pd.DataFrame(out, columns=["text_id", "number", "found", "places"])

    return texts.select("text_id", "text").where(F.length("text") > 0).mapInPandas(run, f"text_id {kind}, number long, found string, places array<int>")


def needed_literals(pattern: str, least: int = 3) -> list[str] | None:
    """Literals one of which stands in whatever a regular expression matches: of each of its top-level alternatives the longest run of plain characters.
    None: there is an alternative without one of ``least`` characters, or the expression says more than this reads (flags, look-around, quotations)."""
    if re.search(r"\(\?|\[\^?\]|\\[QEkupPxcN0-9]", pattern):
        return None
    out, depth, run, best, i = [], 0, "", "", 0

    def ended():
        nonlocal run, best
        best, run = max(best, run, key=len), ""

    while i < len(pattern):
        c, step = pattern[i], 1
        plain = None
        if c == "\\":
            step = 2
            follows = pattern[i + 1 : i + 2]
            plain = follows if follows and not follows.isalnum() else None
        elif c == "[":
            end, inner = i + 1, 1
            while end < len(pattern) and inner:
                inner += {"[": 1, "]": -1}.get(pattern[end], 0) if pattern[end - 1] != "\\" else 0
                end += 1
            step = end - i
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c not in ".^$|?*+{}":
            plain = c
        after = pattern[i + step : i + step + 1]
        if c == "|" and depth == 0:
            ended()
            out.append(best)
            best = ""
        elif plain is not None and depth == 0 and after not in ("?", "*", "{"):
            run += plain
            if after == "+":
                ended()
        else:
            ended()
            if c == "{":
                close = pattern.find("}", i)
                step = (close if close > 0 else len(pattern)) - i + 1
        i += step
    ended()
    out.append(best)
    return out if depth == 0 and min(map(len, out)) >= least else None


def matches(texts: DataFrame, rules: DataFrame, least: int = 3, most: int = MOST) -> DataFrame:
    """texts (text_id, text), rules (rule_id, pattern: a regular expression) -> text_id, rule_id of every rule that matches within a text.

    Rules with needed literals meet only the texts that hold one of these; the others, which a caller should know to be few, meet all."""
    literals = F.udf(lambda p: None if p is None else needed_literals(p, least), "array<string>")
    read = rules.select("rule_id", F.col("pattern").alias("rule"), literals("pattern").alias("literals")).where(F.col("rule").isNotNull())
    keyed = read.where("literals IS NOT NULL").select("rule_id", "rule", F.explode("literals").alias("pattern")).withColumn("pattern_id", F.xxhash64("pattern"))
    met = occurrences(texts, keyed.select("pattern_id", "pattern").distinct(), most).join(keyed, "pattern_id").select("text_id", "rule_id", "rule").distinct()
    near = met.join(texts, "text_id").where(F.regexp_like("text", F.col("rule"))).select("text_id", "rule_id")
    rest = read.where("literals IS NULL").select("rule_id", "rule")
    far = texts.join(rest, F.regexp_like("text", F.col("rule"))).select("text_id", "rule_id")
    return near.unionByName(far)
