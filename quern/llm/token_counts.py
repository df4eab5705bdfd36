"""Token counts: the exact number of tokens at every prefix of a text, for truncation and budgets without encoding again.

The count is that of the sentencepiece library for the prefix alone. A text is cut into chunks that no piece crosses, so
count(prefix) = count(whole chunks before) + count(part of the last chunk): a dynamic programme over prefixes whose only inputs
are the counts of prefixes of single chunks, which recur and are kept in a bounded memo. The counts are stored as one signed
byte a code point: by how much the count changes there. One pass over the texts, no shuffle.

The counts of a chunk's first 64 prefixes are the library's own, in one call; beyond, ``_long`` finds each from earlier ones.

Defined cases: very long texts are counted whole. Null counts as empty (0 bytes, 0 tokens, no prefixes). Special strings inside texts are ordinary text, as the
library has it. Repeated rows give repeated results. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns, table
from .memo import Memo, cuttable, marked_chunks

MODEL, LIMIT = "piece_bpe_32k.model", 4096


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PrefixCounter:
    """deltas(texts): for each text the changes of the count at each code point, as int8 bytes."""

    def __init__(self, path: str, memo_size: int = 300_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.pieces = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
        self.width = max(map(len, self.pieces))
        if not cuttable(self.pieces):
            raise ValueError("a piece of this model crosses chunks")
        self.line = len(self.model.encode("a\n")) - len(self.model.encode("a"))
        self.counts = Memo(self._counts, 2 * memo_size)
        self.chunks = Memo(self._deltas, memo_size)

    def _counts(self, prefixes: list[str]) -> list[int]:
        """Tokens of prefixes of chunks. The library puts a marker in front; after a line feed it doesn't stand alone."""
        raw = [p[1:].replace("▁", " ") if p[0] == "▁" else "\n" + p for p in prefixes]
        got = self.model.encode(raw, num_threads=1)
        return [1 if not r else len(g) if p[0] == "▁" else len(g) - 1 - self.line for p, r, g in zip(prefixes, raw, got)]

    def _deltas(self, chunks: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(chunks), 5000):
            part = chunks[at : at + 5000]
            known = self.counts.need([c[:i] for c in part if c != "\n" for i in range(1, min(len(c), 64) + 1)])
            for c in part:
                if c == "\n":
                    out.append(bytes([self.line]))
                    continue
                counts = [known[c[:i]] for i in range(1, min(len(c), 64) + 1)]
                if len(c) > 64:
                    counts += self._long(c)
                out.append(bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)]))
            self.counts.trim()
        return out

    def _long(self, chunk: str) -> list[int]:
        """Counts from the 65th prefix of a long chunk on. The last token t of a prefix follows the encoding of the prefix
        without t, so count = count(without t) + 1: candidates for t are the pieces that end there, and t is right if it and
        the last token before it stay two tokens when encoded together."""
        last: list[str] = [""]
        counts = [0]
        know: dict[tuple[str, str], bool] = {}
        for end in range(1, len(chunk) + 1):
            for start in range(max(0, end - self.width), end):
                t = chunk[start:end]
                if end - start > 1 and t not in self.pieces:
                    continue
                before = last[start]
                if start and (before, t) not in know:
                    know[before, t] = self._pieces(before + t) == [before, t]
                if not start and self._pieces(t) == [t] or start and know[before, t]:
                    last.append(t)
                    counts.append(counts[start] + (1 if t in self.pieces else len(t.encode())))
                    break
            else:
                raise AssertionError(f"no last token at {end}")
        return counts[65:]

    def _pieces(self, form: str) -> list[str]:
        """The pieces of a stretch of a chunk, bytes of one character joined again."""
        raw = form[1:].replace("▁", " ") if form[0] == "▁" else "\n" + form
        got = self.model.encode(raw, out_type=str) if raw else ["▁"]
        out, held = [], b""
        for p in got if form[0] == "▁" else got[1 + self.line :]:
            if p.startswith("<0x") and len(p) == 6:
                held += bytes([int(p[3:5], 16)])
                try:
                    out.append(held.decode())
                    held = b""
                except UnicodeDecodeError:
                    pass
            else:
                out.append(p)
        return out

    def deltas(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            all_ = b"".join(self.chunks.values(marked_chunks(text))) if text else b""
            # The marker in front is no code point of the text: its change joins that of the first.
            out.append(bytes([(all_[0] + all_[1]) & 255]) + all_[2:] if all_ else b"")
            self.chunks.trim()
        return out


def counter(path: str) -> PrefixCounter:
    """One counter a Python worker: tasks that follow one another in it share its memos."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


_COUNTERS: dict[str, PrefixCounter] = {}


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, deltas (binary: a signed byte a code point; their sums are the counts at the prefixes)."""
    path = path or model_path()

    def run(parts):
        own = counter(path)
        for pdf in parts:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                texts = list(part["text"])
                found = own.deltas(texts)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in found], "deltas": found})

    return doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, deltas binary")


def tokens_at(deltas: Column, n_chars: Column) -> Column:
    """Tokens of the first n_chars code points (all, if there are fewer), from the stored counts."""

    @F.pandas_udf("long")
    def at(d: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.int8)[: max(0, k)].sum(dtype=np.int64)) for x, k in zip(d, n)])

    return at(deltas, n_chars)


def longest_within(deltas: Column, budget: Column) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens (a longer prefix can have fewer tokens)."""

    @F.pandas_udf("long")
    def longest(d: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, most):
            fits = np.flatnonzero(np.cumsum(np.frombuffer(x, np.int8), dtype=np.int64) <= most)
            return int(fits[-1]) + 1 if len(fits) else 0

        return pd.Series([one(x, k) for x, k in zip(d, b)])

    return longest(deltas, budget)


def query(spark, sf_dir):
    return prefix_counts(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
