"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a vocabulary file (never trained here). Its scores count merge ranks, not log probabilities, so a piece of
rank r gets log(1 / (r + 1)) minus the log of the sum (Zipf's law), unless a table of log scores is given. A text is put into
SentencePiece's form (a marker for each space and one in front), cut into chunks that no piece crosses, and each chunk gets its
best segmentation: highest sum of scores, ties to the longer last piece. A character that no piece covers costs the lowest score
less 10 and becomes its UTF-8 bytes' pieces. Decoding joins pieces and bytes and turns markers into spaces.

Defined cases: null counts as empty (no ids). The marker character itself in a text becomes a space, as in the library. Very long
texts are encoded whole. Repeated rows give repeated results; an empty table an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import doc_columns, table
from .memo import Memo, cuttable, marked_chunks
from .token_counts import model_path


class Trie:
    """Double array over UTF-8 bytes: from state s by byte b to t = base[s] + b + 1 if check[t] == s. value[t]: a piece's id or -1."""

    def __init__(self, pieces: dict[bytes, int]):
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        keys = sorted(pieces)
        check[0] = 0
        free = probe = 257  # so that any byte can lead to a free place
        # Breadth first: a state, and the range of keys that have its prefix.
        queue = [(0, 0, len(keys), 0)]
        for state, low, high, depth in queue:
            if low < high and len(keys[low]) == depth:
                value[state] = pieces[keys[low]]
                low += 1
            children, at = [], low
            while at < high:
                byte, first = keys[at][depth], at
                while at < high and keys[at][depth] == byte:
                    at += 1
                children.append((byte, first, at))
            if not children:
                continue
            # Lone children fill gaps from the front; others look on where the last search that took long ended.
            while free < len(check) and check[free] >= 0:
                free += 1
            from_ = free if len(children) == 1 else max(free, probe)
            start = max(0, from_ - children[0][0] - 1)
            tried = 0
            while True:
                if start + 257 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if all(check[start + b + 1] < 0 for b, _, _ in children):
                    break
                start += 1
                tried += 1
            if tried > 50 and len(children) > 1:
                probe = start
            base[state] = start
            for b, first, last in children:
                check[start + b + 1] = state
                queue.append((start + b + 1, first, last, depth + 1))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, data: bytes, at: int):
        """(end, id) of every piece that starts at this byte."""
        base, check, value, state = self.base, self.check, self.value, 0
        for end in range(at, len(data)):
            t = base[state] + data[end] + 1
            if t >= len(check) or check[t] != state:
                return
            state = t
            if value[state] >= 0:
                yield end + 1, value[state]


class Unigram:
    def __init__(self, path: str, scores: dict[str, float] | None = None, memo_size: int = 400_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        kept = {m.id_to_piece(i): i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        if not cuttable(kept):
            raise ValueError("a piece of this model crosses chunks")
        order = sorted(kept, key=lambda p: (-m.get_score(kept[p]), kept[p]))
        total = np.log(np.sum(1 / np.arange(1, len(order) + 1)))
        logs = scores or {p: -float(np.log(r + 1) + total) for r, p in enumerate(order)}
        self.score = {i: logs[p] for p, i in kept.items() if p in logs}
        self.bytes_of = {i: p.encode() for p, i in kept.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.trie = Trie({p.encode(): i for p, i in kept.items() if p in logs})
        self.lowest = min(self.score.values()) - 10
        self.memo = Memo(lambda chunks: [np.array(self.best(c), np.uint16 if n <= 1 << 16 else np.uint32).tobytes() for c in chunks], memo_size)
        self.kind = np.uint16 if n <= 1 << 16 else np.uint32
        self.parts = [self.bytes_of.get(i, b"") for i in range(n)]

    def best(self, chunk: str) -> list[int]:
        """Viterbi over byte positions; only ends of characters are reached."""
        data = chunk.encode("utf-8", "replace")
        n = len(data)
        top, back = [float("-inf")] * (n + 1), [None] * (n + 1)
        top[0] = 0.0
        score, prefixes, lowest = self.score, self.trie.prefixes, self.lowest
        for at in range(n):
            here = top[at]
            if here == float("-inf"):
                continue
            lead = data[at]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single = False
            for end, piece in prefixes(data, at):
                single |= end == at + width
                s = here + score[piece]
                if s > top[end]:
                    top[end], back[end] = s, (at, piece)
            if not single and here + lowest > top[at + width]:
                top[at + width], back[at + width] = here + lowest, (at, -1)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(data[start:at])]
            at = start
        return out[::-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            out.append(np.frombuffer(b"".join(self.memo.values(marked_chunks(text))) if text else b"", self.kind))
            self.memo.trim()
        return out

    def decode(self, ids) -> str:
        parts = self.parts
        text = b"".join([parts[i] for i in ids]).decode("utf-8", "replace").replace("▁", " ")
        return text[1:] if text.startswith(" ") else text


def model_of(path: str) -> Unigram:
    """One model a Python worker: tasks that follow one another in it share its trie and memo."""
    if path not in _MODELS:
        _MODELS[path] = Unigram(path)
    return _MODELS[path]


_MODELS: dict[str, Unigram] = {}


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian uint32), n_pieces, n_byte_pieces, round_trip (decoding gives the text's form back)."""
    path = path or model_path()

    def run(parts):
        model = model_of(path)
        fallback = np.zeros(len(model.parts), bool)
        fallback[list(model.byte_ids.values())] = True
        for pdf in parts:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                texts = list(part["text"])
                ids = model.encode(texts)
                blobs = [x.astype("<u4").tobytes() for x in ids]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "ids": blobs, "n_pieces": [len(x) for x in ids], "n_byte_pieces": [int(fallback[x].sum()) for x in ids], "ids_crc32": [zlib.crc32(b) for b in blobs], "round_trip": [model.decode(x.tolist()) == t.replace("▁", " ") for x, t in zip(ids, texts)]})

    return doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, ids binary, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from (doc_id, ids)."""
    path = path or model_path()

    def run(parts):
        model = model_of(path)
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text": [model.decode(np.frombuffer(b, "<u4").tolist()) for b in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def query(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip")
