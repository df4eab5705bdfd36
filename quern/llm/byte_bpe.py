"""Byte-level BPE from a file of ranks, run by a sentencepiece BPE model that is serialised straight from the vocabulary.

Each byte is written as one letter, so a token of the vocabulary is a piece of letters, scored by its negative rank: joining the
pair of highest score is then joining the pair of lowest rank, leftmost first. Nothing is normalised, and a piece's id is its rank.
Texts are cut into pre-tokens by the pattern and each is encoded alone. Ids are decoded piece by piece by the inverse of the letters.
One pass over the texts, no shuffle.

Code points that are newer than the library's character tables count as what these tables have them for (``Cutter``).

Defined cases: a null text is an empty one: no ids, the hashes are those of no bytes. Very long texts are handled whole, and long
pre-tokens aren't kept in the memo. Special strings inside texts are ordinary text. Repeated rows give repeated results, rows
without a doc_id keep it null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import struct
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import doc_columns, table
from .memo import Memo

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens of more code points are encoded each time, so the memo's bytes are bounded.
LONGEST_KEPT = 48
#: Texts that are encoded together and go back to Spark together.
TOGETHER = 50
#: The letters of the 256 bytes: a run of letters that nothing composes, folds or strips.
LETTERS = [chr(0x4E00 + b) for b in range(256)]
BYTE_OF = {c: b for b, c in enumerate(LETTERS)}
#: An unassigned code point, neither letter, number nor space to any version of the tables.
UNASSIGNED = "\uffff"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field in the wire format of protocol buffers."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a vocabulary whose ranks are 0, 1, ...; the piece after the last is the obligatory unknown one."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, ... without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte needs a rank")
    out = []
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        piece = "".join(LETTERS[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1)))  # 1: an ordinary piece
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))  # 2: the unknown piece
    out.append(_field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks))))  # BPE, pieces, the unknown piece's id
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))  # no marker in front, nothing removed or escaped
    return b"".join(out)


class Cutter:
    """Pre-tokens of a text by a pattern of classes \\p{L}, \\p{N} and \\s, as the tiktoken library cuts them.

    Python's regex may know code points as letters or numbers that the library's own, older tables don't. Which these are is asked
    of the library once; in texts that have them they are cut as unassigned ones.
    """

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        unknown = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
        newest = regex.findall(r"[\p{L}\p{N}]", unknown)
        known = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        self.newer = frozenset(c for c in newest if not known.encode_ordinary(c))
        self.older = {ord(c): UNASSIGNED for c in self.newer}

    def __call__(self, text: str) -> list[str]:
        if not (text.isascii() or self.newer.isdisjoint(text)):
            return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.older))]
        return self.pattern.findall(text)


class Coder:
    def __init__(self, path: str, pattern: str, memo_size: int = 200_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(path)))
        # Inverse mapping of every piece; the unknown one is not a token.
        self.bytes_ = [bytes(BYTE_OF[c] for c in self.model.id_to_piece(i)) for i in range(self.model.get_piece_size() - 1)]
        self.cut, self.memo = Cutter(pattern), Memo(self._make, memo_size)
        self.letters = {b: LETTERS[b] for b in range(256)}

    def _make(self, pre_tokens: list[str]) -> list[bytes]:
        forms = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for p in pre_tokens]
        return [np.asarray(ids, "<u4").tobytes() for ids in self.model.encode(forms, num_threads=1)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. What the memo lacks is encoded in one call."""
        cuts = [self.cut(t) for t in texts]
        missing = set().union(*cuts).difference(self.memo.young)
        long = [c for c in missing if len(c) > LONGEST_KEPT]
        known, also = self.memo.need(missing.difference(long)), dict(zip(long, self._make(long) if long else ()))
        of = (lambda c: also[c] if c in also else known[c]) if also else known.__getitem__
        out = [b"".join(map(of, cut)) for cut in cuts]
        self.memo.trim()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(path: str, pattern: str | None = None) -> Coder:
    """One coder a Python worker: tasks that follow one another in it share the memo."""
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


_CODERS: dict[tuple[str, str], Coder] = {}


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers) of every text."""
    path = path or vocabulary_path()

    def run(batches):
        own = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):  # only so many texts are Python strings at a time
                some = batch.slice(at, TOGETHER)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(own.encode(some.column(1).to_pylist()), pa.binary())], ["doc_id", "ids"])

    return doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that ids (as ``encode`` has them) stand for; null: null."""
    path = path or vocabulary_path()

    @F.pandas_udf("binary")
    def decoded(s: pd.Series) -> pd.Series:
        own = coder(path, pattern)
        return s.map(lambda x: None if x is None else own.decode(x))

    return decoded(ids)


def query(spark, sf_dir):
    coded = encode(table(spark, sf_dir, "documents")).withColumn("decoded", decode(F.col("ids")))
    return coded.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
