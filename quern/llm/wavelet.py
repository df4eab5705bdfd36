"""Token-ID output: a wavelet matrix per shard, in one compressed file that answers access, count and occurrence lookups.

Layout of a shard's bytes (little-endian): magic ``QWM1``; uint32 length of a JSON head; the head (number of ids and documents,
number of bit planes, zeros in each plane, sizes of the parts); the zstd-compressed doc ids (int64) and ends (int64); then for
each plane its bits in zstd blocks of BLOCK bits with a table of (rank before the block, offset). Plane 0 is the highest bit;
after each plane the ids with bit 0 come first, both sides in order. So rank and select need one block a plane.

Shards hold whole documents in ascending doc_id order. Documents are dealt to ranges of ids, each range is one task that writes
its shards as rows (bucket, part, ..., blob) of a Parquet table in the shared folder; Spark's commit makes a lost task harmless.

Defined cases: null or empty text: just the end id. Repeated documents keep the order (doc_id, hash of the text). An empty
table: no shards, empty result. Extra columns are ignored. Null doc_id sorts first.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import doc_columns, new_path, partitions, range_bounds, range_bucket, table
from .memo import Memo

MODEL, END, SHARD, BLOCK, MAGIC = "byte_bpe_50k.json", 0, 1 << 20, 1 << 15, b"QWM1"
NULL_ID = -(2**63)
#: Code points that are encoded at a time, and at most so many a chunk of the memo: a slice's distinct chunks should fit it.
SLICE, SLICE_CHUNK = 1 << 22, 10
#: White space beyond ASCII: the UTF-8 bytes as one number of three bytes (two and a zero for those of two).
WIDE_SPACE = np.array([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in map(chr, range(128, 0x3001)) if c.isspace()])
LETTERS_SIGNS = re.compile(r"( ?[^\W\d_]+)([^\w\s']+)")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """The bytes of one shard. ids: any non-negative integers; ends: for each document the number of ids up to its end."""
    import zstandard

    zip_ = zstandard.ZstdCompressor(level=1).compress
    planes = max(1, int(ids.max()).bit_length() if len(ids) else 1)
    now, zeros, parts, tables = ids.astype(np.uint16 if planes <= 16 else np.uint32), [], [], []
    for level in range(planes - 1, -1, -1):
        ranks, offsets, blocks, low, high = [0], [0], [], [now[:0]], []
        for at in range(0, len(now), BLOCK):
            # Block by block and by places: masks over random bits, or arrays beyond the cache, take twice the time.
            some = now[at : at + BLOCK]
            ones = some & np.array(1 << level, now.dtype) != 0
            blocks.append(zip_(np.packbits(ones).tobytes()))
            low.append(some[np.flatnonzero(~ones)])
            high.append(some[np.flatnonzero(ones)])
            ranks.append(ranks[-1] + len(high[-1]))
            offsets.append(offsets[-1] + len(blocks[-1]))
        tables.append(np.array([ranks, offsets], "<i8").tobytes())
        parts.append(b"".join(blocks))
        zeros.append(len(now) - ranks[-1])
        now = np.concatenate(low + high)
    docs = [zip_(np.asarray(doc_ids, "<i8").tobytes()), zip_(np.asarray(ends, "<i8").tobytes())]
    head = json.dumps({"ids": len(ids), "docs": len(doc_ids), "planes": planes, "zeros": zeros, "block": BLOCK, "doc_bytes": [len(x) for x in docs], "table_bytes": [len(x) for x in tables], "plane_bytes": [len(x) for x in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *docs, *(x for pair in zip(tables, parts) for x in pair)])


class Shard:
    """Queries against the bytes of one shard; only the blocks that a query touches are decompressed."""

    def __init__(self, blob: bytes):
        import zstandard

        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        size = struct.unpack("<I", blob[4:8])[0]
        h = self.head = json.loads(blob[8 : 8 + size])
        self.blob, self.unzip, at, self.held = blob, zstandard.ZstdDecompressor().decompress, 8 + size, {}
        read = []
        for n in h["doc_bytes"]:
            read.append(np.frombuffer(self.unzip(blob[at : at + n]), "<i8"))
            at += n
        self.doc_ids, self.ends = read
        self.ranks, self.offsets, self.starts = [], [], []
        for n, m in zip(h["table_bytes"], h["plane_bytes"]):
            both = np.frombuffer(blob[at : at + n], "<i8").reshape(2, -1)
            self.ranks.append(both[0])
            self.offsets.append(both[1])
            self.starts.append(at + n)
            at += n + m

    def __len__(self) -> int:
        return self.head["ids"]

    def _bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.held:
            a, b = (self.starts[plane] + int(x) for x in self.offsets[plane][block : block + 2])
            n = min(BLOCK, len(self) - block * BLOCK)
            if len(self.held) > 256:
                self.held.clear()
            self.held[plane, block] = np.unpackbits(np.frombuffer(self.unzip(self.blob[a:b]), np.uint8), count=n)
        return self.held[plane, block]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before position i."""
        block, rest = divmod(i, BLOCK)
        return int(self.ranks[plane][block]) + (int(self._bits(plane, block)[:rest].sum(dtype=np.int64)) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        counts = self.ranks[plane] if bit else np.minimum(np.arange(len(self.ranks[plane])) * BLOCK, len(self)) - self.ranks[plane]
        block = int(np.searchsorted(counts, k, side="right")) - 1
        return block * BLOCK + int(np.flatnonzero(self._bits(plane, block) == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for plane, zeros in enumerate(self.head["zeros"]):
            bit = int(self._bits(plane, i // BLOCK)[i % BLOCK])
            ones = self._rank1(plane, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        low, high = 0, end
        if token < 0 or token >> self.head["planes"]:
            return 0, 0
        for plane, zeros in enumerate(self.head["zeros"]):
            a, b = self._rank1(plane, low), self._rank1(plane, high)
            low, high = (zeros + a, zeros + b) if token >> (self.head["planes"] - 1 - plane) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        """How often the id occurs before position ``end`` (all)."""
        low, high = self._range(token, len(self) if end is None else end)
        return high - low

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        low, high = self._range(token, len(self))
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for plane in range(self.head["planes"] - 1, -1, -1):
            bit = token >> (self.head["planes"] - 1 - plane) & 1
            at = self._select(plane, bit, at - self.head["zeros"][plane] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest bit, each time undoing the stable split."""
        now = np.zeros(len(self), np.uint16 if self.head["planes"] <= 16 else np.uint32)
        for plane in range(self.head["planes"] - 1, -1, -1):
            before, zeros = np.empty_like(now), self.head["zeros"][plane]
            now[zeros:] |= now.dtype.type(1 << (self.head["planes"] - 1 - plane))
            for block, rank in enumerate(self.ranks[plane][:-1].tolist()):
                ones, part = self._bits(plane, block).view(bool), before[block * BLOCK : (block + 1) * BLOCK]
                for at, start in ((np.flatnonzero(~ones), block * BLOCK - rank), (np.flatnonzero(ones), zeros + rank)):
                    part[at] = now[start : start + len(at)]
            self.held.clear()
            now = before
        return now


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, from its ids of chunks kept in a bounded memo.

    A byte-level BPE of this kind cuts a text before every single space that stands between two others than white space, and
    around a line feed that does; what is between is encoded by the library alone. Other white space stays within its chunk.
    Some MB of texts are cut at once, and each distinct chunk among them is looked up once.
    """

    def __init__(self, path: str, memo_size: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.model = self.tokenizer.model
        self.bytes_ = dict(enumerate(_byte_letters()))
        self.slice = min(SLICE, SLICE_CHUNK * memo_size)
        self.memo, self.signs, self.kind = Memo(self._make, memo_size), {}, "I" if self.wide else "H"

    def _make(self, chunks: list[str]) -> list[bytes]:
        out, young, old, signs = [], self.memo.young, self.memo.old, self.signs
        for c in chunks:
            if (c[1:] if c[0] == " " else c).isalpha():
                out.append(self._letters(c))
                continue
            # Letters and then signs are two words to the library, and both are mostly known.
            two = LETTERS_SIGNS.fullmatch(c)
            if two and two[1].lstrip(" ").isalpha():
                word, end = two.groups()
                if end not in signs:
                    if len(signs) > 10_000:
                        signs.clear()
                    signs[end] = self._whole(end)
                out.append((young.get(word) or old.get(word) or self._letters(word)) + signs[end])
            else:
                out.append(self._whole(c))
        return out

    def _letters(self, c: str) -> bytes:
        """One word of letters, with or without a space before it: the library's model alone."""
        form = (self.bytes_[32] + c[1:] if c[0] == " " else c) if c.isascii() else c.encode().decode("latin-1").translate(self.bytes_)
        return array(self.kind, [t.id for t in self.model.tokenize(form)]).tobytes()

    def _whole(self, c: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes()

    def _cuts(self, texts: list[str], data: bytes, ends: np.ndarray) -> np.ndarray:
        """Where chunks begin in the joined UTF-8 bytes of these texts, and the end. ends: of each text, after a 0."""
        b = np.frombuffer(data, np.uint8)
        line = b == 10
        cut = line | (b == 32)
        white = cut | (b - 9 < 5) | (b - 28 < 4)
        lead = np.flatnonzero((b == 0xC2) | (b - 0xE1 < 3))
        if len(lead):
            first, second, third = (b.take(lead + i, mode="clip").astype(np.int32) for i in range(3))
            lead = lead[np.isin(first << 16 | second << 8 | np.where(first == 0xC2, 0, third), WIDE_SPACE)]
            for at in (lead, lead + 1, lead[b[lead] != 0xC2] + 2):
                white[at] = True
        cut[1:] &= ~white[:-1]
        cut[:-1] &= ~white[1:]
        begins = ends[:-1][np.diff(ends) > 0]
        cut[begins] = cut[ends[1:][np.diff(ends) > 0] - 1] = False
        if any(s.encode() in data for s in self.special):
            for i, text in enumerate(texts):
                if any(s in text for s in self.special):
                    cut[ends[i] : ends[i + 1]] = False  # the library looks for special strings in the whole text
        after = np.flatnonzero(cut & line) + 1
        cut[after] = cut[begins] = True
        return np.append(np.flatnonzero(cut), len(b))

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        data, ends = b"".join(raw), np.cumsum([0, *map(len, raw)])
        cuts = self._cuts(texts, data, ends)
        chunks = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        known = self.memo.distinct(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), 256)
        which = chunks.indices.to_numpy()
        self.memo.trim()
        ids = np.frombuffer(b"".join(known), np.uint32 if self.wide else np.uint16)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // ids.itemsize
        n = sizes[which]
        done = np.concatenate([[0], np.cumsum(n)])
        # Every chunk's ids are one run of those of the distinct chunks.
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - done[:-1], n)
        places += np.arange(len(places))
        return np.split(ids[places], done[np.searchsorted(cuts[:-1], ends[1:-1])])

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; texts of about ``slice`` code points are held at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= self.slice:
                yield from self._slice(held)
                held, size = [], 0
        if held:
            yield from self._slice(held)


def encoder(path: str, memo_size: int = 600_000) -> Encoder:
    """One encoder a Python worker: tasks that follow one another in it share the memo."""
    if (path, memo_size) not in _ENCODERS:
        _ENCODERS[path, memo_size] = Encoder(path, memo_size)
    return _ENCODERS[path, memo_size]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE vocabularies write for each byte: printable Latin-1 for itself, the others from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def write(docs: DataFrame, path: str, model: str | None = None, shard: int = SHARD) -> None:
    """Writes the shards of docs (doc_id, text) as a Parquet table: bucket, part, start_in_bucket, n_ids, n_docs, blob."""
    model, spark = model or model_path(), docs.sparkSession
    docs = doc_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", partitions(spark))
    rows = docs.withColumn("bucket", range_bucket(F.col("doc_id"), bounds)).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(parts):
        coder, bucket, part, start, held = encoder(model), None, 0, 0, []

        def flush():
            nonlocal part, start, held
            ids = np.concatenate([x for _, x in held])
            ends = np.cumsum([len(x) for _, x in held])
            row = pd.DataFrame([(bucket, part, start, len(ids), len(held), pack(ids, np.array([i for i, _ in held], np.int64), ends))], columns=["bucket", "part", "start_in_bucket", "n_ids", "n_docs", "blob"])
            part, start, held = part + 1, start + len(ids), []
            return row

        size = 0
        for pdf in parts:
            if len(pdf):
                bucket = int(pdf["bucket"].iloc[0])
            for i, ids in zip(pdf["doc_id"].astype("Int64").fillna(NULL_ID), coder.encode(pdf["text"])):
                end = np.array([END], ids.dtype)
                held.append((int(i), np.concatenate([ids, end])))
                size += len(ids) + 1
                if size >= shard:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows.mapInPandas(run, "bucket int, part int, start_in_bucket long, n_ids long, n_docs long, blob binary").write.option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone."""
    shards = spark.read.schema("bucket int, part int, start_in_bucket long, n_ids long, n_docs long, blob binary").parquet(path)
    # One number a bucket, and there are no more buckets than shuffle partitions.
    sums = shards.groupBy("bucket").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    base = {r["bucket"]: r["base"] or 0 for r in sums.collect()}

    def run(parts):
        for pdf in parts:
            for bucket, start, blob in zip(pdf["bucket"], pdf["start_in_bucket"], pdf["blob"]):
                s = Shard(blob)
                ids, begins = s.ids().astype("<u4"), np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                yield pd.DataFrame({"doc_id": pd.array([None if i == NULL_ID else int(i) for i in s.doc_ids], "Int64"), "start": begins + int(start) + base[bucket], "n_tokens": s.ends - begins, "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, s.ends)]})

    # A shard is some MB: few rows at a time.
    return shards.select("bucket", "start_in_bucket", "blob").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def find(spark, path: str, token: int) -> DataFrame:
    """bucket, part, doc_id, position (in its document) of every occurrence of an id, looked up in the shards."""
    shards = spark.read.schema("bucket int, part int, start_in_bucket long, n_ids long, n_docs long, blob binary").parquet(path)

    def run(parts):
        for pdf in parts:
            for bucket, part, blob in zip(pdf["bucket"], pdf["part"], pdf["blob"]):
                s = Shard(blob)
                at = np.array([s.locate(token, k) for k in range(s.count(token))], np.int64)
                doc = np.searchsorted(s.ends, at, side="right")
                yield pd.DataFrame({"bucket": bucket, "part": part, "doc_id": s.doc_ids[doc], "position": at - np.concatenate([[0], s.ends[:-1]]).astype(np.int64)[doc]})

    return shards.select("bucket", "part", "blob").mapInPandas(run, "bucket int, part int, doc_id long, position long")


def query(spark, sf_dir):
    path = new_path(spark, "token_ids")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
