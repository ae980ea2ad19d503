"""Byte-level BPE encoding and decoding by a two-tier lookup.

Each text is split by the tokenizer's pattern. A pre-token that is a vocabulary entry is resolved by one
probe of a minimal perfect hash over the vocabulary (hash and displace, one slot for each entry); any other
pre-token is merged by a heap of adjacent pairs over a linked list of its bytes, lowest rank and leftmost first.

Defined cases: a null text counts as empty and has no ids; texts and pre-tokens of any length are encoded whole
(the heap is O(n log n)); repeated rows are each returned; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.common import documents, whole_text

#: Pre-tokens kept by a Python worker between batches, and the longest one that is kept.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 64
_BUCKET_KEYS = 2


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, ordered by rank (ranks are 0 to n - 1)."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    vocab = [b""] * len(pairs)
    for token, rank in pairs:
        vocab[int(rank)] = base64.b64decode(token)
    return vocab


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``n`` keys, ``n`` slots, one displacement for each bucket."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, -(-n // _BUCKET_KEYS))
        self.shift = np.zeros(self.buckets, np.int64)
        self.rank = np.full(n, -1, np.int64)
        h = self._hashes(keys)
        members: dict[int, list[int]] = {}
        for k, b in enumerate((h % np.uint64(self.buckets)).tolist()):
            members.setdefault(b, []).append(k)
        taken = np.zeros(n, bool)
        free = 0
        for b, own in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(own) == 1:  # a lone key takes the next free slot; the slot is stored as a negative shift
                while taken[free]:
                    free += 1
                slots = np.array([free])
                self.shift[b] = -1 - free
            else:
                for d in range(0, 1 << 40, 256):  # 256 displacements at a time
                    tried = self._slot(h[own], np.arange(d, d + 256)[:, None])
                    in_order = np.sort(tried, axis=1)
                    fits = ~taken[tried].any(axis=1) & (np.diff(in_order, axis=1) > 0).all(axis=1)
                    if fits.any():
                        slots = tried[fits.argmax()]
                        self.shift[b] = d + int(fits.argmax())
                        break
            taken[slots] = True
            self.rank[slots] = own

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxh64_intdigest(k, 1) for k in keys), np.uint64, len(keys))

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only rank each key can have; the caller compares the entry itself."""
        h = self._hashes(keys)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.rank[np.where(d < 0, -1 - d, self._slot(h, d))]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: a heap of (rank, position) over bytes linked by their ends."""
    n = len(piece)
    ends = list(range(1, n + 1))  # of the part that starts here; 0 when merged into the one before
    before = list(range(-1, n - 1))
    get, wide = ranks.get, n + 1
    heap = []
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            heap.append((r * wide + i) * wide + i + 2)
    heapq.heapify(heap)
    while heap:
        entry, end = divmod(heapq.heappop(heap), wide)
        i = entry % wide
        mid = ends[i]
        if not mid or mid >= n or ends[mid] != end:
            continue  # one of the parts has changed since
        ends[i], ends[mid] = end, 0
        if end < n:
            before[end] = i
            if (r := get(piece[i : ends[end]])) is not None:
                heapq.heappush(heap, (r * wide + i) * wide + ends[end])
        if i and (r := get(piece[before[i] : end])) is not None:
            heapq.heappush(heap, (r * wide + before[i]) * wide + end)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class Codec:
    """Encodes and decodes with one vocabulary; remembers pre-tokens up to a bound."""

    def __init__(self, vocab: list[bytes], pattern: str, table: PerfectHash | None = None):
        self.vocab, self.split = vocab, regex.compile(pattern).findall
        self.ranks = {token: k for k, token in enumerate(vocab)}
        self.table = table or PerfectHash(vocab)
        self.known: dict[str, bytes] = {}

    def _resolve(self, new: list[str]) -> dict[str, bytes]:
        raw = [x.encode() for x in new]
        out = {}
        for token, piece, rank in zip(new, raw, self.table.find(raw).tolist(), strict=True):
            hit = rank >= 0 and self.vocab[rank] == piece
            out[token] = np.array([rank] if hit else merge(piece, self.ranks), "<u4").tobytes()
        return out

    def encode_batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for text in texts:
            parts = self.split(text)
            known = self.known
            if len(known) > CACHE_ENTRIES:
                known.clear()
            if new := [x for x in set(parts) if x not in known]:
                found = self._resolve(new)
                if any(len(x) > CACHE_CHARS for x in new):
                    known.update((k, x) for k, x in found.items() if len(k) <= CACHE_CHARS)
                    known = {x: found.get(x) or known[x] for x in set(parts)}
                else:
                    known.update(found)
            yield b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple, Codec] = {}


def _codec(vocab: list[bytes], pattern: str, table: PerfectHash, key: tuple) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocab, pattern, table)
    return _codecs[key]


def encode_texts(docs: DataFrame, rank_path: str, pattern: str, *, with_ids: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if ``with_ids``.

    The decoded bytes are made from the ids alone. The vocabulary is broadcast: it is a file of fixed size.
    """
    entries = read_ranks(rank_path)
    vocab = docs.sparkSession.sparkContext.broadcast((entries, PerfectHash(entries)))
    key = (rank_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(vocab.value[0], pattern, vocab.value[1], key)
        for batch in batches:
            counts, hashes, decoded, ids = [], [], [], []
            for own in codec.encode_batch(x.as_py() for x in batch.column(1)):
                counts.append(len(own) // 4)
                hashes.append(sha256(own).hexdigest())
                decoded.append(sha256(codec.decode(own)).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(own, "<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, rank_path: str) -> DataFrame:
    """Per row of ``encoded`` (doc_id, ids): doc_id and the decoded bytes; null ids count as none."""
    vocab = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b"".join(vocab.value[k] for k in x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_texts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
