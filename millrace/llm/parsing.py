"""Document fingerprints by locally consistent parsing.

Code points are the first names. On each level equal neighbours are joined into runs; deterministic coin tossing
(the lowest bit in which a name differs from its left neighbour, and that bit, four times over) gives every name
a label below six that differs from its neighbour's; local maxima of the labels begin phrases; a phrase's name is a hash of
the names in it. What a phrase is depends only on a few names around it, so equal substrings share their interior
phrases wherever they stand. A fingerprint is a sketch of the names of ``LEVELS``: for each of ``BINS`` hash bins a level, 16
bits of the least hash. Likeness is the estimated share of phrases in common (Dice), from two fingerprints alone.

Defined cases: a null text counts as empty; the empty text's fingerprint is all zeros, like only itself; ties of
doc_id are ordered by a hash of the text, a null doc_id comes last; a repeated row is a document of its own; a single document is its own next one; long texts are parsed whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, stored, whole_text

LEVELS, BINS = (2, 3), 32
#: Code points parsed at a time (a longer text is parsed alone).
BLOCK = 1 << 20
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K2
    x = (x ^ (x >> np.uint64(29))) * _K1
    return x ^ (x >> np.uint64(32))


def _toss_table() -> np.ndarray:
    a, b = np.arange(128)[:, None], np.arange(128)[None, :]
    x = a ^ b
    k = np.bitwise_count((x & -x) - 1)
    return np.where(x > 0, 2 * k + ((b >> k) & 1), 0).astype(np.uint8).ravel()


_TOSS = _toss_table()


def parse_level(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and where texts begin. ``s``: names of many texts, ``first``: marks each one's first."""
    fresh = first.copy()
    fresh[1:] |= s[1:] != s[:-1]
    at = np.flatnonzero(fresh)
    run = np.diff(at, append=len(s))
    s, first = s[at], first[at]
    s = np.where(run > 1, _mix(s + run.astype(np.uint64) * _K1), s)
    heads = np.flatnonzero(first)
    after = np.minimum(heads + 1, len(s) - 1)
    x = s[1:] ^ s[:-1]
    k = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
    label = np.zeros(len(s), np.uint8)
    label[1:] = np.where(x > 0, np.uint64(2) * k + ((s[1:] >> (k & np.uint64(63))) & np.uint64(1)), 0)
    label[heads] = label[after] ^ 1
    for _ in range(3):
        label[1:] = _TOSS[label[:-1].astype(np.int16) * 128 + label[1:]]
        label[heads] = label[after] ^ 1
    begins = first.copy()
    if len(s) > 2:
        begins[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    at = np.flatnonzero(begins)
    place = np.arange(len(s)) - np.repeat(at, np.diff(at, append=len(s)))
    return _mix(np.add.reduceat(_mix(s ^ ((place + 1).astype(np.uint64) * _K1)), at)), first[at]


def _sketch(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), len(LEVELS) * BINS), np.uint16)
    full = [k for k, x in enumerate(texts) if x]
    if not full:
        return out
    s = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    first = np.zeros(len(s), bool)
    first[np.cumsum([0] + [len(texts[k]) for k in full[:-1]])] = True
    for level in range(1, max(LEVELS) + 1):
        s, first = parse_level(s, first)
        if level in LEVELS:
            least = np.full((len(full), BINS), np.iinfo(np.uint64).max, np.uint64)
            h = _mix(s + np.uint64(level))
            cell = (np.cumsum(first) - 1) * BINS + (h & np.uint64(BINS - 1)).astype(np.int64)
            np.minimum.at(least.ravel(), cell, h >> np.uint64(5))
            kept = (1 + _mix(least) % np.uint64(65535)).astype(np.uint16)
            part = LEVELS.index(level) * BINS
            out[full, part : part + BINS] = np.where(least == np.iinfo(np.uint64).max, 0, kept)
    return out


def sketches(texts: list[str]) -> np.ndarray:
    """A row of 16-bit bins for each text; zero is an empty bin. Rows don't depend on the other texts."""
    parts, block, size = [], [], 0
    for x in texts:
        if block and size + len(x) > BLOCK:
            parts.append(_sketch(block))
            block, size = [], 0
        block.append(x)
        size += len(x)
    return np.concatenate([*parts, _sketch(block)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sketches, row by row: 0 to 1; two empty texts are alike."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(used > 0, 2 * same / np.maximum(used + same, 1), 1.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[str], own: np.ndarray, then: np.ndarray) -> list[pa.Array]:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    new = sketches(changed)
    string = lambda x: [r.astype(">u2").tobytes().hex() for r in x]
    columns = ([len(x) for x in texts], [sha256(x.encode()).hexdigest() for x in changed], string(own), string(new), likeness(own, new), likeness(own, then))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return [pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_docs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: the columns in ``SCHEMA``; the next document is that of the next smaller doc_id.

    Texts are dealt once, by ranges of doc_id; inside a range the next row is at hand. Only each range's first and
    last text meet their neighbours in a second, small step.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]  # many rows of one doc_id, or of none, are more than one range
    dealt = read.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()

        def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
            values = [doc_id, None, None, None, None, None, None, kind, pid, text]
            return pa.RecordBatch.from_pylist([dict(zip(shape.names, values, strict=True))], shape)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        shape = pa.schema(list(zip([*NAMES, "kind", "pid", "text"], kinds, strict=True)))
        ids, texts, own = [], [], np.zeros((0, len(LEVELS) * BINS), np.uint16)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                if not part.num_rows:
                    continue
                new = part.column(1).to_pylist()
                if not ids:
                    yield edge(1, None, new[0])
                ids, texts, own = ids + part.column(0).to_pylist(), texts + new, np.concatenate([own, sketches(new)])
                n = len(ids) - 1
                if n:
                    rest = [pa.array([0] * n, pa.int32()), pa.array([pid] * n, pa.int32()), pa.nulls(n, pa.string())]
                    yield pa.RecordBatch.from_arrays([*_rows(ids[:n], texts[:n], texts[1:], own[:n], own[1:]), *rest], schema=shape)
                ids, texts, own = ids[n:], texts[n:], own[n:]
        if ids:
            yield edge(2, ids[0], texts[0])

    made = stored(dealt.mapInArrow(run, f"{SCHEMA}, kind int, pid int, text string"), "ranges")
    begins = made.where("kind = 1").select("pid", F.col("text").alias("following"))
    ends = made.where("kind = 2").select("pid", "doc_id", "text")
    by_range, everything = Window.orderBy("pid"), Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.coalesce(F.lead("pid").over(by_range), F.first("pid").over(everything))
    turns = begins.select("pid").select("pid", turn.alias("then"))  # numbers of ranges only, no texts, meet in one task
    met = ends.join(turns, "pid").join(begins.withColumnRenamed("pid", "then"), "then").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, texts, then = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays(_rows(ids, texts, then, sketches(texts), sketches(then)), NAMES)

    return made.where("kind = 0").select(*NAMES).unionByName(met.mapInArrow(finish, SCHEMA))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_docs(documents(spark, sf_dir))
