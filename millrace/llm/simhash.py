"""SimHash near-duplicate groups by tiled exact comparison.

Every distinct fingerprint goes to the cell of its two halves' population counts. Fingerprints within the radius
have cells whose counts differ by no more than the radius in sum, so only such cells' tiles are compared; all others
are skipped. A tile pair is compared whole with numpy exclusive-or and bit counts, and gives back a spanning
forest of its links, not all of them, so a large group of near copies stays linear. Components come from a
distributed union-find over those links.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and is linked like any other;
texts of under four words have one shingle, the whole sequence; texts of any length are read whole; repeated rows and rows that share a
doc_id are each returned, with the component of their own text; rows with a null doc_id take part in no component and get a null one;
an empty table gives an empty result; other columns are not read, and ``one_of_each`` keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm.common import components, cut, documents, release, stored, whole_text

SHINGLE_WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints a tile holds on average, and hashes whose bits are counted at a time.
TILE, CHUNK = 2048, 1 << 16


def fingerprint(text: str, k: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text, as an unsigned integer."""
    words = text.encode().lower().split()  # bytes: lower() is A-Z only, split() is at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = (ends - length).tolist()
    if len(words) < k:
        h = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        h = np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=False)), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), CHUNK):
        part = h[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and th (a hash of the text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "th"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return read.withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, th long")


def spanning_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of ``left`` and ``right`` that the pairs within ``radius`` between them join."""
    a, b = [], []
    for i in range(0, len(left), 256):
        near = np.bitwise_count(left[i : i + 256, None] ^ right[None, :]) <= radius
        x, y = np.nonzero(near)
        a.append(left[x + i])
        b.append(right[y])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = a[a != b], b[a != b]
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        old = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == old).all():
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def near_links(points: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    low, high = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("fp", 32))
    keyed = points.select("fp").distinct().select("fp", low.alias("lo"), high.alias("hi"))
    sizes = keyed.groupBy("lo", "hi").agg(F.ceil(F.count(F.lit(1)) / tile).alias("n"))  # 33 x 33 rows at most
    dealt = keyed.join(F.broadcast(sizes), ["lo", "hi"]).withColumn("no", F.pmod(F.xxhash64("fp"), F.col("n")))
    tiles = cut(dealt.groupBy("lo", "hi", "no").agg(F.collect_list("fp").alias("fps")))  # about `tile` values each
    names = tiles.select("lo", "hi", "no")
    steps = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])).alias("s")
    near = names.select(F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("no").alias("no1"), step)
    near = near.withColumns({"lo": F.col("lo1") + F.col("s.i"), "hi": F.col("hi1") + F.col("s.j")}).drop("s")
    pairs = near.join(names, ["lo", "hi"]).where("lo1 < lo or hi1 < hi and lo1 = lo or lo1 = lo and hi1 = hi and no1 <= no")
    left = tiles.select(F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("no").alias("no1"), F.col("fps").alias("left"))
    both = pairs.join(left, ["lo1", "hi1", "no1"]).join(tiles, ["lo", "hi", "no"]).select("left", F.col("fps").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                a, b = spanning_links(*(np.asarray(z.values).view(np.uint64) for z in (x, y)), radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(z.view(np.int64)) for z in (a, b)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp and component_id of every row, and th, a hash of its text."""
    prints = stored(fingerprints(docs), "prints")
    n = prints.count()
    first = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"))
    found = components(near_links(prints.where("doc_id is not null"), radius), "a", "b")
    member = stored(first.join(found, first.fp == found.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root")), "member", rows=n)
    least = stored(member.groupBy("root").agg(F.min("doc").alias("component_id")), "least", rows=n)
    of = stored(member.join(least, "root").select("fp", "component_id"), "of", rows=n)
    release(member, least)
    owned = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "th", owned)


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    return _grouped(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row left of each group: of those with the smallest doc_id the one whose text has the least hash.

    Of rows that share doc_id and text one stays. Rows without doc_id all stay.
    """
    groups = _grouped(docs, radius).where("doc_id is not null").groupBy("component_id", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    keep = stored(groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "th", "n")).alias("k")).select("k.*"), "keep")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th"))
    left = own.join(keep, ["doc_id", "th"])
    once = left.where("n = 1").select("row").unionByName(left.where("n > 1").groupBy("doc_id", "th").agg(F.first("row").alias("row")).select("row"))
    return once.unionByName(own.where("doc_id is null").select("row")).select("row.*")


def op8_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
