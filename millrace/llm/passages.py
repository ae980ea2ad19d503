"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words. Its anchor is the least of its ``PHRASE``-word phrases by hash, so equal windows
have equal anchors. Anchors are counted over all documents; those that recur are owned by the first document that has them.
Stretches of windows with recurring anchors go to the shard of the anchor's owner. There the owner's phrases are compiled
into an Aho-Corasick automaton and every stretch is streamed through it; each window that holds a phrase the automaton finds is
looked up among the owner's windows, word for word. A window that the owner has is a repeat. The few others are grouped by two 64-bit
hashes to find whether they start earlier in another document. A shard with many stretches is dealt over salted groups that
each get the owner's phrases, so a passage that a third of all documents share makes many groups of bounded size.
Documents without a recurring anchor, and exact copies, aren't streamed: no window of theirs can be decided by that.

Defined cases: a null text counts as having no words; texts under a window long lose nothing; exact copies of a text
(by MD5) are repeats of the smallest doc_id and skip the search; rows that share doc_id and text are one document; rows that share the
doc_id alone are documents of their own, in the order of a hash of the text; rows with a null doc_id lose nothing; texts of any length,
of one repeated word too, take time in proportion to it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.common import documents, release, stored, whole_text

WINDOW, PHRASE = 20, 8
#: Bytes of stretches that a salted group gets on average, and recurring phrases of a shard.
GROUP_BYTES, SHARD_PHRASES = 2 << 20, 20_000
_MUL = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL[1]
    return x ^ (x >> np.uint64(29))


def _grams(h: np.ndarray, n: int, mul: np.uint64) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * mul + h[k : k + size]
    return _mix(out)


def _slide(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``n`` consecutive values."""
    if len(x) < n:
        return x[:0]
    done, step = x, 1
    while step * 2 <= n:
        done, step = best(done[: len(done) - step], done[step:]), step * 2
    size = len(x) - n + 1
    return best(done[:size], done[n - step : n - step + size])


class Words:
    """A stretch of words: anchors, the anchor of each window, and the windows' hashes."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.hash = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
        self.phrases = _grams(self.hash, PHRASE, _MUL[0])
        self.least = _slide(self.phrases, WINDOW - PHRASE + 1, np.minimum)  # the anchor of each window
        size = WINDOW - PHRASE
        if len(self.least):
            padded = np.concatenate([np.zeros(size, np.uint64), self.least, np.zeros(size, np.uint64)])
            self.anchors = np.flatnonzero(_slide(padded, size + 1, np.maximum) == self.phrases)
        else:
            self.anchors = np.zeros(0, np.int64)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return _grams(self.hash, WINDOW, _MUL[0]), _grams(self.hash, WINDOW, _MUL[1])


def _ranges(at: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cuts + 1])].tolist(), at[np.concatenate([cuts, [len(at) - 1]])].tolist(), strict=True))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            hs, ids, again = [], [], []
            for doc_id, text in zip(*(c.slice(i, 500).to_pylist() for c in batch.columns), strict=True):
                own = Words(text.encode().split())
                h, n = np.unique(own.phrases[own.anchors], return_counts=True)
                hs.append(h.view(np.int64))
                ids.append(np.full(len(h), doc_id, np.int64))
                again.append(n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, again)], ["h", "doc_id", "again"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows by the owner of their anchors: a document's own as role 0, those to be looked up as role 1."""
    names = ["owner", "doc_id", "role", "start", "words"]
    for batch in batches:
        out = []
        for doc_id, text, hs, owners, again in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = Words(text.encode().split())
            order = np.argsort(hs)
            h = np.array(hs, np.int64)[order]
            who, twice = np.array(owners, np.int64)[order], np.array(again, bool)[order]
            least = own.least.view(np.int64)
            k = np.minimum(np.searchsorted(h, least), len(h) - 1)
            hit = h[k] == least
            for owner in np.unique(who).tolist():
                mine = hit & (who[k] == owner)
                found = [(0, mine)] if owner == doc_id else [(1, mine)]
                if owner == doc_id and (twice & (who == owner)).any():
                    found.append((1, mine & twice[k]))
                for role, which in found:
                    for a, b in _ranges(np.flatnonzero(which)):
                        out.append((owner, doc_id, role, a, b" ".join(own.words[a : b + WINDOW]).decode()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], names)


FOUND = "doc_id long, first long, last long, w1 long, w2 long"


def _offsets(text: bytes) -> np.ndarray:
    """Where each word of ``text`` (words joined by one space) begins, and its end plus one."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1]])


def _lookup(group: pd.DataFrame) -> pd.DataFrame:
    """Ranges of window starts that an owner has (w1 null), and single windows that it hasn't (w1, w2 their hashes).

    The owners' phrases are compiled into an automaton, and the first place of each of their windows is kept by its words. The automaton
    goes through every stretch, and each window that holds a phrase it has found is looked up by its words.
    """
    machine = ahocorasick.Automaton()
    first: dict[bytes, tuple[int, int]] = {}
    for r in group[group.role == 0].itertuples():
        text = r.words.encode()
        own, at = Words(text.split()), _offsets(text).tolist()
        for i in own.anchors.tolist():
            machine.add_word(f" {text[at[i] : at[i + PHRASE] - 1].decode()} ", PHRASE)
        for i in range(len(own.least)):
            place = (r.doc_id, r.start + i)
            window = text[at[i] : at[i + WINDOW] - 1]
            if place < first.get(window, (place[0], place[1] + 1)):
                first[window] = place
    if not len(machine):
        return pd.DataFrame(columns=["doc_id", "first", "last", "w1", "w2"])
    machine.make_automaton()
    out = []
    for r in group[group.role == 1].itertuples():
        text = r.words.encode()
        own, at = Words(text.split()), _offsets(text)
        padded = f" {r.words} "
        ends = np.fromiter((end for end, _ in machine.iter(padded)), np.int64)  # at the space behind a phrase
        # spaces[k]: the space before word k, in characters
        spaces = np.concatenate([[0], np.cumsum(np.fromiter(map(len, r.words.split(" ")), np.int64, len(own.words)) + 1)])
        behind = np.searchsorted(spaces, ends)  # the word behind each phrase
        holds = np.zeros(len(own.words) + 2, np.int64)  # windows that hold a phrase, as steps up and down
        np.add.at(holds, np.maximum(behind - WINDOW, 0), 1)
        np.add.at(holds, behind - PHRASE + 1, -1)
        size = len(own.least)
        near = np.flatnonzero(np.cumsum(holds)[:size] > 0)
        same = np.zeros(size, bool)
        for i in near.tolist():
            found = first.get(text[at[i] : at[i + WINDOW] - 1])
            same[i] = found is not None and found < (r.doc_id, r.start + i)
        out += [(r.doc_id, r.start + x, r.start + y, None, None) for x, y in _ranges(np.flatnonzero(same))]
        if r.doc_id != getattr(r, "owner"):
            rest = np.flatnonzero(~same)
            a, b = own.windows()
            out += zip([r.doc_id] * len(rest), (r.start + rest).tolist(), (r.start + rest).tolist(), a[rest].view(np.int64).tolist(), b[rest].view(np.int64).tolist(), strict=True)
    frame = pd.DataFrame(out, columns=["doc_id", "first", "last", "w1", "w2"])
    return frame.astype({"w1": "Int64", "w2": "Int64"})


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id and ``ranges``, the (first, last) starts of its windows that start earlier elsewhere; ``docs``: doc_id, text, distinct texts."""
    anchors = docs.mapInArrow(_anchors, "h long, doc_id long, again boolean")
    recurring = anchors.groupBy("h").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n"), F.bool_or("again").alias("any"))
    recurring = stored(recurring.where("n > 1 or any").select("h", "owner"), "recurring")  # as a table, so that AQE can split a hot phrase's join
    hits = anchors.join(recurring, "h").groupBy("doc_id").agg(F.collect_set(F.struct("h", "owner", "again")).alias("x"))
    wide = docs.join(hits, "doc_id").select("doc_id", "text", "x.h", "x.owner", "x.again")
    stretches = stored(wide.mapInArrow(_stretches, "owner long, doc_id long, role int, start long, words string"), "stretches")
    release(recurring)
    size = F.sum(F.length("words"))
    shards = max(1, -(-(stretches.where("role = 0").agg(size.alias("n")).first()["n"] or 0) // (50 * SHARD_PHRASES)))
    parts = stretches.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    salts = stored(parts.where("role = 1").groupBy("shard").agg(F.ceil(size / GROUP_BYTES).alias("salts")), "salts")
    salted = parts.join(salts, "shard")
    salt = F.when(F.col("role") == 0, F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("salts"))))
    dealt = salted.withColumn("salt", F.explode(salt))
    found = stored(dealt.groupBy("shard", "salt").applyInPandas(_lookup, FOUND), "found")
    release(stretches, salts)
    odd = found.where("w1 is not null")
    least = odd.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "first")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = odd.join(least, ["w1", "w2"]).where("doc_id <> f.doc_id or first <> f.first").select("doc_id", "first", "last")
    return found.where("w1 is null").select("doc_id", "first", "last").unionByName(late).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


def numbered(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, th) with id, their number in the order of doc_id, then th; the counts of the sorted ranges are a row each."""
    dealt = keys.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    ranged = stored(dealt.select("doc_id", "th", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("no")), "ranged")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.alias("s").join(sizes.alias("o"), F.expr("o.part < s.part"), "left").groupBy("s.part").agg(F.coalesce(F.sum("o.n"), F.lit(0)).alias("base"))
    return ranged.join(F.broadcast(before), "part").select("doc_id", "th", (F.col("base") + F.col("no")).alias("id"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, gone, hashes, texts = [], [], [], []
        for text, copy, ranges in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            words = text.encode().split()
            stay = np.ones(len(words), bool)
            if copy and len(words) >= WINDOW:
                stay[:] = False
            for r in ranges or ():
                stay[r["first"] : r["last"] + WINDOW] = False
            left = b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s) if ranges or not stay.all() else b" ".join(words)
            totals.append(len(words))
            gone.append(len(words) - int(stay.sum()))
            hashes.append(sha256(left).hexdigest())
            texts.append(left.decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256 and kept, the words that stay."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).withColumn("th", F.xxhash64("text"))
    pairs = read.where("doc_id is not null").select("doc_id", "th")
    rows = pairs.groupBy("doc_id").agg(F.min("th").alias("a"), F.max("th").alias("z"), F.count(F.lit(1)).alias("n"))
    odd = rows.agg(F.bool_or(F.expr("a <> z")).alias("shared"), F.bool_or(F.expr("n > 1")).alias("repeated")).first()
    if odd["shared"]:  # different texts of one doc_id: documents of their own, so they get numbers of their own in the same order
        read = read.join(stored(numbered(pairs.distinct()), "numbered"), ["doc_id", "th"], "left")
    else:
        read = read.withColumn("id", F.col("doc_id"))
    named = read.where("id is not null").select("id", F.md5("text").alias("key"))
    first = stored(named.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    copies = stored(named.join(first, "key").where("id <> first").select("id").distinct(), "copies")
    own = read.where("id is not null").join(copies, "id", "left_anti").select(F.col("id").alias("doc_id"), "text")
    if odd["repeated"]:
        own = own.distinct()
    found = repeats(own).withColumnRenamed("doc_id", "id")
    ranges = stored(found.unionByName(copies.select("id", F.lit(None).cast("array<struct<first:long,last:long>>").alias("ranges"))), "ranges")
    release(first, copies)
    marked = ranges.withColumn("copy", F.col("ranges").isNull())
    joined = read.join(marked, "id", "left")
    return joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ranges").mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir)).drop("kept")
