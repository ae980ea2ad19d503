"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words and the COMMON words that most blocks of BLOCK words of all texts have. Weights are logarithms of
how rare a term is among those blocks; every word of every text is counted. A randomised SVD of the TF-IDF rows of a bounded sample's passages
and of the items, its products made on the executors, gives a basis of fewer dimensions than there are items (DIMS at most). Items are projected
into it whole, or, if long, in pieces; every text is projected word by word, and windows of it, of the lengths in WINDOWS and moved by
a quarter or half of that, are searched by their cosine with the items of that length. Words that are no terms have no part in it, so a passage is
found at any corpus size and whatever stands around it. For each candidate the longest common subsequence with the words around the window decides:
at least ``COPY`` of the item's words is a copy; at least ``PARAPHRASE`` with the item's answer (its last words) there too is a
paraphrase.

All items of a block of ITEM_BLOCK are searched in one pass over the corpus; the driver holds one block of items and its basis.

Defined cases: null texts count as empty on both sides; empty items match nothing; items with a null id are
left out; repeated items of an id count once each; rows that share a doc_id are searched each and reported once; rows
with a null doc_id are never reported, and stay in ``drop_leaks``; empty tables give no leaks; texts and items of any length are
searched whole; of equal shares of an item the copy, then the greater cosine is reported; other columns are not read, and ``drop_leaks``
keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, release, stored, whole_text

BLOCK, COPY, PARAPHRASE = 24, 0.8, 0.6
#: Lengths of windows, in words. An item is searched in the shortest that holds it, a longer one in pieces of the last length.
WINDOWS = (8, 16, 32, 64)
#: Cosine of a candidate.
COSINE = 0.45
#: Latent dimensions at most, extra ones of the random range finder, documents whose passages the basis is fitted on, common words that
#: are terms, items of a pass, and the items' energy in the fit.
DIMS, EXTRA, SAMPLE_DOCS, COMMON, ITEM_BLOCK, ITEM_ENERGY = 128, 16, 1000, 2048, 20_000, 2.0
#: Words projected at a time, so that their vectors stay in a core's cache.
PIECE = 4096
#: Words that a ``Lookup`` remembers between texts; texts of a row of ``split_texts``, and words (of WORD_CHARS characters) with which it is full.
KNOWN, TEXTS, TEXT_WORDS, WORD_CHARS = 500_000, 1000, 400_000, 6
#: Rows of ``split_texts``, and texts before they are split, that a task holds at once.
SPLIT_GROUP, SPLIT_BATCH = 2, 200
MARKS = ".,;:!?\"'()"


def words_of(text: str) -> list[str]:
    return [x for x in (w.strip(MARKS) for w in text.lower().split()) if x]


class Lookup(dict):
    """Term ids by words as they stand in texts; a word that is new is looked up without its marks and remembered."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        k = self[word] = self.ids.get(word.strip(MARKS), -1)
        return k


class Terms:
    """Ids of the items' words and of ``more``."""

    def __init__(self, items: list[tuple[int, str]], more: list[str]):
        self.items = [(i, words_of(t)) for i, t in items]
        self.ids: dict[str, int] = {}
        for words in (*(w for _, w in self.items), more):
            for w in words:
                self.ids.setdefault(w, len(self.ids))
        self.lookup = Lookup(self.ids)
        self.words = pa.array(self.ids, pa.string())  # in the order of their ids
        self.rows = [np.array([self.ids[w] for w in words], np.int64) for _, words in self.items]
        self.all = np.concatenate(self.rows) if self.rows else np.zeros(0, np.int64)
        self.lengths = np.array([len(r) for r in self.rows], np.int64)

    def numbers(self, words: pa.StringArray) -> np.ndarray:
        """Term ids of words without their marks, -1 for other words."""
        return np.asarray(pc.index_in(words, value_set=self.words).fill_null(-1))

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """For each item whether at least PARAPHRASE of its words are in a text at all; ``verify`` accepts no other."""
        there = np.zeros(len(self.ids), np.int32)
        there[ids[ids >= 0]] = 1
        return np.add.reduceat(there[self.all], np.cumsum(self.lengths) - self.lengths) >= PARAPHRASE * self.lengths

    def of(self, text: str) -> np.ndarray:
        """Term ids in order, -1 for other words."""
        words = text.lower().split()
        return np.fromiter(map(self.lookup.__getitem__, words), np.int32, len(words))


def common_length(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    masks: dict[int, int] = {}
    for k, t in enumerate(item.tolist()):
        masks[t] = masks.get(t, 0) | 1 << k
    full = (1 << len(item)) - 1
    left = full
    for t in words.tolist():
        if m := masks.get(t):
            u = left & m
            left = ((left + u) | (left - u)) & full
    return len(item) - left.bit_count()


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def sampled(docs: DataFrame) -> DataFrame:
    """The texts of SAMPLE_DOCS documents, by a hash of doc_id; of a doc_id with several texts the least."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS)
    own = _read(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return stored(own.select("text").repartition(8), "sample")


def in_blocks(ids: np.ndarray, lengths: np.ndarray, m: int) -> np.ndarray:
    """In how many blocks of BLOCK words each of ``m`` words is, of texts of ``lengths`` words that stand in one row; for word 0 the number of blocks."""
    blocks = -(-lengths // BLOCK)
    at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = at // BLOCK + np.repeat(np.cumsum(blocks) - blocks, lengths)
    pairs = np.sort(at * m + ids)
    n = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % m, minlength=m)
    n[0] = blocks.sum()
    return n


def split_texts(docs: DataFrame) -> DataFrame:
    """The words of the whole text of every row, stored, so that texts are split once.

    A row holds texts until they are TEXTS or have TEXT_WORDS words: their doc_ids, their lengths in words, the numbers of their words one
    after the other, and for each number the word and in how many blocks of these texts it is.
    """

    def row(ids: list[int | None], own: list[str]) -> pa.RecordBatch:
        each = pc.utf8_split_whitespace(pa.array([x or None for x in own], pa.string()))  # at the characters of str.split(); no text begins or ends with one
        lengths = np.asarray(pc.list_value_length(each).fill_null(0)).astype(np.int64)
        bare = pa.concat_arrays([pa.array([""]), pc.ascii_trim(each.flatten(), characters=MARKS)]).dictionary_encode()
        k = np.asarray(bare.indices)[1:]  # 0 is the number of the empty word
        n = in_blocks(k, lengths, len(bare.dictionary))
        columns = ((pa.array(ids, pa.int64()), pa.int64()), (lengths, pa.int32()), (k, pa.int32()), (bare.dictionary, pa.string()), (n, pa.int64()))
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t) if isinstance(x, np.ndarray) else x) for x, t in columns]
        return pa.RecordBatch.from_arrays(arrays, ["doc_ids", "lengths", "ids", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                own.append(text.as_py().lower().strip())
                size += len(own[-1])
                if len(own) == TEXTS or size >= TEXT_WORDS * WORD_CHARS:
                    yield row(ids, own)
                    ids, own, size = [], [], 0
        if own:
            yield row(ids, own)

    return stored(_read(docs).mapInArrow(run, "doc_ids array<long>, lengths array<int>, ids array<int>, words array<string>, n array<long>"), "split", "zstd", group=SPLIT_GROUP, batch=SPLIT_BATCH)


def word_counts(split: DataFrame) -> DataFrame:
    """word and n, in how many blocks of all texts it is, of every word there is; stored. The empty word's n is the number of blocks."""
    each = split.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("n").alias("n"))))
    return stored(each.groupBy("word").agg(F.sum("n").alias("n")), "words", "zstd")


def common_words(counts: DataFrame) -> list[str]:
    """The COMMON words that most blocks of all texts have."""
    top = counts.where("word <> ''").orderBy(F.desc("n"), "word").limit(COMMON)
    return [r["word"] for r in top.collect()]


def block_counts(counts: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """In how many blocks of all texts each term is, and the number of blocks."""
    shared = counts.sparkSession.sparkContext.broadcast(pa.concat_arrays([terms.words, pa.array([""])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pc.index_in(batch.column(0), value_set=shared.value)
            hit = own.is_valid()
            yield pa.RecordBatch.from_arrays([own.filter(hit).cast(pa.int64()), batch.column(1).filter(hit)], ["term", "n"])

    n = np.zeros(len(terms.ids) + 1, np.int64)
    for r in counts.mapInArrow(run, "term long, n long").collect():  # a row a term
        n[r["term"]] = r["n"]
    shared.unpersist()
    return n[:-1], int(n[-1])


def term_ids(batch: pa.RecordBatch, terms: Terms) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """For each row of ``split_texts`` the doc_ids and the term ids of the texts in order, -1 for other words."""
    for doc_ids, lengths, ids, words in zip(*batch.columns, strict=True):
        known = terms.numbers(words.values)
        yield doc_ids.as_py(), np.split(known[np.asarray(ids.values)], np.cumsum(np.asarray(lengths.values))[:-1])


def tf_idf(ids: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """A unit row for each passage of ``length`` words, moved by half of that; ids of -1 count for nothing."""
    half = max(1, length // 2)
    at = np.flatnonzero(ids >= 0)
    count = max(1, -(-len(ids) // half) - 1)
    rows = np.zeros((count + 2, len(weight)), np.float32)
    np.add.at(rows, (np.minimum(at // half, count - 1) + 1, ids[at]), weight[ids[at]])
    np.add.at(rows, (at // half, ids[at]), weight[ids[at]] * (at // half > 0) * (at // half < count))
    rows = rows[1 : count + 1]
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def fit_basis(sample: DataFrame, items: np.ndarray, terms: Terms, weight: np.ndarray) -> np.ndarray:
    """An orthonormal basis (terms x dims) of the leading directions of the sample's passages and the items' rows.

    A randomised SVD with one power step: executors add up A'(A M) for the rows A of their passages, and the items' part is added on the
    driver. What is sent at a time has terms x (dims + extra) numbers.
    """
    n = len(terms.ids)
    dims = max(1, min(DIMS, n, len(items) - 1))
    width = min(n, dims + EXTRA)
    context = sample.sparkSession.sparkContext

    def product(m: np.ndarray) -> np.ndarray:
        shared = context.broadcast((terms, weight, m.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, w, right = shared.value
            total, count = np.zeros_like(right), 0
            for batch in batches:
                for text in batch.column(0):
                    ids = known.of(text.as_py())
                    for lo in range(0, len(ids), PIECE):
                        a = tf_idf(ids[lo : lo + PIECE], w, 2 * BLOCK)
                        total += a.T @ (a @ right)
                        count += len(a)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right) + 1)), pa.array([r.tobytes() for r in total] + [np.int64(count).tobytes()])], ["term", "row"])

        z, count = np.zeros_like(m), 0
        for r in sample.mapInArrow(run, "term long, row binary").toLocalIterator():  # 8 tasks' sums
            if r["term"] < n:
                z[r["term"]] += np.frombuffer(r["row"], np.float32)
            else:
                count += int(np.frombuffer(r["row"], np.int64)[0])
        shared.unpersist()
        return z + ITEM_ENERGY * max(1, count) / len(items) * (items.T @ (items @ m))

    q, _ = np.linalg.qr(product(np.random.default_rng(7).standard_normal((n, width))))
    z = product(q)
    values, vectors = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
    return (q @ vectors[:, np.argsort(values)[::-1][:dims]]).astype(np.float32)


def verify(item: np.ndarray, words: np.ndarray) -> tuple[str, float]:
    """Kind of leak ("" for none) and the share of the item's words in order among ``words``.

    No common subsequence is longer than the item's words that occur at all, so where those are too few none is looked for.
    """
    there = set(words.tolist())
    share = len([t for t in item.tolist() if t in there]) / len(item)
    if share < PARAPHRASE:
        return "", share
    share = common_length(item, words) / len(item)
    if share >= COPY:
        return "copy", share
    answer = item[-max(3, len(item) // 5) :]
    if share >= PARAPHRASE and common_length(answer, words) >= PARAPHRASE * len(answer):
        return "paraphrase", share
    return "", share


def pieces(rows: list[np.ndarray]) -> list[tuple[int, int, np.ndarray]]:
    """(item, window length, ids) of each item, or of the pieces of one that is longer than the last of WINDOWS."""
    out = []
    for k, row in enumerate(rows):
        step = WINDOWS[-1]
        parts = [row] if len(row) <= step else [row[max(0, min(i, len(row) - step)) :][:step] for i in range(0, len(row), step)]
        out += [(k, next(w for w in WINDOWS if len(p) <= w), p) for p in parts]
    return out


class Index:
    """The items' latent images by window length, and the latent vector of each term; the last row is that of no term."""

    def __init__(self, rows: list[np.ndarray], basis: np.ndarray, weight: np.ndarray):
        self.vectors = np.vstack([basis * weight[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        self.images: list[tuple[int, list[tuple[int, np.ndarray]], np.ndarray]] = []
        parts = pieces(rows)
        for length in WINDOWS:
            own = [(k, ids) for k, w, ids in parts if w == length]
            if own:
                image = np.array([self.vectors[ids].sum(axis=0) for _, ids in own])
                image /= np.maximum(np.linalg.norm(image, axis=1, keepdims=True), 1e-9)
                self.images.append((length, own, np.ascontiguousarray(image.T, np.float32)))
        #: Words whose vectors are added up before windows are made of them.
        self.step = max(1, self.images[0][0] // 2) if self.images else 1
        self.step = min(self.step, 8)

    def candidates(self, ids: np.ndarray, inside: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]]:
        """Starts, window length, items' pieces, numbers of pieces and cosines of the windows of ``ids`` that begin ``inside`` and have a
        cosine of at least COSINE with a piece.

        Windows of a length are moved by a quarter of it, or by ``step``. Of those of one piece that begin within half its length the first
        is given: the words around it hold the others' words.
        """
        step, tail = self.step, WINDOWS[-1]
        for lo in range(0, len(ids), PIECE):
            part = ids[lo : lo + PIECE + tail]
            part = np.concatenate([part, np.full(-len(part) % step, -1, ids.dtype)])
            blocks = self.vectors[part].reshape(-1, step, self.vectors.shape[1]).sum(axis=1)
            sums = np.zeros((len(blocks) + 1, blocks.shape[1]), np.float32)
            np.cumsum(blocks, axis=0, out=sums[1:])
            for length, items, image in self.images:
                starts = np.arange(0, min(PIECE // step, len(blocks)), max(1, length // step // 4))
                places = lo + starts * step
                held = (places < len(ids)) & inside[np.minimum(places, len(ids) - 1)]
                starts, places = starts[held], places[held]
                y = sums[np.minimum(starts + length // step, len(blocks))] - sums[starts]
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), 1e-6)
                cosine = y @ image
                i, j = np.nonzero(cosine >= COSINE * norm[:, None])
                if len(i):
                    half = np.array([max(1, len(ids) // 2) for _, ids in items])
                    _, first = np.unique(j * (len(ids) + 1) + places[i] // half[j], return_index=True)
                    first.sort()
                    i, j = i[first], j[first]
                    yield places[i], length, items, j, cosine[i, j] / norm[i]


def searched(known: Terms, index: Index, own: list[np.ndarray]) -> list[dict[int, tuple[float, str, float]]]:
    """For each text (its term ids) the share, kind and cosine of the items that leak into it.

    Texts in which no item is possible are left out; the others are searched in one row with gaps in between that no window spans, each
    beginning at a multiple of the index's step. Of a long item the piece that was found is looked for first.
    """
    tail = WINDOWS[-1]
    best: list[dict[int, tuple[float, str, float]]] = [{} for _ in own]
    possible = np.array([known.possible(x) for x in own]).reshape(len(own), len(known.rows))
    some = np.flatnonzero(possible.any(axis=1))
    if not len(some):
        return best
    gaps = [np.full(tail + -len(own[d]) % index.step, -1, np.int32) for d in some]
    begins = np.cumsum([0] + [len(own[d]) + len(g) for d, g in zip(some, gaps, strict=True)])
    row = np.concatenate([x for d, g in zip(some, gaps, strict=True) for x in (own[d], g)])
    inside = np.concatenate([x for d, g in zip(some, gaps, strict=True) for x in (np.ones(len(own[d]), bool), np.zeros(len(g), bool))])
    for places, length, pieces_, numbers, cosines in index.candidates(row, inside):
        docs = np.searchsorted(begins, places, side="right") - 1
        places, docs = places - begins[docs], some[docs]
        held = possible[docs, np.array([k for k, _ in pieces_])[numbers]]
        for d, at, j, cosine in zip(*(x[held].tolist() for x in (docs, places, numbers, cosines)), strict=True):
            k, piece = pieces_[j]
            text, item, last = own[d], known.rows[k], best[d].get(k, (0.0, "", 0.0))
            if last[0] == 1.0:
                continue
            if len(piece) < len(item) and common_length(piece, text[max(0, at - len(piece)) : at + length + len(piece)]) < PARAPHRASE * len(piece):
                continue
            kind, share = verify(item, text[max(0, at - len(item)) : at + length + len(item)])
            if kind and (share, kind == "copy", cosine) > (last[0], last[1] == "copy", last[2]):
                best[d][k] = (share, kind, cosine)
    return best


SCHEMA = "doc_id long, item_id long, kind string, share double, cosine double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that leaks into it: doc_id, item_id, kind, share (of the item's words), cosine."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().orderBy("item_id", "text")
    everything = ((r["item_id"], r["text"]) for r in items.toLocalIterator())  # the stated query set, a block at a time
    found, sample = spark.createDataFrame([], SCHEMA), None
    while block := list(islice(everything, ITEM_BLOCK)):
        if block := [x for x in block if words_of(x[1])]:
            if not sample:
                sample, split = sampled(docs), split_texts(docs)
                counts = word_counts(split)
                common = common_words(counts)
            found = found.unionByName(_leaks(split, sample, counts, Terms(block, common)))
    if sample:
        release(sample, split, counts)
    by_rank = F.struct(F.col("share"), F.col("kind") == "copy", F.col("cosine"), F.col("kind"))
    best = found.where("doc_id is not null").groupBy("doc_id", "item_id").agg(F.max(by_rank).alias("x"))
    return best.select("doc_id", "item_id", "x.kind", "x.share", "x.cosine")


def _leaks(split: DataFrame, sample: DataFrame, counts: DataFrame, terms: Terms) -> DataFrame:
    n, blocks = block_counts(counts, terms)
    weight = np.maximum(np.log((blocks + 1) / (n + 1)), 0.1).astype(np.float32)
    rows = np.concatenate([tf_idf(row[: WINDOWS[-1]], weight, 2 * WINDOWS[-1]) for row in terms.rows])
    index = Index(terms.rows, fit_basis(sample, rows, terms, weight), weight)
    shared = split.sparkSession.sparkContext.broadcast((terms, index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = shared.value
        for doc_ids, texts in (x for batch in batches for x in term_ids(batch, known)):
            for lo in range(0, len(texts), 200):
                best = searched(known, own, texts[lo : lo + 200])
                out = [(i, known.items[k][0], kind, share, c) for i, found in zip(doc_ids[lo : lo + 200], best, strict=True) for k, (share, kind, c) in found.items()]
                if out:
                    columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["doc_id", "item_id", "kind", "share", "cosine"])

    return stored(split.select("doc_ids", "lengths", "ids", "words").mapInArrow(run, SCHEMA), "found", batch=SPLIT_GROUP)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    gone = stored(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    return own.join(gone, "doc_id", "left_anti").select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
