"""Fuzzy line dedup by MinHash, in DataFrame operations only.

A line is compared in lower case, trimmed, ASCII white space as one space, and is the same as another if two 64-bit hashes
of it are. Its set of character shingles (characters are UTF-16 units) is hashed once and signed by one-permutation MinHash: the least
hash of each of BINS bins; an empty bin takes the least hash of the bin whose number differs in the fewest high bits.
Lines that share a band are candidates: first, in each bucket, every line with the one that has the most neighbours in all its buckets,
which near copies of a text link to. Every candidate pair is verified by its exact Jaccard similarity, and a distributed union-find joins
the links. Then all lines of different components are compared in buckets of at most SMALL lines; lines of larger buckets whose
components are still apart are joined by an exact filter on their shingles (``rest_pairs``) that leaves out no similar pair. The first line of each component (least doc_id, then hash of the text, then position) is the one that stays.

Recall is that of the bands (README): no bucket is cut off, and similar lines of one bucket always end in one component.

Defined cases: a null text counts as empty; blank lines always stay and are never compared; lines shorter than a
shingle are duplicates only if equal; rows that share doc_id and text are one document, and rows that share the doc_id alone
are documents of their own; rows with a null doc_id are returned untouched and compared with nothing; lines of any length are signed
whole; an empty table gives an empty result; all columns of the input are kept, whatever their names, but n_chars,
n_lines and n_removed are the operator's.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded, components, documents, release, stored, whole_text

SHINGLE_CHARS, SIMILARITY = 8, 0.8
BINS, SIDE = 64, 8  # powers of two; SIDE bins are found in one row of an aggregate
#: A task signs some ten thousand lines, each with as many groups as it has rows of bins: more than Spark's fast map takes by itself (16).
GROUPS = 20
#: Buckets of at most so many lines are compared pair by pair.
SMALL = 16
BLANKS = "\t\x0b\f\r "


def groupings(rows: int, bands: int) -> list[list[int]]:
    """``bands`` sets of ``rows`` bins, each BINS // rows of them without a bin in common."""
    out: list[list[int]] = []
    for turn in range(-(-bands * rows // (BINS - BINS % rows))):
        order = list(range(BINS))
        if turn:
            random.Random(f"{rows}, {turn}").shuffle(order)
        out += [order[k : k + rows] for k in range(0, BINS - rows + 1, rows)]
    return out[:bands]


WIDE = groupings(5, 12)


def normal(line: Column) -> Column:
    odd = line.contains("  ")
    for blank in BLANKS[:-1]:
        odd = odd | line.contains(blank)
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, f"[{BLANKS}]+", " ")).otherwise(line)))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos, h1, h2 (hashes of the normal form) and line (the normal form) of every line that isn't blank."""
    read = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    read = read.select("doc_id", "text", F.xxhash64("text").alias("th"))  # here, a text is hashed once and not with each of its lines
    raw = read.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    lines = raw.where(F.ltrim("raw", F.lit(BLANKS)) != "").select("doc_id", "th", "pos", normal(F.col("raw")).alias("line"))
    return lines.select("doc_id", "th", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def distinct_lines(lines: DataFrame) -> DataFrame:
    """A row (h1, h2, line) for each h1; of different lines with one h1 (a chance of 1 in 2^64 a pair) only one is compared."""
    return lines.groupBy("h1").agg(F.min(F.struct("h2", "line")).alias("m")).select("h1", "m.h2", "m.line")


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _starts(units: Column) -> Column:
    """The places of the shingles in ``units``, as octets from 1 on."""
    return F.sequence(F.lit(1), F.octet_length(units) - 2 * SHINGLE_CHARS + 1, F.lit(2))


def _shingle(units: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(units, start, F.lit(2 * SHINGLE_CHARS)))


def _flipped(x: Column, bits: int, low: int) -> Column:
    """``x`` with ``bits`` flipped, of which the last is bit ``low`` of x."""
    number = bits << low
    return x.bitwiseXOR(F.lit(number - (1 << 64) * (number >> 63)).cast("long"))


def band_keys(lines: DataFrame, *kinds: list[list[int]]) -> DataFrame:
    """h1 and an array of keys for each of ``kinds``, of lines (h1, line; a row per h1, dealt by h1) of at least SHINGLE_CHARS characters.

    Shingles become rows inside one stage, so that all of it is generated code and nothing moves. A bin's number is the high bits of the
    hash, so the least hash with the bin's bits flipped is the bin's own least or, if it is empty, that of the bin which replaces it. It
    is found first among the hashes of one row of bins, with the bits of SIDE columns flipped, then among rows.
    """
    low = 65 - BINS.bit_length()
    high = low + SIDE.bit_length() - 1
    units = lines.select("h1", _units(F.col("line")).alias("b"))  # no filter on them, below which each line would be encoded once more
    places = units.select("h1", "b", F.explode(F.when(F.octet_length("b") >= 2 * SHINGLE_CHARS, _starts(F.col("b")))).alias("i"))
    hashed = places.select("h1", _shingle(F.col("b"), F.col("i")).alias("x"))
    least = [F.min(_flipped(F.col("x"), k, low)).alias(f"r{k}") for k in range(SIDE)]
    rows = hashed.groupBy("h1", F.shiftrightunsigned("x", high).alias("row")).agg(*least)
    used = sorted({k for kind in kinds for band in kind for k in band})
    signed = rows.groupBy("h1").agg(*[F.min(_flipped(F.col(f"r{k % SIDE}"), k // SIDE, high)).alias(f"m{k}") for k in used])
    keys = [F.array(*[F.xxhash64(F.lit(100 * n + j), *[f"m{k}" for k in band]) for j, band in enumerate(kind)]).alias(f"k{n}") for n, kind in enumerate(kinds)]
    return signed.select("h1", *keys)


def shared_keys(keys: DataFrame, name: str) -> DataFrame:
    """key, h1, n (the bucket's size) of every key that different lines share."""
    each = keys.select("h1", F.explode(name).alias("key"))
    return each.select("key", "h1", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n")).where("n > 1")


def centred(members: DataFrame) -> DataFrame:
    """``members`` (key, h1, n, ...) with centre: the bucket's line with the most neighbours in all its buckets."""
    scores = members.groupBy("h1").agg(F.sum("n").alias("score"))
    best = members.join(scores, "h1").groupBy("key").agg(F.max(F.struct("score", "h1")).alias("best"))
    return members.join(best.select("key", F.col("best.h1").alias("centre")), "key")


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _all_pairs(members: DataFrame) -> DataFrame:
    """All pairs of a bucket whose components (c) differ."""
    other = members.select("key", F.col("h1").alias("h"), F.col("c").alias("d"))
    return members.join(other, "key").where("h1 < h and c <> d").select(*_pair("h1", "h"))


def shingle_list(line: Column) -> Column:
    """The shingle hashes of a line in order; none for a line shorter than a shingle."""
    units = F.when(F.octet_length(_units(line)) >= 2 * SHINGLE_CHARS, _units(line))
    return F.transform(F.array(units), lambda b: F.transform(_starts(b), lambda i: _shingle(b, i)))[0]


def alike(a: Column, b: Column) -> Column:
    """Whether the Jaccard similarity of two sets is at least SIMILARITY (4 / 5, in whole numbers)."""
    n, m = round(10 * SIMILARITY), 10
    x, y = F.size(a), F.size(b)
    return F.when(F.least(x, y) * m >= F.greatest(x, y) * n, F.size(F.array_intersect(a, b)) * (m + n) >= (x + y) * n).otherwise(False)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the different ``pairs`` (a, b) whose lines are ``alike``."""
    joined = pairs.join(texts.select(F.col("h1").alias("b"), F.col("line").alias("lb")), "b")
    joined = joined.join(texts.select(F.col("h1").alias("a"), F.col("line").alias("la")), "a")
    # inline() gives each pair's lists once; what follows is generated code
    lists = joined.select("a", "b", F.inline(F.array(F.struct(shingle_list(F.col("la")).alias("x"), shingle_list(F.col("lb")).alias("y")))))
    sets = lists.select("a", "b", F.inline(F.array(F.struct(F.array_distinct("x").alias("x"), F.array_distinct("y").alias("y")))))
    return stored(sets.where(alike(F.col("x"), F.col("y"))).select("a", "b"), "links")


def _with_component(members: DataFrame, roots: DataFrame) -> DataFrame:
    joined = members.join(roots.select(F.col("node").alias("h1"), "root"), "h1", "left")
    return joined.select("key", "h1", "n", F.coalesce("root", "h1").alias("c"))


def rest_pairs(lines: DataFrame) -> DataFrame:
    """Pairs of ``lines`` (h1, line, c; a row per h1) of different components c, among them all that are ``alike``.

    Shingles have one order: those of a single component, then the others by the number of their lines. Of the shingles that two alike
    lines share the first stands so near to the beginning of both that as many can follow as they must share; only lines that a shingle
    joins at such places are pairs.
    """
    n, m = round(10 * SIMILARITY), 10
    lists = lines.select("h1", "c", F.array_distinct(shingle_list(F.col("line"))).alias("xs"))
    each = stored(lists.select("h1", "c", F.size("xs").alias("size"), F.explode("xs").alias("x")), "shingles")
    shared = each.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most")
    own = each.join(shared.select("x", "n"), "x").groupBy("h1", "c", "size").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("xs"))
    before = F.col("size") - F.size("xs")
    near = F.greatest(F.expr(f"size * {m - n} div {m}").cast("int") + 1 - before, F.lit(0))
    places = own.select("h1", "c", "size", before.alias("before"), F.posexplode(F.slice("xs", F.lit(1), near)).alias("pos", "s"))
    # rest: shingles of the line from this one on
    first = stored(places.select("h1", "c", "size", F.col("s.x").alias("x"), (F.col("size") - F.col("before") - F.col("pos")).alias("rest")), "first")
    other = first.select("x", F.col("h1").alias("h"), F.col("c").alias("d"), F.col("size").alias("z"), F.col("rest").alias("r"))
    can = f"least(rest, r) * {m + n} >= (size + z) * {n} and least(size, z) * {m} >= greatest(size, z) * {n}"
    out = stored(first.join(other, "x").where(f"h1 < h and c <> d and {can}").select(*_pair("h1", "h")).distinct(), "rest_pairs")
    release(each, first)
    return out


def line_components(lines: DataFrame) -> DataFrame:
    """h1, h2 and root of the lines that are similar to another one."""
    keys = stored(band_keys(distinct_lines(lines), WIDE), "keys", groups=GROUPS)
    members = stored(shared_keys(keys, "k0"), "members")
    release(keys)
    wanted = stored(members.select("h1").distinct(), "wanted")
    texts = stored(distinct_lines(lines.join(bounded(wanted), "h1", "left_semi")), "texts")
    release(wanted)
    tried = stored(centred(members).where("h1 <> centre").select(*_pair("h1", "centre")).distinct(), "pairs")
    links = similar(tried, texts)
    roots = stored(components(links, "a", "b"), "roots")
    # what the centres haven't joined
    wide = stored(_with_component(members, roots), "wide")
    large = wide.where(f"n > {SMALL}")
    mixed = large.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    loose = stored(large.join(mixed, "key", "left_semi").groupBy("h1").agg(F.first("c").alias("c")), "loose")
    pairs = _all_pairs(wide.where(f"n <= {SMALL}"))
    if not loose.isEmpty():
        pairs = pairs.unionByName(rest_pairs(texts.join(loose, "h1")))
    untried = stored(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    more = similar(untried, texts)
    found = roots
    if not more.isEmpty():
        found = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")
    out = stored(found.join(texts.select(F.col("h1").alias("node"), "h2"), "node").select(F.col("node").alias("h1"), "h2", "root"), "joined")
    release(members, texts, tried, links, roots, wide, loose, untried, more)
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, th and gone, the positions of the lines that go, of each document that loses some."""
    lines = stored(occurrences(docs), "lines", "zstd")
    linked = line_components(lines)
    places = lines.drop("line")
    each = stored(places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "each")
    own = each.join(bounded(linked), ["h1", "h2"])
    firsts = own.groupBy("root").agg(F.min("first").alias("first"))
    stay = own.select("h1", "h2", "root").join(firsts, "root").select("h1", "h2", "first")
    stay = stay.unionByName(each.where("n > 1").join(bounded(linked), ["h1", "h2"], "left_anti").select("h1", "h2", "first"))
    stay = stored(stay, "stay")
    gone = places.join(bounded(stay), ["h1", "h2"]).where(F.struct("doc_id", "th", "pos") != F.col("first"))
    out = stored(gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    release(lines, linked, each, stay)
    return out


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with text of the lines that stay, n_chars of that text, and n_lines and n_removed."""
    gone = removed(docs)
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("th"))
    joined = own.join(gone, ["doc_id", "th"], "left")
    old = F.col("row.text").cast("string")
    positions = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone"))
    rest = F.transform(F.array(F.split(old, "\n")), lambda x: F.array_join(F.transform(positions(x), lambda i: F.get(x, i)), "\n"))[0]
    text = F.when(F.col("gone").isNull(), old).otherwise(rest)
    kept = joined.select("row", "gone", text.alias("text"))
    n_lines = F.octet_length(whole_of(old)) - F.octet_length(F.replace(whole_of(old), F.lit("\n"), F.lit(""))) + 1
    new = {"text": F.col("text"), "n_chars": F.length(whole_text()).cast("long"), "n_lines": n_lines.cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")}
    names = [c for c in docs.columns if c.lower() not in new]
    place = {c.lower(): c for c in docs.columns}
    return kept.select(*[F.col("row")[c].alias(c) if c in names else new[c.lower()].alias(c) for c in docs.columns], *[x.alias(c) for c, x in new.items() if c not in place])


def whole_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_chars", "text")
