"""Each operator against a brute-force version, SQL, an exact round trip or held-out accuracy, and its edge cases."""

import base64
import html
import random
import re
from collections import defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import bpe, common, decontaminate, licenses, lines, parsing, passages, quality, queries, simhash, urls, wrappers
from millrace.llm.common import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(400)]


def sql(q):
    return duckdb.sql(q).fetchall()


DOCS = sorted(sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'"))


def frame(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows] if schema == SCHEMA else rows
    return spark.createDataFrame(full, schema)


def edge_docs():
    """Nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    line = " ".join(rng.choice(WORDS) for _ in range(60))
    return [(1, None), (2, ""), (3, " \n\t "), (4, line), (5, line), (5, line), (6, line.replace("w1 ", "w2 ")), (7, long), (8, long + " end"), (None, line), (9, "a" * 50_000), (10, "é漢𝔸 word")]


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_of_few_edges_are_written_by_few_tasks(spark, monkeypatch):
    files, write = [], common.stored

    def watched(*args, **named):
        files.append(len((out := write(*args, **named)).inputFiles()))
        return out

    monkeypatch.setattr(common, "stored", watched)
    own = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 10], "a long, b long")
        got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {k: max(1, (k - 1) // 10 * 10 + 1) for k in range(1, 301)}
    assert max(files[1:]) <= common.FILES


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == groups([e for e in edges if e[0] != e[1]], [*range(41), *range(100, 160)])


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken_and_back(spark, encoding):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = DOCS[:60] + edge_docs()
    got = bpe.encode_texts(frame(spark, rows), path, P.PATTERN)
    want = sorted((str(i), encoding.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"] or []) for r in got.collect()) == want
    assert all(r["decoded_sha256"] in {sha256((t or "").encode()).hexdigest() for _, t in rows} for r in got.collect())
    assert sorted(r["decoded"].decode() for r in bpe.decode_ids(got, path).collect()) == sorted(t or "" for _, t in rows)


def test_perfect_hash_is_minimal():
    keys = [f"k{n}".encode() for n in range(3000)]
    table = bpe.PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(3000)) and sorted(table.rank.tolist()) == list(range(3000))


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_groups(spark):
    rows = DOCS[:120] + [(1000 + i if i is not None else None, t) for i, t in edge_docs() if len(t or "") < 10_000]
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    ids = {i: p for i, p in prints if i is not None}
    root = groups([(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 4], ids)
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == sorted((str(i), f"{p:016x}", str(root.get(i))) for i, p in prints)
    kept = [r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()]
    assert set(kept) == {*root.values(), None}


def test_spanning_links_of_a_chain():
    points = np.array([(1 << k) - 1 for k in range(0, 60, 3)], np.uint64)
    a, b = simhash.spanning_links(points, points, 4)
    assert len(a) == len(points) - 1 and len(set(groups(zip(a.tolist(), b.tolist()), points.tolist()).values())) == 1


def slow_lines(rows):
    """The text that each doc_id (once a row, null left alone) keeps, by all pairs of lines."""
    seen = defaultdict(list)
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            if i is not None and (n := re.sub(r"[ \t\n\x0b\f\r]+", " ", line).strip(" ").lower()):
                seen[n].append((i, p))
    sets = {n: {n[j : j + 8] for j in range(len(n) - 7)} for n in seen}
    keys = sorted(seen)
    links = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    members = defaultdict(list)
    for n, r in groups(links, keys).items():
        members[r] += seen[n]
    gone = {x for m in members.values() for x in set(m) - {min(m)}}
    return {i: t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def test_line_dedup_against_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(WORDS) for _ in range(20)) for _ in range(12)]
    near = [b.replace(b.split()[4], "zz", 1) for b in base[:6]]
    rows = DOCS[:80] + [(500, "\n".join(base)), (501, "\n".join(near + ["", "x", "x"])), (502, None), (503, ""), (504, near[0].upper() + "  "), (None, base[0])]
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(frame(spark, rows)).collect()}
    assert got == slow_lines(rows) and got != dict(rows)


def test_line_dedup_of_odd_rows(spark):
    a, b, c = ("first line of some length", "second line, another text", "third and last line of these")
    long = " ".join(WORDS * 60)
    rows = [(5, f"{a}\n{b}"), (5, f"{c}\n{a}"), (6, b), (6, b), (7, f"\t{c.upper()}  \n\nab\nab"), (8, long), (9, long + " more"), (None, a), (10, None), (11, "")]
    docs = frame(spark, rows).withColumns({x: F.lit(x) for x in ("gone", "th", "row", "pos", "line", "h1", "key", "n_lines")})
    got = lines.drop_lines(docs)
    assert got.columns == [*docs.columns, "n_removed"]
    text = defaultdict(list)
    for r in got.collect():
        assert r["gone"] == "gone" and r["n_lines"] == len((dict_text(rows, r) or "").split("\n")) - 0
        text[r["doc_id"]].append(r["text"])
    assert sorted("\n".join(text[5]).split("\n")) == sorted([a, b, c])  # of two texts with one doc_id each line is left once
    assert text[6] == ["", ""] and text[7] == ["\nab"] and text[8] == [long] and text[9] == [""] and text[None] == [a] and text[10] == [None] and text[11] == [""]


def dict_text(rows, r):
    """The text that a row had: by its number of lines, where a doc_id has several."""
    own = [t for i, t in rows if i == r["doc_id"]]
    return next(t for t in own if len((t or "").split("\n")) == r["n_lines"])


def test_bands_find_similar_lines_and_split_large_buckets(spark):
    rng = random.Random(12)
    base = [rng.choice(WORDS) for _ in range(60)]
    docs = [(0, " ".join(base))]
    for k in range(1, 150):  # near copies of one line, more than SMALL, some too far from the centre
        docs.append((k, " ".join(f"q{rng.randrange(10**6)}" if rng.random() < rng.choice([0.01, 0.03, 0.08]) else w for w in base)))
    sets = {t: {t[j : j + 8] for j in range(len(t) - 7)} for _, t in docs}
    keys = sorted(sets)
    alike = [(x, y) for k, x in enumerate(keys) for y in keys[k + 1 :] if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    root = groups(alike, keys)
    first = {}
    for i, t in docs:
        first.setdefault(root[t], i)
    want = {i for i, t in docs if first[root[t]] != i}
    got = {r["doc_id"] for r in lines.drop_lines(frame(spark, docs)).where("n_removed > 0").collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 50


def test_band_keys_by_brute_force(spark):
    rng = random.Random(21)
    texts = ["aaaaaaaa", "a" * 300, "short", "caf\u00e9 \U0001f600 na\u00efve", *(" ".join(rng.choices(WORDS, k=k)) for k in (2, 3, 10, 40, 300))]
    signed = lambda x: x - (x >> 63 << 64)
    hashed = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)

    def keys(text):
        b = text.encode("utf-16-be")
        xs = [hashed(b[j : j + 16]) for j in range(0, len(b) - 15, 2)]
        least = [min(signed(x ^ (k << 58)) for x in xs) for k in range(lines.BINS)]
        out = []
        for j, band in enumerate(lines.WIDE):
            key = hashed(j.to_bytes(4, "little"))
            for k in band:
                key = hashed(least[k].to_bytes(8, "little", signed=True), key)
            out.append(signed(key))
        return out

    own = spark.createDataFrame(list(enumerate(texts)), "h1 long, line string").repartition("h1")
    got = {r["h1"]: r["k0"] for r in lines.band_keys(own, lines.WIDE).collect()}
    assert got == {k: keys(t) for k, t in enumerate(texts) if t != "short"}


def test_line_dedup_has_one_plan_for_all_sizes(spark):
    rows = [(k, "a line that recurs\n" + " ".join(random.Random(k).choices(WORDS, k=9))) for k in range(20)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond it
    try:
        got = lines.drop_lines(frame(spark, rows))
        plan = got._jdf.queryExecution().toString()
        assert sum(r["n_removed"] for r in got.collect()) == 19
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    # a text is hashed below the split into lines, once
    read = lines.occurrences(frame(spark, rows))._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(text" not in read.split("Generate")[0].replace("coalesce(", "") and "xxhash64(" in read.split("Generate")[1]


def test_lines_are_encoded_once_and_no_pair_is_tried_again(spark, monkeypatch):
    # a filter on the units would encode each line once more below the explode, and one by a pattern would decode it
    own = spark.createDataFrame([(1, "a line of some length")], "h1 long, line string")
    plan = lines.band_keys(own, lines.WIDE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UTF-16BE") == 1
    assert "RLIKE" not in lines.occurrences(frame(spark, [(1, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    tried, told, inner, write = [], {}, lines.similar, lines.stored
    monkeypatch.setattr(lines, "similar", lambda pairs, texts: tried.append({tuple(r) for r in pairs.select("a", "b").collect()}) or inner(pairs, texts))
    monkeypatch.setattr(lines, "stored", lambda df, name, *a, **k: told.setdefault(name, k) and None or write(df, name, *a, **k))
    rng = random.Random(8)
    base = [rng.choice(WORDS) for _ in range(40)]
    rows = [(k, " ".join(f"q{rng.randrange(10**6)}" if rng.random() < 0.06 else w for w in base)) for k in range(40)]
    before = spark.conf.get(common.GROUPS, None)
    got = {r["doc_id"]: r["text"] for r in lines.drop_lines(frame(spark, rows)).collect()}
    assert told["keys"]["groups"] == lines.GROUPS and spark.conf.get(common.GROUPS, None) == before
    first, second = tried
    assert first and second and not first & second
    kept = slow_lines(rows)
    assert {i for i, t in kept.items() if t} <= {i for i, t in got.items() if t} and any(not t for t in got.values())


def test_lines_of_blanks_are_left_out(spark):
    blank = ["", " ", "   ", "\t", " \x0b\f\r ", "\t \t"]
    other = ["\u00a0", "\u3000 ", " \t x", "\x1f", "\x00 "]
    got = [r["pos"] for r in lines.occurrences(frame(spark, [(1, "\n".join(blank + other))])).collect()]
    assert sorted(got) == list(range(len(blank), len(blank + other)))


def test_similar_lines_of_a_large_bucket_are_all_joined(spark, monkeypatch):
    monkeypatch.setattr(lines, "SMALL", 2)
    rng = random.Random(4)
    base = [rng.choice(WORDS) for _ in range(60)]
    change = lambda words, k: [f"q{rng.randrange(10**6)}" if p in own else w for own in [rng.sample(range(60), k)] for p, w in enumerate(words)]
    far = [change(base, 4) for _ in range(120)]  # unlike the base, but each like another one
    texts = [" ".join(x) for x in [base, *(change(base, rng.randrange(1, 4)) for _ in range(150)), *far, *(change(x, k) for x in far for k in (2, 3))]]
    own = lines.stored(lines.occurrences(frame(spark, list(enumerate(texts)))), "lines")
    text = {r["h1"]: r["line"] for r in own.collect()}
    sets = {h: {t[j : j + 8] for j in range(len(t) - 7)} for h, t in text.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    every = {(a, b) for a in sets for b in sets if a < b and alike(a, b)}
    apart = spark.createDataFrame([(h, t, h) for h, t in text.items()] + [(1, "short", 1)], "h1 long, line string, c long")
    pairs = [tuple(r) for r in lines.rest_pairs(apart).collect()]
    assert every <= set(pairs) and len(pairs) == len(set(pairs)) < len(sets) * (len(sets) - 1) / 2
    assert lines.rest_pairs(apart.withColumn("c", F.lit(0))).count() == 0
    buckets = defaultdict(list)
    for r in lines.shared_keys(lines.band_keys(lines.distinct_lines(own), lines.WIDE), "k0").collect():
        buckets[r["key"]].append(r["h1"])
        assert r["n"] > 1
    assert max(map(len, buckets.values())) > lines.SMALL
    near = [(a, b) for m in buckets.values() for a in m for b in m if (a, b) in every]
    got = {r["h1"]: r["root"] for r in lines.line_components(own).collect()}
    assert all(got[a] == got[b] for a, b in near)
    every_root = groups(every, sets)  # lines of no common bucket may be joined too, but only similar ones
    assert all(every_root[h] == every_root[r] for h, r in got.items())


def test_fingerprints_and_next_documents(spark):
    rows = [r for r in DOCS[:50]] + [(900, None), (901, ""), (902, "x"), (903, DOCS[3][1])]
    got = {r["doc_id"]: r for r in parsing.fingerprint_docs(frame(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, then = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + then[: len(t) // 2]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), sha256(new.encode()).hexdigest())
    assert got[903]["fingerprint"] == got[DOCS[3][0]]["fingerprint"]
    long = [i for i, t in rows if len(t or "") > 1000]
    assert np.mean([got[i]["near_edited"] for i in long]) > 0.4 > 0.1 > np.mean([got[i]["near_next"] for i in long])


def test_phrases_are_the_same_at_any_offset():
    for _, text in DOCS[8:30]:
        levels = []
        for x in (text, "some other words before it " + text):
            s = np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.uint64)
            first = np.arange(len(s)) == 0
            levels.append([])
            for _ in range(3):
                s, first = parsing.parse_level(s, first)
                levels[-1].append(set(s.tolist()))
        assert all(len(a - b) <= 6 for a, b in zip(*levels))  # only names at the text's beginning can change


def slow_repeats(rows):
    seen, out, first = {}, {}, set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if (i, t) in first:
            continue
        first.add((i, t))
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        stay = [True] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                stay[s : s + 20] = [False] * 20
            else:
                seen[k] = i
        out[i] = (len(w), stay.count(False), sha256(" ".join(a for a, b in zip(w, stay) if b).encode()).hexdigest())
    return out


def test_substring_dedup_against_brute_force(spark):
    rng = random.Random(9)
    passage = [rng.choice(WORDS) for _ in range(70)]
    planted = []
    for k in range(60):  # one passage in most rows, cut at both ends, and repeated within a row
        a, b = rng.randrange(30), rng.randrange(40, 71)
        filler = [rng.choice(WORDS[:6]) for _ in range(rng.randrange(30))]
        planted.append((2000 + k, " ".join(filler + passage[a:b] + filler + passage[a : b - 5])))
    rows = DOCS[:70] + [(3000 + i if i is not None else None, t) for i, t in edge_docs()] + planted
    got = passages.drop_repeats(frame(spark, rows)).collect()
    want = slow_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_substring_dedup_of_odd_rows(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(30)) for c in "xyz")
    rows = [(0, x), (1, x), (1, y), (1, y), (2, f"{z} {y}"), (3, "one " * 60_000)]
    docs = frame(spark, rows).withColumns({c: F.lit(1) for c in ("id", "th", "key", "ranges", "h", "owner", "copy")})
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in passages.drop_repeats(docs).collect())
    assert got == sorted([(0, 30, 0, x), (1, 30, 30, ""), (1, 30, 0, y), (1, 30, 0, y), (2, 60, 30, z), (3, 60_000, 59_999, "one")])


def test_numbers_follow_the_order_of_ids(spark):
    keys = [(i, t) for i in (-5, 3, 900) for t in (7, -2, 40)]
    got = passages.numbered(spark.createDataFrame(keys, "doc_id long, th long")).orderBy("id").collect()
    assert [(r["doc_id"], r["th"]) for r in got] == sorted(keys) and [r["id"] for r in got] == list(range(9))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_licenses_of_planted_and_edge_texts(spark):
    rows = [(1, "CC BY cc-by, all RIGHTS reserved"), (2, None), (3, "cc"), (4, "Released under the new MIT license. General public license"), (5, "cc bİy"), (5, "cc bİy")]
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 0, 4, "cc-by,reserved")
    assert (got[2]["n_words"], got[2]["labels"], got[2]["first_word"], got[2]["score"]) == (0, "", None, 0.0)
    assert got[4]["labels"] == "gpl,mit" and got[4]["base_labels"] == "gpl" and got[5]["n_base"] == 0


def test_licenses_of_whole_notices_and_odd_rows(spark):
    notice = max((t for _, t in licenses.TEMPLATES), key=len)
    words = notice.split()
    edited = " ".join(w if k % 6 else "other" for k, w in enumerate(words))
    rows = [(1, f"xx {notice.upper()} yy"), (2, edited), (3, "K\u212a cc by \u212a"), (None, "all rights reserved"), (4, "word " * 100_000 + "cc by " * 3), (5, notice), (5, notice), (6, " ".join(words[:20]))]
    got = defaultdict(list)
    for r in licenses.license_scan(frame(spark, rows).withColumns({c: F.lit(1) for c in ("th", "w", "t", "at", "label", "pos")})).collect():
        got[r["doc_id"]].append(r)
    assert got[1][0]["labels"] == got[2][0]["labels"] == "mit" and got[1][0]["score"] == 1.0 > got[2][0]["score"] > 0.6
    assert got[3][0]["n_base"] == 1 and got[3][0]["n_words"] == 4 and got[None][0]["labels"] == "reserved"
    assert (got[4][0]["n_base"], got[4][0]["first_word"], got[4][0]["last_word"]) == (3, 100_000, 100_004)
    assert len(got[5]) == 2 and got[5][0] == got[5][1]


def test_url_intervals(spark):
    pages = spark.createDataFrame([(1, "http://m.ads-track.example.com/x"), (2, None), (3, "http://A.ads-track.example.com:80/x"), (4, "bad"), (5, "")], "page_id long, url string")
    at = F.element_at(F.array(*[F.lit(d).cast("date") for d in ("2024-01-10", "2024-02-01", "2024-06-01", "2024-02-01", "2024-02-01")]), F.col("page_id").cast("int"))
    got = {r["page_id"]: r for r in urls.evaluate(pages.withColumn("fetched", at), urls.entries(spark)).collect()}
    assert got[1]["categories"] == "ads" and got[3]["categories"] == "plain" and [got[k]["listed"] for k in (2, 4, 5)] == [False] * 3


def test_url_filter_of_odd_rows(spark):
    changes = [("word", "x", "c", "add", "2024-01-05"), ("word", "x", "c", "add", "2024-01-05"), ("word", "x", "d", "add", "2024-01-02"), ("word", "x", "d", "remove", "2024-01-04"), ("word", "x", "e", "add", "2024-01-03"),
               ("word", "x", "e", "remove", "2024-01-03"), (None, "x", "f", "add", "2024-01-01"), ("word", None, "f", "add", "2024-01-01"), ("word", "x", "f", "add", None)]
    table = spark.createDataFrame(changes, "kind string, key string, category string, action string, date string").withColumn("date", F.to_date("date"))
    long = "http://h/" + "y/" * 3000 + "x"
    rows = [(1, "http://h/x", "2024-01-03"), (1, "http://h/x", "2024-01-03"), (2, "http://h/x", "2024-01-04"), (3, "http://h/x", "2024-01-05"), (4, "http://h/x", None), (5, long, "2024-02-01"), (None, "x", "2024-01-02"), (6, None, "2024-01-05")]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumns({c: F.lit(1) for c in ("key", "kind", "entries", "since")})
    got = sorted(((r["page_id"], r["categories"], r["n_active"], str(r["since"])) for r in urls.evaluate(pages, table).collect()), key=repr)
    want = [(1, "d", 1, "2024-01-02"), (1, "d", 1, "2024-01-02"), (2, "", 0, "None"), (3, "c", 1, "2024-01-05"), (4, "", 0, "None"), (5, "c", 1, "2024-01-05"), (None, "d", 1, "2024-01-02"), (6, "", 0, "None")]
    assert got == sorted(want, key=repr)
    assert urls.evaluate(pages, table.where("false")).where("not listed").count() == len(rows) and urls.evaluate(pages.where("false"), table).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = sql(f"SELECT doc_id, text, quality, toxic, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END FROM '{sf}/documents.parquet' JOIN '{sf}/labels.parquet' USING (doc_id) ORDER BY hash(doc_id)")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:2500]], "doc_id long, quality int, toxic int")
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    grades = np.array([r[4] for r in rows[2500:]])
    kept = np.array([model.tails(r[1])[-1] >= quality.KEEP for r in rows[2500:]])
    share = [kept[grades == g].mean() for g in range(3)]
    assert share[0] < 0.05 and share[1] < 0.3 and share[2] > 0.95
    assert (np.diff(model.cuts) > 0).all()
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(frame(spark, edge_docs()), labels).count() == len(edge_docs())
    assert quality.rate(frame(spark, edge_docs()), labels.where("false")).where("keep").count() == len(edge_docs())


def test_quality_slope_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    row, col = np.repeat(np.arange(40), 5), rng.integers(0, 12, 200)
    grades, w, t = rng.integers(0, 3, 40), rng.normal(size=12), np.array([-0.4, 0.2])

    def loss(w, t):  # by hand: P(grade >= k) = sigmoid(score - cut)
        score = [sum(w[c] for r, c in zip(row, col) if r == i) for i in range(40)]
        cuts = [t[0], t[0] + np.exp(t[1])]
        tail = lambda s, k: 1.0 if k == 0 else 0.0 if k == 3 else 1 / (1 + np.exp(cuts[k - 1] - s))
        return -np.mean([np.log(tail(s, g) - tail(s, g + 1)) for s, g in zip(score, grades)])

    value, by_w, by_t = quality.slope(w, t, row, col, grades)
    assert abs(value - loss(w, t)) < 1e-9
    for k in range(12):
        step = np.eye(12)[k] * 1e-6
        assert abs((loss(w + step, t) - loss(w - step, t)) / 2e-6 - by_w[k]) < 1e-6
    for k in range(2):
        step = np.eye(2)[k] * 1e-6
        assert abs((loss(w, t + step) - loss(w, t - step)) / 2e-6 - by_t[k]) < 1e-6


def test_quality_of_odd_labels_and_columns(spark):
    clean, junk = "a plain and readable text about rivers and hills", "buy now | buy now | buy now | click | click"
    rows = [(k, f"{clean} {k}" if k % 2 else f"{junk} {k}") for k in range(400)] + [(900, None), (901, ""), (902, (junk + " ") * 5000), (1, clean), (None, clean)]
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in ("grade", "f", "slot", "keep", "s", "n")})
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(400)] + [(1, 1, 1), (3, None, 1), (5, None, None), (None, 0, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.rate(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["expected_grade"] <= 2 and 0 <= r["p_clean"] <= 1 for r in got)
    mean = {k: np.mean([r["expected_grade"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 2 == k]) for k in (0, 1)}
    assert mean[0] < mean[1] - 0.5
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.where("keep = 'keep'").count() == kept.count() == sum(r["keep"] for r in got)


def test_decontamination_recall(spark):
    docs, items = sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'"), sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'")
    planted = [(5000, "clean words before " + items[0][1].replace(",", "").upper() + " and after"), (5001, None), (None, items[1][1])]
    want = {(i, j) for i, t in docs for j, x in items if x in t} | {(5000, items[0][0])}
    bench = spark.createDataFrame([*items, (None, "x"), (77_000, None), (77_001, "")], "item_id long, text string")
    df = frame(spark, docs + planted)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert want <= got and len(got) <= len(want) + 2
    assert decontaminate.leaks(df.withColumns({c: F.lit(1) for c in ("item_id", "ids", "kind", "row")}), bench).count() == len(got)
    left = [r["doc_id"] for r in decontaminate.drop_leaks(df.withColumn("row", F.lit(1)), bench).collect()]
    assert set(left) == {i for i, _ in docs + planted} - {i for i, _ in got}


def test_common_words_and_weights_are_counted_in_all_texts(spark, monkeypatch):
    docs = [(k, t) for k, (_, t) in enumerate(DOCS[:60])] + [(100, None), (101, '.. a, "a" .'), (None, "Usual, " * 100), (101, "usual " * 2000)]
    monkeypatch.setattr(decontaminate, "SAMPLE_DOCS", 3)
    for name, most in (("KNOWN", 200), ("TEXTS", 7), ("TEXT_WORDS", 900)):
        monkeypatch.setattr(decontaminate, name, most, raising=False)
    seen, real = [], decontaminate.common_words
    monkeypatch.setattr(decontaminate, "common_words", lambda x: seen.append(real(x)) or seen[-1])
    bench = spark.createDataFrame([(1, "usual words"), (2, "another item")], "item_id long, text string")
    decontaminate.leaks(frame(spark, docs), bench).collect()
    n = defaultdict(int)
    for _, t in docs:
        words = (t or "").lower().split()
        for k in range(0, len(words), decontaminate.BLOCK):
            n[""] += 1
            for w in {x.strip(decontaminate.MARKS) for x in words[k : k + decontaminate.BLOCK]} - {""}:
                n[w] += 1
    blocks = n.pop("")
    assert seen == [sorted(n, key=lambda w: (-n[w], w.encode()))[: decontaminate.COMMON]]
    terms = decontaminate.Terms([(1, "usual nowhere")], seen[0])
    got, all_of = decontaminate.block_counts(decontaminate.word_counts(decontaminate.split_texts(frame(spark, docs))), terms)
    assert all_of == blocks and dict(zip(terms.ids, got.tolist(), strict=True)) == {w: n.get(w, 0) for w in terms.ids}


def test_tasks_hold_few_rows_of_split_texts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "TEXTS", 1)
    split = decontaminate.split_texts(frame(spark, DOCS[:40]).coalesce(1))
    held = [pq.read_metadata(f.removeprefix("file://")) for f in split.inputFiles()]
    rows = [m.row_group(k).num_rows for m in held for k in range(m.num_row_groups)]
    assert sum(rows) == 40 and max(rows) <= decontaminate.SPLIT_GROUP
    seen, write = {}, common.stored

    def watched(df, name, *args, **named):
        seen[name] = named
        return write(df, name, *args, **named)

    monkeypatch.setattr(decontaminate, "stored", watched)
    decontaminate.leaks(frame(spark, DOCS[:40]), spark.createDataFrame([(1, "an item")], "item_id long, text string")).collect()
    assert seen["split"]["batch"] == decontaminate.SPLIT_BATCH and seen["found"]["batch"] == decontaminate.SPLIT_GROUP
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    before = spark.conf.get(common.BATCH)
    got = common.stored(spark.range(10).coalesce(1).mapInArrow(sizes, "n long"), "sizes", batch=3)
    assert sorted(r["n"] for r in got.collect()) == [1, 3, 3, 3] and spark.conf.get(common.BATCH) == before


def test_texts_without_enough_words_of_an_item_are_not_projected(monkeypatch):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six seven eight nine")]
    terms = decontaminate.Terms(items, ["of"])
    index = decontaminate.Index(terms.rows, np.eye(len(terms.ids), dtype=np.float32), np.ones(len(terms.ids), np.float32))
    rows, real = [], index.candidates
    monkeypatch.setattr(index, "candidates", lambda ids, inside: rows.append(int(inside.sum())) or real(ids, inside))
    texts = ["of " * 500, "one two three of " * 90, "of of " + items[0][1] + " of" * 20, ""]
    got = decontaminate.searched(terms, index, [terms.of(t) for t in texts])
    assert [sorted(x) for x in got] == [[], [], [0], []] and got[2][0][:2] == (1.0, "copy")
    assert rows == [30]
    assert decontaminate.searched(terms, index, [terms.of(texts[0])]) == [{}] and len(rows) == 1
    assert decontaminate.searched(terms, index, []) == []


def latent(texts, items, grow=1):
    """Terms and index as the operator makes them, but with a basis by power iteration on the passages' and items' rows."""
    n = defaultdict(int)
    for t in texts:
        words = decontaminate.words_of(t)
        for k in range(0, len(words), decontaminate.BLOCK):
            for w in set(words[k : k + decontaminate.BLOCK]):
                n[w] += 1
    terms = decontaminate.Terms(items, sorted(n, key=lambda w: (-n[w], w))[: decontaminate.COMMON])
    blocks = sum(-(-len(t.split()) // decontaminate.BLOCK) for t in texts)
    weight = np.array([max(0.1, np.log((blocks * grow + 1) / (n[w] * grow + 1))) for w in terms.ids], np.float32)
    rows = np.concatenate([decontaminate.tf_idf(r[:64], weight, 128) for r in terms.rows])
    passages_ = np.concatenate([decontaminate.tf_idf(terms.of(t), weight, 48) for t in texts])
    scale = np.sqrt(decontaminate.ITEM_ENERGY * len(passages_) / len(rows))
    dims = min(decontaminate.DIMS, len(weight), len(items) - 1)
    both = np.vstack([passages_, scale * rows]).astype(np.float64)
    basis = np.random.default_rng(1).standard_normal((len(weight), dims))
    for _ in range(6):  # power iteration
        basis, _ = np.linalg.qr(both.T @ (both @ basis))
    return terms, decontaminate.Index(terms.rows, basis.astype(np.float32), weight), dims


@pytest.mark.parametrize("grow", [1, 1000])
def test_recall_of_items_of_all_lengths_and_changes(grow):
    """Copies and paraphrases that verify() accepts, against brute force; the second time with the words of a corpus of 1000 times the size."""
    rng = random.Random(6)
    texts = [t for _, t in DOCS if t and len(t.split()) > 60][:60]
    words = [w for t in texts for w in t.split()[:300]]
    items = []
    for n in (3, 4, 5, 6, 8, 12, 20, 32, 48, 64, 70, 150, 560, 2000):
        for _ in range(5):
            x = [rng.choice(words) for _ in range(n)]
            items.append((len(items), " ".join(x)))
    terms, index, dims = latent(texts, items, grow)
    assert dims < len(items)
    found, all_of = defaultdict(int), defaultdict(int)
    for drop in (0.0, 0.15, 0.3):
        for k, (_, t) in enumerate(items):
            x = t.split()
            answer = len(x) - max(3, len(x) // 5)
            changed = [rng.choice(words) if p < answer and rng.random() < drop else w for p, w in enumerate(x)]
            host = rng.choice(texts).split()[:400]
            at = rng.randrange(len(host))
            if decontaminate.verify(terms.rows[k], terms.of(" ".join(changed)))[0]:
                key = (min(len(x), 100), drop > 0)
                all_of[key] += 1
                found[key] += k in decontaminate.searched(terms, index, [terms.of(" ".join(host[:at] + changed + host[at:]))])[0]
    assert sum(found.values()) >= 0.95 * sum(all_of.values())
    assert all(found[k] >= 0.8 * n for k, n in all_of.items()), (dict(found), dict(all_of))


def test_windows_span_no_two_texts():
    texts = ["a b c d e f g h i j k", "", "l m n o p q", "a b c"]
    items = [(k, x) for k, x in enumerate(["i j k l m n", "l m n o p q", "a b c", "g h i j k", "z y x"])]
    terms, index, _ = latent(texts * 3, items)
    got = decontaminate.searched(terms, index, [terms.of(t) for t in texts])
    assert [sorted(x) for x in got] == [[2, 3], [], [1], [2]]


def test_leaks_among_other_words_and_of_all_lengths(spark):
    rng = random.Random(8)
    usual, long, short = WORDS[:15], [f"l{k}" for k in range(600)], ["s1", "s2", "s3"]
    rest = [f"r{k}" for k in range(40)]
    docs = [(k, " ".join(w for _ in range(20) for w in rng.sample(usual[:15], 5) + [f"o{rng.randrange(9999)}" for _ in range(19)])) for k in range(100)]
    around = [f"x{k}" for k in range(200)]
    docs += [(900 + k, " ".join(around[:77] + words + around[77:])) for k, words in enumerate((usual, long, short, [w if k % 6 else "q" for k, w in enumerate(usual)]))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate((usual, long, short, rest))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(frame(spark, docs), bench).collect()}
    assert {k: v for k, v in got.items() if k[0] >= 900} == {(900, 0): "copy", (901, 1): "copy", (902, 2): "copy", (903, 0): "copy"}


def test_common_length_against_the_table():
    rng = random.Random(1)
    for _ in range(30):
        a, b = [np.array([rng.randrange(6) for _ in range(rng.randrange(1, 30))]) for _ in range(2)]
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.common_length(a, b) == t[-1, -1]


def test_main_text(spark):
    got = {r["page_id"]: r["text"] for r in wrappers.op1_html_text(spark, SF).collect()}
    for i, page in sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'"):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        assert got[i] == " ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)>", " ", body))).split())
    page = "<body><div class='menu2'><a>Home</a></div><div class='post-content'><h2>T &lt;x&gt;</h2><p>One <b>two</b>three&nbsp;x<p>Four<div class=advert>buy</div><ul><li>a<li>b</ul></div><div class=comments>no</div><form>f</form>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", page.replace("<p>Four", "")), (3, None, None), (4, "http://h/3", ""), (5, "http://h/4", "<p"), (5, "http://h/4", "<p")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "T <x> One twothree x Four a b" and got[2][0] == "T <x> One twothree x a b" and got[3] == got[4] == got[5] == ("", 0)


def test_wrapper_groups():
    a, b = (wrappers.stream(f"<body><article>{x}</article></body>") for x in ("<h1>t</h1><p>a</p><p>b</p>", "<p>a</p>"))
    assert a == "<body><article><h1><#></h1><p><#></p></article></body>"
    assert ["?", ["<h1>", "<#>", "</h1>"]] in wrappers.infer([a, b])


def texts_of(spark, *pages, url="http://h/{}"):
    rows = [(k, url and url.format(k), page) for k, page in enumerate(pages)]
    return [r["text"] for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_only_whole_elements_are_folded(spark):
    for page, want in [
        ("<article><div><div><p>x</p></div></div></article>", "x"),
        ("<article><ul><li>a<ul><li>b</ul></ul><ul><li><ul><li>c</ul></ul></article>", "a b c"),
        ("<article><blockquote><blockquote>x</blockquote></blockquote></article>", "x"),
        ("<article><div class=col-1><div class=col-2>x</div></div></article>", "x"),
        ("<article>" + "<div>" * 3000 + "x", "x"),
    ]:
        assert texts_of(spark, f"<body>{page}") == [want]
    assert wrappers.stream("<ul><li><p>a</p><li><p>b</p></ul>") == "<ul><li><p><#></p></li></ul>"


def test_hosts_whose_containers_differ(spark):
    for a, b in [("<body><article class='post cat-a'>", "<body><article class='post cat-b'>"), ("<body><div class=content>", "<body><section class=content>"), ("<body class=k><div id=main>", "<body class=l><div id=main>")]:
        pages = [f"{a}<p>x</p>", f"{b}<p>y</p>", f"{b}<h1>t</h1><p>z</p>", f"{a}<h2>u</h2>", f"{a.replace('body', 'body id=q')}v"]
        assert texts_of(spark, *pages) == ["x", "y", "t z", "u", "v"]


def test_each_page_has_its_own_rank_of_slots(spark):
    pages = ["<body><article>x</article><p>no", "<body><main>y</main><p>no", "<body><div class=content>z</div><p>no", "<body><nav>no</nav><p>v", "<body><article> &nbsp;</article><p>w"]
    want = ["x", "y", "z", "v", "w"]
    assert texts_of(spark, *pages) == want and texts_of(spark, *pages, url=None) == want


def test_a_lone_slot_counts_where_it_stands(spark):
    pages = ["<body><nav>k<ul><li>m</ul></nav><article><p>x</p></article>", "<body><article><p>x</p></article>", "<body><article>a<p>x</p></article>"]
    assert texts_of(spark, *pages) == ["x", "x", "a x"]


def test_words_of_classes_count_as_whole_names(spark):
    for page, want in [
        ("<body class='has-sidebar'><article>x</article>", "x"),
        ("<body class='sidebar'><p>x</p>", "x"),
        ("<body><article class='post has-comments comments'>x<div class=comments>no</div></article>", "x"),
        ("<body><main id=share>x<article class=comment>no</article></main>", "x"),
        ("<body><div class='content social-news'>x<div class='social 2'>no</div></div>", "x"),
        ("<body><div class='page sidebar'><article>x<div class=lead-widget>y</div></article></div>", "x y"),
        ("<body><div class=related><article>no</article></div><article>x</article>", "x"),
        ("<body><div class=with-sidebar><p>x</p><div class=site-header>no</div><div class=menu2>no</div></div>", "x"),
        ("<body><div class=has-sidebar><nav><article>no</article></nav>x</div>", "x"),
    ]:
        ranks = wrappers.main_slots(wrappers.infer([wrappers.stream(page)]))
        assert wrappers.main_text(page, {p: k for k, paths in enumerate(ranks) for p in paths}) == want, page
    assert texts_of(spark, "<body class='has-sidebar'><article class=with-ads>x</article>") == ["x"]


def test_pages_without_body_and_with_a_text_of_the_host(spark):
    assert texts_of(spark, "<p>Only a fragment</p>", "a <b>b</b><nav>no</nav><p>c", "<html><head><title>no</title></head><p>d") == ["Only a fragment", "a b c", "d"]
    frame_of = "<body><div class=top>Our site, since 1999</div><div class=x><p>{}</p></div><div class=end>All about us</div>"
    pages = [frame_of.format(f"text {k}") for k in range(5)] + [frame_of.format("text 0"), "<body><article>All about us</article>", "<body><div class=end>All about us</div>"]
    assert texts_of(spark, *pages) == [*(f"text {k}" for k in range(5)), "text 0", "All about us", "All about us"]
    same = [frame_of.format("copy")] * 5  # one page, five times: all of it stays
    assert texts_of(spark, *same) == ["Our site, since 1999 copy All about us"] * 5


def test_a_host_of_many_kinds_of_pages_and_a_long_one(spark):
    pages = [f"<body><div class=k{chr(97 + k % 26)}{chr(97 + k // 26)}><article class=a{chr(97 + k % 7)}><p>t{k}</p></article></div><footer>no</footer>" for k in range(300)]
    pages.append("<body><article>" + "<p>word and word</p>" * 20_000 + "</article>")
    assert texts_of(spark, *pages) == [*(f"t{k}" for k in range(300)), " ".join(["word and word"] * 20_000)]


def test_wrappers_have_the_slots_of_their_streams():
    rng = random.Random(4)

    def some(depth):
        return "".join("t" if depth > 3 or rng.random() < 0.3 else f"<{(n := rng.choice(['div', 'ul', 'section', 'div class=a']))}>{some(depth + 1)}</{n.split()[0]}>" for _ in range(rng.randrange(4)))

    for _ in range(200):
        pages = [f"<body>{some(0)}</body>" for _ in range(rng.randrange(1, 7))]
        halves = [wrappers.infer([wrappers.stream(p) for p in pages[k::2]]) for k in (0, 1)]
        stack, got = [], set()
        for x in wrappers._plain(wrappers.align(*halves)):
            if x[1] == "/":
                assert stack.pop() == x[2:-1]
            elif x == "<#>":
                got.add("/".join(stack))
            else:
                stack.append(x[1:-1])
        assert not stack and got == {p for page in pages for kind, p, _ in wrappers.read(page) if kind == "text"}


def test_pipeline_stages_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, stage(spark, out, SF)
        if name != "bpe":
            assert out.columns == docs.columns
        empty = stage(spark, before.where("false"), SF)
        assert empty.columns == out.columns and empty.count() == 0
        out = spark.createDataFrame(out.collect(), out.schema)
    assert {r["decoded_sha256"] for r in out.collect()} == {sha256((r["text"] or "").encode()).hexdigest() for r in before.collect()}


def test_whole_pipeline_against_brute_force(spark, tmp_path, encoding):
    items = sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'")
    rows = [r for r in DOCS if r[1]][:60] + [(7000, "clean words before " + items[0][1] + " and after"), (7001, DOCS[5][1]), (7002, None), (7003, "")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"] for r in quality.rate(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).where("keep").collect()}
    left = slow_lines([r for r in rows if r[0] in kept])
    prints = {i: slow_fingerprint(t) for i, t in left.items()}
    root = groups([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], prints)
    norm = lambda t: f" {' '.join(decontaminate.words_of(t or ''))} "
    want = {}
    for i, t in left.items():
        if root[i] == i and not any(norm(x) in norm(t) for _, x in items):
            want[i] = sha256(np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()
    got = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 7000 not in got and len(got) < len(rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_empty_tables_with_more_columns(spark, name, tmp_path):
    for t in ("documents", "pages", "benchmark", "labels"):
        df = spark.read.parquet(f"{SF}/{t}.parquet").where("false")
        df.withColumns({c: F.lit(1) for c in ("h", "owner", "fp", "node", "root", "host", "pos", "line", "key")}).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
