"""URL filters by a temporal list join.

Dated list entries (added or removed) become validity intervals, an entry's kept in the order of time in one row of its key. Every
capture is evaluated by an as-of join: each key that its URL has (the host and its parent domains, path prefixes, words) meets the one row
of that key, and of each of its entries the last interval that has begun at the fetch time is taken; it holds if it hasn't ended by then.
So a capture gives at most a row for each key of its own, however often the list has changed and however many captures a host
has. The list is a stored table: Catalyst broadcasts it only if its measured size allows it, before the keys are shuffled; else AQE splits
the hot keys of the join.

Defined cases: a null or unparsable url has no keys and is never listed; a null fetch date is never listed; of changes
to an entry on one date the last in order of action ("remove" after "add") holds; list rows with a null in kind, key, category, action or
date are left out; captures of equal url and date have the same result, and each row is returned; urls of any length are read
whole; an empty table or list gives an empty or unlisted result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, stored

#: Fixed entries of the registered query's list: kind, key, category, action, date.
ENTRIES = [
    ("domain", "ads-track.example.com", "ads", "add", "2024-01-10"),
    ("domain", "ads-track.example.com", "ads", "remove", "2024-06-01"),
    ("domain", "ads-track.example.com", "ads", "add", "2024-09-01"),
    ("prefix", "/de/", "locale", "add", "2024-08-01"),
    ("word", "casino", "gambling", "add", "2024-01-01"),
    ("word", "pills", "pharmacy", "add", "2024-02-15"),
    ("word", "pills", "pharmacy", "remove", "2024-11-01"),
    ("word", "http", "plain", "add", "2024-03-01"),
    ("word", "http", "plain", "remove", "2024-10-01"),
]
#: Each host of the pages is listed by the first digits of its MD5: these begin it in these categories.
CATEGORIES = {"0": "spam", "5": "ads", "a": "adult"}


def entries(spark: SparkSession) -> DataFrame:
    """The fixed entries, as a table of a few rows."""
    return spark.createDataFrame(ENTRIES, "kind string, key string, category string, action string, date string").withColumn("date", F.to_date("date"))


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def listed_hosts(pages: DataFrame) -> DataFrame:
    """Changes of a list made by a rule, as large as the pages' hosts are many: the MD5 of a host says its category and its dates."""
    hosts = pages.select(host_of(F.col("url")).alias("key")).where("key <> ''").distinct().withColumn("digest", F.md5("key"))
    category = F.coalesce(*[F.when(F.substring("digest", 1, 1) == d, c) for d, c in CATEGORIES.items()])
    digit = lambda k: F.instr(F.lit("0123456789abcdef"), F.substring("digest", k, 1)) - 1
    first = F.date_add(F.lit("2024-01-01").cast("date"), digit(2) * 10)
    dates = F.array(F.struct(F.lit("add").alias("action"), first.alias("date")), F.struct(F.lit("remove").alias("action"), F.date_add(first, digit(3) * 5 + 10).alias("date")), F.struct(F.lit("add").alias("action"), F.date_add(first, digit(3) * 5 + digit(4) * 8 + 20).alias("date")))
    rows = hosts.withColumn("category", category).where("category is not null").select("key", "category", F.explode(dates).alias("x"))
    return rows.select(F.lit("domain").alias("kind"), "key", "category", "x.action", "x.date")


def intervals(changes: DataFrame) -> DataFrame:
    """kind, key and entries: for each category its validity intervals (since, until; until null: still active) in the order of time."""
    given = changes.where("kind is not null and key is not null and category is not null and action is not null and date is not null")
    by = Window.partitionBy("kind", "key", "category").orderBy("date")
    last = given.groupBy("kind", "key", "category", "date").agg(F.max("action").alias("action"))
    spans = last.withColumn("until", F.lead("date").over(by)).where("action = 'add'")
    own = spans.groupBy("kind", "key", "category").agg(F.sort_array(F.collect_list(F.struct(F.col("date").alias("since"), "until"))).alias("spans"))
    return own.groupBy("kind", "key").agg(F.collect_list(F.struct("category", "spans")).alias("entries"))


def url_keys(url: Column) -> Column:
    """An array of distinct (kind, key): domains, path prefixes that end in a slash, and words of the URL."""
    low = F.lower(url)
    host = host_of(url)
    path = F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    labels = F.split(host, r"\.")
    steps = F.split(path, "/")
    n, m = F.size(labels), F.size(steps)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, k, n), ".").alias("key")))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(m - 1, F.lit(1))), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/")).alias("key")))
    words = F.transform(F.split(low, "[^a-z0-9]+"), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("key")))
    found = F.concat(F.when(host != "", domains).otherwise(F.array().cast("array<struct<kind:string,key:string>>")), F.when(path != "", prefixes).otherwise(F.array().cast("array<struct<kind:string,key:string>>")), words)
    return F.array_distinct(F.filter(found, lambda x: x["key"] != ""))


def evaluate(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """Per capture (page_id, url, fetched): how many entries were active for it then, their categories, and since when."""
    read = captures.select("page_id", "url", "fetched")
    keys = read.where("fetched is not null").select("url", "fetched").distinct()
    keys = keys.select("url", "fetched", F.explode(url_keys(F.col("url"))).alias("k")).select("url", "fetched", "k.kind", "k.key")
    met = keys.join(stored(intervals(changes), "list"), ["kind", "key"])
    begun = lambda e: F.element_at(F.filter(e["spans"], lambda s: s["since"] <= F.col("fetched")), -1)  # noqa: E731  the last one
    as_of = F.filter(F.col("entries"), lambda e: F.exists(e["spans"], lambda s: s["since"] <= F.col("fetched")))
    now = met.select("url", "fetched", F.explode(F.transform(as_of, lambda e: F.struct(e["category"].alias("category"), begun(e).alias("span")))).alias("e"))
    hits = now.where("e.span.until is null or fetched < e.span.until")
    active = hits.groupBy("url", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_join(F.sort_array(F.collect_set("e.category")), ",").alias("categories"), F.min("e.span.since").alias("since")
    )
    out = read.alias("c").join(stored(active, "active").alias("a"), ["url", "fetched"], "left")
    return out.select("page_id", "url", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("categories", F.lit("")).alias("categories"), "since", F.col("n_active").isNotNull().alias("listed"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; as the table has no fetch time, a page's is the day page_id mod 365 of 2024, from its first."""
    pages = documents(spark, sf_dir, "pages")
    changes = entries(spark).unionByName(listed_hosts(pages))
    return evaluate(pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int"))), changes)


_ROWS = ", ".join(f"('{kind}', '{key}', '{category}', '{action}', DATE '{date}')" for kind, key, category, action, date in ENTRIES)
_HOST = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
_DIGIT = "(instr('0123456789abcdef', substr(digest, {}, 1)) - 1)::INTEGER"
_CATEGORY = " ".join(f"WHEN '{d}' THEN '{c}'" for d, c in CATEGORIES.items())
ORACLE_SQL = f"""
    WITH hosts AS (SELECT DISTINCT {_HOST} AS key FROM pages),
    dated AS (SELECT key, CASE substr(digest, 1, 1) {_CATEGORY} END AS category, DATE '2024-01-01' + {_DIGIT.format(2)} * 10 AS first, {_DIGIT.format(3)} * 5 AS a, {_DIGIT.format(4)} * 8 AS b
        FROM (SELECT key, md5(key) AS digest FROM hosts WHERE key <> '')),
    changes(kind, key, category, action, date) AS (VALUES {_ROWS}
        UNION ALL SELECT 'domain', key, category, 'add', first FROM dated WHERE category IS NOT NULL
        UNION ALL SELECT 'domain', key, category, 'remove', first + a + 10 FROM dated WHERE category IS NOT NULL
        UNION ALL SELECT 'domain', key, category, 'add', first + a + b + 20 FROM dated WHERE category IS NOT NULL),
    entries AS (SELECT DISTINCT kind, key, category FROM changes),
    captures AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 365)::INTEGER AS fetched, lower(url) AS low FROM pages),
    parts AS (SELECT *, string_split(regexp_extract(low, '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.') AS labels,
        string_split(regexp_extract(low, '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/') AS steps FROM captures),
    keys AS (
        SELECT page_id, fetched, 'domain' AS kind, array_to_string(labels[k:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(len(labels), 2))) AS k FROM parts)
        UNION SELECT page_id, fetched, 'prefix', array_to_string(steps[1:k], '/') || '/' FROM (SELECT *, unnest(range(1, greatest(len(steps), 2))) AS k FROM parts WHERE len(steps) > 1)
        UNION SELECT page_id, fetched, 'word', unnest(regexp_split_to_array(low, '[^a-z0-9]+')) FROM parts),
    wanted AS (SELECT page_id, fetched, kind, key, category FROM keys JOIN entries USING (kind, key)),
    hits AS (SELECT page_id, k.category, c.date AS since FROM wanted AS k ASOF JOIN changes AS c
        ON k.kind = c.kind AND k.key = c.key AND k.category = c.category AND k.fetched >= c.date WHERE c.action = 'add'),
    active AS (SELECT page_id, count(*) AS n_active, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, min(since) AS since FROM hits GROUP BY page_id)
    SELECT page_id, url, fetched, coalesce(n_active, 0)::BIGINT AS n_active, coalesce(categories, '') AS categories, since, n_active IS NOT NULL AS listed
    FROM captures LEFT JOIN active USING (page_id)"""
