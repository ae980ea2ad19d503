"""String, date, number, array, map and JSON functions, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dot, histogram_bucket, iso_weekday, norm, ratio, round_half_up, title_words
from millrace.sources import table


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper(name).alias("upper"), F.length(name).alias("chars"), F.substring(name, 2, 4).alias("middle"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"),
        F.regexp_replace(name, "[aeiou]", "*").alias("starred"), F.element_at(F.split(name, " "), 1).alias("first_word"), F.concat_ws("-", "p_brand", "p_type").alias("label"),
        F.instr(name, "e").alias("place"), F.reverse(name).alias("backwards"), F.md5(name).alias("digest"), F.translate(name, "abc", "xyz").alias("changed"),
        F.regexp_extract(F.col("p_brand"), "([0-9]+)", 1).alias("number"), F.repeat(F.lit("ab"), 2).alias("twice"), title_words(name).alias("titled"),
        name.startswith("a").alias("starts_a"), F.levenshtein(name, F.col("p_type")).alias("distance"), F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"), F.dayofyear(day).alias("day_of_year"),
        iso_weekday(day).alias("weekday"), F.weekofyear(day).alias("week"), F.date_add(day, 45).alias("due"), F.last_day(day).alias("month_end"), F.date_format(day, "yyyy/MM/dd").alias("shown"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_trunc("month", "o_orderdate").cast("date").alias("month_start"), F.add_months(day, 3).alias("later"),
        F.to_date(F.date_format(day, "dd.MM.yyyy"), "dd.MM.yyyy").alias("read_again"))


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("l_extendedprice"), F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").where("l_orderkey < 2000").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", F.floor(price).alias("down"), F.ceil(price).alias("up"), F.round(price, 1).alias("rounded"), F.round(F.sqrt(price), 6).alias("root"),
        F.round(F.ln(price), 8).alias("log"), F.round(F.pow(F.col("l_discount") + 1, F.lit(2.0)), 8).alias("squared"), F.pmod(key, F.lit(7)).alias("rest"), F.expr("l_partkey div 7").alias("whole"),
        F.sign(F.col("l_quantity") - 25).alias("side"), F.round(ratio(price, F.col("l_quantity") - 25), 6).alias("per"), F.greatest("l_partkey", "l_suppkey").alias("larger"),
        F.bit_count(key).cast("int").alias("bits"), key.bitwiseAND(F.lit(255)).alias("low_byte"), F.abs(F.col("l_quantity") - 30).alias("off"), F.hex(key).alias("hexed"),
        F.when(F.col("l_tax") > 0.04, "high").when(F.col("l_tax") > 0.02, "some").otherwise("low").alias("band"), histogram_bucket(F.col("l_quantity"), 1.0, 50.0, 7).alias("bucket"))


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All is computed in the elements' own type, float, as SQL does: a decimal fraction is the nearest float, a product is rounded to float."""
    v, some, thousand = F.col("embedding"), F.array_compact("embedding"), F.lit(1000).cast("float")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).alias("n"), round_half_up(norm(v), 5).alias("length"), round_half_up(dot(v, F.reverse(v)), 5).alias("mirrored"), F.try_element_at(v, F.lit(-1)).cast("double").alias("last"),
        F.size(F.filter(v, lambda x: x > 0)).alias("positive"), F.when(F.size(some) > 0, F.exists(some, lambda x: x > F.lit(0.3).cast("float"))).alias("some_large"),
        F.when(F.size(some) > 0, F.forall(some, lambda x: x < F.lit(0.9).cast("float"))).alias("none_huge"),
        F.array_max(v).cast("double").alias("greatest"), F.array_position(v, F.array_min(v)).cast("long").alias("least_at"),
        F.array_join(F.transform(F.slice(F.array_sort(v), 1, 3), lambda x: F.floor(x * thousand).cast("string")), ",").alias("least_three"))


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as rows with their places, then gathered again in another order."""
    words = table(spark, sf_dir, "part").select("p_brand", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    return words.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_set("word"), asc=False), " ").alias("words"), F.count_if(F.col("at") == 0).alias("names"))


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of counts by event type for each user, and what can be asked of it."""
    counts = table(spark, sf_dir, "events").where("user_id < 200").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    own = counts.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    m = F.col("m")
    return own.select(
        "user_id", F.size(m).cast("long").alias("kinds"), F.coalesce(F.try_element_at(m, F.lit("click")), F.lit(0)).alias("clicks"), F.array_join(F.map_keys(m), ",").alias("names"),
        F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_join(F.map_keys(F.map_filter(m, lambda k, n: n >= 20)), ",").alias("frequent"),
        F.map_contains_key(m, "error").alias("has_error"), F.element_at(F.transform_values(m, lambda k, n: n * 2), F.element_at(F.map_keys(m), 1)).alias("first_doubled"))


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object(props, "$.k").alias("k"), F.from_json(props, "k string")["k"].alias("parsed"), F.get_json_object(F.to_json(F.struct(F.col("event_id").alias("id"))), "$.id").alias("id_text"),
        F.variant_get(F.parse_json(props), "$.k", "string").alias("from_variant"), F.json_array_length(F.lit("[1, 2, 3]")).alias("three"), F.get_json_object(props, "$.none").isNull().alias("has_no_other"))


QUERIES = {"q_strings": strings, "q_dates": dates, "q_numbers": numbers, "q_arrays": arrays, "q_explode": exploded, "q_maps": maps, "q_json": json}
ORACLES = {
    "q_strings": """
        SELECT p_partkey, upper(p_name) AS upper, length(p_name)::INTEGER AS chars, substr(p_name, 2, 4) AS middle, lpad(p_partkey::VARCHAR, 8, '0') AS padded,
            regexp_replace(p_name, '[aeiou]', '*', 'g') AS starred, string_split(p_name, ' ')[1] AS first_word, concat_ws('-', p_brand, p_type) AS label,
            instr(p_name, 'e')::INTEGER AS place, reverse(p_name) AS backwards, md5(p_name) AS digest, translate(p_name, 'abc', 'xyz') AS changed,
            regexp_extract(p_brand, '([0-9]+)', 1) AS number, 'abab' AS twice,
            array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' ') AS titled, starts_with(p_name, 'a') AS starts_a,
            levenshtein(p_name, p_type)::INTEGER AS distance, trim('  ' || p_name || ' ') AS trimmed FROM part""",
    "q_dates": """
        SELECT o_orderkey, year(d)::INTEGER AS year, quarter(d)::INTEGER AS quarter, month(d)::INTEGER AS month, day(d)::INTEGER AS day, dayofyear(d)::INTEGER AS day_of_year,
            isodow(d)::INTEGER AS weekday, week(d)::INTEGER AS week, (d + 45)::DATE AS due, last_day(d) AS month_end, strftime(d, '%Y/%m/%d') AS shown, d - DATE '1995-01-01' AS days,
            date_trunc('month', d)::DATE AS month_start, (d + INTERVAL 3 MONTH)::DATE AS later, d AS read_again FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""",
    "q_numbers": """
        SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, floor(l_extendedprice)::BIGINT AS down, ceil(l_extendedprice)::BIGINT AS up, round(l_extendedprice, 1) AS rounded,
            round(sqrt(l_extendedprice), 6) AS root, round(ln(l_extendedprice), 8) AS log, round(pow(l_discount + 1, 2.0), 8) AS squared, l_partkey % 7 AS rest, l_partkey // 7 AS whole,
            sign(l_quantity - 25)::DOUBLE AS side, round(l_extendedprice / nullif(l_quantity - 25, 0), 6) AS per, greatest(l_partkey, l_suppkey) AS larger, bit_count(l_partkey)::INTEGER AS bits,
            l_partkey & 255 AS low_byte, abs(l_quantity - 30) AS off, to_hex(l_partkey) AS hexed, CASE WHEN l_tax > 0.04 THEN 'high' WHEN l_tax > 0.02 THEN 'some' ELSE 'low' END AS band,
            greatest(0, least(6, floor((l_quantity - 1.0) * 7 / 49.0)))::INTEGER AS bucket FROM lineitem WHERE l_orderkey < 2000""",
    "q_arrays": """
        SELECT vec_id, len(embedding)::INTEGER AS n, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS length,
            round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS mirrored, embedding[-1]::DOUBLE AS last,
            len([x FOR x IN embedding IF x > 0])::INTEGER AS positive, list_max(embedding) > 0.3 AS some_large, list_max(embedding) < 0.9 AS none_huge, list_max(embedding)::DOUBLE AS greatest,
            list_position(embedding, list_min(embedding))::BIGINT AS least_at, array_to_string([floor(x * 1000)::BIGINT::VARCHAR FOR x IN list_sort(embedding)[1:3]], ',') AS least_three FROM embeddings""",
    "q_explode": """
        SELECT p_brand, array_to_string(list_reverse_sort(list_distinct(list(word))), ' ') AS words, count(*) FILTER (place = 1) AS names
        FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part) GROUP BY p_brand""",
    "q_maps": """
        WITH counts AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE user_id < 200 GROUP BY user_id, event_type)
        SELECT user_id, count(*) AS kinds, coalesce(sum(n) FILTER (event_type = 'click'), 0)::BIGINT AS clicks, string_agg(event_type, ',' ORDER BY event_type) AS names, sum(n)::BIGINT AS total,
            coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (n >= 20), '') AS frequent, bool_or(event_type = 'error') AS has_error, (2 * arg_min(n, event_type))::BIGINT AS first_doubled
        FROM counts GROUP BY user_id""",
    "q_json": """
        SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS parsed, event_id::VARCHAR AS id_text, json_extract_string(props, '$.k') AS from_variant,
            3 AS three, true AS has_no_other FROM events""",
}
