"""Scalar functions by family: strings, dates, numbers, arrays, maps, JSON and vectors, with the SQL
that gives the same rows. Integer results are cast where the two engines name other widths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..tables import table


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.upper(name).alias("upper_name"),
        F.length(name).cast("long").alias("n"),
        F.substring(name, 2, 3).alias("middle"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.replace(name, F.lit("a"), F.lit("_")).alias("replaced"),
        F.concat_ws("-", "p_brand", "p_type").alias("joined"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"),
        F.reverse(name).alias("backwards"),
        F.instr(name, "e").cast("long").alias("place"),
        F.levenshtein("p_brand", "p_type").cast("long").alias("distance"),
        F.md5(name).alias("md5"),
        F.sha2(name, 256).alias("sha256"),
        F.regexp_replace(name, r"[aeiou]+", "*").alias("no_vowels"),
        F.element_at(F.split(name, r"\s+"), 1).alias("first_word"),
    )


STRINGS = r"""
SELECT p_partkey, upper(p_name) AS upper_name, length(p_name) AS n, substring(p_name, 2, 3) AS middle,
       trim('  ' || p_name || ' ') AS trimmed, replace(p_name, 'a', '_') AS replaced,
       concat_ws('-', p_brand, p_type) AS joined, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded,
       reverse(p_name) AS backwards, instr(p_name, 'e') AS place, levenshtein(p_brand, p_type) AS distance,
       md5(p_name) AS md5, sha256(p_name) AS sha256, regexp_replace(p_name, '[aeiou]+', '*', 'g') AS no_vowels,
       regexp_split_to_array(p_name, '\s+')[1] AS first_word
FROM part
"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        *(getattr(F, f)(at).cast("long").alias(f) for f in ("year", "quarter", "month", "day")),
        F.weekofyear(at).cast("long").alias("week"),
        (F.dayofweek(at) - 1).cast("long").alias("weekday"),
        F.datediff(at, F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
        F.expr("o_orderdate + INTERVAL 10 DAYS").alias("later"),
        F.date_trunc("month", at).cast("timestamp_ntz").alias("month_start"),
        F.date_format(at, "yyyy/MM/dd").alias("written"),
    )


DATES = """
SELECT o_orderkey, year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, month(o_orderdate) AS month, day(o_orderdate) AS day,
       weekofyear(o_orderdate) AS week, dayofweek(o_orderdate) AS weekday,
       date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, o_orderdate + INTERVAL 10 DAY AS later,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, strftime(o_orderdate, '%Y/%m/%d') AS written
FROM orders
"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.floor(balance).cast("double").alias("down"),
        F.ceil(balance).cast("double").alias("up"),
        F.sqrt(F.abs(balance)).alias("root"),
        F.round(F.log(F.abs(balance) + 1), 9).alias("log"),
        F.pow(balance, 2).alias("square"),
        F.signum(balance).alias("sign"),
        F.try_divide(balance, F.col("c_nationkey").cast("double")).alias("ratio"),
        (F.col("c_custkey") % 7).alias("rest"),
        F.greatest(balance, F.lit(0.0)).alias("at_least_0"),
        balance.cast("int").cast("long").alias("whole"),
    )


NUMBERS = """
SELECT c_custkey, floor(c_acctbal) AS down, ceil(c_acctbal) AS up, sqrt(abs(c_acctbal)) AS root, round(ln(abs(c_acctbal) + 1), 9) AS log,
       power(c_acctbal, 2) AS square, CAST(sign(c_acctbal) AS DOUBLE) AS sign, c_acctbal / nullif(c_nationkey, 0) AS ratio,
       c_custkey % 7 AS rest, greatest(c_acctbal, 0.0) AS at_least_0, CAST(trunc(c_acctbal) AS BIGINT) AS whole
FROM customer
"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the few words of a part's name."""
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(F.transform(words, F.upper), ",").alias("upper_words"),
        F.size(F.filter(words, lambda w: F.length(w) > 4)).cast("long").alias("long_words"),
        F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w)).cast("long").alias("letters"),
        F.array_join(F.slice(words, 1, 1), ",").alias("first_word"),
        F.size(F.array_distinct(words)).cast("long").alias("different"),
        F.array_join(F.array_sort(words), ",").alias("in_order"),
        F.exists(words, lambda w: w.like("%e%")).alias("any_e"),
        F.aggregate(F.sequence(F.lit(1), F.col("p_size")), F.lit(0), lambda a, b: a + b).cast("long").alias("triangle"),
    )


ARRAYS = """
WITH w AS (SELECT *, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey, array_to_string(list_transform(words, lambda x: upper(x)), ',') AS upper_words,
       len(list_filter(words, lambda x: length(x) > 4)) AS long_words,
       CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT) AS letters, words[1] AS first_word,
       CAST(list_unique(words) AS BIGINT) AS different, array_to_string(list_sort(words), ',') AS in_order,
       len(list_filter(words, lambda x: x LIKE '%e%')) > 0 AS any_e,
       CAST(list_sum(range(1, p_size + 1)) AS BIGINT) AS triangle
FROM w
"""


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split("p_name", " ")).alias("word")
    return table(spark, sf_dir, "part").select(words).groupBy("word").agg(F.count("*").alias("n"))


EXPLODED = "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word"


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k INT")
    return table(spark, sf_dir, "events").select(
        "event_id",
        parsed["k"].cast("long").alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("props"), F.col("props"))["type"].alias("kind"),
        F.to_json(F.struct(F.col("user_id"))).alias("written"),
    )


JSON = """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
       event_type AS kind, '{"user_id":' || user_id || '}' AS written FROM events
"""


def url_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.groupBy(F.parse_url("url", F.lit("HOST")).alias("host")).agg(F.count("*").alias("n"))


URL_HOSTS = "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1"


def vector_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    return vectors.select("vec_id", F.round(length, 5).alias("length"), F.size("embedding").cast("long").alias("n"))


VECTOR_LENGTHS = """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS length,
       len(embedding) AS n FROM embeddings
"""

def more_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.lower(text).alias("small"),
        F.size(F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))).cast("long").alias("n_words"),
        F.regexp_count(text, F.lit("[aeiou]")).cast("long").alias("n_vowels"),
        F.startswith(text, F.lit("T")).alias("starts"),
        F.contains(text, F.lit("the")).alias("has_the"),
        F.left(text, F.lit(5)).alias("head"),
        F.translate("role", "aeiou", "AEIOU").alias("role_upper"),
        F.split_part(text, F.lit(" "), F.lit(2)).alias("second"),
        F.ascii("role").cast("long").alias("code"),
        F.repeat("role", 2).alias("twice"),
        F.base64(F.encode("role", "UTF-8")).alias("in_base64"),
    )


MORE_STRINGS = r"""
SELECT conv_id, turn, lower(text) AS small, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n_words,
       len(regexp_extract_all(text, '[aeiou]')) AS n_vowels, starts_with(text, 'T') AS starts, contains(text, 'the') AS has_the, left(text, 5) AS head,
       translate(role, 'aeiou', 'AEIOU') AS role_upper, split_part(text, ' ', 2) AS second, CAST(ascii(role) AS BIGINT) AS code,
       repeat(role, 2) AS twice, to_base64(encode(role)) AS in_base64
FROM conversations
"""


def bits_and_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.bit_count(key).cast("long").alias("ones"),
        key.bitwiseAND(12).alias("masked"),
        key.bitwiseXOR(5).alias("flipped"),
        F.shiftleft(key, 3).alias("shifted"),
        F.lower(F.conv(key.cast("string"), 10, 16)).alias("in_hex"),
        F.bin(key).alias("in_binary"),
        F.width_bucket(F.col("p_retailprice"), F.lit(900.0), F.lit(1000.0), F.lit(10)).cast("long").alias("bucket"),
        F.greatest(F.lit(10), F.col("p_size")).alias("at_least"),
        F.factorial(F.col("p_size") % 10).alias("factorial"),
        F.round(F.atan2(F.col("p_size").cast("double"), F.lit(3.0)), 9).alias("angle"),
        F.try_divide(F.col("p_retailprice"), F.col("p_size") - 1).isNull().alias("no_quotient"),
    )


BITS_AND_BASES = """
SELECT p_partkey, CAST(bit_count(p_partkey) AS BIGINT) AS ones, p_partkey & 12 AS masked, xor(p_partkey, 5) AS flipped, p_partkey << 3 AS shifted,
       lower(to_hex(p_partkey)) AS in_hex, to_binary(p_partkey) AS in_binary,
       CAST(CASE WHEN p_retailprice < 900 THEN 0 WHEN p_retailprice >= 1000 THEN 11 ELSE floor((p_retailprice - 900) / 10) + 1 END AS BIGINT) AS bucket,
       greatest(10, p_size) AS at_least, CAST(factorial(p_size % 10) AS BIGINT) AS factorial, round(atan2(CAST(p_size AS DOUBLE), 3.0), 9) AS angle, p_size = 1 AS no_quotient
FROM part
"""


def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a turn shares with the one before it."""
    own = F.array_sort(F.array_distinct(F.split(F.lower("text"), " ")))
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("own"))
    rows = rows.withColumn("last", F.coalesce(F.lag("own").over(before), F.array().cast("array<string>")))
    both, either = F.array_intersect("own", "last"), F.array_union("own", "last")
    return rows.select(
        "conv_id",
        "turn",
        F.size(both).cast("long").alias("n_both"),
        F.size(either).cast("long").alias("n_either"),
        F.array_join(F.array_sort(F.array_except("own", "last")), " ").alias("new"),
        F.arrays_overlap("own", "last").alias("overlap"),
        F.array_contains("own", "the").alias("has_the"),
        F.element_at(F.map_from_entries(F.transform("own", lambda w: F.struct(w, F.length(w)))), F.element_at("own", 1)).cast("long").alias("first_length"),
        F.array_max(F.transform("own", F.length)).cast("long").alias("longest"),
        F.size(F.flatten(F.array("own", "last"))).cast("long").alias("n_all"),
    )


ARRAY_SETS = """
WITH w AS (SELECT conv_id, turn, list_sort(list_distinct(string_split(lower(text), ' '))) AS own FROM conversations),
p AS (SELECT *, coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY turn), CAST([] AS VARCHAR[])) AS last FROM w)
SELECT conv_id, turn, len(list_intersect(own, last)) AS n_both, len(list_distinct(own || last)) AS n_either,
       array_to_string(list_sort(list_filter(own, lambda x: NOT list_contains(last, x))), ' ') AS new, list_has_any(own, last) AS overlap,
       list_contains(own, 'the') AS has_the, length(own[1]) AS first_length, list_max(list_transform(own, lambda x: length(x))) AS longest, len(own) + len(last) AS n_all
FROM p
"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of events as variants, and as XML."""
    events = table(spark, sf_dir, "events")
    variant = F.parse_json("props")
    xml = F.concat(F.lit("<e><t>"), "event_type", F.lit("</t></e>"))
    return events.select(
        "event_id",
        F.variant_get(variant, "$.k", "long").alias("k"),
        F.try_variant_get(variant, "$.none", "long").alias("none"),
        F.schema_of_variant(variant).alias("kind"),
        F.xpath_string(xml, F.lit("e/t")).alias("type"),
    )


VARIANTS = """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS none, 'OBJECT<k: BIGINT>' AS kind, event_type AS type FROM events
"""

QUERIES = {
    "scalar_strings": (strings, STRINGS),
    "scalar_dates": (dates, DATES),
    "scalar_numbers": (numbers, NUMBERS),
    "scalar_arrays": (arrays, ARRAYS),
    "scalar_explode": (exploded, EXPLODED),
    "scalar_json_map": (json, JSON),
    "scalar_url_host": (url_hosts, URL_HOSTS),
    "vector_lengths": (vector_lengths, VECTOR_LENGTHS),
    "scalar_more_strings": (more_strings, MORE_STRINGS),
    "scalar_bits_and_bases": (bits_and_bases, BITS_AND_BASES),
    "scalar_array_sets": (array_sets, ARRAY_SETS),
    "scalar_variants": (variants, VARIANTS),
}
