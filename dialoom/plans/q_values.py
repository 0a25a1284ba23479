"""String, number, NULL, cast, array and JSON queries: dialect functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dialoom.functions import maths as ma
from dialoom.functions import nested as nx
from dialoom.functions import strings as st
from dialoom.plans.registry import query, table

MAYBE = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END"


@query(
    "ST-1",
    f"""SELECT c_custkey, coalesce(c_name || ' ' || seg, 'NULL') AS tsql, c_name || ' ' || coalesce(seg, '') AS oracle,
      coalesce(CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE seg END, 'NULL') AS oracle_empty
    FROM (SELECT c_custkey, c_name, {MAYBE} AS seg FROM customer)""",
)
def concat_nulls(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", f"{MAYBE} AS seg")
    return people.select(
        "c_custkey",
        F.coalesce(st.concat("c_name", F.lit(" "), "seg"), F.lit("NULL")).alias("tsql"),
        st.concat("c_name", F.lit(" "), "seg", dialect="oracle").alias("oracle"),
        F.coalesce(st.concat("seg", F.lit(""), dialect="oracle"), F.lit("NULL")).alias("oracle_empty"),
    )


@query(
    "ST-2 ST-3",
    """SELECT p_partkey, cast(length(p_name) + 2 AS int) AS len_snowflake, cast(length(p_name) AS int) AS len_tsql,
      substr(p_name, 3, 5) AS middle, substr(p_name, 4) AS rest, left(p_name, 6) AS first_part FROM part""",
)
def lengths_and_parts(spark, sf_dir):
    padded = F.concat("p_name", F.lit("  "))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        st.length(padded).alias("len_snowflake"),
        st.length(padded, "tsql").alias("len_tsql"),
        st.substr("p_name", 3, 5).alias("middle"),
        st.substr("p_name", 4).alias("rest"),
        st.left("p_name", 6).alias("first_part"),
    )


@query(
    "ST-4",
    "SELECT doc_id, cast(instr(text, 'en') AS int) AS first_en, cast(instr(text, lang) AS int) AS first_lang FROM documents",
)
def positions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", st.position("en", "text").alias("first_en"), st.position(F.col("lang"), "text").alias("first_lang")
    )


@query(
    "ST-5",
    """SELECT doc_id, coalesce(list_filter(regexp_split_to_array(text, '[ .,]'), lambda x: x <> '')[3], 'none') AS third,
      coalesce(list_filter(regexp_split_to_array(text, '[ .,]'), lambda x: x <> '')[900], 'none') AS far FROM documents""",
)
def strtok_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.coalesce(st.strtok("text", " .,", 3), F.lit("none")).alias("third"),
        F.coalesce(st.strtok("text", " .,", 900), F.lit("none")).alias("far"),
    )


@query(
    "ST-6",
    """SELECT page_id, cast(len(string_split(url, '.')) AS int) AS parts, string_split(url, '.')[2] AS second_part
    FROM pages""",
)
def split_to_array(spark, sf_dir):
    parts = st.split_to_array("url", ".")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.size(parts).alias("parts"), F.get(parts, F.lit(1)).alias("second_part")
    )


@query(
    "ST-7",
    """SELECT c_custkey, ltrim('00' || c_custkey || '00', '0') AS leading, rtrim('00' || c_custkey || '00', '0') AS trailing,
      trim('00' || c_custkey || '00', '0') AS both_sides FROM customer""",
)
def trim_sides(spark, sf_dir):
    zeros = F.concat(F.lit("00"), F.col("c_custkey").cast("string"), F.lit("00"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        st.trim(zeros, "leading", "0").alias("leading"),
        st.trim(zeros, "trailing", "0").alias("trailing"),
        st.trim(zeros, "both", "0").alias("both_sides"),
    )


@query(
    "ST-8",
    """SELECT doc_id, md5(regexp_replace(text, '[aeiou]+', '<v>', 'g')) AS every_match,
      md5(regexp_replace(text, '([a-z])([a-z])', '\\2\\1')) AS first_match, regexp_matches(text, '(?i)THE') AS like_the,
      regexp_extract(text, '[A-Z][a-z]+', 0) AS first_word,
      cast(len(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS int) AS words FROM documents""",
)
def regular_expressions(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(st.regexp_replace("text", "[aeiou]+", "<v>", "g")).alias("every_match"),
        F.md5(st.regexp_replace("text", "([a-z])([a-z])", "$2$1", "")).alias("first_match"),
        st.regexp_like("text", "THE", "i").alias("like_the"),
        st.regexp_extract("text", "[A-Z][a-z]+").alias("first_word"),
        F.size(st.regexp_extract_all("text", "[A-Z][a-z]+")).alias("words"),
    )


@query("ST-9", "SELECT p_partkey, cast(levenshtein(p_name, p_type) AS int) AS distance FROM part")
def edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", st.levenshtein("p_name", "p_type").alias("distance"))


@query(
    "ST-10",
    """SELECT doc_id, md5(replace(text, 'en', 'EN')) AS replaced, md5(translate(text, 'abc.,', 'xyz')) AS translated
    FROM documents""",
)
def replace_and_translate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(st.oreplace("text", "en", "EN")).alias("replaced"),
        F.md5(st.otranslate("text", "abc.,", "xyz")).alias("translated"),
    )


@query(
    "ST-11",
    """SELECT doc_id, md5(text) AS md5_hex, sha1(text) AS sha1_hex, sha256(text) AS sha256_hex FROM documents""",
)
def hash_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        st.hashbytes("MD5", "text").alias("md5_hex"),
        st.hashbytes("SHA1", "text").alias("sha1_hex"),
        st.hashbytes("SHA2_256", "text").alias("sha256_hex"),
    )


# Published SHA-512 test values: of the empty text and of "abc".
SHA512_EMPTY = (
    "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce"
    "47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e"
)
SHA512_ABC = (
    "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a"
    "2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f"
)


@query(
    "ST-11",
    f"""SELECT doc_id, 128 AS digits, true AS is_hex, count(*) OVER (PARTITION BY text) AS same_text,
      CASE doc_id % 2 WHEN 0 THEN '{SHA512_EMPTY}' ELSE '{SHA512_ABC}' END AS known FROM documents""",
)
def hash_bytes_512(spark, sf_dir):
    """SHA-512 of all texts: form, equal digests exactly for equal texts, and two published digests."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        st.hashbytes("SHA2_512", "text").alias("h"),
        st.hashbytes("SHA2_512", F.expr("CASE doc_id % 2 WHEN 0 THEN '' ELSE 'abc' END")).alias("known"),
    )
    counts = docs.groupBy("h").agg(F.count(F.lit(1)).alias("same_text"))
    return docs.join(counts, "h").select(
        "doc_id", F.length("h").alias("digits"), F.col("h").rlike("^[0-9a-f]+$").alias("is_hex"), "same_text", "known"
    )


@query("ST-12", "SELECT r_regionkey AS regionkey, r_name AS \"Region Name\" FROM region")
def normalize_column_names(spark, sf_dir):
    return st.normalize_columns(table(spark, sf_dir, "region").toDF("@region#key", "[Region Name]"))


NULLED = "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 0 ELSE o_orderkey END"


@query(
    "MA-1 MA-2",
    f"""SELECT o_orderkey, coalesce(v, -1) AS replaced, coalesce(v, 0) AS zeroed, coalesce(nullif(v, 0), -9) AS nulled
    FROM (SELECT o_orderkey, {NULLED} AS v FROM orders)""",
)
def null_replacement(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{NULLED} AS v")
    return rows.select(
        "o_orderkey",
        ma.isnull("v", -1).alias("replaced"),
        ma.zeroifnull("v").alias("zeroed"),
        ma.isnull(ma.nullifzero("v"), -9).alias("nulled"),
    )


DIVIDEND = "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END"
DIVISOR = "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity % 4 END"


@query(
    "MA-3",
    f"""SELECT l_orderkey, l_partkey, l_linenumber, coalesce(CASE WHEN b = 0 THEN 0.0 ELSE a / b END, -1.0) AS ratio
    FROM (SELECT *, {DIVIDEND} AS a, {DIVISOR} AS b FROM lineitem)""",
)
def divide_or_zero(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", f"{DIVIDEND} AS a", f"{DIVISOR} AS b"
    )
    return rows.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.coalesce(ma.div0("a", "b"), F.lit(-1.0)).alias("ratio")
    )


@query(
    "MA-4 MA-5",
    f"""SELECT c_custkey, CASE WHEN seg IS NULL THEN 'none' WHEN seg = 'BUILDING' THEN 'b'
        WHEN seg = 'MACHINERY' THEN 'm' ELSE 'other' END AS decoded,
      CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END AS flag FROM (SELECT c_custkey, {MAYBE} AS seg FROM customer)""",
)
def decode_and_if(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MAYBE} AS seg")
    return people.select(
        "c_custkey",
        ma.decode("seg", None, "none", "BUILDING", "b", "MACHINERY", "m", default="other").alias("decoded"),
        ma.iff(F.col("seg") == "BUILDING", 1, 0).alias("flag"),
    )


@query(
    "MA-6 MA-8",
    """SELECT p_partkey, cast(p_size * p_size AS int) AS squared, p_partkey * 8 AS shifted_left,
      p_partkey // 4 AS shifted_right, xor(p_partkey, cast(p_size AS bigint)) AS bits,
      (p_size > 10) <> (p_partkey % 2 = 0) AS one_only FROM part""",
)
def square_and_bits(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        ma.square("p_size").alias("squared"),
        ma.bitshiftleft("p_partkey", 3).alias("shifted_left"),
        ma.bitshiftright("p_partkey", 2).alias("shifted_right"),
        ma.bitxor("p_partkey", F.col("p_size").cast("bigint")).alias("bits"),
        ma.boolxor(F.col("p_size") > 10, F.expr("p_partkey % 2 = 0")).alias("one_only"),
    )


NUMBER_TEXT = "CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE ' ' || cast(c_custkey AS string) || '.25 ' END"


@query(
    "MA-7",
    f"""SELECT c_custkey, coalesce(cast(try_cast(trim(t) AS decimal(18,2)) AS double), -1.0) AS number,
      coalesce(try_cast(trim(t) AS double), -1.0) AS dbl, cast(c_custkey AS varchar) AS as_text,
      cast(c_nationkey AS bigint) AS int8 FROM (SELECT *, {NUMBER_TEXT} AS t FROM customer)""",
)
def conversions(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey", f"{NUMBER_TEXT} AS t")
    return people.select(
        "c_custkey",
        F.coalesce(ma.to_number("t", 18, 2, strict=False).cast("double"), F.lit(-1.0)).alias("number"),
        F.coalesce(ma.convert(F.trim("t"), "double", strict=False), F.lit(-1.0)).alias("dbl"),
        ma.to_text("c_custkey").alias("as_text"),
        ma.int8("c_nationkey").alias("int8"),
    )


@query(
    "JS-1",
    f"""SELECT c_custkey, c_name || '|' || cast(c_nationkey AS varchar) AS items,
      CASE WHEN seg IS NULL THEN 1 ELSE 2 END AS entries, coalesce(seg, 'absent') AS segment
    FROM (SELECT c_custkey, c_name, c_nationkey, {MAYBE} AS seg FROM customer)""",
)
def construct_arrays_and_objects(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_nationkey", f"{MAYBE} AS seg")
    obj = nx.object_construct(segment="seg", name="c_name")
    return people.select(
        "c_custkey",
        F.array_join(nx.array_construct("c_name", F.col("c_nationkey").cast("string")), "|").alias("items"),
        F.size(obj).alias("entries"),
        F.coalesce(F.try_element_at(obj, F.lit("segment")), F.lit("absent")).alias("segment"),
    )


@query(
    "JS-2 JN-8",
    """SELECT page_id, cast(generate_subscripts(string_split(url, '/'), 1) - 1 AS int) AS index,
      unnest(string_split(url, '/')) AS value FROM pages""",
)
def flatten_url_parts(spark, sf_dir):
    from dialoom.operators.relational import apply_explode

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return apply_explode(pages, st.split_to_array("url", "/"), with_index=True).select("page_id", "index", "value")


DOC = """'{"k": {"a": [' || cast(value AS string) || ', 2], "b": null}, "t": "' || event_type || '"}'"""


@query(
    "JS-3 JS-4",
    """SELECT event_id, event_type AS scalar, 'NULL' AS scalar_of_object, '[' || value || ',2]' AS container,
      'NULL' AS container_of_scalar, cast(json_extract(props, '$.k') AS varchar) AS arrow,
      cast(value AS varchar) AS path_value FROM events""",
)
def json_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "props", f"{DOC} AS doc")
    null = F.lit("NULL")
    return rows.select(
        "event_id",
        nx.json_value("doc", "$.t").alias("scalar"),
        F.coalesce(nx.json_value("doc", "$.k"), null).alias("scalar_of_object"),
        nx.json_query("doc", "$.k.a").alias("container"),
        F.coalesce(nx.json_query("doc", "$.t"), null).alias("container_of_scalar"),
        nx.json_get("props", "k").alias("arrow"),
        nx.json_get("doc", "{k,a,0}").alias("path_value"),
    )


@query(
    "JS-5 JS-6",
    """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL
        ELSE list_transform(range(doc_id % 3), lambda i: 'e' || i) END AS errors FROM documents)
    SELECT doc_id, coalesce(array_to_string(errors, '; '), 'NULL') AS joined,
      coalesce(array_to_string(errors, ', '), '') AS joined_or_empty, coalesce(len(errors), -1) AS n FROM e""",
)
def joined_errors(spark, sf_dir):
    listed = F.transform(
        F.slice(F.sequence(F.lit(0), F.lit(3)), F.lit(1), F.expr("cast(doc_id % 3 AS int)")),
        lambda i: F.concat(F.lit("e"), i.cast("string")),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.expr("doc_id % 4 <> 0"), listed).alias("errors"))
    return docs.select(
        "doc_id",
        F.coalesce(nx.errors_text("errors"), F.lit("NULL")).alias("joined"),
        nx.errors_text_or_empty("errors").alias("joined_or_empty"),
        F.coalesce(F.size("errors"), F.lit(-1)).cast("long").alias("n"),
    )
