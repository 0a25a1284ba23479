"""URL filter: host and path rules and listed URLs behind one blocked Bloom filter.

A rule is ``host`` + ``path`` (``example.org/es/``, ``net/``): it fits its host and all
subdomains if the URL's path starts with the rule's path. A listed URL is compared in its
canonical form. Both kinds are keys of one list. Each distinct URL asks the Bloom filter for the
few keys that could name it; only possible hits go to an exact hash join with the list, which
removes the false positives.

Defined results: a NULL URL or one without ``://`` has an empty host and path, no rule, and is
allowed. Repeated rows are judged alike, each giving its own row. An empty list allows
everything. Only the id and URL columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import LOWER, UPPER, ascii_lower, whole
from dialoom.session import small_table

#: Query parameters that do not change the page, a fixed list.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Blocks of the Bloom filter, each four 64-bit words. The filter is broadcast, and this number
#: bounds its size (about 4 MB) whatever the length of the list; a list beyond some 1.5 million
#: keys raises the share of false positives, which the join removes, and nothing else.
BLOCKS = 1 << 16
_WORDS, _BITS_PER_WORD = 4, 2
#: Copies of each rule in the list. A rule such as ``org/`` can fit a third of all URLs; each URL
#: asks for one copy, chosen by its hash, so the rule's hits spread over as many tasks.
SALTS = 32


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column | str) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column | str) -> Column:
    """Host without ``www.``, path without a closing slash, parameters sorted without tracking ones.

    The scheme and the fragment are dropped. Empty for a URL without a host.
    """
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(whole(url), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    joined = F.array_join(F.array_sort(kept), "&")
    site = F.regexp_replace(host, r"^www\.", "")
    return F.when(host == "", "").otherwise(
        F.concat(site, F.regexp_replace(path, "/+$", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))
    )


def _bits(key: Column) -> list[Column]:
    """The words of a block with the key's bits set."""
    mixed = F.xxhash64(key, F.lit(1))
    masks = []
    for word in range(_WORDS):
        mask = F.lit(0).cast("long")
        for bit in range(_BITS_PER_WORD):
            at = F.shiftrightunsigned(mixed, 6 * (_BITS_PER_WORD * word + bit)).bitwiseAND(63).cast("int")
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
        masks.append(mask)
    return masks


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_filter(keys: DataFrame, key: str, blocks: int = BLOCKS) -> DataFrame:
    """The filter as at most ``blocks`` rows: block number and its words."""
    marked = keys.select(_block(F.col(key), blocks).alias("b"), *[m.alias(f"w{i}") for i, m in enumerate(_bits(F.col(key)))])
    return marked.groupBy("b").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def may_contain(rows: DataFrame, key: str, bloom: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The rows whose key is in the list, and a few others."""
    probe = rows.withColumn("_b", _block(F.col(key), blocks))
    for i, mask in enumerate(_bits(F.col(key))):
        probe = probe.withColumn(f"_m{i}", mask)
    hit = F.col("_b") == F.col("b")
    for i in range(_WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    return probe.join(F.broadcast(bloom), hit, "left_semi").select(*rows.columns)


def _rule_keys(url: Column, host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys under which a rule that fits this host and path could be listed, with the URL's salt."""
    if not rules:
        return F.array().cast("array<string>")
    most_labels = max(r.host.count(".") + 1 for r in rules)
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda n: F.array_join(F.slice(labels, -n, n), "."),
    )
    lengths = sorted({len(r.path) for r in rules})
    prefixes = [F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    starts = F.array_compact(F.array(*prefixes))
    mark = F.concat(F.lit("r"), F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("string"), F.lit(":"))
    pairs = F.transform(hosts, lambda h: F.transform(starts, lambda p: F.concat(mark, h, F.lit("\x1f"), p)))
    return F.flatten(pairs)


def judge_urls(
    pages: DataFrame, id_column: str, url_column: str, rules: list[Rule], listed: DataFrame, blocks: int = BLOCKS
) -> DataFrame:
    """``id_column, host, path, rule, verdict`` for every row of ``pages``.

    ``listed`` has one column ``url``. The longest fitting rule decides (equally long: the longer
    host, then block); without one, a listed URL is blocked and any other allowed.
    """
    spark = pages.sparkSession
    rule_rows = small_table(
        spark,
        [(f"r{k}:{r.host}\x1f{r.path}", r.text, len(r.text), len(r.host), r.verdict) for r in rules for k in range(SALTS)],
        [("key", "string"), ("rule", "string"), ("size", "int"), ("host_size", "int"), ("verdict", "string")],
    )
    url_rows = listed.select(F.concat(F.lit("u:"), canonical("url")).alias("key")).filter(F.col("key") != "u:").distinct()
    none = F.lit(None)
    entries = rule_rows.groupBy("key").agg(
        F.max(F.struct("size", "host_size", "verdict", "rule")).alias("found")
    ).unionByName(
        url_rows.select(
            "key",
            F.struct(
                F.lit(0).alias("size"), F.lit(0).alias("host_size"), F.lit("block").alias("verdict"),
                none.cast("string").alias("rule"),
            ).alias("found"),
        )
    )
    url = whole(url_column)
    distinct = pages.select(url.alias("_url")).distinct()
    host, path = host_of("_url"), path_of("_url")
    asked = distinct.select(
        "_url",
        F.explode(
            F.concat(_rule_keys(F.col("_url"), host, path, rules), F.array(F.concat(F.lit("u:"), canonical("_url"))))
        ).alias("key"),
    )
    possible = may_contain(asked, "key", bloom_filter(entries, "key", blocks), blocks)
    hits = possible.join(entries.hint("shuffle_hash"), "key").groupBy("_url").agg(F.max("found").alias("found"))
    keyed = pages.select(F.col(id_column), url.alias("_url"))
    judged = keyed.join(hits, "_url", "left")
    return judged.select(
        id_column,
        host.alias("host"),
        path.alias("path"),
        F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.lit("allow")).alias("verdict"),
    )


#: The rules and listed host labels of the registered query, fixed values.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
LISTED_LABELS = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]


def listed_pages(pages: DataFrame) -> DataFrame:
    """The URLs that the query lists: those on hosts with a listed label."""
    on_list = F.arrays_overlap(F.split(host_of("url"), r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    return pages.select("url").filter(on_list)


SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\\?([^#]*)', 1) AS query
  FROM pages),
named AS (
  SELECT *, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN args = '' THEN '' ELSE '?' || args END END AS canon
  FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(query, '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS args FROM parts)),
listed AS (
  SELECT DISTINCT canon FROM named
  WHERE canon <> '' AND list_has_any(string_split(host, '.'), {LISTED_LABELS!r})),
rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)}),
fits AS (
  SELECT n.page_id, n.host, n.path, n.canon, r.verdict, r.rhost || r.rpath AS rule,
    row_number() OVER (PARTITION BY n.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM named n LEFT JOIN rules r
    ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath))
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits WHERE k = 1
"""
