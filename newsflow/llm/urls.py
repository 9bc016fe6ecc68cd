"""URL filters, in column expressions only: host rules, and a blocked Bloom filter of listed URLs
whose possible hits an exact hash join confirms.

The filter is a table of 64-bit blocks. A URL's hash names its block and the bits to be set there,
so one keyed lookup per URL tests all bits. Only its possible hits carry their URL into the join
with the list.
"""

from pyspark.sql import Column, DataFrame, functions as F

from newsflow.llm.common import table
from newsflow.scratch import materialise

#: Keys per 64-bit block and bits per key: about one URL in fifty passes that is not listed.
KEYS_PER_BLOCK, BITS = 8, 5


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def _lower(text: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null or without it."""
    return F.coalesce(_lower(F.regexp_extract(after_scheme(url), r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.``, ``m.`` or a port, and path without ``.html`` or closing slashes.
    Scheme, query and fragment are left out."""
    return F.concat(F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^(www|m)\.", ""),
                    F.regexp_replace(path, r"(\.html)?/*$", ""))


def rule_for(host: Column, path: Column, rules) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits.

    ``rules`` are (verdict, host, path): a rule fits its host and all subdomains where the path
    starts with its own. The list is part of the plan, so it should hold some hundreds at most; of
    rules of one length, the first by name wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(
            rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):
        fits = (((host == rule_host) | host.endswith("." + rule_host))
                & path.startswith(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                      F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(blocks).cast("bigint"))


def _bits(key: Column) -> Column:
    """The bits of a key in its block, from six bits of a second hash each."""
    mixed, mask = F.xxhash64(F.lit(2), key), F.lit(0).cast("bigint")
    for i in range(BITS):
        shift = F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), shift))
    return mask


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocks that have a bit set, from distinct ``_key`` values."""
    return listed.groupBy(_block(F.col("_key"), blocks).alias("_block")).agg(
        F.bit_or(_bits(F.col("_key"))).alias("_mask"))


def is_listed(urls: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """``urls`` with a boolean ``_listed``: whether ``key`` is among ``listed``'s ``_key`` values.

    Rows keep their number; a null key is not listed. Spark broadcasts the filter where its stored
    size allows, and shuffles by block otherwise. Hits join on the key's hash and value; the others
    get a random-looking hash and no value, so they are spread evenly and match nothing.
    """
    listed = materialise(listed.filter(F.col("_key").isNotNull()).distinct(), "listed")
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    bloom = materialise(bloom_table(listed, blocks), "bloom")
    bits = _bits(F.col(key))
    probed = (urls.withColumn("_block", _block(F.col(key), blocks))
              .join(bloom, "_block", "left")
              .withColumn("_hit", F.coalesce(F.col("_mask").bitwiseAND(bits) == bits, F.lit(False)))
              .withColumn("_value", F.when(F.col("_hit"), F.col(key)))
              .withColumn("_hash", F.when(F.col("_hit"), F.xxhash64(key)).otherwise(
                  F.xxhash64(F.lit(3), *[F.col(f"`{c}`") for c in urls.columns]))))
    exact = listed.select(F.xxhash64("_key").alias("_hash"), F.col("_key").alias("_value"),
                          F.lit(True).alias("_found"))
    return (probed.join(exact, ["_hash", "_value"], "left")
            .withColumn("_listed", F.coalesce("_found", F.lit(False)))
            .select(*[F.col(f"`{c}`") for c in urls.columns], "_listed"))


def judge(pages: DataFrame, rules, listed: DataFrame, url_col="url") -> DataFrame:
    """``pages`` with a struct ``_u``: host, path, rule, canonical URL, and verdict.

    ``listed`` has canonical URLs in ``_key``. The longest rule decides; without one, a listed URL
    is blocked and any other allowed. Null and malformed URLs have an empty host and are allowed
    unless the empty URL is listed.
    """
    seen = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"),
                        host_of(F.col(url_col)).alias("_host"),
                        path_of(F.col(url_col)).alias("_path"))
    seen = (seen.withColumn("_rule", rule_for(F.col("_host"), F.col("_path"), rules))
            .withColumn("_canonical", canonical(F.col("_host"), F.col("_path"))))
    verdict = F.coalesce(F.col("_rule.verdict"),
                         F.when(F.col("_listed"), "block").otherwise("allow"))
    return is_listed(seen, "_canonical", listed).select(
        *[F.col(f"_row.`{c}`") for c in pages.columns],
        F.struct(F.col("_host").alias("host"), F.col("_path").alias("path"),
                 F.col("_rule.rule").alias("rule"), F.col("_canonical").alias("canonical"),
                 verdict.alias("verdict")).alias("_u"))


def keep_allowed(pages: DataFrame, rules, listed: DataFrame, url_col="url") -> DataFrame:
    """The rows with an allowed URL, with the columns they came with."""
    return (judge(pages, rules, listed, url_col).filter(F.col("_u.verdict") == "allow")
            .select(*[F.col(f"`{c}`") for c in pages.columns]))


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Names that mark a host whose pages are put on the list.
SPAM_HOSTS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def spam_list(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages on spam hosts."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return (pages.select(host.alias("_h"), canonical(host, path).alias("_key"))
            .filter(F.col("_h").rlike(r"(^|\.)(" + "|".join(SPAM_HOSTS) + r")\."))
            .select("_key"))


def op9_url_filters(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, spam_list(pages)).select(
        "page_id", F.col("_u.host").alias("host"), F.col("_u.path").alias("path"),
        F.col("_u.rule").alias("rule"), F.col("_u.verdict").alias("verdict"))


OP9_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0
                       THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (
  SELECT page_id, rest,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
canon AS (
  SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)\.', '')
            || regexp_replace(path, '(\.html)?/*$', '') AS canonical FROM seen),
spam AS (
  SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host,
    '(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\.')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM canon)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM spam) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""
