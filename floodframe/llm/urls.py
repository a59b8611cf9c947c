"""URL filter: host rules first, then a list of canonical URLs behind a blocked Bloom filter. DataFrame functions only.

The filter is a table of 64-bit blocks: a URL's hash picks one block and four bits in it. Pages whose bits are all set go on to an exact
join with the list, which removes false positives; all others are passed at once. The filter is about ten bits per listed URL.

Defined results: a null URL, or one without ``://``, has empty host and path and is allowed; repeated rows are judged each by itself;
repeated and null list entries are ignored; an empty list blocks nothing; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, functions as F

from floodframe.llm.common import bounded

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule wins.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
KEYS_PER_BLOCK = 6
#: Blocks that may be broadcast; a bigger filter is joined by shuffle.
BROADCAST_BLOCKS = 1_000_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://``, with ASCII capitals lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.``, path without closing slashes; scheme, query and fragment play no part."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", ""))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _mask(url: Column) -> Column:
    """Four bits out of 64, from a hash that is independent of the block's."""
    h = F.xxhash64(F.lit(17), url)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """``block``, ``bits`` of ``listed(url)``."""
    return listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("url"))).alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages(page_id, url)``.

    ``listed(url)`` holds canonical URLs. Counting it, to size the filter, is a job.
    """
    listed = listed.where("url is not null").distinct()
    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule = verdict = None
    for host, path, says in sorted(rules, key=lambda x: -len(x[0] + x[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    judged = parts.select("*", rule.alias("rule"), verdict.alias("verdict"), canonical(F.col("host"), F.col("path")).alias("url"))
    probe = judged.withColumn("block", F.when(F.col("rule").isNull(), _block(F.col("url"), blocks)))
    ruled = judged.where("rule is not null").select("page_id", "host", "path", "rule", "verdict")
    tested = probe.where("rule is null").join(bounded(bloom_filter(listed, blocks), BROADCAST_BLOCKS), "block", "left")
    possible = F.coalesce(F.col("bits").bitwiseAND(_mask(F.col("url"))) == _mask(F.col("url")), F.lit(False))
    passed = tested.where(~possible).withColumn("verdict", F.lit("allow"))
    exact = tested.where(possible).join(listed.withColumn("is_listed", F.lit(True)), "url", "left").withColumn(
        "verdict", F.when(F.col("is_listed"), "block").otherwise("allow"))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return ruled.unionByName(passed.select(columns)).unionByName(exact.select(columns))
