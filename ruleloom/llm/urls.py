"""URL filters: host and path rules first, then a list of canonical URLs.

The list is turned into a blocked Bloom filter whose size is bounded; what it lets pass goes to an exact hash join that
removes the false positives.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is never listed;
repeated rows are each judged; an empty list allows everything that no rule blocks; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without a closing .html or slash; scheme, query and fragment do not count. Null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", "")))


def _rule(host: Column, path: Column, rules, pick) -> Column:
    """What pick gives for the longest rule that fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1])))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in ordered]
    first = F.when(fits[0], F.lit(pick(ordered[0])))
    return reduce(lambda c, x: c.when(x[0], F.lit(pick(x[1]))), zip(fits[1:], ordered[1:], strict=True), first)


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", max_blocks: int = bloom.MAX_BLOCKS) -> DataFrame:
    """pages with host, path, rule and verdict. listed: column ``canonical``, in any number and order."""
    host, path = F.col("__host"), F.col("__path")
    seen = pages.withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    seen = seen.withColumn("__rule", _rule(host, path, rules, lambda r: r[1] + r[2])).withColumn("__says", _rule(host, path, rules, lambda r: r[0])).withColumn("__key", canonical(host, path))
    keys = listed.select(F.col("canonical").alias("__key")).where("__key is not null").distinct()
    blocks = bloom.blocks_for(keys.count(), max_blocks)
    seen = bloom.probed(seen, "__key", bloom.build(keys, "__key", blocks), blocks)
    asks = F.col("__rule").isNull() & F.col("__possible")
    sure = seen.where(~asks).withColumn("__verdict", F.coalesce("__says", F.lit("allow")))
    exact = seen.where(asks).join(keys.withColumn("__listed", F.lit(True)).hint("shuffle_hash"), "__key", "left")
    exact = exact.withColumn("__verdict", F.when(F.col("__listed"), "block").otherwise("allow")).drop("__listed")
    both = sure.unionByName(exact)
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return both.select(*own, host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))
