"""Operator 5: allow and block URLs by host and path rules.

Every URL is expanded into (host suffix, path prefix) expressions, these are joined
to the rules on a short prefix of their SHA-256, the full digest confirms a hit, and
the longest rule wins.  DataFrame functions only; neither side is broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import ascii_lower

#: Bytes of the digest two expressions must share to be compared in full.
PREFIX_BYTES = 4


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as written; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with the columns host, path, rule and verdict (existing ones of these names are replaced).

    ``rules`` has ``rule`` (``host/path``: everything before the first slash is the host, the slash
    belongs to the path) and ``verdict`` (``allow`` or ``block``).  A rule fits its host and all its
    subdomains where the path starts with the rule's.  The longest rule wins; of equally long ones the
    longer host, then ``block``, then the larger text.  A page no rule fits gets ``default`` and a null
    rule.  Null, empty or broken URLs have an empty host and path and no rule.  Repeated pages stay
    repeated; empty tables give empty results; rules that are null or have no slash fit nothing.  The column
    name ``_best`` is reserved.
    """
    host, path = host_and_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*kept, host.alias("host"), path.alias("path"))

    slash = F.instr("rule", "/")
    known = (rules.select(F.col("rule"), F.col("verdict")).where(slash > 1)
             .withColumn("_host", ascii_lower(F.substring("rule", F.lit(1), slash - 1)))
             .withColumn("_path", F.substring("rule", slash, F.length("rule"))))
    # How long rule paths are: at most as many lengths as the longest rule has characters.
    lengths = sorted(r[0] for r in known.select(F.length("_path")).distinct().collect())
    known = known.select("rule", "verdict", F.length("_host").alias("_host_size"),
                         _digest(F.concat("_host", "_path")).alias("_digest"))
    known = known.withColumn("_short", F.substring("_digest", 1, 2 * PREFIX_BYTES))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
                               if lengths else F.array(F.lit(None).cast("string")))
    urls = judged.select("host", "path").where("host <> ''").distinct()
    expressions = (urls.select("host", "path", F.explode(suffixes).alias("_suffix"))
                   .select("host", "path", "_suffix", F.explode(prefixes).alias("_prefix"))
                   .select("host", "path", _digest(F.concat("_suffix", "_prefix")).alias("_found"))
                   .withColumn("_short", F.substring("_found", 1, 2 * PREFIX_BYTES)))
    best = F.max(F.struct(F.length("rule").alias("size"), F.col("_host_size"), (F.col("verdict") == "block").alias("block"),
                          "rule", "verdict"))
    fitting = (expressions.join(known, "_short").where("_found = _digest")
               .groupBy("host", "path").agg(best.alias("_best")))
    return (judged.join(fitting, ["host", "path"], "left")
            .select(*kept, "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
