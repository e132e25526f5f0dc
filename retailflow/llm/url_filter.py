"""URL filters: a blocked Bloom filter of listed canonical URLs passes possible hits on to an exact
hash join, which removes the false ones. Host and path rules come before the list.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is on no
list: allowed. Null ids and repeated rows are judged like any other, a row each. Empty tables give
empty results or an empty list. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.llm import bloom
from retailflow.llm.common import renamed, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Query parameters that do not name another page.
IGNORED_PARAMETERS = "^(utm_[a-z]+|ref)(=|$)"


class Rule(NamedTuple):
    """Fits `host` and all its subdomains where the url's path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without `www.`, path without a closing slash, parameters in order without those that only
    track; no scheme and no fragment. Null where there is no host."""
    host = F.regexp_replace(host_of(url), "^www\\.", "")
    query = F.split(F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETERS))), "&")
    page = F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", page)


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page. `listed` has canonical URLs in `canonical`."""
    listed = written(renamed(listed, ["canonical"]).where("canonical IS NOT NULL").distinct(), "url-list")
    page = renamed(pages, ["page_id", "url"])
    page = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    page = bloom.marked(page.withColumn("rule", rule).withColumn("by_rule", verdict), F.col("canonical"), bloom.build(listed, "canonical"), "possible")
    page = written(page, "url-pages")  # urls only, judged once
    # Most pages end here, without a shuffle.
    passed = page.where("NOT possible").withColumn("listed", F.lit(False))
    exact = listed.withColumn("listed", F.lit(True)).hint("shuffle_hash")
    hits = page.where("possible").join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return passed.unionByName(hits).select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_list).alias("verdict"), "listed")
