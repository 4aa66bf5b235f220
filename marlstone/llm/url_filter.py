"""URL rules by a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels reversed, each followed by a dot: a rule's host and all its subdomains are then
the keys in [key, key with its last dot replaced by the next character). These intervals nest or are disjoint. A sweep over the sorted rules
keeps a stack: intervals that have ended are popped, the one that begins is pushed, and what the stack then holds goes with the place where it begins. URLs and
these places are sorted together by key within ranges of keys, and a URL carries on the stack of the last place before it; rules whose interval has
ended meanwhile are popped from it, and the longest of the rest whose path fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """'www.example.net' becomes 'net.example.www.'."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def swept(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, list[tuple[str, str, str, str]]]]:
    """(key, end, stack) of each host of rules, in order of keys. stack: (end, host, path, verdict) of its rules and of those that enclose them."""
    verdicts: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        host = host.translate(str.maketrans(UPPER, LOWER))
        verdicts[host, path] = "block" if "block" in (verdict, verdicts.get((host, path))) else verdict
    begins: dict[str, list[tuple[str, str, str]]] = {}
    for (host, path), verdict in verdicts.items():
        begins.setdefault(".".join(reversed(host.split("."))) + ".", []).append((host, path, verdict))
    out, stack = [], []
    for key in sorted(begins):
        while stack and stack[-1][0] <= key:
            stack.pop()
        end = key[:-1] + "/"  # the first string beyond all that start with this key: '/' follows '.'
        stack += [(end, *rule) for rule in sorted(begins[key])]
        out.append((key, end, list(stack)))
    return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", ranges: int = 32, urls_a_task: int = 500_000) -> DataFrame:
    """page_id, url, host, path, rule, verdict for every page.

    Of the rules that fit, the longest (host and path together) wins; two that fit can't be equally long, but one host and path may be given twice: then block
    wins. Null URLs and those without '://' have an empty host and path and get the default verdict, as do URLs that no rule fits. Very long URLs are
    keys as any others. Repeated pages each get a row; other columns are not read. An empty table gives an empty result. rules: a list in the program, so small;
    ranges: key ranges that the rules' own keys divide the key space into. Each is dealt into as many parts as the table has rows for, each with
    a copy of the range's rules, so no host is hot.
    """
    spark = pages.sparkSession
    places = swept(rules)
    cuts = [key for key, _, _ in places][:: max(1, len(places) // ranges)][:ranges]
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    salts = max(16, pages.count() // urls_a_task + 1)

    def range_of(key: Column) -> Column:
        return F.size(F.filter(bounds, lambda b: b <= key))

    stacks = spark.createDataFrame(places, "key string, over string, stack array<struct<over: string, h: string, p: string, verdict: string>>")
    dealt = stacks.withColumn("part", F.explode(F.sequence(range_of(F.col("key")), range_of(F.col("over"))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    urls = urls.withColumn("part", range_of(F.col("key"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    both = urls.withColumn("is_url", F.lit(1)).unionByName(dealt.select("part", "salt", "key", "stack").withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("part", "salt").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("is_url = 1")
    fits = F.filter("stack", lambda x: (F.col("key") < x["over"]) & F.col("path").startswith(x["p"]))
    best = F.array_max(F.transform(fits, lambda x: F.struct((F.length(x["h"]) + F.length(x["p"])).alias("n"), x["h"].alias("h"), x["p"].alias("p"), x["verdict"].alias("v"))))
    return carried.withColumn("best", best).select("page_id", "url", "host", "path", F.concat("best.h", "best.p").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
