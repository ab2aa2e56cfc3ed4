"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import free_name, lower_ascii

ALLOW, BLOCK = "allow", "block"
#: Above this many rules the index is a joined table instead of a literal in the plan.
MAX_INLINE_RULES = 2000
HOST_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """A rule on a host with its subdomains and the start of a path, or, with pattern, on the whole URL.

    literals: tokens that stand whole, in lower case, in every URL that pattern fits. any_of: tokens of which one at
    least does so, for patterns of alternatives.
    """

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    literals: tuple[str, ...] = ()
    any_of: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.pattern or self.host + self.path

    @property
    def regex(self) -> str:
        return self.pattern or r"^(?:[^/]*\.)?" + re.escape(self.host) + (re.escape(self.path) or r"(?:/|\z)")

    @property
    def tokens(self) -> list[str]:
        text = (self.host + (self.path or "/")).lower()
        return sorted(self.literals if self.pattern else set(re.findall("[0-9a-z]+", re.sub("[0-9a-z]+$", "", text))))


HOST_RULES = [
    Rule(BLOCK, "com", "/en/"),
    Rule(ALLOW, "example.com", "/en/7"),
    Rule(ALLOW, "net", "/de/"),
    Rule(BLOCK, "example.net", "/de/8"),
    Rule(BLOCK, "org", "/es/"),
]
#: Rules of this library's own for what no host rule judges.
PATTERN_RULES = [
    Rule(BLOCK, pattern=r"://([^/?#]*\.)?spam-farm\.", literals=("spam", "farm")),
    Rule(BLOCK, pattern=r"://([^/?#]*\.)?(ads|adserver|doubleclick)\.", any_of=("ads", "adserver", "doubleclick")),
    Rule(BLOCK, pattern=r"[?&]utm_source=(spam|casino)\b", literals=("utm", "source")),
    Rule(BLOCK, pattern=r"/(wp-login|xmlrpc)\.php", any_of=("wp", "xmlrpc")),
    Rule(ALLOW, pattern=r"/robots\.txt$", literals=("robots", "txt")),
]


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(url), "[^0-9a-z]+"))


def rarest_literals(urls: DataFrame, url_col: str, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under that literal of its own which fewest of all URLs hold (ties: the first by code point), or under
    each token of its any_of.

    One pass over all URLs; what comes back has a row for each literal of the rules at most. Rules without either
    stand under the empty token and are candidates for every URL.
    """
    known = sorted({t for r in rules for t in r.tokens})
    held: dict[str, int] = {}
    if known:
        hit = F.explode(F.array_intersect(url_tokens(F.coalesce(F.col(url_col), F.lit(""))), F.lit(known)))
        held = {r["t"]: r["n"] for r in urls.select(hit.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        for t in r.any_of or [min(r.tokens, key=lambda t: (held.get(t, 0), t), default="")]:
            index.setdefault(t, []).append(r)
    return index


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from JSON lines with the fields of Rule; fields left out are empty. Order is kept; rules are few enough for the driver."""
    schema = "verdict string, host string, path string, pattern string, literals array<string>, any_of array<string>"
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path).collect()
    return [Rule(r.verdict, r.host or "", r.path or "", r.pattern or "", tuple(r.literals or ()), tuple(r.any_of or ())) for r in rows]


def _as_struct(r: Rule) -> Column:
    return F.struct(
        F.lit(not r.pattern).alias("on_host"), F.lit(len(r.name)).alias("size"), F.lit(r.verdict == ALLOW).alias("allows"), F.lit(r.name).alias("name"), F.lit(r.regex).alias("regex")
    )


def filter_urls(urls: DataFrame, url_col: str = "url", rules: list[Rule] | None = None, max_inline: int = MAX_INLINE_RULES) -> DataFrame:
    """urls with host, path, rule and verdict (columns of these names are replaced).

    host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows up to
    `?`, `#` or the end; both empty where url is null or has no `://`. rule: the longest host rule that fits, else
    null. verdict: that rule's; else, of the pattern rules that fit, an allowing one wins over blocking ones; else allow.

    A URL's tokens fetch candidates from the index; only these run their regular expressions. Up to max_inline rules
    the index is a literal and the whole judgement one projection without a shuffle, whatever host is frequent.
    More rules are joined by token, where adaptive execution splits frequent tokens. Null and empty URLs have empty
    parts and are judged as any other; repeated rows get equal verdicts; very long URLs are judged whole; an empty table
    gives an empty result.
    """
    rules = HOST_RULES + PATTERN_RULES if rules is None else rules
    index = rarest_literals(urls, url_col, rules)
    url = F.coalesce(F.col(url_col), F.lit(""))
    t, c = free_name(urls, "_tokens"), free_name(urls, "_fits")
    base = urls.withColumns({"host": lower_ascii(F.regexp_extract(url, HOST_PATH, 1)), "path": F.regexp_extract(url, HOST_PATH, 2), t: F.concat(F.array(F.lit("")), url_tokens(url))})
    fits = lambda r: F.rlike(F.when(r["on_host"], F.concat("host", "path")).otherwise(url), r["regex"])
    if not rules:
        judged = base.withColumn(c, F.expr("cast(array() as array<struct<on_host:boolean,size:int,allows:boolean,name:string,regex:string>>)"))
    elif len(rules) <= max_inline:
        table = F.create_map(*[x for k, v in index.items() for x in (F.lit(k), F.array(*map(_as_struct, v)))])
        found = F.flatten(F.transform(F.array_intersect(F.col(t), F.lit(list(index))), lambda k: table[k]))
        judged = base.withColumn(c, F.filter(found, fits))
    else:
        row, found, held = (free_name(urls, x) for x in ("_row", "_found", "_hits"))
        spark = urls.sparkSession
        listed = spark.createDataFrame([(k, not r.pattern, len(r.name), r.verdict == ALLOW, r.name, r.regex) for k, v in index.items() for r in v], "token string, on_host boolean, size int, allows boolean, name string, regex string")
        base = base.withColumn(row, F.monotonically_increasing_id())
        probes = base.select(F.col(row).alias(found), "host", "path", url.alias("_url"), F.explode(F.array_distinct(t)).alias("token"))
        hits = probes.join(listed, "token").filter(F.rlike(F.when(F.col("on_host"), F.concat("host", "path")).otherwise(F.col("_url")), F.col("regex")))
        hits = hits.groupBy(found).agg(F.collect_list(F.struct("on_host", "size", "allows", "name", "regex")).alias(held))
        judged = base.join(hits, F.col(row) == F.col(found), "left").withColumn(c, F.coalesce(held, F.expr("cast(array() as array<struct<on_host:boolean,size:int,allows:boolean,name:string,regex:string>>)")))
    best = F.array_max(F.transform(F.filter(F.col(c), lambda r: r["on_host"]), lambda r: F.struct(r["size"], r["name"], r["allows"])))
    patterns = F.filter(F.col(c), lambda r: ~r["on_host"])
    own = F.when((F.size(patterns) == 0) | F.exists(patterns, lambda r: r["allows"]), ALLOW).otherwise(BLOCK)
    kept = [f"`{x}`" for x in urls.columns if x.lower() not in ("host", "path", "rule", "verdict")]
    return judged.select(*kept, "host", "path", best["name"].alias("rule"), F.coalesce(F.when(best["allows"], ALLOW).when(~best["allows"], BLOCK), own).alias("verdict"))
