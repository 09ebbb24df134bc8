"""URL filters: rules found by their rarest literal token, then matched by regular expression; DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A pattern over `host + path`. tokens: literal tokens that every match holds as whole tokens; none: the rule runs on every URL."""

    name: str
    pattern: str
    action: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(host: str, path: str, action: str) -> Rule:
    """Fits the host and its subdomains if the URL's path starts with `path`; longer rules win."""
    # the last piece of a path may go on in the URL, so it is no whole token unless something ends it
    whole = f"{host}{path}".lower()
    tokens = [m.group() for m in _TOKEN.finditer(whole) if m.end() < len(whole)]
    return Rule(host + path, rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", action, tuple(tokens), len(host + path))


def pattern_rule(pattern: str, action: str = "block") -> Rule:
    """Fits a URL whose host + path, in any case of A-Z, holds the pattern: `*` stands for any run of characters, `^` for one character that
    is no ASCII letter or digit, or for an end, `|` as the first or last character for an end, all else for itself.

    A piece of letters and digits is a whole token of every match if on either side something other than `*` ends it; a pattern may have none.
    """
    first, last = pattern.startswith("|"), pattern.endswith("|") and len(pattern) > 1
    body = pattern[first : len(pattern) - last].lower()
    signs = {"*": ".*", "^": r"(?:[^a-z0-9]|\A|\z)"}
    regex = r"\A" * first + "".join(signs.get(c) or re.escape(c) for c in body) + r"\z" * last
    ended = lambda c, anchor: c not in ("", "*") or (c == "" and anchor)
    tokens = [m.group() for m in _TOKEN.finditer(body) if ended(body[: m.start()][-1:], first) and ended(body[m.end() :][:1], last)]
    return Rule(pattern, f"(?is){regex}", action, tuple(tokens), 0)


#: What a crawl is better without, where no host rule fits: spam and adult words, downloads, pages of no content, traps for crawlers.
PATTERNS = (
    "^spam^", "^spam*farm^", "^pills^", "^cheap-*-pills^", "^viagra^", "^casino^", "^online-casino*^", "^poker^", "^betting^", "^porn^", "^xxx^", "^sex^", "^escort^", "^warez^", "^torrent^", "^malware^", "^phishing^",
    "^cgi-bin^", "^wp-login.php|", "^wp-admin^", "^cart^checkout^", "^calendar^*^print|", "*.exe|", "*.zip|", "^tag^*^page^*^page^", "//", "|-",
)
PATTERN_RULES = tuple(pattern_rule(p) for p in PATTERNS)


def _lowered(x: Column) -> Column:
    """A-Z only: other letters end a token whatever their case."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no `://`."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = _lowered(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def tokens(whole: Column) -> Column:
    return F.array_distinct(F.split(_lowered(whole), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, column: str, literals: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' literal tokens stands, over all rows: at most one row per literal reaches the driver."""
    host, path = parts(F.col(column))
    found = urls.select(F.explode(F.array_intersect(tokens(F.concat(host, path)), F.array(*[F.lit(x) for x in literals]))).alias("token"))
    return {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge(urls: DataFrame, rules: list[Rule] | tuple[Rule, ...], key: str = "page_id", url: str = "url", default: str = "allow", most_rules: int = 10_000) -> DataFrame:
    """(key, host, path, rule, pattern, verdict, candidates) for every row of urls.

    Each rule is indexed under the literal token of its own that is rarest over all URLs. A URL's tokens fetch their rules from that
    index, a literal of the plan whose size is the rule set's (`most_rules` at most), so no row moves between executors, whatever key
    repeats. Only fetched rules run their regular expressions. The heaviest fitting rule decides, ties by name; `rule` names it if it is
    a host rule, `pattern` if it is another. Null or malformed URLs have an empty host and path and get `default`, as have URLs that no
    rule fits. Repeated rows and null keys stay; other columns are dropped.
    """
    rules = list(rules)
    if len(rules) > most_rules:
        raise ValueError(f"{len(rules)} rules; the index is a literal of the plan and holds {most_rules}")
    host, path = parts(F.col(url))
    base = urls.select(F.col(key), host.alias("host"), path.alias("path")).withColumn("_whole", F.concat("host", "path"))
    if not rules:
        return base.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pattern"), F.lit(default).alias("verdict"), F.lit(0).alias("candidates"))
    literals = sorted({t for r in rules for t in r.tokens})
    counts = token_counts(urls, url, literals) if literals else {}
    index: dict[str, list[Rule]] = {}
    always = []
    for r in rules:
        if r.tokens:
            index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
        else:
            always.append(r)

    def literal(some: list[Rule]) -> Column:
        return F.array(*[F.struct(F.lit(r.weight).alias("weight"), F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("regex")) for r in some])

    kind = "array<struct<weight:int,name:string,action:string,regex:string>>"
    none = F.array().cast(kind)
    fetched = none
    if index:
        table = F.create_map(*[c for t in sorted(index) for c in (F.lit(t), literal(index[t]).cast(kind))])
        known = F.array(*[F.lit(t) for t in sorted(index)])
        fetched = F.flatten(F.transform(F.array_intersect(tokens(F.col("_whole")), known), lambda t: F.element_at(table, t)))
    candidates = F.concat(fetched, literal(always).cast(kind)) if always else fetched
    base = base.withColumn("_candidates", candidates)
    fits = F.filter("_candidates", lambda r: F.rlike(F.col("_whole"), r["regex"]))
    best = F.try_element_at(F.sort_array(F.transform(fits, lambda r: F.struct((-r["weight"]).alias("w"), r["name"].alias("name"), r["action"].alias("action")))), F.lit(1))
    base = base.withColumn("_best", best)
    of_host = F.col("_best")["w"] < 0
    return base.select(
        key, "host", "path", F.when(of_host, F.col("_best")["name"]).alias("rule"), F.when(~of_host, F.col("_best")["name"]).alias("pattern"),
        F.coalesce(F.col("_best")["action"], F.lit(default)).alias("verdict"), F.size("_candidates").alias("candidates"))


#: The rules of the registered query.
HOST_RULES = (
    host_rule("org", "/", "allow"), host_rule("example.org", "/es/", "block"), host_rule("example.org", "/en/1", "block"),
    host_rule("com", "/fr/", "allow"), host_rule("com", "/de/", "block"),
)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), HOST_RULES + PATTERN_RULES).drop("candidates")


ORACLE = r"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM u),
r(host_r, path_r, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                    ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
w(name, pattern) AS (VALUES %s),
c AS (SELECT page_id, h.host, h.path,
        (SELECT max(struct_pack(n := length(host_r || path_r), name := host_r || path_r, action := action)) FROM r
          WHERE (h.host = host_r OR h.host LIKE '%%.' || host_r) AND starts_with(h.path, path_r)) AS best,
        (SELECT min(name) FROM w WHERE regexp_matches(translate(h.host || h.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), w.pattern)) AS pat
      FROM h)
SELECT page_id, host, path, best.name AS rule, CASE WHEN best IS NULL THEN pat END AS pattern,
       coalesce(best.action, CASE WHEN pat IS NOT NULL THEN 'block' END, 'allow') AS verdict FROM c
""" % ", ".join(f"('{r.name}', '{r.pattern}')" for r in PATTERN_RULES)
