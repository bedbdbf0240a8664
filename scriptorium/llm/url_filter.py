"""URL filtering by pattern rules indexed by their rarest literal token, in native expressions.

Every rule is a regular expression over host and path, with the literal tokens that any URL it fits must contain: words
between other characters, or stretches of six characters of a host, for rules on a part of a word. A rule is filed
under its rarest token, the one that fewest rules share. The index is a hash table: an array of buckets
that travels in the plan as one literal, so a URL's tokens fetch their candidates by position, without a join or a
shuffle, and only the candidates' expressions run. The rule set is a parameter and its size is checked.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.native import columns_of, fresh, let

MAX_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Length of the stretches of a host that are tokens too, and what marks them.
_PART, _PART_MARK = 6, "~"
_INDEX = "array<array<struct<token:string,name:string,action:string,pattern:string,listed:boolean,size:int>>>"


@dataclass(frozen=True)
class Rule:
    """action allow or block; pattern is searched in host + path; tokens must all occur in a URL that it fits.

    A listed rule is a host and path prefix that decides by itself, the longest first; the others are the method's
    own patterns, which decide where no listed rule does.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool


def listed_rule(action: str, name: str) -> Rule:
    """A rule written host/path: it fits the host, its subdomains, and paths that start with the path."""
    host, slash, rest = name.partition("/")
    prefix = slash + rest
    closed = prefix if not prefix or not prefix[-1].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", prefix)
    tokens = re.findall(r"[a-z0-9]+", f"{host}{closed}".lower())
    return Rule(name, action, rf"^(?:[^/]*\.)?{re.escape(host)}(?![^/]){re.escape(prefix)}", tuple(dict.fromkeys(tokens)), True)


def pattern_rule(name: str, pattern: str, *tokens: str) -> Rule:
    """A blocking pattern of the method's own."""
    return Rule(name, "block", pattern, tokens, False)


#: Fixed value: the rule list that the registered query judges by.
LISTED = (
    listed_rule("allow", "com/"),
    listed_rule("block", "example.com/en/"),
    listed_rule("allow", "www.example.com/en/"),
    listed_rule("block", "net/es/"),
    listed_rule("block", "net/fr/"),
)
#: The method's own patterns: hosts and paths that rarely carry prose worth keeping.
HOST_WORDS = (
    "spam pills casino casinos porn porno pornhub torrent torrents xxx viagra cialis poker betting gambling escort escorts sex adult warez crack"
    " keygen payday loans replica slots jackpot hentai"
).split()
HOST_PARTS = "casino viagra torrent hentai gambling".split()
AD_HOSTS = "ads adserver adservice doubleclick".split()
PAGE_WORDS = "login signin signup register logout account cart checkout basket admin".split()
PATTERNS = (
    *(pattern_rule(f"{w}-host", rf"^[^/]*(?<![a-z0-9]){w}(?![a-z0-9])", w) for w in HOST_WORDS),
    *(pattern_rule(f"{w}-in-host", rf"^[^/]*{w}", f"{_PART_MARK}{w[:_PART]}") for w in HOST_PARTS),
    *(pattern_rule(f"{w}-server", rf"^(?:[^/]*\.)?{w}\.[^/]*", w) for w in AD_HOSTS),
    *(pattern_rule(f"{w}-page", rf"(?i)/{w}(?:[/.]|$)", w) for w in PAGE_WORDS),
    pattern_rule("wp-admin-page", r"(?i)/wp-admin(?:[/.]|$)", "wp", "admin"),
)


def _indexed(rules: tuple[Rule, ...]) -> tuple[Column, int]:
    """The literal hash table and its number of buckets."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index in the plan is for {MAX_RULES} at most")
    shared = Counter(t for r in rules for t in set(r.tokens))
    buckets: list[list[dict]] = [[] for _ in range(1 << max(4, (2 * len(rules)).bit_length()))]
    for rule in rules:
        if not rule.tokens:
            raise ValueError(f"rule {rule.name} has no literal token to be filed under")
        rarest = min(rule.tokens, key=lambda t: (shared[t], -len(t), t))
        filed = {"token": rarest, "name": rule.name, "action": rule.action, "pattern": rule.pattern, "listed": rule.listed, "size": len(rule.name)}
        buckets[zlib.crc32(rarest.encode()) % len(buckets)].append(filed)
    return F.from_json(F.lit(json.dumps(buckets)), _INDEX), len(buckets)


def host_and_path(url: Column) -> Column:
    """A struct of host and path; both are empty for a null url or one without ``://``."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substr(url, mark + 3)).otherwise(F.lit(""))

    def split(r: Column) -> Column:
        host = F.regexp_extract(r, r"^[^/?#]*", 0)
        path = let(host, lambda h: F.regexp_extract(F.substr(r, F.length(h) + 1), r"^[^?#]*", 0))
        return F.struct(F.translate(host, _UPPER, _LOWER).alias("host"), path.alias("path"))

    return let(rest, split)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS) -> DataFrame:
    """``pages`` (with url) plus host, path, rule (the longest fitting listed rule or null), pattern (the first fitting
    own pattern by name, or null) and verdict.

    Defined cases: a null, empty or odd url has empty host and path, fits no rule and is allowed; repeated rows are
    judged alike; of listed rules of equal length the first by name wins; a url of any length is judged whole; an
    empty table gives an empty result; columns named host, path, rule, pattern or verdict, in any case, are replaced,
    the others are carried along whatever their names.
    """
    index, buckets = _indexed(rules)
    made = ("host", "path", "rule", "pattern", "verdict")
    at, fit = fresh(pages, "url_at"), fresh(pages, "url_fit")

    def bucket(token: Column) -> Column:
        found = F.get(index, (F.crc32(token.cast("binary")) % buckets).cast("int"))
        return F.filter(found, lambda r: r["token"] == token)

    host = F.col(f"{at}.host")
    parts = F.when(F.length(host) >= _PART, F.transform(F.sequence(F.lit(1), F.length(host) - _PART + 1), lambda i: F.concat(F.lit(_PART_MARK), F.substr(host, i, F.lit(_PART)))))

    def fitting(place: Column) -> Column:
        words = F.split(F.lower(place), "[^a-z0-9]+")
        tokens = F.array_distinct(F.concat(words, F.coalesce(parts, F.array().cast("array<string>"))))
        return F.filter(F.flatten(F.transform(tokens, bucket)), lambda r: F.rlike(place, r["pattern"]))

    def first(found: Column, listed: bool) -> Column:
        ranked = F.transform(F.filter(found, lambda r: r["listed"] == listed), lambda r: F.struct((-r["size"] if listed else F.lit(0)).alias("rank"), r["name"].alias("name"), r["action"].alias("action")))
        return F.array_min(ranked)

    verdicts = let(let(F.concat(F.col(f"{at}.host"), F.col(f"{at}.path")), fitting), lambda found: F.struct(first(found, True).alias("listed"), first(found, False).alias("own")))
    carried = columns_of(pages, without=made)
    out = pages.select(*carried, host_and_path(F.col("url")).alias(at)).select(*carried, at, verdicts.alias(fit))
    listed, own = F.col(f"{fit}.listed"), F.col(f"{fit}.own")
    values = (F.col(f"{at}.host"), F.col(f"{at}.path"), listed["name"], own["name"], F.coalesce(listed["action"], own["action"], F.lit("allow")))
    return out.select(*carried, *(v.alias(n) for v, n in zip(values, made)))
