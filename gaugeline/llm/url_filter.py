"""URL filters: rules are indexed by their rarest literal token, and a URL's own tokens fetch the few rules whose regular
expressions are then run.

Everything on the main path is a Spark SQL expression over one row, so a scan of any size needs no shuffle, no join and no
Python worker. The index is a literal array of hash buckets (crc32 of the token): looking a token up is one array access, so
the cost per URL is its number of tokens, not the number of rules. The rule list is a parameter from the driver, which is sent
with each task and doesn't grow with the table.

Rules look at host and path with a ``#`` between them, which neither can hold; all other characters, line ends too, may occur in both.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and gets the default verdict;
of rules that fit, the longest rule wins, then the first by code point; repeated rows each get the same answer; urls of any length are
judged whole; an empty table gives no rows; columns of the input that clash with the output names are not looked at, as only ``id_col`` and ``url_col`` are read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENTRY = "array<array<struct<t:string,n:int,r:string,v:string,e:string>>>"
#: Every key starts with these, so the token index must not use them.
_TOKEN = re.compile(r"[0-9a-z]+")


@dataclass(frozen=True)
class HostRule:
    """``host/path``: fits the host and all its subdomains when the URL's path starts with the rule's path."""

    rule: str
    verdict: str

    def literals(self) -> list[str]:
        host, slash, path = self.rule.partition("/")
        tokens = _TOKEN.findall(host.translate(str.maketrans(UPPER, LOWER)))
        # The last token of a path prefix may be a part of the URL's token, as in /en/1 and /en/17.
        whole = path if re.search(r"[^0-9a-zA-Z]$", path) else re.sub(r"[0-9a-zA-Z]+$", "", path)
        return tokens + [t for t in _TOKEN.findall(whole.translate(str.maketrans(UPPER, LOWER)))]

    def expression(self) -> str:
        host, slash, path = self.rule.partition("/")
        return rf"^(?:[^#]*\.)?{_quote(host.translate(str.maketrans(UPPER, LOWER)))}\#{_quote(slash + path)}"


@dataclass(frozen=True)
class PatternRule:
    """A host pattern: ``*`` stands for any characters; all other characters are literal. It must fit the whole host."""

    rule: str
    verdict: str

    def literals(self) -> list[str]:
        return [t for t in _TOKEN.findall(self.rule) if re.search(rf"(?<![0-9a-z*]){t}(?![0-9a-z*])", self.rule)]

    def expression(self) -> str:
        return "^" + "[^#]*".join(map(_quote, self.rule.split("*"))) + r"\#"


def _quote(text: str) -> str:
    """A regular expression for exactly this text that Java and Python read alike."""
    return re.sub(r"([^0-9A-Za-z_/ -])", r"\\\1", text)


def rarest_token(rules: Sequence[HostRule | PatternRule]) -> list[str]:
    """For each rule its literal token that the fewest rules share (ties: the longest, then by code point); empty if none."""
    counts = Counter(t for r in rules for t in set(r.literals()))
    return [min(r.literals(), key=lambda t: (counts[t], -len(t), t), default="") for r in rules]


def build_index(rules: Sequence[HostRule | PatternRule]) -> tuple[str, int]:
    """JSON of the buckets and their number. Rules without a literal token are kept under the empty token, which every URL has."""
    n = max(1, 2 * len(rules))
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for rule, token in zip(rules, rarest_token(rules), strict=True):
        buckets[zlib.crc32(token.encode()) % n].append({"t": token, "n": len(rule.rule), "r": rule.rule, "v": rule.verdict, "e": rule.expression()})
    return json.dumps(buckets), n


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(key: Column, tokens: Column, rules: Sequence[HostRule | PatternRule]) -> Column:
    """Struct (n, r, v) of the longest rule that fits ``key`` (host, #, path); null if none does."""
    index, n = build_index(rules)
    buckets = F.from_json(F.lit(index), _ENTRY)
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.get(buckets, F.pmod(F.crc32(t.cast("binary")), F.lit(n)).cast("int")), lambda e: e["t"] == t)))
    fits = F.filter(fetched, lambda e: F.regexp_like(key, e["e"]))
    return F.array_min(F.transform(fits, lambda e: F.struct((-e["n"]).alias("n"), e["r"].alias("r"), e["v"].alias("v"))))


def filter_urls(df: DataFrame, host_rules: Sequence[HostRule], pattern_rules: Sequence[PatternRule] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A row for each input row: id, host, path, rule (host rules only), verdict and the pattern rule that set the verdict.

    A host rule takes precedence; without one, the longest pattern rule decides, and without that ``default``.
    """
    host, path = split_url(F.col(url_col))
    parts = df.select(F.col(id_col), host.alias("host"), path.alias("path"))
    key = F.concat("host", F.lit("#"), "path")
    tokens = F.array_distinct(F.split(F.concat(F.lit("-"), F.translate(key, UPPER, LOWER)), "[^0-9a-z]+"))
    found = parts.select("*", best_rule(key, tokens, host_rules).alias("h"), (best_rule(key, tokens, pattern_rules) if pattern_rules else F.lit(None).cast("struct<n:int,r:string,v:string>")).alias("p"))
    return found.select(id_col, "host", "path", F.col("h.r").alias("rule"), F.coalesce("h.v", "p.v", F.lit(default)).alias("verdict"), F.when(F.col("h").isNull(), F.col("p.r")).alias("pattern"))
