"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

Pattern rules are written like block lists: ``*`` stands for any characters,
``^`` for a separator or the end, a leading ``||`` for the start of the host or
of one of its labels, and everything else for itself, in any case.  A literal
token of a rule is a run of letters and digits that must be a whole token of
every url it matches.  Over all urls the rule tokens are counted, each rule is
filed under its rarest one, and a url runs only the regular expressions of
rules filed under one of its own tokens.  Rules without such a token run on
every url.

Host rules (host, path) come first: the longest fitting one decides.

Nulls and urls without ``://`` have an empty host and path; they fit no host
rule and no pattern rule of a host, and the other pattern rules see the whole
url.  Repeated rows are judged alike, an empty table gives an empty result, and
other columns are ignored.  Of host rules of equal length that fit, and of
pattern rules that hit, the first one listed is reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import map_rows

_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    text: str
    verdict: str = "block"

    @property
    def of_host(self) -> bool:
        return self.text.startswith("||")

    @property
    def expression(self) -> str:
        """For the url, or for what follows its first ``://`` if the rule is one of hosts."""
        body, anchor = (self.text[2:], r"^(?:[^/?#]*\.)?") if self.of_host else (self.text, "")
        return "(?s)" + anchor + "".join({"*": ".*", "^": r"(?:[^a-z0-9%._-]|$)"}.get(c, re.escape(c)) for c in body.lower())

    def hits(self, url: str) -> bool:
        """Whether the rule fits a lower-cased url."""
        _, mark, rest = url.partition("://")
        return (bool(mark) or not self.of_host) and re.search(self.expression, rest if self.of_host else url) is not None

    @property
    def tokens(self) -> list[str]:
        """Runs that whole tokens of a matching url must equal: bounded by literal non-token characters or anchors."""
        body = self.text.lower()
        start_is_edge = self.of_host
        body = body[2:] if start_is_edge else body
        out = []
        for m in _TOKEN.finditer(body):
            left = body[m.start() - 1] if m.start() else ("|" if start_is_edge else "*")
            right = body[m.end()] if m.end() < len(body) else "*"
            if "*" not in (left, right):
                out.append(m[0])
        return out


#: The contract's host rules.
HOST_RULES = (HostRule("net", "/", "block"), HostRule("example.net", "/en/", "allow"), HostRule("example.com", "/de/", "block"), HostRule("org", "/fr/", "allow"))

#: Adverts, gambling, pills and trackers.
PATTERN_RULES = tuple(
    PatternRule(x)
    for x in (
        "||ads.", "||ads-track.", "||ad.", "||adserver.", "||banner.", "||doubleclick.", "||popads.", "||track.", "||tracker.", "||tracking.",
        "||casino-win.", "||casino.", "||free-bets.", "||bets.", "||betting.", "||poker.", "||slots.", "||cheap-pills.", "||pills.", "||viagra.",
        "-casino-", ".casino-", "-bets.", "-pills.", "/ads/", "/adserver/", "/banner/", "/banners/", "/casino/", "/popup/", "/viagra/",
        "?ad_id=", "&ad_id=", "||xxx.", "||porn.", "/porn/", "||adult-", "||warez.", "/warez/", "||torrent.", "/phishing/",
    )
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def host_rule(host: str, path: str, rules: tuple[HostRule, ...]) -> HostRule | None:
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def token_counts(df: DataFrame, tokens: set[str], url_col: str = "url") -> dict[str, int]:
    """Urls that have each of the rules' tokens; tokens of no rule are dropped before the count."""
    found = F.array_intersect(F.array_distinct(F.split(F.lower(url_col), "[^a-z0-9]+")), F.array(*map(F.lit, sorted(tokens))))
    return {r["t"]: r["n"] for r in df.select(F.explode(found).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def index_rules(rules: tuple[PatternRule, ...], counts: dict[str, int]) -> tuple[dict[str, list[PatternRule]], list[PatternRule]]:
    """Rules by their rarest token, and the rules that have none."""
    index: dict[str, list[PatternRule]] = {}
    always = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    return index, always


def judge_urls(
    df: DataFrame,
    patterns: tuple[PatternRule, ...] = PATTERN_RULES,
    hosts: tuple[HostRule, ...] = HOST_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row."""
    index, always = index_rules(patterns, token_counts(df, {t for r in patterns for t in r.tokens} or {""}, url_col))
    order = {r.text: i for i, r in enumerate(patterns)}
    fields = [T.StructField("page_id", df.schema[id_col].dataType), *(T.StructField(x, T.StringType()) for x in ("host", "path", "rule", "verdict", "pattern"))]

    def make():
        def judge(key, url):
            host, path = split_url(url)
            if rule := host_rule(host, path, hosts):
                return key, host, path, rule.text, rule.verdict, None
            low = (url or "").lower()
            candidates = {r.text: r for t in _TOKEN.findall(low) for r in index.get(t, ())} | {r.text: r for r in always}
            hits = [r for r in candidates.values() if r.hits(low)]
            hit = min(hits, key=lambda r: order[r.text], default=None)
            return key, host, path, None, hit.verdict if hit else "allow", hit.text if hit else None

        return judge

    return map_rows(df, [F.col(id_col), F.col(url_col)], make, T.StructType(fields))
