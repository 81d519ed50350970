"""URL filters: host and path rules, and patterns indexed by their rarest literal.

A base rule names a host and a path prefix; it fits the host and all its
subdomains and the longest fitting rule decides.  Other URLs are judged by
pattern rules.  Each pattern lists literal tokens that every URL it matches
must contain, alone or glued to other characters (``cams`` in ``sexcams``).
Counts of the URLs that contain them (one aggregate, a row for each literal)
tell the rarest one, under which the rule is filed; the literals of a URL then
fetch the few rules that could match, and only their regular expressions run.
A URL is blocked if any of them matches; which literal a rule is filed under
changes only how often its expression runs, never the verdict.

Defined results: a null URL or one without ``://`` has an empty host and path
and, like every URL that no rule fits, is allowed; repeated rows are judged
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import clean_columns

# The base rules as (verdict, host and path).
BASE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

TOKEN = r"[0-9a-z]+"
#: Characters by which literals are looked up in a URL; shorter ones by all of theirs.
GRAM = 3


@dataclass(frozen=True)
class Pattern:
    """A blocking rule: literals that all occur in whatever matches, and the expression that decides (on the lower-cased URL)."""

    name: str
    tokens: tuple[str, ...]
    regex: str


PATTERNS = (
    Pattern("adult-host", ("adult",), r"://([^/?#]*[.-])?adult[.-]"),
    Pattern("adult-host-words", ("xxx",), r"://([^/?#]*[.-])?xxx[.-]"),
    Pattern("porn-host", ("porn",), r"://([^/?#]*[.-])?porn[.-]"),
    Pattern("sex-cams", ("sex", "cams"), r"://[^/?#]*sex-?cams"),
    Pattern("free-bets", ("free", "bets"), r"://([^/?#]*\.)?free-bets[.-]"),
    Pattern("bets-host", ("bet",), r"://([^/?#]*[.-])?bet[.-]"),
    Pattern("casino-host", ("casino",), r"://([^/?#]*[.-])?casino[.-]"),
    Pattern("casino-path", ("casino", "bonus"), r"/casino[-_/]bonus"),
    Pattern("poker-host", ("poker",), r"://([^/?#]*[.-])?poker[.-]"),
    Pattern("spam-farm", ("spam", "farm"), r"://([^/?#]*\.)?spam-farm[.-]"),
    Pattern("link-farm", ("link", "farm"), r"://([^/?#]*\.)?link-farm[.-]"),
    Pattern("cheap-pills", ("cheap", "pills"), r"cheap-pills"),
    Pattern("payday-loans", ("payday", "loans"), r"payday-loans"),
    Pattern("phishing-login", ("secure", "login", "verify"), r"://[^/?#]*secure[.-][^/?#]*login.*verify"),
    Pattern("malware-host", ("malware",), r"://([^/?#]*[.-])?malware[.-]"),
    Pattern("warez", ("warez",), r"[./-]warez[./-]"),
    Pattern("keygen", ("keygen",), r"[./_-]keygen([./_-]|$)"),
    Pattern("ad-server", ("ad",), r"://ads?\.[^/?#]*/"),
    Pattern("ad-tracker", ("doubleclick",), r"://([^/?#]*\.)?doubleclick\."),
    Pattern("program-file", ("exe",), r"\.exe([?#]|$)"),
    Pattern("installer-file", ("msi",), r"\.msi([?#]|$)"),
    Pattern("package-file", ("apk",), r"\.apk([?#]|$)"),
    Pattern("archive-file", ("torrent",), r"\.torrent([?#]|$)"),
    Pattern("admin-login", ("wp", "login", "php"), r"/wp-login\.php([?#]|$)"),
    Pattern("server-config", ("phpmyadmin",), r"/phpmyadmin(/|$)"),
)


def host_and_path(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    before_query = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = before_query.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


class BaseRules:
    """The longest rule of a host's domains whose path begins the URL's."""

    def __init__(self, rules=BASE_RULES):
        self.by_domain = defaultdict(list)
        for verdict, rule in rules:
            domain, slash, path = rule.partition("/")
            self.by_domain[domain].append((len(rule), rule, slash + path, verdict))
        for found in self.by_domain.values():
            found.sort(reverse=True)

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        labels, fits = host.split("."), []
        for i in range(len(labels)):
            for length, rule, prefix, verdict in self.by_domain.get(".".join(labels[i:]), ()):
                if path.startswith(prefix):
                    fits.append((length, rule, verdict))
                    break
        return max(fits)[1:] if fits else None


class Literals:
    """Finds which literals stand anywhere in a URL, by the grams they begin with."""

    def __init__(self, literals):
        tables: dict[int, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for literal in dict.fromkeys(literals):
            tables[min(len(literal), GRAM)][literal[:GRAM]].append(literal)
        self.tables = [(size, frozenset(table), dict(table)) for size, table in sorted(tables.items())]

    def find(self, low: str) -> list[str]:
        found = []
        for size, grams, table in self.tables:
            for gram in grams & {low[i:i + size] for i in range(len(low) - size + 1)}:
                found += [literal for literal in table[gram] if literal in low]
        return found


class PatternIndex:
    """Patterns filed under their rarest literal."""

    def __init__(self, patterns, token_counts: dict[str, int]):
        self.by_token = defaultdict(list)
        for i, p in enumerate(patterns):
            rarest = min(p.tokens, key=lambda t: (token_counts.get(t, 0), -len(t), t))
            self.by_token[rarest].append((i, p.name, re.compile(p.regex)))
        self.literals = Literals(self.by_token)

    def first_match(self, url: str) -> str | None:
        """The first of the patterns, in their own order, that matches."""
        low = url.lower()
        fetched = [rule for token in self.literals.find(low) for rule in self.by_token[token]]
        for _, name, regex in sorted(fetched, key=lambda rule: rule[0]):
            if regex.search(low):
                return name
        return None


def token_counts(pages: DataFrame, patterns=PATTERNS) -> dict[str, int]:
    """How many URLs contain each literal of the rules (at most a row for each)."""
    wanted = sorted({t for p in patterns for t in p.tokens})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        literals, counts = Literals(wanted), Counter()
        for batch in batches:
            for url in batch.column("url").to_pylist():
                counts.update(literals.find(url.lower()) if url else ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                         names=["token", "n"])

    counted = pages.select("url").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counted.collect()}


def judge_urls(pages: DataFrame, base_rules=BASE_RULES, patterns=PATTERNS) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (which one blocked it) for each page."""
    pages = clean_columns(pages, "page_id", "url")
    counts = token_counts(pages, patterns)
    id_type = pages.schema["page_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, index = BaseRules(base_rules), PatternIndex(patterns, counts)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = host_and_path(url)
                fit = base.best(host, path)
                hit = None if fit or url is None else index.first_match(url)
                rows.append((host, path, fit[0] if fit else None,
                             fit[1] if fit else "block" if hit else "allow", hit))
            host, path, rule, verdict, hit = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), *[pa.array(c, pa.string()) for c in (host, path, rule, verdict, hit)]],
                names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return pages.mapInArrow(judge, f"page_id {id_type}, host string, path string, rule string, verdict string, "
                                   "pattern string")


def op8_query(pages: DataFrame) -> DataFrame:
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _sql_list(rules) -> str:
    return ", ".join(f"('{v}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{r}')" for v, r in rules)


def _sql_pattern(p: Pattern) -> str:
    return f"regexp_matches(lower(url), '{p.regex}')"


ORACLE_SQL = f"""
WITH base(b_verdict, b_host, b_path, b_rule) AS (VALUES {_sql_list(BASE_RULES)}),
cut AS (
  SELECT page_id, url,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*')
              ELSE '' END AS raw_host,
         CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1)
              ELSE '' END AS path
  FROM pages),
split AS (
  SELECT page_id, url, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path
  FROM cut),
fits AS (
  SELECT s.*, b_rule, b_verdict,
         row_number() OVER (PARTITION BY page_id, url ORDER BY length(b_rule) DESC NULLS LAST) AS r
  FROM split s LEFT JOIN base
    ON (host = b_host OR ends_with(host, '.' || b_host)) AND starts_with(path, b_path))
SELECT page_id, host, path, b_rule AS rule,
       CASE WHEN b_rule IS NOT NULL THEN b_verdict
            WHEN {' OR '.join(_sql_pattern(p) for p in PATTERNS)} THEN 'block' ELSE 'allow' END AS verdict
FROM fits WHERE r = 1
"""
