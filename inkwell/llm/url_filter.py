"""URL verdicts by pattern rules that are indexed by their rarest literal token.

Each rule names literal tokens that any matching URL must hold.  A rule is filed under the one of them that the fewest
rules hold, so a URL's own tokens fetch the few rules that can match it, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

_TOKEN = re.compile(r"[a-z0-9]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Rules travel to every task, so their number is limited.
MOST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in ``host + path``.  ``literals``: lower-case tokens (runs of a-z0-9 of the URL) of which
    every match holds all.  ``name``: the rule as it is reported; None for a rule of the method itself."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None
    reach: int = 0


def place_rule(verdict: str, place: str) -> Rule:
    """A rule ``host/path``: it fits the host and all subdomains if the URL's path starts with the rule's."""
    host, slash, path = place.partition("/")
    pattern = rf"^(?:[^/?#]*\.)?{re.escape(host)}" + (re.escape(slash + path) if slash else r"(?:/|$)")
    # The last token of the path may go on in the URL, so it need not be a whole token there.
    of_path = _TOKEN.findall(path.lower())
    if of_path and not place.endswith("/"):
        of_path.pop()
    return Rule(verdict, pattern, tuple(dict.fromkeys([*_TOKEN.findall(host), *of_path])), place, len(place))


#: Words that stand for unwanted sites as a whole part of a host name (parts end at dots and dashes), by subject.
HOST_WORDS = {
    "adult": "adult escort hentai nude porn sexcam webcam xxx",
    "gambling": "betting bingo casino jackpot lottery poker roulette slots",
    "pharmacy": "cheap-meds cheap-pills cialis online-pharmacy pills viagra",
    "piracy": "crack free-download keygen torrent warez",
    "spam": "article-spinner buy-followers content-farm link-farm payday-loan seo-links spam-farm",
}
#: Paths that hold no text of a site: programs, archives, logins, search results, feeds, endless calendars.
PATHS = {
    **{rf"\.{suffix}$": (suffix,) for suffix in "apk exe msi gz iso rar zip".split()},
    r"/wp-(?:admin|login)": ("wp",),
    r"/cgi-bin/": ("cgi", "bin"),
    r"/xmlrpc\.php$": ("xmlrpc", "php"),
    **{rf"/{word}/?$": (word,) for word in "search suche recherche buscar".split()},
    r"/feed/?$": ("feed",),
    r"/calendar/[0-9]{4}/[0-9]{1,2}/": ("calendar",),
    r";jsessionid=": ("jsessionid",),
}
#: The method's own rules, for URLs that no given rule fits.
OWN_RULES = (
    *(Rule("block", rf"^(?:[^/]*[.-])?{word}[.-]", tuple(word.split("-"))) for words in HOST_WORDS.values() for word in words.split()),
    *(Rule("block", pattern, literals) for pattern, literals in PATHS.items()),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/ ? #``, A-Z lower-cased; then up to ``? #``.  Else both empty."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(_LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


class RuleIndex:
    def __init__(self, rules: tuple[Rule, ...]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        held = Counter(t for r in rules for t in r.literals)
        self.by_token: dict[str, list[tuple[Rule, re.Pattern]]] = defaultdict(list)
        for rule in rules:
            rarest = min(rule.literals, key=lambda t: (held[t], -len(t), t)) if rule.literals else ""
            self.by_token[rarest].append((rule, re.compile(rule.pattern)))

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(name of the longest given rule that fits, verdict); ties go to the name that sorts first."""
        url = host + path
        best = own = None
        for token in {"", *_TOKEN.findall(url.lower())}:
            for rule, pattern in self.by_token.get(token, ()):
                if rule.name is None:
                    own = own or (rule if pattern.search(url) else None)
                elif (best is None or (-rule.reach, rule.name) < (-best.reach, best.name)) and pattern.search(url):
                    best = rule
        return (best.name, best.verdict) if best else (None, own.verdict if own else "allow")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], *, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict for every row; no shuffle.

    A null URL or one without ``://`` has an empty host and path, so only a rule without literals could fit it; it is
    allowed.  A URL of any length is judged whole.  Null keys and repeated rows are kept as they are, an empty table gives no
    rows, and other columns are not looked at.
    """
    schema = f"{key} {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for batch in batches:
            split = [split_url(u) for u in batch.column(url).to_pylist()]
            judged = [index.judge(*s) for s in split]
            columns = [[s[0] for s in split], [s[1] for s in split], [j[0] for j in judged], [j[1] for j in judged]]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c, pa.string()) for c in columns)], names=[key, "host", "path", "rule", "verdict"])

    return pages.select(key, url).mapInArrow(run, schema)


#: The rules of the query, as given.
GIVEN = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), (*(place_rule(*g) for g in GIVEN), *OWN_RULES))


ORACLE_SQL = (
    r"""
WITH rest AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), split AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), fits AS (
  SELECT *, host || path AS u, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN """
    + " OR ".join(f"regexp_matches(u, '{r.pattern}')" for r in OWN_RULES)
    + """ THEN 'block'
  ELSE 'allow' END AS verdict
FROM fits
"""
)
