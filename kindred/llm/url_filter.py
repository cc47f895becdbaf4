"""URL filters: host rules with paths, then a weighted vocabulary counted by an Aho-Corasick automaton.

A strict term weighs as much as the limit, a soft one weighs 1; each distinct term counts once, and only where no
ASCII letter or digit touches it. A url is blocked when the weights reach the limit: one strict term, or several
distinct soft ones. A host rule that fits decides before the vocabulary; the longest rule wins.

Defined results: a null url, or one without "://", has empty host and path, and its text (null: empty) still goes
through the vocabulary; repeated rows give repeated results; an empty table gives an empty result; other columns
are not read. Urls are taken whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, slices

# Fixed values of the production filter.
STRICT_TERMS = ("adult", "casino", "escort", "malware", "phishing", "porn", "sex", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "bonus", "buy", "cheap", "click", "coupon", "crack", "deal", "discount", "download", "farm",
    "free", "jackpot", "loan", "loans", "lottery", "meds", "pills", "poker", "prize", "promo", "replica", "slots",
    "track", "tracker", "win", "winner",
)
SOFT_LIMIT = 2
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)


@dataclass(frozen=True)
class Vocabulary:
    """``limit``: distinct soft terms that block a url; a strict term alone does."""

    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    limit: int = SOFT_LIMIT

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for weight, terms in ((1, self.soft), (self.limit, self.strict)):
            for t in terms:
                out.add_word(t, (len(t), t, weight))
        out.make_automaton()
        return out


_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDLY = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """The authority after the first "://" in lower case, and the path up to a query or fragment."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[cut:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:cut].translate(_UPPER), path[:stop]


def rule_table(rules: tuple[tuple[str, str], ...]) -> dict[str, list[tuple[str, str, str]]]:
    """By rule host: (path prefix, rule, action), the longest rule first."""
    out: dict[str, list[tuple[str, str, str]]] = {}
    for rule, action in sorted(rules, key=lambda r: -len(r[0])):
        host, slash, path = rule.partition("/")
        out.setdefault(host, []).append((slash + path, rule, action))
    return out


def matching_rule(host: str, path: str, table: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule that fits the host or a domain above it, and the path; its action."""
    best: tuple[str, str] | None = None
    at = 0
    while host:
        for prefix, rule, action in table.get(host[at:], ()):
            if path.startswith(prefix):
                if best is None or len(rule) > len(best[0]):
                    best = rule, action
                break
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def hits(url: str | None, automaton) -> dict[str, int]:
    """Distinct terms that stand alone in the url, with their weights."""
    low = (url or "").translate(_UPPER)
    out: dict[str, int] = {}
    for end, (n, term, weight) in automaton.iter(low):
        before, after = end - n, end + 1
        if (before < 0 or low[before] not in _WORDLY) and (after >= len(low) or low[after] not in _WORDLY):
            out[term] = weight
    return out


def judge(df: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, vocabulary: Vocabulary = Vocabulary(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits int) for every row."""
    df = only(df, id_col, url_col)
    kind = df.schema[id_col].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table, limit = vocabulary.automaton(), rule_table(rules), vocabulary.limit
        for b in slices(batches, url_col):
            hosts, paths, fits, verdicts, strict, soft = [], [], [], [], [], []
            for url in b.column(1).to_pylist():
                host, path = host_and_path(url)
                fit = matching_rule(host, path, table)
                found = hits(url, automaton)
                weight = sum(found.values())
                hosts.append(host)
                paths.append(path)
                fits.append(fit and fit[0])
                verdicts.append(fit[1] if fit else "block" if weight >= limit else "allow")
                hard = sum(w >= limit for w in found.values())
                strict.append(hard)
                soft.append(len(found) - hard)
            cols = [b.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, fits, verdicts)), pa.array(strict, pa.int32()), pa.array(soft, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return df.mapInArrow(decide, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def sql(rules: tuple[tuple[str, str], ...] = RULES, vocabulary: Vocabulary = Vocabulary()) -> str:
    """The same in SQL over the table ``pages``."""
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    count = lambda terms: " + ".join(f"cast(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') as int)" for t in terms)
    fits = []
    for rule, _ in rules:
        host, slash, path = rule.partition("/")
        fits.append(f"select page_id, host, path, '{rule}' as rule from h where (host = '{host}' or suffix(host, '.{host}')) and prefix(path, '{slash}{path}')")
    actions = " ".join(f"when rule = '{r}' then '{a}'" for r, a in rules)
    return f"""
with l as (select page_id, {low} as low, coalesce(url, '') as u, strpos(coalesce(url, ''), '://') as pos from pages),
r as (select *, case when pos > 0 then substr(u, pos + 3) else '' end as rest from l),
p as (select *, regexp_extract(rest, '^[^/?#]*') as raw_host from r),
h as (select *, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path,
             {count(vocabulary.strict)} as strict_hits, {count(vocabulary.soft)} as soft_hits from p),
f as ({" union all ".join(fits)}),
b as (select page_id, host, path, rule from (select *, row_number() over (partition by page_id, host, path order by length(rule) desc) as k
      from (select distinct page_id, host, path, rule from f) q) q where k = 1)
select h.page_id, h.host, h.path, b.rule,
       case {actions} when strict_hits >= 1 or soft_hits >= {vocabulary.limit} then 'block' else 'allow' end as verdict,
       cast(strict_hits as int) as strict_hits, cast(soft_hits as int) as soft_hits
from h left join b on h.page_id = b.page_id and h.host = b.host and h.path = b.path
"""
