"""URL filter: site rules by longest match, then pattern rules looked up by their rarest literal token.

A pattern is literal text in which ``*`` stands for any characters, ``^`` for one character that no word contains
(or the end), a leading ``||`` for the start of a host name or of one of its labels, and ``|`` for the start or end.
Every pattern is filed under one token (run of a-z, 0-9) that all urls it can match must contain whole: of its
candidates, the one that the fewest urls hold. The tokens of a url fetch candidate rules from that index, and only
their regular expressions run. Patterns without such a token are candidates for every url.

All work is row by row in projections: no shuffle of urls, so a hot host does not matter. The first pass counts how
many urls hold each token of the rules; its result has one row per such token.

Null urls and urls without ``://`` have an empty host and path; pattern rules see a null url as empty. Repeated rows
each get their verdict; other columns of the input are kept as they are unless named like a result column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SEPARATOR = r"(?:[^a-z0-9_.%-]|$)"

# Site rules: (verdict, host and path). Pattern rules: (id, verdict, pattern).
SITE_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
PATTERN_RULES = (
    ("ads", "block", "^ads^"), ("adserver", "block", "||adserver."), ("banner", "block", "/banner*.gif|"), ("beacon", "block", "^beacon^"),
    ("cart", "block", "/cart^"), ("casino", "block", ".casino."), ("feed", "block", "^utm_source=feed^"), ("listing", "block", "^page=*&ref="),
    ("login", "block", "/login^"), ("mobile", "block", "://m.*#top|"), ("popup", "block", "^popup^"), ("tracker", "block", "^tracker^"),
    ("blog", "allow", "://blog.*/en/"), ("imprint", "allow", "/imprint^"), ("privacy", "allow", "/privacy^"),
)


@dataclass(frozen=True)
class Pattern:
    rule: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def compiled(rule: str, verdict: str, text: str) -> Pattern:
    """The regular expression of a pattern, and the tokens that a matching url must hold whole."""
    text = text.lower()
    head, tail = "", ""
    if text.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", text[2:]
    elif text.startswith("|"):
        head, body = "^", text[1:]
    else:
        body = text
    if body.endswith("|"):
        tail, body = "$", body[:-1]
    inner = "".join(".*" if c == "*" else SEPARATOR if c == "^" else c if c.isalnum() else "\\" + c for c in body)
    tokens = []
    for m in re.finditer(r"[a-z0-9]+", body):
        before = body[m.start() - 1] if m.start() else ("|" if head else "*")
        after = body[m.end()] if m.end() < len(body) else ("|" if tail else "*")
        if before != "*" and after != "*":
            tokens.append(m.group())
    return Pattern(rule, verdict, f"(?s){head}{inner}{tail}", tuple(dict.fromkeys(tokens)))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(u, SPLIT, 1)), F.regexp_extract(u, SPLIT, 2)


def site_rule(host: Column, path: Column, rules=SITE_RULES) -> Column:
    """Struct (rule, verdict) of the longest site rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first, as it is wrapped last
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(lower_ascii(F.coalesce(url, F.lit(""))), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, patterns: list[Pattern], url: str = "url") -> dict[str, int]:
    """How many urls hold each token of the patterns; as many rows as the patterns have tokens."""
    wanted = sorted({t for p in patterns for t in p.tokens})
    if not wanted:
        return {}
    held = urls.select(F.explode(F.array_intersect(url_tokens(F.col(url)), F.array(*map(F.lit, wanted)))).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judged(urls: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, and the ids of the pattern rules that matched (``matched``, sorted, comma-joined)."""
    patterns = [compiled(*r) for r in pattern_rules]
    seen = token_counts(urls, patterns, url)
    index: dict[str, list[Pattern]] = {}
    for p in patterns:
        key = min(p.tokens, key=lambda t: (seen.get(t, 0), t)) if p.tokens else ""
        index.setdefault(key, []).append(p)

    def entry(p: Pattern) -> Column:
        return F.struct(F.lit(p.rule).alias("rule"), F.lit(p.verdict).alias("verdict"), F.lit(p.regex).alias("regex"))

    plain = lower_ascii(F.coalesce(F.col(url), F.lit("")))
    nothing = F.array().cast("array<struct<rule:string,verdict:string,regex:string>>")
    cells = [c for k, ps in index.items() if k for c in (F.lit(k), F.array(*map(entry, ps)))]
    always = F.array(*map(entry, index[""])) if "" in index else nothing
    found = always
    if cells:
        lookup = F.create_map(*cells)
        keys = F.array_intersect(F.col("_tokens"), F.map_keys(lookup))
        found = F.concat(always, F.flatten(F.transform(keys, lambda t: F.element_at(lookup, t))))
    host, path = host_and_path(F.col(url))
    own = ["host", "path", "rule", "verdict", "matched"]
    back = {c: f"k{i}" for i, c in enumerate(urls.columns) if c not in own}  # names that no step adds
    kept = [F.col(k).alias(c) for c, k in back.items()]
    out = urls.select(*[F.col(f"`{c}`").alias(k) for c, k in back.items()], host.alias("host"), path.alias("path"), plain.alias("_plain"), url_tokens(F.col(url)).alias("_tokens"))
    out = out.withColumn("_hit", F.filter(found, lambda r: F.rlike(F.col("_plain"), r["regex"])))
    out = out.withColumn("_site", site_rule(F.col("host"), F.col("path"), site_rules))
    verdicts = F.transform("_hit", lambda r: r["verdict"])
    allow, block = F.array_contains(verdicts, "allow"), F.array_contains(verdicts, "block")
    return out.select(
        *kept, "host", "path", F.col("_site.rule").alias("rule"),
        F.coalesce(F.col("_site.verdict"), F.when(block & ~allow, "block").otherwise("allow")).alias("verdict"),
        F.array_join(F.array_sort(F.transform("_hit", lambda r: r["rule"])), ",").alias("matched"),
    )


def sql(site_rules=SITE_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same verdicts with every regular expression run on every url."""
    patterns = [compiled(*r) for r in pattern_rules]
    hit = {p.rule: f"regexp_matches(u, '{p.regex}')" for p in patterns}
    case = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
                    for _, r in sorted(site_rules, key=lambda r: -len(r[1])))
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in site_rules)
    allow = " OR ".join(hit[p.rule] for p in patterns if p.verdict == "allow")
    block = " OR ".join(hit[p.rule] for p in patterns if p.verdict == "block")
    names = ", ".join(f"CASE WHEN {hit[k]} THEN '{k}' END" for k in sorted(hit))
    return f"""
WITH t AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
                  translate(regexp_extract(coalesce(url, ''), '{SPLIT}', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '{SPLIT}', 2) AS path FROM pages),
r AS (SELECT *, CASE {case} END AS rule FROM t)
SELECT page_id, host, path, rule,
       CASE {verdicts} WHEN ({block}) AND NOT ({allow}) THEN 'block' ELSE 'allow' END AS verdict,
       concat_ws(',', {names}) AS matched
FROM r"""
