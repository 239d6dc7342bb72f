"""URL filter: rules first, then trust and distrust along the links between hosts.

Rules name a host with all its subdomains and a path prefix; the longest one that fits decides.
Pages that no rule fits are judged by their host. A host most of whose pages the rules allow
is a trusted seed, one most of whose pages they block is a blocked seed, each of weight 1.
Trust walks from trusted seeds along links (personalised PageRank: at each step a walk goes on
with probability DAMPING and picks one of the host's links); distrust walks from blocked seeds
against them, from a host to those that link to it. A host's score is the expected share of
walks that end there after at most ROUNDS links; a walk ends at a host without links. A host is
blocked if its distrust is above its trust and at least LEAST of what a seed gives itself.

Scores are not normalised by the number of seeds or hosts, so a threshold means the same for
every size. Links within a host, and to no host, do not count. Each page is read once; the
graph is aggregated to weighted host pairs before the walks, and each round is one join and one
aggregate with map-side sums, written out, so that hosts with a third of all links can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import staged, unstaged

#: The rules of the registered query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
ROUNDS = 30
LEAST = 0.01
#: Decimals of scores that are compared; sums of doubles depend on their order behind them.
DIGITS = 9

#: An absolute link, or one without a scheme, in an anchor's href: group 1 is what follows the slashes, up to the path.
LINK = r"""(?is)<a[ \t\r\n\f][^<>]*?href[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \t\r\n\f]*)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (what follows the first ``://``, up to ``/``, ``?``, ``#`` or the end) and path (up to ``?``, ``#`` or the end)."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Of rules of one length and text, block wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def seeds(pages: DataFrame) -> DataFrame:
    """(kind, host, mass) of trusted (t) and blocked (d) seeds."""
    counts = pages.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "allow").alias("t"), F.count_if(F.col("verdict") == "block").alias("d")
    )
    kind = F.when(F.col("t") * 2 > F.col("n"), "t").when(F.col("d") * 2 > F.col("n"), "d")
    return counts.select(kind.alias("kind"), "host", F.lit(1.0).alias("mass")).filter("kind is not null")


def flows(pages: DataFrame) -> DataFrame:
    """(kind, host, to, share): along links for trust, against them for distrust."""
    links = pages.filter("host <> ''").select("host", F.explode("targets").alias("to")).filter("to <> '' and to <> host")
    links = staged(links.groupBy("host", "to").agg(F.count("*").alias("n")), "host-links")
    sides = links.select(F.lit("t").alias("kind"), "host", "to", "n").union(links.select(F.lit("d"), F.col("to"), F.col("host"), F.col("n")))
    totals = staged(sides.groupBy("kind", "host").agg(F.sum("n").alias("total")), "host-totals")
    out = staged(sides.join(totals, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total")).alias("share")), "host-flows")
    unstaged(links, totals)
    return out


def host_scores(pages: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of every host that a walk from a seed reaches.

    ``pages`` is (host, verdict of the rules or null, targets: hosts that the page links to).
    """
    walk = staged(seeds(pages), "host-walk")
    edges = flows(pages)
    ended = [walk.withColumn("mass", F.col("mass") * (1 - damping))]
    for k in range(1, rounds + 1):
        walk = staged(
            walk.join(edges, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("mass")),
            "host-walk",
        )
        if walk.isEmpty():
            break
        ended.append(walk.withColumn("mass", F.col("mass") * ((1 - damping) * damping**k)))
    every = ended[0]
    for part in ended[1:]:
        every = every.union(part)
    score = lambda kind: F.round(F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)), DIGITS)
    return staged(every.groupBy("host").agg(score("t").alias("trust"), score("d").alias("distrust")), "host-scores")


def judged(pages: DataFrame, rules=RULES, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, html).

    A null url, or one without ``://``, has neither host nor path; no rule fits it and it is
    allowed. A null or empty html has no links. Rows that repeat a page_id are judged one by
    one, and count as pages of their own. Long texts are read by Spark's expressions, one row at
    a time, in linear time. ``rules`` is a short list, part of the plan; of equal rules, block
    wins. A host whose distrust equals its trust is allowed. Other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("html").cast("string"), F.lit("")), F.lit(LINK), 1), lowered))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), targets.alias("targets"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = staged(rows.withColumns({"rule": rule, "verdict": verdict}), "pages-by-host")
    scores = host_scores(rows, damping, rounds)
    blocked = scores.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= least * (1 - damping))).select("host", F.lit("block").alias("found"))
    ruled = rows.filter("rule is not null").select("page_id", "host", "path", "rule", "verdict")
    open_ = rows.filter("rule is null").join(staged(blocked, "blocked-hosts"), "host", "left")
    return ruled.union(open_.select("page_id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict")))


def _rules_sql(what: int) -> str:
    cases = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule[1].partition("/")
        cases.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '{slash}{rest}') THEN '{rule[what]}'")
    return f"CASE {' '.join(cases)} END"


_LINK_SQL = LINK.replace("'", "''")

JUDGED_SQL = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{_LINK_SQL}', 1), lambda x: translate(x, '{_UPPER}', '{_LOWER}'))) AS targets
  FROM cut),
ruled AS (SELECT *, {_rules_sql(1)} AS rule, {_rules_sql(0)} AS said FROM parts),
counts AS (
  SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS t, count(*) FILTER (said = 'block') AS d FROM ruled WHERE host <> '' GROUP BY host),
links AS (
  SELECT host, target AS other, count(*) AS n FROM (SELECT host, unnest(targets) AS target FROM ruled WHERE host <> '')
  WHERE target <> '' AND target <> host GROUP BY host, target),
sides AS (SELECT 't' AS kind, host AS a, other AS b, n FROM links UNION ALL SELECT 'd', other, host, n FROM links),
flows AS (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS share FROM sides),
walk AS (
  SELECT 0 AS step, CASE WHEN t * 2 > n THEN 't' ELSE 'd' END AS kind, host, 1.0::DOUBLE AS mass FROM counts WHERE t * 2 > n OR d * 2 > n
  UNION ALL
  SELECT step + 1, w.kind, b, sum(mass * share) FROM walk w JOIN flows f ON f.kind = w.kind AND f.a = w.host WHERE step < {ROUNDS} GROUP BY step, w.kind, b),
scores AS (
  SELECT host, round(sum(CASE WHEN kind = 't' THEN mass * {1 - DAMPING} * {DAMPING} ** step ELSE 0 END), {DIGITS}) AS trust,
         round(sum(CASE WHEN kind = 'd' THEN mass * {1 - DAMPING} * {DAMPING} ** step ELSE 0 END), {DIGITS}) AS distrust
  FROM walk GROUP BY host)
SELECT page_id, r.host, path, rule,
       coalesce(said, CASE WHEN distrust > trust AND distrust >= {LEAST * (1 - DAMPING)} THEN 'block' END, 'allow') AS verdict
FROM ruled r LEFT JOIN scores s ON s.host = r.host
"""
