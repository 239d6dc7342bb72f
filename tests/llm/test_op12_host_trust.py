"""Rules and link-graph propagation against plain Python and the SQL."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalmill.llm.host_trust import DAMPING, JUDGED_SQL, LEAST, ROUNDS, RULES, host_scores, judged
from evalmill.llm.queries import op12_link_propagation

from .helpers import SF

PAGES = "page_id long, url string, html string"


def split(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = m.groups() if m else ("", "")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = [(len(r), r, kind) for kind, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return max(fits)[1:] if fits else (None, None)


def plain_scores(rows, links):
    """{host: (trust, distrust)} by powers of dense matrices; rows (host, said), links [(host, host)]."""
    names = sorted({h for h, _ in rows} | {h for e in links for h in e} - {""})
    at = {h: k for k, h in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for a, b in links:
        if a and b and a != b:
            m[at[a], at[b]] += 1
    out = []
    for kind, edges in (("allow", m), ("block", m.T)):
        share = edges / np.maximum(edges.sum(axis=1, keepdims=True), 1)
        said = {h: [s == kind for g, s in rows if g == h] for h in names}
        walk = np.array([float(2 * sum(said[h]) > len(said[h])) for h in names])
        score = np.zeros(len(names))
        for k in range(ROUNDS + 1):
            score += (1 - DAMPING) * DAMPING**k * walk
            walk = walk @ share
        out.append(score)
    return {h: (out[0][k], out[1][k]) for h, k in at.items()}


def page(host, *targets, path="/en/1"):
    anchors = "".join(f'<p><A class="x"\nHREF = "{t}">a</a>' for t in targets)
    return f"https://{host}{path}?q=1://x", f"<html><a href='/own'>o</a>{anchors}<a href=mailto:a@b.c>m</a></html>"


def graph(rng):
    """A good and a bad neighbourhood, a hub, hosts that nobody links to."""
    bad = [f"spam{k}.net" for k in range(4)]
    good = [f"www.good{k}.org" for k in range(4)]
    near_bad = [f"links{k}.com" for k in range(6)]
    near_good = [f"News{k}.com" for k in range(6)]
    out = []
    for h in bad:
        out += [page(h, "http://" + rng.choice(bad) + "/a"), page(h, "//hub.com")]
    for h in good:
        out += [page(h, *(f"https://{x}/y" for x in rng.sample(near_good, 3)), path="/fr/1"), page(h, "https://hub.com", path="/fr/2")]
    for h in near_bad:
        out += [page(h, *(f"http://{rng.choice(bad)}/x?y" for _ in range(3)))]
    for h in near_good:
        out += [page(h, "HTTP://" + rng.choice(near_good).upper() + "/#", "https://lonely.com")]
    out += [page("hub.com", *(f"https://{x}" for x in near_good + near_bad)), page("alone.com"), page("a.example.com", path="/de/1"), page("a.example.com")]
    return [(k, *x) for k, x in enumerate(out)]


def wanted(rows):
    seen = []
    for page_id, url, html in rows:
        host, path = split(url)
        found = re.findall(r"""<a\s[^<>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<> \s]*)""", html or "", re.I)
        seen.append((page_id, host, path, *rule_of(host, path), {split("x://" + f)[0] for f in found}))
    scores = plain_scores([(h, said) for _, h, _, _, said, _ in seen if h], [(h, t) for _, h, _, _, _, ts in seen for t in ts])
    out = []
    for page_id, host, path, rule, said, _ in seen:
        trust, distrust = scores.get(host, (0, 0))
        blocked = round(distrust, 9) > round(trust, 9) and distrust >= LEAST * (1 - DAMPING)
        out.append((page_id, host, path, rule, said or ("block" if blocked else "allow")))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, judged(df).collect()), key=str)


def test_neighbours_of_seeds(spark):
    rows = graph(random.Random(2))
    df = spark.createDataFrame(rows, PAGES)
    have = got(df)
    assert have == wanted(rows)
    verdict = {h: v for _, h, _, r, v in have if r is None}
    assert all(verdict[h] == "block" for h in verdict if h.startswith("links"))
    assert all(verdict[h] == "allow" for h in verdict if h.startswith("news")) and verdict["alone.com"] == "allow"
    assert {r[3:] for r in have if r[1] == "a.example.com"} == {("example.com/de/", "block"), (None, "allow")}


def test_random_graphs(spark):
    rng = random.Random(11)
    hosts = [f"h{k}.{rng.choice(['com', 'net', 'org'])}" for k in range(25)]
    rows = []
    for k in range(150):
        url, html = page(rng.choice(hosts), *("//" + rng.choice(hosts) for _ in range(rng.randrange(4))), path=rng.choice(["/fr/", "/de/x", "/en/"]))
        rows.append((k, url, html))
    df = spark.createDataFrame(rows, PAGES)
    assert got(df) == wanted(rows)
    con = duckdb.connect()
    frame = df.toPandas()  # noqa: F841
    con.sql("CREATE TABLE pages AS SELECT * FROM frame")
    assert sorted(con.sql(JUDGED_SQL).fetchall(), key=str) == wanted(rows)


def test_scores(spark):
    rows = [("a.net", "block", ["b.com"]), ("b.com", None, ["a.net", "c.com"]), ("c.com", None, []), ("t.org", "allow", ["b.com"])]
    df = spark.createDataFrame(rows, "host string, verdict string, targets array<string>")
    want = plain_scores([(h, s) for h, s, _ in rows], [(h, t) for h, _, ts in rows for t in ts])
    have = {r.host: (r.trust, r.distrust) for r in host_scores(df).collect()}
    for h, (trust, distrust) in want.items():
        assert have.get(h, (0, 0)) == pytest.approx((trust, distrust), abs=1e-9)


ODD = [
    (1, None, None), (2, "", "<a href='//net'>"), (3, "no scheme/x", "x"), (4, "http://", ""), (5, "http://NET", "y"), (6, "http://net/", None),
    (7, "HTTPS://User@X.Example.NET:80/en/?a#b", "<a href=''>"), (8, "x://y.org#/fr/", "<a href"), (9, "x://y.org/fr/\n://", "a" * 300000), (9, "x://y.org/fr/\n://", "<a " * 100000),
    (None, "http://Ünet.net/É", "<a href=//É.com>"), (10, "://org/fr/1", "<!-- <a href='http://net/'> -->"), (11, "http://notexample.net/en/", ""), (12, "http://a.org?/fr/", ""),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, PAGES)
    for name in ("host", "path", "rule", "verdict", "targets", "kind", "mass", "found"):
        df = df.withColumn(name, F.lit("?"))
    assert got(df) == wanted(ODD)


def test_no_rows(spark):
    assert judged(spark.createDataFrame([], PAGES)).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, op12_link_propagation(spark, SF).collect()), key=str) == sorted(con.sql(JUDGED_SQL).fetchall(), key=str)
