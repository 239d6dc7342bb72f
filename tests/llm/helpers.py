"""Small tables and plain versions that the operators are compared with."""

import random

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Nulls, empty and blank texts, a long text, repeated rows, a repeated id; columns that clash with inner names."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, say(90)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "One TWO"),
        (10, say(20000)), (11, say(30)), (11, say(30)), (12, base + " " + say(60)), (12, base + " " + say(60)), (None, base), (None, None),
        (13, "x" * 50000), (14, "the " * 3000), (15, "the " * 2900), (16, "a\x0bb\x0cc d e"),
    ]
    rows.append(rows[3])
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
    clash = ("tok", "doc", "h", "n", "pos", "component", "component_id", "rep", "label", "x", "id", "_text", "_key", "_doc", "bucket", "score", "words")
    for name in clash:
        df = df.selectExpr("*", f"'?' AS {name}")
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def texts(df, key="doc_id", value="text"):
    return [(r[key], r[value]) for r in df.select(key, value).collect()]


def components_of(nodes, edges):
    """{node: smallest node reachable}."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
