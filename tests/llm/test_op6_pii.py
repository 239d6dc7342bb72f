"""Base spans against plain expressions, learned contexts, redaction, native plan."""

import hashlib
import random
import re

from evalmill.llm.pii import KINDS, pii_report, redacted

from .helpers import no_documents, odd_documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        worth = [int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(worth) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def plain(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(PLAIN[k], text or "", re.A) if counts(k, m.group())] for k in KINDS}


def row_of(doc_id, text):
    spans = plain(text)
    base = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])
    return (doc_id, *[len(spans[k]) for k in KINDS], hashlib.sha256(base.encode()).hexdigest())


def hard_texts():
    rng = random.Random(5)
    out = ["a@b.c_d@e.f.g x@y", "1.2.3.4.5.6.7.8.9", "0000255.1.1.1 256.1.1.1 1.2.3.4.", "4111 1111 1111 1111 4111-1111-1111-1111-5", "+1 (555) 555-5555) x +12 ((((", "é😀 a.b+c@d-e.com. 😀1.1.1.1"]
    out += ["x" * 2000 + "@" + "y." * 300 + "com", "1" * 2000, "+1" * 200, "1." * 500, "99999999999999999999.1.1.1", "4111111111111111" * 3]
    out += ["".join(rng.choice("ab1234567890.@+-_() %") for _ in range(rng.randrange(5, 80))) for _ in range(400)]
    return out


def test_base_spans(spark):
    rows = list(enumerate(hard_texts()))
    got = [tuple(r)[:6] for r in pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(row_of(i, t) for i, t in rows)


def test_odd_rows(spark):
    df = odd_documents(spark)
    got = [tuple(r)[:6] for r in pii_report(df).collect()]
    assert sorted(got, key=str) == sorted((row_of(r.doc_id, r.text) for r in df.collect()), key=str)
    assert pii_report(no_documents(spark)).count() == 0
    assert redacted(df).columns == df.columns and redacted(df).count() == df.count()


def learned_rows():
    rows = [f"Reach the office phone +1 (555) 555-{k:04d} today" for k in range(40)]
    rows += [f"lorem ipsum no {k} apples and {k * 7} pears" for k in range(60)]
    rows += [f"the office phone 555-{k:04d} today" for k in range(3)]
    return list(enumerate(rows))


def test_contexts_find_unseen_identifiers(spark):
    df = spark.createDataFrame(learned_rows(), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii_report(df).filter("spans LIKE '%id:%'").collect()}
    assert found == {k: "id:17:25" for k in (100, 101, 102)}


def test_unseen_values_outnumber_seeds(spark):
    rows = [t for _, t in learned_rows()[:100]] + [f"the office phone 555-{k:04d} today" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii_report(df).filter("spans LIKE '%id:%'").collect()}
    assert found == {k: "id:17:25" for k in range(100, 160)}


def test_contexts_by_chance_teach_nothing(spark):
    """Seeds and numbers in the same random contexts."""
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "klmn" for b in "aeiou"]
    value = lambda: f"+1 (555) 555-{rng.randrange(10**4):04d}" if rng.random() < 0.3 else f"{rng.randrange(10**6)}"
    rows = [(k, " ".join([rng.choice(words), rng.choice(words), value(), rng.choice(words)])) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii_report(df).filter("spans LIKE '%id:%'").count() == 0


def test_redaction(spark):
    df = spark.createDataFrame(learned_rows() + [(500, "a@b.c, 1.2.3.4"), (501, None), (502, "é 😀 x@y.z")], "doc_id long, text string")
    df = df.selectExpr("*", "cast(length(text) as bigint) AS n_chars", "7 AS kind")
    got = {r.doc_id: (r.text, r.n_chars) for r in redacted(df, "n_chars").collect()}
    assert got[3][0] == "Reach the office phone [PHONE] today" and got[3][1] == len(got[3][0])
    assert got[101][0] == "the office phone [ID] today"
    assert got[500][0] == "[EMAIL], [IP]" and got[501] == (None, None) and got[502][0] == "é 😀 [EMAIL]"
    assert got[50][0] == dict(learned_rows())[50]


def test_plan_is_native(spark):
    df = pii_report(spark.createDataFrame(learned_rows(), "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
