"""Personal data: base patterns plus bootstrapped contextual extraction, in DataFrame functions only.

Base kinds are regular expressions, read leftmost and non-overlapping over whole texts. They
are written so that a text is scanned in linear time: a run is entered at its start only and
never given back where nothing behind it could match.

Beyond them, identifiers are learned from context. Base spans are the seeds; candidates are the
other words with a digit. The two words before either, and the words on both sides, are its
lexical patterns (digits as #). Patterns and candidate values form a
graph. Background values stand in a pattern that holds many values and no seed; other values
without belief are unknown, and do not count against a pattern, however many they are. Each
round scores a pattern by the mean belief of its believed and background values and a value by
the patterns that hold it, 1 - prod(1 - score). A pattern counts once enough distinct believed
values support it, its score surely exceeds half way between the share of seeds among all
values and 1, and the mean belief of all its values lies CHANCE deviations above that share,
so that contexts which merely happen to precede a seed teach nothing.
Candidates of believed values in such patterns are the found
identifiers (kind ``id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalmill.llm.common import staged

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
#: The base expressions, equal in their matches to the plain ones: a run of digits or address
#: characters is tried at its start (or where the last match ended), and not given back.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
_HINT = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "[+][0-9]"}
_CANDIDATE = r"(?<![^\x20\x09-\x0D])[^0-9\x20\x09-\x0D]*+[0-9][^\x20\x09-\x0D]*+"
_BLANK = r"[\x20\x09-\x0D]+"
#: Code points on each side of a candidate that its context words are read from.
CONTEXT = 60
#: Deviations that tell a pattern's belief from the share of seeds among all values.
CHANCE = 5
#: Numbers summed at a time.
RUN = 128


def before_each(sizes: Column) -> Column:
    """Sums of the numbers before each number; by runs of RUN, so that long arrays stay cheap."""

    def sums(numbers):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(numbers, zero, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["sums"], F.array(s["at"])).alias("sums")))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / RUN).cast("int")), lambda k: sums(F.slice(sizes, k * RUN + 1, RUN)))
    offsets = sums(F.transform(runs, lambda r: r["at"]))["sums"]
    moved = F.zip_with(runs, offsets, lambda r, o: F.transform(r["sums"], lambda x: x + o))
    return F.when(F.size(sizes) > 0, F.flatten(moved)).otherwise(F.array().cast("array<int>"))


def positioned(docs: DataFrame, column: str, pattern: str, hint: str) -> DataFrame:
    """Adds ``column``: an array of (start, end, value, left, right) of the matches in ``_text``.

    Positions are code points and follow from the pieces between the matches; left and right
    are up to CONTEXT code points of the text on both sides, back and on to the next match at least.
    """
    text = F.col("_text")
    held = text.rlike(hint)
    none = F.array().cast("array<string>")
    docs = docs.withColumn("_m", F.when(held, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    docs = docs.withColumn("_p", F.when(held, F.split(text, pattern)).otherwise(none))
    pairs = F.zip_with("_m", F.slice("_p", 1, F.size("_m")), lambda m, p: F.length(p) + F.length(m))
    docs = docs.withColumn("_at", before_each(pairs))

    def span(m, k):
        start = F.get("_at", k) + F.length(F.get("_p", k))
        left = F.concat(F.coalesce(F.get("_p", k - 1), F.lit("")), F.coalesce(F.get("_m", k - 1), F.lit("")), F.get("_p", k))
        right = F.concat(F.get("_p", k + 1), F.coalesce(F.get("_m", k + 1), F.lit("")))
        return F.struct(
            start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"), F.right(left, F.lit(CONTEXT)).alias("left"), F.left(right, F.lit(CONTEXT)).alias("right")
        )

    return docs.withColumn(column, F.transform("_m", span)).drop("_m", "_p", "_at")


def luhn(digits: Column) -> Column:
    """True if the check digit fits; every second digit from the right counts double."""

    def worth(k):
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, k: s + worth(k)) % 10 == 0


def kept(kind: str, spans: str) -> Column:
    """The matches that count."""
    return F.filter(spans, lambda s: valid(kind, s["value"]))


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
            F.split(value, "[.]"), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255
        )
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def joined(kind: str, spans: Column) -> Column:
    """kind:start:end of each span."""
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]))


def base_spans(docs: DataFrame) -> DataFrame:
    """Adds one array of spans of ``_text`` for each base kind."""
    for kind in KINDS:
        docs = positioned(docs, f"_{kind}", PATTERNS[kind], _HINT[kind])
    for kind in KINDS:
        docs = docs.withColumn(f"_{kind}", kept(kind, f"_{kind}"))
    return docs


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``_found``: (start, end, value, seed, patterns) of the base spans, which are the seeds,
    and of the other words with a digit, without outer marks."""
    docs = docs.withColumn("_base", F.concat(*[F.col(f"_{k}") for k in KINDS]))
    docs = positioned(docs, "_words", _CANDIDATE, "[0-9]")

    def apart(w):
        return ~F.exists(F.col("_base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))

    def told(seed):
        def one(c):
            value = F.regexp_replace(c["value"], r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
            lead = F.length(c["value"]) - F.length(F.regexp_replace(c["value"], r"^[^\p{L}\p{N}]+", ""))
            clean = lambda s: F.filter(F.split(F.regexp_replace(F.lower(s), "[0-9]", "#"), _BLANK), lambda w: w != "")
            before, after = clean(c["left"]), clean(c["right"])
            two = F.array_join(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), " ")
            near = F.concat_ws(" _ ", F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")), F.coalesce(F.try_element_at(after, F.lit(1)), F.lit("")))
            start = c["start"] + lead
            return F.struct(
                start.alias("start"),
                (start + F.length(value)).alias("end"),
                value.alias("value"),
                F.lit(seed).alias("seed"),
                F.array(F.concat(F.lit("< "), two), F.concat(F.lit("<> "), near)).alias("patterns"),
            )

        return one

    return docs.withColumn("_found", F.concat(F.transform("_base", told(True)), F.transform(F.filter("_words", apart), told(False))))


def believed(edges: DataFrame, rounds: int, support: int, sure: float) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns that count (pattern, score) and beliefs of values (value, belief).

    ``edges`` is (pattern, value, seed), each pair once.
    """
    values = staged(edges.groupBy("value").agg(F.max("seed").alias("seed")).select("value", F.col("seed").cast("double").alias("belief")), "values")
    rate = values.agg(F.avg("belief")).first()[0] or 0.0
    least = rate + (1 - rate) * 0.5
    barren = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.max("seed").alias("seed")).filter((F.col("n") >= support) & (F.col("seed") == 0))
    background = edges.join(barren.select("pattern"), "pattern").select("value").distinct().withColumn("background", F.lit(True))
    values = staged(values.join(background, "value", "left").withColumn("background", F.coalesce("background", F.lit(False))), "known")
    pairs = edges.select("pattern", "value")
    beliefs, chance = values, CHANCE * (rate * (1 - rate)) ** 0.5
    patterns = None
    for _ in range(rounds):
        held = pairs.join(beliefs, "value").groupBy("pattern").agg(
            F.avg(F.when(F.col("background") | (F.col("belief") >= sure), F.col("belief"))).alias("score"),
            F.count_if(F.col("background") | (F.col("belief") >= sure)).alias("n"),
            F.count_if(F.col("belief") >= sure).alias("support"),
            F.avg("belief").alias("mean"),
            F.count("*").alias("every"),
        )
        low = F.col("score") - 1.64 * F.sqrt(F.col("score") * (1 - F.col("score")) / F.col("n"))
        patterns = staged(held.filter((F.col("support") >= support) & (low >= least) & (F.col("mean") - rate >= chance / F.sqrt("every"))).select("pattern", "score"), "patterns")
        doubt = pairs.join(patterns, "pattern").groupBy("value").agg(F.sum(F.log(1 - F.least("score", F.lit(0.999)))).alias("doubt"))
        beliefs = values.join(doubt, "value", "left").select("value", "background", F.greatest("belief", F.coalesce(1 - F.exp("doubt"), F.lit(0.0))).alias("belief"))
        beliefs = staged(beliefs, "beliefs")
    return patterns, beliefs


def spans_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base kinds, _found) of every row; ``text_key`` tells texts of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = candidates(base_spans(rows.withColumn("text_key", F.xxhash64("_text"))))
    short = [plain_spans(f"_{k}").alias(k) for k in KINDS]
    return staged(rows.select("doc_id", "text_key", *short, "_found"), "spans")


def plain_spans(column: str) -> Column:
    """(start, end, value) of spans."""
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def identifiers(rows: DataFrame, rounds: int, support: int, sure: float) -> DataFrame:
    """(of_doc, of_text, id): the identifiers found by context in ``spans_of``, of the texts that hold any."""
    words = rows.select("doc_id", "text_key", F.explode("_found").alias("c")).select("doc_id", "text_key", "c.*").filter("value <> ''")
    edges = words.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    patterns, beliefs = believed(staged(edges, "edges"), rounds, support, sure)
    open_words = words.filter("not seed").select("doc_id", "text_key", "start", "end", "value", F.explode("patterns").alias("pattern"))
    found = open_words.join(patterns.select("pattern"), "pattern").join(beliefs.filter(F.col("belief") >= sure).select("value"), "value")
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "value")
    found = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(one)).alias("id"))
    return staged(found.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "id"), "found")


def extracted(docs: DataFrame, rounds: int = 3, support: int = 5, sure: float = 0.8) -> DataFrame:
    """(doc_id, text_key, email, ip, card, phone, id) of every row: arrays of (start, end, value).

    A null text counts as empty and holds nothing. Rows that repeat a doc_id are read one by
    one; rows without one are read too. Found identifiers do not overlap base spans. Other
    columns are not read.
    """
    rows = spans_of(docs)
    found = identifiers(rows, rounds, support, sure)
    match = rows["doc_id"].eqNullSafe(found["of_doc"]) & (rows["text_key"] == found["of_text"])
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return rows.join(found, match, "left").select("doc_id", "text_key", *KINDS, F.coalesce("id", empty).alias("id"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; see ``extracted``."""
    found = extracted(docs)
    base = F.concat(*[joined(k, F.col(k)) for k in KINDS])
    every = F.concat(base, joined("id", F.col("id")))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )


def redacted(docs: DataFrame, length: str | None = None) -> DataFrame:
    """All columns of every row, with each span of ``text`` replaced by its kind in brackets.

    ``length`` names a column that holds the code points of the text and follows it.

    Spans that overlap are replaced together, by the kind of the one that starts first (ties:
    kinds in the order listed). A null text stays null.
    """
    found = identifiers(spans_of(docs), 3, 5, 0.8)
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that no name clashes
    rows = rows.withColumn("_text", F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    match = F.col("row.doc_id").cast("long").eqNullSafe(F.col("of_doc")) & (F.xxhash64("_text") == F.col("of_text"))
    # Base spans are read again from the text at hand: only texts with found identifiers are joined.
    rows = base_spans(rows.join(found, match, "left"))

    def marked(rank: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    columns = [(k, plain_spans(f"_{k}")) for k in KINDS] + [("id", F.coalesce("id", empty))]
    rows = rows.withColumn("spans", F.array_sort(F.concat(*[marked(n, k, c) for n, (k, c) in enumerate(columns)])))
    text = F.col("row.text")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s, x):
        gap = F.substring("_text", s["at"] + 1, x["start"] - s["at"])
        fresh = F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(F.concat(gap, F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("parts"))
        inside = F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts"))
        return F.when(x["start"] >= s["at"], fresh).otherwise(inside)

    whole = F.aggregate("spans", zero, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring("_text", s["at"] + 1, F.length("_text"))))
    rows = rows.withColumn("new", F.when(F.size("spans") == 0, text).otherwise(whole))
    new = {"text": F.col("new").alias("text")}
    if length:
        new[length] = F.when(F.size("spans") == 0, F.col(f"row.`{length}`")).otherwise(F.length("new")).cast(docs.schema[length].dataType).alias(length)
    return rows.select(*[new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])
