"""Secrets in texts: fixed shapes, and tokens that a battery of tests finds random.

Three shapes are searched as they are. Beside them every long token is a candidate. Its
encoding is inferred from its characters, and three tests ask whether it could be random
in that encoding: chi-squared for a uniform alphabet, runs about the alphabet's middle,
serial correlation of neighbours. A token that none of them rejects still has to be
unlikely as ordinary text: its evidence is the likelihood ratio of the random encoding
against the corpus's own mix of letters, cases and digits, which grows with the
token's length. False discoveries are held to FALSE_DISCOVERIES over all candidates of the
corpus by the rule for such ratios (the k best are taken while the k-th is at least
candidates / (k * FALSE_DISCOVERIES)), which needs no independence.

Everything is built from Spark's own functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column, fresh

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_CHARS = 6
# A run that is long enough begins where the run begins, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

RANDOM = "random"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_DISCOVERIES = 0.01
# The battery rejects a token when the smallest of its three p-values, times three, is below this.
BATTERY_LEVEL = 0.001
MASK = "[SECRET]"

DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
SIGNS = "+/_-"
# Smallest alphabet first: the first that holds the whole token is its encoding.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex upper", r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("letters", r"^[a-z]+$", LOWER),
    ("capitals", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("base36 upper", r"^[A-Z0-9]+$", DIGITS + UPPER),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
    ("signs", r"", UPPER + LOWER + DIGITS + SIGNS),
)

SPAN = "array<struct<start:int,end:int,value:string>>"
# Matches of a text are placed in blocks of so many, and masked texts put together from chunks.
BLOCK_PARTS = 512
CHUNK_CHARS = 1024


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(parts: Column, step, row, none: Column) -> Column:
    """row(place, part) of each part; places begin at 0 and step(place, part) is the next one.

    Appending to an array copies it, so rows are gathered by blocks and the blocks joined
    at the end: the work stays near proportion to the number of parts.
    """

    def add(acc, part):
        out = F.concat(acc["out"], F.array(row(acc["at"], part)))
        return F.struct(step(acc["at"], part).alias("at"), out.alias("out"))

    def block(acc, number):
        own = F.slice(parts, number * BLOCK_PARTS + 1, BLOCK_PARTS)
        begin = F.struct(acc["at"].alias("at"), none.alias("out"))
        rows = F.aggregate(own, begin, add, lambda made: made["out"])
        return F.struct(
            F.aggregate(own, acc["at"], step).alias("at"),
            F.concat(acc["out"], F.array(rows)).alias("out"),
        )

    last = F.greatest(F.ceil(F.size(parts) / BLOCK_PARTS).cast("int") - 1, F.lit(0))
    begin = F.struct(F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("out"))
    return F.flatten(F.aggregate(F.sequence(F.lit(0), last), begin, block, lambda acc: acc["out"]))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches: start and end in code points, end exclusive, and a group's text.

    The text between matches gives the places. Texts without a match are only searched.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(
        F.transform(
            F.slice(F.split(text, pattern, -1), 1, F.size(whole)), F.length
        ).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        value.alias("value"),
    )

    def step(at, x):
        return at + x["gap"] + x["size"]

    def span(at, x):
        start = at + x["gap"]
        return F.struct(start.alias("start"), step(at, x).alias("end"), x["value"].alias("value"))

    none = F.array().cast(SPAN)
    spans = _let(parts, lambda p: _running(p, step, span, none))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(none)


def _tail(z: Column) -> Column:
    """Both tails of the normal distribution, by the usual five-term polynomial."""
    z = F.abs(z)
    t = 1 / (1 + 0.2316419 * z)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    return 2 * F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _battery(values: Column, size: Column, alphabet: Column) -> Column:
    """Smallest p-value of the three tests, times three; values are places in the alphabet."""
    n = size.cast("double")
    a = alphabet.cast("double")
    squares = F.aggregate(
        F.array_distinct(values),
        F.lit(0.0),
        lambda s, v: s + F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), F.lit(2)),
    )
    chi = a / n * squares - n
    p_chi = _tail((chi - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n))

    # Runs above and below the middle of the alphabet.
    pairs = F.arrays_zip(
        F.slice(values, 1, size - 1).alias("x"), F.slice(values, 2, size - 1).alias("y")
    )

    def side(v):
        return 2 * v >= alphabet

    def runs(counts):
        above, turns = counts["above"], counts["turns"]
        expected = 2 * above * (n - above) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        return F.when(spread > 0, _tail((turns + 1 - expected) / F.sqrt(spread))).otherwise(0.0)

    counts = F.struct(
        F.size(F.filter(values, side)).cast("double").alias("above"),
        F.size(F.filter(pairs, lambda p: side(p["x"]) != side(p["y"]))).cast("double").alias("turns"),
    )

    # The mean is worked out before the sums that use it for every character.
    def serial(mean):
        def moments(sums):
            return F.when(
                sums["var"] > 0, _tail((sums["co"] / sums["var"] + 1 / n) * F.sqrt(n))
            ).otherwise(0.0)

        var = F.aggregate(values, F.lit(0.0), lambda s, v: s + F.pow(v - mean, F.lit(2)))
        co = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - mean) * (p["y"] - mean))
        return _let(F.struct(var.alias("var"), co.alias("co")), moments)

    p_serial = _let(F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n, serial)
    return F.least(F.lit(1.0), 3 * F.least(p_chi, _let(counts, runs), p_serial))


def _count(token: Column, chars: str) -> Column:
    return F.length(token) - F.length(F.translate(token, chars, ""))


def _evidence(token: Column, mix: dict[str, float]) -> Column:
    """Log likelihood ratio of the token's random encoding against the corpus's mix.

    Signs say nothing either way: paths and dashed words have them as well.
    """
    digits, upper, lower = (_count(token, c) for c in (DIGITS, UPPER, LOWER))
    one_case = (upper == 0) | (lower == 0)
    letters = F.when(one_case, (upper + lower) * math.log(mix["letter"] / 26)).otherwise(
        upper * math.log(mix["upper"] / 26) + lower * math.log(mix["lower"] / 26)
    )
    text = digits * math.log(mix["digit"] / 10) + letters
    size = F.coalesce(*[F.when(F.rlike(token, F.lit(p)), len(a)) for _, p, a in ENCODINGS])
    return -(digits + upper + lower) * F.log(size.cast("double")) - text


def _random(token: Column) -> Column:
    """Whether the battery lets the token pass as random in its encoding."""
    alphabet = F.coalesce(*[F.when(F.rlike(token, F.lit(p)), F.lit(a)) for _, p, a in ENCODINGS])

    def tested(alpha):
        values = F.transform(F.split(token, ""), lambda c: (F.instr(alpha, c) - 1).cast("double"))

        def battery(v):
            return _battery(v, F.size(v), F.length(alpha)) >= BATTERY_LEVEL

        return _let(values, battery)

    return _let(alphabet, tested)


def _candidates(text: Column) -> Column:
    """Long tokens without their padding signs, as spans."""
    return F.transform(
        found(text, CANDIDATE),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.rtrim(s["value"], F.lit("=")).alias("value"),
        ),
    )


def character_mix(docs: DataFrame, text_col: str) -> dict[str, float]:
    """Shares of digits and cases among them in all texts, one added to each count."""
    text = column(docs, text_col)
    counts = docs.agg(
        *[
            F.coalesce(F.sum(_count(text, chars).cast("long")), F.lit(0)).alias(name)
            for name, chars in (("digit", DIGITS), ("upper", UPPER), ("lower", LOWER))
        ]
    ).first().asDict()
    total = sum(counts.values()) + len(counts)
    mix = {name: (n + 1) / total for name, n in counts.items()}
    return mix | {"letter": mix["upper"] + mix["lower"]}


def evidence_needed(docs: DataFrame, text_col: str, mix: dict[str, float]) -> float:
    """The evidence from which random tokens are secrets, over all candidates of the corpus.

    What reaches the driver is one count for each whole step of evidence.
    """
    tokens = docs.select(F.explode(_candidates(column(docs, text_col))["value"]).alias("token"))
    steps = tokens.select(
        F.floor(F.least(F.greatest(_evidence(F.col("token"), mix), F.lit(-1)), F.lit(700))).alias("e"),
        _random(F.col("token")).alias("random"),
    )
    counts = steps.groupBy("e").agg(
        F.count("*").alias("n"), F.count_if("random").alias("passed")
    ).collect()
    candidates = sum(r["n"] for r in counts)
    needed, k = math.inf, 0
    for row in sorted(counts, key=lambda r: -r["e"]):
        k += row["passed"]
        if k and row["e"] >= math.log(candidates / (FALSE_DISCOVERIES * k)):
            needed = row["e"]
    return float(needed)


def base_spans(text: Column) -> Column:
    """Spans of the three shapes as (start, order, end), sorted."""
    kinds = [
        F.filter(found(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= ASSIGN_CHARS),
        found(text, ACCESS),
        found(text, HEX),
    ]
    return F.array_sort(F.concat(*[_of_kind(spans, k) for k, spans in enumerate(kinds)]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")
        ),
    )


def _n_of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def with_spans(docs: DataFrame, text_col: str, base: str, spans: str) -> DataFrame:
    """docs with its base spans and all spans, arrays of (start, kind number, end) by start.

    Kind numbers are places in KINDS; len(KINDS) is a random token. A random token that
    touches a base span is left out, as the span covers it. A null text has no spans.
    The corpus is read three times, and no text is shuffled.
    """
    mix = character_mix(docs, text_col)
    needed = evidence_needed(docs, text_col, mix)
    text = F.coalesce(column(docs, text_col), F.lit(""))
    with_base = docs.withColumn(base, base_spans(text))
    if math.isinf(needed):
        return with_base.withColumn(spans, F.col(base))
    random = F.filter(
        _candidates(text),
        lambda s: (_evidence(s["value"], mix) >= needed)
        & _random(s["value"])
        & ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return with_base.withColumn(
        spans, F.array_sort(F.concat(base, _of_kind(random, len(KINDS))))
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, RANDOM)])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":",
                F.element_at(names, s["kind"] + 1),
                s["start"].cast("string"),
                s["end"].cast("string"),
            ),
        ),
        ",",
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts of the base kinds, the digest of their places, all spans.

    A null text counts as empty; repeated rows come out alike; an empty table gives an empty
    result; extra columns are not read. A text is worked through in one row, in time and
    memory about in proportion to its length and its matches.
    """
    narrow = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text"))
    marked = with_spans(narrow, "text", "base", "spans").select("id", "base", "spans")
    return marked.select(
        F.col("id").alias(id_col),
        *[
            _n_of_kind(F.col("base"), k).alias(f"n_{name}")
            for k, name in enumerate(KINDS)
        ],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def _cut(text: Column, pieces: Column) -> Column:
    """The texts of pieces, an array of (start, end) in code points.

    A place is found by counting from the text's start, so the text is cut into chunks
    first and each piece is counted from the chunk it begins in.
    """

    def one(chunks, p):
        low = F.floor(p["start"] / CHUNK_CHARS).cast("int")
        high = F.floor(p["end"] / CHUNK_CHARS).cast("int")
        joined = F.array_join(F.slice(chunks, low + 1, high - low + 1), "")
        return F.substr(joined, p["start"] - low * CHUNK_CHARS + 1, p["end"] - p["start"])

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK_CHARS}}}"), F.lit(0))
    return _let(chunks, lambda c: F.transform(pieces, lambda p: one(c, p)))


def redacted(text: Column, spans: Column, mask: str = MASK) -> Column:
    """text with every span replaced; spans that overlap become one mask.

    spans come by start. The pieces between masks are put together at once, so that time
    stays in proportion to the text.
    """

    def gap(at, s):
        return F.when(s["start"] >= at, F.struct(at.alias("start"), s["start"].alias("end")))

    none = F.array().cast("array<struct<start:int,end:int>>")
    # One more span behind the text's end brings its last piece.
    end = F.length(text)
    plain = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    closed = F.concat(plain, F.array(F.struct(end.alias("start"), end.alias("end"))))
    pieces = F.filter(
        _let(closed, lambda c: _running(c, lambda at, s: F.greatest(at, s["end"]), gap, none)),
        lambda p: p.isNotNull(),
    )
    built = F.array_join(_cut(text, pieces), mask)
    return F.when(F.size(spans) > 0, built).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs with every secret masked and the text's length brought up to date; no row goes."""
    base, spans = fresh(docs, "secret_base", "secret_spans")
    marked = with_spans(docs, text_col, base, spans)
    text = redacted(column(marked, text_col), F.col(spans))
    out = []
    for f in docs.schema.fields:
        value = column(marked, f.name)
        if f.name == text_col:
            value = text
        elif f.name == size_col:
            value = F.when(F.size(spans) > 0, F.length(text).cast(f.dataType)).otherwise(value)
        out.append(value.alias(f.name))
    return marked.select(*out)
