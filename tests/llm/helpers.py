"""Small tables that hold every awkward case at once."""

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id string, fp int, row string, size int, base string, score double, `odd.name` string"
)
PROSE = {
    "en": "the quick brown fox jumps over the lazy dog and then the other one walks away from it",
    "fr": "le renard brun saute par dessus le chien paresseux et puis les autres sont partis aussi",
}
LONG = 60_000


def _row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text)) + ("x", 1, "r", 2, "b", 0.5, "o")


def documents(spark):
    rows = [_row(i, PROSE["en"] + f" number {i} of many", "en", "ab"[i % 2]) for i in range(20)]
    rows += [_row(20 + i, PROSE["fr"] + f" numero {i} de plusieurs", "fr", "c") for i in range(20)]
    rows += [
        _row(40, None),
        _row(41, ""),
        _row(42, None, None, None),
        _row(None, PROSE["en"], None, None),
        _row(43, " ".join(f"word{i % 7919}" for i in range(LONG)), "en", "long"),
        _row(44, "x" * 100_000, None, "long"),
        _row(45, PROSE["en"]),
        _row(45, PROSE["en"]),
        _row(46, PROSE["en"].upper()),
        _row(47, "12 34 !! --", "en"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(df):
    return df.limit(0)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
