"""Personal data, and the terms around it that give its owner away.

Four kinds of personal data are searched in every text: they are the protected entities.
The terms of a document may reveal its entities even when these are masked. How strongly
is estimated from the corpus, over all documents: a term t reveals of an entity e

    log(N * n(e, t) / (n(e) * n(t))) / log(N / n(e))

the share of e's information content that their pointwise mutual information makes up;
n counts documents. A term is two or more letters and digits, so that numbers of houses,
rooms and accounts are terms too. There are two estimates, and the larger one counts:

- near: n(e, t) counts the documents where t stands within CONTEXT_TERMS terms of e. That t
  stands beside e is evidence of its own, so one document is enough to generalise t.
- whole: n(e, t) counts the documents that hold both, at any distance. Here each count is one
  less (N, n(e), n(t) and n(e, t)): a document is not evidence for what is masked in it. So a
  term that meets e in one document only, like most rare words, is not masked for it.

From GENERALISE_FROM on, t is replaced by a general word wherever it occurs in the documents
of e; from REMOVE_FROM on, with more than one document as evidence, it is removed.
Documents without an entity are left alone. Texts may be of any length: the time they take
is in proportion, but for a document's entities that other documents hold too, each of which
meets the document's terms that are rare enough to reveal it.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column, fresh, map_rows
from feedlake.staging import stage

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
SPAN_KINDS = (*KINDS, GENERALISED, REMOVED)
CONTEXT_TERMS = 6
GENERALISE_FROM = 0.75
REMOVE_FROM = 0.9
GENERAL_WORD = "[TERM]"
# Distinct terms a task counts before it hands its counts on.
HELD_TERMS = 500_000
# Most terms that are broadcast as common ones that reveal no one.
COMMON_TERMS = 1 << 16

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behinds leave the matches as they are and keep long digit runs linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]{2,}")
HAS_ENTITY = re.compile(r"@|[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """Leftmost matches of local part, @ and domain, found from their @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all personal data, by start, then kind."""
    if not HAS_ENTITY.search(text):
        return []
    spans = [(a, 0, b) for a, b in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _hash(value: str) -> int:
    h = xxhash.xxh64_intdigest(value.encode())
    return h - (1 << 64) if h >> 63 else h


def _entity(text: str, span: tuple[int, int, int]) -> int:
    """An entity is a kind and a value; spelling variants of one value are one entity."""
    start, kind, end = span
    value = text[start:end]
    value = value.lower() if kind < 2 else NOT_DIGIT.sub("", value)
    return _hash(f"{kind}:{value}")


def contexts(text: str, spans: list[tuple[int, int, int]]) -> tuple[dict[int, list], set, set]:
    """Of a text with entities: its terms with their places, (entity, term) pairs of near ones, its entities."""
    if not spans:
        return {}, set(), set()
    terms, places, at = [], {}, 0
    ends, reach = [], 0
    for start, _, end in spans:
        reach = max(reach, end)
        ends.append(reach)
    for m in TERM.finditer(text):
        # Terms inside or touching personal data are part of it.
        while at < len(spans) and ends[at] <= m.start():
            at += 1
        if at < len(spans) and spans[at][0] < m.end():
            continue
        term = _hash(m[0].lower())
        terms.append((m.start(), term))
        places.setdefault(term, []).append((m.start(), m.end()))
    pairs, entities, k = set(), set(), 0
    for span in spans:
        while k < len(terms) and terms[k][0] < span[0]:
            k += 1
        entity = _entity(text, span)
        entities.add(entity)
        pairs.update((entity, t) for _, t in terms[max(0, k - CONTEXT_TERMS) : k + CONTEXT_TERMS])
    return places, pairs, entities


SCANNED = (
    "base array<struct<start:int,kind:int,end:int>>, "
    "terms array<struct<term:long,places:array<struct<start:int,end:int>>>>, "
    "pairs array<struct<entity:long,term:long>>, entities array<long>"
)
_PLACE = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_TYPES = {
    "base": pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])),
    "terms": pa.list_(pa.struct([("term", pa.int64()), ("places", pa.list_(_PLACE))])),
    "pairs": pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())])),
    "entities": pa.list_(pa.int64()),
}


def _scan(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            out = {c: [] for c in _TYPES}
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                terms, pairs, entities = contexts(text, spans)
                out["base"].append([(a, k, b) for a, k, b in spans])
                out["terms"].append(sorted(terms.items()))
                out["pairs"].append(sorted(pairs))
                out["entities"].append(sorted(entities))
            arrays = [pa.array(out[c], kind) for c, kind in _TYPES.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", *_TYPES])


def _document_counts(batches):
    """Terms with the number of documents that hold them, summed over what a task has read."""
    counts: Counter = Counter()

    def flushed():
        batch = pa.RecordBatch.from_arrays(
            [pa.array([_hash(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
            names=["term", "n"],
        )
        counts.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            texts = batch.column(0).slice(at, 64).to_pylist()
            own = ({t.lower() for t in set(TERM.findall(x))} for x in texts if x)
            counts.update(chain.from_iterable(own))
            if len(counts) > HELD_TERMS:
                yield flushed()
    yield flushed()


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One written row per row of docs: row, id, personal data, the terms beside it, near (entity, term) pairs."""
    narrow = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    found = narrow.mapInArrow(_scan, f"id {kind}, {SCANNED}")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), "personal")


def _held(found: DataFrame) -> DataFrame:
    """(row, entity), each once."""
    return found.select("row", F.explode("entities").alias("entity"))


def _term_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t) of all documents, written once."""
    texts = docs.select(column(docs, text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(_document_counts, "term long, n long")
    return stage(counts.groupBy("term").agg(F.sum("n").alias("n_t")), "terms")


def _common(by_term: DataFrame) -> DataFrame:
    """(term, n_t) of the terms with 1 / COMMON_TERMS of all places in documents: COMMON_TERMS at most."""
    places = by_term.agg(F.sum("n_t")).first()[0] or 0
    return by_term.where(F.col("n_t") * COMMON_TERMS >= places)


def _share(n, n_e: Column, n_t: Column, n_et: Column) -> Column:
    """The share of an entity's information content that a term reveals; 0 where it has none."""
    content = F.log(F.lit(float(max(n, 1))) / n_e)
    mutual = F.log(F.lit(float(n)) * n_et / (n_e * n_t))
    return F.when(content > 0, mutual / content).otherwise(0.0)


def _shares(found: DataFrame, by_term: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(row, entity, term) of near terms, and (entity, term, share, sure, elsewhere) from GENERALISE_FROM on.

    sure says that more than one document is the evidence, elsewhere that other documents
    than those where the term is near hold it.
    """
    pairs = found.select("row", F.explode("pairs").alias("p")).select("row", "p.entity", "p.term")
    pairs = stage(pairs, "pairs")
    by_entity = _held(found).groupBy("entity").agg(F.count("*").alias("n_e"))
    together = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    joined = together.join(by_entity, "entity").join(by_term, "term")
    strong = joined.select(
        "entity",
        "term",
        _share(n, F.col("n_e"), F.col("n_t"), F.col("n_et")).alias("share"),
        (F.col("n_et") > 1).alias("sure"),
        (F.least("n_e", "n_t") > F.col("n_et")).alias("elsewhere"),
    )
    return pairs, strong.where(F.col("share") >= GENERALISE_FROM)


def disclosing(docs: DataFrame, text_col: str, found: DataFrame) -> DataFrame:
    """(row, term, share): the largest share of an entity of that row that a term near it reveals.

    Only terms from GENERALISE_FROM on are given.
    """
    pairs, strong = _shares(found, _term_counts(docs, text_col), found.count())
    return _near(pairs, strong).groupBy("row", "term").agg(F.max("share").alias("share"))


def _near(pairs: DataFrame, strong: DataFrame) -> DataFrame:
    return pairs.join(strong, ["entity", "term"]).select("row", "term", "share", "sure")


def _whole(found: DataFrame, by_term: DataFrame, n: int) -> DataFrame:
    """(row, term, share, sure) of terms that reveal an entity of that row by the documents that hold both.

    Entities that the same documents hold (many, where a long text is copied) count as one:
    they share all counts. A pair reaches GENERALISE_FROM only where
    n(t) <= n(e, t) * (N / n(e)) ** (1 - GENERALISE_FROM), and n(e, t) <= n(e), all less one,
    so common terms go before they meet the entities. Those that hold 1 / COMMON_TERMS of all
    places in documents, no more than COMMON_TERMS in number, go before any shuffle.
    """
    held = _held(found)
    known = held.groupBy("entity").agg(
        F.count("*").alias("n_e"),
        F.bit_xor(F.xxhash64("row")).alias("a"),
        F.bit_xor(F.xxhash64(F.lit("b"), "row")).alias("b"),
    )
    known = known.where((F.col("n_e") > 1) & (F.col("n_e") < n))
    groups = stage(held.join(known, "entity").select("row", "a", "b", "n_e").distinct(), "groups")
    others = F.col("n_e") - 1
    reach = others * F.pow(F.lit(float(max(n - 1, 1))) / others, 1 - GENERALISE_FROM)
    rows = groups.groupBy("row").agg(F.max(reach).alias("widest"))
    terms = found.join(rows, "row").select("row", "widest", F.explode("terms.term").alias("term"))
    # The margin keeps rounding from deciding; the shares themselves do.
    slack = 1 + 1e-9
    widest = rows.agg(F.max("widest")).first()[0] or 0.0
    common = F.broadcast(_common(by_term).where(F.col("n_t") - 1 > widest * slack).select("term"))
    terms = terms.join(common, "term", "left_anti")
    rare = by_term.where("n_t > 1").join(common, "term", "left_anti")
    rare = terms.join(rare, "term").where((F.col("n_t") - 1) <= F.col("widest") * slack)
    pairs = rare.join(groups, "row").where((F.col("n_t") - 1) <= reach * slack)
    pairs = stage(pairs.select("row", "a", "b", "n_e", "term", "n_t"), "whole")
    together = pairs.groupBy("a", "b", "n_e", "term", "n_t").agg(F.count("*").alias("n_et"))
    share = _share(n - 1, others, F.col("n_t") - 1, F.col("n_et") - 1)
    strong = together.where("n_et > 1").select("a", "b", "term", share.alias("share"))
    strong = strong.where(F.col("share") >= GENERALISE_FROM)
    return pairs.join(strong, ["a", "b", "term"]).select("row", "term", "share", F.lit(True).alias("sure"))


def disclosing_anywhere(found: DataFrame, by_term: DataFrame) -> DataFrame:
    """(row, term, remove): all terms to be masked in that row, near its entities or not."""
    n = found.count()
    pairs, strong = _shares(found, by_term, n)
    strong = stage(strong, "strong")
    held = found.select("row", F.explode("terms.term").alias("term"))
    # Through the term first: an entity's rows times its terms could be far more.
    other = strong.where("elsewhere")
    # Most places hold common terms that reveal no one; they go before the shuffle.
    held = held.join(F.broadcast(_common(by_term).join(other, "term", "left_anti").select("term")), "term", "left_anti")
    further = held.join(other, "term").join(_held(found), ["row", "entity"])
    every = _near(pairs, strong).unionByName(further.select("row", "term", "share", "sure"))
    every = every.unionByName(_whole(found, by_term, n))
    remove = F.max(F.col("sure") & (F.col("share") >= REMOVE_FROM))
    return stage(every.groupBy("row", "term").agg(remove.alias("remove")), "disclosing")


def with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: row, id, base and spans, arrays of (start, kind number, end)."""
    found = scanned(docs, id_col, text_col)
    by_term = _term_counts(docs, text_col)
    strong = disclosing_anywhere(found, by_term)
    places = found.select("row", F.explode("terms").alias("t")).select("row", "t.term", "t.places")
    harmless = _common(by_term).join(strong, "term", "left_anti").select("term")
    places = places.join(F.broadcast(harmless), "term", "left_anti")
    kind = F.when(F.col("remove"), SPAN_KINDS.index(REMOVED)).otherwise(SPAN_KINDS.index(GENERALISED))
    more = (
        places.join(strong, ["row", "term"])
        .withColumn("kind", kind)
        .withColumn("p", F.explode("places"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("p.start", "kind", "p.end")).alias("more"))
    )
    joined = found.select("row", "id", "base").join(more, "row", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select(
        "row", "id", "base", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans")
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in SPAN_KINDS])

    def one(s):
        return F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
        )

    return F.array_join(F.transform(spans, one), ",")


def _n_of_kind(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: counts of personal data, the digest of its places, all spans.

    A null text counts as empty. Repeated rows are documents of their own in the counts and
    come out alike. An empty table gives an empty result; extra columns are not read.
    """
    marked = with_spans(docs, id_col, text_col)
    return marked.select(
        F.col("id").alias(id_col),
        *[_n_of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def sanitised_text(text: str, spans: list) -> str:
    """text with personal data and strong terms masked, generalised or removed; overlaps are one span."""
    out, at = [], 0
    for s in spans:
        if s["start"] < at:
            at = max(at, s["end"])
            continue
        out.append(text[at : s["start"]])
        if s["kind"] < len(KINDS):
            out.append(f"[{KINDS[s['kind']].upper()}]")
        elif SPAN_KINDS[s["kind"]] == GENERALISED:
            out.append(GENERAL_WORD)
        at = s["end"]
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with sanitised texts; other columns, among them counts of characters, stay as they are.

    The texts are shuffled once, to meet their spans.
    """
    row, spans = fresh(docs, "pii_row", "pii_spans")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    marked = with_spans(numbered, row, text_col)
    marked = marked.select(F.col("id").alias(row), F.col("spans").alias(spans))
    joined = numbered.join(marked, row)
    at = [joined.columns.index(c) for c in (text_col, spans)]

    def run(batches):
        for batch in batches:
            texts = [
                x if x is None else sanitised_text(x, s)
                for x, s in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist())
            ]
            columns = list(batch.columns)
            columns[at[0]] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = map_rows(joined, run)
    return done.select(*[column(done, c) for c in docs.columns])
