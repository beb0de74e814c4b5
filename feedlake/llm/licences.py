"""Licence statements by sentence rules.

A text is cut into sentences, each is normalised to lower-case words, and a sentence that
is known as part of a licence gets its identifier. The identifiers of a text, in order,
are then matched against rules, the most demanding first; a rule takes the identifiers it
matched out of the sequence, so that a plainer rule does not count them again. What no
rule takes is reported as unmatched.

Everything is built from Spark's own functions; no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import column

# Texts without any of these hold none of the sentences below.
TRIGGER = (
    r"(?i)licen[sc]e|copyright|rights reserved|permission|warrant|redistribut|spdx|free software"
    r"|applicable law|endorse|as is|public domain|altered|misrepresented|creative commons|\bcc.by\b"
)
# Parts that may follow "CC BY", and how their names are spelled out.
CC_PARTS = ("", "nc", "nd", "sa", "nc nd", "nc sa")
CC_NAMES = {"nc": "nc|non ?commercial", "nd": "nd|no ?deriv(?:ative)?s?(?: works)?", "sa": "sa|share ?alike"}


def _cc(part: str) -> str:
    return "".join(f"(?:{CC_NAMES[p]}) " for p in part.split())


# Wording of public licences and of their usual notices, as patterns of a whole
# normalised sentence, and the identifier each stands for; $1, $2 are the pattern's groups.
SENTENCES = (
    (r"spdx licen[sc]e identifier ([a-z0-9 ]+)", "spdx=$1"),
    (r"copyright( c)? [0-9]{4}.*", "copyright"),
    (r"(.* )?all rights reserved", "copyright"),
    (r"(.* )?licensed under the apache (software )?licen[sc]e v(ersion )?([0-9]) ([0-9])( the licen[sc]e)?", "apache-notice=$4.$5"),
    (r"(.* )?licensed under the apache (software )?licen[sc]e v(ersion )?([0-9])( the licen[sc]e)?", "apache-notice=$4.0"),
    (r"(.* )?you may not use (this|these) files? except in compliance with the licen[sc]e", "apache-compliance"),
    (r"(.* )?you may obtain a copy of the licen[sc]e at( .*)?", "apache-copy"),
    (r"(.* )?unless required by applicable law or agreed to in writing.*", "apache-warranty"),
    (r"(.* )?licensed under the gnu general public licen[sc]e v(ersion )?([0-9]).*", "gpl-notice=$3"),
    (r"(.* )?licensed under the gnu general public licen[sc]e.*", "gpl-notice"),
    (r"(.* )?licensed under the gnu lesser general public licen[sc]e v(ersion )?([0-9]) ([1-9])( .*)?", "lgpl-notice=$3.$4"),
    (r"(.* )?licensed under the gnu lesser general public licen[sc]e v(ersion )?([0-9]).*", "lgpl-notice=$3"),
    (r"(.* )?licensed under the gnu lesser general public licen[sc]e.*", "lgpl-notice"),
    (r"(.* )?licensed under the gnu affero general public licen[sc]e v(ersion )?([0-9]).*", "agpl-notice=$3"),
    (r"(.* )?licensed under the gnu affero general public licen[sc]e.*", "agpl-notice"),
    (r"(.* )?is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e.* version ([0-9]).*", "gpl-free=$2"),
    (r"(.* )?is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e.* version ([0-9]).*", "lgpl-free=$2"),
    (r"(.* )?is distributed in the hope that it will be useful but without any warranty.*", "gpl-warranty"),
    (r"(.* )?you should have received a copy of the gnu .*general public licen[sc]e.*", "gpl-copy"),
    (r"see the gnu .*general public licen[sc]e for more details", "gpl-details"),
    (r"(.* )?(released|licensed|distributed) under the( terms of the)? mit licen[sc]e", "mit-notice"),
    (r"(.* )?permission is hereby granted free of charge to any person obtaining a copy.*", "mit-grant"),
    (r"(.* )?the above copyright notice and this permission notice shall be included in all copies.*", "mit-condition"),
    (r"(.* )?the software is provided as is without warranty of any kind.*", "mit-warranty"),
    (r"(.* )?redistribution and use in source and binary forms with or without modification are permitted.*", "bsd-grant"),
    (r"(.* )?redistributions of source code must retain the above copyright notice.*", "bsd-source"),
    (r"(.* )?redistributions in binary form must reproduce the above copyright notice.*", "bsd-binary"),
    (r"(.* )?neither the names? of .* may be used to endorse or promote products.*", "bsd-endorse"),
    (r"(.* )?this software is provided by .* as is.*", "bsd-warranty"),
    (r"(.* )?permission to use copy modify and( or)? distribute this software for any purpose.*", "isc-grant"),
    (r"(.* )?the software is provided as is and (the author|isc|.* )disclaims? all warranties.*", "isc-warranty"),
    (r"(.* )?this software is provided as is without any express or implied warranty.*", "zlib-warranty"),
    (r"(.* )?permission is granted to anyone to use this software for any purpose.*", "zlib-grant"),
    (r"(.* )?the origin of this software must not be misrepresented.*", "zlib-origin"),
    (r"(.* )?altered source versions must be plainly marked as such.*", "zlib-altered"),
    (r"(.* )?this notice may not be removed or altered from any source distribution.*", "zlib-notice"),
    (r"(.* )?permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e.*", "boost-grant"),
    (r"(.* )?distributed under the boost software licen[sc]e v(ersion )?([0-9]) ([0-9])( .*)?", "boost-notice=$3.$4"),
    (r"(.* )?under the( terms of the)? eclipse public licen[sc]e v(ersion)? ?([0-9]) ([0-9])( .*)?", "epl-notice=$4.$5"),
    (r"(.* )?this is free and unencumbered software released into the public domain", "unlicense"),
    *(
        (rf"(.* )?(released |licensed |available )?under (a |an |the )?(cc by|creative commons attribution) {_cc(p)}v?([0-9]) ([0-9])( .*)?",
         f"cc-by{'-' if p else ''}{p.replace(' ', '-')}=$5.$6")
        for p in CC_PARTS
    ),
    (r"(.* )?subject to the terms of the mozilla public licen[sc]e v(ersion)? ?([0-9]) ([0-9])( .*)?", "mpl-notice=$3.$4"),
    (r"(.* )?subject to the mozilla public licen[sc]e version ([0-9]) ([0-9])( .*)?", "mpl-notice=$2.$3"),
    (r"(.* )?(released|dedicated) (in|in to|into|to) the public domain.*", "public-domain"),
)

# Rules in the order they are tried: identifiers in sequence (a copyright line may stand between
# them), and the licence; $1 is the value an identifier of the rule carries.
RULES = (
    ("spdx=([^;]*)", "SPDX $1"),
    ("apache-notice=([^;]*) apache-compliance apache-copy apache-warranty", "Apache-$1 full notice"),
    ("apache-notice=([^;]*)", "Apache-$1"),
    ("gpl-free=([^;]*) gpl-warranty gpl-details gpl-copy", "GPL-$1.0 full notice"),
    ("gpl-free=([^;]*) gpl-warranty gpl-copy", "GPL-$1.0 full notice"),
    ("lgpl-free=([^;]*) gpl-warranty gpl-details gpl-copy", "LGPL-$1 full notice"),
    ("gpl-free=([^;]*)", "GPL-$1.0"),
    ("lgpl-free=([^;]*)", "LGPL-$1"),
    ("gpl-notice=([^;]*)", "GPL-$1.0"),
    ("lgpl-notice=([^;]*)", "LGPL-$1"),
    ("agpl-notice=([^;]*)", "AGPL-$1.0"),
    ("gpl-notice", "GPL"),
    ("lgpl-notice", "LGPL"),
    ("agpl-notice", "AGPL"),
    ("mit-grant mit-condition mit-warranty", "MIT text"),
    ("mit-notice", "MIT"),
    ("bsd-grant bsd-source bsd-binary bsd-endorse bsd-warranty", "BSD-3-Clause text"),
    ("bsd-grant bsd-source bsd-binary bsd-warranty", "BSD-2-Clause text"),
    ("isc-grant isc-warranty", "ISC text"),
    ("isc-grant mit-warranty", "ISC text"),
    ("zlib-warranty zlib-grant zlib-origin zlib-altered zlib-notice", "Zlib text"),
    ("boost-notice=([^;]*)", "BSL-$1"),
    ("boost-grant", "BSL text"),
    ("epl-notice=([^;]*)", "EPL-$1"),
    ("unlicense", "Unlicense"),
    ("isc-grant", "ISC"),
    *(
        (f"cc-by{'-' if p else ''}{p.replace(' ', '-')}=([^;]*)", f"CC BY{'-' if p else ''}{p.replace(' ', '-').upper()} $1")
        for p in CC_PARTS
    ),
    ("mpl-notice=([^;]*)", "MPL-$1"),
    ("public-domain", "Public domain"),
)

BREAK = "\x01"
# Sentence ends, empty lines, and line starts that open a statement become breaks.
BREAKS = (
    (r"([.!?:;])\s+", "$1" + BREAK),
    (r"\n\s*\n", BREAK),
    (r"(?i)\n(\s*)((copyright|permission|licensed|released|redistribution|this|spdx)\s)", BREAK + "$2"),
)
BETWEEN = "(?:;copyright;)*"

# Stops that stand inside a licence's wording, replaced before the breaks are set; an SPDX tag
# with its expression is a sentence of its own.
JOINS = (
    (
        r"(?i:\bspdx-licen[sc]e-identifier)\s*:\s*"
        r"(\(*[A-Za-z0-9.+:-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+:-]+\)*)*)",
        BREAK + "SPDX-License-Identifier $1" + BREAK,
    ),
    (r"(?i)\b(free\W+software)\s*[:;](\W+you\W+can\W+redistribute\b)", "$1$2"),
    (r"(?i)\b(licen[sc]e,?\s+v)[.]\s+([0-9])", "$1 $2"),
    (r"(?i)\b(free\W+software\W+foundation)\s*[:;](\W+either\W+version\b)", "$1$2"),
)
_FREE = r"(.* )?is free software you can redistribute it and or modify it under the terms of the gnu "
# Tried before SENTENCES.
MORE_SENTENCES = (
    (_FREE + r"lesser general public licen[sc]e.* version ([0-9]) ([0-9])( .*)?", "lgpl-free=$2.$3"),
    (_FREE + r"affero general public licen[sc]e.* version ([0-9]).*", "agpl-free=$2"),
)
# Tried before RULES.
MORE_RULES = (
    ("lgpl-free=([^;]*) gpl-warranty gpl-copy", "LGPL-$1 full notice"),
    ("agpl-free=([^;]*) gpl-warranty gpl-details gpl-copy", "AGPL-$1.0 full notice"),
    ("agpl-free=([^;]*) gpl-warranty gpl-copy", "AGPL-$1.0 full notice"),
    ("agpl-free=([^;]*)", "AGPL-$1.0"),
)


def rule_pattern(rule: str) -> str:
    """A rule as a pattern over ';id;;id;'."""
    return BETWEEN.join(f";{part};" for part in rule.split(" "))


def sentences(text: Column) -> Column:
    """The text's sentences, normalised: lower-case letters and digits, single spaces."""
    for pattern, by in (*JOINS, *BREAKS):
        text = F.regexp_replace(text, pattern, by)
    return F.transform(
        F.split(text, BREAK, -1),
        lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", " ")),
    )


def identifiers(text: Column) -> Column:
    """Identifiers of the text's licence sentences, in order."""

    def known(sentence):
        found = F.lit(None).cast("string")
        for pattern, name in reversed((*MORE_SENTENCES, *SENTENCES)):
            whole = f"^{pattern}$"
            named = F.regexp_replace(sentence, whole, name) if "$" in name else F.lit(name)
            found = F.when(F.rlike(sentence, F.lit(whole)), F.trim(named)).otherwise(found)
        return found

    candidates = F.filter(sentences(text), lambda s: F.rlike(s, F.lit(TRIGGER)))
    ids = F.filter(F.transform(candidates, known), lambda i: i.isNotNull())
    return F.when(F.rlike(text, F.lit(TRIGGER)), ids).otherwise(F.array().cast("array<string>"))


def licences(ids: Column) -> Column:
    """(found, rest): licences the rules find, in rule order, and the sequence they leave."""
    rules = F.array(
        *[F.struct(F.lit(rule_pattern(r)).alias("pattern"), F.lit(name).alias("name")) for r, name in (*MORE_RULES, *RULES)]
    )

    def apply(acc, rule):
        hits = F.regexp_extract_all(acc["rest"], rule["pattern"], F.lit(0))
        # The name takes its value from the matched identifiers alone.
        names = F.transform(
            hits, lambda h: F.regexp_replace(h, F.concat(F.lit("^"), rule["pattern"], F.lit("$")), rule["name"])
        )
        return F.struct(
            F.when(F.size(hits) > 0, F.regexp_replace(acc["rest"], rule["pattern"], F.lit(""))).otherwise(acc["rest"]).alias("rest"),
            F.concat(acc["found"], names).alias("found"),
        )

    # Separators on both sides of each identifier, so that neighbours can match one after the other.
    joined = F.array_join(F.transform(ids, lambda i: F.concat(F.lit(";"), i, F.lit(";"))), "")
    begin = F.struct(joined.alias("rest"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(rules, begin, apply)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, sentence_ids, licences, unmatched (all joined by `;`), n_sentences.

    Licences are distinct and sorted; unmatched holds the identifiers no rule took, bare
    copyright lines aside. A null or empty text has none. Repeated rows come out alike; whole
    texts are read; an empty table gives an empty result; extra columns are not read.
    """
    text = F.coalesce(column(docs, text_col), F.lit(""))
    marked = docs.select(column(docs, id_col).alias("id"), identifiers(text).alias("ids"))
    matched = marked.withColumn("m", F.when(F.size("ids") > 0, licences(F.col("ids"))))
    rest = F.filter(
        F.split(F.coalesce("m.rest", F.lit("")), ";"), lambda i: (i != "") & (i != "copyright")
    )
    found = F.coalesce("m.found", F.array().cast("array<string>"))
    return matched.select(
        F.col("id").alias(id_col),
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ";").alias("sentence_ids"),
        F.array_join(F.array_sort(F.array_distinct(found)), ";").alias("licences"),
        F.array_join(rest, ";").alias("unmatched"),
    )


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _groups(value: str) -> str:
    return value.replace("$", "\\")


def _oracle() -> str:
    text = "text"
    for pattern, by in (*JOINS, *BREAKS):
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(_groups(by))}, 'g')"
    cases = "\n".join(
        f"WHEN regexp_full_match(s, {_quoted(p)}) THEN trim(regexp_replace(s, {_quoted('^' + p + '$')}, {_quoted(_groups(n))}))"
        for p, n in (*MORE_SENTENCES, *SENTENCES)
    )
    steps, last = [], "joined"
    for k, (rule, name) in enumerate((*MORE_RULES, *RULES)):
        p = _quoted(rule_pattern(rule))
        whole = _quoted("^" + rule_pattern(rule) + "$")
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, regexp_replace(rest, {p}, '', 'g') AS rest, list_concat(found,"
            f" [regexp_replace(h, {whole}, {_quoted(_groups(name))}) FOR h IN regexp_extract_all(rest, {p})]) AS found FROM {last})"
        )
        last = f"r{k}"
    return f"""
WITH cut AS (
  SELECT doc_id, generate_subscripts(a, 1) AS k, unnest(a) AS s
  FROM (SELECT doc_id, string_split({text}, chr(1)) AS a FROM documents WHERE text IS NOT NULL)),
norm AS (SELECT doc_id, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM cut),
known AS (SELECT doc_id, k, CASE {cases} END AS id FROM norm),
ids AS (SELECT doc_id, list(id ORDER BY k) AS ids FROM known WHERE id IS NOT NULL GROUP BY doc_id),
joined AS (
  SELECT doc_id, coalesce(ids, []::VARCHAR[]) AS ids, []::VARCHAR[] AS found,
    array_to_string([';' || i || ';' FOR i IN coalesce(ids, []::VARCHAR[])], '') AS rest
  FROM documents LEFT JOIN ids USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ';') AS sentence_ids,
  array_to_string(list_sort(list_distinct(found)), ';') AS licences,
  array_to_string([i FOR i IN string_split(rest, ';') IF i <> '' AND i <> 'copyright'], ';') AS unmatched
FROM {last}
"""


ORACLE_SQL = _oracle()
