"""Licence scan by sentence rules.

A text is cut into sentences at line ends and at ``. ! ? ; :`` before white space or the end; ASCII capitals are lower-cased and all runs of
other characters than letters, digits and dots become one blank. Sentences known from licences are replaced by their identifiers, others
drop out. Rules, each a sequence of identifiers, then take their turns in order: a rule takes every place its sequence stands, and what
is taken is gone for later rules, so a full licence text comes before its single sentences. DataFrame functions only, no shuffle.

Defined results: null, empty and other texts without known sentences have no identifiers and no licence; known sentences that no rule
takes are counted in ``n_left``; repeated documents are judged each by itself; other columns are ignored.
"""

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_END = r"[.!?;:]+([ \t\r\n]|\z)"
_OTHER = r"[^a-z0-9.\n]+"

# Normalised sentences of well-known licences and their identifiers.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "released under the mit license": "mit-name", "licensed under the mit license": "mit-name", "this project is licensed under the mit license": "mit-name", "spdx license identifier mit": "mit-name",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under the apache license version 2.0": "apache-2-name", "licensed under the apache license version 2.0 the license": "apache-2-name", "released under the apache license version 2.0": "apache-2-name", "spdx license identifier apache 2.0": "apache-2-name",
    "you may not use this file except in compliance with the license": "apache-2-compliance",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl-2-name",
    "this is free and unencumbered software released into the public domain": "unlicense-name",
    "all rights reserved": "reserved",
}
_LINES = ("licensed under the", "this work is licensed under the", "this program is licensed under the", "released under the", "distributed under the terms of the")
_FAMILY = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}
SENTENCES |= {f"{line} {name} version {v}{tail}": f"{short}-{v}{'-later' if tail else ''}"
              for line in _LINES for short, name in _FAMILY.items() for v in ("2", "2.1", "3", "3.0") for tail in ("", " or later")}
_CC = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
SENTENCES |= {f"{line}cc {kind} {v}": f"cc-{kind.replace(' ', '-')}-{v}" for line in ("licensed under ", "this work is licensed under ", "released under ") for kind in _CC for v in ("3.0", "4.0")}

#: (licence, identifiers in order); earlier rules take first.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-name", "mit-grant")), ("ISC", ("isc-grant", "as-is")),
    ("Apache-2.0", ("apache-2-name", "apache-2-compliance", "apache-2-as-is")), ("Apache-2.0", ("apache-2-name", "apache-2-compliance")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-notice")), ("MIT", ("mit-name",)), ("ISC", ("isc-grant",)), ("Apache-2.0", ("apache-2-name",)),
    ("MPL-2.0", ("mpl-2-name",)), ("Unlicense", ("unlicense-name",)),
]
RULES += [(f"{short.upper()}-{v if '.' in v else v + '.0'}-{'or-later' if tail else 'only'}", (f"{short}-{v}{tail}",))
          for short in _FAMILY for v in ("2", "2.1", "3", "3.0") for tail in ("-later", "")]
RULES += [(f"CC-{kind.replace(' ', '-').upper()}-{v}", (f"cc-{kind.replace(' ', '-')}-{v}",)) for kind in _CC for v in ("3.0", "4.0")]


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    lines = F.split(F.regexp_replace(F.regexp_replace(lower, _END, "\n"), _OTHER, " "), "\n")
    known = F.create_map(*map(F.lit, chain.from_iterable(sentences.items())))
    named = F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: F.length(s) >= min(map(len, sentences)))
    return F.array_compact(F.transform(named, lambda s: F.try_element_at(known, s)))


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id``, ``n_sentences`` known, ``sentence_ids`` (as ``<id><id>``), ``licences`` (sorted, distinct) and ``n_left`` per row of ``docs(doc_id, text)``."""
    ids = F.array_join(F.transform(sentence_ids(F.col("text"), sentences), lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    marked = docs.select("doc_id", ids.alias("sentence_ids"))
    found, rest = [], F.col("sentence_ids")
    for name, sequence in rules:
        pattern = "".join(f"<{i}>" for i in sequence)
        found.append(F.when(F.contains(rest, F.lit(pattern)), name))
        rest = F.replace(rest, F.lit(pattern), F.lit("|"))
    # most texts hold no known sentence and pass no rule
    some = F.col("sentence_ids") != ""
    count = lambda s: F.length(s) - F.length(F.replace(s, F.lit("<"), F.lit("")))
    licences = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), ",")
    return marked.select(
        "doc_id", count(F.col("sentence_ids")).cast("long").alias("n_sentences"), "sentence_ids",
        F.when(some, licences).otherwise("").alias("licences"), F.when(some, count(rest)).otherwise(0).cast("long").alias("n_left"))


def oracle(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The same in DuckDB's SQL."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences.items())
    steps, before = [], "ids"
    for k, (name, sequence) in enumerate(rules):
        pattern = "".join(f"<{i}>" for i in sequence)
        steps.append(f"r{k} AS (SELECT doc_id, all_ids, CASE WHEN contains(s, '{pattern}') THEN list_append(f, '{name}') ELSE f END AS f, replace(s, '{pattern}', '|') AS s FROM {before})")
        before = f"r{k}"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_END}', chr(10), 'g'), '{_OTHER}', ' ', 'g') AS t FROM documents),
        lines AS (SELECT k, unnest(string_split(t, chr(10))) AS s, unnest(range(len(string_split(t, chr(10))))) AS place FROM d),
        known AS (SELECT * FROM (VALUES {known}) AS v(s, id)),
        seen AS (SELECT k, string_agg('<' || id || '>', '' ORDER BY place) AS all_ids FROM lines JOIN known ON trim(lines.s) = known.s GROUP BY k),
        ids AS (SELECT doc_id, coalesce(all_ids, '') AS all_ids, CAST([] AS VARCHAR[]) AS f, coalesce(all_ids, '') AS s FROM d LEFT JOIN seen USING (k)),
        {', '.join(steps)}
        SELECT doc_id, CAST(len(all_ids) - len(replace(all_ids, '<', '')) AS BIGINT) AS n_sentences, all_ids AS sentence_ids,
               array_to_string(list_sort(list_distinct(f)), ',') AS licences, CAST(len(s) - len(replace(s, '<', '')) AS BIGINT) AS n_left FROM {before}"""
