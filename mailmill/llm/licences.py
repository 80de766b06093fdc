"""License scans: known licence sentences, and ordered rules over them.

A text is cut into sentences at line feeds and behind sentence marks. A sentence
in lower case, with one space for whatever is no letter or digit, is looked up
among the known sentences; each known one has a letter, every other sentence is a
dot. Rules are sequences of letters with at most GAP other sentences between;
longer rules come first, and a sentence counts for one rule only.

Everything is one projection of built-in functions, without a shuffle. Null and
empty texts match nothing. Known sentences all hold a word of TRIGGER, so texts
without one are not cut up.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.pii import matches
from mailmill.llm.tables import bound

GAP = 2
TRIGGER = r"(?i)licen[cs]e|rights reserved|copyright|permission|warrant|redistribut|creative commons|public domain|cc by|cc0|liable"

# Sentences of public licences and of the notices that name them.
SENTENCES = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "Licensed under CC0 1.0.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache2-named": "Licensed under the Apache License, Version 2.0.",
    "all-rights": "All rights reserved.",
    "apache2-notice": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache2-may-not": "you may not use this file except in compliance with the License.",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "public-domain": "This work is in the public domain.",
}

# Licence names by sequences of known sentences.
RULES = {
    "apache-2.0": (("apache2-notice", "apache2-may-not", "apache2-obtain", "apache2-as-is", "apache2-see"), ("apache2-notice", "apache2-may-not"), ("apache2-named",)),
    "mit": (("mit-grant", "mit-notice", "mit-as-is"), ("mit-grant", "mit-notice"), ("mit-released",), ("mit-licensed",)),
    "bsd": (("bsd-redistribution", "bsd-source", "bsd-binary"), ("bsd-redistribution", "bsd-source")),
    "gpl-3.0": (("gpl-free", "gpl-no-warranty", "gpl-received"), ("gpl-free", "gpl-no-warranty"), ("gpl3-work",)),
    "cc-by-nc-4.0": (("cc-by-nc-4",),),
    "cc-by-4.0": (("cc-by-4",),),
    "cc-by-sa-4.0": (("cc-by-sa-4",),),
    "cc0-1.0": (("cc0",),),
    "public-domain": (("public-domain",),),
    "proprietary": (("all-rights",),),
}


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


LETTERS = {name: chr(0x100 + i) for i, name in enumerate(SENTENCES)}
KNOWN = {normalised(text): LETTERS[name] for name, text in SENTENCES.items()}
SEQUENCES = {"".join(LETTERS[s] for s in rule): licence for licence, rules in RULES.items() for rule in rules}
PATTERN = "|".join(
    rf"\.{{0,{GAP}}}".join(sequence) for sequence in sorted(SEQUENCES, key=lambda s: (-len(s), s))
)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def sentence_letters(text: Column) -> Column:
    """A letter for each sentence that is known and a dot for each other one."""
    lines = F.split(F.regexp_replace(text, r"([.!?:;])[ \t\n\r\f]+", "$1\n"), "\n", -1)
    plain = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    known = _map(KNOWN)
    return F.array_join(F.transform(F.filter(plain, lambda s: s != ""), lambda s: F.coalesce(known[s], F.lit("."))), "")


def scan_licences(docs: DataFrame, text: str = "text", into: str = "licences") -> DataFrame:
    """Adds `into`: (licence, first, last) of each match by the number of its sentences, from left to right.

    `last` is not included. A column of that name is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = _map(SEQUENCES)
    empty = F.array().cast("array<struct<licence:string,first:int,last:int>>")

    def found(letters: Column) -> Column:
        return F.transform(
            matches(letters, PATTERN),
            lambda m: F.struct(names[F.replace(m["text"], F.lit("."), F.lit(""))].alias("licence"), m["start"].alias("first"), m["end"].alias("last")),
        )

    return docs.withColumn(into, F.when(body.rlike(TRIGGER), bound(sentence_letters(body), found)).otherwise(empty))


def licence_digest(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_matches, licences, places) of `scan_licences`, a row per document."""
    place = lambda m: F.concat_ws(":", m["licence"], m["first"], m["last"])
    return scanned.select(
        "doc_id", F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda m: m["licence"]))), ",").alias("licences"),
        F.array_join(F.transform("licences", place), ",").alias("places"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, with the tables of sentences and rules written out."""
    quoted = lambda pairs: ", ".join(f"'{k}': '{v}'" for k, v in pairs.items())
    return rf"""
with cut as (
  select doc_id, list_filter(list_transform(
    string_split(regexp_replace(coalesce(text, ''), '([.!?:;])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10)),
    lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') as sentences
  from documents),
lettered as (
  select doc_id, coalesce(array_to_string(list_transform(sentences, lambda s: coalesce(map_extract_value(map {{{quoted(KNOWN)}}}, s), '.')), ''), '') as letters
  from cut),
found as (
  select doc_id, regexp_extract_all(letters, '{PATTERN}') as hits, string_split_regex(letters, '{PATTERN}') as gaps from lettered),
named as (
  select doc_id, list_transform(range(1, len(hits) + 1), lambda i: {{
    'licence': map_extract_value(map {{{quoted(SEQUENCES)}}}, replace(hits[i], '.', '')),
    'last': list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))),
    'n': length(hits[i])}}) as ms
  from found)
select doc_id, len(ms)::bigint as n_matches,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(ms, lambda m: m.licence))), ','), '') as licences,
  coalesce(array_to_string(list_transform(ms, lambda m: m.licence || ':' || (m.last - m.n)::bigint || ':' || m.last::bigint), ','), '') as places
from named
"""
