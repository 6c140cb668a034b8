"""Licence scans by sentence recognition. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.llm.common import id_or_max, id_or_null

#: Known licence sentences, normalised: (identifier, sentence).
SENTENCES = (
    ("apache2-notice", "licensed under the apache license version 2 0"),
    ("apache2-obtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2-limits", "you may not use this file except in compliance with the license"),
    ("apache2-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-release", "released under the mit license"),
    ("mit-license", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied"),
    ("gpl3-work", "this work is licensed under the gnu general public license version 3"),
    ("gpl-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty"),
    ("bsd-redistribute", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("ccbync4", "licensed under cc by nc 4 0"),
    ("ccbysa4", "licensed under cc by sa 4 0"),
    ("ccby4", "licensed under cc by 4 0"),
    ("rights", "all rights reserved"),
)
#: Licences by the identifiers that must follow one another among a text's known sentences. Earlier rules come first.
RULES = (
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache2-notice",)),
    ("Apache-2.0", ("apache2-limits", "apache2-obtain", "apache2-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-release",)),
    ("MIT", ("mit-license",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-2.0-or-later", ("gpl-redistribute", "gpl-hope")),
    ("CC-BY-NC-4.0", ("ccbync4",)),
    ("CC-BY-SA-4.0", ("ccbysa4",)),
    ("CC-BY-4.0", ("ccby4",)),
    ("Proprietary", ("rights",)),
)

#: Licence sentences in full, normalised, that are found wherever a text has their words in a row, over line ends, comment marks and list numbers: (identifier, words).
PASSAGES = (
    ("apache2-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache2-obtain", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache2-obtain", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache2-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl3-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2-redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd-redistribute", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
)
#: Rules that only passages can meet; they come after the others.
PASSAGE_RULES = (
    ("GPL-3.0-or-later", ("gpl3-redistribute", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-redistribute", "gpl-hope")),
)


def anchors(sentences: tuple = SENTENCES) -> list[str]:
    """Few words of which every known sentence has one: a text without them has no known sentence. Greedy cover, longer words first."""
    left = [set(s.split()) for _, s in sentences]
    out: list[str] = []
    while left:
        words = sorted({w for s in left for w in s if len(w) > 3} or {w for s in left for w in s})
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w), w))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def sentences_of(text: Column) -> Column:
    """Sentences: ended by a line end, or by . ! ? or ; with white space after it; normalised to lower-case runs of a-z and 0-9 with single spaces."""
    cut = F.split(F.regexp_replace(text, r"([.!?;])[\x20\x09-\x0D]+", "$1\n"), "\n")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))


def known_in(s: Column, sentences: tuple, passages: tuple) -> Column:
    """Identifiers of the sentences s that are known, and of the passages that their words have in a row, in the order of their first characters; one that is found both ways at one place counts once."""
    known = F.create_map(*[F.lit(x) for i, t in sentences for x in (t, i)])
    none = F.array().cast("array<struct<at:int,id:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        i = F.element_at(known, x)
        out = F.when(i.isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), i.alias("id"))))).otherwise(acc["out"])
        return F.struct((acc["at"] + F.length(x) + 1).alias("at"), out.alias("out"))

    found = [F.aggregate(s, start, step, lambda acc: acc["out"])]
    flat = F.concat(F.lit(" "), F.array_join(s, " "), F.lit(" "))

    def placing(i: str, size: int) -> Callable[[Column, Column], Column]:
        def place(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x)
            return F.struct((at + size).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), F.lit(i).alias("id")))).alias("out"))

        return place

    for i, words in passages:
        # the texts between the places of the passage; its spaces before and after stay outside, so that places may touch
        parts = F.split(flat, f"(?<= ){words}(?= )")
        begin = F.struct(F.lit(-1).alias("at"), none.alias("out"))
        places = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), begin, placing(i, len(words)), lambda acc: acc["out"])
        found.append(F.when(F.contains(flat, F.lit(f" {words} ")), places).otherwise(none))
    return F.transform(F.array_sort(F.concat(found[0], F.array_except(F.concat(*found[1:]), found[0]))) if passages else found[0], lambda x: x["id"])


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: tuple = SENTENCES, rules: tuple = RULES, passages: tuple = PASSAGES, passage_rules: tuple = PASSAGE_RULES) -> DataFrame:
    """(id_col, n_known, sentence_ids, licenses, license) per row of df.

    Each text's sentences are normalised and mapped to identifiers by the table of known sentences; sentence_ids has
    those known, in their order in the text. A rule matches if its identifiers follow one another there; licenses
    lists the licences of all matching rules in the rules' order, each once, and license is the first. Whole texts are
    read in one pass without a shuffle; a text without any of the anchor words, of which every known sentence has at
    least one, is not cut into sentences.

    Full licence sentences (passages) are found as well where they are wrapped over lines or in comments: their words must
    stand in a row. They only add to what the sentences give, and passage_rules to the rules.

    Null and empty texts have no sentences: 0, empty lists as empty strings, and a null license. Repeated rows give
    repeated rows; an empty table gives an empty result; other columns are not read. The book of sentences and rules
    is a constant in the plan and thus small.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lower = F.lower(text)
    may = F.lit(False)
    for a in anchors((*sentences, *passages)):
        may = may | F.contains(lower, F.lit(a))
    book = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",".join(need) + ",").alias("need")) for name, need in (*rules, *passage_rules)])
    cut = df.select(id_or_max(id_col).alias("id"), F.when(may, F.filter(sentences_of(text), lambda s: s != "")).otherwise(F.array().cast("array<string>")).alias("s"))
    found = cut.select("id", F.when(F.size("s") > 0, known_in(F.col("s"), sentences, passages)).otherwise(F.array().cast("array<string>")).alias("ids"))
    joined = found.select("id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"))
    match = F.array_distinct(F.transform(F.filter(book, lambda r: F.contains(F.concat(F.lit(","), F.col("sentence_ids"), F.lit(",")), r["need"])), lambda r: r["name"]))
    out = joined.withColumn("names", F.when(F.col("n_known") > 0, match).otherwise(F.array().cast("array<string>")))
    return out.select(id_or_null(F.col("id")).alias(id_col), "n_known", "sentence_ids", F.array_join("names", ",").alias("licenses"), F.get("names", 0).alias("license"))


def oracle(sentences: tuple = SENTENCES, rules: tuple = RULES) -> str:
    """DuckDB SQL for license_scan over documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(i)}, {quoted(s)})" for i, s in sentences)
    book = ", ".join(f"({k}, {quoted(n)}, {quoted(',' + ','.join(r) + ',')})" for k, (n, r) in enumerate(rules))
    return rf"""
with known(id, sentence) as (values {known}),
rules(k, name, need) as (values {book}),
cut as (select doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) as s from documents),
each as (select doc_id, unnest(s) as s, unnest(range(1, len(s) + 1)) as k from cut),
seq as (
  select doc_id, string_agg(id, ',' order by e.k) as ids, count(*) as n
  from (select doc_id, k, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) as s from each) e join known on e.s = sentence group by doc_id),
hit as (
  select doc_id, string_agg(name, ',' order by k) as names, arg_min(name, k) as first
  from (select doc_id, name, min(k) as k from seq join rules on contains(',' || ids || ',', need) group by doc_id, name) group by doc_id)
select d.doc_id, coalesce(n, 0) as n_known, coalesce(ids, '') as sentence_ids, coalesce(names, '') as licenses, first as license
from documents d left join seq on d.doc_id = seq.doc_id left join hit on d.doc_id = hit.doc_id"""
