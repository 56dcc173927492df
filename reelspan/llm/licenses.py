"""Licence recognition by sentences: known sentences get identifiers, rules are ordered identifiers.

A text is cut into sentences twice, with line ends as boundaries and as spaces (licence texts are
often wrapped). Sentences are normalised (lower case, runs of other than letters and digits become
one space) and looked up among the known ones; what remains of a text is a short string of
identifiers such as <3><4><5>. A rule matches where its identifiers come in their order, with
anything between. Texts that can hold a licence in its published layout are cut a third time, into
clauses: at sentence ends, ':', ';', lines without a letter or digit, copyright lines and list
letters, with wrapped lines joined; more sentences and rules hold for that cut alone. All of it is
one projection over the documents: nothing is shuffled, so neither hot sources nor copies matter,
and memory is one row's.

Defined results: null or empty text has no sentences and no licences. Each row stands for itself.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.common import free_name, table

# Licence sentences in normal form; a sentence's identifier is its place, from 1.
SENTENCES = (
    "released under the mit license",
    "this project is licensed under the mit license",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "licensed under the apache license version 2 0",
    "licensed under the apache license version 2 0 the license",
    "you may not use this file except in compliance with the license",
    "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "this work is licensed under the gnu general public license version 3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "licensed under cc by nc 4 0",
    "licensed under cc by 4 0",
    "this work is licensed under a creative commons attribution 4 0 international license",
    "spdx license identifier mit",
    "spdx license identifier apache 2 0",
    "spdx license identifier gpl 3 0 or later",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "this is free and unencumbered software released into the public domain",
    "boost software license version 1 0 august 17th 2003",
    "this software is provided as is without any express or implied warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software",
    "this source code form is subject to the terms of the mozilla public license v",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license",
)
# Licences and the sentences, in order, that name them (alternatives in one licence).
RULES = {
    "MIT": ((1,), (2,), (3, 4, 5), (22,)),
    "Apache-2.0": ((6,), (7, 8, 9), (7, 10), (23,)),
    "GPL-3.0": ((11,), (12, 14), (24,)),
    "GPL-2.0-or-later": ((13, 14),),
    "BSD-3-Clause": ((15, 16, 17, 18),),
    "BSD-2-Clause": ((15, 16, 17),),
    "CC-BY-NC-4.0": ((19,),),
    "CC-BY-4.0": ((20,), (21,)),
    "ISC": ((25,),),
    "0BSD": ((26,),),
    "Unlicense": ((27,),),
    "BSL-1.0": ((28,),),
    "Zlib": ((29, 30),),
    "MPL-2.0": ((31,),),
    "LGPL-2.1-or-later": ((32,),),
    "LGPL-3.0-or-later": ((33,),),
    "AGPL-3.0-or-later": ((34,),),
    "CC-BY-SA-4.0": ((35,),),
}
# Further licence names that may stand in an SPDX line.
NAMED = "BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-SA-4.0 ISC 0BSD Unlicense BSL-1.0 Zlib MPL-2.0 LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-or-later GPL-2.0-or-later".split()
RULES = {k: v + (((len(SENTENCES) + 1 + NAMED.index(k),),) if k in NAMED else ()) for k, v in RULES.items()}
SENTENCES += tuple("spdx license identifier " + re.sub("[^a-z0-9]+", " ", k.lower()) for k in NAMED)
# Sentences as the clause cut of published texts gives them, numbered on from SENTENCES.
CLAUSES = (
    "you may obtain a copy of the license at",
    "the asf licenses this file to you under the apache license version 2 0 the license",
    "apache license version 2 0 january 2004 http www apache org licenses",
    "terms and conditions for use reproduction and distribution",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "this program is distributed in the hope that it will be useful but without any warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose",
    "gnu general public license version 3 29 june 2007",
    "gnu general public license version 2 june 1991",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this program is free software",
    "apache license version 2 0 january 2004 https www apache org licenses",
)
_I = len(SENTENCES)
#: Clauses that also count at the end of a longer one: a holder's name or address comes before them.
TAILS = (CLAUSES[10], CLAUSES[11])
CLAUSE_RULES = {
    "Apache-2.0": ((7, 8, _I + 1), (_I + 2, 8, _I + 1), (_I + 2, 10), (_I + 3, _I + 4), (_I + 14, _I + 4)),
    "GPL-3.0": ((_I + 13, _I + 5, _I + 7, _I + 8), (_I + 9, _I + 11)),
    "GPL-2.0-or-later": ((_I + 13, _I + 6, _I + 7, _I + 8),),
    "BSD-3-Clause": ((15, 16, 17, _I + 12),),
    "GPL-2.0": ((_I + 10, _I + 11),),
}
MARK = "\x01"
ENDS = r"[.!?]+(\s+|$)"
#: Every rule has a sentence that holds one of these; other texts need no clauses.
HINT = r"(?i)licen[sc]e|permission|redistribut|cc\W+by|unencumbered|liable"
LETTERED = r"(^|\n)[ \t]*(?:dnl|rem)(?=\s)"  # comment prefixes that are letters
CLAUSE_ENDS = r"[.!?]+(\s+|$)|(?<=[\p{L}\p{N}\x22')”])[:;](\s+|$)|\n[^\p{L}\p{N}]*\n|(?<=\n)[^\p{L}\p{N}\n]*\(?[a-z0-9]{1,2}\)\s|all rights reserved"
COPYRIGHT = r"(^|\n)([^\p{L}\p{N}\n]*(?:copyright[ \t]+[(©<\[12]|\(c\)[ \t]+copyright|©)[^\n]*)(\n|$)"


def sentences(text: Column, lines: bool) -> Column:
    """Normalised sentences that are not empty; with `lines`, line ends are boundaries too."""
    marked = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ENDS + (r"|\n" if lines else ""), MARK)
    plain = F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")
    return F.filter(F.transform(F.split(plain, MARK), lambda s: F.trim(s)), lambda s: s != "")


def clauses(text: Column) -> Column:
    """Normalised clauses of a text in a licence's published layout, with or without comment signs."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\r\n?", "\n"), LETTERED, "$1")
    marked = F.regexp_replace(F.regexp_replace(bare, COPYRIGHT, f"$1{MARK}$2{MARK}\n"), CLAUSE_ENDS, MARK)
    plain = F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")

    def named(s: Column) -> Column:
        out = F.trim(s)
        for tail in TAILS:
            out = F.when(F.endswith(F.trim(s), F.lit(" " + tail)), F.lit(tail)).otherwise(out)
        return out

    return F.when(text.rlike(HINT), F.filter(F.transform(F.split(plain, MARK), named), lambda s: s != "")).otherwise(F.array().cast("array<string>"))


#: Known sentences are looked up in the one of this many lists that their hash names.
LISTS = 64


def identifiers(found: Column, sentences_: tuple[str, ...] = SENTENCES) -> Column:
    """The known sentences as a string of <identifier>s."""
    lists: list[list[int]] = [[] for _ in range(LISTS)]
    for i, s in enumerate(sentences_, 1):
        lists[xxhash.xxh64_intdigest(s, 42) % LISTS].append(i)  # what xxhash64 gives in Spark
    texts = F.array(*[F.array(*[F.lit(sentences_[i - 1]) for i in own]).cast("array<string>") for own in lists])
    numbers = F.array(*[F.array(*map(F.lit, own)).cast("array<int>") for own in lists])

    def number(s: Column) -> Column:
        at = F.xxhash64(s).bitwiseAND(F.lit(LISTS - 1)).cast("int")
        return F.get(F.get(numbers, at), F.array_position(F.get(texts, at), s).cast("int") - 1)

    known = F.filter(F.transform(found, number), lambda i: i.isNotNull())
    return F.concat_ws("", F.transform(known, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))))


def follows(ids: Column, rule: tuple[int, ...]) -> Column:
    return ids.like("%" + "%".join(f"<{i}>" for i in rule) + "%")


#: Identifiers other than the first of the BSD sentences.
OTHERS = r"(?:<(?:[0-9]|1[0-46-9]|[2-9][0-9]|[0-9]{3,})>)*"


def bsd_three(last: int) -> str:
    """A pattern for the sentences of one three-clause licence, whose first three are those of the two-clause one."""
    return OTHERS.join(f"<{i}>" for i in (15, 16, 17, last))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """`docs` with n_sentences, line_ids, sentence_ids and license_ids in one struct `_licenses` (see `free_name`)."""
    line, count, a, b, c, out_name = (free_name(docs, x) for x in ("_s", "_n", "_a", "_b", "_c", "_licenses"))
    by_line = docs.withColumn(line, sentences(F.col("text"), lines=True))
    found = by_line.withColumn(count, F.size(line).cast("long")).withColumn(a, identifiers(F.col(line))).withColumn(b, identifiers(sentences(F.col("text"), lines=False)))
    found = found.withColumn(c, identifiers(clauses(F.col("text")), SENTENCES + CLAUSES))
    cuts = [F.col(a), F.col(b), F.col(c)]

    def matches(name: str, ids: list[Column]) -> Column:
        match = F.lit(False)
        for rule in RULES.get(name, ()):
            for own in ids:
                match = match | follows(own, rule)
        for rule in CLAUSE_RULES.get(name, ()):
            match = match | follows(ids[2], rule)
        return match

    hits = []
    for name in dict.fromkeys([*RULES, *CLAUSE_RULES]):
        ids = cuts
        if name == "BSD-2-Clause":  # its sentences begin those of the three-clause licence, which are taken out
            ids = [F.regexp_replace(F.regexp_replace(x, bsd_three(18), ""), bsd_three(_I + 12), "") for x in cuts]
        hits.append(F.when(matches(name, ids), F.lit(name)))
    out = F.struct(F.col(count).alias("n_sentences"), F.col(a).alias("line_ids"), F.col(b).alias("sentence_ids"), F.concat_ws(",", *hits).alias("license_ids"))
    return found.withColumn(out_name, out).drop(line, count, a, b, c)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_sentences, line_ids, sentence_ids, license_ids of every row of documents."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_licenses.*")


def _oracle() -> str:
    known = ", ".join(f"'{s}'" for s in SENTENCES)

    def cut(lines: str) -> str:
        return rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower(coalesce(text, '')),
            '[.!?]+(\s+|$){lines}', chr(1), 'g'), '[^\p{{L}}\p{{N}}' || chr(1) || ']+', ' ', 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"""

    def ids(cut_: str) -> str:
        return f"list_reduce(list_prepend('', list_transform(list_filter(list_transform({cut_}, lambda s: coalesce(list_position([{known}], s), 0)), lambda i: i > 0), lambda i: '<' || i || '>')), lambda x, y: x || y)"

    def like(rule: tuple[int, ...]) -> str:
        p = "%" + "%".join(f"<{i}>" for i in rule) + "%"
        return f"(line_ids LIKE '{p}' OR sentence_ids LIKE '{p}')"

    hits = []
    for name, rules in RULES.items():
        test = "(" + " OR ".join(map(like, rules)) + ")"
        if name == "BSD-2-Clause":
            for x in ("line_ids", "sentence_ids"):
                test = test.replace(x, f"regexp_replace({x}, '{bsd_three(18)}', '', 'g')")
        hits.append(f"CASE WHEN {test} THEN '{name}' END")
    lines = cut(r"|\n")
    return f"""
WITH found AS (SELECT doc_id, len({lines}) AS n_sentences, {ids(lines)} AS line_ids, {ids(cut(""))} AS sentence_ids FROM documents)
SELECT doc_id, n_sentences, line_ids, sentence_ids, concat_ws(',', {", ".join(hits)}) AS license_ids FROM found
"""


ORACLE_SQL = _oracle()
