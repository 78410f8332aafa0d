"""Licence recognition by sentences (built-in DataFrame operations only).

Texts are cut into sentences, each normalised to lower-case ASCII words and other letters; known licence sentences become
identifiers, and the identifier sequence of a text is matched against ordered rules. A sentence begins and ends at the end
of a sentence or line, and may run over single newlines with their comment signs, so wrapped licences are found as well as
statements on a line of their own. Everything happens inside a row, so there is no shuffle, and a row's work is in
proportion to its text: a rule is one walk over the identifiers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import ascii_lower

# The sentences of public licences, normalised, with our identifiers. Where one sentence says what two
# identifiers stand for, it gives both. Short forms stand beside those that the licences have in full.
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
MIT_RIGHTS = " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
GNU_FREE = "is free software you can redistribute it and or modify it under the terms of the gnu"
GNU_FSF = "as published by the free software foundation"
GNU_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
SENTENCES = [
    ("mit.title", "mit license"),
    ("mit.title", "the mit license"),
    ("mit.title", "the mit license mit"),
    ("mit.release", "released under the mit license"),
    ("mit.grant", MIT_GRANT),
    ("mit.grant", MIT_GRANT + MIT_RIGHTS + " subject to the following conditions"),
    ("mit0.grant", MIT_GRANT + MIT_RIGHTS),
    ("mit.notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit.notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("mit.warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("mit.warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc.grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd.grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc.warranty", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("apache2.title", "apache license version 2 0 january 2004"),
    ("apache2.title", "apache license version 2 0 january 2004 http www apache org licenses"),
    ("apache2.terms", "terms and conditions for use reproduction and distribution"),
    ("apache2.licensed", "licensed under the apache license version 2 0"),
    ("apache2.licensed|apache2.comply", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache2.comply", "you may not use this file except in compliance with the license"),
    ("apache2.obtain", "you may obtain a copy of the license at"),
    ("apache2.warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl3.licensed", "this work is licensed under the gnu general public license version 3"),
    ("gpl3.title", "gnu general public license version 3 29 june 2007"),
    ("gpl2.title", "gnu general public license version 2 june 1991"),
    ("lgpl3.title", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl21.title", "gnu lesser general public license version 2 1 february 1999"),
    ("agpl3.title", "gnu affero general public license version 3 19 november 2007"),
    ("gnu.verbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl3.free", f"this program {GNU_FREE} general public license {GNU_FSF} either version 3 of the license or at your option any later version"),
    ("gpl2.free", f"this program {GNU_FREE} general public license {GNU_FSF} either version 2 of the license or at your option any later version"),
    ("gpl2only.free", f"this program {GNU_FREE} general public license version 2 {GNU_FSF}"),
    ("agpl3.free", f"this program {GNU_FREE} affero general public license {GNU_FSF} either version 3 of the license or at your option any later version"),
    ("lgpl21.free", f"this library {GNU_FREE} lesser general public license {GNU_FSF} either version 2 1 of the license or at your option any later version"),
    ("lgpl3.free", f"this library {GNU_FREE} lesser general public license {GNU_FSF} either version 3 of the license or at your option any later version"),
    ("gnu.hope", f"this program {GNU_HOPE}"),
    ("gnu.hope", f"this library {GNU_HOPE}"),
    ("gpl.received", "you should have received a copy of the gnu general public license along with this program"),
    ("agpl.received", "you should have received a copy of the gnu affero general public license along with this program"),
    ("lgpl.received", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("bsd.redistribute", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd.source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd.binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd.endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd.warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed"),
    ("bsd.warranty", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    # In "v. 2.0" the full stop ends the sentence.
    ("mpl2.subject", "this source code form is subject to the terms of the mozilla public license v"),
    ("mpl2.copy", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl2.copy", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("unlicense.domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense.anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib.warranty", "this software is provided as is without any express or implied warranty"),
    ("zlib.liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib.grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost.grant", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("boost.line", "distributed under the boost software license version 1 0"),
]
# Creative Commons licences (4.0): identifier, code, name, whether commercial use and changed works are allowed.
CREATIVE_COMMONS = [
    ("ccby4", "by", "attribution", True),
    ("ccbysa4", "by sa", "attribution sharealike", True),
    ("ccbynd4", "by nd", "attribution noderivatives", False),
    ("ccbync4", "by nc", "attribution noncommercial", False),
    ("ccbyncsa4", "by nc sa", "attribution noncommercial sharealike", False),
    ("ccbyncnd4", "by nc nd", "attribution noncommercial noderivatives", False),
]
# Licences named by SPDX tags, and whether they allow commercial use and closed derivatives.
TAGGED = [
    ("MIT", True), ("MIT-0", True), ("ISC", True), ("0BSD", True), ("Apache-2.0", True), ("BSD-2-Clause", True), ("BSD-3-Clause", True), ("MPL-2.0", False), ("Unlicense", True), ("Zlib", True),
    ("BSL-1.0", True), ("GPL-2.0-only", False), ("GPL-2.0-or-later", False), ("GPL-3.0-only", False), ("GPL-3.0-or-later", False), ("LGPL-2.1-only", False), ("LGPL-2.1-or-later", False),
    ("LGPL-3.0-only", False), ("LGPL-3.0-or-later", False), ("AGPL-3.0-only", False), ("AGPL-3.0-or-later", False), ("CC0-1.0", True),
]
# Rule, licence, whether commercial use and closed derivatives are allowed, and the sentences in order.
RULES = [
    ("mit-text", "MIT", True, ["mit.grant", "mit.notice", "mit.warranty"]),
    ("mit-0-text", "MIT-0", True, ["mit0.grant", "mit.warranty"]),
    ("isc-text", "ISC", True, ["isc.grant", "isc.warranty"]),
    ("0bsd-text", "0BSD", True, ["0bsd.grant", "isc.warranty"]),
    ("apache-2.0-text", "Apache-2.0", True, ["apache2.title", "apache2.terms"]),
    ("apache-2.0-notice", "Apache-2.0", True, ["apache2.licensed", "apache2.comply", "apache2.obtain", "apache2.warranty"]),
    ("gpl-3.0-text", "GPL-3.0", False, ["gpl3.title", "gnu.verbatim"]),
    ("gpl-2.0-text", "GPL-2.0", False, ["gpl2.title", "gnu.verbatim"]),
    ("lgpl-3.0-text", "LGPL-3.0", False, ["lgpl3.title", "gnu.verbatim"]),
    ("lgpl-2.1-text", "LGPL-2.1", False, ["lgpl21.title", "gnu.verbatim"]),
    ("agpl-3.0-text", "AGPL-3.0", False, ["agpl3.title", "gnu.verbatim"]),
    ("gpl-3.0-notice", "GPL-3.0", False, ["gpl3.free", "gnu.hope", "gpl.received"]),
    ("gpl-2.0-notice", "GPL-2.0", False, ["gpl2.free", "gnu.hope"]),
    ("gpl-2.0-only-notice", "GPL-2.0", False, ["gpl2only.free", "gnu.hope"]),
    ("agpl-3.0-notice", "AGPL-3.0", False, ["agpl3.free", "gnu.hope", "agpl.received"]),
    ("lgpl-2.1-notice", "LGPL-2.1", False, ["lgpl21.free", "gnu.hope"]),
    ("lgpl-3.0-notice", "LGPL-3.0", False, ["lgpl3.free", "gnu.hope"]),
    ("bsd-3-text", "BSD-3-Clause", True, ["bsd.redistribute", "bsd.endorse", "bsd.warranty"]),
    ("bsd-2-text", "BSD-2-Clause", True, ["bsd.redistribute", "bsd.warranty"]),
    ("mpl-2.0-notice", "MPL-2.0", False, ["mpl2.subject", "mpl2.copy"]),
    ("unlicense-text", "Unlicense", True, ["unlicense.domain", "unlicense.anyone"]),
    ("zlib-text", "Zlib", True, ["zlib.warranty", "zlib.liable", "zlib.grant"]),
    ("boost-text", "BSL-1.0", True, ["boost.grant"]),
    ("boost-line", "BSL-1.0", True, ["boost.line"]),
    ("mit-line", "MIT", True, ["mit.release"]),
    ("apache-2.0-line", "Apache-2.0", True, ["apache2.licensed"]),
    ("gpl-3.0-line", "GPL-3.0", False, ["gpl3.licensed"]),
]
#: A rule inside a longer rule that matched says nothing more.
WITHIN = {"bsd-2-text": "bsd-3-text", "apache-2.0-line": "apache-2.0-notice"}


def known_sentences() -> list[tuple[str, str]]:
    """All sentences: the fixed ones, those of Creative Commons, and SPDX tags."""
    out = list(SENTENCES)
    for key, code, name, _ in CREATIVE_COMMONS:
        out.append((f"{key}.licensed", f"licensed under cc {code} 4 0"))
        out += [(f"{key}.work", f"this work is licensed under {article} creative commons {name} 4 0 international license") for article in ("a", "the")]
    return out + [(f"spdx.{tag.lower()}", "spdx license identifier " + tag.lower().replace("-", " ").replace(".", " ")) for tag, _ in TAGGED]


def known_rules() -> list[tuple[str, str, bool, list[str]]]:
    """All rules, longer ones first."""
    out = list(RULES)
    for key, code, _, free in CREATIVE_COMMONS:
        licence = f"CC-{code.upper().replace(' ', '-')}-4.0"
        out += [(f"{licence.lower()}-{kind}", licence, free, [f"{key}.{said}"]) for kind, said in (("line", "licensed"), ("work", "work"))]
    return out + [(f"{tag.lower()}-tag", tag, free, [f"spdx.{tag.lower()}"]) for tag, free in TAGGED]


BREAK, NOT_WORD = r"[.!?]+[ \t\r\n]", r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _tree(sentences: list[str]) -> str:
    """A regular expression of the sentences as a tree of words: what begins alike is tried once, and longer ones before shorter."""
    tree: dict = {}
    for s in sentences:
        node = tree
        for word in s.split():
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        said = "|".join(word + after(child) for word, child in node.items() if word)
        return f"(?:{said})"

    def after(node: dict) -> str:
        if not any(node):
            return ""
        # A newline stands for one space of a sentence; the words are ASCII letters and digits.
        return f"(?:[ \n]{pattern(node)})" + ("?" if "" in node else "")

    return pattern(tree)


def sentence_ids(text: Column, sentences: list[tuple[str, str]]) -> Column:
    """The identifiers of a text's known sentences, in order; of sentences that overlap, the first, and of these the longest."""
    # A blank line and the end of a sentence are two newlines, which no sentence runs over.
    lines = F.regexp_replace(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, "\n\n"), NOT_WORD, " ")
    lines = F.trim(F.regexp_replace(lines, " ?\n ?", "\n"))
    known = "(?<![^\n])" + _tree([s for _, s in sentences]) + "(?![^\n])"
    names = F.create_map(*[F.lit(x) for i, s in sentences for x in (s, i)])
    found = F.transform(F.regexp_extract_all(lines, F.lit(known), F.lit(0)), lambda x: F.split(F.try_element_at(names, F.translate(x, "\n", " ")), "\\|"))
    return F.flatten(found)


def in_order(ids: Column, wanted: Column) -> Column:
    """Whether ``wanted`` are among the identifiers in this order; others may lie between. One walk, counting how many are met."""
    return F.aggregate(ids, F.lit(0), lambda n, x: F.when(F.get(wanted, n) == x, n + 1).otherwise(n)) == F.size(wanted)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences=None, rules=None) -> DataFrame:
    """One row for each document: id, n_sentences (known ones, repeats counted), sentence_ids and rules (comma-joined), licences (sorted, comma-joined), n_licences, restricted.

    ``restricted`` is true if some licence found bars commercial use or closed derivatives, false otherwise. Null and empty
    texts have no licence: empty strings, 0, false. Repeated rows and null ids stay as they are; an empty table gives an
    empty result; other columns are ignored.
    """
    sentences, rules = sentences or known_sentences(), rules or known_rules()
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), sentence_ids(F.col(f"`{text_col}`"), sentences).alias("ids"))
    # The rules are one constant, so the plan stays small; most documents have no known sentence, and no rule to walk.
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, ids)).alias("ids")) for name, _, _, ids in rules])
    hits = F.transform(F.filter(known, lambda rule: in_order(F.col("ids"), rule["ids"])), lambda rule: rule["name"])
    found = found.withColumn("hits", F.when(F.size("ids") > 0, hits).otherwise(F.array().cast("array<string>")))
    longer = F.create_map(*[F.lit(x) for pair in WITHIN.items() for x in pair])
    inside = lambda x: F.coalesce(F.array_contains("hits", F.try_element_at(longer, x)), F.lit(False))
    found = found.withColumn("rules", F.filter("hits", lambda x: ~inside(x)))
    licence = F.create_map(*[F.lit(x) for name, kind, *_ in rules for x in (name, kind)])
    barred = [name for name, _, free, _ in rules if not free]
    kinds = F.array_sort(F.array_distinct(F.transform("rules", lambda x: F.try_element_at(licence, x))))
    found = found.select("doc_id", "ids", "rules", kinds.alias("kinds"), F.exists("rules", lambda x: x.isin(barred)).alias("restricted"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join("rules", ",").alias("rules"),
        F.array_join("kinds", ",").alias("licences"), F.size("kinds").cast("long").alias("n_licences"), "restricted",
    )
