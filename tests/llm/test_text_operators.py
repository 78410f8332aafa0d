"""HTML, chat, WARC, licences, decontamination and packing: small cases, round trips and brute force."""

import hashlib
import math
import random
import re
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import chat, decontaminate, html_text, licenses, packing, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")


def main_text(html):
    return "\n".join(t for t, _ in html_text.parse(html)[0])


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<p>a&nbsp; b\n c<br>d</p>", "a b c d"), ("<script>var t='</p>';</script><p>x", "x"),
    ("<body><nav><ul><li>m</ul></nav><article><h1>T</h1><p><b>T.<br><p>x</article><footer>f</footer>", "T\nT.\nx"), ("<!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<header>h</header><main><h1>T</h1><p>x</p><aside>s</aside><form>q</form><section id='comments'><p>c</p></section></main>", "T\nx"),
    ("<article><p>x</p></article><article class='comment'><p>c</p></article>", "x"), ("<div class='sidebar-left'>s</div><div>body</div>", "body"),
    ("<div class='cookieNotice'>s</div><p style='display:none'>h</p><p>b</p>", "b"), ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<p>cut &am", "cut &am"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<p>a<div class=ad>b</div>c</p>", "a\nc"), ("<p title='>'>q</p>", "q"),
])
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='content has-sidebar'><article><p>x</p></article></div>", "x"), ("<div id='page-no-comments'><p>x</p></div>", "x"), ("<div class='layout menu-open'><main><p>x</p></main></div>", "x"),
    ("<div class='with-cookie-notice'><div>x</div></div>", "x"), ("<div class='sidebar layout'><article><p>x</p><div class='share'>s</div></article><p>y</p></div>", "x"),
    ("<div class='menu wrap'><div itemprop='articleBody'><p>x</p></div></div>", "x"), ("<div class='page widget'><p>most of the text</p></div><div>z</div>", "most of the text\nz"),
    ("<main><p>x</p><div class='related'><article><p>teaser</p></article></div></main>", "x"), ("<article><p>x</p></article><div class='related'><article><p>teaser</p></article></div>", "x"),
    ("<div><p>a long text</p></div><div class='related'><article><p>teaser</p></article></div>", "a long text"), ("<div>a</div><div id='comments'><p>a long thread</p></div>", "a"),
    ("<article><p>x</p></article><div class='widget'><article><p>teaser</p></article></div>", "x"), ("<article><h1>T</h1><div class='entry share'><p>the body</p></div></article>", "T\nthe body"),
    ("<div class='menu menu-open'>m</div><div>body</div>", "body"), ("<div class='cookie'>we use cookies</div><div>b</div>", "b"),
])
def test_wrappers_named_as_furniture(html, text):
    assert main_text(html) == text


def test_template_is_counted_per_host(spark):
    page = lambda i: f"<div class='x1'><p>Part of the Example network</p></div><div><p>Story {i} is long enough to be the main text of its page, whatever stands around.</p></div>"
    rows = [(i, f"https://a.example/{i}", page(i), 0) for i in range(6)] + [(10, "https://b.example/", page(10), 0), (11, None, page(11), 0), (12, "https://a.example/x", None, 0), (12, "https://a.example/x", None, 0)]
    copies = [(20 + i, "https://c.example/", "<div><p>The same story on many pages of a host stays.</p></div>", 0) for i in range(9)]
    got = html_text.extract(spark.createDataFrame(rows + copies, "page_id long, url string, html string, host int")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 19 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i].startswith(f"Story {i}") for i in range(6))
    assert text[10].startswith("Part of") and text[11].startswith("Part of") and text[12] == ""
    assert all(text[20 + i].startswith("The same") for i in range(9))


def test_articles_and_copies_keep_their_text(spark):
    def text_of(pages):
        rows = [(i, "https://a.example/", p) for i, p in enumerate(pages)]
        return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}

    recipe = lambda i: f"<article><h1>Recipe {i}</h1><ul><li>2 eggs</li></ul><table><tr><td>Yes</td></tr></table><div>Serve</div><p>Story {i} goes on for a while.</p></article>"
    assert text_of([recipe(i) for i in range(8)]) == {i: f"Recipe {i}\n2 eggs\nYes\nServe\nStory {i} goes on for a while." for i in range(8)}
    copied = "<div>one</div><div>two</div><ul><li>six</li><li>ten</li></ul>"
    assert set(text_of([copied] * 9).values()) == {"one\ntwo\nsix\nten"}
    # On a host of 100 pages, 6 are no tenth and 20 are more.
    page = lambda i: f"<p>Story {i} is long enough to be the main text of its page.</p>" + "<div>rare</div>" * (i < 6) + "<div>often</div>" * (i >= 80)
    got = text_of([page(i) for i in range(100)])
    assert all(got[i].endswith("\nrare") for i in range(6)) and not any("often" in got[i] for i in range(80, 100))


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='header-fixed'><article><p>x</p></article></div>", "x"), ("<div class='related-work'><p>r</p></div><p>body of it</p>", "r\nbody of it"), ("<div class='related-posts'><p>r</p></div><p>body of it</p>", "body of it"),
    ("<div class='social-history'>s</div><p>body</p>", "s\nbody"), ("<div class='comments-policy'>s</div><p>body</p>", "s\nbody"), ("<div class='td-social-share'>s</div><p>body</p>", "body"), ("<div id='siteFooter'>s</div><p>body</p>", "body"),
    ("<h1>Title</h1><article><p>x</p></article>", "Title\nx"), ("<h1>Site</h1><article><h1>Title</h1><p>x</p></article>", "Title\nx"), ("<header><h1>Site</h1></header><article><p>x</p></article>", "x"),
    ("<h1>Site</h1><p>about</p><article><p>x</p></article>", "x"), ("<article><ul><li>a<li>b</ul><ol><li><ul><li>c</ul><li>d</ol></article>", "a\nb\nc\nd"),
])
def test_names_and_titles(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", [
    "<div>" * 50_000 + "text" + "</div>" * 50_000, "<b>" + "<div>" * 50_000 + "</b>" * 50_000 + "<li>" * 50_000 + "text", "<span>" * 50_000 + "text" + "</p>" * 50_000, "<div class='widget'>" * 20_000 + "<p>text" + "</div>" * 20_000,
    "<p>" + "<ul><li>" * 20_000 + "text", "<table><tr><td>" * 20_000 + "text",
])
def test_deep_nesting_costs_no_more_than_its_length(html):
    start = time.perf_counter()
    assert main_text(html) == "text"
    assert time.perf_counter() - start < 8


def test_long_pages_ties_and_clashing_columns(spark):
    long = "<p>" + "word " * 400_000 + "</p>"
    rows = [(1, "https://a.example/", long, "c", 3), (1, "https://a.example/", long, "c", 3), (None, None, "<p>x", "c", 3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, blocks int")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 1_999_999), ("1", 1_999_999), ("None", 1)]


def test_template_counts_against_brute_force(spark):
    """Random pages of known boxes around a story: a box goes where it stands on enough different stories of its host."""
    rnd = random.Random(4)
    boxes = [f"<div class=b{k}>Box number {k}</div>" for k in range(8)]
    rows, parts = [], []
    for i in range(240):
        host, story = rnd.choice("ab"), rnd.randrange(60)
        have = [k for k in range(8) if rnd.random() < (0.02, 0.04, 0.06, 0.1, 0.15, 0.3, 0.6, 0.9)[k]]
        parts.append((host, story, have))
        rows.append((i, f"https://{host}.example/{i}", "".join(boxes[k] for k in have) + f"<p>Story {story} " + "of this host and what it says " * 12 + "</p>"))
    mains = lambda h: {(s, *have) for x, s, have in parts if x == h}
    gone = {(h, k) for h in "ab" for k in range(8) if (n := sum(k in m[1:] for m in mains(h))) >= 5 and n >= 0.1 * len(mains(h))}
    want = {i: [f"Box number {k}" for k in have if (h, k) not in gone] + [f"Story {s} " + ("of this host and what it says " * 12).strip()] for i, (h, s, have) in enumerate(parts)}
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"].split("\n") for r in got} == want
    assert 4 < len(gone) < 14


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(none).count() == 0
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double, path string, leaf long, t int")


def test_best_path_of_a_tree(spark):
    nodes = tree(spark, [(1, 1, None, "user", "q", 0.0, "", 0, 0), (1, 2, 1, "assistant", "bad", 0.1, "", 0, 0), (1, 3, 1, "assistant", "good", 0.9, "", 0, 0), (1, 4, 3, "user", "more", 0.5, "", 0, 0), (2, 1, 9, "user", None, None, "", 0, 0), (3, 1, 2, "user", "cycle", 0.0, "", 0, 0), (3, 2, 1, "user", "cycle", 0.0, "", 0, 0)])
    best = {r["tree_id"]: chat.parse(r["formatted"]) for r in chat.conversations(nodes.drop("path", "leaf", "t")).collect()}
    assert best == {1: [("user", "q"), ("assistant", "good"), ("user", "more")], 2: [("user", "")]}
    two = chat.conversations(nodes, top_paths=2).filter("tree_id = 1").orderBy("rank").collect()
    assert [chat.parse(r["formatted"])[-1][1] for r in two] == ["more", "bad"]


def test_paths_against_brute_force(spark):
    """Random trees, deep and wide, some with cycles or missing parents: the chosen paths are those of a walk from every leaf."""
    rnd = random.Random(8)
    rows = []
    for t in [*range(12), None]:
        n = rnd.choice([1, 2, 7, 40, 90])
        for i in range(n):
            parent = None if i == 0 else rnd.randrange(max(0, i - 2), i) if rnd.random() < 0.7 else rnd.randrange(i)
            rows.append((t, i, 999 if rnd.random() < 0.03 else parent, "user", f"text {i}", rnd.choice([None, 0.0, 0.25, 0.5, 1.0])))
    rows += [(50, i, (i + 1) % 5, "user", "cycle", 1.0) for i in range(5)] + [(50, 9, 2, "user", "on a cycle", 1.0)]
    got = {}
    for r in chat.paths(spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double"), top_paths=3).collect():
        got.setdefault((r["tree_id"], r["rank"]), {})[r["up"]] = r["node_id"]
    want = {}
    for t in {r[0] for r in rows}:
        parent = {i: p for tt, i, p, *_ in rows if tt == t}
        score = {i: s or 0.0 for tt, i, *_, s in rows if tt == t}
        found = []
        for leaf in parent.keys() - {p for p in parent.values() if p in parent}:
            path = [leaf]
            while parent[path[-1]] in parent and len(path) <= len(parent):
                path.append(parent[path[-1]])
            if len(path) <= len(parent):
                found.append((-sum(score[x] for x in path) / len(path), -len(path), leaf, path))
        want |= {(t, k + 1): dict(enumerate(x[3])) for k, x in enumerate(sorted(found)[:3])}
    assert got == want


def test_conversation_of_many_turns(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(6000)] + [(None, 0, None, None)]
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.conversations(chat.chain(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))).collect()}
    assert got == {1: (6000, sum(len(f"turn {i}") for i in range(1, 6000, 2))), None: (1, 0)}


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "</turn>", "\\", "\\\\</turn>\n### user:\n", "a:\nb", "", "é\u2028\x00", "#" * 7])
def test_template_is_reversible(spark, text):
    nodes = tree(spark, [(1, 1, None, text, text, 0.0, "", 0, 0), (1, 2, 1, "assistant", text, 0.0, "", 0, 0), (1, 3, 2, "assistant", "z" + text, 0.0, "", 0, 0)]).drop("path", "leaf", "t")
    got = chat.conversations(nodes)
    assert chat.parse(got.first()["formatted"]) == [(text, text), ("assistant", text), ("assistant", "z" + text)]
    back = chat.read_back(got).first()
    assert back["loss_chars"] == 2 * len(text) + 1 and back["loss_sha256"] == hashlib.sha256((text + "z" + text).encode()).hexdigest()


def test_long_and_messy_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(100)] + [(2, 0, None, None), (2, 0, None, None), (None, 1, "user", "x"), (3, None, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.conversations(chat.chain(df))).collect()}
    assert got == {1: 100, 2: 2, None: 1, 3: 1}
    assert chat.read_back(chat.conversations(chat.chain(df.limit(0)))).count() == 0


@pytest.mark.parametrize("split_bytes", [37, 1000, 1 << 22])
def test_archives_round_trip(spark, split_bytes):
    rnd = random.Random(5)
    texts = ["", None, "x", "x", "é" * 50, "WARC/1.1\r\n\r\n"] + ["".join(rnd.choice("abc \n<>") for _ in range(rnd.randrange(4000))) for _ in range(40)]
    rows = [(i, f"http://h/{i}\r\nX: y", t, "c", 1) for i, t in enumerate(texts)] + [(2, "again", "x", "c", 1), (None, None, "x", "c", 1), (None, None, "q", "c", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, n_bytes int")
    got = warc.read_archives(warc.write_archives(pages), split_bytes=split_bytes).collect()
    first = {}
    for i, _, t, _, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t, _, _ in rows:
        body, to = (t or "").encode(), first.get(t or "")
        again = to is not None and to != i
        want.append((i, len(body), warc.payload_digest(body), "revisit" if again else "response", to if again else None, None if again else body))
    key = lambda r: tuple(map(str, r))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=key) == sorted(want, key=key)


def test_archives_of_very_long_pages(spark):
    long = "<p>" + "\x1f\x8b\x08 é" * 700_000
    pages = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "short"), (4, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages.coalesce(1)), split_bytes=5_000).collect()}
    assert bytes(got[1]["payload"]) == long.encode() and (got[2]["record_type"], got[2]["refers_to"], got[2]["payload_bytes"]) == ("revisit", 1, len(long.encode()))
    assert bytes(got[3]["payload"]) == b"short" and got[4]["payload_bytes"] == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction. Other words. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
    turned = ". ".join(reversed(mit.split(". ")))
    rows = [(1, "Text.\nReleased under the MIT License.\nMore"), (2, mit), (3, turned), (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0!"), (6, "x" * 200000), (7, "Not Released under the MIT License.")]
    got = sorted((r["doc_id"], r["licences"], r["restricted"]) for r in licenses.scan(spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, ids int, seq string")).collect())
    assert got == [(1, "MIT", False), (2, "MIT", False), (3, "", False), (4, "", False), (5, "", False), (6, "", False), (6, "Apache-2.0,CC-BY-NC-4.0", True), (7, "", False)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
@
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES."""
BSD3 = BSD2.replace("@", """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""")


@pytest.mark.parametrize("wrap", [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */", lambda t: "\n".join(f"# {x}" for x in t.split("\n")), lambda t: "Words before\n\n" + t + "\n\nand after"])
def test_licences_in_full(spark, wrap):
    texts = [MIT, APACHE, GPL, BSD2.replace("@", ""), BSD3, MIT.replace("free of charge", "for a charge"), "Released under\n\nthe MIT License."]
    got = {r["doc_id"]: (r["rules"], r["licences"]) for r in licenses.scan(spark.createDataFrame([(i, wrap(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {0: ("mit-text", "MIT"), 1: ("apache-2.0-notice", "Apache-2.0"), 2: ("gpl-3.0-notice", "GPL-3.0"), 3: ("bsd-2-text", "BSD-2-Clause"), 4: ("bsd-3-text", "BSD-3-Clause"), 5: ("", ""), 6: ("", "")}


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
MORE = {
    "ISC": ISC, "MPL-2.0": MPL, "LGPL-2.1": LGPL, "Unlicense": UNLICENSE, "Zlib": ZLIB,
    "AGPL-3.0": GPL.replace("General Public License", "Affero General Public License").replace("the GNU General", "the GNU Affero General"),
    "GPL-2.0": GPL.replace("version 3", "version 2"),
    "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only\nint x;",
    "Apache-2.0": "/* SPDX-License-Identifier: Apache-2.0 */",
    "CC-BY-NC-ND-4.0": "Text. Licensed under CC BY-NC-ND 4.0. More text.",
}


def test_more_licences(spark):
    rows = list(MORE.items()) + [("", MPL.replace("Mozilla", "Other")), ("", "SPDX-License-Identifier: Apache-2.0 or later"), ("", ISC.split("THE")[0])]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licences"] for r in got} == {i: name for i, (name, _) in enumerate(rows)}
    assert {rows[r["doc_id"]][0] for r in got if r["restricted"]} == {"MPL-2.0", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "CC-BY-NC-ND-4.0"}


def test_licence_rules_against_sql(spark, tmp_path):
    """The operator and the joins of the SQL over all licence texts, wrapped and in comments, whole, cut and mixed."""
    import duckdb
    from quillmesh.llm import queries

    rnd = random.Random(5)
    texts = [MIT, APACHE, GPL, BSD2.replace("@", ""), BSD3, *MORE.values()]
    rows = [(i, t) for i, t in enumerate(texts + ["\n".join(f" * {x}" for x in t.split("\n")) for t in texts] + [" ".join(t.split()) for t in texts])]
    for k in range(60):
        lines = [x for t in rnd.sample(texts, 3) for x in t.split("\n")]
        rows.append((1000 + k, "\n".join(x for x in lines if rnd.random() < 0.97)))
    rows += [(2000, None), (2001, ""), (2002, "MIT License\nMIT License\nThe MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    names = ["doc_id", "n_sentences", "sentence_ids", "rules", "licences", "n_licences", "restricted"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.op10_sql()})").fetchall()
    got = [tuple(r) for r in licenses.scan(docs).select(*names).collect()]
    assert sorted(got) == sorted(want) and sum(bool(r[3]) for r in got) > 60


def test_licence_walk_is_linear(spark):
    """Thousands of repeats of a rule without its last sentence; null ids."""
    part = "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
    docs = spark.createDataFrame([(1, part * 3000), (None, part * 10)], "doc_id long, text string")
    licenses.scan(docs.limit(0)).collect()
    start = time.perf_counter()
    got = {r["doc_id"]: (r["n_sentences"], r["rules"]) for r in licenses.scan(docs).collect()}
    assert got == {1: (9000, "apache-2.0-line"), None: (30, "apache-2.0-line")}
    assert time.perf_counter() - start < 20


def windows(item, size=10):
    return {tuple(item[i : i + min(size, len(item))]) for i in range(max(1, len(item) - size + 1))} if item else set()


def brute_hits(ws, items):
    hit, found = set(), set()
    for k, item in items:
        for win in windows(item):
            for i in range(len(ws) - len(win) + 1):
                if tuple(ws[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(k)
    return hit, found


@pytest.mark.parametrize("seed", range(6))
def test_automaton_is_exact(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice([b"a", b"b", b"c"])
    items = [(k, [word() for _ in range(rnd.choice([0, 1, 3, 7, 10, 11, 30]))]) for k in range(8)]
    items.append((99, items[-1][1]))
    built = decontaminate.Automaton(items, 10)
    for _ in range(40):
        ws = [word() if rnd.random() < 0.95 else b"z" for _ in range(rnd.randrange(60))]
        if rnd.random() < 0.7 and items[6][1]:
            ws[5:5] = items[rnd.randrange(8)][1]
        spans, found = built.scan(ws)
        assert ({i for a, b in spans for i in range(a, b)}, found) == brute_hits(ws, items)


def test_decontamination(spark):
    item = " ".join(f"word{i}" for i in range(15))
    benchmark = spark.createDataFrame([(1, item), (2, "short one"), (3, None), (4, "")], "item_id long, text string")
    clean = "nothing to see here, Move on."
    rows = [(1, clean), (2, f"before {item} after and some more words that stay as they are, so most of it is clean enough"), (3, item), (4, None), (5, ""), (5, "A SHORT, one!")]
    docs = spark.createDataFrame([(i, t, 7, len(t or ""), "c") for i, t in rows], "doc_id long, text string, spans int, n_chars long, items string")
    for block_words in (200_000, 3):
        got = decontaminate.digest(decontaminate.matches(docs, benchmark, block_words=block_words)).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in got) == [(1, 6, 0, 0), (2, 33, 15, 1), (3, 15, 15, 1), (4, 0, 0, 0), (5, 0, 0, 0), (5, 3, 2, 1)]
        assert {r["items_sha256"] for r in got if r["doc_id"] == 2} == {hashlib.sha256(b"1").hexdigest()}
        left = decontaminate.decontaminate(docs, benchmark, length_col="n_chars", block_words=block_words)
        assert left.columns == docs.columns
        text = {(r["doc_id"], r["text"]): r["n_chars"] for r in left.collect()}
        cut = "before  after and some more words that stay as they are, so most of it is clean enough"
        assert text == {(1, clean): len(clean), (2, cut): len(cut), (4, None): 0, (5, ""): 0}
    assert decontaminate.matches(docs, benchmark.limit(0)).filter("size(items) > 0").count() == 0
    assert decontaminate.matches(docs.limit(0), benchmark).count() == 0


def test_blocks_of_items_change_nothing(spark):
    """String ids, a long text, repeated rows: one automaton or many give the same rows, and those of brute force."""
    rnd = random.Random(9)
    text = lambda n: " ".join(rnd.choice("abcdef") for _ in range(n))
    items = [(f"item-{k}", text(rnd.choice([2, 9, 10, 14, 30]))) for k in range(12)] + [("item-0", text(11)), (None, text(12))]
    docs = [(i, text(rnd.randrange(0, 40)) + " " + rnd.choice(items)[1] + " " + text(60)) for i in range(40)]
    docs += [docs[3], docs[3], (99, text(3000)), (None, items[4][1])]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    coded = [(k, t.encode().split()) for k, t in items]
    want = []
    for i, t in docs:
        hit, found = brute_hits(t.encode().split(), coded)
        listed = ",".join(sorted(k for k in found if k is not None))
        want.append((i, len(t.split()), len(hit), len(found - {None}), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    cleaned = []
    for block_words in (200_000, 40):
        got = decontaminate.digest(decontaminate.matches(*frames, block_words=block_words)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        left = decontaminate.decontaminate(*frames, block_words=block_words, max_coverage=0.8).collect()
        cleaned.append(sorted(map(tuple, left), key=str))
        assert not any(brute_hits(r["text"].encode().split(), coded)[0] for r in left)
    assert cleaned[0] == cleaned[1]


def test_encoder_gives_the_ids_of_the_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["<|endoftext|> x", "a <|endoftext|>  <|endoftext|>", "<|endoftext", "<|ENDOFTEXT|>", "  a\n\n b\t", "l'été d'İ ßﬁ 漢字🙂\u00a0x", "a" * 3000, "\x00\r\n"]
    fast = packing.encoder(BPE)
    assert [fast(t) for t in texts] == [own.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("options", [{}, {"window": 64, "open_windows": 3, "min_cut": 8, "merge_tokens": 500}])
def test_packing(spark, sf, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80).select("doc_id", "text").unionByName(spark.createDataFrame([(100001, None), (100002, ""), (100003, "x y " * 20000)], "doc_id long, text string"))
    docs = docs.withColumn("offset", F.lit("clash")).repartition(3)
    size = options.get("window", 2048)
    pieces = packing.pack(docs, BPE, with_ids=True, **options).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p["ids"])) == p["ids_crc32"] and len(p["ids"]) == p["length"] > 0
    fast = packing.encoder(BPE)
    for r in docs.collect():
        ids = [i for p in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]) for i in p["ids"]]
        assert ids == [*fast(r["text"] or ""), 1] and {p["doc_tokens"] for p in by_doc[r["doc_id"]]} == {len(ids)}
    total = 0
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        total += at
    assert total / (size * len(by_seq)) > 0.9 or math.isclose(total, size)
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_packing_of_ties_repeated_rows_and_null_ids(spark):
    """Each row's ids lie in one piece each, whatever repeats; equal lengths and ids give no clash."""
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, "<|endoftext|> x"), (3, "x y z"), (3, "other words of the same id")] + [(10 + i, "tie tie") for i in range(40)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), BPE, with_ids=True, window=16, open_windows=2, min_cut=4, merge_tokens=64).collect()
    fast, got, want = packing.encoder(BPE), {}, {}
    for i, t in rows:
        ids = [*fast(t or ""), 1]
        want.setdefault(i, []).extend((k, x) for k, x in enumerate(ids))
    for p in pieces:
        got.setdefault(p["doc_id"], []).extend((p["start"] + k, x) for k, x in enumerate(p["ids"]))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    filled = {}
    for p in pieces:
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for seq in filled.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 16


def test_words_are_those_of_the_contract():
    text = "Ab1-É,ß\u00a0x_y\x00Z"
    assert [w.decode() for w in decontaminate.words(text)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><p>Hello <button>Share</button> world.</p></article>", "Hello world."),
        ("<p>A <span hidden>secret</span> B</p>", "A B"),
        ('<p>A <span style="display:none">x</span>B</p>', "A B"),
        ('<p>A<span class="ad">buy</span> B</p>', "A B"),
        ('<p>A <a class="share">s</a> B</p>', "A B"),
        ("<p>A <svg><text>q</text></svg> B</p>", "A B"),
        ("<p>A <audio>x</audio> <object>y</object> B</p>", "A B"),
        ("<p>A <select><option>o1</option><option>o2</option></select> B</p>", "A B"),
        ("<p>Hello <span hidden>secret</p><p>more</p>", "Hello\nmore"),
        ("<ul><li>a<li>b <button><div>no</div></button> c</ul>", "a\nb c"),
        ('<p>The <span class="commentary">commentary</span> stays.</p>', "The commentary stays."),
        ('<div class="post comments-enabled"><p>Text.</p></div>', "Text."),
        *[(f'<p>Text of the page.</p><div class="{c}">Nice one!</div>', "Text of the page.") for c in ("reader-comments", "user-comments", "comments-wrapper-dark", "comment-body", "commentText", "commentlist", "UserComments", "feedback", "adsbygoogle")],
    ],
)
def test_furniture_inside_a_line(html, want):
    assert "\n".join(t for t, _ in html_text.parse(html)[0]) == want


def test_extraction_of_random_trees():
    """Elements that stay and go, blocks and inline ones, nested at random, against the rules read off the tree."""
    rng = random.Random(4)
    stay = [("div", True), ("section", True), ("span", False), ("b", False), ('a href="x"', False), ('span class="big"', False)]
    go = [("nav", True), ("aside", True), ("form", True), ("div hidden", True), ('div role="search"', True), ("button", False), ("span hidden", False), ('i style="display: none"', False), ("select", False), ("svg", False)]

    def tree(depth, dropped, inline, lines):
        """HTML of a tree; ``lines`` gets the text of each block as it goes on."""
        out = []
        for _ in range(rng.randrange(1, 5)):
            if depth == 0 or rng.random() < 0.4:
                text = rng.choice(["word", " two words ", "&amp;", "\n", "x  y", " "])
                out.append(text)
                if not dropped:
                    lines[-1] += text.replace("&amp;", "&")
                continue
            gone = rng.random() < 0.3
            tag, block = rng.choice(go if gone else stay)
            within = inline or (dropped is False and gone and not block)
            breaks = block and not (inline and dropped)
            if breaks:
                lines.append("")
            inner = tree(depth - 1, dropped or gone, within, lines)
            if breaks:
                lines.append("")
            out.append(f"<{tag}>{inner}</{tag.split()[0]}>")
        return "".join(out)

    for _ in range(400):
        lines = [""]
        html = tree(4, False, False, lines)
        want = [x for x in (" ".join(line.split()) for line in lines) if x]
        assert [t for t, _ in html_text.parse(html)[0]] == want, html
