import itertools
import re

import pytest

from ruleflow.llm import license_scan as scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""


def licences(text):
    return [name for name, _, _ in scan.recognise(scan.identified(text))[0]]


@pytest.mark.parametrize(("text", "names"), [
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Some words.\nReleased under the MIT License.\nMore.", ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3"]),
    ("a\nLicensed under the Apache License, Version 2.0.\nb", ["Apache-2.0"]), (MIT, ["MIT"]), (MIT + "\n\nLicensed under CC BY 4.0", ["MIT", "CC-BY-4.0"]),
    ("We licensed under no terms the license.", []), ("Licensed under the\nApache License, Version 2.0", ["Apache-2.0"]),
    ("Licensed under the MIT License and more.", []), ("licensed under cc by 4.0! licensed under cc by 4.0?", ["CC-BY-4.0"] * 2),
    ("", []), ("\n.\n", []), ("All rights reserved.", []),
])
def test_licences_of_texts(text, names):
    assert licences(text) == names


def test_rules_are_tried_in_order_and_need_adjacent_sentences():
    free = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    hope = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    see = "See the GNU General Public License for more details."
    assert scan.recognise(scan.identified(f"{free} {hope} {see}")) == ([("GPL-2-or-later", 0, 5)], [])
    licences_found, unresolved = scan.recognise(scan.identified(f"{free} Something else. {hope} {see}"))
    assert [n for n, _, _ in licences_found] == ["GPL-2-or-later"] and unresolved == ["gpl-hope", "gpl-see"]


def slow_identified(text):
    """Every run of sentences against every known sentence as an expression."""
    parts = [p for p in re.split(r"[.!?;:](?=\s|$)|\n", text) if scan.WORD.search(p)]
    found, i = [], 0
    while i < len(parts):
        ends = []
        for j in range(i, min(len(parts), i + 80)):
            joined = " ".join(scan.WORD.findall(" ".join(parts[i : j + 1]).lower()))
            for known, name in scan.KNOWN.items():
                m = re.fullmatch(re.escape(known).replace(r"\{v\}", r"(\d+(?:\.\d+)*)"), joined)
                if m:
                    ends.append((i, j, name, m[1] if m.groups() else None))
        if ends:
            found.append(ends[-1])
            i = ends[-1][1]
        i += 1
    return found


def test_sentences_equal_trying_all():
    pieces = ["Licensed under CC BY 4.0.", "words here", "the\n", "Licensed under\n", "the MIT License.", MIT, "v. 2.0", "All rights reserved!", "\n\n", "Licensed"]
    for combination in itertools.product(pieces, repeat=3):
        text = " ".join(combination)
        assert scan.identified(text) == slow_identified(text)


def test_hint_is_in_every_known_sentence():
    assert all(scan.HINT.search(text.replace("{v}", "1")) or text.startswith("licensed under cc") for text in scan.KNOWN)
    assert all(scan.HINT.search(text) for text in scan.KNOWN)


def test_rows(spark):
    rows = [(1, MIT, "x"), (2, None, None), (None, "Licensed under CC BY-SA 4.0.", "y"), (1, MIT, "x"), (3, "", ""), (4, "word. " * 20000 + "All rights reserved", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = sorted(map(tuple, scan.scan(docs).collect()), key=str)
    assert got == sorted(
        [(1, "MIT", "MIT:0:10", 1, ""), (1, "MIT", "MIT:0:10", 1, ""), (2, "", "", 0, ""), (None, "CC-BY-SA-4.0", "CC-BY-SA-4.0:0:0", 1, ""), (3, "", "", 0, ""), (4, "", "", 0, "reserved")],
        key=str,
    )
    assert scan.scan(docs.limit(0)).count() == 0


APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
BSD_2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize(("text", "name"), [
    (APACHE, "Apache-2.0"), (APACHE.replace("\n   ", "\n# "), "Apache-2.0"), (APACHE.replace("at\n\n      ", "at"), "Apache-2.0"),
    (BSD_2, "BSD-2-Clause"), (BSD_3, "BSD-3-Clause"), (BSD_3.replace("\n", "\n * "), "BSD-3-Clause"),
])
def test_standard_texts(spark, text, name):
    docs = spark.createDataFrame([(1, f"Copyright (c) 2020, Somebody\n\n{text}\nmore")], "doc_id long, text string")
    found = scan.scan(docs).first()
    assert (found.licences, found.n_matches, found.unresolved) == (name, 1, "")


def test_only_addresses_and_list_numbers_keep_sentences_together():
    text = BSD_2.replace("2. Redist", "2. Something else. Redist")
    assert [n for n, _, _ in scan.recognise(scan.identified(text), scan.empty_sentences(text))[0]] == []
    assert licences("GNU\nLicensed under the GNU General Public License version\n3.") == ["GPL-3"]
