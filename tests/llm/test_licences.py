from gyre.llm.licences import licences

FILLER = "<p>words that say nothing at all</p>"


def page(text):
    return f"<html>{FILLER}<p>{text}</p>{FILLER}</html>"


def test_own_inherited_and_none(spark):
    mit, gpl, cc = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."
    rows = [
        (1, "https://h.org/a/LICENSE", page(mit)),
        (2, "https://h.org/a/b/page?x=1", page("plain")),
        (3, "http://h.org/a/own.html#top", page(gpl)),
        (4, "h.org/z/page", page("nothing")),
        (5, "k.org/d/one", page(cc)),
        (6, "k.org/d/two", page(cc)),
        (7, "k.org/d/e/three", "<p>the licence of this text is unknown to its readers and friends</p>"),
        (8, "m.org/d/one", page(cc)),
        (9, "m.org/d/two", page(gpl)),
        (10, "m.org/d/three", page("x")),
        (11, None, page(mit)),
        (12, None, None),
        (13, "h.org/a/b/page", ""),
        (2, "https://h.org/a/b/page?x=1", page("plain")),
        (14, "h.org", page("x")),
        (15, "h.org/a/b/c/", page("Licensed under the Apache License, Version 2.0.")),
        (16, "h.org/a/b/c/d", "w " * 50000),
    ]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, licence string, dir int")
    found = {r.page_id: (r.licence, r.basis, r.directory) for r in licences(table).collect()}
    assert found[1][:2] == ("MIT", "own") and found[3][:2] == ("GPL-3.0", "own") and found[11][:2] == ("MIT", "own")
    assert found[2] == found[13] == ("MIT", "inherited", "h.org/a/")
    assert found[7] == ("CC-BY-NC-4.0", "inherited", "k.org/d/") and found[16] == ("Apache-2.0", "inherited", "h.org/a/b/c/")
    assert all(found[i] == (None, "none", None) for i in (4, 10, 12, 14))
    assert licences(table).count() == len(rows) and licences(table.limit(0)).collect() == []


STATED = [
    ("MIT License", "MIT"), ("Licensed under the MIT License", "MIT"), ("This project is licensed under the MIT License.", "MIT"), ("SPDX-License-Identifier: MIT", "MIT"),
    ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("Copyright (c) 2020 Jane Doe. All rights reserved.", "Proprietary"), ("ISC License", "ISC"), ("BSD 2-Clause License", "BSD-2-Clause"),
    ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"), ("Licensed under CC BY-ND 4.0", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("GNU GPL, version 2 or later", "GPL-2.0-or-later"), ("GNU General Public License, version 2", "GPL-2.0"), ("GNU General Public License, version 3 or later", "GPL-3.0-or-later"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:", "MIT"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later"),
    ("Licensed under the Zebra Lion License", None), ("the licence fee for the concert hall was paid by friends", None), ("Licensed under CC BY-XX 4.0 terms of the zoo", None), ("public domain walks", None),
]


def test_statements_keep_their_licences_apart(spark):
    rows = [(i, f"https://s{i}.org/x", page(text)) for i, (text, _) in enumerate(STATED)]
    rows += [(1000 + i, f"https://f{i}.org/x", page(f"filler words number {i} under the version of this work")) for i in range(60)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.licence for r in licences(table).collect()}
    assert {STATED[i][0]: found[i] for i in range(len(STATED))} == dict(STATED)
