"""Licence notices as they are published, wrapped and with their marks."""

from __future__ import annotations

import re

import duckdb
import pandas as pd

from brindle.llm import license as LI

SCHEMA = "doc_id long, text string"
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
ISC = """Copyright (c) 2020, Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
APACHE = """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def scanned(spark, texts):
    rows = LI.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    return [(r["sentences"], r["licenses"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def test_published_notices(spark):
    comment = lambda t: "".join(f"# {x}".rstrip() + "\n" for x in t.split("\n"))
    gpl = ["gpl_free", "gpl_hope", "gpl_received"]
    want = [
        (GPL3, gpl, ["gpl-3.0-or-later"]),
        (GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;"), gpl, ["gpl-3.0-or-later"]),
        (MPL, ["mpl_terms"], ["mpl-2.0"]),
        (MIT, ["mit_released", "mit_grant", "mit_notice", "mit_warranty"], ["mit"]),
        (MIT.partition("\n\n")[2], ["mit_grant", "mit_notice", "mit_warranty"], ["mit"]),
        (ISC, ["isc_grant"], ["isc"]),
        (APACHE, ["apache_licensed", "apache_may_not", "apache_obtain", "apache_unless"], ["apache-2.0"]),
        (comment(GPL3), gpl, ["gpl-3.0-or-later"]),
        (comment(ISC), ["isc_grant"], ["isc"]),
        ("This program is free software: you can look at it.", [], []),
    ]
    assert scanned(spark, [t for t, *_ in want]) == [(s, found) for _, s, found in want]


def test_wrapped_and_doubly_spaced_notices_and_the_sql(spark):
    assert all(re.search(LI.NEEDLE, t) for texts in LI.SENTENCES.values() for t in texts) and not re.search(r"\s", LI.NEEDLE)
    texts = ["Copyright 2020 X. All rights\nreserved.", "All  rights  reserved.", "This is free and unencumbered software released into the public\ndomain.", "ALL RIGHTS-RESERVED", "rights"]
    got = scanned(spark, texts)
    assert [licenses for _, licenses in got] == [["all-rights-reserved"], ["all-rights-reserved"], ["unlicense"], ["all-rights-reserved"], []]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    theirs = con.execute(f"SELECT sentences, licenses FROM ({LI.license_sql()}) ORDER BY doc_id").fetchall()
    assert theirs == [(",".join(s), ",".join(x)) for s, x in got]
