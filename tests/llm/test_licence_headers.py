"""Licence headers as they are written: wrapped, unwrapped, in comments; each gives its one licence, in operator and twin."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tidemark.llm import licenses
from tools.compare import compare

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def fsf(what, licence, version):
    return f"""This {what} is free software; you can redistribute it and/or modify
it under the terms of the GNU {licence} as published by
the Free Software Foundation; either version {version} of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {licence} for more details."""


def fsf3(licence):
    return fsf("program", licence, 3).replace("software; you", "software: you").replace("Foundation; either", "Foundation, either")


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
TEXTS = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD2, "BSD-3-Clause": BSD3, "GPL-2.0-or-later": fsf("program", "General Public License", 2),
    "LGPL-2.1-or-later": fsf("library", "Lesser General Public License", "2.1"), "GPL-3.0-or-later": fsf3("General Public License"),
    "LGPL-3.0-or-later": fsf3("Lesser General Public License"), "AGPL-3.0-or-later": fsf3("Affero General Public License"), "MPL-2.0": MPL, "EPL-2.0": EPL,
}
HEAD = "Copyright (c) 2020 Foo Bar"


def written_ways(text):
    lines = [HEAD, "", *text.split("\n")]
    code = "\n\nint main() { return 0; }\n"
    yield "\n".join(lines)
    yield f"{HEAD}\n{text}"                                         # no empty line in between
    yield " ".join(text.split("\n"))                                # not wrapped
    yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */" + code
    yield "\n".join(f"# {x}".rstrip() for x in lines) + code
    yield "\n".join(f"// {x}".rstrip() for x in lines) + code
    yield "\n".join(f"#  {x}" for x in [HEAD, *text.split("\n")]) + code
    yield "<!--\n" + "\n".join(lines) + "\n-->\n<p>software</p>"


def test_each_header_gives_its_licence(spark):
    rows, want = [], {}
    for name, text in TEXTS.items():
        for way in written_ways(text):
            want[len(rows)] = name
            rows.append((len(rows), way))
    two = [(900, f"{APACHE}\n\n---\n\n{BSD3}"), (901, f"{MIT}\n{MIT}"), (902, "MIT License\n\n" + MIT), (903, "the software\n" * 3000 + HEAD), (904, None),
           (905, "See the License.\nPermission is hereby granted"), (906, BSD2.replace("binary form", "any form"))]
    d = spark.createDataFrame(rows + two, "doc_id long, text string")
    out = licenses.scan(d)
    got = {r.doc_id: r.licenses for r in out.collect()}
    assert {i: got[i] for i in want} == {i: [n] for i, n in want.items()}
    assert [got[i] for i in range(900, 907)] == [["Apache-2.0", "BSD-3-Clause"], ["MIT"], ["MIT"], [], [], [], []]
    duck = duckdb.connect()
    duck.register("lic", pd.DataFrame(rows + two, columns=["doc_id", "text"]))
    flat = out.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_license_sentences"), F.array_join("licenses", ",").alias("licenses"))
    assert compare(flat.toPandas(), duck.sql(licenses.sql("lic")).df()) == "ok"


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(spark.createDataFrame([(1, MIT)], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
