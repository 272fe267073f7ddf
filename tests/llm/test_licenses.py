import textwrap

import duckdb

from wardline.llm import licenses

from .conftest import HARD


def test_op3_equals_sql(spark, sf_dir):
    got = sorted(map(tuple, licenses.op3_sentence_rules(spark, sf_dir).collect()), key=str)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(licenses.oracle_sql()).fetchall(), key=str)
    assert any(r[2] for r in got)


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_rules_take_their_sentences_in_order(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); '
    head = 'Licensed under the Apache License,\tVersion 2.0 (the "License").'
    rest = "You may not use this file except in compliance with the License. You may obtain a copy of the License at:"
    got = scan(
        spark,
        f"{head} {rest} Elsewhere",
        "You may obtain a copy of the License at: Licensed under the Apache License, Version 2.0!",
        "Released under the MIT License. All rights reserved.",
        "Released under the MIT License.\nIn between.\nALL RIGHTS   RESERVED",
        apache,
        "unlicensed text without any known sentence",
        "Some words of prose without an end\nLicensed under CC BY-NC 4.0.\nmore words",
    )
    assert got[0][1:] == ("Apache-2.0", 3, 0)
    assert got[1] == ("apache_obtain,names_apache_2_0", "Apache-2.0", 2, 1)
    assert got[2][1] == "MIT AND Proprietary"
    assert got[3] == ("names_mit,all_rights", "MIT,Proprietary", 2, 0)
    assert got[4] == ("apache_named", "Apache-2.0", 1, 0)
    assert got[5] == ("", "", 0, 0)
    assert got[6] == ("names_cc_by_nc_4_0", "CC-BY-NC-4.0", 1, 0)


#: Texts of licences as they are published: copyright lines and holders are made up.
MIT = """MIT License

Copyright (c) 2019 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
BSD3 = """Copyright (c) 2001-2003, The Owners
All rights given below are reserved to them.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the Owners nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
APACHE = """Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
GPL3 = """Widget, a thing. Copyright (C) 2021 Someone

Widget is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

Widget is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with Widget. If not, see <https://www.gnu.org/licenses/>.
"""
LGPL21 = GPL3.replace("General Public", "Lesser General Public").replace("version 3", "version 2.1").replace("Widget", "This library")
ISC = """Copyright (c) 2004 by Someone

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
"""
WHOLE = {"MIT": MIT, "BSD-3-Clause": BSD3, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "LGPL-2.1-or-later": LGPL21, "ISC": ISC, "MPL-2.0": MPL2, "Unlicense": UNLICENSE}


def wrapped(text, mark=""):
    """Lines of up to 72 characters, after a mark of comments."""
    out = []
    for line in text.split("\n"):
        parts = textwrap.wrap(line, 72) or [""]
        out += [f"{mark}{x}".rstrip() for x in parts]
    return "\n".join(out)


def test_published_texts_are_recognised_wrapped_or_not(spark):
    for shape in (str, wrapped, lambda t: wrapped(t, "// "), lambda t: wrapped(t, " * "), lambda t: wrapped(t, "# "), lambda t: wrapped(t).replace("\n", "\r\n")):
        got = scan(spark, *[f"Prose before.\n\n{shape(t)}\n\nProse after, without a licence.\n" for t in WHOLE.values()])
        for name, (_, licences, n_known, n_unmatched) in zip(WHOLE, got, strict=True):
            assert (licences, n_unmatched) == (name, 0), (name, licences, n_known, n_unmatched)
    assert [x[2] for x in got] == [4, 6, 5, 5, 5, 3, 2, 2]
    without = BSD3.replace(BSD3[BSD3.index("3. Neither") : BSD3.index("THIS SOFTWARE IS")], "")
    assert scan(spark, wrapped(without))[0][1] == "BSD-2-Clause"


def test_statements_and_several_licences_in_one_text(spark):
    got = scan(spark, f"{MIT}\n{wrapped(APACHE)}\nThis project is licensed under the BSD 3-Clause License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Distributed under the terms of the GNU General Public License v3.0")
    assert set(got[0][1].split(",")) == {"MIT", "Apache-2.0", "BSD-3-Clause"}
    assert got[1][1] == "CC-BY-SA-4.0" and got[2][1] == "GPL-3.0-only"


def test_sql_on_published_texts(spark):
    texts = [f(t) for t in WHOLE.values() for f in (str, wrapped, lambda t: wrapped(t, "# "))] + ["Released under the MIT License. All rights reserved.", None, "", "\x01 licensed\x01", "1. a) licence\n\n\n* permission"]
    got = [(i, *r) for i, r in enumerate(scan(spark, *texts))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert got == sorted(con.sql(licenses.oracle_sql()).fetchall())


def test_every_known_sentence_is_read_by_itself(spark):
    """A text of one sentence is read whatever its words are."""
    alone = ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", "This notice may not be removed or altered from any source distribution."]
    got = scan(spark, *alone, *[t for _, t in licenses.SENTENCES], "This project is licensed under the MIT License, Copyright 2020 A. Person")
    assert [x[0] for x in got[:2]] == ["zlib_origin", "zlib_notice"]
    assert all(x[2] == 1 for x in got) and got[-1][1] == "MIT"


def test_hard_rows(spark, hard):
    rows = licenses.scan_licenses(hard).collect()
    assert len(rows) == len(HARD) and all(tuple(r)[1:] == ("", "", 0, 0) for r in rows)
    assert licenses.scan_licenses(hard.limit(0)).count() == 0


def test_native_plan(spark, sf_dir):
    plan = licenses.op3_sentence_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
