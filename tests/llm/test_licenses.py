"""Published notices as they stand, plain and in comments, and the SQL for the same rows."""

import duckdb
from test_corpus import ODD

from loomgraph.llm import licenses

APACHE = """Copyright 2024 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""

MIT = """MIT License

Copyright (c) 2024 Some One

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

BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
CLAUSE3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""

GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""

MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""

#: (notice, licence, numbers of its sentences: the whole rule)
NOTICES = [
    (APACHE, "apache-2.0", "30,3,4,5"), (MIT, "mit", "8,9,10,11"), (BSD2 + DISCLAIMER, "bsd-2-clause", "25,26,27,36,37"), (BSD2 + CLAUSE3 + DISCLAIMER, "bsd-3-clause", "25,26,27,35,36,37"),
    (ISC, "isc", "28,38,39"), (GPL3, "gpl-3.0-or-later", "14,16,17,18,31"), (GPL2, "gpl-2.0-or-later", "15,16,17,33"), (MPL, "mpl-2.0", "23,24"),
]


def commented(notice):
    lines = notice.split("\n")
    yield notice
    yield "Some code above.\n\n" + notice + "\n\nand more text below"
    for mark in ("# ", "// ", "-- ", "; ", "% "):
        yield "\n".join((mark + line).rstrip() for line in lines) + "\n\nimport this"
    yield "/*\n" + "\n".join((" * " + line).rstrip() for line in lines) + "\n */\nint x;"
    yield notice.replace("\n", "\r\n")
    yield notice.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, numbers int")


def test_published_notices(spark):
    rows = [(text, *want) for notice, *want in NOTICES for text in commented(notice)]
    got = {r.doc_id: r for r in licenses.recognise(frame(spark, [t for t, *_ in rows])).collect()}
    for i, (text, name, numbers) in enumerate(rows):
        assert (got[i].licenses, got[i].sentence_ids, got[i].n_rules) == (name, numbers, 1), text


def test_short_notices_and_odd_texts(spark, tmp_path):
    texts = ["Text. Released under the MIT License.\nMore", "no end here\nLicensed under CC BY-NC 4.0\nand on", "a.\nlicensed  under the MIT-License! x", "licensed under the GPL", APACHE + " Released under the MIT License.", "v. 2.0", *ODD]
    docs = frame(spark, texts).unionAll(spark.createDataFrame([(0, None, 5), (None, MIT, 1)], "doc_id long, text string, numbers int"))
    got = [r for r in licenses.recognise(docs).collect()]
    assert [r.licenses for r in got[:6]] == ["mit", "cc-by-nc-4.0", "", "", "apache-2.0,mit", ""]
    assert all((r.n_sentences, r.n_rules, r.licenses) == (0, 0, "") for r in got[6:-1]) and len(got) == len(texts) + 2 and got[-1].licenses == "mit"
    every = docs.unionAll(frame(spark, [text for notice, *_ in NOTICES for text in commented(notice)]))
    every.select("doc_id", "text").write.parquet(str(tmp_path / "documents"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, licenses.recognise(every).collect()), key=key) == sorted(duckdb.sql(licenses.sql()).fetchall(), key=key)
    assert licenses.recognise(docs.limit(0)).count() == 0


def test_rules_name_known_sentences():
    assert all(1 <= i <= len(licenses.SENTENCES) for _, seq in licenses.RULES for i in seq)
    assert len({seq for _, seq in licenses.RULES}) == len(licenses.RULES) and len(set(licenses.SENTENCES)) == len(licenses.SENTENCES)
