"""Notices that the table of sentences was not made from: other owners, other programs, identifiers."""

import duckdb
import pytest
from test_licenses import BSD2, CLAUSE3, DISCLAIMER, MIT

from loomgraph.llm import licenses

OWNER = """
   * Neither the name of Gadget Works Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
REGENTS = """
THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LESSER = """/* Widgets is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Lesser General Public License as published by
 * the Free Software Foundation; either version 2.1 of the License, or
 * (at your option) any later version.
 *
 * Widgets is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU Lesser General Public License for more details.
 *
 * You should have received a copy of the GNU Lesser General Public License
 * along with Widgets.  If not, see <https://www.gnu.org/licenses/>.
 */"""
NOTICES = {
    "bsd-2-clause": [BSD2 + DISCLAIMER, BSD2 + REGENTS, BSD2],
    "bsd-3-clause": [BSD2 + OWNER + DISCLAIMER, BSD2 + CLAUSE3 + REGENTS, BSD2.replace("1. ", "   * ").replace("2. ", "   * ") + OWNER + REGENTS, BSD2 + "\n3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n" + DISCLAIMER],
    "bsd": [BSD2 + "\n3. All advertising materials must display the following acknowledgement.\n" + DISCLAIMER],
    "mit": [MIT.replace("AUTHORS OR COPYRIGHT HOLDERS", "X CONSORTIUM"), "// SPDX-License-Identifier: MIT\nint x;"],
    "lgpl-2.1-or-later": [LESSER, "# SPDX-License-Identifier: LGPL-2.1-or-later"],
    "lgpl-3.0-or-later": [LESSER.replace("2.1", "3")],
    "agpl-3.0-or-later": [LESSER.replace("Lesser", "Affero").replace("2.1", "3")],
    "gpl-2.0-or-later": [LESSER.replace("Lesser ", "").replace("2.1", "2")],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "": ["This is about the GNU Lesser General Public License.", "In no event shall it rain.", "SPDX-License-Identifier: Made-Up-1.0", "http://www.gnu.org/licenses/"],
}


def test_notices_of_others_get_their_names(spark):
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, texts in NOTICES.items() for t in texts)]
    got = {r.doc_id: r for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()}
    assert {(i, text[:60]): got[i].licenses for i, _, text in rows} == {(i, text[:60]): name for i, name, text in rows}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, name VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = duck.execute(licenses.sql())
    columns = [c[0] for c in want.description]
    assert sorted(tuple(got[i][c] for c in columns) for i in got) == sorted(want.fetchall())


@pytest.mark.parametrize("size, named", [(1, True), (licenses.SLOT, True), (licenses.SLOT + 1, False)])
def test_slots_have_a_bound(spark, size, named):
    text = OWNER.replace("Gadget Works Inc.", "x" * size)
    assert (licenses.recognise(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().sentence_ids == "35") == named
