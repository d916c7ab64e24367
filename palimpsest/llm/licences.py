"""Licence scan by canonical digests of entire texts, in built-in functions.

A text's canonical form is its lower-cased (A-Z) words without copyright statements and punctuation, however it is wrapped, with equivalent spellings made one; its
digest is the SHA-256 of that form. Whole texts are hash-joined to the digests of known licences, a fixed table of a few rows
(or the caller's own `known` table of (licence, text), joined without a broadcast hint). Null or empty text: the digest of the empty form, no
licence. Texts of any length are read whole; repeated rows give a row each; two licences with one form count as the first by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings of licence texts, left made right.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("honour", "honor"),
    ("judgement", "judgment"), ("whilst", "while"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright holder", "copyright owner"),
    ("merchantibility", "merchantability"), ("https", "http"), ("per cent", "percent"), ("fulfilment", "fulfillment"),
]

#: Copyright lines as the SQL deletes them: from the line's start over anything but letters and digits to one of these words, up to the line's end.
COPYRIGHT_LINE = "(^|\\n)[^a-z0-9\\n©]*(copyright|©|c\\) |all rights reserved)[^\\n]*"
_NOT_HOLDER = "(?![^a-z0-9\\n]*(notices?|holders?|owners?|laws?|licen[sc]es?|statements?|and|or|in|is|as|to|of|the above|permission|interests?|protection|treaty|treaties|infringement|also|means|shall|may|must|on|for)\\b)"
#: Copyright statements: lines that begin with copyright and a mark or have a year, with a mark, with (c) and a year, or that only reserve all rights.
STATEMENT = "(^|\\n)[^a-z0-9\\n©]*(copyright[^a-z0-9\\n]*(c\\)|©)|copyright" + _NOT_HOLDER + "[^\\n]*\\b(19|20)[0-9][0-9]\\b|©|c\\) *(19|20)[0-9][0-9]\\b|all rights reserved(?=[^a-z0-9\\n]*(\\n|$)))[^\\n]*"
#: Lines of copyright and a holder, at a paragraph's start only: elsewhere a wrapped sentence goes on.
HOLDERS = "(^|\\n[^a-z0-9\\n]*\\n)([^a-z0-9\\n©\"“']*copyright\\b" + _NOT_HOLDER + "[^\\n]*(\\n|$))+"
NOT_WORD = "[^\\p{L}\\p{N}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_KEPT_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"

# Fixed values: (licence, text) of published licences and of their customary notices.
KNOWN = [
    ("0BSD", _ISC.format("")), ("Apache-2.0 notice", _APACHE),
    ("BSD-2-Clause", _BSD.format("")), ("BSD-3-Clause", _BSD.format(_THIRD)), ("BSL-1.0", _BSL), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BSL),
    ("GPL-3.0 notice", _GPL),
    ("ISC", _ISC.format(_KEPT_NOTICE)), ("ISC", "ISC License\n\n" + _ISC.format(_KEPT_NOTICE)), ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n\n" + _ZLIB),
]

# Fixed values: (licence, digest of the canonical form) of whole licence texts, made from the copies in Debian's /usr/share/common-licenses; the SQL has none of them.
FULL = [
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8"),
    ("LGPL-2.0", "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e"),
    ("LGPL-2.1", "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    out = F.regexp_replace(F.regexp_replace(out, STATEMENT, "\n"), HOLDERS, "\n\n")
    out = F.trim(F.regexp_replace(out, NOT_WORD, " "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def licence_matches(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, digest, licence): n_words of the canonical form; licence is null where the entire text is no known licence."""
    form = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col)).alias("form"))
    rows = form.select("doc_id", F.when(F.col("form") == "", 0).otherwise(F.regexp_count("form", F.lit(" ")) + 1).cast("long").alias("n_words"), F.sha2("form", 256).alias("digest"))
    fixed = known is None
    if fixed:
        known = docs.sparkSession.createDataFrame(KNOWN, "licence string, text string")
    table = known.where("text is not null").select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("licence").alias("licence"))
    if fixed:
        full = docs.sparkSession.createDataFrame(FULL, "licence string, digest string").select("digest", "licence")
        table = table.unionByName(full).groupBy("digest").agg(F.min("licence").alias("licence"))
    # The built-in table is a constant of this module; another may be of any size.
    return rows.join(F.broadcast(table) if fixed else table, "digest", "left").select("doc_id", "n_words", "digest", "licence")


def _sql_form(text: str) -> str:
    quoted = COPYRIGHT_LINE.replace("\\\\", "\\")
    out = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    out = f"regexp_replace({out}, '{quoted}', chr(10), 'g')"
    out = f"trim(regexp_replace({out}, '{NOT_WORD}', ' ', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def oracle_sql() -> str:
    values = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    return f"""WITH known AS (SELECT sha256({_sql_form("t")}) AS digest, min(l) AS licence FROM (VALUES {values}) v(l, t) GROUP BY 1),
form AS (SELECT doc_id, {_sql_form("text")} AS form FROM documents)
SELECT doc_id, CASE WHEN form = '' THEN 0 ELSE length(form) - length(replace(form, ' ', '')) + 1 END::BIGINT AS n_words, sha256(form) AS digest, licence
FROM form LEFT JOIN known ON known.digest = sha256(form.form)"""
