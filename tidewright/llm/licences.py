"""Licence lookup by canonical digest (DataFrame functions only).

A text is made canonical (case, punctuation, copyright lines and equivalent spellings do not
count), hashed, and the digest is joined to those of known licences: whole texts match or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import NOT_ALNUM, bounded

#: Known digests up to so many rows are broadcast; beyond, the join is dealt out by digest.
BROADCAST_ROWS = 20_000

#: Lines that state a copyright: such a word or sign at the start, and a year, a sign or a place for them; and lines that
#: say "all rights reserved" and no more. A line of running text that begins with the word is none.
COPYRIGHT_LINE = (
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[^\n]*(?:[0-9]{4}|\(c\)|©|<year>|\[year\]|\[yyyy\])[^\n]*|(?:\(c\)|©)[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
)

#: Equivalent spellings, left is written as right; a space stands for the edge of a word.
SPELLINGS = (
    (" licence", " license"),
    (" sub license", " sublicense"),
    (" sublicence", " sublicense"),
    (" non infringement ", " noninfringement "),
    (" organisation", " organization"),
    (" authoris", " authoriz"),
    (" acknowledgement", " acknowledgment"),
    (" copyright owner", " copyright holder"),
    (" favour", " favor"),
    (" whilst ", " while "),
    (" wilful", " willful"),
    (" per cent ", " percent "),
    (" modelled ", " modeled "),
    (" recognis", " recogniz"),
    (" https ", " http "),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Public licence texts (id, title line, body).
TEXTS = (
    ("MIT", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_END),
    ("0BSD", "Zero-Clause BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_END),
    ("BSD-2-Clause", "BSD 2-Clause License", _BSD_HEAD + _BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License", _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END),
    ("Zlib", "zlib License", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "The Unlicense", 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n' + _AS_IS + " AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n" + _AS_IS + ", TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0-notice", "", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "", "Licensed under CC BY-NC 4.0."),
)


#: Canonical digests of public licences whose texts are long, from their plain text forms; of some also
#: without the appendix that says how to apply them.
DIGESTS = (
    ("Apache-2.0", "adf220ee02537f83220e088f4488ca0e7557d614fac1cc48967b41d13911d6e0"),
    ("Apache-2.0", "9446b99128ec9c3946adbb681853599f3a5f01a69d6c0762a9d0ab699868d801"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "7843068060f4d9ee30736221ce49abf6cb7dafa9b775fabb47fbf0c21e05b102"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
)


def known_digests(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """license_id, digest: each known licence with and without its title line; texts: more of them (license_id, text)."""
    rows = [(i, body) for i, _, body in TEXTS] + [(i, f"{title}\n\n{body}") for i, title, body in TEXTS if title]
    known = spark.createDataFrame(rows, "license_id string, text string")
    known = known if texts is None else known.unionByName(texts.select("license_id", "text"))
    digests = known.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest")).where(F.col("digest") != F.sha2(F.lit(""), 256))
    return digests.unionByName(spark.createDataFrame(DIGESTS, "license_id string, digest string"))


def canonical(text: Column) -> Column:
    """The canonical text: null as empty; lower case words joined by one space, without copyright lines."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, NOT_ALNUM, " ")), F.lit(" "))
    for left, right in SPELLINGS:
        out = F.replace(out, F.lit(left), F.lit(right))
    return F.trim(out)


def find_licences(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_canonical (code points), digest (SHA-256 of the canonical text), license_id (null: none known) for every row.

    known: license_id, digest.

    Null, empty and wordless texts have no licence. If known licences share a digest, the least id counts,
    so no row is doubled. Repeated rows stay; an empty docs or known table is fine; other columns are not looked at.
    """
    named = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("c")).select(F.col(id_col), F.length("c").cast("long").alias("n_canonical"), F.sha2("c", 256).alias("digest"))
    return rows.join(F.broadcast(named) if bounded(known, BROADCAST_ROWS) else named, "digest", "left").select(id_col, "n_canonical", "digest", "license_id")


def oracle_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(text: str) -> str:
        out = f"' ' || trim(regexp_replace(regexp_replace(lower(coalesce({text}, '')), {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(NOT_ALNUM)}, ' ', 'g')) || ' '"
        for left, right in SPELLINGS:
            out = f"replace({out}, '{left}', '{right}')"
        return f"trim({out})"

    rows = [(i, body) for i, _, body in TEXTS] + [(i, f"{title}\n\n{body}") for i, title, body in TEXTS if title]
    values = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in rows)
    digests = ", ".join(f"({quoted(i)}, {quoted(d)})" for i, d in DIGESTS)
    return f"""WITH named AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, sha256({canon('text')}) AS digest FROM (VALUES {values}) AS v(license_id, text)
      UNION ALL SELECT * FROM (VALUES {digests}) AS w(license_id, digest)) GROUP BY 1),
    d AS (SELECT doc_id, {canon('text')} AS c FROM documents)
    SELECT doc_id, length(c)::BIGINT AS n_canonical, sha256(c) AS digest, license_id FROM d LEFT JOIN named ON named.digest = sha256(c)"""
