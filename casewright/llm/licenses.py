"""Licence scans by canonical digest lookup: whole texts against known licences, in DataFrame functions only.

A text is reduced to a canonical form: copyright lines out, lower case, equivalent spellings to one, everything that
is no letter or digit to single spaces. Its SHA-256 is looked up in the digests of the known texts by a hash join. A
known text counts with and without its title line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices by SPDX identifier.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "MIT (line)": "Released under the MIT License.",
    "GPL-3.0 (line)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.",
}
# Title lines that may stand before a text.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (Expat)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Digests of the canonical form of long texts, as their publishers distribute them.
FULL_DIGESTS = {
    "Apache-2.0 (full)": "70d7dc3c932f0fe2897b85e437308d81cf9e95cead3d19cc09dc51eb95303daa",
    "GPL-1.0": "98760ce0d17a59fc77e97462ac1212cfc8e286396cd26f04698e47b4c72c757d",
    "GPL-2.0": "89d9a7a2a53e8ebef42e38ec69d8f487c0cbcfd11afc36f546b2ce7e975fda42",
    "GPL-3.0": "e9e95c9bbbad775493003b4571016e35e03ec87e99383a3b7bd1eb18471001c4",
    "LGPL-2.0": "69e3ad539b1239e8a4838a5f948ef2c8514ea477fd1877848f1389fa22421830",
    "LGPL-2.1": "a05c4cc3c6c706f826229221d0535f0ea06d3674d2297f3334894f65e1a907de",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61",
    "MPL-2.0": "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9",
    "CC0-1.0": "5ae3f76dda2e69e50143522ea539402a0b5e33eb1a4ba0497fc88f282d5c0d33",
    "GFDL-1.2": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "Artistic-1.0": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
}
# A spelling and its equivalent.
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"), ("favour", "favor"), ("organisation", "organization"), ("whilst", "while"),
    ("noninfringement", "non infringement"), ("merchantability", "merchantibility"), ("per cent", "percent"),
    ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("https", "http"),
)
# A line of a sign, a year or a place for one, and a line of nothing but capitalised words after `Copyright`.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:(?:(?i:copyright)(?: ?\((?i:c)\)| ?©|:| [0-9<\[])|\((?i:c)\) |© |(?i:all rights reserved))[^\n]*|Copyright(?: (?:\p{Lu}[\p{L}.,'-]*|and|&|of|the|van|von|de|der|den|del|la|le|da|di|dos))+[^\p{L}\p{N}\n]*)$"


def canonical(text: Column) -> Column:
    """The canonical form of a whole text; null stays null, a text without a letter or digit gives an empty string."""
    low = F.lower(F.regexp_replace(text, COPYRIGHT_LINE, " "))
    # two spaces between words, so that a spelling and the next have a space each
    flat = F.concat(F.lit("  "), F.replace(F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " ")), F.lit(" "), F.lit("  ")), F.lit("  "))
    for shown, same in SPELLINGS:
        flat = F.replace(flat, F.lit(f" {shown.replace(' ', '  ')} "), F.lit(f" {same.replace(' ', '  ')} "))
    return F.replace(F.trim(flat), F.lit("  "), F.lit(" "))


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the canonical form."""
    return F.sha2(canonical(text), 256)


def variants(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(license, text) of each text, alone and under each of its titles."""
    return sorted((k, f"{title}\n\n{t}" if title else t) for k, t in texts.items() for title in ("", *TITLES.get(k, ())))


def known_digests(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the known texts with and without their titles, by the same rule, and of FULL_DIGESTS."""
    table = spark.createDataFrame(variants(KNOWN if texts is None else texts), "license string, _text string")
    every = table.select(digest(F.col("_text")).alias("digest"), "license")
    if texts is None:
        every = every.union(spark.createDataFrame(sorted((d, k) for k, d in FULL_DIGESTS.items()), "digest string, license string"))
    return every.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None, *, text: str = "text", out: str = "license", out_digest: str = "digest") -> DataFrame:
    """docs with the digest of the whole text and the licence it is (null: none).

    known: (digest, license), one row a digest; by default the texts in KNOWN, a fixed small table that Spark may
    broadcast by its size. A null text has a null digest and no licence; repeated rows stay; other columns pass through.
    """
    table = known_digests(docs.sparkSession) if known is None else known
    table = table.select(F.col("digest").alias("_cw_digest"), F.col("license").alias("_cw_license"))
    marked = docs.drop(out, out_digest).withColumn(out_digest, digest(F.col(text)))
    joined = marked.join(table, marked[out_digest] == table["_cw_digest"], "left")
    return joined.withColumn(out, F.col("_cw_license")).drop("_cw_digest", "_cw_license")
