"""Licence scan by canonical digests: a text that is a known licence as a whole, however it is typeset.

Texts are brought to a canonical form - lower case, no copyright lines, equivalent spellings alike, no punctuation, one
blank between words - and hashed; digests are joined to those of the known licences. The table of known digests is as
large as the list of licences, so it is broadcast; documents aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read_table

#: Spellings that licence matching treats as one.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"),
    ("signalling", "signaling"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"),
]

GRANT = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MIT_BODY = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: {GRANT} THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
ISC_TAIL = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
#: Texts of well-known licences and notices, in the forms they come in: (identifier, text).
KNOWN = [
    ("MIT", MIT_BODY),
    ("MIT", f"MIT License {MIT_BODY}"),
    ("MIT", f"The MIT License (MIT) {MIT_BODY}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {ISC_TAIL}"),
    ("ISC", f"ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {ISC_TAIL}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {ISC_TAIL}"),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {BSD_HEAD} {BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_TAIL}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {BSD_TAIL}"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Canonical digests of long licences, as whole files and, where these have an appendix, of the terms alone.
KNOWN_DIGESTS = [
    ("Apache-2.0", "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("GPL-1.0-only", "eafda7cb5e995143f4d45ef2107eb160d6856afabed7c48b1b317303bc40a7e6"),
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0-only", "633db8412bbb99b0672b664e80d260461a3f7fb1c14a45c614eb6124876ce2a7"),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0-only", "969fd5d620157eced8b632e4ba7154859f195397976b89e7ee716615116fc70a"),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0-only", "1f1ace2d2c5e80547f3f0517299934f8d456c17a9a9939250e76087b010f5614"),
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1-only", "6eacb2e57ceb0cc63a48b9b4e3181e4b691c27408dfd80dc12bafc4bffff46b5"),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", "452eaadd998b06b62a51be424c021eea5228803a2773e147818b9cd429a60d64"),
    ("GFDL-1.3-only", "c6db6132e3f9cfc574a0348860b9e8a36b70ab711ca7ec85d9c61871c2d90e55"),
]
#: Lines that only say who holds the copyright, and words that follow "copyright" in the body of a licence instead.
HOLDER = r"^[^\p{L}\p{N}]*(copyright[^\p{L}\p{N}]+[\p{L}\p{N}]|©|\(c\) *(19|20)[0-9]{2})"
BODY = (
    r"^[^\p{L}\p{N}]*copyright([.,;:-]| \(c\) +(19[xy]|year |_|<year> +<name of author)|(ed|able)?[^\p{L}\p{N}]+(notices?|holders?|owners?|ownership|laws?|licen[cs]es?|licensors?|statements?|interests?|acts?|treat(y|ies)|rights?|protection|protected|control|controlled"
    r"|line|date|year|disclaimers?|patents?|trademarks?|infringement|claims?|materials?|works?|attribution|management|status|terms?|portions?|conditions?|similar|granted|grants?|permission"
    r"|and|or|on|in|of|to|for|by you|is|are|as|such|that|which|with|under|from|at|any|this|these|shall|may|must|can|will|has|have|you|your|if|resulting|does|do|also|along|as|so|only|applies|exists?|means?|doctrines?|those|the (software|library|program|work))\b)"
)
RESERVED = r"^[^\p{L}\p{N}]*all rights reserved[^\p{L}\p{N}]*$"
#: A holder's clause in front of a licence on the same line.
INLINE = r"(copyright|©)( *\(c\)| *©)? *[0-9]{4}[^\n]{0,200}?(all rights reserved[^\p{L}\p{N}]+)?(permission is hereby granted|permission to use|redistribution and use)"
SOME = r"copyright|©|\(c\)|all rights reserved"


def canonical(text: Column) -> Column:
    """The canonical form; a null text has that of the empty one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    lines = F.split(F.regexp_replace(low, INLINE, "$4"), "\n")
    kept = F.filter(lines, lambda x: ~((x.rlike(HOLDER) & ~x.rlike(BODY)) | x.rlike(RESERVED)))
    # these lines and most spellings are rare: look first
    out = F.when(low.rlike(SOME), F.array_join(kept, "\n")).otherwise(low)
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    some = F.concat(F.lit(" "), out, F.lit(" ")).rlike(" (" + "|".join(a for a, _ in SPELLINGS) + ") ")
    # two blanks between words, so that neighbours share none
    alike = F.concat(F.lit(" "), F.replace(out, F.lit(" "), F.lit("  ")), F.lit(" "))
    for a, b in SPELLINGS:
        alike = F.replace(alike, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.when(some, F.replace(alike, F.lit("  "), F.lit(" "))).otherwise(out))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest of known (license, text), or by default of KNOWN and KNOWN_DIGESTS."""
    rows = spark.createDataFrame(KNOWN if known is None else known, "license string, text string").select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(KNOWN_DIGESTS, "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: the columns in keep (doc_id), digest, license (null if none) and matched.

    Equal rows are looked up one by one. An empty or null text has the digest of nothing, which no licence has.
    """
    keep = ["doc_id"] if keep is None else keep
    flat = docs.select(*[docs[c] for c in keep], F.sha2(canonical(docs[text]), 256).alias("digest"))
    found = flat.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest", "left")
    return found.select(*keep, "digest", "license", F.col("license").isNotNull().alias("matched"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan of all documents: one row each, repeated rows included. Null and empty texts match nothing; an empty table gives no row."""
    return scan(read_table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    lines = f"string_split(regexp_replace({low}, '{INLINE}', '\\4', 'g'), chr(10))"
    kept = f"list_filter({lines}, lambda x: not ((regexp_matches(x, '{HOLDER}') and not regexp_matches(x, '{BODY}')) or regexp_matches(x, '{RESERVED}')))"
    out = f"case when regexp_matches({low}, '{SOME}') then array_to_string({kept}, chr(10)) else {low} end"
    out = f"' ' || replace(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ', '  ') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{f' {a} '.replace(' ', '  ')[1:-1]}', '{f' {b} '.replace(' ', '  ')[1:-1]}')"
    return f"trim(replace({out}, '  ', ' '))"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    more = ", ".join(f"('{a}', '{b}')" for a, b in KNOWN_DIGESTS)
    return f"""
with known as (select digest, min(license) as license from (select license, sha256({_sql_canonical("text")}) as digest from (values {values}) v(license, text) union all select * from (values {more}) w(license, digest)) group by 1),
flat as (select doc_id, sha256({_sql_canonical("text")}) as digest from documents)
select doc_id, digest, license, license is not null as matched from flat left join known using (digest)"""
