"""Licence scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences, each is normalised, and those that are known licence sentences become identifiers; all others are
unknown. A rule is an ordered list of identifiers. Rules are tried from the most specific on; a match takes its sentences, so that
the short statement within a long one isn't found again.

Every text is read twice. The first reading takes each line as it stands, as in notices and lists. The second joins wrapped lines:
comment marks at line starts go, a paragraph ends at an empty line or where a list mark begins the next line, and all other line
ends are spaces. Nothing is shuffled and no row is larger than its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: Known sentences by identifier, normalised: lower case, runs of other characters than a-z and 0-9 as one space, and
#: what differs from text to text as the last steps of `NORMAL` write it.
SENTENCES = [
    ("apache_header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache_named", "licensed under the apache license version 2 0 the license"),
    ("apache_compliance", "you may not use this file except in compliance with the license"),
    ("apache_obtain", "you may obtain a copy of the license at"),
    ("apache_obtain_url", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache_obtain_url", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    ("apache_url", "http www apache org licenses license 2 0"),
    ("apache_url", "https www apache org licenses license 2 0"),
    ("apache_as_is", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache_url_as_is", "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache_see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit_granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit_granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_notice", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("mit_as_is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit_as_is", "the software is provided as is without warranty of any kind express or implied"),
    ("mit_liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit0_granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("isc_granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd0_granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc_liable", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd_redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd_advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd_endorse", "neither the name of holder may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_as_is", "this software is provided by holder as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd_liable", "in no event shall holder be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("gpl3_free_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl2_free_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl3_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3"),
    ("gpl2_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2"),
    ("gpl2_free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl_hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_details", "see the gnu general public license for more details"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses"),
    ("gpl_copy", "you should have received a copy of the gnu general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"),
    ("gpl_if_not", "if not see http www gnu org licenses"),
    ("gpl_if_not", "if not see https www gnu org licenses"),
    ("lgpl3_free_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl21_free_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl_details", "see the gnu lesser general public license for more details"),
    ("lgpl_copy", "you should have received a copy of the gnu lesser general public license along with this program"),
    ("lgpl_copy", "you should have received a copy of the gnu lesser general public license along with this program if not see https www gnu org licenses"),
    ("lgpl_copy", "you should have received a copy of the gnu lesser general public license along with this program if not write to the free software foundation inc 51 franklin street fifth floor boston ma 02110 1301 usa"),
    ("agpl3_free_later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl_details", "see the gnu affero general public license for more details"),
    ("agpl_copy", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl_copy", "you should have received a copy of the gnu affero general public license along with this program if not see http www gnu org licenses"),
    ("agpl_copy", "you should have received a copy of the gnu affero general public license along with this program if not see https www gnu org licenses"),
    ("mpl2_subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl2_obtain", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl2_obtain", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("epl2_under", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("zlib_as_is", "this software is provided as is without any express or implied warranty"),
    ("zlib_liable", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib_granted", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("zlib_origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib_product", "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("zlib_altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib_notice", "this notice may not be removed or altered from any source distribution"),
    ("bsl_granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("unlicense_free", "this is free and unencumbered software released into the public domain"),
    ("unlicense_anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0_waived", "to the extent possible under law holder has waived all copyright and related or neighboring rights to this work"),
    ("public_domain", "this work is in the public domain"),
    ("public_domain", "this file is in the public domain"),
    ("all_rights", "all rights reserved"),
]
#: What stands after "licensed under", "released under" and the like, by licence.
NAMES = {
    "MIT": ["the mit license"],
    "Apache-2.0": ["the apache license version 2 0", "the apache 2 0 license", "apache license 2 0", "apache 2 0"],
    "GPL-3.0-only": ["the gnu general public license version 3", "the gnu general public license v3 0", "the gnu gpl version 3", "the gpl version 3", "the gplv3", "gplv3"],
    "GPL-2.0-only": ["the gnu general public license version 2", "the gnu general public license v2 0", "the gnu gpl version 2", "the gpl version 2", "the gplv2", "gplv2"],
    "LGPL-3.0-only": ["the gnu lesser general public license version 3", "the gnu lgpl version 3", "the lgpl version 3", "the lgplv3"],
    "LGPL-2.1-only": ["the gnu lesser general public license version 2 1", "the gnu lgpl version 2 1", "the lgpl version 2 1"],
    "AGPL-3.0-only": ["the gnu affero general public license version 3", "the gnu agpl version 3", "the agpl version 3", "the agplv3"],
    "MPL-2.0": ["the mozilla public license version 2 0", "the mozilla public license 2 0", "the mpl 2 0"],
    "EPL-2.0": ["the eclipse public license 2 0", "the eclipse public license version 2 0"],
    "BSD-2-Clause": ["the bsd 2 clause license", "the 2 clause bsd license", "the simplified bsd license"],
    "BSD-3-Clause": ["the bsd 3 clause license", "the 3 clause bsd license", "the new bsd license", "the modified bsd license"],
    "ISC": ["the isc license"],
    "Zlib": ["the zlib license"],
    "BSL-1.0": ["the boost software license version 1 0"],
    "Unlicense": ["the unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0", "the cc0 license"],
} | {
    f"CC-{code.upper()}-{v}.0": [f"{a}{code.replace('-', ' ')} {v} 0" for a in ("cc ", "a cc ", "the cc ")] + [f"{a} creative commons {words} {v} 0{end}" for a in ("a", "the") for end in (" international license", " license", " unported license")]
    for v in (4, 3)
    for code, words in {"by": "attribution", "by-sa": "attribution sharealike", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nd": "attribution noderivatives", "by-nc-nd": "attribution noncommercial noderivatives"}.items()
}


def statement(licence: str) -> str:
    """The identifier of the sentence that names a licence."""
    return "names_" + licence.lower().replace("-", "_").replace(".", "_")


SENTENCES += [(statement(licence), f"under {name}") for licence, names in NAMES.items() for name in names]

_APACHE = [["apache_header"], ["apache_named", "apache_compliance"]]
_APACHE_AT = [["apache_obtain", "apache_url", "apache_as_is"], ["apache_obtain_url", "apache_as_is"], ["apache_obtain", "apache_url_as_is"], ["apache_obtain", "apache_as_is"]]
_BSD = ["bsd_redistribution", "bsd_source", "bsd_binary"]
_GNU = [("GPL-3.0-or-later", "gpl3_free_later", "gpl"), ("GPL-2.0-or-later", "gpl2_free_later", "gpl"), ("GPL-3.0-only", "gpl3_free", "gpl"), ("GPL-2.0-only", "gpl2_free", "gpl"), ("LGPL-3.0-or-later", "lgpl3_free_later", "lgpl"), ("LGPL-2.1-or-later", "lgpl21_free_later", "lgpl"), ("AGPL-3.0-or-later", "agpl3_free_later", "agpl")]
_ZLIB = ["zlib_as_is", "zlib_liable", "zlib_granted", "zlib_origin", "zlib_product", "zlib_altered", "zlib_notice"]
#: Licence, then its sentences in order; most specific first.
RULES = (
    [("Apache-2.0", [*a, *b, *c]) for a in _APACHE for b in _APACHE_AT for c in (["apache_see"], [])]
    + [("Apache-2.0", [*a, "apache_obtain"]) for a in _APACHE]
    + [(name, [free, "gpl_hope", f"{kind}_details", f"{kind}_copy", *end]) for name, free, kind in _GNU for end in (["gpl_if_not"], [])]
    + [(name, [free, "gpl_hope", *more]) for name, free, kind in _GNU for more in ([f"{kind}_details"], [f"{kind}_copy"], [])]
    + [
        ("MIT", ["mit_granted", "mit_notice", "mit_as_is", "mit_liable"]),
        ("MIT", ["mit_granted", "mit_notice", "mit_as_is"]),
        ("MIT", ["mit_granted", "mit_notice"]),
        ("MIT-0", ["mit0_granted", "mit_as_is", "mit_liable"]),
        ("ISC", ["isc_granted", "isc_as_is", "isc_liable"]),
        ("ISC", ["isc_granted"]),
        ("0BSD", ["bsd0_granted", "isc_as_is", "isc_liable"]),
        ("BSD-4-Clause", [*_BSD, "bsd_advertising"]),
        ("BSD-3-Clause", [*_BSD, "bsd_endorse", "bsd_as_is", "bsd_liable"]),
        ("BSD-3-Clause", [*_BSD, "bsd_endorse"]),
        ("BSD-2-Clause", [*_BSD, "bsd_as_is", "bsd_liable"]),
        ("BSD-2-Clause", _BSD),
        ("MPL-2.0", ["mpl2_subject", "mpl2_obtain"]),
        ("MPL-2.0", ["mpl2_subject"]),
        ("EPL-2.0", ["epl2_under"]),
        ("Zlib", _ZLIB),
        ("Zlib", _ZLIB[:3]),
        ("BSL-1.0", ["bsl_granted"]),
        ("Unlicense", ["unlicense_free", "unlicense_anyone"]),
        ("Unlicense", ["unlicense_free"]),
        ("CC0-1.0", ["cc0_waived"]),
        ("MIT AND Proprietary", [statement("MIT"), "all_rights"]),
        ("Apache-2.0", ["apache_header"]),
        ("Apache-2.0", ["apache_named"]),
    ]
    + [(name, [free]) for name, free, _ in _GNU]
    + [(licence, [statement(licence)]) for licence in NAMES]
    + [("MIT", ["mit_granted"]), ("Public-Domain", ["public_domain"]), ("Proprietary", ["all_rights"])]
)
#: Every known sentence holds one of these; a text without any of them holds none and isn't read.
TRIGGERS = [
    "licens", "permission", "redistribut", "copyright", "warrant", "public domain", "rights reserved", "under cc", "under a cc", "under the cc", "under apache", "gpl", "the mpl", "this software", "liable",
    "misrepresented", "source distribution",
]
#: Steps that normalise a sentence after it is in lower case, in turn: (pattern, replacement).
NORMAL = [
    ("[^a-z0-9]+", " "),
    ("^ | $", ""),
    # who and what differ from text to text
    ("^(this (work|software|project|program|file|code|document|library|material|text|article|page) is )?(dual )?(licensed|released|distributed|published|made available|available) under (the terms of )?", "under "),
    ("^(under [a-z0-9 ]{1,60}?) copyright( c)? [0-9]{4}[a-z0-9 ]*$", "$1"),
    ("^under (the apache license version 2 0 the license)", "licensed under $1"),
    ("^[a-z0-9 ]{1,60} is free software you can redistribute it", "this program is free software you can redistribute it"),
    ("^[a-z0-9 ]{1,60} is distributed in the hope that", "this program is distributed in the hope that"),
    ("along with (this library|[a-z0-9]{1,40})( if not|$)", "along with this program$2"),
    ("^neither the name of [a-z0-9 ]{1,120} may be used", "neither the name of holder may be used"),
    ("^this software is provided by [a-z0-9 ]{1,120} as is and any", "this software is provided by holder as is and any"),
    ("^in no event shall [a-z0-9 ]{1,120} be liable for any direct", "in no event shall holder be liable for any direct"),
    ("^to the extent possible under law [a-z0-9 ]{1,120} has waived", "to the extent possible under law holder has waived"),
]
END = r"([.!?:])[ \t\r]+"
#: The second reading: marks of comments; ends of paragraphs; marks that begin an item of a list.
COMMENT = r"(^|\n)[ \t]*(//+|#+|;+|--+|/?\*+|%+|<!--|\(\*)[ \t]?"
PARAGRAPH = r"\n([ \t]*\n)+"
ITEM = r"\n[ \t]*([0-9]{1,2}[.)]|\([a-z0-9]{1,2}\)|[-*+])[ \t]+"
#: A colon and a full stop that end no sentence.
COLON = "(?i)(is free software|license, v)[:.]"
#: A sentence that is only a number or letter of a list.
MARK = "^([0-9]{1,2}|[a-z]|[ivx]{1,4})$"


def lines_of(text: Column) -> Column:
    """First reading: a sentence ends at its line's end, or at one of .!?: before white space."""
    return F.split(F.regexp_replace(text, END, "$1\n"), "\n")


def joined_lines_of(text: Column) -> Column:
    """Second reading: without comment marks, a sentence ends with its paragraph or item, or at one of .!?: before white space."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), COMMENT, "$1")
    parts = F.replace(F.regexp_replace(F.regexp_replace(plain, PARAGRAPH, "\u0001"), ITEM, "\u0001"), F.lit("\n"), F.lit(" "))
    return F.split(F.regexp_replace(parts, END, "$1\u0001"), "\u0001")


def normalised(sentence: Column) -> Column:
    out = F.lower(sentence)
    for pattern, by in NORMAL:
        out = F.regexp_replace(out, pattern, by)
    return out


def identifiers(sentences: Column, known: list[tuple[str, str]]) -> Column:
    """The sentences as one string: <identifier> for a known one, <> for any other; empty ones and marks of lists are passed over."""
    table = F.map_from_arrays(F.array(*[F.lit(s) for _, s in known]), F.array(*[F.lit(f"<{name}>") for name, _ in known]))
    plain = F.filter(F.transform(sentences, normalised), lambda s: (s != "") & ~s.rlike(MARK))
    return F.array_join(F.transform(plain, lambda s: F.coalesce(F.try_element_at(table, s), F.lit("<>"))), "")


def scan_licenses(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, triggers: list[str] = TRIGGERS) -> DataFrame:
    """doc_id, identifiers (known sentences in order, joined by commas), licences (likewise), n_known, n_unmatched.

    One row for each row of (doc_id, text). Null and empty texts have no sentences: empty strings and zeros. Null and repeated ids
    and repeated rows stay as they are. Identifiers between which an unknown sentence stands don't make a rule of two. identifiers,
    n_known and n_unmatched (known sentences in no rule) are those of the reading with more known sentences, the first one if both
    have as many; licences are those of the first reading, and after them those that only the second one finds.
    """
    for name, s in sentences:
        if not any(t in s for t in triggers):
            raise ValueError(f"{name}: no trigger in {s}")
    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), COLON, "$1")
    # the words of a trigger may be parted by anything that normalising makes a space
    seen = F.lower(text).rlike("|".join(t.replace(" ", "[^a-z0-9]+") for t in triggers))
    readings = {"_a": lines_of(text), "_b": joined_lines_of(text)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.when(seen, identifiers(s, sentences)).otherwise("").alias(n) for n, s in readings.items()])
    for n in readings:
        left = F.col(n)
        for licence, order in rules:
            left = F.replace(left, F.lit("".join(f"<{x}>" for x in order)), F.lit(f"[{licence}]"))
        rows = rows.withColumn(f"{n}_left", F.when(F.col(n).contains("<"), left).otherwise(""))

    def tags(c: str) -> Column:
        return F.regexp_extract_all(c, F.lit("<([a-z0-9_]+)>"), F.lit(1))

    def found(c: str) -> Column:
        return F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1))

    second = F.size(tags("_b")) > F.size(tags("_a"))
    known = F.when(second, tags("_b")).otherwise(tags("_a"))
    return rows.select(
        "doc_id",
        F.array_join(known, ",").alias("identifiers"),
        F.array_join(F.concat(found("_a_left"), F.filter(found("_b_left"), lambda x: ~F.array_contains(found("_a_left"), x))), ",").alias("licences"),
        F.size(known).cast("long").alias("n_known"),
        F.when(second, F.size(tags("_b_left"))).otherwise(F.size(tags("_a_left"))).cast("long").alias("n_unmatched"),
    )


def oracle_sql(sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The same by a join of all sentences of all texts with the table of known ones and an ordered aggregate."""
    known = ", ".join(f"('{s}', '{name}')" for name, s in sentences)
    plain = "lower(line)"
    for pattern, by in NORMAL:
        by = by.replace("$1", r"\1").replace("$2", r"\2")
        plain = f"regexp_replace({plain}, '{pattern}', '{by}', 'g')"
    left = "seq"
    for licence, order in rules:
        left = f"replace({left}, '{''.join(f'<{x}>' for x in order)}', '[{licence}]')"
    return rf"""
WITH known(s, tag) AS (VALUES {known}),
texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '{COLON}', '\1', 'g') AS t FROM documents),
plain AS (SELECT r, regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '{COMMENT}', '\1', 'g') AS t FROM texts),
cut AS (SELECT r, 1 AS reading, string_split(regexp_replace(t, '{END}', '\1' || chr(10), 'g'), chr(10)) AS parts FROM texts
  UNION ALL SELECT r, 2, string_split(regexp_replace(replace(regexp_replace(regexp_replace(t, '{PARAGRAPH}', chr(1), 'g'), '{ITEM}', chr(1), 'g'), chr(10), ' '), '{END}', '\1' || chr(1), 'g'), chr(1)) FROM plain),
each AS (SELECT r, reading, unnest(parts) AS line, unnest(range(len(parts))) AS p FROM cut),
norm AS (SELECT r, reading, p, {plain} AS s FROM each),
tagged AS (SELECT r, reading, p, tag FROM norm LEFT JOIN known USING (s) WHERE s <> '' AND NOT regexp_matches(s, '{MARK}')),
seqs AS (SELECT r, reading, string_agg('<' || coalesce(tag, '') || '>', '' ORDER BY p) AS seq, list(tag ORDER BY p) FILTER (tag IS NOT NULL) AS tags FROM tagged GROUP BY 1, 2),
matched AS (SELECT r, reading, coalesce(tags, []) AS tags, {left} AS rest FROM seqs),
counted AS (SELECT r, reading, tags, regexp_extract_all(rest, '\[([^\]]+)\]', 1) AS licences, len(regexp_extract_all(rest, '<([a-z0-9_]+)>', 1)) AS n_left FROM matched),
both_ AS (SELECT x.r, coalesce(a.tags, []) AS ta, coalesce(b.tags, []) AS tb, coalesce(a.licences, []) AS la, coalesce(b.licences, []) AS lb, coalesce(a.n_left, 0) AS na, coalesce(b.n_left, 0) AS nb
  FROM texts x LEFT JOIN counted a ON a.r = x.r AND a.reading = 1 LEFT JOIN counted b ON b.r = x.r AND b.reading = 2)
SELECT doc_id,
  array_to_string(CASE WHEN len(tb) > len(ta) THEN tb ELSE ta END, ',') AS identifiers,
  array_to_string(list_concat(la, list_filter(lb, lambda x: NOT list_contains(la, x))), ',') AS licences,
  CAST(greatest(len(ta), len(tb)) AS BIGINT) AS n_known,
  CAST(CASE WHEN len(tb) > len(ta) THEN nb ELSE na END AS BIGINT) AS n_unmatched
FROM both_ JOIN texts USING (r)"""


def op3_sentence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
