"""Licence scans by sentence rules: normalised sentences map to identifiers of known licence sentences, and a document's
identifiers, in order, are matched against rules that are ordered sequences of identifiers.

Only built-in functions within a row, so nothing is shuffled. A known sentence may be wrapped over lines, stand behind
comment marks or a list's mark, and hold : and ; between its words; names of programs and holders may stand in it, if they
hold no stop. The same rules give the SQL statement of the scan, which knows a sentence only where no line's end, : or ; stands
within it, and no expression of several licences; on texts without such sentences both give the same rows.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, lower-cased, other characters than letters and digits as one space.
SENTENCES: dict[str, tuple[str, ...]] = {
    "MIT-NAME": ("released under the mit license", "licensed under the mit license", "mit license", "the mit license", "this project is licensed under the mit license"),
    "MIT-GRANT": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",),
    "MIT-NOTICE": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "MIT-AS-IS": ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",),
    "APACHE2-NAME": ("licensed under the apache license version 2 0", "apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "APACHE2-COMPLY": ("you may not use this file except in compliance with the license",),
    "APACHE2-COPY": ("you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"),
    "APACHE2-TITLE": ("apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"),
    "APACHE2-GRANT": ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",),
    "GPL3-NAME": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "GPL2-NAME": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "GPL-FREE": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GPL2-FREE": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of version 2 of the gnu general public license as published by the free software foundation",
    ),
    "LGPL21-FREE": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",),
    "LGPL3-FREE": ("this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "AGPL3-FREE": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "GPL-HOPE": (
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "GPL3-TITLE": ("gnu general public license version 3 29 june 2007",),
    "GPL2-TITLE": ("gnu general public license version 2 june 1991",),
    "GPL3-COPYLEFT": ("the gnu general public license is a free copyleft license for software and other kinds of works",),
    "GPL2-FREEDOM": ("the licenses for most software are designed to take away your freedom to share and change it",),
    "LGPL3-TITLE": ("gnu lesser general public license version 3 29 june 2007",),
    "LGPL3-TEXT": ("this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",),
    "MPL2-FORM": ("this source code form is subject to the terms of the mozilla public license v",),
    "MPL2-COPY": ("if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    "MPL2-TITLE": ("mozilla public license version 2 0",),
    "BSD-GRANT": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "BSD-SOURCE": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "BSD-BINARY": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "BSD-NAMES": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the copyright holders nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "ISC-GRANT": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "UNLICENSE-DOMAIN": ("this is free and unencumbered software released into the public domain",),
    "UNLICENSE-FREE": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "ZLIB-AS-IS": ("this software is provided as is without any express or implied warranty",),
    "ZLIB-GRANT": ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",),
    "BOOST-GRANT": ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",),
    "CCBYNC4-NAME": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    "CCBY4-NAME": ("licensed under cc by 4 0", "this work is licensed under cc by 4 0", "cc by 4 0"),
    "RESERVED": ("all rights reserved",),
}

# Names that a line of the form `SPDX-License-Identifier: name` may hold, and the licence that each tells.
SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1",
    "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0", "MPL-2.0": "MPL-2.0",
    "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC", "Unlicense": "Unlicense", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "CC-BY-4.0": "CC-BY-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0",
}
for _name, _licence in SPDX.items():
    _words = "spdx license identifier " + re.sub("[^a-z0-9]+", " ", _name.lower())
    SENTENCES[f"SPDX-{_licence}"] = (*SENTENCES.get(f"SPDX-{_licence}", ()), _words)

# Rules (name, licence, identifiers in the order in which they must follow, one that must not come right
# after). Of a licence's rules that match the last listed here counts.
RULES: tuple[tuple[str, str, tuple[str, ...], str | None], ...] = (
    ("mit-name", "MIT", ("MIT-NAME",), None),
    ("mit-spdx", "MIT", ("SPDX-MIT",), None),
    ("mit-text", "MIT", ("MIT-GRANT", "MIT-NOTICE"), None),
    ("apache-2.0-name", "Apache-2.0", ("APACHE2-NAME",), None),
    ("apache-2.0-spdx", "Apache-2.0", ("SPDX-Apache-2.0",), None),
    ("apache-2.0-header", "Apache-2.0", ("APACHE2-NAME", "APACHE2-COMPLY", "APACHE2-COPY"), None),
    ("apache-2.0-text", "Apache-2.0", ("APACHE2-TITLE", "APACHE2-GRANT"), None),
    ("gpl-2.0-name", "GPL-2.0", ("GPL2-NAME",), None),
    ("gpl-2.0-spdx", "GPL-2.0", ("SPDX-GPL-2.0",), None),
    ("gpl-2.0-header", "GPL-2.0", ("GPL2-FREE", "GPL-HOPE"), None),
    ("gpl-2.0-text", "GPL-2.0", ("GPL2-TITLE", "GPL2-FREEDOM"), None),
    ("gpl-3.0-name", "GPL-3.0", ("GPL3-NAME",), None),
    ("gpl-3.0-spdx", "GPL-3.0", ("SPDX-GPL-3.0",), None),
    ("gpl-3.0-header", "GPL-3.0", ("GPL-FREE", "GPL-HOPE"), None),
    ("gpl-3.0-text", "GPL-3.0", ("GPL3-TITLE", "GPL3-COPYLEFT"), None),
    ("lgpl-2.1-spdx", "LGPL-2.1", ("SPDX-LGPL-2.1",), None),
    ("lgpl-2.1-header", "LGPL-2.1", ("LGPL21-FREE", "GPL-HOPE"), None),
    ("lgpl-3.0-spdx", "LGPL-3.0", ("SPDX-LGPL-3.0",), None),
    ("lgpl-3.0-header", "LGPL-3.0", ("LGPL3-FREE", "GPL-HOPE"), None),
    ("lgpl-3.0-text", "LGPL-3.0", ("LGPL3-TITLE", "LGPL3-TEXT"), None),
    ("agpl-3.0-spdx", "AGPL-3.0", ("SPDX-AGPL-3.0",), None),
    ("agpl-3.0-header", "AGPL-3.0", ("AGPL3-FREE", "GPL-HOPE"), None),
    ("mpl-2.0-name", "MPL-2.0", ("MPL2-TITLE",), None),
    ("mpl-2.0-spdx", "MPL-2.0", ("SPDX-MPL-2.0",), None),
    ("mpl-2.0-header", "MPL-2.0", ("MPL2-FORM", "MPL2-COPY"), None),
    ("bsd-2-clause-spdx", "BSD-2-Clause", ("SPDX-BSD-2-Clause",), None),
    ("bsd-2-clause", "BSD-2-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY"), "BSD-NAMES"),
    ("bsd-3-clause-spdx", "BSD-3-Clause", ("SPDX-BSD-3-Clause",), None),
    ("bsd-3-clause", "BSD-3-Clause", ("BSD-GRANT", "BSD-SOURCE", "BSD-BINARY", "BSD-NAMES"), None),
    ("isc-spdx", "ISC", ("SPDX-ISC",), None),
    ("isc-text", "ISC", ("ISC-GRANT",), None),
    ("unlicense-spdx", "Unlicense", ("SPDX-Unlicense",), None),
    ("unlicense-text", "Unlicense", ("UNLICENSE-DOMAIN", "UNLICENSE-FREE"), None),
    ("zlib-spdx", "Zlib", ("SPDX-Zlib",), None),
    ("zlib-text", "Zlib", ("ZLIB-AS-IS", "ZLIB-GRANT"), None),
    ("boost-spdx", "BSL-1.0", ("SPDX-BSL-1.0",), None),
    ("boost-text", "BSL-1.0", ("BOOST-GRANT",), None),
    ("cc-by-nc-4.0-name", "CC-BY-NC-4.0", ("CCBYNC4-NAME",), None),
    ("cc-by-nc-4.0-spdx", "CC-BY-NC-4.0", ("SPDX-CC-BY-NC-4.0",), None),
    ("cc-by-4.0-name", "CC-BY-4.0", ("CCBY4-NAME",), None),
    ("cc-by-4.0-spdx", "CC-BY-4.0", ("SPDX-CC-BY-4.0",), None),
    ("all-rights-reserved", "Proprietary", ("RESERVED",), None),
)

#: The SQL's sentences end at a line's end, at ; or : and at . ! ? before white space or the text's end.
_BREAK = r"[.!?]+([ \t\r]|$)|[.!?]*\n+|[;:]"
#: No sentence goes over . ! ? before white space or the text's end, nor over an empty line.
_STOP = r"[.!?]+([ \t\r\n]|$)|\n[ \t\r]*\n"
#: Every known sentence holds one of these.
_CUE = r"(?i)licen|permission|copyright|warranty|redistribut|reserved|unencumbered|anyone is|of the mpl|cc[^a-z0-9]+by|neither the name"
#: What sentences may hold beside their fixed words: a list's mark before them; the name of the program in notices of the GNU
#: licences; the holder's name in the third rule of BSD; what is licensed before a licence's name, and where to see it. Each is
#: a pattern of words and what stands for it in the table; of a sentence with `not` no licence's name is told.
_MARK = "(?:[0-9]{1,2}|[a-z]|[ivx]{2,4}) "
_NAMED = "mit license|apache license version 2 0|gnu general public license version [23]|cc by nc 4 0|cc by 4 0|creative commons attribution noncommercial 4 0 international license"
_SEE = "(?: see(?: [a-z0-9]+){1,8})?"
_FORMS = (
    ("(?:[a-z0-9]+ ){1,8}?(is free software you can redistribute it .*)", "this program {1}"),
    ("(?:[a-z0-9]+ ){1,8}?(is distributed in the hope that it will be useful .*)", "this program {1}"),
    ("neither the name of (?:[a-z0-9]+ ){1,12}?nor the names of (?:its )?contributors (may be used .*)", "neither the name of the copyright holder nor the names of its contributors {1}"),
    ("(?:[a-z0-9]+ ){0,8}?(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(" + _NAMED + ")" + _SEE, "licensed under the {1}"),
)


def _plain(words: str) -> str:
    """A sentence of the table with what stands for names."""
    for pattern, new in _FORMS:
        if (m := re.fullmatch(pattern, words)) and not re.search(r"\bnot\b.* under ", words):
            return new.replace("{1}", m[1])
    return words


#: Plain sentences and their identifiers; several sentences of the table may come to one.
TABLE = {_plain(words): name for name, some in SENTENCES.items() for words in some}
_SPDX_START = "spdx license identifier "
_SPDX = "|".join(sorted((w.removeprefix(_SPDX_START) for w in TABLE if w.startswith(_SPDX_START)), key=len, reverse=True))
_EXPRESSION = f"{_SPDX_START}(?:{_SPDX})(?: (?:or|and) (?:{_SPDX}))+"
_LONGEST = sorted({words for some in SENTENCES.values() for words in some} | {*TABLE}, key=len, reverse=True)


def _spread() -> str:
    """The forms as parts of the pattern of known sentences: what is free in them is any words, what is fixed is the table's."""
    ends = lambda start: "|".join(w[len(start) :] for w in sorted(TABLE, key=len, reverse=True) if w.startswith(start))
    holder = "neither the name of the copyright holder nor the names of its contributors "
    some = [
        f"(?:[a-z0-9]+ ){{1,8}}?(?:{ends('this program ')})", f"neither the name of (?:[a-z0-9]+ ){{1,12}}?nor the names of (?:its )?contributors (?:{ends(holder)})",
        f"(?:(?!not )[a-z0-9]+ ){{0,8}}?(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:{_NAMED}){_SEE}",
    ]
    return "|".join([_EXPRESSION, *some])


#: A known sentence in a text whose lines and parts at : and ; are set off by |.
_KNOWN = r"(?<=\|)(?:" + re.sub(" (?!\\?)", "[ |]", f"(?:{_MARK})?(?:" + _spread() + "|" + "|".join(_LONGEST) + ")") + r")(?=\|)"


def marked(block: Column) -> Column:
    """Normalised words of what stands between two stops; |, also at both ends, is a line's end, : or ;."""
    parts = F.translate(F.lower(block), "|:;\n", " |||")
    words = F.regexp_replace(F.concat(F.lit("|"), parts, F.lit("|")), "[^a-z0-9|]+", " ")
    return F.regexp_replace(words, r" ?\|[ |]*", "|")


def sentence_ids(text: Column) -> Column:
    """Identifiers, in order, of the sentences of a whole text that the fixed table holds; an empty list for null texts.

    Of known sentences that begin at one place the longest counts, and none that begins within another.
    """
    fixed = F.create_map(*[F.lit(x) for pair in TABLE.items() for x in pair])
    blocks = F.filter(F.split(text, _STOP), lambda b: b.rlike(_CUE))
    found = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(marked(b), F.lit(_KNOWN), F.lit(0))))
    names = F.flatten(F.transform(found, lambda x: F.transform(_sentences(F.translate(x, "|", " ")), lambda w: F.try_element_at(fixed, w))))
    return F.coalesce(F.when(text.rlike(_CUE), F.array_compact(names)), F.array().cast("array<string>"))


def _sentences(words: Column) -> Column:
    """The plain sentences of a known one: without its mark, with what stands for names; an expression of several licences is
    a sentence for each."""
    bare = F.when(F.lit(False), words)
    for pattern, new in _FORMS:
        bare = bare.when(_own(words).rlike(f"^{pattern}$"), F.regexp_replace(_own(words), f"^{pattern}$", new.replace("{1}", "$1")))
    several = F.transform(F.regexp_extract_all(_own(words), F.lit(f"(?<= )(?:{_SPDX})(?= |$)"), F.lit(0)), lambda n: F.concat(F.lit(_SPDX_START), n))
    return F.when(_own(words).rlike(f"^{_EXPRESSION}$"), several).otherwise(F.array(bare.otherwise(_own(words))))


def _own(words: Column) -> Column:
    """The words without a list's mark, unless they are known with it."""
    return F.when(words.isin(*TABLE), words).otherwise(F.regexp_replace(words, f"^{_MARK}", ""))


def _pattern(parts: tuple[str, ...], unless: str | None) -> str:
    """What a line of identifiers, each after and before a comma, must hold for a rule."""
    return "," + ",(?:[^,]+,)*".join(parts) + "," + (f"(?!{unless},)" if unless else "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, rules, licenses) of the rows with a known sentence, lists joined by commas.

    sentence_ids are in the order of the text, each as often as it comes, but a run of one as one; a rule matches if its
    identifiers follow each other in that order, others between them or not. Of a licence's matching rules only the one of
    highest precedence is told. rules and licenses are sorted. Texts without a known sentence, null ones too, have no row;
    repeated rows have a row each, and a null id is kept; an empty table gives no rows.
    """
    every = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("ids")).where(F.size("ids") > 0)
    runs = F.filter("ids", lambda x, i: (i == 0) | (x != F.get("ids", i - 1)))
    line = every.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join(runs, ",").alias("sentence_ids"))
    padded = F.concat(F.lit(","), "sentence_ids", F.lit(","))
    hits = [
        F.when(padded.rlike(_pattern(parts, unless)), F.struct(F.lit(rule).alias("rule"), F.lit(name).alias("name"), F.lit(k).alias("k")))
        for k, (rule, name, parts, unless) in enumerate(RULES)
    ]
    matched = line.withColumn("m", F.array_compact(F.array(*hits)))
    best = F.filter("m", lambda h: ~F.exists("m", lambda o: (o["name"] == h["name"]) & (o["k"] > h["k"])))
    listed = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(best, lambda h: h[part]))), ",")
    return matched.select("doc_id", "n_sentences", "sentence_ids", listed("rule").alias("rules"), listed("name").alias("licenses"))


def scan_sql() -> str:
    """DuckDB SQL for scan() over the table documents; what must not come after is put as all that may."""
    fixed = ", ".join(f"('{words}', '{name}')" for words, name in TABLE.items())
    known = ", ".join(f"'{words}'" for words in TABLE)
    plain_form = "CASE " + " ".join(f"WHEN regexp_full_match(w, '{p}') AND NOT regexp_matches(w, '(^| )not .* under ') THEN regexp_replace(w, '^{p}$', '{n.replace('{1}', chr(92) + '1')}')" for p, n in _FORMS) + " ELSE w END"
    after = lambda unless: "($|(" + "|".join(n.replace(".", "[.]") for n in SENTENCES if n != unless) + "),)" if unless else ""
    plain = lambda parts: "," + ",([^,]+,)*".join(p.replace(".", "[.]") for p in parts) + ","
    rules = ", ".join(f"({k}, '{rule}', '{name}', '{plain(parts) + after(unless)}')" for k, (rule, name, parts, unless) in enumerate(RULES))
    return rf"""
    WITH fixed(words, sentence_id) AS (VALUES {fixed}), rules(k, rule, name, pattern) AS (VALUES {rules}),
    cut AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(text, '{_BREAK}', chr(10), 'g'), chr(10)) AS parts
            FROM documents WHERE text IS NOT NULL),
    sentences AS (SELECT r, doc_id, unnest(range(len(parts))) AS place, unnest(parts) AS sentence FROM cut),
    spelled AS (SELECT r, doc_id, place, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS v FROM sentences WHERE regexp_matches(sentence, '{_CUE}')),
    own AS (SELECT r, doc_id, place, CASE WHEN v IN ({known}) THEN v ELSE regexp_replace(v, '^{_MARK}', '') END AS w FROM spelled),
    each AS (SELECT r, doc_id, place, w FROM (SELECT r, doc_id, place, {plain_form} AS w FROM own)),
    found AS (SELECT r, doc_id, place, sentence_id FROM each JOIN fixed ON fixed.words = w),
    marked AS (SELECT *, sentence_id IS DISTINCT FROM lag(sentence_id) OVER (PARTITION BY r ORDER BY place) AS fresh FROM found),
    lines AS (SELECT r, doc_id, count(*)::BIGINT AS n_sentences, string_agg(sentence_id, ',' ORDER BY place) FILTER (fresh) AS sentence_ids FROM marked GROUP BY r, doc_id),
    hits AS (SELECT r, rule, name FROM lines JOIN rules ON regexp_matches(',' || sentence_ids || ',', pattern) QUALIFY k = max(k) OVER (PARTITION BY r, name)),
    named AS (SELECT r, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM hits GROUP BY r)
    SELECT doc_id, n_sentences, sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
    FROM lines LEFT JOIN named USING (r)
    """
