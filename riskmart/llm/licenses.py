"""Licence scans by sentence rules, with DataFrame functions alone.

A text is cut at blank lines, at line ends, and after a full stop, semicolon or colon with white space behind it; what is between is normalised: A-Z
lower-cased, every run of other characters than letters, digits and dots one space, dots at its ends gone. A known sentence goes from a cut to a cut and may be
wrapped: line ends, with comment marks after them, and marks within it count as a space, blank lines don't. Where several known sentences begin
at a cut, the longest is taken. SENTENCES, put through the same cut, maps sentences to identifiers; RULES are sequences of identifiers in order. A rule matches where its identifiers
follow each other among the known sentences of a text; unknown sentences between them don't matter, other known ones do. Where a longer rule matches, shorter ones
that are part of it are not reported. A gap in a known sentence stands for up to 120 characters without a blank line.

Everything happens within the row of a text, so there is no shuffle and no group. Null and empty texts have no matches and
give no row; a row that occurs twice is reported twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In a known sentence, a gap: words that differ from text to text, such as a holder's name; and what stands for it in a cut sentence.
GAP, _GAP_WORD, _GAP_PATTERN = "<...>", "gapofwords", "{1,120}?"
#: Sentences of licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License", "MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is-mit": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "Apache License 2.0"],
    "apache-header": ["Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License v3.0"],
    "gpl-free": ["This program is free software"],
    "gpl3-grant": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-grant": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "bsd-allowed": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-advert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-endorse": ["Neither the name of <...> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "The name of <...> may not be used to endorse or promote products derived from this software without specific prior written permission", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "gpl2-title": ["GNU General Public License Version 2, June 1991"],
    "gpl3-title": ["GNU General Public License Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "lgpl3-title": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "agpl3-title": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "lgpl-free": ["This library is free software"],
    "lgpl21-grant": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-grant": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "agpl3-grant": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "apache-title": ["Apache License Version 2.0, January 2004"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "mpl2-title": ["Mozilla Public License Version 2.0"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "as-is-isc": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "unlicense-free": ["This is free and unencumbered software released into the public domain"],
    "unlicense-grant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsl1-notice": ["Distributed under the Boost Software License, Version 1.0"],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright to the public domain worldwide", "Released under CC0 1.0", "CC0 1.0 Universal"],
}
#: Rule, licence, identifiers in order.
RULES = [
    ("mit-text", "MIT", ["mit-grant", "mit-condition", "as-is-mit"]),
    ("mit-grant", "MIT", ["mit-grant"]),
    ("mit-notice", "MIT", ["mit-notice"]),
    ("apache-header", "Apache-2.0", ["apache-header", "apache-use", "apache-copy", "apache-as-is"]),
    ("apache-short-header", "Apache-2.0", ["apache-header", "apache-use"]),
    ("apache-notice", "Apache-2.0", ["apache-notice"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl-free", "gpl3-grant", "gpl-hope"]),
    ("gpl3-grant", "GPL-3.0-or-later", ["gpl-free", "gpl3-grant"]),
    ("gpl3-notice", "GPL-3.0-only", ["gpl3-notice"]),
    ("gpl2-header", "GPL-2.0-or-later", ["gpl-free", "gpl2-grant", "gpl-hope"]),
    ("gpl2-grant", "GPL-2.0-or-later", ["gpl-free", "gpl2-grant"]),
    ("bsd-4-text", "BSD-4-Clause", ["bsd-allowed", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse"]),
    ("bsd-3-text", "BSD-3-Clause", ["bsd-allowed", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("bsd-2-text", "BSD-2-Clause", ["bsd-allowed", "bsd-source", "bsd-binary"]),
    ("mpl2-notice", "MPL-2.0", ["mpl2-notice"]),
    ("mpl2-text", "MPL-2.0", ["mpl2-title", "mpl2-notice"]),
    ("mpl2-title", "MPL-2.0", ["mpl2-title"]),
    ("apache-full-text", "Apache-2.0", ["apache-title", "apache-terms", "apache-header", "apache-use", "apache-copy", "apache-as-is"]),
    ("apache-text", "Apache-2.0", ["apache-title", "apache-terms"]),
    ("gpl3-full-text", "GPL-3.0-only", ["gpl3-title", "gnu-verbatim", "gpl-free", "gpl3-grant", "gpl-hope"]),
    ("gpl3-text", "GPL-3.0-only", ["gpl3-title", "gnu-verbatim"]),
    ("gpl2-full-text", "GPL-2.0-only", ["gpl2-title", "gnu-verbatim", "gpl-free", "gpl2-grant", "gpl-hope"]),
    ("gpl2-text", "GPL-2.0-only", ["gpl2-title", "gnu-verbatim"]),
    ("lgpl21-full-text", "LGPL-2.1-only", ["lgpl21-title", "gnu-verbatim", "lgpl-free", "lgpl21-grant", "lgpl-hope"]),
    ("lgpl21-text", "LGPL-2.1-only", ["lgpl21-title", "gnu-verbatim"]),
    ("lgpl21-header", "LGPL-2.1-or-later", ["lgpl-free", "lgpl21-grant", "lgpl-hope"]),
    ("lgpl21-grant", "LGPL-2.1-or-later", ["lgpl-free", "lgpl21-grant"]),
    ("lgpl3-text", "LGPL-3.0-only", ["lgpl3-title", "gnu-verbatim"]),
    ("lgpl3-header", "LGPL-3.0-or-later", ["lgpl-free", "lgpl3-grant", "lgpl-hope"]),
    ("lgpl3-grant", "LGPL-3.0-or-later", ["lgpl-free", "lgpl3-grant"]),
    ("lgpl3-program-grant", "LGPL-3.0-or-later", ["gpl-free", "lgpl3-grant"]),
    ("agpl3-full-text", "AGPL-3.0-only", ["agpl3-title", "gnu-verbatim", "gpl-free", "agpl3-grant", "gpl-hope"]),
    ("agpl3-text", "AGPL-3.0-only", ["agpl3-title", "gnu-verbatim"]),
    ("agpl3-header", "AGPL-3.0-or-later", ["gpl-free", "agpl3-grant", "gpl-hope"]),
    ("agpl3-grant", "AGPL-3.0-or-later", ["gpl-free", "agpl3-grant"]),
    ("isc-text", "ISC", ["isc-grant", "as-is-isc"]),
    ("isc-grant", "ISC", ["isc-grant"]),
    ("0bsd-text", "0BSD", ["0bsd-grant", "as-is-isc"]),
    ("unlicense-text", "Unlicense", ["unlicense-free", "unlicense-grant"]),
    ("unlicense-notice", "Unlicense", ["unlicense-free"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "zlib-grant"]),
    ("bsl1-notice", "BSL-1.0", ["bsl1-notice"]),
    ("epl2-notice", "EPL-2.0", ["epl2-notice"]),
    ("cc-by-nc-4", "CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("cc-by-4", "CC-BY-4.0", ["cc-by-4"]),
    ("cc-by-sa-4", "CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("cc0", "CC0-1.0", ["cc0"]),
]
#: In a text that is cut: the end of a line, of a paragraph, and of what a mark ends.
_LINE, _BLANK, _MARK = "\n", "\r", "\f"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(text: Column) -> Column:
    """The text normalised, with _LINE, _BLANK and _MARK for its cuts, and a cut at both ends."""
    steps = [
        (r"\r\n?", "\n"),
        (r"\f", " "),
        (r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*", _BLANK),
        (r"\n[^\p{L}\p{N}\n]*", _LINE),  # with the comment marks of the next line
        (r"[.;:](?:[ \t\x0B]+\n?|\n)", _MARK),
        (r"[^\p{L}\p{N}.\n\r\f]+", " "),
        (r"(?<![ .])[ .]++(?=[\n\r\f]|\z)", ""),
        (r"(?<=[\n\r\f])[ .]++|\A[ .]++", ""),
        (r"[\n\f]*\r[\n\r\f]*", _BLANK),
        (r"\n*\f[\n\f]*", _MARK),
    ]
    out = F.translate(text, _UPPER, _LOWER)
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit(_BLANK), out, F.lit(_BLANK))


def _plain(x: Column) -> Column:
    return F.trim(F.translate(x, _LINE + _BLANK + _MARK, "   "))


def _known(sentences: dict[str, list[str]], df: DataFrame) -> tuple[Column, str, list[tuple[str, str]]]:
    """A map from sentence to identifier, the pattern of all, and those with a gap: what they look like and the sentence; the sentences are cut by the same expression as the texts, once, here."""
    pairs = [(text.replace(GAP, _GAP_WORD), k) for k, texts in sentences.items() for text in texts]
    rows = df.sparkSession.createDataFrame(pairs, "text string, id string").select(_plain(cut(F.col("text"))).alias("text"), "id").distinct().collect()  # the parameter's own size
    longest = sorted((r.text for r in rows), key=lambda x: (-len(x), x))
    one = "|".join(r"[ \n\f]".join(rf"[^\r]{_GAP_PATTERN}" if w == _GAP_WORD else "\\Q" + w + "\\E" for w in x.split(" ")) for x in longest)
    gaps = [("^" + f".{_GAP_PATTERN}".join("\\Q" + part + "\\E" for part in x.split(_GAP_WORD)) + "$", x) for x in longest if _GAP_WORD in x.split(" ")]
    return F.create_map(*[F.lit(x) for r in sorted(rows) for x in (r.text, r.id)]), rf"(?<=[\n\r\f])(?:{one})(?=[\n\r\f])", gaps


def known_sentences(text: Column, known: tuple[Column, str, list[tuple[str, str]]]) -> Column:
    """The identifiers of a text's known sentences, in order."""
    ids, pattern, gaps = known

    def named(s: Column) -> Column:
        plain = out = _plain(s)
        for look, sentence in gaps:
            out = F.when(plain.rlike(look), F.lit(sentence)).otherwise(out)
        return F.try_element_at(ids, out)

    return F.transform(F.regexp_extract_all(cut(text), F.lit(pattern), F.lit(0)), named)


def scan(df: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rule, license, n_matches, sentence_ids of each rule that matches a text."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    ids = docs.select("doc_id", known_sentences(F.col("text"), _known(sentences, df)).alias("sentence_ids"))
    # Each identifier between bars of its own, so that a sequence is a substring and neighbours share none.
    joined = F.concat(F.lit("|"), F.array_join("sentence_ids", "||"), F.lit("|"))
    keys = ["".join(f"|{x}|" for x in seq) for _, _, seq in rules]

    def own(key: str) -> Column:
        """Matches of a sequence that are not within one of a longer rule. Of each place in a longer one: what stands before and after it there."""
        within = [(k[:at], k[at + len(key) :]) for k in set(keys) if k != key for at in range(len(k) - len(key) + 1) if k.startswith(key, at)]
        covered = "".join(f"(?!{f'(?<=\\Q{before}\\E)' if before else ''}\\Q{key}{after}\\E)" for before, after in sorted(within))
        return F.regexp_count("joined", F.lit(f"{covered}\\Q{key}\\E"))

    found = [F.struct(F.lit(rule).alias("rule"), F.lit(license_).alias("license"), own(key).cast("long").alias("n_matches")) for (rule, license_, _), key in zip(rules, keys, strict=True)]
    matched = ids.withColumn("joined", joined).withColumn("m", F.explode(F.filter(F.array(*found), lambda x: x.n_matches > 0)))
    return matched.select("doc_id", "m.rule", "m.license", "m.n_matches", "sentence_ids")
