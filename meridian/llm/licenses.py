"""License scans by sentence rules, in SQL functions only.

A text is cut into sentences, each normalised and mapped to the identifier of a known licence sentence if it is
one; the sequence of identifiers is then matched against ordered licence rules. Sentences are read once with
line ends as boundaries and once across them, since licence texts are wrapped. A scan is one map over the rows.

Known sentences are cut as texts are, so that each is found by its pieces whatever marks it holds. Rules are tried in
order, longer ones before those that they contain; the sentences that a rule matches are taken out of the sequence,
and a rule that matched one reading is passed over where the other reading shows it to be part of a longer rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence notices, by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3-semicolon": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl21-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-grant": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-joined": "This Source Code Form is subject to the terms of the Mozilla Public License, v.2.0.",
    "epl-grant": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "bsl-grant": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd0-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
}

#: licence, class, sentences that must follow one another (known others may lie between). A rule stands before those
#: whose sentences it contains.
RULES = (
    ("Apache-2.0", "permissive", ("apache-grant", "apache-copy", "apache-warranty", "apache-limits")),
    ("Apache-2.0", "permissive", ("apache-grant", "apache-copy")),
    ("Apache-2.0", "permissive", ("apache-grant",)),
    ("Apache-2.0", "permissive", ("apache-short",)),
    ("MIT", "permissive", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", "permissive", ("mit-title",)),
    ("MIT", "permissive", ("mit-short",)),
    ("MIT", "permissive", ("mit-licensed",)),
    ("ISC", "permissive", ("isc-grant",)),
    ("0BSD", "permissive", ("bsd0-grant",)),
    ("BSD-3-Clause", "permissive", ("bsd-grant", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", "permissive", ("bsd-grant", "bsd-warranty")),
    ("Zlib", "permissive", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", "permissive", ("bsl-grant",)),
    ("GPL-3.0-or-later", "copyleft", ("gpl3-grant", "gpl-warranty")),
    ("GPL-3.0-or-later", "copyleft", ("gpl3-semicolon", "gpl-warranty")),
    ("GPL-2.0-or-later", "copyleft", ("gpl2-grant", "gpl-warranty")),
    ("GPL-2.0-only", "copyleft", ("gpl2-only", "gpl-warranty")),
    ("GPL-3.0-only", "copyleft", ("gpl3-short",)),
    ("LGPL-2.1-or-later", "copyleft", ("lgpl21-grant", "lgpl-warranty")),
    ("LGPL-3.0-or-later", "copyleft", ("lgpl3-grant", "gpl-warranty")),
    ("AGPL-3.0-or-later", "copyleft", ("agpl3-grant", "gpl-warranty")),
    ("MPL-2.0", "copyleft", ("mpl-grant",)),
    ("MPL-2.0", "copyleft", ("mpl-joined",)),
    ("EPL-2.0", "copyleft", ("epl-grant",)),
    ("CC-BY-4.0", "attribution", ("cc-by",)),
    ("CC-BY-4.0", "attribution", ("cc-by-work",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", "copyleft", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", "noncommercial", ("cc-by-nc-work",)),
    ("CC-BY-ND-4.0", "noderivatives", ("cc-by-nd",)),
    ("CC0-1.0", "public-domain", ("cc0",)),
    ("Unlicense", "public-domain", ("unlicense-domain", "unlicense-grant")),
    ("Unlicense", "public-domain", ("unlicense-domain",)),
    ("Proprietary", "reserved", ("reserved",)),
)

#: Every known sentence has one of these, so a text without them has none.
TRIGGER = "[Ll][Ii][Cc][Ee][Nn][Ss]|[Pp][Ee][Rr][Mm][Ii][Ss]|[Cc][Oo][Pp][Yy]|[Ww][Aa][Rr][Rr][Aa][Nn]|[Rr][Ee][Ss][Ee][Rr][Vv]|[Rr][Ee][Dd][Ii][Ss][Tt][Rr]|[Ll][Ii][Aa][Bb][Ll][Ee]|[Uu][Nn][Ee][Nn][Cc][Uu][Mm][Bb]"
_BLANK = "[\\x09-\\x0D\\x20]"
#: A sentence ends at one of these marks before a blank.
_END = f"([.!?:]){_BLANK}+"


def normal(sentence: str) -> str:
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip(" ").lower()


def _pieces() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Identifiers by the normalised pieces of the known sentences, and each sentence's as a sequence: its own name, or
    that with a number where a mark cuts it. A piece that an earlier sentence has goes by that one's identifier."""
    names: dict[str, str] = {}
    of = {}
    for k, s in SENTENCES.items():
        parts = [normal(x) for x in re.sub(_END, r"\1\n", s).split("\n")]
        of[k] = tuple(names.setdefault(x, k if len(parts) == 1 else f"{k}/{i + 1}") for i, x in enumerate(parts))
    return names, of


#: Identifiers by normalised piece; each sentence as identifiers; each identifier's sign, one character, in a sequence.
PIECES, _OF = _pieces()
_SIGN = {k: chr(0x4E00 + i) for i, k in enumerate(PIECES.values())}
#: (licence, class, signs) by rule.
SIGNED = tuple((name, kind, "".join(_SIGN[i] for k in ids for i in _OF[k])) for name, kind, ids in RULES)


def pattern(signs: str) -> str:
    """Matches signs that follow one another, the first not again before the last; what lies between is kept as groups."""
    return f"([^{signs[0]}]*?)".join(signs)


def kept_groups(signs: str, mark: str) -> str:
    return "".join(f"{mark}{i}" for i in range(1, len(signs)))


def longer() -> dict[int, list[int]]:
    """For each rule, the rules of other licences whose signs contain its signs in order."""

    def within(a: str, b: str) -> bool:
        rest = iter(b)
        return all(x in rest for x in a)

    return {i: [j for j, (m, _, y) in enumerate(SIGNED) if m != n and len(y) > len(x) and within(x, y)] for i, (n, _, x) in enumerate(SIGNED)}


def _ids(text: Column) -> Column:
    """Identifiers of the known pieces of a text, in order; a line end is a boundary."""
    known = F.create_map(*[F.lit(x) for kv in PIECES.items() for x in kv])
    lines = F.split(F.regexp_replace(text, _END, "$1\n"), "\n", -1)
    plain = F.transform(lines, lambda s: F.lower(F.trim(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))))
    return F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda k: k.isNotNull())


def _matched(ids: str) -> str:
    """Which rules match a sequence of identifiers, as an array of booleans in SQL: each takes its sentences away."""
    sign = ", ".join(f"'{k}', '{x}'" for k, x in _SIGN.items())
    rules = ", ".join(f"struct('{pattern(x)}' as p, '{kept_groups(x, '$')}' as g)" for _, _, x in SIGNED)
    start = f"named_struct('s', array_join(transform({ids}, k -> element_at(map({sign}), k)), ''), 'out', cast(array() as array<boolean>))"
    step = "named_struct('s', regexp_replace(a.s, r.p, r.g), 'out', concat(a.out, array(regexp_like(a.s, r.p))))"
    return f"aggregate(array({rules}), {start}, (a, r) -> {step}).out"


def recognise(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence_ids, licenses, classes) of documents(doc_id, text), arrays in the order of text and of RULES.

    sentence_ids is the longer of the two readings, the one by lines where they are equal. A rule holds if either
    reading has its sentences in order, no earlier rule having taken them, unless it was found in one reading alone and
    the other has a rule of another licence that contains it. Null and empty texts have none; every row, repeated ones
    too, gives one; a very long text is read whole; other columns are ignored.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce("text", F.lit(""))
    thin = F.regexp_replace(text, "[\\x20\\x09\\x0D]+", " ")
    across = F.regexp_replace(F.regexp_replace(thin, "\n ?\n", ".\u0085"), " ?\n ?", " ")
    hit = text.rlike(TRIGGER)
    out = documents.select("doc_id", F.when(hit, _ids(text)).otherwise(none).alias("a"), F.when(hit, _ids(F.regexp_replace(across, "\u0085", "\n"))).otherwise(none).alias("b"))
    out = out.selectExpr("doc_id", "CASE WHEN size(b) > size(a) THEN b ELSE a END as sentence_ids", *[f"CASE WHEN size({x}) > 0 THEN {_matched(x)} END as {x}" for x in "ab"])
    either = []
    for i, others in longer().items():
        a, b = f"coalesce(a[{i}], false)", f"coalesce(b[{i}], false)"
        more = [" or ".join(f"coalesce({x}[{j}], false)" for j in others) or "false" for x in "ab"]
        either.append(f"CASE WHEN ({a} and {b}) or ({a} and not ({more[1]})) or ({b} and not ({more[0]})) THEN named_struct('license', '{SIGNED[i][0]}', 'class', '{SIGNED[i][1]}') END")
    rules = f"CASE WHEN size(sentence_ids) > 0 THEN filter(array({', '.join(either)}), r -> r is not null) ELSE cast(array() as array<struct<license:string,class:string>>) END as rules"
    out = out.selectExpr("doc_id", "sentence_ids", rules)
    return out.selectExpr("doc_id", "sentence_ids", "array_distinct(transform(rules, r -> r.license)) as licenses", "array_distinct(transform(rules, r -> r.class)) as classes")
