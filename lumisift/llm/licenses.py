"""Licence scans by sentence rules.

Sentences are normalised (lower case, runs of letters and digits, one space between) and mapped to
identifiers of known licence sentences, at whatever word of the text they begin: marks, line ends,
comment signs and indentation are no words. A long sentence is known too if at most a tenth of its words, whole ones,
are missing, added or changed, none of them with a digit. Where known sentences overlap the one with more words that fit counts. Rules are ordered sequences of identifiers;
they are matched against the identifiers in their order in the text, from left to right, the first
rule that fits winning, with at most GAP words between two sentences.

Sentences about a licence by its SPDX identifier or one of its names are made by rule from NAMES.

Null and empty texts have no licences. Whole texts are read. Repeated rows are scanned alike. Where
two rules fit at one place, the one that stands first counts; rules stand longest first.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumisift.llm.common import id_text, slices

#: Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-title-full": "The MIT License (MIT)",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-program": "This program is licensed under the GNU General Public License, version 3.",
    "gpl2-program": "This program is licensed under the GNU General Public License, version 2.",
    "gpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
}
#: Licence and the identifiers that show it, in order.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-title-full", "mit-grant", "mit-notice", "mit-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("Apache-2.0", ("apache-notice", "apache-copy", "apache-warranty")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-warranty", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-warranty", "gpl-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-title",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-only", ("gpl3-program",)),
    ("GPL-2.0-only", ("gpl2-program",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-form",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("Unlicense", ("unlicense",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("0BSD", ("0bsd-grant",)),
    ("WTFPL", ("wtfpl",)),
]
#: SPDX identifiers, and the names under which texts refer to them. The sentences about them are made by rule.
NAMES = {
    "0BSD": ["Zero-Clause BSD License"],
    "AFL-3.0": ["Academic Free License version 3.0"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU AGPL v3.0"],
    "AGPL-3.0-or-later": ["GNU Affero General Public License, version 3 or later"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "BUSL-1.1": ["Business Source License 1.1"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "EUPL-1.2": ["European Union Public Licence 1.2"],
    "Elastic-2.0": ["Elastic License 2.0"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later"],
    "ISC": ["ISC License"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1"],
    "LGPL-2.1-or-later": ["GNU Lesser General Public License, version 2.1 or later"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "LGPL-3.0-or-later": ["GNU Lesser General Public License, version 3 or later"],
    "MIT": ["MIT License"],
    "MIT-0": ["MIT No Attribution License"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan PSL v2"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1"],
    "OSL-3.0": ["Open Software License version 3.0"],
    "PHP-3.01": ["PHP License, version 3.01"],
    "PSF-2.0": ["Python Software Foundation License Version 2"],
    "PostgreSQL": ["PostgreSQL License"],
    "SSPL-1.0": ["Server Side Public License, version 1"],
    "UPL-1.0": ["Universal Permissive License v1.0"],
    "Unlicense": ["Unlicense"],
    "Vim": ["Vim License"],
    "WTFPL": ["Do What The F*ck You Want To Public License"],
    "X11": ["X11 License"],
    "Zlib": ["zlib License"],
}
GAP, NEAR_WORDS, NEAR_SHARE = 60, 12, 10
_WORD = re.compile(r"[^\W_]+")


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def about(names: dict[str, list[str]] = NAMES) -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences by which texts refer to a licence, and the rules for them. A name of two words or more that ends in a licence's word stands for itself after `under`."""
    sentences, rules = {}, []
    for licence, own in names.items():
        forms = [f"SPDX-License-Identifier: {licence}", *(f"under {the}{n}" for n in own for the in ("", "the ", "a ", "the terms of the "))]
        for n, form in enumerate(forms):
            sentences[f"{licence}-about-{n}"] = form
            rules.append((licence, (f"{licence}-about-{n}",)))
    return sentences, rules


def edits(sentence: list[str], words: list[str]) -> tuple[int, int, int]:
    """Fewest words to change, add or leave out between the sentence and a stretch of words; the stretch's start and end. Words with a digit, versions, must be there."""
    row = [(0, j) for j in range(len(words) + 1)]
    for s in sentence:
        price = len(sentence) if any(map(str.isdigit, s)) else 1
        new = [(row[0][0] + price, 0)]
        for j, w in enumerate(words, 1):
            new.append(min((row[j - 1][0] + price * (s != w), row[j - 1][1]), (row[j][0] + price, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    best = min(range(len(row)), key=lambda j: row[j][0])
    return row[best][0], row[best][1], best


class Rules:
    def __init__(self, sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None, gap: int = GAP):
        made, of_made = about()
        sentences, rules = sentences or SENTENCES | made, rules or RULES + of_made
        self.gap, self.known = gap, {}
        for name, s in sentences.items():
            self.known.setdefault(tuple(normalised(s).split()), name)
        same = {name: self.known[tuple(normalised(s).split())] for name, s in sentences.items()}
        self.starting = defaultdict(list)
        for licence, sequence in rules:
            self.starting[same[sequence[0]]].append((licence, tuple(same[i] for i in sequence)))
        #: Sentences by their last two words, and long ones by all their runs of three.
        self.ends, self.runs, self.long = defaultdict(list), defaultdict(list), {}
        for words, name in sorted(self.known.items(), key=lambda k: -len(k[0])):
            self.ends[words[-2:]].append((words, name))
            if len(words) >= NEAR_WORDS:
                self.long[name] = list(words)
                for i, run in enumerate(zip(words, words[1:], words[2:], strict=False)):
                    self.runs[run].append((name, i))
        self.single = {w[0]: n for w, n in self.known.items() if len(w) == 1}
        self.fewest = min((self.least(w) for w in self.long.values()), default=1)
        self.ends, self.runs = dict(self.ends), dict(self.runs)

    @staticmethod
    def least(words: list[str]) -> int:
        """Runs of three that stay whole, whichever words are edited."""
        return max(1, len(words) - 2 - 3 * (len(words) // NEAR_SHARE))

    def sentences(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """Known sentences in order: number of the first word and of the one behind, identifier, first and end code point."""
        low = _WORD.findall(text.lower())
        some = not self.ends.keys().isdisjoint(zip(low, low[1:], strict=False)) or not self.single.keys().isdisjoint(low)
        if not some and len(self.runs.keys() & set(zip(low, low[1:], low[2:], strict=False))) < self.fewest:
            return []
        at = list(_WORD.finditer(text))  # lower case may have other lengths than the text
        words = [m[0].lower() for m in at]
        if len(words) != len(low):
            words = [normalised(w) for w in words]
        return [(begin, end, name, at[begin].start(), at[end - 1].end()) for begin, end, name in self.matches(words)]

    def matches(self, words: list[str]) -> list[tuple[int, int, str]]:
        found = [(i, i + 1, self.single[w], 0) for i, w in enumerate(words) if w in self.single]
        for i, pair in enumerate(zip(words, words[1:], strict=False)):
            for sentence, name in self.ends.get(pair, ()):
                begin = i + 2 - len(sentence)
                if begin >= 0 and tuple(words[begin : i + 2]) == sentence:
                    found.append((begin, i + 2, name, 0))
        hits = defaultdict(list)
        for i, run in enumerate(zip(words, words[1:], words[2:], strict=False)):
            for name, offset in self.runs.get(run, ()):
                hits[name].append((i - offset, i))
        for name, own in hits.items():
            sentence = self.long[name]
            most, need = len(sentence) // NEAR_SHARE, self.least(sentence)
            own.sort()
            # places whose begin differs by no more than the edits belong together
            for k in range(len(own) - need + 1):
                if own[k + need - 1][0] - own[k][0] <= 2 * most and (k == 0 or own[k][0] != own[k - 1][0]):
                    low = max(0, own[k][0] - most)
                    cost, begin, end = edits(sentence, words[low : own[k][0] + 2 * most + len(sentence) + most])
                    if cost <= most:
                        found.append((low + begin, low + end, name, cost))
        kept: list[tuple[int, int, str]] = []
        taken: set[int] = set()
        for begin, end, name, _ in sorted(set(found), key=lambda f: (f[0] - f[1] + 2 * f[3], f[0], f[2])):
            if taken.isdisjoint(range(begin, end)):
                kept.append((begin, end, name))
                taken.update(range(begin, end))
        return sorted(kept)

    def licences(self, found: list[tuple[int, int, str, int, int]]) -> list[tuple[str, int, int]]:
        """Licence, first and end code point of each place where a rule fits."""
        out, i = [], 0
        while i < len(found):
            for licence, sequence in self.starting.get(found[i][2], ()):
                own = found[i : i + len(sequence)]
                if tuple(f[2] for f in own) == sequence and all(b[0] - a[1] <= self.gap for a, b in zip(own, own[1:], strict=False)):
                    out.append((licence, own[0][3], own[-1][4]))
                    i += len(sequence)
                    break
            else:
                i += 1
        return out


def licences(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """A row for each document: doc_id, licences (distinct, sorted, comma-joined), spans (licence:start:end), sentences (identifiers in order)."""
    sent = docs.sparkSession.sparkContext.broadcast(rules or Rules())  # some hundred kilobytes of rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches):
            names, spans, ids = [], [], []
            for text in batch.column("text").to_pylist():
                found = own.sentences(text) if text else []
                hits = own.licences(found)
                names.append(",".join(sorted({h[0] for h in hits})))
                spans.append(",".join(f"{n}:{s}:{e}" for n, s, e in hits))
                ids.append(",".join(f[2] for f in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.string()) for x in (names, spans, ids))], names=["doc_id", "licences", "spans", "sentences"])

    return id_text(docs).mapInArrow(run, "doc_id long, licences string, spans string, sentences string")
