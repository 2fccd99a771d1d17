"""License scans: winnowed fingerprints of license templates in an inverted index pick candidates, and banded alignment
reports how much of a template a text holds, and where.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmerge.llm.align import GramTable, align
from fieldmerge.llm.common import PUNCTUATION, text_blocks, word_grams, words

#: Words of a fingerprint, and successive fingerprints of which the smallest is indexed: GRAM + WINDOW - 1 common words
#: of a text and a template always meet in the index.
GRAM, WINDOW = 3, 2
#: A text holds a template if so much of it stands there; the band allows for this many words more or less, and a part.
COVERAGE, BAND_WORDS, BAND_PART = 0.75, 6, 0.1

# Notices of public licenses, and titles of their whole texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
        "Apache License, Version 2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU General Public License, version 3",
        "GNU GPL v3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU General Public License, version 2",
        "GNU GPL v2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, Version 2.0."),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
        "Licensed under the BSD License.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "Licensed under the ISC License."),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-3.0": ("Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    "CC-BY-SA-3.0": ("Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "EPL-2.0": ("Licensed under the Eclipse Public License, Version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    "EPL-1.0": ("Licensed under the Eclipse Public License, Version 1.0.", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    "MPL-1.1": ("Licensed under the Mozilla Public License, Version 1.1.",),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.1."),
    "ECL-2.0": ("Licensed under the Educational Community License, Version 2.0.",),
    "EUPL-1.2": ("Licensed under the European Union Public License, Version 1.2.", "Licensed under the European Union Public Licence, Version 1.2."),
    "BSL-1.0": ("Licensed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License, Version 1.0."),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-2.0": ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}

#: What tells licenses apart that share their other words: those of these phrases that a notice holds stand in its place too, word by word.
TELLING: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",), "BSD": ("BSD License",), "ISC": ("ISC License",), "Apache-2.0": ("Apache License", "2 0"), "Apache-1.1": ("Apache License", "Apache Software License", "1 1"),
    "GPL-3.0": ("GNU General Public License", "version 3"), "GPL-2.0": ("GNU General Public License", "version 2"), "AGPL-3.0": ("GNU Affero General Public License", "version 3"),
    "LGPL-3.0": ("GNU Lesser General Public License", "version 3"), "LGPL-2.1": ("GNU Lesser General Public License", "version 2 1"), "LGPL-2.0": ("GNU Library General Public License", "version 2"),
    "MPL-2.0": ("Mozilla Public License", "2 0"), "MPL-1.1": ("Mozilla Public License", "1 1"), "EPL-2.0": ("Eclipse Public License", "2 0"), "EPL-1.0": ("Eclipse Public License", "version 1 0", "v1 0"),
    "ECL-2.0": ("Educational Community License", "2 0"), "EUPL-1.2": ("European Union Public", "1 2"), "BSL-1.0": ("Boost Software License", "1 0"),
    "CC-BY-4.0": ("CC BY 4 0", "Attribution 4 0"), "CC-BY-SA-4.0": ("CC BY SA 4 0", "Attribution ShareAlike 4 0"), "CC-BY-NC-4.0": ("CC BY NC 4 0", "Attribution NonCommercial 4 0"), "CC-BY-ND-4.0": ("CC BY ND 4 0", "Attribution NoDerivatives 4 0"),
    "CC-BY-NC-SA-4.0": ("CC BY NC SA 4 0", "Attribution NonCommercial ShareAlike 4 0"), "CC-BY-NC-ND-4.0": ("CC BY NC ND 4 0", "Attribution NonCommercial NoDerivatives 4 0"), "CC-BY-3.0": ("CC BY 3 0", "Attribution 3 0"), "CC-BY-SA-3.0": ("CC BY SA 3 0", "Attribution ShareAlike 3 0"),
}


#: A notice that follows one of these words in its own sentence, at most so many words before, says what isn't granted.
_DENIED, BEFORE = re.compile(rb"\b(?:not|never|neither|nor|cannot|without)\b[^.;:!?\r\n]*$", re.I), 4


def _holds(text: np.ndarray, phrase: np.ndarray) -> bool:
    return len(text) >= len(phrase) and bool((np.lib.stride_tricks.sliding_window_view(text, len(phrase)) == phrase).all(axis=1).any())


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Indices of the fingerprints: the smallest (ties: the last) of each WINDOW successive grams, or of all if fewer."""
    if not len(grams):
        return np.zeros(0, np.int64)
    if len(grams) < WINDOW:
        return np.array([int(grams.argmin())])
    seen = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(seen)) + WINDOW - 1 - seen[:, ::-1].argmin(axis=1))


class Templates:
    """The templates' words, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names = [n for n, texts in templates.items() for _ in texts]
        texts = pa.array([t for texts in templates.values() for t in texts], pa.string())
        self.words, grams, owner, place = [], [], [], []
        for i, end, data, at in text_blocks(texts):
            hashes, _, _, rows = words(data, at, PUNCTUATION)
            found, _, offsets = word_grams(hashes, rows, GRAM)
            for r in range(end - i):
                own = found[offsets[r] : offsets[r + 1]]
                picked = winnowed(own)
                self.words.append(hashes[rows[r] : rows[r + 1]])
                grams.append(own[picked])
                owner.append(np.full(len(picked), len(self.words) - 1))
                place.append(picked)
        self.telling = []
        for name, held in zip(self.names, self.words, strict=True):
            phrases = TELLING.get(name, ())
            _, _, data, at = next(text_blocks(pa.array(phrases, pa.string())), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
            hashes, _, _, rows = words(data, at, PUNCTUATION)
            self.telling.append([p for p in np.split(hashes, rows[1:-1]) if len(p) and _holds(held, p)])
        none = np.zeros(0, np.int64)
        self.index = GramTable(np.concatenate([*grams, none.astype(np.uint64)]), np.concatenate([*owner, none]), np.concatenate([*place, none]))


def _places(query: np.ndarray, telling: list[np.ndarray], text: np.ndarray, first: int, end: int, low: int, high: int) -> list[tuple[int, int, int]]:
    """(matched words, first word, end word) of the places in text[first:end] that hold enough of query and the phrases that tell it, along the diagonals low to high."""
    found, open_parts = [], [(first, end)]
    while open_parts:
        i, j = open_parts.pop()
        if j - i < COVERAGE * len(query) or np.isin(query, text[i:j]).sum() < COVERAGE * len(query):
            continue
        best = align(query, text[i:j], low - i, high - i)
        if not best.matched:
            continue
        x, y = i + best.first[1], i + best.end[1]
        if best.matched >= COVERAGE * len(query) and all(_holds(text[x:y], p) for p in telling):
            found.append((best.matched, x, y))
        open_parts += [(i, x), (y, j)]
    return found


def spans_in(own: Templates, text: np.ndarray, at: np.ndarray, entries: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matched words, first word, end word) of the templates of which the text holds enough.

    Hits of a template whose diagonals lie within its band make one candidate, or several where they spread over more
    diagonals than it has words; the template is aligned with the text in that band, then with what is left and right of
    the place found, so that a repeated notice counts at each place. A span of which more than half lies in one with more matching words (ties: the larger coverage, then the
    first) isn't reported, so a notice counts for the template it is nearest to."""
    owner = own.index.owner[entries]
    diagonal = at - own.index.place[entries]
    order = np.lexsort((diagonal, owner))
    new = (np.diff(owner[order]) != 0) | (np.diff(diagonal[order]) > BAND_WORDS)
    spans: dict[int, list[tuple[int, int, int]]] = {}
    for chain in np.split(order, np.flatnonzero(new) + 1):
        k = int(owner[chain[0]])
        query = own.words[k]
        band = BAND_WORDS + int(BAND_PART * len(query))
        pieces = (diagonal[chain] - diagonal[chain[0]]) // len(query)
        for part in np.split(chain, np.flatnonzero(np.diff(pieces)) + 1):
            low, high = int(diagonal[part].min()) - band, int(diagonal[part].max()) + band
            spans.setdefault(k, []).extend(_places(query, own.telling[k], text, max(0, low), min(len(text), high + len(query)), low, high))
    kept: list[tuple[int, int, int, int]] = []
    for m, i, j, k in sorted({(*span, k) for k, found in spans.items() for span in found}, key=lambda s: (-s[0], -s[0] / len(own.words[s[3]]), s[1:])):
        if all(2 * (min(j, other[2]) - max(i, other[1])) <= j - i for other in kept):
            kept.append((m, i, j, k))
    return [(k, m / len(own.words[k]), m, i, j) for m, i, j, k in sorted(kept, key=lambda s: s[1:])]


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, license, template (its number), coverage, matched_words, first_byte, end_byte and excerpt for each place of a
    document (doc_id, text) that holds COVERAGE of a template's words in order, and what TELLING asks for, but for places
    that deny it (not licensed under ...).

    Words are runs of letters and digits, A-Z lower-cased. Templates of fewer than GRAM words and null or empty texts match
    nothing. An empty table gives no rows. The templates (a parameter of
    the program, not a table) go to every task."""
    model = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        own = model.value
        for b in batches:
            for i, _, data, at in text_blocks(b.column(1)):
                hashes, start, end, rows = words(data, at, PUNCTUATION)
                grams, first, offsets = word_grams(hashes, rows, GRAM)
                hit, entries = own.index.find(grams)
                doc = np.searchsorted(offsets, hit, "right") - 1
                out = []
                for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
                    d = int(doc[part[0]])
                    for k, coverage, matched, w0, w1 in spans_in(own, hashes[rows[d] : rows[d + 1]], first[hit[part]] - rows[d], entries[part]):
                        x, y = int(start[rows[d] + w0]), int(end[rows[d] + w1 - 1])
                        if _DENIED.search(data[int(start[rows[d] + max(0, w0 - BEFORE)]) : x].tobytes()):
                            continue
                        out.append((i + d, own.names[k], k, coverage, matched, x - int(at[d]), y - int(at[d]), data[x:y].tobytes().decode("utf-8", "replace")))
                c = list(zip(*out, strict=True)) or [[]] * 8
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(c[0], pa.int64())), *(pa.array(x, t) for x, t in zip(c[1:], kinds, strict=True))], ["doc_id", "license", "template", "coverage", "matched_words", "first_byte", "end_byte", "excerpt"])

    schema = f"doc_id {kind}, license string, template int, coverage double, matched_words int, first_byte long, end_byte long, excerpt string"
    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(scan, schema)
