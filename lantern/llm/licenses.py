"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import slices
from lantern.llm.text import ALNUM, Words, mix64
from lantern.runtime import small_batches

#: Fixed: notices by which public licenses are applied or granted.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-grant": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: Fixed: further notices, by the words in which headers and readmes use them.
VARIANTS = {
    "Apache-2.0-licensed": "licensed under the Apache License 2.0",
    "Apache-2.0-disclaimer": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-licensed": "licensed under the MIT License",
    "MIT-distributed": "distributed under the MIT License",
    "MIT-available": "available under the MIT License",
    "MIT-terms": "under the terms of the MIT License",
    "MIT-disclaimer": "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "BSD-licensed": "licensed under the BSD License",
    "BSD-3-Clause-licensed": "licensed under the BSD 3-Clause License",
    "BSD-2-Clause-licensed": "licensed under the BSD 2-Clause License",
    "BSD-disclaimer": "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
    "GPL-licensed": "licensed under the GNU General Public License",
    "LGPL-licensed": "licensed under the GNU Lesser General Public License",
    "AGPL-licensed": "licensed under the GNU Affero General Public License",
    "LGPL-grant": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-2.0-grant": "you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "AGPL-grant": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "AGPL-3.0-clause": "if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "EPL-2.0-v": "made available under the terms of the Eclipse Public License v2.0",
    "EPL-1.0": "made available under the terms of the Eclipse Public License v1.0",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-3.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

#: Fixed: templates with much text in common; where they overlap in a document, only those of the highest containment count.
FAMILIES = (
    ("GPL-grant", "LGPL-grant", "LGPL-2.0-grant", "AGPL-grant"),
    ("GPL-1.0-text", "GPL-2.0-text", "LGPL-2.0-text", "LGPL-2.1-text"),
    ("GPL-3.0-text", "AGPL-3.0-clause"),
    ("GFDL-1.2-text", "GFDL-1.3-text"),
    ("MPL-1.1-text", "MPL-2.0-text"),
    ("BSD-2-Clause-text", "BSD-3-Clause-text"),
    ("MIT-text", "Unlicense-text"),
    ("EPL-1.0", "EPL-2.0", "EPL-2.0-v"),
    ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-SA-3.0", "CC-BY-NC-4.0-notice"),
    ("CC-BY-4.0-short", "CC-BY-SA-4.0-short", "CC-BY-NC-4.0"),
)

#: Fixed: the line by which a file names its license, with an expression of identifiers.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9.+-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+-]+\)*)*)", re.IGNORECASE)


def license_templates() -> dict[str, str]:
    """All notices, and the bodies in ``license_texts`` under their names with ``-text``."""
    folder = Path(__file__).with_name("license_texts")
    return NOTICES | VARIANTS | {f"{p.stem}-text": p.read_text() for p in sorted(folder.glob("*.txt"))}


def band_plan(similarity: float, assurance: float = 0.9999, rows: int = 1) -> int:
    """Bands of ``rows`` rows after which sets of that Jaccard similarity share one with the probability ``assurance``."""
    agree = similarity**rows
    return 1 if agree >= assurance else math.ceil(math.log(1 - assurance) / math.log(1 - agree))


class Templates:
    """The shingle sets of the notices by size class, with the least similarity of a window that holds enough of one.

    A class of size T has windows of T shingles and a block, in steps of a block of T / 2, so any run
    of T shingles lies whole in a window. ``bands`` is the most that any class needs.
    """

    def __init__(self, notices: Mapping[str, str], containment: float, width: int, families: Sequence[Sequence[str]] = ()):
        self.names, self.containment, self.width = list(notices), containment, width
        self.family = {self.names.index(n): i for i, names in enumerate(families) for n in names}
        words = Words(list(notices.values()), ALNUM)
        shingles, first = words.shingles(width)
        self.sets = [np.unique(shingles[a:b]) for a, b in zip(first, first[1:], strict=False)]
        self.classes: dict[int, list[int]] = {}
        least = 1.0
        for i, own in enumerate(self.sets):
            if len(own):
                size = 1 << max(0, len(own) - 1).bit_length()
                self.classes.setdefault(size, []).append(i)
                held = math.ceil(containment * len(own))
                least = min(least, held / (self.span(size) * self.block(size) + len(own) - held))
        self.bands = band_plan(least)
        self.seeds = mix64(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.minima = [np.array([(own * s).min() if len(own) else 0 for s in self.seeds], dtype=np.uint64) for own in self.sets]

    @staticmethod
    def block(size: int) -> int:
        return max(1, size // 2)

    @classmethod
    def span(cls, size: int) -> int:
        """Blocks in a window."""
        return -(-size // cls.block(size)) + 1


def scan(texts: list[str | None], templates: Templates) -> Iterator[tuple[int, int, float, int, int, int]]:
    """``(text, template, containment, first word, last word, windows)`` for each template that a text holds."""
    words = Words(texts, ALNUM)
    shingles, first = words.shingles(templates.width)
    if not len(shingles):
        return
    n, levels = np.diff(first), []
    for size in sorted(templates.classes):
        # Blocks start anew in each text, so no window goes over two.
        block = templates.block(size)
        per_text = -(-n // block)
        block_first = np.concatenate([[0], np.cumsum(per_text)])
        owner = np.repeat(np.arange(len(n)), per_text)
        place = np.arange(len(owner)) - block_first[:-1][owner]
        # A block is a whole number of the blocks of the class before, so its minimum is that of theirs.
        before = first if not levels else levels[-1][3]
        ratio = block if not levels else block // levels[-1][1]
        hit = {t: np.zeros(len(owner), dtype=bool) for t in templates.classes[size]}
        levels.append((size, block, owner, block_first, before[:-1][owner] + place * ratio, first[:-1][owner] + place * block, hit))
    for k, seed in enumerate(templates.seeds):
        least = shingles * seed
        for size, _, owner, _, parts, _, hit in levels:
            least = np.minimum.reduceat(least, parts)
            window = least.copy()
            for step in range(1, templates.span(size)):
                same = owner[:-step] == owner[step:] if len(owner) > step else np.zeros(0, dtype=bool)
                if len(same):
                    window[:-step] = np.where(same, np.minimum(window[:-step], least[step:]), window[:-step])
            for t in hit:
                hit[t] |= window == templates.minima[t][k]
    rows: dict[int, list[tuple[int, float, int, int, int]]] = {}
    for size, block, owner, _, _, starts, hit in levels:
        for t in hit:
            own, found = templates.sets[t], {}
            for w in np.flatnonzero(hit[t]):
                text = int(owner[w])
                a, e = int(starts[w]), min(int(starts[w]) + block * templates.span(size), int(first[text + 1]))
                inside = np.isin(shingles[a:e], own)
                held = len(np.unique(shingles[a:e][inside])) / len(own)
                if held >= templates.containment:
                    at = np.flatnonzero(inside) + a - int(first[text])
                    best = found.get(text)
                    here = (held, int(at[0]), int(at[-1]) + templates.width - 1)
                    count = best[3] + 1 if best else 1
                    found[text] = (*(here if best is None or held > best[0] else best[:3]), count)
            for text, row in found.items():
                rows.setdefault(text, []).append((t, *row))
    for text, here in rows.items():
        for row in here:
            if not any(_outdone(row, other, templates.family) for other in here):
                yield text, *row


def _outdone(row: tuple, other: tuple, family: Mapping[int, int]) -> bool:
    """Whether another template of the family is held to a higher degree in over half of the same place."""
    if row[0] not in family or family[row[0]] != family.get(other[0]) or other[1] <= row[1]:
        return False
    shared = min(row[3], other[3]) - max(row[2], other[2]) + 1
    return 2 * shared > min(row[3] - row[2], other[3] - other[2]) + 1


def spdx_lines(text: str | None) -> Iterator[tuple[str, float, int, int, int]]:
    """``(license, containment, first word, last word, lines)`` for each identifier that the SPDX lines of a text name, at its first line."""
    found: dict[str, list[int]] = {}
    for line in SPDX.finditer(text or ""):
        parts = re.split(r"[ \t]+", line[1])
        # After WITH comes an exception, no license.
        names = {p.strip("().") for i, p in enumerate(parts) if i % 2 == 0 and (i == 0 or parts[i - 1].upper() != "WITH")}
        start = int(Words([text[: line.start()]], ALNUM).first[1])
        end = start + int(Words([line[0]], ALNUM).first[1]) - 1
        for name in names - {""}:
            found.setdefault(f"SPDX:{name}", [start, end, 0])[2] += 1
    for name, (start, end, count) in found.items():
        yield name, 1.0, start, end, count


def scan_licenses(
    docs: DataFrame,
    notices: Mapping[str, str] = NOTICES,
    containment: float = 0.75,
    width: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    families: Sequence[Sequence[str]] = (),
    spdx: bool = False,
) -> DataFrame:
    """``doc_id, license, containment, first_word, last_word, n_windows``: the notices that each whole text holds.

    Words are runs of ASCII letters, digits and bytes beyond ASCII, without case; shingles are
    ``width`` of them. Windows in steps of half a notice are signed by minima of multiplicative
    hashes; a window that shares a band with a notice is a candidate, and bands are set so that one
    with enough of the notice is missed less than once in ten thousand. A candidate counts when the
    window holds at least ``containment`` of the notice's shingles; the row tells the best window,
    the first on ties, and how many windows matched.

    Every text is scanned where it lies: nothing is shuffled, and only the notices are sent out.
    Texts that are null, empty or without a match give no row; repeated rows give a row each. A
    text with fewer than ``width`` words is one shingle, and so is such a notice.

    Of templates in one of ``families`` that match in the same place, only those of the highest
    containment give a row. With ``spdx``, each identifier of an SPDX line gives a row too.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Templates(notices, containment, width, families))

    def scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = sent.value.names
        for pdf in batches:
            for run in slices(pdf, "text"):
                ids = [None if pd.isna(x) else int(x) for x in run["doc_id"]]
                rows = [(ids[i], names[t], *rest) for i, t, *rest in scan(run["text"].tolist(), sent.value)]
                if spdx:
                    rows += [(i, *row) for i, t in zip(ids, run["text"], strict=True) for row in spdx_lines(t)]
                frame = pd.DataFrame(rows, columns=["doc_id", "license", "containment", "first_word", "last_word", "n_windows"])
                yield frame.astype({"doc_id": "Int64"})

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return narrow.mapInPandas(scan_all, "doc_id long, license string, containment double, first_word long, last_word long, n_windows long")
