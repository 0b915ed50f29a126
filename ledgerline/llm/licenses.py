"""Licence statements in texts, by Dice coefficient over word bigrams.

A text and the templates are cut into lower-case words. A stretch of a text
matches a template when the Dice coefficient of their bigrams, counted with
repeats, reaches the threshold. Two bounds prune: the Dice coefficient can only
reach the threshold if the stretch has between ``low`` and ``high`` bigrams,
and only if at least ``least`` bigrams of the template occur within ``high``
places; templates without such a place are never compared.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import batches

THRESHOLD = 0.8

# Public licence notices, by their SPDX names.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation; either version 2 of the License,
        or (at your option) any later version.""",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the
        License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
        binary, for any purpose, commercial or non-commercial, and by any means.""",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "MIT statement": "Released under the MIT License.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

WORDS = re.compile(r"\w+")


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        self.name, self.threshold = name, threshold
        words = WORDS.findall(text.lower())
        self.bigrams = Counter(zip(words, words[1:], strict=False))
        self.size = self.bigrams.total()
        # 2 min(a, b) / (a + b) >= t  bounds the bigrams a of a stretch.
        self.low = max(1, math.ceil(self.size * threshold / (2 - threshold) - 1e-9))
        self.high = math.floor(self.size * (2 - threshold) / threshold + 1e-9)
        self.least = max(1, math.ceil(threshold * (self.low + self.size) / 2 - 1e-9))

    def best(self, pairs: list, spots: list[int]) -> list[tuple[int, int, float]]:
        """(first bigram, end, Dice) of stretches that match, best first for each
        place and none overlapping. ``spots`` has the bigrams that are the template's."""
        found, k, least = [], 0, self.least
        while k + least <= len(spots):
            start = spots[k]
            if spots[k + least - 1] - start >= self.high:
                k += 1
                continue
            left, shared, top = dict(self.bigrams), 0, None
            for at in spots[k:]:
                size = at - start + 1
                if size > self.high:
                    break
                if left.get(pairs[at], 0) > 0:
                    left[pairs[at]] -= 1
                    shared += 1
                dice = 2 * shared / (size + self.size)
                if size >= self.low and dice >= self.threshold and (top is None or dice > top[2]):
                    top = (start, at + 1, dice)
            if top is None:
                k += 1
                continue
            if found and top[0] < found[-1][1]:
                if top[2] > found[-1][2]:
                    found[-1] = top
                k += 1
            else:
                found.append(top)
                k += 1
        return found


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.templates = [Template(n, t, threshold) for n, t in templates.items()]
        self.owners: dict[tuple[str, str], list[int]] = {}
        for k, t in enumerate(self.templates):
            for b in t.bigrams:
                self.owners.setdefault(b, []).append(k)

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, Dice) of every match, in order."""
        words = WORDS.findall(text.lower())
        pairs = list(zip(words, words[1:], strict=False))
        spots: dict[int, list[int]] = {}
        owners = self.owners
        for at in [k for k, p in enumerate(pairs) if p in owners]:
            for k in owners[pairs[at]]:
                spots.setdefault(k, []).append(at)
        found = []
        for k, places in spots.items():
            t = self.templates[k]
            found += [(t.name, a, b + 1, d) for a, b, d in t.best(pairs, places)]
        return sorted(found, key=lambda x: (x[1], x[0]))


_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("license", pa.string()),
        ("first_word", pa.int64()),
        ("end_word", pa.int64()),
        ("dice", pa.float64()),
    ]
)


def license_matches(
    docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per licence statement: ``doc_id``, ``license``, ``first_word``,
    ``end_word`` (exclusive, counted in words) and ``dice``.

    Stretches of one template do not overlap; the better one stands. A text
    that is null, empty or without two words has none. Rows that repeat are
    rows of their own, ``doc_id`` may be null, other columns are not looked at,
    and an empty table gives an empty table.
    """
    chosen = templates or TEMPLATES

    def scan(parts):
        scanner = Scanner(chosen, threshold)
        rows = (
            (i, *found)
            for part in parts
            for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)
            for found in scanner.scan(t.as_py() or "")
        )
        yield from batches(_FOUND, rows)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(scan, "doc_id long, license string, first_word long, end_word long, dice double")
