"""License scans: MinHash bands over text windows, then exact containment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orderlens.llm.common import (
    blocks,
    is_blank,
    mixed,
    shingle_hashes,
    slices,
    word_hashes,
)

SHINGLE = 5
#: Words of a shingle of a template of fewer than SHORT words.
SHORT_SHINGLE, SHORT = 2, 10
CONTAINMENT = 0.8
#: A window of a template's length that is off by a tenth of it at most and holds
#: 0.8 of its shingles has Jaccard similarity 0.6 or more; 20 bands of 2 rows
#: retrieve it with probability 1 - (1 - 0.6**2)**20 = 0.9999.
BANDS, ROWS = 20, 2

#: A tag names its license itself, by an expression of identifiers.
SPDX = re.compile(
    r"SPDX-License-Identifier:[ \t]*"
    r"([A-Za-z0-9(][A-Za-z0-9.+()-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)",
    re.IGNORECASE,
)

# fixed values: notices as their licenses ask to have them placed
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License.",
    "MIT licensed": "Licensed under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License."
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
        "International License."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "EPL-2.0 header": (
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at"
    ),
}
_FREE = (
    "{0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} "
    "as published by the Free Software Foundation{3} either version {4} of the License, or (at "
    "your option) any later version."
)
for _name, _title, _version in (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
):
    NOTICES[f"{_name} header"] = _FREE.format("This program", ":", _title, ",", _version)
# one-line notices in their usual wordings
for _name, _title in (
    ("MIT", "MIT"),
    ("ISC", "ISC"),
    ("BSD-2-Clause", "BSD 2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause"),
):
    for _verb in ("Released", "Licensed", "Distributed"):
        for _the in ("the ", ""):
            NOTICES.setdefault(f"{_name} {_verb.lower()} {_the}line", f"{_verb} under {_the}{_title} License.")
NOTICES |= {
    f"{path.stem} text": path.read_text(encoding="utf-8")
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt"))
}


def _separators() -> np.ndarray:
    """All of ASCII but letters and digits, so that marks of comments are no words."""
    table = np.zeros(256, bool)
    table[:128] = True
    table[[c for c in range(128) if chr(c).isalnum()]] = False
    return table


_BLANK = _separators()
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def band_hashes(windows: np.ndarray) -> np.ndarray:
    """BANDS hashes for each row of shingles."""
    least = np.stack([mixed(windows ^ seed).min(axis=1) for seed in _SEEDS], axis=1)
    out = np.zeros((len(windows), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(windows), band + 1, np.uint64)
        for row in range(ROWS):
            key = mixed(key * np.uint64(0x9FB21C651E98DF25) + least[:, band * ROWS + row])
        out[:, band] = key
    return out


class Templates:
    """Templates by length of window, their bands and shingles."""

    def __init__(self, notices: Mapping[str, str], shingle: int = SHINGLE):
        self.names = sorted(notices)
        self.shingle = shingle
        words, first = word_hashes([notices[n] for n in self.names], _BLANK)
        hashes, owner = shingle_hashes(words, first, shingle)
        self.shingles = [np.unique(hashes[owner == i]) for i in range(len(self.names))]
        self.words = np.diff(first)
        self.every = np.unique(hashes)
        self.by_size: dict[int, dict[int, list[int]]] = {}
        self.of_size: dict[int, list[int]] = defaultdict(list)
        for i in range(len(self.names)):
            own = hashes[owner == i]
            if not len(own):
                continue
            self.of_size[len(own)].append(i)
            table = self.by_size.setdefault(len(own), {})
            for key in band_hashes(own[None, :])[0].tolist():
                table.setdefault(key, []).append(i)


class Library:
    """Templates of short and of long notices, under one numbering."""

    def __init__(self, notices: Mapping[str, str]):
        self.names = sorted(notices)
        _, first = word_hashes([notices[n] for n in self.names], _BLANK)
        self.words = np.diff(first)
        short = {n for n, size in zip(self.names, self.words) if size < SHORT}
        at = {n: i for i, n in enumerate(self.names)}
        self.parts = []
        for names, shingle in ((short, SHORT_SHINGLE), (set(at) - short, SHINGLE)):
            part = Templates({n: notices[n] for n in names}, shingle)
            self.parts.append((part, [at[n] for n in part.names]))


def find_notices(
    texts: list[str | None], library: Library, containment: float = CONTAINMENT
) -> list[tuple[int, int, int, int, float]]:
    """Matches as (text, template, first word in common, words of the template,
    containment).

    Of overlapping matches of templates of about one length, as the versions of
    one license are, the best stays; equal ones all stay.
    """
    words, first = word_hashes(texts, _BLANK)
    every = [
        (text, at[t], start, n, share)
        for part, at in library.parts
        for text, t, start, n, share in _find(words, first, part, containment)
    ]
    by_text: dict[int, list[tuple[int, int, int, int, float]]] = defaultdict(list)
    for match in sorted(every):
        by_text[match[0]].append(match)

    def beaten(a: tuple[int, int, int, int, float], b: tuple[int, int, int, int, float]) -> bool:
        longer = max(a[3], b[3])
        return (
            b[4] > a[4] and abs(a[3] - b[3]) * 5 <= longer and abs(a[2] - b[2]) * 2 < longer
        )

    return [m for own in by_text.values() for m in own if not any(beaten(m, o) for o in own)]


def _find(
    words: np.ndarray, first: np.ndarray, templates: Templates, containment: float
) -> list[tuple[int, int, int, int, float]]:
    """The matches of one list of templates.

    Only windows that hold a shingle of a template of their length are hashed;
    any other has similarity 0 with all of them. A text with too few of those
    shingles for any containment is not looked at.
    """
    hashes, owner = shingle_hashes(words, first, templates.shingle)
    if not len(hashes) or not len(templates.every):
        return []
    bounds = np.searchsorted(owner, np.arange(len(first)))
    at = np.minimum(np.searchsorted(templates.every, hashes), len(templates.every) - 1)
    known = np.flatnonzero(templates.every[at] == hashes)
    found: dict[tuple[int, int, int], tuple[float, int]] = {}
    for size, table in templates.by_size.items():
        step = max(1, size // 10)
        enough = np.zeros(len(first) - 1, bool)
        hit = np.zeros(len(known), bool)
        for t in templates.of_size[size]:
            own = np.isin(hashes[known], templates.shingles[t])
            in_text = np.bincount(owner[known[own]], minlength=len(enough))
            enough |= in_text >= containment * len(templates.shingles[t])
            hit |= own
        hits = known[hit & enough[owner[known]]]
        low, high = bounds[owner[hits]], bounds[owner[hits] + 1]
        # window starts on the grid of each text, and the last one that fits
        starts: set[int] = set()
        for h, a, b in zip(hits.tolist(), low.tolist(), high.tolist()):
            last = max(a, b - size)
            begin = max(a, h - size + 1)
            begin = a + -(-(begin - a) // step) * step
            starts.update(range(begin, min(h, last) + 1, step))
            if last <= h:
                starts.add(last)
        order = np.array(sorted(starts), np.int64)
        for i, j in blocks(np.arange(len(order) + 1) * size, 1 << 17):
            part = order[i:j]
            end = bounds[owner[part] + 1]
            inside = np.minimum(part[:, None] + np.arange(size)[None, :], end[:, None] - 1)
            for row, keys in enumerate(band_hashes(hashes[inside]).tolist()):
                candidates = {t for key in keys for t in table.get(key, ())}
                if not candidates:
                    continue
                p, text = int(part[row]), int(owner[part[row]])
                lower, upper = int(bounds[text]), int(bounds[text + 1])
                begin = max(lower, p - step)
                own = hashes[begin : min(upper, p + size + step)]
                for t in candidates:
                    share = len(np.intersect1d(own, templates.shingles[t])) / len(
                        templates.shingles[t]
                    )
                    if share >= containment:
                        here = np.isin(own, templates.shingles[t]).argmax()
                        key = (text, t, int(begin + here - lower))
                        found[key] = (share, size)
    # windows of one template that overlap are one match, the best of them
    out: list[tuple[int, int, int, int, float]] = []
    for (text, t, start), (share, size) in sorted(found.items()):
        n = int(templates.words[t])
        if out and out[-1][:2] == (text, t) and start < out[-1][2] + size:
            if share > out[-1][4]:
                out[-1] = (text, t, start, n, share)
        else:
            out.append((text, t, start, n, share))
    return out


def spdx_tags(texts: list[str | None]) -> list[tuple[int, str, int, int, float]]:
    """Matches of tags, named ``SPDX`` and their expression."""
    out = []
    for i, text in enumerate(texts):
        for m in SPDX.finditer(text or ""):
            before, own = (
                int(n) for n in np.diff(word_hashes([text[: m.start()], m.group()], _BLANK)[1])
            )
            out.append((i, f"SPDX {' '.join(m.group(1).split())}", before, own, 1.0))
    return out


def scan_licenses(
    docs: DataFrame,
    notices: Mapping[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per license notice found in a document.

    Words are runs of ASCII letters, digits and all characters beyond ASCII, and
    are compared without ASCII case. Each text is read in
    overlapping windows as long as a template; MinHash bands retrieve templates
    for a window, and a match holds at least ``containment`` of the template's
    five-word shingles (two-word ones for a template of fewer than ten words).
    Overlapping windows of one template are one match; see ``find_notices`` for
    those of several. Tags ``SPDX-License-Identifier`` are matches of their own,
    whatever ``notices`` are given. Null and empty texts have none; repeated rows
    repeat their matches; an empty table gives no rows. Columns other than
    ``doc_id`` and ``text`` are not read. The templates travel with the job.

    Returns ``doc_id, license, start_word, n_words, containment``.
    """
    given = dict(NOTICES if notices is None else notices)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(given)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            found = [
                (text, library.names[t], start, n, share)
                for text, t, start, n, share in find_notices(texts, library, containment)
            ] + spdx_tags(texts)
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.string()),
                    pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                    pa.array(columns[4], pa.float64()),
                ],
                ["doc_id", "license", "start_word", "n_words", "containment"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        scan,
        f"doc_id {kind}, license string, start_word bigint, n_words bigint, containment double",
    )
