"""License scan: MinHash bands over text windows, then exact shingle containment.

Every template is a set of five-word shingles. For each template size, windows
of as many shingles slide over a text in steps of an eighth; a window's
MinHash signature is cut into ``BANDS`` bands of ``ROWS`` hashes, and a band
equal to a template's retrieves it. A template that stands whole in a text has
a window with similarity of at least 0.88, one with containment 0.8 a window
of about 0.6, which some band meets with probability over 1 - 10**-6
(``collision_chance``). Every retrieved template is verified by the exact share
of its shingles in the window and a step around it.

Only templates of which a text holds ``LEAST_CONTAINED`` of the shingles at all
can match and are looked for. A notice also needs its version: of each number in
it a shingle that holds the whole number must be there.

One-line wordings are exact: the name of a license with its version (``NAMES``,
the longest that fits) after words that grant it (``LEADS``). Their template
numbers follow those of the templates.

Of matches of different templates at one place the one that explains most words
wins (``best_of``), so the texts of sibling licenses do not report each other.

The templates are a bounded table (``TEMPLATES_MOST`` texts) that is broadcast;
the scan is a map without a shuffle.

Defined cases: null texts match nothing; texts under five words match one-line
wordings only; rows stay as they are, repeated or null ids included; an empty
input gives no rows; a text of many notices takes time in proportion to them.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.arrowtext import Words, chunks, mix, sliding_min
from lodestar.llm.shared import bounded_batches

WORDS = 5
LEAST_CONTAINED = 0.8
BANDS = 32
ROWS = 2
TEMPLATES_MOST = 2_000
#: Longer templates are whole texts, whose numbers are mostly of sections.
NOTICE_WORDS = 60

#: (license, notice), fixed values: notices in common use.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def texts() -> list[tuple[str, str]]:
    """(license, its terms) of every file in ``license_texts``; preambles and appendices on use are left off, as copies often are without them."""
    return [(path.stem, path.read_text(encoding="utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]


#: What ``scan`` looks for: notices, then whole license texts.
CATALOGUE: list[tuple[str, str]] = [*TEMPLATES, *texts()]


def _phrases(pattern: str) -> list[str]:
    """All readings of a pattern with groups such as ``(a|b|)``."""
    parts = [part.split("|") for part in re.split(r"[()]", pattern)]
    return sorted({" ".join("".join(x).split()) for x in itertools.product(*parts)})


def _names() -> dict[str, str]:
    """Words of a license's name to the license; without a version, to its family."""
    license_ = "(license|licence)"
    found: dict[str, str] = {}

    def add(name: str, *patterns: str) -> None:
        for pattern in patterns:
            for phrase in _phrases(pattern):
                found.setdefault(phrase, name)

    gnu = {
        "GPL": ("(gnu |)gpl", f"(gnu |)general public {license_}( gpl| gnu gpl|)", ("1.0", "2.0", "3.0")),
        "LGPL": ("(gnu |)lgpl", f"(gnu |)(lesser|library) general public {license_}( lgpl| gnu lgpl|)", ("2.0", "2.1", "3.0")),
        "AGPL": ("(gnu |)agpl", f"(gnu |)affero general public {license_}( agpl| gnu agpl|)", ("3.0",)),
        "GFDL": ("(gnu |)(gfdl|fdl)", f"(gnu |)free documentation {license_}( gfdl| gnu fdl|)", ("1.1", "1.2", "1.3")),
    }
    for family, (short, long, versions) in gnu.items():
        add(family, short, long)
        for version in versions:
            major, minor = version.split(".")
            for said in [f"{major} {minor}"] + ([major] if minor == "0" else []):
                full = f"{family}-{version}"
                marks = f"(version {said}|v {said}|v{said}|{said})"
                add(full, f"{short} {marks}", f"{long} {marks}", f"(version {said}|v{said}) of the {long}", f"(version {said}|v{said}) of the {short}", f"{family.lower()}v{said}", f"gnu {family.lower()}v{said}")
    for family, key, long, versions in (("Apache", "apache", "apache(| software)", ("1.0", "1.1", "2.0")), ("MPL", "mpl", "mozilla public", ("1.0", "1.1", "2.0")), ("EPL", "epl", "eclipse public", ("1.0", "2.0")), ("EUPL", "eupl", "european union public", ("1.1", "1.2")), ("Artistic", "artistic", "(perl |)artistic", ("1.0", "2.0")), ("BSL", "bsl", "boost software", ("1.0",))):
        add(family, key if family != "BSL" else f"boost {license_}", f"{long} {license_}")
        for version in versions:
            major, minor = version.split(".")
            for said in [f"{major} {minor}"] + ([major] if minor == "0" else []):
                marks = f"(version {said}|v {said}|v{said}|{said})"
                add(f"{family}-{version}", f"{key} {marks}", f"{long} {license_} {marks}", f"{long} {license_} {key} {marks}", f"{long} {marks} {license_}", f"{long} {marks}", f"(version {said}|v{said}) of the {long} {license_}")
    kinds = {"BY": ("by", "attribution"), "BY-SA": ("by sa", "attribution (share alike|sharealike)"), "BY-NC": ("by nc", "attribution (non commercial|noncommercial)"), "BY-ND": ("by nd", "attribution (no derivatives|noderivatives|no derivs|noderivs)"), "BY-NC-SA": ("by nc sa", "attribution (non commercial|noncommercial) (share alike|sharealike)"), "BY-NC-ND": ("by nc nd", "attribution (non commercial|noncommercial) (no derivatives|noderivatives|no derivs|noderivs)")}
    for kind, (short, long) in kinds.items():
        add(f"CC-{kind}", f"(cc|creative commons) {short}", f"creative commons {long}( {license_}|)")
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            said = version.replace(".", " ")
            marks = f"(version {said}|v {said}|v{said}|{said})"
            add(f"CC-{kind}-{version}", f"(cc|creative commons) {short} {marks}", f"creative commons {long}( cc {short}|) {marks}( international| unported| generic|)( {license_}|)", f"creative commons {long} {license_} {marks}")
    add("CC0-1.0", "cc0", "(creative commons |)cc0 (1 0|v1 0)( universal|)", "creative commons zero( v1 0| 1 0|)( universal|)")
    add("CC-PDM-1.0", "creative commons public domain mark( 1 0|)")
    add("MIT", "mit", f"mit {license_}", f"(expat|x11|mit x11|mit expat) {license_}")
    add("MIT-0", "mit 0", f"mit no attribution {license_}")
    add("BSD", "bsd", f"bsd( style|) {license_}")
    for number, also in (("2", "simplified|freebsd"), ("3", "new|modified|revised"), ("4", "original|old")):
        word = {"2": "two", "3": "three", "4": "four"}[number]
        full = f"BSD-{number}-Clause"
        add(full, f"bsd ({number}|{word}) clause( {license_}|)", f"({number}|{word}) clause bsd( {license_}|)", f"({also}) bsd {license_}")
    add("0BSD", "0bsd", f"(zero clause|0 clause) bsd( {license_}|)", "bsd zero clause")
    add("ISC", "isc", f"isc {license_}")
    add("Unlicense", "unlicense", "unlicence", f"unlicense {license_}")
    add("Zlib", "zlib", f"zlib {license_}", f"zlib libpng {license_}")
    add("WTFPL", "wtfpl")
    add("PSF-2.0", "psf 2 0", f"(python software foundation|psf) {license_}( version 2| 2 0|)")
    return found


NAMES = _names()
#: Words before a license's name that grant it.
LEADS = sorted({*_phrases("(licensed|released|relicensed|distributed|redistributed|available|published|provided|shared|offered|issued|used|is|are) under( the| a| an| terms of| the terms of| the terms of the| terms of the| the terms and conditions of the| the conditions of the|)"), *_phrases("(under|subject to|according to) the terms( and conditions|) of( the| a|)"), *_phrases("(covered|governed|protected) by( the| a| an)"), *_phrases("spdx (license|licence) identifier"), *_phrases("(license|licence)( is| is the| the|)"), *_phrases("licensed as( the|)")})
#: Words after a license's name that do the same.
TAILS = ["licensed", "licenced"]


def _separators() -> np.ndarray:
    flags = np.ones(256, bool)
    for codes in (range(48, 58), range(65, 91), range(97, 123), range(128, 256)):
        flags[list(codes)] = False
    return flags


SEPARATORS = _separators()
_KEYS = np.random.default_rng(8_675_309).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def collision_chance(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that two sets of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _bands(minima: list[np.ndarray]) -> np.ndarray:
    """Band keys, a row for each band, from the minima of every hash function."""
    out = []
    for band in range(BANDS):
        key = np.full(len(minima[0]), band, np.uint64)
        for row in range(ROWS):
            key = mix(key ^ minima[band * ROWS + row])
        out.append(key)
    return np.stack(out)


class Templates:
    """Shingles and band keys of the templates."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        if len(templates) > TEMPLATES_MOST:
            raise ValueError(f"more than {TEMPLATES_MOST} templates")
        words = Words(pa.array([t for _, t in templates], pa.string()), lower=True, separators=SEPARATORS)
        starts, hashes = words.grams(WORDS)
        of = words.text_of(starts) if len(starts) else starts
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(hashes[of == i]) for i in range(len(templates))]
        self.sizes: dict[int, dict[int, list[int]]] = {}
        for i, shingles in enumerate(self.sets):
            if len(shingles):
                keys = _bands([mix(shingles ^ k).min(keepdims=True) for k in _KEYS])[:, 0]
                table = self.sizes.setdefault(len(shingles), {})
                for key in keys.tolist():
                    table.setdefault(key, []).append(i)
        #: Of each number in a notice, the shingles that hold it whole; one of them must be found.
        self.marks: list[list[np.ndarray]] = [[] for _ in templates]
        at = 0
        for i, (_, text) in enumerate(templates):
            count = int(words.counts[i])
            said = re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower())
            if count == len(said) and count <= NOTICE_WORDS:
                for first, past in _numbers(said):
                    past = min(past, first + WORDS)
                    low, high = max(0, past - WORDS), min(first, count - WORDS)
                    if low <= high:
                        self.marks[i].append(hashes[at + low : at + high + 1])
            at += max(0, count - WORDS + 1)
        self.postings = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        order = np.argsort(self.postings, kind="stable")
        self.posted = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])[order]
        self.postings = self.postings[order]
        self.least = np.array([max(1, LEAST_CONTAINED * len(x)) for x in self.sets])
        self.all = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.keys = {size: np.array(sorted(table), np.uint64) for size, table in self.sizes.items()}

    def touched(self, hashes: np.ndarray) -> np.ndarray:
        """Which shingles are of some template."""
        if not len(self.all):
            return np.zeros(len(hashes), bool)
        return self.all[np.minimum(np.searchsorted(self.all, hashes), len(self.all) - 1)] == hashes

    def possible(self, hashes: np.ndarray) -> set[int]:
        """Templates of which these distinct shingles hold enough; no other can match."""
        low, high = (np.searchsorted(self.postings, hashes, side) for side in ("left", "right"))
        counts = np.zeros(len(self.sets), np.int64)
        for k in range(int((high - low).max(initial=0))):
            np.add.at(counts, self.posted[(low + k)[low + k < high]], 1)
        return set(np.flatnonzero(counts >= self.least).tolist())

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first word, past word, containment) in a text's shingles in order; of overlapping places of a template the best, then the first."""
        found: dict[int, list[tuple[float, int, int]]] = {}
        possible = self.possible(np.unique(hashes[self.touched(hashes)]))
        inside: dict[int, np.ndarray] = {}  # places of a template's shingles, and of its marks: one pass a template
        marked: dict[int, list[np.ndarray]] = {}
        for size in sorted({len(self.sets[i]) for i in possible}):
            table = self.sizes[size]
            width, step = min(size, len(hashes)), max(1, size // 8)
            starts = np.unique(np.append(np.arange(0, len(hashes) - width + 1, step), len(hashes) - width))
            keys = _bands([sliding_min(mix(hashes ^ k), width)[starts] for k in _KEYS])
            near = self.keys[size][np.minimum(np.searchsorted(self.keys[size], keys), len(self.keys[size]) - 1)] == keys
            bands, ats = np.nonzero(near)
            hits = {(template, at) for key, at in set(zip(keys[bands, ats].tolist(), ats.tolist(), strict=True)) for template in table[int(key)] if template in possible}
            for template, at in sorted(hits):
                if template not in inside:
                    inside[template] = np.flatnonzero(np.isin(hashes, self.sets[template]))
                    marked[template] = [np.flatnonzero(np.isin(hashes, mark)) for mark in self.marks[template]]
                low, high = max(0, int(starts[at]) - step), min(len(hashes), int(starts[at]) + width + step)
                a, b = np.searchsorted(inside[template], [low, high])
                held = inside[template][a:b]
                share = len(np.unique(hashes[held])) / size
                if share >= LEAST_CONTAINED and all(np.searchsorted(m, low) < np.searchsorted(m, high) for m in marked[template]):
                    found.setdefault(template, []).append((-share, int(held[0]), int(held[-1]) + WORDS))
        out = []
        for template, places in found.items():
            taken: list[tuple[int, int]] = []  # apart, in order
            for share, first, past in sorted(set(places)):
                at = bisect_left(taken, (first, past))
                if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or past <= taken[at][0]):
                    taken.insert(at, (first, past))
                    out.append((template, first, past, -share))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def _numbers(words: list[str]) -> list[tuple[int, int]]:
    """(first, past) of every run of numbers."""
    out, first = [], None
    for i, word in enumerate([*words, ""]):
        number = word.isdigit() or (word[:1] == "v" and word[1:].isdigit())
        if number and first is None:
            first = i
        elif not number and first is not None:
            out.append((first, i))
            first = None
    return out


class _Table:
    """Phrases by length: sorted hashes and their numbers."""

    def __init__(self, phrases: Sequence[str]) -> None:
        self.phrases = list(phrases)
        words = Words(pa.array(self.phrases, pa.string()), lower=True, separators=SEPARATORS)
        hashes = words.span_hashes(words.first[:-1], words.first[1:]) if self.phrases else np.zeros(0, np.uint64)
        self.heads = np.unique(words.hashes[words.first[:-1]]) if self.phrases else hashes
        self.tables: list[tuple[int, np.ndarray, np.ndarray]] = []
        for n in sorted(set(words.counts.tolist())):
            of = np.flatnonzero(words.counts == n)
            of = of[np.argsort(hashes[of])]
            self.tables.append((n, hashes[of], of))

    def find(self, words: Words, at: np.ndarray, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(words, phrase) of the longest phrase that begins at, or ends before, each place, inside its text; 0 words where there is none."""
        sizes, phrases = np.zeros(len(at), np.int64), np.full(len(at), -1)
        texts = words.text_of(at) if len(at) else at
        for n, known, of in self.tables:
            starts = at - n if backward else at
            fits = np.flatnonzero((starts >= words.first[texts]) & (starts + n <= words.first[texts + 1]))
            got = words.span_hashes(starts[fits], starts[fits] + n)
            places = np.minimum(np.searchsorted(known, got), len(known) - 1)
            same = known[places] == got
            sizes[fits[same]], phrases[fits[same]] = n, of[places[same]]
        return sizes, phrases


class Wordings:
    """One-line wordings: a name after words that grant it, or before such words."""

    def __init__(self, names: dict[str, str]) -> None:
        self.names, self.leads, self.tails = _Table(list(names)), _Table(LEADS), _Table(TAILS)
        self.licenses = sorted(set(names.values()))
        number = {name: i for i, name in enumerate(self.licenses)}
        self.of = np.array([number[name] for name in names.values()], np.int64)

    def found(self, words: Words) -> dict[int, list[tuple[int, int, int]]]:
        """Text to its (license number, first word, past word), words counted in the text."""
        if not len(words) or not len(self.of):
            return {}
        heads = self.names.heads
        at = np.flatnonzero(heads[np.minimum(np.searchsorted(heads, words.hashes), len(heads) - 1)] == words.hashes)
        size, name = self.names.find(words, at)
        at, size, name = at[size > 0], size[size > 0], name[size > 0]
        before, _ = self.leads.find(words, at, backward=True)
        inner = np.minimum(at + size, len(words) - 1)
        after, _ = self.tails.find(words, inner)
        after[(at + size >= len(words)) | (words.text_of(inner) != words.text_of(at))] = 0
        out: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero((before > 0) | (after > 0)).tolist():
            text = int(words.text_of(at[i : i + 1])[0])
            low = int(words.first[text])
            out.setdefault(text, []).append((int(self.of[name[i]]), int(at[i] - before[i]) - low, int(at[i] + size[i] + (after[i] if not before[i] else 0)) - low))
        return out


def best_of(found: list[tuple[int, int, int, float, int, np.ndarray]]) -> list[tuple[int, int, int, float]]:
    """Matches (template, first, past, containment, shingles, words) without those mostly explained by a better one at their place.

    Better is more shingles found less those missing; a match goes if better ones hold half of its words.
    """
    kept, taken = [], np.zeros(max((int(x[5][-1]) + 1 for x in found if len(x[5])), default=0), bool)
    for template, first, past, share, size, words in sorted(found, key=lambda x: (round(x[4] - 2 * x[4] * x[3]), x[1], x[2], x[0])):
        if 2 * int(taken[words].sum()) < len(words):
            kept.append((template, first, past, share))
            taken[words] = True
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = CATALOGUE, key: str = "doc_id", wordings: dict[str, str] = NAMES) -> DataFrame:
    """(key, licenses, matches) for each row: license names in order of text, and (license, template, first, past, containment) by words."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((list(templates), dict(wordings)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lines = Templates(held.value[0]), Wordings(held.value[1])
        licenses = [*known.names, *lines.licenses]
        kind = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("containment", pa.float64())]))
        for batch in batches:
            for part in chunks(batch):
                words = Words(part.column("text"), lower=True, separators=SEPARATORS)
                starts, hashes = words.grams(WORDS)
                of = words.text_of(starts) if len(starts) else starts
                matches: list[list[dict]] = [[] for _ in range(part.num_rows)]
                said = lines.found(words)
                touched = known.touched(hashes)
                for row in sorted({*np.unique(of[touched]).tolist(), *said}):
                    a, b = np.searchsorted(of, [row, row + 1])
                    found = [(len(known.names) + n, f, p, 1.0, max(1, p - f - WORDS + 1), np.arange(f, p)) for n, f, p in said.get(row, [])]
                    for t, f, p, c in known.matches(hashes[a:b]) if touched[a:b].any() else []:
                        places = f + np.flatnonzero(np.isin(hashes[a + f : a + p - WORDS + 1], known.sets[t]))
                        found.append((t, f, p, c, len(known.sets[t]), np.unique(places[:, None] + np.arange(WORDS))))
                    matches[row] = [{"license": licenses[t], "template": t, "first": f, "past": p, "containment": c} for t, f, p, c in best_of(found)]
                names = [sorted({m["license"] for m in found}) for found in matches]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.list_(pa.string())), pa.array(matches, kind)], [key, "licenses", "matches"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, licenses array<string>, matches array<struct<license: string, template: int, first: int, past: int, containment: double>>"
    return docs.select(key, "text").mapInArrow(run, schema)
