"""License scans by MinHash bands over overlapping text windows.

Templates are notices and license texts.  A template of n words belongs to the
size class L, the power of two with L/2 < n <= L.  For each class a document is
read in windows of 2L words that begin every L words, so whatever is as long
as a template lies whole in some window.  A window and a template are sets of
shingles of five words; ``HASHES`` MinHash values of one row each are the
bands, and a window retrieves the templates with which it shares any value.
A window that holds 80% of a template's shingles has a Jaccard similarity of
at least 0.16 with it, so it retrieves the template with probability
1 - 0.84 ** 96, over 0.99999994.  A retrieved template counts if the window holds
80% of its shingles, compared exactly.

Windows without any shingle of any template hold no part of one and are
skipped before they are hashed.  Templates are a bounded parameter and travel
with the tasks.

Cases: null and empty texts have no license; texts of fewer than five words
are one shingle; repeated rows and null ids are answered row by row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .base import ids as column_ids
from .base import mix, prepare, text_slices
from .words import Words, shingles

SHINGLE = 5
CONTAINED = 0.8
HASHES = 96

# Names and texts of license notices.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
     by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
     and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
     files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
     merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
     to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
     copies or substantial portions of the Software."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
     provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
     conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
     disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
     disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
     as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
     as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
     License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (sets x HASHES) of non-empty shingle sets."""
    seeds = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.array([mix(s[:, None] ^ seeds[None, :]).min(axis=0) for s in sets], np.uint64).reshape(-1, HASHES)


class Templates:
    """Shingle sets and MinHash values of templates, by size class."""

    def __init__(self, notices: list[tuple[str, str]]):
        w = Words(pa.array([t for _, t in notices], pa.string()))
        doc, h = shingles(w, w.hashes(), SHINGLE)
        self.names = [n for n, _ in notices]
        self.sets = [np.unique(h[doc == i]) for i in range(len(notices))]
        self.all = np.unique(h)
        may = np.zeros(1 << 16, bool)
        may[(self.all >> np.uint64(48)).astype(np.int64)] = True
        self.may = may
        self.classes: dict[int, list[int]] = {}
        for i, n in enumerate(w.counts.tolist()):
            if n:
                self.classes.setdefault(1 << (n - 1).bit_length(), []).append(i)
        self.values = min_hashes(self.sets) if all(len(s) for s in self.sets) else \
            np.vstack([min_hashes([s]) if len(s) else np.zeros((1, HASHES), np.uint64) for s in self.sets])

    def held(self, h: np.ndarray) -> np.ndarray:
        """Which shingles some template has."""
        out = self.may[(h >> np.uint64(48)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at) and len(self.all):
            k = np.minimum(np.searchsorted(self.all, h[at]), len(self.all) - 1)
            out[at] = self.all[k] == h[at]
        return out

    def scan(self, h: np.ndarray, held: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, start, stop, containment) of the matches in a document's shingles (held: places of template shingles)."""
        found: dict[tuple[int, int], tuple[int, int, float]] = {}
        for size, members in self.classes.items():
            # windows of 2 * size words: of 2 * size - 4 shingles, one every size words
            last = max(0, -(-(len(h) + SHINGLE - 1) // size) - 2)
            near = np.unique(np.clip(np.concatenate((held // size, held // size - 1)), 0, last))
            windows = [(int(k) * size, int(k) * size + max(1, 2 * size - SHINGLE + 1)) for k in near]
            sets = [np.unique(h[a:b]) for a, b in windows]
            pairs = [(x, y) for x, y in zip(windows, sets) if len(y)]
            if not pairs:
                continue
            values = min_hashes([y for _, y in pairs])
            for ((a, b), own), value in zip(pairs, values):
                for t in members:
                    if not (value == self.values[t]).any():
                        continue
                    share = np.isin(self.sets[t], own, assume_unique=True).mean()
                    if share >= CONTAINED:
                        at = np.flatnonzero(np.isin(h[a:b], self.sets[t])) + a
                        found[t, int(at[0])] = (int(at[0]), int(at[-1]) + SHINGLE, float(share))
        return [(t, *v) for (t, _), v in sorted(found.items(), key=lambda x: (x[1][0], x[0][0]))]


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: id, licenses (names, sorted), matches (license, start, stop in words, containment)."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(notices if notices is not None else NOTICES)
    kind = dict(docs.dtypes)[id_col]
    match = pa.struct([("license", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("containment", pa.float64())])

    def run(batches):
        t = Templates(sent.value)
        for batch in batches:
            for a, b, texts in text_slices(batch, text_col):
                w = Words(texts)
                doc, h = shingles(w, w.hashes(), SHINGLE)
                at = np.flatnonzero(t.held(h))
                first = np.searchsorted(doc, np.arange(b - a + 1))
                cut = np.searchsorted(at, first)
                out = []
                for i in range(b - a):
                    own = at[cut[i]:cut[i + 1]]
                    out.append([{"license": t.names[k], "start": x, "stop": min(y, int(w.counts[i])), "containment": s}
                                for k, x, y, s in t.scan(h[first[i]:first[i + 1]], own - first[i])] if len(own) else [])
                yield pa.RecordBatch.from_arrays([
                    column_ids(batch, id_col).slice(a, b - a), pa.array([sorted({m["license"] for m in x}) for x in out], pa.list_(pa.string())),
                    pa.array(out, pa.list_(match))], ["id", "licenses", "matches"])
    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, licenses array<string>, matches array<struct<license:string,start:int,stop:int,containment:double>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (comma-joined), n_matches."""
    from pyspark.sql import functions as F

    return scan(docs).select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"),
                             F.concat_ws(",", "licenses").alias("licenses"), F.size("matches").cast("long").alias("n_matches"))
