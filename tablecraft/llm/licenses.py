"""License notices, found by conditional compression and confirmed word by word.

A pattern of tell-tale words picks the texts to look at. Around each such word lies a block of text, for
each template as long as that on either side. The block is compressed on its own and with the template
as zstandard's raw dictionary: the more of its length a template saves, the more of its wording the block
holds. Templates that save something are aligned with the block's words, those that save most first, and the one
whose wording differs least, little enough and in none of its telling words, is the block's license.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import picked, query, table

# Customary notices, and the words of each that must be there as they are.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2.0"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "apache 2.0",
    ),
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Licensed under the MIT License.", "mit"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction",
        "permission granted software",
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu public 3"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu public 2"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "gnu public 3",
    ),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser 3"),
    ("bsd-3-clause", "Licensed under the BSD 3-Clause License.", "bsd 3-clause"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "redistribution conditions",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0.", "by 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", "by-sa 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", "by-nc 4.0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0.", "by-nc-nd 4.0"),
    ("cc0-1.0", "To the extent possible under law, all copyright and related rights are waived under CC0 1.0.", "cc0 1.0"),
    ("all-rights-reserved", "Copyright. All rights reserved.", "rights reserved"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero 3"),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "gnu affero 3",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "gnu public 2",
    ),
    (
        "lgpl-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "gnu lesser 2.1",
    ),
    ("bsd-2-clause", "Licensed under the BSD 2-Clause License.", "bsd 2-clause"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "permission purpose fee granted",
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "eclipse public 2.0",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software.",
        "as-is authors liable",
    ),
)
# Tags of source files, by license.
TAGS = (
    ("apache-2.0", "Apache-2.0"),
    ("mit", "MIT"),
    ("gpl-3.0", "GPL-3.0"),
    ("gpl-3.0", "GPL-3.0-only"),
    ("gpl-3.0", "GPL-3.0-or-later"),
    ("gpl-2.0", "GPL-2.0"),
    ("gpl-2.0", "GPL-2.0-only"),
    ("gpl-2.0", "GPL-2.0-or-later"),
    ("lgpl-3.0", "LGPL-3.0-only"),
    ("lgpl-3.0", "LGPL-3.0-or-later"),
    ("lgpl-2.1", "LGPL-2.1-only"),
    ("lgpl-2.1", "LGPL-2.1-or-later"),
    ("agpl-3.0", "AGPL-3.0-only"),
    ("agpl-3.0", "AGPL-3.0-or-later"),
    ("bsd-3-clause", "BSD-3-Clause"),
    ("bsd-2-clause", "BSD-2-Clause"),
    ("isc", "ISC"),
    ("mpl-2.0", "MPL-2.0"),
    ("epl-2.0", "EPL-2.0"),
    ("unlicense", "Unlicense"),
    ("zlib", "Zlib"),
    ("cc-by-4.0", "CC-BY-4.0"),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0"),
    ("cc0-1.0", "CC0-1.0"),
)
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {tag}", f"spdx-license-identifier {tag.lower()}") for name, tag in TAGS)
#: Words that make a notice one of another license, where they stand in between.
ABSENT = {"gpl-3.0": "affero lesser library", "gpl-2.0": "affero lesser library", "lgpl-3.0": "affero", "lgpl-2.1": "affero"}
SIGNS = (
    r"(?i)licen[sc]e|permission is hereby granted|permission to use, copy|redistribution and use|all rights reserved|\bcc0\b"
    r"|\bunencumbered software\b|provided 'as-is'|eclipse public"
)
#: Share of a template's words that may differ.
TOLERANCE = 0.25
LEVEL = 19

_SIGN = re.compile(SIGNS)
_WORD = re.compile(r"\w+(?:[.-]\w+)*")

NOTICE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("license", T.StringType()),
        T.StructField("saved", T.IntegerType()),
        T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("extra", T.ArrayType(T.StringType())),
    ]
)


@dataclass(frozen=True)
class Aligned:
    """A template's place among the words of a block, and how the wording differs there."""

    first: int
    last: int
    missing: tuple[str, ...]
    extra: tuple[str, ...]

    @property
    def differences(self) -> int:
        return max(len(self.missing), len(self.extra))


def align(wanted: list[str], words: list[str]) -> Aligned:
    """The cheapest alignment of all ``wanted`` with any stretch of ``words``; the leftmost of equals."""
    rows = [[0] * (len(words) + 1)]
    for i, w in enumerate(wanted, 1):
        row, above = [i], rows[-1]
        for j, word in enumerate(words, 1):
            row.append(min(above[j - 1] + (w != word), above[j] + 1, row[j - 1] + 1))
        rows.append(row)
    j = min(range(len(words) + 1), key=lambda k: (rows[-1][k], k))
    i, last, missing, extra = len(wanted), j, [], []
    while i:
        if j and rows[i][j] == rows[i - 1][j - 1] + (wanted[i - 1] != words[j - 1]):
            if wanted[i - 1] != words[j - 1]:
                missing.append(wanted[i - 1])
                extra.append(words[j - 1])
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            missing.append(wanted[i - 1])
            i -= 1
        else:
            extra.append(words[j - 1])
            j -= 1
    return Aligned(j, last, tuple(missing[::-1]), tuple(extra[::-1]))


@functools.cache
def _templates() -> list[tuple[str, int, list[str], frozenset[str], frozenset[str], object]]:
    import zstandard as z

    ready = []
    for name, text, telling in TEMPLATES:
        data = z.ZstdCompressionDict(text.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        press = z.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
        wanted, absent = _WORD.findall(text.lower()), frozenset(ABSENT.get(name, "").split())
        ready.append((name, len(text), wanted, frozenset(telling.split()), absent, press))
    return ready


@functools.cache
def _alone():
    import zstandard as z

    return z.ZstdCompressor(level=LEVEL, write_content_size=False)


def notices(text: str) -> list[tuple]:
    """``(start, end, license, saved, missing, extra)`` of each notice, in code points.

    A block does not reach back into a notice already found, so notices do not overlap. A template whose telling
    words are not all near the sign cannot be confirmed and is not compressed. All others that save something are
    ranked, and aligned unless the words that the block lacks already make them differ too much or more than
    the best one so far. Of templates that differ alike the longer one counts, of equally long ones the first.
    """
    out: list[tuple] = []
    reach = max(size for _, size, *_ in _templates())
    for sign in _SIGN.finditer(text):
        done = out[-1][1] if out else 0
        if sign.start() < done:
            continue
        around = set(_WORD.findall(text[max(done, sign.start() - reach) : sign.end() + reach].lower()))
        ranked, alone = [], {}
        for k, (_, size, _, telling, _, press) in enumerate(_templates()):
            # A word cut off by the end of what is looked at may be a telling one within its own block.
            if not all(w in around or w in _cut(text, done, sign, size) for w in telling):
                continue
            low, high = max(done, sign.start() - size), min(len(text), sign.end() + size)
            data = text[low:high].lower().encode()
            if (low, high) not in alone:
                alone[low, high] = len(_alone().compress(data))
            saved = alone[low, high] - len(press.compress(data))
            if saved > 0:
                ranked.append((-saved / size, k, saved, low, high))
        best = None
        for _, k, saved, low, high in sorted(ranked):
            name, _, wanted, telling, absent, _ = _templates()[k]
            places = list(_WORD.finditer(text, low, high))
            words = [p.group().lower() for p in places]
            lacking = sum((Counter(wanted) - Counter(words)).values())
            if lacking > TOLERANCE * len(wanted) or (best and lacking / len(wanted) > best[0]):
                continue
            near = align(wanted, words)
            if near.differences <= TOLERANCE * len(wanted) and not telling & set(near.missing) and not absent & set(near.extra):
                span = places[near.first].start(), places[near.last - 1].end()
                fit = near.differences / len(wanted), -len(wanted), k, (*span, name, saved, list(near.missing), list(near.extra))
                best = min(best, fit, key=lambda f: f[:3]) if best else fit
        if best:
            out.append(best[3])
    return out


def _cut(text: str, done: int, sign: re.Match, size: int) -> tuple[str, ...]:
    """The first and the last word of a template's block, cut off where the block ends."""
    words = _WORD.findall(text[max(done, sign.start() - size) : sign.end() + size].lower())
    return (words[0], words[-1]) if words else ()


@F.arrow_udf(T.ArrayType(NOTICE))
def _notices(texts: pa.Array) -> pa.Array:
    names = NOTICE.fieldNames()
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("saved", pa.int32()), ("missing", pa.list_(pa.string())), ("extra", pa.list_(pa.string()))])
    )
    found = ([] if not t.is_valid else [dict(zip(names, n)) for n in notices(t.as_py())] for t in texts)
    return pa.array(list(found), kind)


def license_notices(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, notices)`` per row of ``docs``: an array of (start, end, license, saved, missing, extra).

    ``start`` and ``end`` are code points, ``saved`` the bytes that the template saves, ``missing`` and
    ``extra`` the words in which the wording differs. Only texts with a tell-tale word leave the JVM; those
    are read whole. Null and empty texts have no notice. Repeated rows are returned as often as they occur,
    null ids stay null, ties are settled as in ``notices``, an empty table gives an empty result, and other columns are ignored. No shuffle.
    """
    rows = picked(docs, doc_id=id_column, text=text_column)
    told = F.when(F.col("text").rlike(SIGNS), F.col("text"))
    return rows.select("doc_id", _notices(told).alias("notices"))


@query("op8_licenses")
def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = license_notices(table(spark, folder, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"])))
    changed = F.size(F.filter("notices", lambda n: F.size(n["missing"]) + F.size(n["extra"]) > 0))
    written = F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"].cast("string"), n["end"].cast("string")))
    return found.select(
        "doc_id",
        F.size("notices").cast("long").alias("n_notices"),
        F.array_join(names, ",").alias("licenses"),
        changed.cast("long").alias("n_changed"),
        F.array_join(written, ",").alias("notices"),
    )
