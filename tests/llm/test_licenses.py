import random
import re

import pytest

from tablecraft.llm import licenses

PROSE = "The and attion to thanedble the anea Eriner thanea of by with this work under version public".split()


def prose(rng, n):
    return " ".join(rng.choices(PROSE, k=n)) + ".\n"


@pytest.mark.parametrize("name, template, _", licenses.TEMPLATES)
def test_every_template_is_found_in_prose(name, template, _):
    rng = random.Random(len(template))
    for before, after in ((0, 0), (300, 300), (1, 2)):
        text = prose(rng, before) + template + "\n" + prose(rng, after)
        found = licenses.notices(text)
        assert [f[2] for f in found] == [name]
        start, end, _, saved, missing, extra = found[0]
        assert text[start:end] == template.rstrip(".") and saved > 0 and not missing and not extra


def test_wording_differences():
    (one,) = licenses.notices("x\nThis text is licensed under the GNU General Public License, version 3, see there.")
    assert one[2] == "gpl-3.0" and one[4] == ["work"] and one[5] == ["text"]
    assert [n[2] for n in licenses.notices("licensed under CC BY-NC 4.0 and RELEASED UNDER THE MIT LICENSE")] == ["cc-by-nc-4.0", "mit"]


@pytest.mark.parametrize(
    "text", ["", "A driving license was issued in 1999.", "Licensed under the Potato License, Version 7.", "No license at all; licensed staff only."]
)
def test_other_texts_have_none(text):
    assert licenses.notices(text) == []


@pytest.mark.parametrize(
    "text, name",
    [
        ("Licensed under the GNU Affero General Public License, version 3.", "agpl-3.0"),
        ("// SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
         "provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"),
    ],
)
def test_licenses_that_look_alike(text, name):
    assert [n[2] for n in licenses.notices(text)] == [name]


def test_words_that_must_be_absent():
    assert licenses.notices("This work is licensed under the GNU Library General Public License, version 2.") == []


def brute_notices(text):
    """All templates, compressed and aligned at every sign."""
    import zstandard as z

    out = []
    for sign in re.finditer(licenses.SIGNS, text):
        done = out[-1][1] if out else 0
        if sign.start() < done:
            continue
        fitting = []
        for k, (name, template, telling) in enumerate(licenses.TEMPLATES):
            low, high = max(done, sign.start() - len(template)), min(len(text), sign.end() + len(template))
            data = text[low:high].lower().encode()
            given = z.ZstdCompressionDict(template.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
            pressed = z.ZstdCompressor(level=19, dict_data=given, write_content_size=False, write_dict_id=False).compress(data)
            saved = len(z.ZstdCompressor(level=19, write_content_size=False).compress(data)) - len(pressed)
            places = list(re.finditer(r"\w+(?:[.-]\w+)*", text[:high][low:]))
            wanted = re.findall(r"\w+(?:[.-]\w+)*", template.lower())
            near = licenses.align(wanted, [p.group().lower() for p in places])
            wrong = set(telling.split()) & set(near.missing) or set(licenses.ABSENT.get(name, "").split()) & set(near.extra)
            if saved > 0 and near.differences <= 0.25 * len(wanted) and not wrong:
                span = low + places[near.first].start(), low + places[near.last - 1].end()
                fitting.append((near.differences / len(wanted), -len(wanted), k, (*span, name, saved, list(near.missing), list(near.extra))))
        if fitting:
            out.append(min(fitting)[3])
    return out


def test_notices_equal_all_templates_at_all_signs():
    """Templates with words changed, left out and put in, one after the other."""
    rng = random.Random(8)
    found = set()
    for turn in range(60):
        parts = []
        for _, template, _ in rng.sample(licenses.TEMPLATES, 3):
            words = template.split()
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(["GNU", "", "Lesser", "Affero 2.0", "license", "of the"])
            parts += [prose(rng, rng.choice([0, 1, 5, 60])), " ".join(words)]
        text = " ".join(parts)
        got = licenses.notices(text)
        assert got == brute_notices(text)
        found |= {n[2] for n in got}
    assert len(found) > 12


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j - 1] + (x != y), above[j] + 1, row[j - 1] + 1))
    return row[-1]


def brute(wanted, words):
    """The least number of edits over all stretches."""
    return min(distance(wanted, words[i:j]) for i in range(len(words) + 1) for j in range(i, len(words) + 1))


def test_alignment_is_the_cheapest():
    rng = random.Random(6)
    for _ in range(200):
        wanted, words = rng.choices("abcd", k=rng.randrange(1, 6)), rng.choices("abcd", k=rng.randrange(0, 9))
        near = licenses.align(wanted, words)
        edits = sum(1 for _ in near.missing) + len(near.extra)
        best = brute(wanted, words)
        assert near.differences <= best <= edits
        assert len(wanted) - len(near.missing) == (near.last - near.first) - len(near.extra)


def test_query_rows(spark):
    rng = random.Random(9)
    data = [(1, None, "z"), (2, "", "z"), (3, prose(rng, 50), "z"), (None, licenses.TEMPLATES[2][1], "z")]
    data += [(4, "é👩‍👧 " + licenses.TEMPLATES[0][1], "z")] * 2 + [(5, prose(rng, 60_000) + licenses.TEMPLATES[5][1], "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, notices string")
    rows = licenses.license_notices(docs).collect()
    got = {(r.doc_id, *((n.license, n.start) for n in r.notices)) for r in rows}
    long = data[-1][1]
    assert len(rows) == len(data)
    assert got == {(1,), (2,), (3,), (None, ("mit", 0)), (4, ("apache-2.0", 5)), (5, ("gpl-3.0", long.index("This work is")))}
    assert licenses.license_notices(docs.limit(0)).count() == 0
