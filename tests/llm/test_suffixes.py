import hashlib
import random

import pytest

from tablecraft.llm import suffixes


def plain(texts):
    """All 200-byte strings counted one by one."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\x01" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randrange(1, 9))) for _ in range(300)] + ["é", "ß", "東京"]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(rng.randrange(30, 120)) for _ in range(6)]
    out = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "ab" * 150, " " * 450, prose(40)[:200]]
    for _ in range(60):
        text = prose(rng.randrange(5, 200))
        for _ in range(rng.randrange(4)):
            passage = rng.choice(passages)
            a = rng.randrange(0, 60)
            piece = passage[a : a + rng.choice([150, 198, 199, 200, 201, 202, 240, 600])]
            at = rng.randrange(len(text))
            text = text[:at] + piece + text[at:]
        out.append(text)
    for text in rng.choices([t for t in out if t and len(t) > 300], k=25):  # near copies
        at = rng.randrange(len(text))
        out.append(text[:at] + rng.choice(["", "x", "changed here"]) + text[at + rng.randrange(3) :])
    return out + [out[20]] * 3


@pytest.mark.parametrize("seed, together, part", [(1, 20_000, 1 << 20), (2, 3, 1 << 20), (3, 20_000, 500)])
def test_against_all_strings(spark, monkeypatch, seed, together, part):
    """Also with cores too crowded for a task, and with texts longer than a part."""
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    data = texts(seed)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(data)], "doc_id long, text string, key int, start int").repartition(3)
    if part != suffixes.PART:
        rows = [(0, (t or "").encode()) for t in data]
        monkeypatch.setattr(suffixes, "PART", part)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["key", "text"])
        parts = [p for held in suffixes._parts(iter([batch])) for p in held]
        assert sum(p[3] for p in parts) == sum(max(0, len(r[1]) - 199) for r in rows)
        assert all(len(p[1]) == p[3] + 199 for p in parts) and max(p[3] for p in parts) <= part
        return
    got = sorted(tuple(r) for r in suffixes.without_repeats(docs).collect())
    expected = [(i, *e) for i, e in enumerate(plain(data))]
    assert got == expected
    assert sum(e[2] > 0 for e in expected) > 30


def test_strings_of_many_suffixes():
    """More bytes than a part holds: equal text at equal places has equal names, other text has not."""
    import pyarrow as pa

    rng = random.Random(8)
    parts = [rng.randbytes(300) for _ in range(4_000)]
    place = (1000 << 16) | (100 << 8)
    rows = pa.RecordBatch.from_arrays(
        [pa.array([1] * 8_000), pa.array([1] * 8_000), pa.array(range(8_000)), pa.array([place] * 8_000), pa.array(parts * 2)],
        ["core", "n", "key", "place", "part"],
    )
    row, start, names = suffixes._strings(rows)
    assert len(names) == 8_000 * 101 and len(set(names.tolist())) == 4_000 * 101
    assert (names[: 4_000 * 101] == names[4_000 * 101 :]).all() and start.min() == 900 and start.max() == 1000


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL", 1)
    data = texts(4)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(data)], "doc_id long, text string")
    assert sorted(tuple(r) for r in suffixes.without_repeats(docs).collect()) == [(i, *e) for i, e in enumerate(plain(data))]


def test_empty_null_ids_and_long_texts(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(7)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    data = [(None, long[:400]), (None, "z" * 10), (5, long)]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in suffixes.without_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(None, 400): (400, 1), (None, 10): (0, 0), (5, 1_300_000): (400, 1)}
