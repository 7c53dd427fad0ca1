import random

import corpus_pipeline
from tablecraft.llm import bpe, mixing, secrets
from tests.llm.test_simhash import brute


def test_stages_one_by_one(spark, tmp_path):
    """Each stage against plain code, on what the stage before it returned."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abdeghiklnoprstu", k=rng.randrange(3, 9))) for _ in range(500)]
    rows, marks = [], []
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randrange(40, 90)))
        if i % 5 == 0:
            text = "vile scoundrel " + text + " vile scoundrel rotter rotter"
        if i % 7 == 1:
            text += " password=abcdef0123456789"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        marks.append((i, 1, int(i % 5 == 0)))
    rows += [(500 + i, rows[i + 1][1], "en", None, 1) for i in range(0, 40, 5)] + [(None, None, None, None, None), (900, "", "en", "s0", 0)]
    rows += [rows[3]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], str(tmp_path)).write.parquet(f"{tmp_path}/step{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/step{i}"))
    assert all(s.columns == steps[0].columns for s in steps[:5])
    raw, clean, single, masked, mixed, tokens = ([tuple(r) for r in s.collect()] for s in steps)

    assert not any("scoundrel" in (r[1] or "") for r in clean)
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in raw if "scoundrel" not in (r[1] or ""))

    groups = {}
    for (doc, text, *_), (_, _, component) in zip(clean, brute([r[:2] for r in clean])):
        groups.setdefault(component, set()).add((doc, text))
    assert len(single) == len(groups)
    assert all(min(d for d, _ in g if d is not None) in {r[0] for r in single} for c, g in groups.items() if c is not None)

    assert {r[0] for r in masked} == {r[0] for r in single}
    assert not any("password=" in (r[1] or "") for r in masked)
    assert sum(secrets.MASK in (r[1] or "") for r in masked) == sum("password=" in (r[1] or "") for r in single)

    plan = {r.doc_id: r for r in mixing.mix_plan(steps[3]).collect()}
    times = {}
    for r in mixed:
        times[r[0]] = times.get(r[0], 0) + 1
    assert times == {d: n for d, r in plan.items() if (n := sum(2 * p.words >= r.size for p in r["passes"]))}

    codec = bpe.Codec(open(bpe.default_path(), encoding="utf-8").read())
    assert sorted((r[0], r[2]) for r in tokens) == sorted((r[0], codec.encode(r[1] or "")) for r in mixed)
    assert all(r[1] == len(r[2]) and r[3] for r in tokens)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(tokens)
