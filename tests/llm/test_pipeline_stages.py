"""The corpus pipeline: every stage against a brute-force version, and the contract of the stages."""

import random

import corpus_pipeline
from tessera.llm import decontaminate, line_dedup, minhash
from tests.llm.test_operators import prose


def corpus():
    rows = [(i, prose(70, i), "en", f"s{i % 2}") for i in range(60)]
    rows += [(100 + i, prose(70, i), "en", "s0") for i in range(10)]  # copies
    w = prose(200, 500).split()
    for i in range(5):
        v = list(w)
        v[3 + i] = "edited"
        rows.append((200 + i, " ".join(v), "en", "s1"))
    rows += [(300, prose(30, 600) + " " + prose(40, 700), None, None), (301, None, "en", "s0"), (302, "", "en", "s0"), (303, "junk " * 200, "en", "s0")]
    rows += [(400 + i, f"shared header line of the site\n{prose(60, 800 + i)}", "fr", "s1") for i in range(6)]
    random.Random(1).shuffle(rows)
    return rows


def test_stages(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, la, so, len(t or "")) for i, t, la, so in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, prose(40, 700)), (2, prose(50, 999))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (now, spark.read.parquet(f"{tmp_path}/{name}"))
        now = seen[name][1]
    for name, (_, out) in list(seen.items())[:-1]:
        assert out.columns == docs.columns, name
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    kept = {d for d, _ in pairs(seen["quality_rules"][1])}
    assert kept >= set(range(60)) | set(range(200, 205)) and not kept & {301, 302, 303}

    before, after = pairs(seen["line_dedup"][0]), dict(pairs(seen["line_dedup"][1]))
    want = {d: h for d, _, _, h in line_dedup.brute_force(before)}
    import hashlib

    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in seen["line_dedup"][1].collect())

    before, after = pairs(seen["near_duplicates"][0]), pairs(seen["near_duplicates"][1])
    classes = minhash.brute_force(before)
    assert sorted(d for d, _ in after) == sorted(d for d in classes if classes[d] == d)

    before, after = pairs(seen["decontamination"][0]), {d for d, _ in pairs(seen["decontamination"][1])}
    leaks = {d for d, _ in decontaminate.brute_force(before, items)}
    assert 300 in leaks and after == {d for d, _ in before} - leaks

    assert {r["doc_id"] for r in seen["packing"][1].collect()} == after
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"][1].count()
