import random
from pathlib import Path

import pytest

import corpus_pipeline as pipeline
from logloom.llm import winnow
from tests.llm.test_ops import brute_contamination, brute_lines, brute_print, components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else []
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before, docs)
        assert name == "sentencepiece" or docs.columns == columns
    before, after = out["quality"]
    bad = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
    gone = {k for k, _ in before} - {r.doc_id for r in after.collect()}
    assert gone & bad and len(bad & {r.doc_id for r in after.collect()}) <= len(bad) // 5
    before, after = out["line_dedup"]
    removed = brute_lines(before)
    assert {r.doc_id: r.text for r in after.collect()} == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in removed.get(k, ())) for k, t in before}
    before, after = out["near_dedup"]
    prints = {k: brute_print(t) for k, t in before}
    of = components(set(prints.values()))
    least = {}
    for k, p in prints.items():
        least[of[p]] = min(k, least.get(of[p], k))
    assert {r.doc_id for r in after.collect()} == set(least.values())
    before, after = out["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after.collect()} == {x[0] for x in brute_contamination(before, items) if not x[-1]}
    before, after = out["sentencepiece"]
    assert {r.doc_id for r in after.where("decodes").collect()} == {k for k, _ in before} and after.where("not decodes").count() == 0
    assert winnow.WINDOW == 13 and pipeline.run(spark, FOLDER).columns == after.columns


def brute_sets(texts):
    words = {k: t.encode().lower().split() for k, t in texts}
    return {k: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}


def test_near_dedup_stage_links_edited_copies(spark):
    """Whole recall against brute force: five-word Jaccard of 0.8 or more, in groups above and below shingles.SMALL."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    for group in range(40):
        base = [word() for _ in range(r.randint(6, 300))]
        for _ in range(r.choice([1, 2, 3, 12, 30])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 45))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    passage = " ".join(word() for _ in range(12))
    rows += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(30)] + [passage, "", " "]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    prints, sets = {k: brute_print(t) for k, t in rows}, brute_sets(rows)
    near = components(set(prints.values()))
    root = {k: k for k, _ in rows}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n_pairs = 0
    for a, _ in rows:
        for b in range(a):
            like = bool(sets[a] | sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            n_pairs += like and near[prints[a]] != near[prints[b]]
            if like or near[prints[a]] == near[prints[b]]:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert n_pairs > 100
    kept = pipeline.stage_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({find(k) for k, _ in rows})


LONG = "word " * 3000 + "x" * 3000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one two three four five six"), (5, "one two three four five six"), (5, "one two three four five six"), (None, "no key at all here"), (6, LONG), (7, LONG), (8, "é ñ 😀 ▁ tabs\tand\r\nlines")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_a_whole_run_over_odd_rows_and_over_none(spark, tmp_path, rows):
    """Nothing is labelled, so that quality keeps all; of copies one stays, and a row without a key stays."""
    spark.createDataFrame([(k, t, "en", "s", len(t or ""), "theirs") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k1 string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "é ñ tabs and lines")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.decodes for r in out)
    kept = {r.doc_id for r in out}
    # 1, 2 and 3 have no words; the second copy of a line goes before documents are compared, which leaves 5 and 7 empty as well
    assert kept == ({None, 1, 4, 6, 8} if rows else set())
