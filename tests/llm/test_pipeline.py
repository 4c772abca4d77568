"""The corpus pipeline, stage by stage against brute force on a small fixture, and the registration of its queries."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def _write(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def _corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(30, 60))]
        if i % 6 == 0:
            words[5] = "grumpfel"
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    copy = rows[1][1]
    rows += [(300, copy, "en", "s1", 0), (301, copy + " more", "en", "s2", 0), (302, None, None, None, None), (303, "", "en", "s0", 0), (304, "tiny", "en", "s0", 4)]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = _corpus()
    sf = str(tmp_path)
    _write(spark, sf, rows, labels)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/stage{k}")
        docs = spark.read.parquet(f"{sf}/stage{k}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    clean = {r[0] for r in rows if "grumpfel" not in (r[1] or "")}
    assert {r["doc_id"] for r in kept["toxicity"]} == clean
    assert {r["doc_id"] for r in kept["line dedup"]} == clean - {300, 301}  # nothing is left of the copies
    assert {r["doc_id"] for r in kept["near dedup"]} == clean - {300, 301}
    size = {r["doc_id"]: len((r["text"] or "").split()) for r in kept["near dedup"]}
    assert abs(sum(size[r["doc_id"]] for r in kept["mixing"]) - sum(size.values())) <= 10
    placed = [(r["doc_id"], r["start"]) for r in kept["packing"]]
    assert sorted({d for d, _ in placed}) == sorted({r["doc_id"] for r in kept["mixing"]}) and len([1 for _, s in placed if s == 0]) == len(kept["mixing"])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_empty_table(spark, tmp_path, name):
    sf = str(tmp_path)
    _write(spark, sf, [], [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf).count() == 0
