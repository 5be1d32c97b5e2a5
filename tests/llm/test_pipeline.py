from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parley.llm import copies, decontaminate, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF)
        if name != "encoding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out = spark.createDataFrame(out.collect(), out.schema)
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert after.items() <= before.items()
            seen.append(len(before) - len(after))
        docs = out
    rows = docs.collect()
    assert all(r["round_trip"] and r["parity"] for r in rows) and sum(seen) > 0
    run = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in run.collect()) == sorted(r["doc_id"] for r in rows)


def test_stages_agree_with_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(corpus_pipeline.not_toxic(spark, docs, SF)) == ids(toxicity.score(docs, labels).where("predicted = 0"))
    assert ids(corpus_pipeline.decontaminated(spark, docs, SF)) == ids(decontaminate.report(decontaminate.locate(docs, bench)).where("NOT contaminated"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_rows(spark, name):
    sf = "/root/testdata/sf0.001"
    tables = {"op1": "pages", "op6": "pages", "op7": "pages", "op4": None}
    out = queries.QUERIES[name](spark, sf)
    source = tables.get(name.split("_")[0], "documents")
    if source:
        assert out.count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
    else:
        assert out.count() == 25 * 20


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows_are_the_sqls(spark, name):
    from compare import differences

    assert differences(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) == ""


def brute_kept(rows):
    """Least ids of the components of texts whose five-word shingle sets are alike by 0.8, every pair compared."""
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a == b or both * 9 >= 4 * (len(a) + len(b)):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return {min(i for (i, _), r in zip(rows, root, strict=True) if r == x) for x in set(root)}


def test_near_copies_are_found_by_exact_similarity(spark):
    rng = random.Random(5)
    vocab, rows = [f"w{i}" for i in range(2000)], [(900, None), (901, " "), (902, "one two"), (903, "One  two"), (904, "one three")]
    for i in range(12):  # planted near copies: words replaced, ends cut off, and texts that only share a part
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 200))]
        rows.append((i * 10, " ".join(words)))
        for j in range(1, 6):
            copy = list(words)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((i * 10 + j, " ".join(copy)))
        rows += [(i * 10 + 6, " ".join(words[: len(words) * 9 // 10])), (i * 10 + 7, " ".join(words[: len(words) // 2]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    want, op3 = brute_kept(rows), {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert {r["doc_id"] for r in stage(spark, docs, SF).collect()} == want and len(want) < len(op3)
    assert {r["doc_id"] for r in copies.deduplicate(docs, chunk=2).collect()} == want  # clusters wider than a tile lose no pair


def test_fingerprints_give_candidates(spark, monkeypatch):
    rng = random.Random(7)
    vocab, rows = [f"w{i}" for i in range(5000)], []
    for i in range(20):
        words = [rng.choice(vocab) for _ in range(3000)]
        rows += [(i * 10, " ".join(words)), (i * 10 + 1, " ".join([*words[:-1], "another"])), (i * 10 + 2, " ".join(words[:1500]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(copies, "_chains", lambda distinct: distinct.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0))
    near = [(a, b) for a, b in ((simhash.fingerprint(rows[i * 3][1], 5), simhash.fingerprint(rows[i * 3 + 1][1], 5)) for i in range(20)) if bin(a ^ b).count("1") <= simhash.RADIUS]
    assert len(near) > 15
    assert {r["doc_id"] for r in copies.deduplicate(docs).collect()} == brute_kept(rows), "without bands, texts within the radius are still linked, exactly checked"


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == brute_kept(rows)


def tables(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2.0, 3) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, k string, weight double, u int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_over_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item = text(14)
    rows = [(i, text(40) + (" vileword" if i % 4 == 0 else "")) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "  "), (None, text(30)), (503, text(30)), (503, "one row of an id"), (503, "one row of an id"), (504, "x " + item + " y"), (505, text(200_000)), (506, "one row of an id")]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 0, 1), (3, None, None), (7, 1, 5), (1, 0, 0), (1, 0, 0)]
    tables(spark, tmp_path, rows, labels, [(1, item), (2, None), (None, item), (3, ""), (1, item)])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = [r["doc_id"] for r in out]
    assert None in got and 505 in got and 504 not in got and not any(i is not None and i < 200 and i % 4 == 0 for i in got)
    assert {i for i in range(200) if i % 4} <= set(got) and len({500, 501, 502} & set(got)) == 1 and 503 in got and 506 not in got
    assert all(r["parity"] and r["round_trip"] for r in out)


def test_run_over_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_without_labels_and_benchmark(spark, tmp_path):
    tables(spark, tmp_path, [(1, "some words"), (2, "other words here")], [], [])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 2]
