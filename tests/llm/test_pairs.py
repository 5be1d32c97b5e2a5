"""Near duplicates, neighbours, decontamination and shards against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from parley.llm import ann, decontaminate, shards, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, lang string, k string, g bigint, fp bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "own", 7, 8) for i, t in rows], DOCS)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


def corpus(n=120, seed=3):
    rng, rows = random.Random(seed), []
    vocab = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(300)]
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(40, 160))]
        rows.append((10 * i, " ".join(words)))
        if i % 4 == 0:
            rows.append((10 * i + 1, " ".join(words)))
        if i % 3 == 0:
            words[len(words) // 2] = "changed"
            rows.append((10 * i + 2, "\n".join(words)))
    return [*rows, (5001, None), (5002, ""), (5003, " \t\n"), (5004, "One"), (5005, "one two"), (5006, "x " * 30000)]


def test_fingerprints_and_components(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert {i: int(got[i]["fingerprint"], 16) for i, _ in rows} == {i: f for (i, _), f in zip(rows, fps)}
    label = plain_components(fps)
    least = {}
    for (i, _), c in zip(rows, label):
        least[c] = min(least.get(c, i), i)
    assert {i: got[i]["component_id"] for i, _ in rows} == {i: least[c] for (i, _), c in zip(rows, label)}
    assert sum(least[c] != i for (i, _), c in zip(rows, label)) > 30


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_slices_give_all_links(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for i in range(100, 400):
        x = int(fps[i % 100])
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            x ^= 1 << int(b)
        fps[i] = x
    fps = np.unique(fps)
    rng.shuffle(fps)
    group = np.sort(rng.integers(0, 3, len(fps)))
    a, b = simhash.forest(fps, group, radius)
    assert len(a) <= len(fps)

    def classes(edges):
        label = list(range(len(fps)))
        for i, j in edges:
            if label[i] != label[j]:
                x, y = max(label[i], label[j]), min(label[i], label[j])
                label = [y if v == x else v for v in label]
        return label

    every = [(i, j) for i in range(len(fps)) for j in range(i) if group[i] == group[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius]
    assert classes(every) == classes(zip(a.tolist(), b.tolist()))


def test_large_groups_are_split_without_loss(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) & ~0xFFFF for _ in range(30)]  # all share a stretch
    fps = sorted({x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in base for _ in range(6)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    whole, split = ({(r["node"], r["root"]) for r in simhash.components(rows, simhash.links(rows, group=g)).collect()} for g in (10**6, 5))
    assert whole == split and len(whole) > 30


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"W{i % 977}\x0b{i}" for i in range(3000))
    want = plain_fingerprint(text)
    chunks = simhash.space_chunks
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(simhash, "space_chunks", lambda t, _, s=size: chunks(t, s))
        assert simhash.fingerprint(text) == want


def test_empty_and_repeated_documents(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "other words stand here"), (None, None), (3, "")]
    got = sorted(str(tuple(r)) for r in simhash.near_duplicates(docs_of(spark, rows)).select("doc_id", "component_id").collect())
    assert got == sorted(map(str, [(1, 1), (1, 1), (None, 1), (2, 2), (None, 3), (3, 3)]))
    kept = simhash.deduplicate(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "k", "g", "fp"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]


def test_paths_are_contracted(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 90)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in simhash.components(edges, edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90}


def plain_hits(docs, items, window):
    out = {}
    cut = {i: WORD.findall(lower(t)) for i, t in items if i is not None}
    for i, t in docs:
        words, hit, found = WORD.findall(lower(t)), set(), set()
        for item, w in cut.items():
            size = min(window, len(w))
            for a in range(len(w) - size + 1) if w else ():
                for s in range(len(words) - size + 1):
                    if words[s : s + size] == w[a : a + size]:
                        hit.update(range(s, s + size))
                        found.add(item)
        out[i] = (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def plain_longest(text, by_item, contaminated, window=10):
    """The longest match of at least a window, or of a whole short item: words, place in the document, item, place in the item."""
    words, best = WORD.findall(lower(text)), (0, None, None, None)
    found = []
    for item, texts in by_item.items():
        for w in (WORD.findall(lower(t)) for t in texts):
            for o in range(len(w)):
                for p in range(len(words)):
                    n = 0
                    while o + n < len(w) and p + n < len(words) and w[o + n] == words[p + n]:
                        n += 1
                    if n >= min(window, len(w)) and n:
                        found.append((-n, p, str(item), o))
    if found:
        n, *rest = min(found)
        best = (-n, *rest)
    assert bool(found) == contaminated
    return best


def test_neighbouring_items_make_no_longer_match(spark):
    words = [f"w{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words[:10])), (2, " ".join(words[10:]))], "item_id bigint, text string")
    got = decontaminate.report(decontaminate.locate(docs_of(spark, [(1, "x " + " ".join(words) + " y")]), bench)).first()
    assert (got["n_hit"], got["longest_hit"], got["longest_at"], got["longest_item"], got["item_at"]) == (20, 10, 1, "1", 0)


def test_very_long_text_is_decontaminated(spark, monkeypatch):
    item = " ".join(f"q{i}" for i in range(30))
    text = "word other " * 300_000 + item + " tail" * 100_000
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = decontaminate.report(decontaminate.locate(docs_of(spark, [(1, text), (2, text[:-5])]), bench)).collect()
    assert [(r["n_words"], r["n_hit"], r["longest_hit"], r["longest_at"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(700_030, 30, 30, 600_000), (700_029, 30, 30, 600_000)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, block_bytes):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(12)]  # few words, so runs of them are long
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(5, 25))) for i in range(12)] + [(20, "Short One"), (21, ""), (22, None), (None, "v1 v2"), (2, "a second row of item two that has more than ten words in it")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, text(9) + ", " + items[i][1].upper() + "! " + text(30)) for i in range(10)] + [(200, None), (201, ""), (202, "?!"), (203, "a SHORT-one here short one"), (204, items[0][1]), (205, "x short one then v1 v2 y")]
    items += [(30, "then short one then follows a longer text of more than ten words"), (31, "short one then")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.locate(docs_of(spark, docs), bench, block_bytes=block_bytes)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.report(found).collect()}
    by_item = {}
    for i, t in items:
        if i is not None:
            by_item.setdefault(i, []).append(t)
    want = plain_hits(docs, [(i, t) for i, ts in by_item.items() for t in ts[:1]], 10)
    for i, t in by_item[2][1:] and [(2, by_item[2][1])]:
        more = plain_hits(docs, [(i, t)], 10)
        assert not any(m[1] for m in more.values())
    assert got == want and sum(v[4] for v in got.values()) >= 12
    for r in found.collect():
        assert (r["longest"], r["longest_at"], r["longest_item"], r["item_at"]) == plain_longest(dict(docs)[r["doc_id"]], by_item, bool(want[r["doc_id"]][1])), r
    kept = decontaminate.clean(docs_of(spark, docs), bench, block_bytes=block_bytes)
    assert kept.columns == ["doc_id", "text", "lang", "k", "g", "fp"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if not v[4]}


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    rows = docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c")])
    got = decontaminate.report(decontaminate.locate(rows, bench))
    assert sorted((str(r["doc_id"]), r["n_words"], r["contaminated"], r["items_sha256"]) for r in got.collect()) == [("1", 2, False, hashlib.sha256(b"").hexdigest())] * 2 + [("None", 1, False, hashlib.sha256(b"").hexdigest())]
    assert decontaminate.locate(rows.limit(0), bench).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for top in (2, 4):
        stream = rng.integers(0, top, 300)
        tail = lambda i: stream[i : i + (list(stream[i:]) + [0]).index(0)].tolist()
        assert [tail(i) for i in decontaminate.suffix_array(stream).tolist()] == sorted(tail(i) for i in range(300))


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    vecs = rng.standard_normal((6000, 64)) * rng.uniform(0.5, 1.5, (6000, 1))
    rows = [(i, [float(np.float32(x)) for x in v], "c", i) for i, v in enumerate(vecs)]
    rows += [(7001, None, "c", 1), (7002, [0.0] * 64, "c", 1), (7003, [float("nan")] * 64, "c", 1), (7004, [None] * 64, "c", 1), (7005, [float("inf")] * 64, "c", 1), (None, [1.0] * 64, "c", 1), (7020, [], "c", 1), (7040, [1.0] * 63, "c", 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, b string, id bigint")
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    exact = np.array([r[1] for r in rows[:6000]], np.float64)
    hits = 0
    assert sorted(got) == list(range(0, 6000, 20))
    for q, found in got.items():
        scores = exact @ exact[q]
        scores[q] = -np.inf
        best = set(np.lexsort((np.arange(6000), -scores))[:20].tolist())
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21)) and all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len(best & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.95


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()]
    assert sorted(got)[:4] == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (0, 4, 3, 0.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    same = spark.createDataFrame([(0, [1.0, 0.5])] + [(4, [1.0, 1.0])] * 50 + [(0, [0.5, 0.5])], "vec_id bigint, embedding array<float>").repartition(5)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(same, same.where("vec_id % 20 = 0")).collect()]
    assert sorted(got) == [(0, i, 4, 1.0) for i in range(1, 21)], "of two vectors of a query the least, and as many of rows alike as can be found"


def test_neighbours_in_several_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in v], i, "f") for i, v in enumerate(rng.standard_normal((900, 16)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id bigint, file string")
    exact = np.array([r[1] for r in rows], np.float64)
    hits = 0
    for r in ann.search(df, df.where("vec_id % 20 = 0"), rows=200, query_rows=10).collect():
        scores = exact @ exact[r["query_id"]]
        scores[r["query_id"]] = -np.inf
        assert abs(r["score"] - scores[r["vec_id"]]) < 1e-9
        hits += r["vec_id"] in np.argsort(-scores)[:20]
    assert hits / (45 * 20) >= 0.95


def held_law(got, rows, n=40):
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and set(by) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    groups = {}
    for r in got:
        groups.setdefault(r["text_group"], []).append(r["shard"])
    return groups


def plain_cuts(got):
    links = cut = 0
    texts = {}
    for i, r in enumerate(got):
        texts.setdefault(r["text_group"], []).append(i)
    for rows in texts.values():
        for x in range(len(rows)):
            for y in range(x):
                links += 1
                cut += got[rows[x]]["shard"] != got[rows[y]]["shard"]
    return links, cut


def test_shards(spark):
    from zlib import crc32

    rows = [(i, "hot text") for i in range(700)] + [(1000 + i, f"pair {i // 2}") for i in range(800)] + [(5000 + i, f"single {i} é") for i in range(515)] + [(None, None), (9009, ""), (9009, ""), (9010, None)]
    df = docs_of(spark, rows)
    found = shards.assign(df)
    got = found.collect()
    groups = held_law(got, rows)
    size = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got}
    assert all(size[i] == (len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t in rows)
    quota = len(rows) // 40
    assert all(len(set(s)) == 1 for s in groups.values() if len(s) <= quota), "no group that fits is cut"
    hot = max(groups.values(), key=len)
    assert len(set(hot)) == -(-len(hot) // quota)  # as few shards as can hold it
    measured = shards.cuts(found).first()
    assert (measured["links"], measured["cut"]) == plain_cuts(got) and measured["cut_groups"] == 1
    again = shards.assign(df.repartition(7).orderBy(F.desc("doc_id"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)), "files and their order don't matter"


def test_shards_of_groups_of_all_sizes(spark):
    rng = random.Random(12)
    sizes = [rng.choice([2, 2, 3, 5, 8, 13, 21, 34]) for _ in range(60)] + [50] * 9
    rows = [(1000 * g + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)] + [(-i, f"single {i}") for i in range(1, 120)]
    got = shards.assign(docs_of(spark, rows), shards=12).collect()
    groups = held_law(got, rows, 12)
    quota = len(rows) // 12
    assert max(sizes) <= quota and all(len(set(s)) == 1 for s in groups.values())
    # Three groups in two shards: one of them can't be whole.
    tight = [(10 * g + i, f"group {g}") for g in range(3) for i in range(4)]
    groups = held_law(shards.assign(docs_of(spark, tight), shards=2).collect(), tight, 2)
    assert sum(len(set(s)) > 1 for s in groups.values()) == 1


def test_shards_of_few(spark):
    assert shards.assign(docs_of(spark, [])).count() == 0
    few = [(1, "a"), (1, "a"), (2, None)]
    got = shards.assign(docs_of(spark, few)).collect()
    held_law(got, few)
    assert sorted(r["slot"] for r in got) == [0, 0, 0]
    same = [(7, "alike")] * 90
    held_law(shards.assign(docs_of(spark, same)).collect(), same)
