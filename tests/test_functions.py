from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from parley.functions import hashing, text, timing
from parley.operators import catalogue, intervals, pieces, scoring, simulator
from parley.plans.metrics import ata
from parley.streaming import endpointing, runs


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(fn(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("value, want", [(None, None), ("", ""), ("  a \n b ,  c ", "a b, c"), ("ÀB !", "àb!")])
def test_normalise(spark, value, want):
    assert one(spark, value, text.normalise) == want


def test_words_and_sentences(spark):
    assert one(spark, " a  b\tc ", text.ws_words) == ["a", "b", "c"]
    assert one(spark, "", text.ws_words) == []
    assert one(spark, "it's 2 days, déjà", text.alpha_words) == ["it", "s", "days", "déjà"]
    assert one(spark, "One. Two! Three? four", text.sentences) == ["One.", "Two!", "Three?", "four"]
    assert one(spark, 'He said "no!" ', text.terminal_mark) == "!"
    assert one(spark, "well...", text.strip_terminal) == "well"
    assert one(spark, "açaí Ñ", text.fold_accents) == "acai N"
    assert one(spark, "<|a|> hi <|b|>", text.tokens) == ["<|a|>", "<|b|>"]
    assert one(spark, "# Head\n- **x** [y](http://z) http://q", text.spoken) == "Head x y"
    assert one(spark, "aaaaaab", text.repeated_run) is True and one(spark, "aaaaab", text.repeated_run) is False
    assert len(text.MARKED) == len(text.PLAIN)


@pytest.mark.parametrize("n, sec, back, formal", [(0, 0.0, True, False), (1, 0.35, True, False), (3, 3 / 3.25, True, False), (4, 4 / 3.25, False, True), (13, 4.0, False, True)])
def test_clock(spark, n, sec, back, formal):
    row = spark.createDataFrame([(n,)], "n bigint").select(timing.speech_seconds(F.col("n")).alias("s")).select("s", timing.is_backchannel(F.col("s"), F.lit(n)).alias("b"), timing.is_formal(F.col("s"), F.lit(n)).alias("f")).first()
    assert row["s"] == pytest.approx(sec) and row["b"] == back and row["f"] == formal


@pytest.mark.parametrize("n, first, last, words, want", [(0, None, None, None, 0), (1, 0.0, 0.5, 2, 0), (1, 0.0, 0.5, 5, 1), (2, 3.36, 10.38, 22, 1)])
def test_takeover(spark, n, first, last, words, want):
    df = spark.createDataFrame([(n, first, last, words)], "n bigint, a double, b double, w bigint")
    assert df.select(timing.takeover(F.col("n"), F.col("a"), F.col("b"), F.col("w"))).first()[0] == want


@pytest.mark.parametrize("row, want", [((0.0, 0.0, 0.0, None), 0.0), ((1.0, 1.0, 1.0, 1.0), 0.5), ((0.1, 0.2, 0.9, 0.95), 0.8875), ((0.1, 0.2, 0.9, None), 0.65)])
def test_ata(spark, row, want):
    df = spark.createDataFrame([row], "a double, b double, c double, d double")
    assert df.select(ata(*[F.col(c) for c in "abcd"])).first()[0] == pytest.approx(want)


def test_hash_split_is_the_digest_modulo_ten(spark):
    keys = [f"en:conv:{i}" for i in range(50)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.digest_split(F.col("k")).alias("r")).collect()
    assert all(r["r"] == int(hashlib.sha1(r["k"].encode()).hexdigest(), 16) % 10 for r in got)


def test_pieces_keep_every_word(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a b  c\nd e f g h i j k l m n o p"), (1, 1, "assistant", ""), (2, 0, "user", None)], "conv_id bigint, turn bigint, role string, text string")
    got = pieces.pieces(turns).orderBy("conv_id", "turn", "piece").collect()
    assert " ".join(r["text"] for r in got) == "a b c d e f g h i j k l m n o p"
    assert max(r["n_words"] for r in got) <= 7 and [r["ends_turn"] for r in got] == [False] * (len(got) - 1) + [True]


def test_merge_close_and_overlap(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.04, 2.0), (1, 3.0, 4.0), (1, 3.5, 3.6), (2, 5.0, 5.0)], "k bigint, s double, e double")
    got = sorted(tuple(r) for r in intervals.merge_close(rows, ["k"], "s", "e", 0.05).collect())
    assert got == [(1, 0.0, 2.0, 2), (1, 3.0, 4.0, 2), (2, 5.0, 5.0, 1)]
    b = spark.createDataFrame([(1, 0.5, 3.2)], "k bigint, s2 double, e2 double")
    pairs = intervals.overlapping(rows, b, ["k"], 0.7).select("s", "shared").orderBy("s").collect()
    assert [(r["s"], round(r["shared"], 6)) for r in pairs] == [(0.0, 0.5), (1.04, 0.96), (3.0, 0.2)]


def test_divergence_limits(spark):
    total = lambda p, q: spark.createDataFrame(list(zip(p, q)), "p double, q double").select(F.sum(scoring.jensen_shannon(F.col("p"), F.col("q")))).first()[0]
    assert total([1.0, 0.0], [0.0, 1.0]) == pytest.approx(1.0)
    assert total([0.3, 0.7], [0.3, 0.7]) == pytest.approx(0.0)
    assert total([0.3, 0.7], [0.6, 0.4]) == pytest.approx(total([0.6, 0.4], [0.3, 0.7]))


def test_scores_without_positives_are_null(spark):
    rows = spark.createDataFrame([(0, 0), (0, 0)], "gold bigint, pred bigint")
    got = {r["label"]: r for r in scoring.prf(rows, spark.range(2).withColumnRenamed("id", "label"), "gold", "pred").collect()}
    assert got[0]["f1"] == 1.0 and got[1]["precision"] is None and got[1]["f1"] is None and got[1]["tn"] == 2


def test_filter_update(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "base map<string,string>, new map<string,string>")
    assert df.select(catalogue.merged_filter(F.col("base"), F.col("new"))).first()[0] == {"a": "1", "b": None, "c": "3"}


def timeline(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, piece bigint, t_start double, t_end double, ends_turn boolean")


def test_simulator(spark):
    rows = timeline(spark, [(1, 0, 0, 0.0, 1.0, False), (1, 0, 1, 1.0, 2.0, True), (1, 2, 0, 4.0, 5.0, True), (1, 4, 0, 5.1, 6.0, True)])
    got = simulator.simulate(rows, simulator.after_turn).orderBy("start").collect()
    assert [(r["turn"], round(r["start"], 3), round(r["end"], 3), r["stopped"]) for r in got] == [(0, 2.2, 4.0, True), (4, 6.2, round(6.2 + 20 / 3.25, 3), False)]
    assert simulator.simulate(rows, simulator.never).count() == 0
    assert simulator.simulate(rows.limit(0), simulator.after_turn).count() == 0


def test_stream_states_are_a_loops(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["user_id"]: (r["state"], r["n_taken"], r["n_seen"]) for r in runs.run_latest(endpointing.turn_states(runs.file_stream(spark, sf, "events")), ["user_id"]).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect():
        state, taken, seen = want.get(r["user_id"], ("listening", 0, 0))
        kind = r["event_type"]
        if kind == "purchase":
            taken, state = taken + (state != "answering"), "answering"
        elif kind == "click" and state == "answering":
            state = "yielded"
        elif kind == "view" and state == "yielded":
            state = "listening"
        want[r["user_id"]] = (state, taken, seen + 1)
    assert got == want


def test_sem(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    assert df.agg(timing.sem(F.col("v"))).first()[0] == pytest.approx(math.sqrt(7 / 3) / math.sqrt(3))
    assert df.limit(1).agg(timing.sem(F.col("v"))).first()[0] is None


def test_packing_is_a_loops(spark):
    from parley.operators import folds

    value = "One two. Three four five six. Seven! " + " ".join(["w"] * 12) + ". Last one."
    got = one(spark, value, lambda c: folds.speech_chunks(c, 6))
    want, now, n = [], [], 0
    for s in one(spark, value, text.sentences):
        size = len(s.split())
        if n and n + size > 6:
            want.append(" ".join(now))
            now, n = [], 0
        now.append(s)
        n += size
    assert got == [*want, " ".join(now)] and one(spark, "", lambda c: folds.speech_chunks(c)) == []


def test_slots(spark):
    from parley.operators import folds

    rows = spark.createDataFrame([(1, 0, "12 34"), (1, 1, "567"), (1, 2, "89012345"), (2, 0, "123"), (2, 1, "x"), (3, 0, "1"), (4, 0, None)], "k bigint, i bigint, t string")
    got = {r["k"]: (r["digits"], r["state"]) for r in folds.slots(rows, ["k"], "i", "t").collect()}
    assert got[1] == ("12345678901", "complete") and got[2] == ("", "error") and got[3] == ("1", "open")


def test_covering_is_a_loops(spark):
    from parley.operators import selection

    rows = [(1, 5, 0, 1), (2, 0, 3, 1), (3, 4, 1, 0), (4, 0, 0, 9), (5, 0, 3, 1)]
    got = selection.covering(spark.createDataFrame(rows, "k bigint, a bigint, b bigint, c bigint"), "k", ["a", "b", "c"], 4)
    have, left, want = [0, 0, 0], dict((r[0], r[1:]) for r in rows), []
    for _ in range(4):
        gain = {k: round(sum(x / (1 + h) for x, h in zip(v, have)), 9) for k, v in left.items()}
        best = min(gain, key=lambda k: (-gain[k], k))
        want.append((best, gain[best]))
        have = [h + x for h, x in zip(have, left.pop(best))]
    assert [(k, pytest.approx(g)) for k, g in got] == want and len(selection.covering(spark.createDataFrame(rows, "k bigint, a bigint, b bigint, c bigint"), "k", ["a"], 9)) == 5


def test_adopted_thresholds_are_a_loops(spark):
    import random

    from parley.operators import selection

    rng = random.Random(3)
    rows = []
    for _ in range(300):
        p = [rng.random() for _ in range(4)]
        rows.append((rng.randrange(4), [x / sum(p) for x in p]))

    def f1(limits):
        pred = []
        for _, p in rows:
            may = [x if x >= limits.get(t, 0.0) else -1.0 for t, x in enumerate(p)]
            pred.append(max(range(4), key=lambda t: (may[t], -t)) if max(may) >= 0 else 0)
        total = 0.0
        for t in range(4):
            tp = sum(g == t == q for (g, _), q in zip(rows, pred, strict=True))
            wrong = sum((g == t) != (q == t) for (g, _), q in zip(rows, pred, strict=True))
            total += 2 * tp / (2 * tp + wrong) if tp or wrong else 0.0
        return total / 4

    candidates, kept, want = {0: 0.4, 1: 0.3, 3: 0.35}, {}, []
    best = f1(kept)
    for t, v in candidates.items():
        if f1(kept | {t: v}) - best >= 5e-4:
            kept[t], best = v, f1(kept | {t: v})
            want.append((t, v, best))
    got = selection.adopted(spark.createDataFrame(rows, "gold bigint, p array<double>"), [0, 1, 2, 3], candidates)
    assert [(t, v, pytest.approx(f)) for t, v, f in got] == want and want


@pytest.mark.parametrize("value, want", [("see é é é", "see é"), ("done. ő", "done."), ("ok ok", "ok"), ("", ""), (None, None)])
def test_degenerate_tail(spark, value, want):
    assert one(spark, value, text.degenerate_tail) == want


def test_allow_lists_and_guards(spark):
    from parley.plans import records as rules

    allowed = spark.createDataFrame([("m", "a"), ("m", "b")], "model string, name string")
    runs_ = spark.createDataFrame([("m", "b"), ("m", None)], "model string, candidate string")
    assert sorted(r["name"] for r in rules.resolved(runs_, allowed).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="not allowed: m x"):
        rules.resolved(spark.createDataFrame([("m", "x")], "model string, candidate string"), allowed).collect()
    rows = spark.createDataFrame([(1, "a", None), (2, None, None)], "id int, text string, error string")
    assert rules.required(rows.where("id = 1"), ["text"]).count() == 1
    with pytest.raises(Exception, match="missing input: text"):
        rules.required(rows, ["text"]).collect()
    assert rules.without_errors(rows.withColumn("error", F.when(F.col("id") == 2, "x"))).count() == 1


def test_settled_words_are_held_back(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(i, "w", start + timedelta(seconds=i)) for i in range(11)]
    spark.createDataFrame(rows, "event_id bigint, event_type string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = runs.run_to_table(endpointing.settled_words(runs.file_stream(spark, str(tmp_path), "events"), "2 seconds"))
    assert sorted(r["event_id"] for r in got.collect()) == list(range(8)), "words at 8, 9 and 10 s are too young at 10 s"
    twin = endpointing.settled_of(spark.read.parquet(f"{tmp_path}/events.parquet"), "2 seconds")
    assert sorted(r["event_id"] for r in twin.where("settled").collect()) == list(range(8))
    both = endpointing.flushed(got, spark.read.parquet(f"{tmp_path}/events.parquet"))
    assert sorted((r["event_id"], r["phase"]) for r in both.collect()) == [(i, "settled" if i < 8 else "flush") for i in range(11)]


def test_trace_labels_follow_targets(spark):
    from parley.plans import decisions

    events = [(1, 0, 1.0, "partial", False, "hello"), (1, 1, 2.0, "final", True, "there"), (1, 2, 2.5, "silence", False, ""), (1, 3, 3.0, "silence", False, ""), (1, 4, 3.5, "silence", False, ""), (1, 5, 4.0, "partial", False, "more"), (1, 6, 4.5, "silence", False, "")]
    rows = [(*e, s) for s in (decisions.SUBSETS[3],) for e in events]
    df = spark.createDataFrame(rows, "conv_id bigint, i bigint, at double, kind string, ends boolean, text string, subset string")
    marks = spark.createDataFrame([(1, 2.2, None, None)], "conv_id bigint, first_end double, second_start double, second_end double")
    said = spark.createDataFrame([], "conv_id bigint, s double, e double")
    got = [r["label"] for r in decisions.trace_labels(df, said, marks).orderBy("i").collect()]
    assert got == [decisions.WAIT, decisions.TAKE, decisions.TAKE, decisions.TAKE, decisions.THINK, decisions.WAIT, decisions.WAIT]
    cut = df.withColumn("subset", F.lit(decisions.SUBSETS[4]))
    marks = spark.createDataFrame([(1, None, 0.5, 2.0)], "conv_id bigint, first_end double, second_start double, second_end double")
    said = spark.createDataFrame([(1, 0.9, 1.5), (1, 2.9, 3.2)], "conv_id bigint, s double, e double")
    got = [r["label"] for r in decisions.trace_labels(cut, said, marks).orderBy("i").collect()]
    assert got == [decisions.STOP, decisions.TAKE, decisions.TAKE, decisions.NONE, decisions.TAKE, decisions.WAIT, decisions.WAIT]
