"""Ranking, blending, contracts, AUC, probabilities, texts and sequences."""

import math
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ruleflow.functions import scores, sequences, templates
from ruleflow.operators import batching, blending, contracts, metrics, positions, profiling, rendering
from ruleflow.operators.joins import join_counted
from ruleflow.operators.ranking import rank_within
from ruleflow.operators.scoring import length_scorer, score_batches

SCORED = "row_id long, rule string, rule_violation double"


def ranked(df):
    return {r.row_id: r.rank_score for r in rank_within(df).collect()}


def ranked_by_window(df):
    """The same in one window per rule, for comparison on small data."""
    whole = Window.partitionBy("rule")
    ordered = whole.orderBy(F.col("rule_violation").asc_nulls_last())
    ties = F.count(F.lit(1)).over(ordered.rangeBetween(Window.currentRow, Window.currentRow))
    scaled = (F.rank().over(ordered) - 1 + (ties - 1) / 2) / F.greatest(F.count(F.lit(1)).over(whole) - 1, F.lit(1))
    usable = F.col("rule_violation").isNotNull() & ~F.isnan("rule_violation") & F.col("rule").isNotNull()
    return {r.row_id: r.rank for r in df.select("row_id", F.when(usable, scaled).alias("rank")).collect()}


def test_rank_demo(spark):
    rows = [(1, "x", 0.9), (2, "x", -3.0), (3, "x", 0.9), (4, "x", 12.5), (5, "x", 0.0), (6, "y", 0.3)]
    assert ranked(spark.createDataFrame(rows, SCORED)) == {1: 0.625, 2: 0.0, 3: 0.625, 4: 1.0, 5: 0.25, 6: 0.0}


def test_rank_ties_missing_and_singletons(spark):
    rows = [
        (1, "A", 0.4), (2, "A", 0.1), (3, "A", 0.4),
        (4, "B", 0.7), (5, "B", 0.2), (6, "B", None), (7, "B", float("nan")),
        (8, None, 0.5), (9, "C", 0.3), (10, "D", None),
    ]
    got = ranked(spark.createDataFrame(rows, SCORED))
    assert got == {1: 0.75, 2: 0.0, 3: 0.75, 4: 1 / 3, 5: 0.0, 6: None, 7: None, 8: None, 9: 0.0, 10: None}


def test_rank_of_skewed_groups_is_the_same_either_way(spark):
    """One rule holds most rows and one score a third of all rows; both ways equal pandas."""
    random.seed(7)
    rows = [
        (i, "big" if i % 10 else f"small{i % 7}", 0.5 if i % 3 == 0 else random.choice([None, random.random()]))
        for i in range(20_000)
    ]
    df = spark.createDataFrame(rows, SCORED)
    frame = pd.DataFrame(rows, columns=["row_id", "rule", "score"])
    frame["score"] = frame["score"].astype(float)
    groups = frame.groupby("rule")["score"]
    frame["rank"] = (groups.rank(method="average") - 1) / (groups.transform("size") - 1).clip(lower=1)
    wanted = {int(i): None if math.isnan(r) else r for i, r in zip(frame["row_id"], frame["rank"])}
    assert ranked_by_window(df) == wanted
    assert ranked(df) == wanted


def test_rank_with_one_score_on_most_rows_and_rules_missing(spark):
    """The hot score is split and rows without a rule or score are spread; nothing is lost."""
    rows = [(i, None if i % 50 == 0 else "r", 0.25 if i % 10 else (None if i % 20 else i / 40_000)) for i in range(30_000)]
    df = spark.createDataFrame(rows, SCORED)
    got = ranked(df)
    assert len(got) == len(rows) and got == ranked_by_window(df)
    counted = df.groupBy("rule", "rule_violation").agg(F.count(F.lit(1)).alias("n"))
    parts = join_counted(df, counted.dropna(), ["rule", "rule_violation"], "n", ["row_id"], share=100)
    assert parts.count() == len(rows)


def test_positions_equal_a_plain_window(spark):
    df = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 10 > 0).cast("int").alias("g"))
    frame = df.toPandas()
    wanted = frame.sort_values(["g", "k"]).assign(p=lambda f: f.groupby("g").cumcount()).set_index("id")["p"].to_dict()
    for digits in (1, 2, 4):
        got = {r.id: r.position for r in positions.hash_positions(df, "k", ["g"], digits=digits).collect()}
        assert got == wanted
    got = {r.id: r.position for r in positions.range_positions(df, ["k"], ["g"]).collect()}
    assert got == wanted


def test_blend_normalises_present_weights(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 1, 1.0)], "slot int, row_id long, rule_violation double")
    assert [r.rule_violation for r in blending.blend(df, {1: 0.2, 2: 0.2, 3: 0.9}).collect()] == [0.5]
    raw = blending.blend(df, {1: 0.2, 2: 0.2}, normalize=False).collect()
    assert [r.rule_violation for r in raw] == [0.2]


def test_blend_drops_incomplete_and_rejects_repeated_ids(spark):
    schema = "slot int, row_id long, rule_violation double"
    rows = [(1, 1, 0.2), (2, 1, 0.4), (1, 2, 0.5), (1, 3, None), (2, 3, 0.1)]
    got = {r.row_id: r.rule_violation for r in blending.blend(spark.createDataFrame(rows, schema), {1: 1, 2: 1}).collect()}
    assert got.keys() == {1, 3}
    assert got[1] == pytest.approx(0.3) and got[3] is None
    with pytest.raises(Exception, match="more than one prediction"):
        blending.blend(spark.createDataFrame([*rows, (1, 2, 0.5)], schema), {1: 1, 2: 1}).collect()


SUBMISSION = "row_id long, rule_violation string"


def failed(spark, rows, ids=(1, 2, 3)):
    sample = spark.createDataFrame([(i,) for i in ids], "row_id long")
    return {r.check: r.violations for r in contracts.failed_checks(spark.createDataFrame(rows, SUBMISSION), sample).collect()}


def test_submission_checks(spark):
    good = [(3, "0.1"), (1, "0"), (2, "1")]
    assert failed(spark, good) == {}
    assert failed(spark, good[:2]) == {"row_count": 1, "id_set": 1}
    assert failed(spark, [*good[:2], (9, "0.5")]) == {"id_set": 2}
    assert failed(spark, [*good[:2], (1, "0.5")]) == {"id_set": 1, "duplicates": 1}
    assert failed(spark, [(1, "x"), (2, None), (3, "1.5")]) == {"finite": 2, "range": 1}
    assert failed(spark, [(1, "0.1"), (1, "0.1"), (2, "0")], ids=(1, 1, 2)) == {"duplicates": 1}
    assert failed(spark, [(1, "-0.1"), (2, "0"), (3, "1e400")]) == {"range": 1, "finite": 1}


def test_wrong_columns_fail_first(spark):
    df = spark.createDataFrame([(1, 2)], "row_id long, other long")
    sample = spark.createDataFrame([(1,)], "row_id long")
    assert [r.check for r in contracts.failed_checks(df, sample).collect()] == ["columns"]
    with pytest.raises(ValueError, match="columns"):
        contracts.require_valid(df, sample)


def test_order_is_restored(spark):
    sample = spark.createDataFrame([(0, 1), (1, 2)], "ord long, row_id long")
    rows = contracts.restore_order(spark.createDataFrame([(2, "0.8"), (1, "0.2")], SUBMISSION), sample).collect()
    assert [(r.row_id, r.rule_violation) for r in rows] == [(1, 0.2), (2, 0.8)]


def test_auc_equals_all_pairs(spark):
    random.seed(3)
    rows = [(random.choice(["a", "b"]), random.randrange(12) / 12, int(random.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, score double, label int")

    def pairs(selected):
        pos = [s for _, s, y in selected if y]
        neg = [s for _, s, y in selected if not y]
        return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))

    assert metrics.roc_auc(df, "score", "label").first().auc == pytest.approx(pairs(rows))
    got = {r.g: r.auc for r in metrics.roc_auc(df, "score", "label", ["g"]).collect()}
    assert got == {g: pytest.approx(pairs([r for r in rows if r[0] == g])) for g in "ab"}
    only = metrics.roc_auc(df.filter("label = 1"), "score", "label").first()
    assert only.auc is None


def test_auc_of_billions_of_rows(spark):
    counts = spark.createDataFrame([(0.1, 0, 5 * 10**9), (0.5, 4 * 10**9, 10**9), (0.9, 2 * 10**9, 0)], "score double, pos long, neg long")
    row = metrics.auc_of_counts(counts, "score").first()
    assert row.auc == pytest.approx((4 * 5.5 + 2 * 6) / (6 * 6)) and (row.positives, row.negatives) == (6 * 10**9, 6 * 10**9)


def test_slots_of_any_number(spark):
    schema = "slot int, row_id long, rule_violation double"
    rows = [(6, 1, 0.1), (70, 1, 0.3), (64, 1, 0.5), (-1, 1, 0.7), (6, 2, 0.1), (70, 2, 0.3)]
    df = spark.createDataFrame(rows, schema)
    assert [(r.row_id, r.rule_violation) for r in blending.blend(df, dict.fromkeys((6, 64, 70, -1), 1.0)).collect()] == [(1, pytest.approx(0.4))]
    assert [tuple(r) for r in contracts.incomplete_ids(df).collect()] == [(2, 2)]


def test_pair_softmax_demo_and_extremes(spark):
    pairs = [(0.5, -0.5), (-3.0, -1.0), (1000.0, -1000.0), (-1e9, -1e9)]
    df = spark.createDataFrame(pairs, "y double, n double")
    got = [r.p for r in df.select(scores.pair_softmax(F.col("y"), F.col("n")).alias("p")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.exp(2)), 1.0, 0.5])


def test_verdict_probability_with_an_empty_group(spark):
    df = spark.createDataFrame([([1.0, 2.0, 800.0],)], "logits array<double>")
    both = df.select(scores.verdict_probability(F.col("logits"), [0, 1], [2]).alias("p")).first().p
    assert both == pytest.approx(0.0)
    assert df.select(scores.verdict_probability(F.col("logits"), [0], []).alias("p")).first().p == pytest.approx(1.0)


def test_missing_texts_are_shown(spark):
    df = spark.createDataFrame([(1, None, "r", None)], "row_id long, body string, rule string, rule_violation string")
    row = df.select(templates.encoder_text(F.col("rule"), F.col("body"), "[SEP]").alias("t")).first()
    assert row.t == "r[SEP]nan"
    assert "completion" in rendering.prompt_table(df).columns
    assert "completion" not in rendering.prompt_table(df.drop("rule_violation")).columns
    chat = rendering.with_conversation(df, answers=False).first().conversation
    assert [t.role for t in chat] == ["system", "user"]


def test_closing_markers_have_the_cut_length():
    assert {row[0]: len(row[4]) for row in templates.CHAT_FAMILIES} == templates.TAIL_LENGTH


def test_chat_pieces_join_to_the_chat_text(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    pieces = rendering.chat_turn_pieces(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    chats = spark.createDataFrame([([("system", "s"), ("user", "u"), ("assistant", "a")],)], "conversation array<struct<role:string,content:string>>")
    texts = {r.family: r.text for r in rendering.chat_texts(chats).collect()}
    for family, text in texts.items():
        parts = sorted((p.turn, p.piece) for p in pieces if p.family == family)
        assert "".join(piece for _, piece in parts) == text


def test_sequences(spark):
    df = spark.createDataFrame([([11, 12, 13], [21])], "p array<int>, c array<int>")
    p, c = F.col("p"), F.col("c")
    row = df.select(
        sequences.completion_inputs(p, c).alias("ids"), sequences.completion_labels(p, c).alias("labels"),
        sequences.keep_last(p, 2).alias("last"), sequences.keep_last(p, 9).alias("all"), sequences.keep_first(p, 2).alias("first"),
        sequences.pad_left(p, F.lit(5), 0).alias("left"), sequences.left_position_ids(p, F.lit(5)).alias("pos"),
        sequences.round_up(F.size(p), 8).alias("up"),
    ).first()
    assert row.ids == [11, 12, 13, 21, 1] and row.labels == [-100, -100, -100, 21, 1]
    assert row["last"] == [12, 13] and row["all"] == [11, 12, 13] and row["first"] == [11, 12]
    assert row.left == [0, 0, 11, 12, 13] and row["pos"] == [0, 0, 0, 1, 2] and row.up == 8


def test_empty_sequence_pads(spark):
    df = spark.createDataFrame([(1, []), (2, [5, 6])], "row_id long, ids array<int>")
    rows = batching.pad_left(batching.batch_sequences(df, "ids", 2, 8), "ids").collect()
    assert {r.row_id: (r.padded_ids, r.attention_mask, r.position_ids) for r in rows} == {
        1: ([0, 0], [0, 0], [0, 0]), 2: ([5, 6], [1, 1], [0, 1]),
    }


def test_batch_scores_do_not_depend_on_batches(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"))
    one, many = (
        {r.row_id: r.logit for r in score_batches(df, length_scorer(), batch_size=size).collect()} for size in (1, 64)
    )
    assert one == many == {i: -1.0 + 0.001 * (i % 50) for i in range(300)}


def test_model_is_loaded_once_per_worker_and_texts_stay(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        open(f"{folder}/{os.getpid()}-{time.time_ns()}", "w").close()
        return lambda texts: texts.str.len().astype("float64")

    df = spark.range(640).repartition(32).select(F.col("id").alias("row_id"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text"))
    scored = score_batches(df, load, batch_size=4)
    assert {r.row_id: r.logit for r in scored.collect()} == {i: float(i % 9) for i in range(640)}
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(loads) == len(set(loads)) <= 16
    texts = spark.createDataFrame([(1, "a")], "row_id long, text string")
    assert "Exchange" not in score_batches(texts, load)._jdf.queryExecution().executedPlan().toString()


def test_null_sequences_are_empty_and_null_ids_an_error(spark):
    df = spark.createDataFrame([(1, None), (2, [5, 6])], "row_id long, ids array<int>")
    rows = batching.pad_left(batching.batch_sequences(df, "ids", 2, 8), "ids").collect()
    assert {r.row_id: (r.width, r.padded_ids) for r in rows} == {1: (2, [0, 0]), 2: (2, [5, 6])}
    with pytest.raises(Exception, match="row_id is NULL"):
        batching.batch_sequences(spark.createDataFrame([(None, [1])], "row_id long, ids array<int>"), "ids", 2, 8).collect()


def test_other_roles_are_written_as_the_assistant(spark):
    turns = [(1, 0, "user", "u"), (1, 1, "tool", "t"), (1, 2, None, "n")]
    pieces = rendering.chat_turn_pieces(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    chats = spark.createDataFrame([([("user", "u"), ("tool", "t"), (None, "n")],)], "conversation array<struct<role:string,content:string>>")
    for row in rendering.chat_texts(chats).collect():
        assert "".join(p.piece for p in sorted(pieces, key=lambda p: p.turn) if p.family == row.family) == row.text


def test_shards_are_dense(spark):
    df = spark.createDataFrame([(i * i - 50,) for i in range(101)], "row_id long")
    rows = sorted((r.shard, r.shard_position) for r in batching.round_robin(df, 2).collect())
    assert rows == [(0, i) for i in range(51)] + [(1, i) for i in range(50)]


def test_label_distribution_and_top_values(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    assert [tuple(r) for r in profiling.value_counts(df, "s", top=1).collect()] == [("a", 2)]
    shares = {r.s: r.percent for r in profiling.label_distribution(df.dropna(), "s").collect()}
    assert shares == {"a": 66.67, "b": 33.33}


def test_hot_keys_join_like_any_other(spark):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    counted = rows.filter("k <> 10").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = join_counted(rows, counted, ["k"], "n", ["id"])
    assert {r.id: r.top for r in got.collect()} == {
        i: 8997 if i % 3 == 0 else None if i == 10 else i for i in range(9000)
    }
    assert got.count() == 9000
