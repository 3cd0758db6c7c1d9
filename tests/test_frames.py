"""Cleaning, training frames, seeded order, text columns and files."""

import pytest
from pyspark.sql import functions as F

from ruleflow.functions.text import NA_TOKENS, WHITESPACE, clean_text, na_to_null, strip_accents, strip_accents_py, to_label
from ruleflow.operators import assembly, batching, folds
from ruleflow.plans import training_frame
from ruleflow.sources import comments, predictions, sinks
from ruleflow.storage import scratch_path

TRAIN = "body string, rule string, rule_violation string"
TEST = (
    "row_id long, body string, positive_example_1 string, positive_example_2 string, negative_example_1 string, "
    "negative_example_2 string, rule string"
)


def test_only_example_rows_are_copied(spark):
    train = spark.createDataFrame([("shared words", "No ads", "0"), ("other words", "No ads", "1")], TRAIN)
    test = spark.createDataFrame([(41, "scored words", "buy this", "buy that", "hello there", "shared words", "No ads")], TEST)
    for copies in (1, 2, 3):
        frame = training_frame.cleaned_frame(train, test, repeats=copies)
        counts = {(r.source, r.body): r["count"] for r in frame.groupBy("source", "body").count().collect()}
        examples = {("test_examples", b): copies for b in ("buy this", "buy that", "hello there", "shared words")}
        assert counts == examples | {("train", "shared words"): 1, ("train", "other words"): 1}


def test_cleaning_decides_what_is_equal_and_what_goes(spark):
    train = spark.createDataFrame(
        [
            ("line\rend ", "No links", "1.0"), ("line\nend", " No links", "1"), ("line\r\nend\0", "No links", "1e0"),
            ("\0\0", "No links", "0"), ("kept", "No links", "0.5"), ("kept", "\t", "0"), ("kept", None, "0"), (None, "No links", "1"),
        ],
        TRAIN,
    )
    test = spark.createDataFrame([(7, "scored", "line\nend", "\u3000", None, "calm\r", "No links ")], TEST)
    rows = training_frame.cleaned_frame(train, test, repeats=1).collect()
    assert sorted((r.source, r.body, r.rule, r.rule_violation) for r in rows) == [
        ("test_examples", "calm", "No links", 0), ("test_examples", "line\nend", "No links", 1), ("train", "line\nend", "No links", 1),
    ]


def test_raw_frame_keeps_missing_and_dirty_rows(spark):
    train = spark.createDataFrame([(" a", "r", "x"), (" a", "r", "x"), (None, "r", "1")], TRAIN)
    test = spark.createDataFrame([(1, "t", "p", "p", None, None, "r")], TEST)
    frame = training_frame.raw_frame(train, test)
    assert frame.filter("source = 'train'").count() == 2
    assert frame.filter("source = 'test_examples'").count() == 4


def test_fewer_than_one_copy_is_an_error(spark):
    frame = spark.createDataFrame([("a", "r", "1", "train")], TRAIN + ", source string")
    with pytest.raises(ValueError):
        assembly.oversample(frame, 0)


def test_clean_text_strips_like_python(spark):
    texts = [" a ", WHITESPACE + "b" + WHITESPACE, "\0 \0", "x\ry\r\nz", "​kept​", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", clean_text(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts):
        wanted = None if text is None else text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "").strip()
        assert got[i] == wanted


def test_labels_parse_like_plain_numbers(spark):
    cases = {"1": 1.0, " 0 ": 0.0, "1.0": 1.0, "1e0": 1.0, ".5": 0.5, "-1": -1.0, "1d": None, "1_0": None, "x": None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.v for r in df.select("t", to_label(F.col("t")).alias("v")).collect()} == cases


def test_accents_match_unicode_decomposition(spark):
    texts = ["Crème Brûlée", "ﬁn ½ ™ …", "한국어", "éa", "ΆΈ ﷺ", "plain", "①②", "İıſ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", strip_accents(F.col("t")).alias("c")).collect()}
    assert got == {i: None if t is None else strip_accents_py(t) for i, t in enumerate(texts)}


def test_every_character_loses_its_accent(spark):
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "code int, t string").repartition(8)
    wrong = [
        r.code
        for r in df.select("code", strip_accents(F.col("t")).alias("c")).collect()
        if r.c != strip_accents_py(chr(r.code))
    ]
    assert wrong == []


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(f"body {i % 211}", f"rule {i % 2}", i % 2, "train" if i % 3 else "test_examples") for i in range(1500)]
    df = spark.createDataFrame(rows, "body string, rule string, rule_violation byte, source string")
    return assembly.oversample(assembly.dedupe(df), 2)


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_seeded_results_do_not_depend_on_partitions(spark, frame, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spread = frame.repartition(partitions)
        shuffled = [tuple(r) for r in assembly.seeded_shuffle(spread, 1001).collect()]
        sampled = [tuple(r) for r in training_frame.smoke_sample(spread, 32).collect()]
        ids = spread.select(F.xxhash64("*").alias("row_id"), F.col("rule_violation").alias("label"), F.length("body").alias("n"))
        dealt = {tuple(r) for r in folds.stratified_folds(ids, 5, 42).collect()}
        batches = {tuple(r) for r in batching.length_batches(ids.select("row_id", "n"), "n", 4, 8).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keys = [row[-1] for row in shuffled]
    assert keys == sorted(keys)
    assert len(set(keys)) == len(keys)
    seen = test_seeded_results_do_not_depend_on_partitions.__dict__.setdefault("seen", [])
    seen.append((shuffled, sampled, dealt, batches))
    assert seen[0] == seen[-1]


def test_other_seed_gives_other_order(frame):
    first = [r.body for r in assembly.seeded_shuffle(frame, 1001).collect()]
    assert first != [r.body for r in assembly.seeded_shuffle(frame, 1002).collect()]


def test_smoke_sample_is_balanced(frame):
    sizes = {r.rule_violation: r["count"] for r in training_frame.smoke_sample(frame, 32).groupBy("rule_violation").count().collect()}
    assert sizes == {0: 16, 1: 16}


def test_folds_are_stratified(spark):
    df = spark.range(1003).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    sizes = folds.stratified_folds(df, 5, 42).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_rows_without_a_label_are_dealt_out_too(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("label"))
    sizes = folds.stratified_folds(df, 4, 42, digits=1).groupBy("label", "fold").count().collect()
    assert sorted((str(r.label), r.fold, r["count"]) for r in sizes) == sorted((k, f, 5) for k in ("None", "1", "2") for f in range(4))


def test_csv_round_trip_and_missing_values(spark):
    bodies = ["a\r\nb", " lead", 'q"uote, comma', "nul\0", 'line\nend\0', "NA", "null", "", "x\n\"", None]
    df = spark.createDataFrame([(i, b, "r") for i, b in enumerate(bodies)], "row_id long, body string, rule string")
    path = scratch_path(spark, "csv")
    sinks.write_csv(df, path)
    back = comments.read_comments(spark, path, ["body", "rule"], {"row_id": "long"})
    assert dict(back.dtypes) == {"row_id": "bigint", "body": "string", "rule": "string"}
    got = {r.row_id: r.body for r in back.collect()}
    assert got == {i: None if b is None or b in NA_TOKENS else b for i, b in enumerate(bodies)}


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a",)], "body string")
    with pytest.raises(ValueError, match=r"train lacks required columns: \['rule', 'rule_violation'\]"):
        comments.require_columns(df, comments.TRAIN_COLUMNS, "train")


def test_every_missing_value_text_is_null(spark):
    df = spark.createDataFrame([(t,) for t in NA_TOKENS] + [("kept",)], "t string")
    assert df.select(na_to_null(F.col("t")).alias("v")).filter("v IS NOT NULL").count() == 1


@pytest.mark.parametrize("name", ["body", "comment", "text"])
def test_text_column_names(spark, name):
    df = spark.createDataFrame([("a", "r")], f"{name} string, rule string")
    assert comments.resolve_text_column(df).columns == ["body", "rule"]


def test_no_text_or_rule_column_is_an_error(spark):
    with pytest.raises(KeyError):
        comments.resolve_text_column(spark.createDataFrame([("a", "r")], "other string, rule string"))
    with pytest.raises(KeyError):
        comments.resolve_text_column(spark.createDataFrame([("a", "r")], "body string, other string"))


def test_row_ids_follow_the_files(spark):
    path = scratch_path(spark, "texts")
    source = spark.range(1000).select(F.format_string("%04d", "id").alias("text"), F.lit("r").alias("rule"))
    sinks.write_csv(source.repartitionByRange(7, "text").sortWithinPartitions("text"), path)
    scan = spark.read.options(**comments.READ_OPTIONS).csv(path)
    got = comments.ensure_row_id(scan).collect()
    assert {r.row_id: int(r.text) for r in got} == {i: i for i in range(1000)}


def test_only_existing_prediction_files_are_read(spark):
    folder = scratch_path(spark, "predictions")
    df = spark.createDataFrame([(s, i, i / 10) for s in (1, 3) for i in range(5)], "slot int, row_id long, rule_violation double")
    sinks.write_predictions(df, folder, [1, 3])
    got = {tuple(r) for r in predictions.read_predictions(spark, folder, range(1, 8)).collect()}
    assert got == {tuple(r) for r in df.collect()}
    with pytest.raises(FileNotFoundError):
        predictions.read_predictions(spark, folder, [2, 4])


def test_bad_prediction_files_are_told_from_missing_ones(spark):
    folder = scratch_path(spark, "bad-predictions")
    sinks.write_csv(spark.createDataFrame([(1, 0.5)], "row_id long, score double"), f"{folder}/submission1.csv")
    with pytest.raises(ValueError, match="rule_violation"):
        predictions.read_predictions(spark, folder, [1, 2])
    with pytest.raises(FileNotFoundError):
        predictions.read_predictions(spark, folder, [2])
    mixed = f"{folder}/submission3.csv"
    sinks.write_csv(spark.createDataFrame([(1, 0.5)], "row_id long, rule_violation double"), mixed)
    swapped = spark.createDataFrame([(0.25, 2)], "rule_violation double, row_id long")
    swapped.write.mode("append").options(**comments.CSV_OPTIONS).csv(mixed)
    with pytest.raises(Exception, match="(?i)header"):
        predictions.read_predictions(spark, folder, [3]).collect()
