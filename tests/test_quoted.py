import random

import pytest

from ruleflow.sources import comments, quoted


def field(text):
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in '",\n\r') else text


def write(path, rows, end="\n"):
    with open(path, "w", newline="") as file:
        file.write(end.join([",".join(["row_id", "body", "rule"]), *[",".join(map(field, row)) for row in rows]]) + end)


def corpus(n):
    rng = random.Random(3)
    letters = ["a", "bc ", ",", '"', '""', "\n", "\r\n", "é", "\n\n", " x"]
    return [(str(i), "".join(rng.choices(letters, k=rng.randint(1, 40))) or "z", f"r{i % 3}") for i in range(n)]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize(("end", "piece"), [("\n", 700), ("\r\n", 700), ("\n", 5_000)])
def test_split_reading_equals_one_reading(spark, tmp_path, end, piece):
    """One file over several tasks, with nested quotes, line breaks in quotes and records longer than a piece."""
    rows = [*corpus(300), ("300", "long\n" * 900 + '"x"', "r")]
    write(f"{tmp_path}/train.csv", rows, end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        lines = quoted.numbered_lines(spark, f"{tmp_path}/train.csv")
        pieces = lines.select("piece").distinct().count()
        split = found(quoted.read_quoted(spark, f"{tmp_path}/train.csv", ["body"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert pieces > (10 if piece == 700 else 1)
    assert split == rows
    assert split == found(comments.read_comments(spark, f"{tmp_path}/train.csv", ["body"])) or end == "\r\n"


def test_several_files_and_headers(spark, tmp_path):
    write(f"{tmp_path}/a.csv", [("1", "x\ny", "r"), ("2", "NA", "")])
    write(f"{tmp_path}/b.csv", [("3", "z", "r")])
    df = quoted.read_quoted(spark, str(tmp_path), ["body"], {"row_id": "long"})
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x\ny", "r"), (2, None, None), (3, "z", "r")]
    with pytest.raises(ValueError, match="lacks"):
        quoted.read_quoted(spark, str(tmp_path), ["comment"])
    (tmp_path / "c.csv").write_text("other,body\n1,2\n")
    with pytest.raises(ValueError, match="several headers"):
        quoted.read_quoted(spark, str(tmp_path))
