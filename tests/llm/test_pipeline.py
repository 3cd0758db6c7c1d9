import corpus_pipeline
import public_tokenizers
from ruleflow.llm import classifier, decontamination, piece_coding, secret_scan, simhash

SF = "/root/testdata/sf0.001"


def test_every_stage_keeps_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES][1] == "SimHash near-dedup" and len(stages) == 5
    good = stages["quality classifier"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in classifier.quality_scores(docs, labels).collect()}
    assert good.columns == columns
    rows = {r.doc_id: r for r in good.collect()}
    assert set(rows) == {d for d, p in scores.items() if p}
    single = stages["SimHash near-dedup"](spark, good, SF)
    assert single.columns == columns
    kept = {r.doc_id: r for r in single.collect()}
    assert kept.items() <= rows.items() and len({r.text for r in kept.values()}) == len(kept)
    assert {r.text.lower() for r in rows.values()} >= {r.text.lower() for r in kept.values()}
    assert set(kept) == {r.component_id for r in simhash.near_duplicates(good).collect()}
    clean = stages["benchmark decontamination"](spark, single, SF)
    leaked = {r.doc_id for r in decontamination.leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == set(kept) - leaked
    safe = stages["secret scans"](spark, clean, SF)
    assert safe.columns == columns
    texts = {r.doc_id: r.text for r in safe.collect()}
    for doc, text in texts.items():
        assert not any(rule.spans(text) for rule in secret_scan.RULES)
        assert text == kept[doc].text or any(rule.spans(kept[doc].text) for rule in secret_scan.RULES)
    coded = stages["SentencePiece encoding and decoding"](spark, safe, SF)
    pieces = piece_coding.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    for row in coded.collect():
        assert row.round_trip and row.ids == piece_coding.encode(texts[row.doc_id], pieces, {}).tolist()


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, "x"), (1, "", "", "", 0, None)], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.selectExpr("*", "'s' as score").unionByName(odd).unionByName(odd).write.parquet(f"{tmp_path}/a/documents.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert len(found) > 50 and all(r.round_trip for r in found)
    for name in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{tmp_path}/a/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/b/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
