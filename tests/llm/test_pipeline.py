"""Each stage of the pipeline against a brute-force version on what its predecessor kept."""

import corpus_pipeline
import pytest

from .test_operators import CLASH, DATA, best_windows, comparable, documents, least_linked, odd_rows, read, repeated_lines, shingle_sets, wide


def test_stages_against_brute_force(spark, tmp_path):
    docs, sf_dir = documents(spark, "sf0.01"), f"{DATA}/sf0.01"
    bench = [(r["item_id"], r["text"]) for r in read(spark, "sf0.01", "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r for r in docs.collect()}
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and len(after) == docs.count()
        if name == "quality classifier":
            labels = {r["doc_id"]: r["quality"] for r in read(spark, "sf0.01", "labels").collect()}
            good = [i for i in (r["doc_id"] for r in before) if labels.get(i) == 1]
            assert sum(i in after for i in good) > 0.97 * len(good)
            assert all(after[r["doc_id"]] == r for r in before if r["doc_id"] in after)
        elif name == "line dedup":
            gone, left = repeated_lines(before)
            want = {i: t for i, t in left.items() if not gone[i] or t.strip(" \t\n\v\f\r")}
            assert {i: r["text"] for i, r in after.items()} == want
        elif name == "n-gram Jaccard join":
            ids = [r["doc_id"] for r in before]
            assert after.keys() == {i for i, c in zip(ids, least_linked(ids, shingle_sets(before)), strict=True) if i == c}
        elif name == "benchmark decontamination":
            hit = {i for (i, _), v in best_windows([(r["doc_id"], r["text"]) for r in before], bench).items() if v >= 0.75}
            assert hit and after.keys() == {r["doc_id"] for r in before} - hit
        else:
            assert after.keys() == {r["doc_id"] for r in before}


def test_run_writes_and_rereads_all_stages(spark):
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    """Nulls, empty and long texts, repeated rows and clashing columns change nothing; an empty table stays empty."""
    plain = odd_rows(spark).select("doc_id", "text", "lang", "source", "n_chars")
    want, got = stage(spark, plain, f"{DATA}/sf0.001"), stage(spark, wide(plain), f"{DATA}/sf0.001")
    assert comparable(got.collect(), want.columns) == comparable(want.collect(), want.columns)
    if stage is not corpus_pipeline.packing:
        assert want.columns == plain.columns and set(CLASH) <= set(got.columns)
    assert stage(spark, plain.where("false"), f"{DATA}/sf0.001").collect() == []


def test_repeated_and_null_ids_are_told_apart(spark):
    bench = read(spark, "sf0.001", "benchmark").orderBy("item_id").first()["text"]
    a, b = "one two three four five six seven eight nine ten", "quite another text with words of its very own kind"
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda *x: spark.createDataFrame([(i, t, "en", "s", n) for i, t, n in x], kind)
    left = lambda f, df: sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in f(spark, df, f"{DATA}/sf0.001").collect()), key=repr)
    got = left(corpus_pipeline.near_duplicates, rows((1, a, 1), (1, a, 2), (2, a, 1), (2, b, 1), (None, a, 1), (None, None, 1), (3, "", 1), (3, "", 1)))
    assert got == sorted([(1, a, 1), (2, b, 1), (None, None, 1), (3, "", 1), (3, "", 1)], key=repr)
    got = left(corpus_pipeline.decontamination, rows((1, bench, 1), (1, a, 1), (None, bench, 1), (None, b, 1), (None, None, 1), (2, "", 1)))
    assert got == sorted([(1, a, 1), (None, b, 1), (None, None, 1), (2, "", 1)], key=repr)
