import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import compare, connect
from tests.llm import cases
from tests.llm import test_operators as plain
from tickloom.llm import (
    bpe, decontamination, language, lines, neardup, queries, resampling, secrets, sharding, simhash, substrings, tokenfile)

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    ok, note = compare(spark, connect(SMALL), SMALL, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages(spark):
    """Each stage against what plain Python keeps of its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = corpus_pipeline.staged(stage(spark, docs, SMALL), name)
        after = docs.collect()
        seen.append(name)
        if name != "bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == {
                r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}
        if name == "line_dedup":
            assert [r.doc_id for r in sorted(after)] == [r.doc_id for r in sorted(before)]
            assert all(r.n_chars == len(r.text) for r in after)
            con = duckdb.connect()
            con.register("documents", pd.DataFrame([(r.doc_id, r.text) for r in before], columns=["doc_id", "text"]))
            want = con.execute(f"WITH {lines.sql()} SELECT doc_id, text FROM lined").fetchall()
            assert sorted((r.doc_id, r.text) for r in after) == sorted(want)
        if name == "near_duplicates":
            want = set(cases.classes([(r.doc_id, r.text) for r in before]).values())
            assert sorted(r.doc_id for r in after) == sorted(want)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            want = plain.hits([(r.doc_id, r.text) for r in before], items)
            assert {r.doc_id for r in after} == {d for d, w in want.items() if not w[4]}
        if name == "bpe":
            lib = plain.library("word_bpe_49k.json")
            ids = {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids for r in before}
            assert {r.doc_id: r.ids_sha256 for r in after} == {d: plain.sha(" ".join(map(str, i))) for d, i in ids.items()}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} and all(r.n_tokens >= 0 for r in after)
    assert seen == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    assert corpus_pipeline.run(spark, SMALL).count() == len(after)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = cases.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0


def test_a_line_of_two_texts_goes_from_the_second(spark):
    shared = "this line of more than ten tokens stands in just two of the texts"
    rows = [(1, f"one text\n{shared}\nand its end"), (2, f"quite another text here\n{shared}"), (3, "a third text without it")]
    docs = cases.frame(spark, [(i, t, "en", "s", len(t)) for i, t in rows])
    out = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SMALL).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "quite another text here" and out[3].text == rows[2][1]
    assert out[2].n_chars == len(out[2].text)


def test_language_id_drops_only_documents_without_a_letter(spark):
    """However short they are, and whether their words are known or not."""
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(-1, "日本語", "en", "s", 3), (-2, "ж", None, "s", 1), (-3, "日 42", "en", "s", 4), (-4, "12 !?", "en", "s", 5), (-5, None, "en", "s", 0)]
    docs = given.unionByName(spark.createDataFrame(odd, given.schema))
    left = {r.doc_id for r in stage(spark, docs, SMALL).collect()}
    assert left == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {-1, -2, -3} <= left
    unlabelled = cases.frame(spark, [(1, "some words", None, "s", 10), (2, "7", None, "s", 1)])  # nothing to learn from
    assert [r.doc_id for r in stage(spark, unlabelled, SMALL).collect()] == [1]


CLASHES = ["drops", "_node", "node", "_n", "n", "_d", "d", "_l", "l", "_same", "same", "_lines", "lines", "n_tokens", "ids_sha256",
           "decoded_sha256", "score", "lang_pred", "n_lines", "n_dropped", "band", "bands", "sketch", "leader", "root", "_null",
           "class_id", "line", "size", "lead", "kind", "template", "w", "runs", "marks", "fp", "rank", "weight", "_row"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(-1, None, "en", "s", None), (-2, "", None, None, 0), (None, "words of no id", "en", "s", 14),
                                 (-3, "word " * 30_000, "en", "s", 150_000)], docs.schema)
    return docs.unionByName(odd).unionByName(odd).withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id")) for c in CLASHES})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_give_clashing_columns_back(spark, clashing, name):
    """Null, empty, long and repeated rows pass too; the last stage's own columns replace those of the same name."""
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, SMALL)
    kept = clashing.columns if name != "bpe" else [
        c for c in clashing.columns if c not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")]
    assert out.columns == kept + (["n_tokens", "ids_sha256", "decoded_sha256"] if name == "bpe" else [])
    rows = out.collect()
    assert len(rows) > 40
    for r in rows:
        want = None if r.doc_id is None else r.doc_id
        assert all(r[c] == (None if want is None else f"{c}:{want}") for c in CLASHES if c in kept)


@pytest.mark.parametrize("run", [
    lambda d, b, p: decontamination.contamination(d, b), lambda d, b, p: bpe.encoded_documents(d),
    lambda d, b, p: lines.deduplicated_lines(d), lambda d, b, p: tokenfile.stored_documents(d),
    lambda d, b, p: substrings.deduplicated_documents(d), lambda d, b, p: language.predicted_documents(d),
    lambda d, b, p: neardup.classed_documents(d), lambda d, b, p: secrets.scanned_documents(d),
    lambda d, b, p: sharding.sharded_documents(d), lambda d, b, p: simhash.linked_documents(d),
    lambda d, b, p: resampling.resampled_documents(d, b)], ids=[f"op{n}" for n in (1, 3, 2, 4, 5, 6, 7, 8, 9, 11, 13)])
def test_operators_do_not_read_clashing_columns(spark, clashing, run):
    plain = clashing.select("doc_id", "text", "lang")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    other = items.withColumns({c: F.lit("x") for c in CLASHES})
    got = run(clashing, other, None)
    if "node" in got.columns:
        got = got.drop("node")
    want = run(plain, items, None)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("node").collect()))
