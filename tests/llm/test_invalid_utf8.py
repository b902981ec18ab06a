"""Bytes that are no UTF-8: every operator on texts reads them in a defined way and none of them fails."""

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, collocations, decontamination, html_labeller, jaccard_join, language, pitman_yor, quality_rules, simhash, substrings, token_files, weak_labels

BAD = b"\xffA \xe2\x82 words here\xc3"
READ = BAD.decode(errors="replace")


def spoilt(docs, rows):
    """The given texts, with BAD where they are None."""
    table = docs([(i, t or "") for i, t in rows])
    return table.withColumn("text", F.when(F.col("text") == "", F.lit(BAD).cast("string")).otherwise(F.col("text")))


def test_token_operators(docs):
    table = spoilt(docs, [(1, None), (2, "plain words")])
    got = {r.doc_id: r for r in byte_bpe.round_trip(table).collect()}
    ids = byte_bpe.codec(byte_bpe.default_ranks(), public_tokenizers.PATTERN).encode_ordinary(READ)
    assert got[1].n_tokens == len(ids) and got[1].decoded_sha256 == hashlib.sha256(READ.encode()).hexdigest()
    found = {r.doc_id: r.n_tokens for r in token_files.write_and_read(table).collect()}
    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    assert found[1] == len(library.encode(READ, add_special_tokens=False).ids) + 1


def test_language_and_decontamination(docs):
    table = spoilt(docs, [(1, None), (2, "words here are plain")])
    model = language.train(table, learns=lambda i: True)
    assert {r.doc_id: r.lang_pred for r in language.predict(table, model).collect()} == {1: "en", 2: "en"}
    assert language.identified(table, model).count() == 2
    benchmark = table.sparkSession.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    assert decontamination.clean(table, benchmark).count() == 2


def test_texts_keep_their_bytes_where_windows_go(docs):
    passage = " ".join(f"p{k}" for k in range(30))
    table = docs([(1, passage), (2, passage + " rest")]).withColumn("text", F.concat(F.lit(BAD + b" ").cast("string"), F.col("text")))
    got = {r.doc_id: bytes(r.raw) for r in substrings.dedup(table).select("doc_id", F.col("text").cast("binary").alias("raw")).collect()}
    assert got[1] == BAD + b" " + passage.encode() and got[2].strip() == b"rest"


def test_pages(spark):
    html = b"<html><body><article><p>Some plain words \xff of an article.</p></article></body></html>"
    pages = spark.range(1, 6).select(F.col("id").alias("page_id"), F.lit("http://a/b").alias("url"), F.lit(html).cast("string").alias("html"))
    assert html_labeller.extract(pages, html_labeller.trained(pages)).count() == 5


def test_counts_of_a_document(docs):
    """Operators that read bytes: words are runs between blanks, whatever their bytes."""
    table = spoilt(docs, [(1, None), (2, None), (3, "plain words of another text")])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(table).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.component_id for r in jaccard_join.classes(table).collect()} == {1: 1, 2: 1, 3: 3}
    none = table.sparkSession.createDataFrame([], "doc_id long, quality int")
    found = quality_rules.score(table, quality_rules.train(table, none)).collect()
    assert {r.doc_id: r.n_words for r in found} == {1: 4, 2: 4, 3: 5}
    assert sorted(r.n_tokens for r in pitman_yor.score(table, *pitman_yor.train(table)).collect()) == [5, 5, 6]
    model = weak_labels.label_model(table)
    assert weak_labels.score(table, model, weak_labels.train(table, model)).count() == 3
    assert collocations.collocations(table).count() == 0
