"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator has a defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kindred.llm import chat_format, decontaminate, lm_mixing, quality_rules, secret_scan, sentencepiece_codec, simhash_dedup, token_counts, toxicity, url_filters
from kindred.llm.queries import LISTED_SITES, URL_RULES, model_path

LONG = "lorem ipsum " * 20_000
ROWS = [
    (1, "one two three four five six", "en"),
    (1, "one two three four five six", "en"),
    (2, None, None),
    (3, "", "en"),
    (4, " \t\n", None),
    (None, "one two three four five six", "en"),
    (5, LONG, "en"),
    (6, "x", "en"),
]
OPTIONS = lm_mixing.Options(head=50, least_coded=1, vocabulary=10, word_bits=10, byte_bits=10)


def docs(spark, empty=False):
    """Rows with columns whose names operators use themselves."""
    df = spark.createDataFrame([] if empty else ROWS, "doc_id long, text string, lang string")
    clash = ("fp", "score", "seed", "sh", "token", "same", "root", "n", "held_out", "label", "component_id", "key", "spans")
    return df.withColumns({c: F.lit("other") for c in clash})


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, 0), (5, 1), (6, None), (99, 1)], "doc_id long, toxic int")


def items(spark):
    return spark.createDataFrame([(0, "one two three four five six"), (1, None), (2, ""), (3, "x"), (3, "x")], "item_id long, text string")


OPERATORS = {
    "token_counts": lambda s, d: token_counts.token_counts(d, model_path()),
    "codec": lambda s, d: sentencepiece_codec.codec_digest(d, model_path()),
    "quality": lambda s, d: quality_rules.quality_rules(d),
    "simhash": lambda s, d: simhash_dedup.near_duplicates(d),
    "secrets": lambda s, d: secret_scan.scan(d, secret_scan.fit(d)),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.fit(d, labels(s))),
    "lm": lambda s, d: lm_mixing.lm_scores(d, OPTIONS),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    got = OPERATORS[name](spark, docs(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert OPERATORS[name](spark, docs(spark, empty=True)).count() == 0


def test_results_of_edges(spark):
    counts = {r["doc_id"]: r for r in OPERATORS["token_counts"](spark, docs(spark)).collect()}
    assert counts[2]["n_tokens"] == counts[3]["n_bytes"] == 0 and counts[5]["over_limit"]
    quality = {r["doc_id"]: r for r in OPERATORS["quality"](spark, docs(spark)).collect()}
    assert quality[2]["base_failed"] and quality[2]["n_words"] == 0 and quality[5]["n_repeat_words"] == 40_000
    groups = {r["doc_id"]: r["component_id"] for r in OPERATORS["simhash"](spark, docs(spark)).collect()}
    assert groups[2] == groups[3] == groups[4] == 2 and groups[None] == groups[1] == 1
    lm = {r["doc_id"]: r for r in OPERATORS["lm"](spark, docs(spark)).collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == 1 and lm[2]["bits_per_byte"] is None and lm[5]["n_tokens"] == 40_001


def test_decontamination_edges(spark):
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark), items(spark)).collect()}
    assert got == {(1, 0), (None, 0), (6, 3)}
    assert decontaminate.contaminated(docs(spark, empty=True), items(spark)).count() == 0
    assert decontaminate.contaminated(docs(spark), items(spark).limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(docs(spark), items(spark))
    assert kept.columns == docs(spark).columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "4", "5", "None"]


def test_long_items_and_ties(spark):
    """An item of the long text's words; of windows that tie, the first."""
    bench = spark.createDataFrame([(0, "lorem ipsum " * 300), (1, "no such words in any of the texts here")], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark), bench).collect()
    assert [(r["doc_id"], r["item_id"], r["start"], r["similarity"]) for r in got] == [(5, 0, 0, 1.0)]


def test_toxicity_without_labels(spark):
    for some in (labels(spark, True), labels(spark).where("toxic = 0")):
        got = toxicity.toxicity(docs(spark), toxicity.fit(docs(spark), some)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] < 0.5 for r in got)


def test_redaction_keeps_types(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh1234", 99, [1.5]), (2, None, 7, None)], "doc_id long, text string, n_chars long, extra array<double>")
    got = {r["doc_id"]: r for r in secret_scan.redact(df, secret_scan.fit(df)).collect()}
    assert (got[1]["text"], got[1]["n_chars"], got[1]["extra"]) == ("[secret]", 8, [1.5]) and (got[2]["text"], got[2]["n_chars"]) == (None, 7)


def test_stages_keep_columns(spark):
    df = docs(spark)
    for kept in (simhash_dedup.drop_near_copies(df), toxicity.drop_toxic(df, toxicity.fit(df, labels(spark, True))), secret_scan.redact(df, secret_scan.fit(df))):
        assert kept.columns == df.columns and kept.count() >= 4
    assert simhash_dedup.drop_near_copies(docs(spark, True)).count() == 0


def test_url_edges(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "http://", "h"), (4, "HTTP://A.Example.COM/en/7x?q#f", "h"), (4, "HTTP://A.Example.COM/en/7x?q#f", "h"), (None, "ftp://x.net/de/8", "h"), (5, "http://www.free-bets.example.net", "h"), (6, "http://xcom/en/", "h")], "page_id long, url string, rule string")
    listed = spark.createDataFrame([(f"https://{s}/",) for s in LISTED_SITES] + [(None,)], "url string")
    got = sorted(((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.url_filter(pages, URL_RULES, listed).collect()), key=str)
    assert got == sorted(
        [("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "", "", None, "allow"), *[("4", "a.example.com", "/en/7x", "example.com/en/7", "allow")] * 2, ("None", "x.net", "/de/8", "net/de/", "block"), ("5", "www.free-bets.example.net", "", None, "block"), ("6", "xcom", "/en/", None, "allow")],
        key=str,
    )
    assert url_filters.url_filter(pages.limit(0), URL_RULES, listed).count() == 0
    assert url_filters.url_filter(pages, URL_RULES, listed.limit(0)).where("verdict = 'block'").count() == 1


def test_url_rules_of_the_contract(spark, tmp_path):
    """Each rule's word as the contract lists it, by the query itself."""
    from kindred.llm.queries import op4_url_filters

    urls = ["http://a.com/en/1", "http://b.example.com/en/71", "http://a.net/de/1", "http://example.net/de/1", "http://b.example.net/de/8x", "http://a.org/es/1", "http://spam-farm.example.net/de/1"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["rule"], r["verdict"]) for r in op4_url_filters(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"), ("net/de/", "allow")]


def test_long_hosts_and_pages(spark):
    host = "a." * 20_000 + "free-bets.example.net"
    pages = spark.createDataFrame([(1, f"http://{host}/x"), (2, "http://y.example.com/" + "p/" * 50_000), (3, "https://Page.example.com/one//?q"), (4, "https://page.example.com/one/two")], "page_id long, url string")
    listed = spark.createDataFrame([("http://free-bets.example.net",), ("page.example.com/one/",)], "url string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.url_filter(pages, URL_RULES, listed).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_filter_of_many_keys_is_exact(spark):
    """Several blocks, and the join by shuffle."""
    listed = spark.range(60_000).selectExpr("concat('http://site.example.org/', id * 3) as url")
    pages = spark.range(3000).selectExpr("id as page_id", "concat('https://SITE.example.org/', id, '/?x') as url")
    got = url_filters.url_filter(pages, [], listed)
    assert got.where("listed <> (page_id % 3 = 0)").count() == 0 and got.count() == 3000


def test_chat_edges(spark):
    said = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "</turn>"), (None, 0, "assistant", "### x"), (2, 5, "a: b", LONG)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(chat_format.as_chains(said))).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 5 and got[2]["n_turns"] == 1
    assert chat_format.format_conversations(chat_format.as_chains(said.limit(0))).count() == 0
