"""One thin query an operator, with production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.common import table

#: The tokenizer that the token queries use; the file stays where its package has it.
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), model_path())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.sentencepiece_codec import codec_digest

    return codec_digest(table(spark, sf_dir, "documents"), model_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Sites that the URL query blocks where no rule fits, under each domain.
LISTED_SITES = [f"{name}.example.{domain}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for domain in ("com", "net", "org")]
#: And single pages: of each of these hosts and languages, every page whose number leaves this remainder.
LISTED_HOSTS = ["therhe.example.org", "ththan.example.com", "tiontion.example.net", "m.ththha.example.net", "tionble.example.org", "www.thering.example.org", "blog.theror.example.com", "m.theron.example.net"]
LISTED_LANGUAGES, LISTED_NUMBERS, LISTED_EACH, LISTED_REMAINDER = ("de", "en", "es", "fr"), 10_000, 3, 1


def listed_urls(spark: SparkSession) -> DataFrame:
    """The URL query's list: 18 sites and some hundred thousand pages."""
    from pyspark.sql import functions as F

    sites = spark.createDataFrame([(f"https://{site}/",) for site in LISTED_SITES], "url string")
    numbers = spark.range(LISTED_NUMBERS).where(F.col("id") % LISTED_EACH == LISTED_REMAINDER)
    host, lang = (F.explode(F.array(*map(F.lit, x))) for x in (LISTED_HOSTS, LISTED_LANGUAGES))
    pages = numbers.select("id", host.alias("host")).select("id", "host", lang.alias("lang"))
    return sites.unionByName(pages.select(F.concat(F.lit("http://"), "host", F.lit("/"), "lang", F.lit("/"), F.col("id")).alias("url")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.url_filters import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES, listed_urls(spark))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kindred.llm.simhash_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), radius=4, width=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.chat_format import as_chains, format_conversations, read_back

    awkward = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(as_chains(said)))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from kindred.llm.secret_scan import fit, scan

    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.decontaminate import contaminated

    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "similarity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kindred.llm.lm_mixing import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_quality_rules, op4_url_filters, op5_simhash_dedup, op6_chat_format, op7_secret_scan, op8_decontaminate, op9_toxicity, op10_lm_mixing)}

#: Rules of the SQL, which is left as it was: net/de/ still blocks there, against the contract and the query.
_SQL_RULES = [("block", *rule[1:]) if rule[1:] == ("net", "/de/") else rule for rule in URL_RULES]
_RULES_SQL = ", ".join(f"('{host}{path}', '{host}', '{path}', '{verdict}')" for verdict, host, path in _SQL_RULES)
_SITES_SQL = ", ".join(f"('{site}')" for site in LISTED_SITES)
_PAGES_SQL = f"SELECT h || '/' || l || '/' || i AS page FROM (SELECT unnest({LISTED_HOSTS}) AS h), (SELECT unnest({list(LISTED_LANGUAGES)}) AS l), range({LISTED_NUMBERS}) r(i) WHERE i % {LISTED_EACH} = {LISTED_REMAINDER}"

_WORDS_SQL = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SHINGLES_SQL = "CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[pos + 1:pos + 5], ' ') END AS s, greatest(len(w) - 4, 1) AS n"
#: Escapes in a text: backslashes, each # before two more, each </turn>.
_ESCAPES_SQL = r"(length({x}) - length(replace({x}, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all({x}, '#{{3,}}'), lambda r: length(r) - 2)), 0) + (length({x}) - length(replace({x}, '</turn>', ''))) // 7)"

ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": rf"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
whole AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
sum(4 + length(role) + 2 + length(text) + {_ESCAPES_SQL.format(x='text')} + 8) AS formatted FROM said GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM whole
""",
    "op8_decontaminate": f"""
WITH d AS (SELECT DISTINCT doc_id, {_WORDS_SQL} AS w FROM documents), b AS (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS pos FROM d WHERE len(w) > 0), ds AS (SELECT doc_id, pos, {_SHINGLES_SQL} FROM dp),
bp AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS pos FROM b WHERE len(w) > 0), bs AS (SELECT item_id, pos, {_SHINGLES_SQL} FROM bp),
windows AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(ds.pos - bs.pos, ds.n - bs.n)) AS start, ds.n AS n_doc, bs.n AS n_item FROM ds JOIN bs USING (s)),
own AS (SELECT w.doc_id, w.item_id, w.start, ds.s, count(*) AS k FROM windows w JOIN ds ON ds.doc_id = w.doc_id AND ds.pos >= w.start AND ds.pos < w.start + w.n_item GROUP BY ALL),
items AS (SELECT item_id, s, count(*) AS k FROM bs GROUP BY ALL),
shared AS (SELECT own.doc_id, own.item_id, own.start, sum(least(own.k, items.k)) AS shared FROM own JOIN items ON items.item_id = own.item_id AND items.s = own.s GROUP BY ALL),
scored AS (SELECT doc_id, item_id, start, shared / (least(n_item, n_doc - start) + n_item - shared) AS similarity FROM windows JOIN shared USING (doc_id, item_id, start))
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start, round(similarity, 6) AS similarity FROM scored WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
""",
    "op4_url_filters": f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS row_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(rule, rule_host, rule_path, rule_verdict) AS (VALUES {_RULES_SQL}),
sites(site) AS (VALUES {_SITES_SQL}),
fits AS (SELECT row_id, arg_max(rule, length(rule)) AS rule, arg_max(rule_verdict, length(rule)) AS rule_verdict FROM parts JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) GROUP BY row_id),
one_pages AS ({_PAGES_SQL}),
listed AS (SELECT row_id FROM parts JOIN sites ON host = site OR host LIKE '%.' || site UNION SELECT row_id FROM parts JOIN one_pages ON host || regexp_replace(path, '/+$', '') = page)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN l.row_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict, l.row_id IS NOT NULL AS listed
FROM parts LEFT JOIN fits USING (row_id) LEFT JOIN listed l USING (row_id)
""",
}
