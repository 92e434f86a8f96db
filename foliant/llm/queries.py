"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import classifier, decontaminate, html_extract, near_dup, packing, pii, quality_rules, substring_dedup, tokens, url_filter
from foliant.llm.common import discard, folders, materialise, work_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality_rules.apply_cascade(docs, quality_rules.plan_cascade(docs, emit=features), quality_rules.BASE_RULES, features)
    return out.select("doc_id", *features, F.col("gate_failed").alias("base_failed"), "kept")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removed_runs(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{work_folder(spark)}/tokens"
    tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return tokens.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(classifier.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    out = classifier.score(stats, classifier.fit(stats, table(spark, sf_dir, "labels")))
    return out.select("doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))


def _tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, which then leaves no tables in the shared folder but those its result reads."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        older = folders()
        out = query(spark, sf_dir)
        discard(spark, out, older)
        return out

    return run


_ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_personal_data": op6_personal_data,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_filter": op9_url_filter,
    "op10_html_extraction": op10_html_extraction,
}

QUERIES = {name: _tidy(query) for name, query in _ALL.items()}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

_OP1 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS r FROM (SELECT win.doc_id, i, unnest(range(0, 8)) AS o FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(r, 0) AS n_repeat_words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  len(regexp_extract_all(t, '\p{{L}}')) AS letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS uppers, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS lettered,
  len(regexp_extract_all(t, '(?m)^[ \t]*[-*•]')) AS bullets, len(regexp_extract_all(t, '(?m)(\.\.\.|…)[ \t]*$')) AS ellipses FROM w LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words
  OR 100 * n_dup_lines > 30 * len(ls) OR 2 * uppers > letters OR 100 * lettered < 80 * n_words OR 100 * bullets > 90 * len(ls) OR 100 * ellipses > 30 * len(ls)) AS kept FROM g"""

_OP8 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, ways.y FROM r JOIN ways ON ways.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""


#: Written out by hand, apart from the operator's own expressions.
_OP9 = rf"""
WITH u AS (SELECT page_id, coalesce(lower(url), '') AS url, coalesce(regexp_extract(lower(url), '(?s)://(.*)$', 1), '') AS rest,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(rest, '^([^/?#]*[.])?(ads[.]|ads-track[.]|ad[.]|adserver[.]|banner[.]|doubleclick[.]|popads[.]|track[.]|tracker[.]|tracking[.]|casino-win[.]|casino[.]|free-bets[.]|bets[.]|betting[.]|poker[.]|slots[.]|cheap-pills[.]|pills[.]|viagra[.]|xxx[.]|porn[.]|adult-|warez[.]|torrent[.])') THEN 'block'
  WHEN regexp_matches(url, '(-casino-|[.]casino-|-bets[.]|-pills[.]|/ads/|/adserver/|/banner/|/banners/|/casino/|/popup/|/viagra/|[?]ad_id=|&ad_id=|/porn/|/warez/|/phishing/)') THEN 'block' ELSE 'allow' END AS verdict FROM r"""

#: The other operators train models, call the tokenizer or split texts by rules that SQL has no words for; the tests hold them against plain Python.
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op8_near_duplicates": _OP8, "op9_url_filter": _OP9}
