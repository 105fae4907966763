"""Queries on corpus building, tokens, discovery and scoring.

Turns are the lines of documents (speaker label up front), calls are documents, sentences the table of that name, each (Id,
sentence_id) once.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MARKERS, RISK_WORDS, SAFE_HARBOR, SAFE_HARBOR_ENDS, SAFE_HARBOR_SENTENCE, STOPWORDS, Config
from ..operators import corpus, discovery, scoring, tokens, validate
from ..sources.tables import table
from . import pipeline
from .registry import query, r6, rounded
from .storage import stored

#: Seeds that the test collection holds, a tone and a small theme list: parameters of the queries, not of the operators.
SEEDS = ("import quota", "customs duty", "export licence", "asset freeze", "capital control", "peace talks", "entity list", "rare metal", "grain corridor", "customs union")
POSITIVE, NEGATIVE = ("good", "strong", "steady", "improved", "new"), ("bad", "weak", "hard", "tight", "conflict")
THEMES = {"trade": ("import", "export", "tariff", "quota", "customs", "duty"), "sanctions": ("sanction", "embargo", "freeze", "entity"), "supply": ("supplier", "port", "container", "freight"), "energy": ("oil", "gas", "fuel", "steel")}
GENERIC, LEADS = ("price", "cost", "fee", "cash", "stock"), ("the", "of", "to", "from", "for", "in", "on", "at", "with")
SPEAKER = r"^(Operator|CEO|CFO|Analyst): "
DICTIONARY_TOP, MODEL_VOCABULARY, SAMPLE = 9_600, 10_000, 100_000
KEYS = ["Id", "sentence_id"]


def _in(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(s: str) -> str:
    return s.replace("'", "''")


def turns(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "companyTicker", "eventYear", "text").filter("text IS NOT NULL")
    lines = docs.select("doc_id", "companyTicker", "eventYear", F.posexplode(F.split("text", "\n")).alias("secIdx", "line"))
    group = F.regexp_extract("line", SPEAKER, 1)
    return lines.select("doc_id", "companyTicker", "eventYear", "secIdx", F.when(group != "", group).alias("speakerGroup"), F.regexp_replace("line", SPEAKER, "").alias("speech"))


TURNS = f"""l AS (SELECT doc_id, companyTicker, eventYear, unnest(range(len(p))) AS secIdx, unnest(p) AS line FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, companyTicker, eventYear, secIdx, nullif(regexp_extract(line, '{SPEAKER}', 1), '') AS speakerGroup, regexp_replace(line, '{SPEAKER}', '') AS speech FROM l),
k AS (SELECT * FROM t WHERE (speakerGroup IS NULL OR speakerGroup <> 'Operator') AND length(speech) > 0)"""


@query(f"WITH {TURNS} SELECT doc_id, count(*) AS n_turns, CAST(sum(length(speech)) AS BIGINT) AS n_chars FROM k GROUP BY 1")
def turns_kept(spark: SparkSession, d: str) -> DataFrame:
    """Turns that aren't the operator's and aren't empty."""
    k = corpus.drop_empty(corpus.drop_operator(turns(spark, d)), "doc_id")
    return k.groupBy("doc_id").agg(F.count("*").alias("n_turns"), F.sum(F.length("speech")).alias("n_chars"))


@query(f"WITH {TURNS} SELECT doc_id, md5(string_agg(speech, ' ' ORDER BY secIdx, speech)) AS text_md5, first(companyTicker ORDER BY secIdx) AS companyTicker FROM k GROUP BY 1")
def concat_turns(spark: SparkSession, d: str) -> DataFrame:
    """One text per call."""
    k = corpus.drop_empty(corpus.drop_operator(turns(spark, d)), "doc_id")
    return corpus.concat_turns(k, "doc_id", "secIdx", "speech", ["companyTicker"]).select("doc_id", F.md5("text").alias("text_md5"), "companyTicker")


@query(f"WITH {TURNS} SELECT eventYear, count(*) AS n_rows_raw, count(DISTINCT doc_id) AS n_calls_raw, count(*) FILTER (speakerGroup IS NULL OR speakerGroup <> 'Operator') AS n_rows_after_operator_drop, count(*) FILTER ((speakerGroup IS NULL OR speakerGroup <> 'Operator') AND length(speech) > 0) AS n_rows_after_na_drop, count(DISTINCT doc_id) FILTER ((speakerGroup IS NULL OR speakerGroup <> 'Operator') AND length(speech) > 0) AS n_calls, CAST(coalesce(sum(length(speech)) FILTER ((speakerGroup IS NULL OR speakerGroup <> 'Operator') AND length(speech) > 0), 0) AS BIGINT) AS n_chars FROM t GROUP BY 1")
def corpus_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows and calls after each step, by year."""
    return pipeline.funnel(turns(spark, d), key="doc_id")


STRIPPED = rf"trim(regexp_replace(regexp_replace(text, '(?i){_q(MARKERS)}', ' ', 'g'), '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({STRIPPED}) AS text_md5, length({STRIPPED}) AS n_chars FROM documents WHERE text IS NOT NULL")
def strip_markers(spark: SparkSession, d: str) -> DataFrame:
    """Stage directions off, white space squished."""
    x = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL").select("doc_id", corpus.strip_markers("text").alias("t"))
    return x.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars"))


_TAIL = rf"regexp_extract(regexp_replace(text, '(?is)^.*?({_q(SAFE_HARBOR)})', ''), '(?s)(?:\n\n|\. [A-Z]).*$')"
_ENDS = " ".join(f"WHEN regexp_extract(text, '(?is)(?:{_q(p)}).*$') <> '' THEN regexp_extract(text, '(?is)(?:{_q(p)}).*$')" for p in SAFE_HARBOR_ENDS)
_CUT = f"CASE WHEN NOT regexp_matches(text, '(?i){_q(SAFE_HARBOR)}') THEN text {_ENDS} WHEN {_TAIL} <> '' THEN substring({_TAIL}, 2) ELSE text END"


@query(f"SELECT doc_id, md5(coalesce({_CUT}, '')) AS text_md5 FROM (SELECT doc_id, 'These are forward-looking statements of the year. ' || text AS text FROM documents)")
def boilerplate_cut(spark: SparkSession, d: str) -> DataFrame:
    """T4: legal boilerplate off, here after a sentence of it is put before every text."""
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.concat(F.lit("These are forward-looking statements of the year. "), "text").alias("text"))
    return x.select("doc_id", F.md5(F.coalesce(corpus.boilerplate_once("text"), F.lit(""))).alias("text_md5"))


_ROUND = lambda src: f"SELECT doc_id, coalesce({_CUT}, '') AS text FROM {src}"


@query(f"WITH a AS (SELECT doc_id, 'These are forward-looking statements of the year. ' || text || ' And now, a safe harbor applies. ' || text AS text FROM documents), b AS ({_ROUND('a')}), c AS ({_ROUND('b')}), e AS ({_ROUND('c')}) SELECT doc_id, md5(text) AS text_md5 FROM e")
def boilerplate_iterated(spark: SparkSession, d: str) -> DataFrame:
    """T5: the cut repeated, here three times on texts with two legal passages."""
    t = F.concat(F.lit("These are forward-looking statements of the year. "), "text", F.lit(" And now, a safe harbor applies. "), "text")
    x = table(spark, d, "documents", "doc_id", "text").select("doc_id", t.alias("text"))
    return x.select("doc_id", F.md5(F.coalesce(corpus.boilerplate_iter("text", 3), F.lit(""))).alias("text_md5"))


@query(f"SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates from epoch seconds and from strings; what is neither is null."""
    from ..functions.text import parse_date

    x = table(spark, d, "events", "event_id", "ts").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    kind = F.col("event_id") % 3
    seconds = F.unix_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").cast("string")
    given = F.when(kind == 0, seconds).when(kind == 1, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00"))).otherwise("unknown")
    return x.select("event_id", parse_date(given).alias("day"))


@query("SELECT l_orderkey, count(*) AS n_lines FROM lineitem SEMI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey) GROUP BY 1")
def in_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """SRC3, J7: a scan narrowed to the keys of another table."""
    from ..sources.connectors import in_list

    keys = table(spark, d, "orders", "o_orderkey", "o_orderstatus").filter("o_orderstatus = 'F'")
    return in_list(table(spark, d, "lineitem", "l_orderkey"), "l_orderkey", keys, "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


SPLIT = r"string_split_regex(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n+')"
PARTS = f"""p AS (SELECT doc_id, {SPLIT} AS a FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS sentence_id, trim(unnest(a)) AS text FROM p)"""


@query(f"WITH {PARTS} SELECT doc_id, sentence_id::INTEGER AS sentence_id, md5(text) AS text_md5 FROM x WHERE length(text) >= 5")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of at least five characters."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("text IS NOT NULL")
    return corpus.min_length(corpus.split_sentences(docs, "text", ["doc_id"])).select("doc_id", "sentence_id", F.md5("text").alias("text_md5"))


@query(f"WITH {PARTS}, n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1) SELECT d.doc_id, coalesce(n.n, 0) AS n_sentences, length(d.text) AS n_chars FROM documents d LEFT JOIN n USING (doc_id)")
def call_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and characters of each call."""
    docs = table(spark, d, "documents", "doc_id", "text")
    s = corpus.split_sentences(docs.filter("text IS NOT NULL"), "text", ["doc_id"])
    return corpus.call_counts(docs, s, "doc_id").select("doc_id", "n_sentences", F.col("n_chars").cast("bigint").alias("n_chars"))


@query(
    "SELECT source, eventYear, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys, count(*) FILTER (text IS NULL) AS n_null, count(*) FILTER (length(text) = 0) AS n_empty, round(avg(length(text)), 6) + 0.0 AS mean_chars, round(quantile_cont(length(text), 0.5), 6) + 0.0 AS median_chars FROM documents GROUP BY 1, 2"
)
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts, nulls and lengths by source and year."""
    return rounded(corpus.audit(table(spark, d, "documents", "doc_id", "source", "eventYear", "text"), ["source", "eventYear"], "text", "doc_id"), "mean_chars", "median_chars")


def _hits(lang: str) -> str:
    return rf"len(list_filter(string_split_regex(lower(text), '[^\p{{L}}]+'), lambda w: list_contains({_in(corpus.PROFILES[lang])}, w)))"


_SPLIT = lambda c: rf"string_split_regex(regexp_replace({c}, '([.!?])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1) || '|\n+')"
_FUN = f"""WITH {TURNS}, kc AS (SELECT doc_id, eventYear, secIdx, {STRIPPED.replace("(text,", "(speech,")} AS c, length(speech) AS lb FROM k),
rw AS (SELECT eventYear, count(*) AS n_rows_raw, count(DISTINCT doc_id) AS n_calls_raw, count(*) FILTER (speakerGroup IS NULL OR speakerGroup <> 'Operator') AS n_rows_after_operator_drop, count(*) FILTER ((speakerGroup IS NULL OR speakerGroup <> 'Operator') AND length(speech) > 0) AS n_rows_after_na_drop FROM t GROUP BY 1),
ch AS (SELECT eventYear, sum(lb) AS lb, sum(length(c)) AS la FROM kc GROUP BY 1), ca AS (SELECT doc_id, arg_min(eventYear, secIdx) AS eventYear, string_agg(c, ' ' ORDER BY secIdx, c) AS text FROM kc GROUP BY 1),
hh AS (SELECT *, {", ".join(f"{_hits(x)} AS {x}" for x in ("de", "en", "es", "fr"))} FROM ca), la AS (SELECT *, (en > 0 AND en = greatest(de, en, es, fr) AND en > de) AS inn FROM hh),
se AS (SELECT eventYear, inn, CASE WHEN inn THEN list_transform({_SPLIT("text")}, lambda x: trim(x)) END AS p FROM la), sl AS (SELECT *, list_filter(p, lambda x: length(x) >= 5) AS l FROM se), ss AS (SELECT *, list_filter(l, lambda x: NOT regexp_matches(x, '(?i){_q(SAFE_HARBOR_SENTENCE)}')) AS z FROM sl),
nn AS (SELECT eventYear, count(*) AS n_calls_reconstructed, count(*) FILTER (inn) AS n_calls_english, coalesce(sum(len(p)), 0) AS n_sentences, coalesce(sum(len(l)), 0) AS n_sentences_after_minlen, coalesce(sum(len(z)), 0) AS n_sentences_after_safeharbor_filter FROM ss GROUP BY 1)
SELECT rw.*, CAST(coalesce(lb - la, 0) AS BIGINT) AS chars_stripped, round(100.0 * (lb - la) / lb, 2) AS chars_stripped_pct, n_calls_reconstructed, n_calls_english, CAST(n_sentences AS BIGINT) AS n_sentences, CAST(n_sentences_after_minlen AS BIGINT) AS n_sentences_after_minlen, CAST(n_sentences_after_safeharbor_filter AS BIGINT) AS n_sentences_after_safeharbor_filter, n_calls_reconstructed - n_calls_english AS n_calls_dropped_nonenglish, CAST(n_sentences_after_minlen - n_sentences_after_safeharbor_filter AS BIGINT) AS n_sentences_dropped_safeharbor, round(n_sentences / n_calls_english, 2) AS mean_sentences_per_call
FROM rw LEFT JOIN ch ON ch.eventYear IS NOT DISTINCT FROM rw.eventYear LEFT JOIN nn ON nn.eventYear IS NOT DISTINCT FROM rw.eventYear"""


@query(_FUN)
def audit_funnel(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen counters of the way from turns to sentences, by year."""
    return pipeline.audit_funnel(turns(spark, d), Config(sentence_safe_harbor=True), key="doc_id")


@query(
    f"WITH h AS (SELECT doc_id, {', '.join(f'{_hits(x)} AS {x}' for x in ('de', 'en', 'es', 'fr'))} FROM documents) SELECT doc_id, CASE WHEN de IS NULL OR greatest(de, en, es, fr) = 0 THEN NULL WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS lang FROM h"
)
def detected_language(spark: SparkSession, d: str) -> DataFrame:
    """Language by function words."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", corpus.detect_language("text").alias("lang"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sentences", "year", "Id", "sentence_id", "text").filter("Id IS NOT NULL AND sentence_id IS NOT NULL AND text IS NOT NULL")
    return s.groupBy(*KEYS).agg(F.min("year").alias("year"), F.min("text").alias("text"))


SENT = "s AS (SELECT Id, sentence_id, min(year) AS year, min(text) AS text FROM sentences WHERE Id IS NOT NULL AND sentence_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)"
TOK = rf"{SENT}, w AS (SELECT Id, sentence_id, year, text, regexp_extract_all(strip_accents(lower(text)), '{tokens.WORD}') AS t FROM s)"
BIG = f"{TOK}, v AS (SELECT *, list_filter(t, lambda x: NOT list_contains({_in(STOPWORDS)}, x)) AS k FROM w), b AS (SELECT Id, sentence_id, year, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS bigram FROM v WHERE len(k) > 1), c AS (SELECT Id, sentence_id, year, bigram, count(*) AS n FROM b GROUP BY ALL)"


def counts(spark: SparkSession, d: str) -> DataFrame:
    """(Id, sentence_id, year, bigram, n)"""
    return tokens.dfm(sentences(spark, d), [*KEYS, "year"], "text", STOPWORDS)


@query(f"WITH {SENT} SELECT year, count(*) AS n_kept FROM s WHERE NOT regexp_matches(text, '(?i){_q(SAFE_HARBOR_SENTENCE)}') GROUP BY 1")
def safe_harbor_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences that stay, by year."""
    return corpus.drop_safe_harbor(sentences(spark, d)).groupBy("year").agg(F.count("*").alias("n_kept"))


@query(f"WITH {TOK} SELECT Id, sentence_id, array_to_string(t, ' ') AS words, len(t)::INTEGER AS n FROM w")
def token_words(spark: SparkSession, d: str) -> DataFrame:
    """K1, K2, K6: words of each sentence."""
    return sentences(spark, d).select(*KEYS, tokens.words("text").alias("t")).select(*KEYS, F.array_join("t", " ").alias("words"), F.size("t").alias("n"))


_ICU = rf"list_filter(list_transform(string_split_regex(lower(text), '\s+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')), lambda x: regexp_full_match(x, '{tokens.WORD}'))"


@query(f"WITH {SENT} SELECT Id, sentence_id, array_to_string({_ICU}, ' ') AS words FROM s")
def token_words_icu(spark: SparkSession, d: str) -> DataFrame:
    """K3: words by the older rule."""
    return sentences(spark, d).select(*KEYS, F.array_join(tokens.icu_like_words("text"), " ").alias("words"))


@query(f"WITH {BIG} SELECT Id, sentence_id, bigram, n FROM c")
def dfm_counts(spark: SparkSession, d: str) -> DataFrame:
    """K4, K5, K7: bigram counts of each sentence, stop words bridged."""
    return counts(spark, d).select(*KEYS, "bigram", "n")


@query(f"WITH {BIG} SELECT Id, CAST(sum(n) AS BIGINT) AS B FROM c GROUP BY 1")
def document_totals(spark: SparkSession, d: str) -> DataFrame:
    """Bigrams of each call."""
    return tokens.totals(tokens.group(counts(spark, d), ["Id"]), ["Id"])


TRIM = "f AS (SELECT bigram, CAST(sum(n) AS BIGINT) AS feat_freq, count(*) AS docfreq FROM c GROUP BY 1)"


@query(f"WITH {BIG}, {TRIM} SELECT bigram, feat_freq, docfreq FROM f WHERE docfreq >= 5")
def docfreq_trim(spark: SparkSession, d: str) -> DataFrame:
    """K8: bigrams of at least five sentences."""
    return tokens.docfreq(tokens.trim(counts(spark, d), 5))


def seeds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in SEEDS], "bigram string")


SEED = f"seed AS (SELECT unnest({_in(SEEDS)}) AS bigram)"


@query(f"WITH {BIG}, {SEED} SELECT Id, sentence_id, bigram, n FROM c SEMI JOIN seed USING (bigram)")
def dfm_match(spark: SparkSession, d: str) -> DataFrame:
    """K9: counts of a fixed vocabulary."""
    return tokens.match(counts(spark, d), seeds(spark)).select(*KEYS, "bigram", "n")


@query(f"WITH {BIG}, {SEED} SELECT bigram, len(string_split(bigram, ' ')) = 2 AS valid, bigram IN (SELECT bigram FROM c) AS present FROM seed")
def seed_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether seeds are bigrams and occur."""
    return tokens.check_seeds(seeds(spark), counts(spark, d))


REF = f"{BIG}, {SEED}, r AS (SELECT Id, sentence_id, max((bigram IN (SELECT bigram FROM seed))::INTEGER) AS in_R FROM c GROUP BY 1, 2)"


@query(f"WITH {REF} SELECT Id, sentence_id, in_R FROM r")
def seed_label(spark: SparkSession, d: str) -> DataFrame:
    """L1: sentences with a seed."""
    return discovery.label_reference(counts(spark, d), seeds(spark), KEYS)


SAMPLE_KEY = "CAST(substring(Id, 2) AS BIGINT) * 10007 + sentence_id"


@query(f"WITH {REF}, z AS (SELECT Id, sentence_id, {SAMPLE_KEY} AS key FROM r WHERE in_R = 0) SELECT Id, sentence_id FROM z ORDER BY ((key % 2147483647) * 48271 + 42) % 2147483647, key LIMIT 500")
def search_sample(spark: SparkSession, d: str) -> DataFrame:
    """L2: an exact-size pseudo-random sample of the other sentences."""
    labels = discovery.label_reference(counts(spark, d), seeds(spark), KEYS).withColumn("key", F.expr(SAMPLE_KEY))
    return discovery.sample_search(labels, "key", 500).select(*KEYS)


VOCAB = f"{REF}, top AS (SELECT bigram FROM c GROUP BY 1 ORDER BY sum(n) DESC, bigram LIMIT {MODEL_VOCABULARY}), voc AS (SELECT bigram FROM top UNION SELECT bigram FROM seed)"


@query(f"WITH {VOCAB} SELECT bigram FROM voc")
def model_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """L3: most frequent bigrams and the seeds."""
    return discovery.model_vocabulary(counts(spark, d), seeds(spark), MODEL_VOCABULARY)


NB = f"""{VOCAB}, x AS (SELECT * FROM c SEMI JOIN voc USING (bigram)), y AS (SELECT x.*, in_R FROM x JOIN r USING (Id, sentence_id)),
per AS (SELECT voc.bigram, coalesce(sum(n) FILTER (in_R = 1), 0) AS n1, coalesce(sum(n) FILTER (in_R = 0), 0) AS n0 FROM voc LEFT JOIN y USING (bigram) GROUP BY 1),
tot AS (SELECT sum(n1) AS t1, sum(n0) AS t0, count(*) AS v FROM per), o AS (SELECT bigram, ln((n1 + 1) / (t1 + v)) - ln((n0 + 1) / (t0 + v)) AS o FROM per, tot),
sx AS (SELECT Id, sentence_id, sum(n * o) AS sx FROM x JOIN o USING (bigram) GROUP BY 1, 2), pr AS (SELECT ln(sum(in_R) / sum(1 - in_R)) AS base FROM r),
nb AS (SELECT r.Id, r.sentence_id, in_R, round(1 / (1 + exp(-(coalesce(sx, 0) + base))), 6) + 0.0 AS p_nb FROM r LEFT JOIN sx USING (Id, sentence_id), pr)"""


@query(f"WITH {NB} SELECT Id, sentence_id, p_nb FROM nb")
def nb_probability(spark: SparkSession, d: str) -> DataFrame:
    """L4: naive Bayes as plain aggregates and joins."""
    c = hub(spark, d)
    labels = discovery.label_reference(c, seeds(spark), KEYS).withColumnRenamed("in_R", "y")
    return rounded(discovery.naive_bayes(c, labels, discovery.model_vocabulary(c, seeds(spark), MODEL_VOCABULARY), KEYS), "p_nb")


def nb_target(spark: SparkSession, d: str, c: DataFrame) -> DataFrame:
    labels = stored(discovery.label_reference(c, seeds(spark), KEYS))
    p = rounded(discovery.naive_bayes(c, labels.withColumnRenamed("in_R", "y"), discovery.model_vocabulary(c, seeds(spark), MODEL_VOCABULARY), KEYS), "p_nb")
    return discovery.vote(p, ["p_nb"], labels, KEYS)


@query(f"WITH {NB} SELECT Id, sentence_id, (in_R = 1 OR p_nb > 0.8)::INTEGER AS in_T FROM nb")
def nb_vote(spark: SparkSession, d: str) -> DataFrame:
    """All sentences scored, and the vote, here with naive Bayes alone, which SQL can repeat."""
    return nb_target(spark, d, hub(spark, d))


def sampled(labels: DataFrame) -> DataFrame:
    """Keys of the seed sentences and of SAMPLE others."""
    return discovery.sample_search(labels.withColumn("key", F.expr(SAMPLE_KEY)), "key", SAMPLE).select(*KEYS).unionByName(labels.filter("in_R = 1").select(*KEYS))


@query()
def klr_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Three classifiers on exact counts and their vote, parameters pinned."""
    c = hub(spark, d)
    labels = stored(discovery.label_reference(c, seeds(spark), KEYS))
    p = discovery.ensemble(c, labels.withColumnRenamed("in_R", "y"), discovery.model_vocabulary(c, seeds(spark), MODEL_VOCABULARY), KEYS, sampled(labels), search=False)
    return discovery.vote(p, ["p_nb", "p_c2", "p_rf"], labels, KEYS)


FOLD = "CAST(substring(Id, 2) AS BIGINT) % 5"


@query(
    f"""WITH {VOCAB}, y AS (SELECT Id, sentence_id, in_R AS y, ({FOLD})::INTEGER AS fold FROM r), x AS (SELECT c.Id, c.sentence_id, bigram, n, y, fold FROM c SEMI JOIN voc USING (bigram) JOIN y USING (Id, sentence_id)),
pf AS (SELECT fold, bigram, sum(CASE WHEN y = 1 THEN n ELSE 0 END) AS f1, sum(CASE WHEN y = 0 THEN n ELSE 0 END) AS f0 FROM x GROUP BY 1, 2), pa AS (SELECT bigram, sum(f1) AS a1, sum(f0) AS a0 FROM pf GROUP BY 1), fs AS (SELECT DISTINCT fold FROM y),
rs AS (SELECT fs.fold, voc.bigram, coalesce(a1, 0) - coalesce(f1, 0) AS n1, coalesce(a0, 0) - coalesce(f0, 0) AS n0 FROM voc CROSS JOIN fs LEFT JOIN pa ON pa.bigram = voc.bigram LEFT JOIN pf ON pf.bigram = voc.bigram AND pf.fold = fs.fold),
tt AS (SELECT fold, sum(n1) AS t1, sum(n0) AS t0, count(*) AS v FROM rs GROUP BY 1), al AS (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS alpha),
od AS (SELECT fold, bigram, alpha, ln((n1 + alpha) / (t1 + alpha * v)) - ln((n0 + alpha) / (t0 + alpha * v)) AS o FROM rs JOIN tt USING (fold), al),
sc AS (SELECT Id, sentence_id, alpha, sum(n * o) AS s FROM x JOIN od USING (fold, bigram) GROUP BY 1, 2, 3), aa AS (SELECT y.*, al.alpha, round(coalesce(s, 0), 9) + 0.0 AS s FROM y CROSS JOIN al LEFT JOIN sc ON sc.Id = y.Id AND sc.sentence_id = y.sentence_id AND sc.alpha = al.alpha),
rk AS (SELECT *, rank() OVER (PARTITION BY alpha, fold ORDER BY s) + (count(*) OVER (PARTITION BY alpha, fold, s) - 1) / 2 AS rk FROM aa), au AS (SELECT alpha, fold, sum(rk) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM rk GROUP BY 1, 2)
SELECT alpha, round(avg((sr - p * (p + 1) / 2) / (p * q)), 6) + 0.0 AS auc FROM au WHERE p * q > 0 GROUP BY 1"""
)
def nb_grid(spark: SparkSession, d: str) -> DataFrame:
    """Mean AUC over five folds of each alpha of naive Bayes; folds by call, so that SQL can repeat them."""
    c = hub(spark, d)
    folded = stored(discovery.label_reference(c, seeds(spark), KEYS).select(*KEYS, F.col("in_R").alias("y"), F.expr(FOLD).cast("int").alias("fold")))
    return rounded(discovery.nb_search(c, folded, discovery.model_vocabulary(c, seeds(spark), MODEL_VOCABULARY), KEYS), "auc")


def _g2(a: str, c: str, ta: str, tc: str) -> str:
    n, w = f"({ta} + {tc})", f"({a} + {c})"
    terms = [(a, f"{w} * {ta} / {n}"), (f"({ta} - {a})", f"({n} - {w}) * {ta} / {n}"), (c, f"{w} * {tc} / {n}"), (f"({tc} - {c})", f"({n} - {w}) * {tc} / {n}")]
    s = " + ".join(f"CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / ({e})) ELSE 0 END" for o, e in terms)
    return f"(CASE WHEN {a} * {tc} >= {c} * {ta} THEN 2 * ({s}) ELSE -2 * ({s}) END)"


def _tail(x: str) -> str:
    """SQL of the p of a chi-squared value x with one degree of freedom: a series below 12.5, a continued fraction above."""
    z = f"sqrt(abs({x}) / 2)"
    total = " + ".join(f"{(-1) ** n / (math.factorial(n) * (2 * n + 1))!r}::DOUBLE * pow({z}, {2 * n + 1})" for n in range(40))
    k = z
    for n in range(30, 0, -1):
        k = f"({z} + {n / 2} / {k})"
    return f"(CASE WHEN abs({x}) < 12.5 THEN 1 - {2 / math.sqrt(math.pi)!r} * ({total}) ELSE exp(-abs({x}) / 2) / {math.sqrt(math.pi)!r} / {k} END)"


KEY = f"""{REF}, y AS (SELECT c.*, in_R FROM c JOIN r USING (Id, sentence_id)),
per AS (SELECT bigram, CAST(coalesce(sum(n) FILTER (in_R = 1), 0) AS BIGINT) AS a, CAST(coalesce(sum(n) FILTER (in_R = 0), 0) AS BIGINT) AS c, count(*) FILTER (in_R = 1) AS d FROM y GROUP BY 1),
tot AS (SELECT CAST(sum(a) AS DOUBLE) AS ta, CAST(sum(c) AS DOUBLE) AS tc FROM per),
key AS (SELECT bigram, round({_g2("CAST(a AS DOUBLE)", "CAST(c AS DOUBLE)", "ta", "tc")}, 6) + 0.0 AS G2, a AS target_freq, c AS nontarget_freq, d AS target_docfreq, round(a / (a + c), 6) + 0.0 AS target_share FROM per, tot WHERE a > 0)"""


def hub(spark: SparkSession, d: str) -> DataFrame:
    """counts, stored: for queries that read them more than once, so that texts are tokenised once."""
    return stored(counts(spark, d))


def key_table(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    c = hub(spark, d) if c is None else c
    target = discovery.label_reference(c, seeds(spark), KEYS).withColumnRenamed("in_R", "in_T")
    return rounded(discovery.keyness(c, target, KEYS, stored), "G2", "target_share")


@query(f"WITH {KEY} SELECT * FROM key")
def keyness_g2(spark: SparkSession, d: str) -> DataFrame:
    """Signed log-likelihood of each bigram of seed sentences."""
    return key_table(spark, d)


FLAGS = f"{KEY}, pk AS (SELECT key.*, {_tail('G2')} AS p, count(*) OVER () AS m FROM key)"


@query(f"WITH {FLAGS} SELECT bigram, (p < 0.05 / m)::INTEGER AS significant, (nontarget_freq = 0)::INTEGER AS target_only FROM pk")
def keyness_flags(spark: SparkSession, d: str) -> DataFrame:
    """Significance after Bonferroni's correction, and bigrams that only the target has."""
    return discovery.bonferroni(key_table(spark, d)).select("bigram", "significant", "target_only")


@query(f"WITH {FLAGS} SELECT bigram, G2, target_freq, nontarget_freq, target_docfreq, target_share, (p < 0.05 / m)::INTEGER AS significant, (nontarget_freq = 0)::INTEGER AS target_only, round(p, 6) + 0.0 AS p FROM pk")
def keyness_bonferroni(spark: SparkSession, d: str) -> DataFrame:
    """Bonferroni flag and p of each bigram."""
    return rounded(discovery.with_p(discovery.bonferroni(key_table(spark, d))), "p")


def _key(target: str) -> str:
    """CTEs of the keyness table for a target table (Id, sentence_id, in_T)."""
    return f"""ty AS (SELECT c.*, in_T FROM c JOIN {target} USING (Id, sentence_id)),
tper AS (SELECT bigram, CAST(coalesce(sum(n) FILTER (in_T = 1), 0) AS BIGINT) AS a, CAST(coalesce(sum(n) FILTER (in_T = 0), 0) AS BIGINT) AS c, count(*) FILTER (in_T = 1) AS d FROM ty GROUP BY 1),
ttot AS (SELECT CAST(sum(a) AS DOUBLE) AS ta, CAST(sum(c) AS DOUBLE) AS tc FROM tper),
tkey AS (SELECT bigram, round({_g2("CAST(a AS DOUBLE)", "CAST(c AS DOUBLE)", "ta", "tc")}, 6) + 0.0 AS G2, a AS target_freq, c AS nontarget_freq, d AS target_docfreq, round(a / (a + c), 6) + 0.0 AS target_share FROM tper, ttot WHERE a > 0)"""


@query(f"WITH {NB}, tg AS (SELECT Id, sentence_id, (in_R = 1 OR p_nb > 0.8)::INTEGER AS in_T FROM nb), {_key('tg')} SELECT * FROM tkey")
def keyness_voted(spark: SparkSession, d: str) -> DataFrame:
    """Keyness of the bigrams of the voted sentences."""
    c = hub(spark, d)
    return rounded(discovery.keyness(c, nb_target(spark, d, c), KEYS, stored), "G2", "target_share")


LOCK = f"{KEY}, found AS (SELECT * FROM key ANTI JOIN seed USING (bigram) ORDER BY G2 DESC, bigram LIMIT {DICTIONARY_TOP}), dic AS (SELECT bigram, 'seed' AS origin, G2, target_freq, target_share FROM seed LEFT JOIN key USING (bigram) UNION ALL SELECT bigram, 'discovered', G2, target_freq, target_share FROM found)"


@query(f"WITH {LOCK} SELECT * FROM dic")
def locked_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and the top of the keyness table."""
    return discovery.locked_dictionary(key_table(spark, d), seeds(spark), DICTIONARY_TOP)


VINT = f"""{REF}, y AS (SELECT c.*, in_R FROM c JOIN r USING (Id, sentence_id)), yy AS (SELECT DISTINCT year FROM c WHERE year IS NOT NULL),
u AS (SELECT year AS vintage FROM yy UNION SELECT year - 1 FROM yy WHERE year > (SELECT min(year) FROM yy)), yc AS (SELECT year, bigram, coalesce(sum(n) FILTER (in_R = 1), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (in_R = 0), 0)::DOUBLE AS c FROM y GROUP BY 1, 2),
cum AS (SELECT vintage, bigram, sum(a) AS a, sum(c) AS c FROM u JOIN yc ON year <= vintage GROUP BY 1, 2),
tot AS (SELECT vintage, sum(a) AS ta, sum(c) AS tc, count(*) FILTER (a > 0) AS m FROM cum GROUP BY 1),
g AS (SELECT vintage, bigram, m, round({_g2("a", "c", "ta", "tc")}, 6) AS G2 FROM cum JOIN tot USING (vintage) WHERE a > 0),
vin AS (SELECT vintage, bigram FROM g ANTI JOIN seed USING (bigram) WHERE G2 > 0 AND {_tail("G2")} < 0.05 / m UNION ALL SELECT vintage, bigram FROM seed, u)"""


def cutoffs(c: DataFrame) -> list[int]:
    """Years of text and the years before them, from the first year on: what calls of any year can be scored with, and the last vintage."""
    years = sorted(r.year for r in c.select("year").distinct().collect() if r.year is not None)  # bounded by the calendar
    return sorted({*years, *(y - 1 for y in years[1:])})


def vintage_table(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    c = hub(spark, d) if c is None else c
    per = stored(discovery.vintage_counts(c, discovery.label_reference(c, seeds(spark), KEYS), KEYS, "year"))
    return discovery.vintages(per, seeds(spark), "year", cutoffs(c))


@query(f"WITH {VINT} SELECT vintage, bigram FROM vin")
def vintage_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    """Seeds and all significant bigrams of the text up to each year."""
    return vintage_table(spark, d)


@query(
    f"WITH {VINT}, pv AS (SELECT vintage, lag(vintage) OVER (ORDER BY vintage) AS prev FROM u), q AS (SELECT vintage, count(*) AS n FROM vin GROUP BY 1), j AS (SELECT pv.vintage, count(*) AS n_both FROM pv JOIN vin a ON a.vintage = pv.vintage JOIN vin b ON b.vintage = pv.prev AND b.bigram = a.bigram GROUP BY 1) SELECT pv.vintage, n_both, round(n_both / (qa.n + qb.n - n_both), 6) + 0.0 AS jaccard FROM pv JOIN j USING (vintage) JOIN q qa ON qa.vintage = pv.vintage JOIN q qb ON qb.vintage = pv.prev"
)
def vintage_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each dictionary with the one before."""
    c = hub(spark, d)
    v, years = stored(vintage_table(spark, d, c)), cutoffs(c)
    later = {a: b for a, b in zip(years, years[1:], strict=False)}
    step = reduce(lambda c, kv: c.when(F.col("vintage") == kv[0], kv[1]), later.items(), F.when(F.lit(False), 0))
    prev = v.select(step.alias("vintage"), "bigram").filter("vintage IS NOT NULL")
    now = v.filter(F.col("vintage").isin(list(later.values())))
    return discovery.overlap(now, prev, ["vintage"]).select("vintage", "n_both", r6("jaccard").alias("jaccard"))


@query(
    f"WITH {VINT}, per AS (SELECT bigram, sum(a) AS a, sum(c) AS c FROM yc GROUP BY 1), tt AS (SELECT sum(a) AS ta, sum(c) AS tc FROM per), kk AS (SELECT bigram, round({_g2('a', 'c', 'ta', 'tc')}, 6) + 0.0 AS G2 FROM per, tt WHERE a > 0), dic AS (SELECT bigram, G2 FROM seed LEFT JOIN kk USING (bigram) UNION ALL (SELECT bigram, G2 FROM kk ANTI JOIN seed USING (bigram) ORDER BY G2 DESC, bigram LIMIT {DICTIONARY_TOP})), top AS (SELECT bigram FROM dic ORDER BY G2 DESC NULLS LAST, bigram LIMIT 1000), nn AS (SELECT (SELECT count(*) FROM dic) AS nf, (SELECT count(*) FROM top) AS nt) SELECT vintage, count(*) AS n_terms, round(count(dic.bigram) / any_value(nf), 6) + 0.0 AS cover_full, round(count(top.bigram) / any_value(nt), 6) + 0.0 AS cover_top, round(count(dic.bigram) / (count(*) + any_value(nf) - count(dic.bigram)), 6) + 0.0 AS jaccard_full FROM vin LEFT JOIN dic USING (bigram) LEFT JOIN top USING (bigram), nn GROUP BY 1"
)
def vintage_divergence(spark: SparkSession, d: str) -> DataFrame:
    """How much of the locked dictionary, and of its first thousand terms, each vintage holds."""
    c = hub(spark, d)
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), DICTIONARY_TOP)
    return rounded(discovery.divergence(vintage_table(spark, d, c), dic), "cover_full", "cover_top", "jaccard_full")


@query(
    f"""WITH {REF}, y AS (SELECT Id, sentence_id, bigram FROM c SEMI JOIN seed USING (bigram)), dr AS (SELECT DISTINCT s2.bigram AS dropped, Id, sentence_id FROM seed s2 JOIN y ON y.bigram <> s2.bigram),
allc AS (SELECT bigram, sum(n)::DOUBLE AS w FROM c GROUP BY 1), gr AS (SELECT sum(w) AS g FROM allc), aa AS (SELECT dropped, bigram, sum(n)::DOUBLE AS a FROM c JOIN dr USING (Id, sentence_id) GROUP BY 1, 2), ta AS (SELECT dropped, sum(a) AS ta FROM aa GROUP BY 1),
z AS (SELECT dropped, bigram, a, w - a AS c, ta, g - ta AS tc FROM aa JOIN allc USING (bigram) JOIN ta USING (dropped), gr)
SELECT dropped, bigram FROM z ANTI JOIN seed USING (bigram) QUALIFY row_number() OVER (PARTITION BY dropped ORDER BY round({_g2("a", "c", "ta", "tc")}, 6) DESC, bigram) <= 30"""
)
def leave_one_seed_out(spark: SparkSession, d: str) -> DataFrame:
    """What is found without each seed."""
    return discovery.leave_one_out(hub(spark, d), SEEDS, KEYS, 30, spark)


LOO = f"""y2 AS (SELECT Id, sentence_id, bigram FROM c SEMI JOIN seed USING (bigram)), dr AS (SELECT DISTINCT s2.bigram AS dropped, Id, sentence_id FROM seed s2 JOIN y2 ON y2.bigram <> s2.bigram),
allc AS (SELECT bigram, sum(n)::DOUBLE AS w FROM c GROUP BY 1), gr AS (SELECT sum(w) AS g FROM allc), aa AS (SELECT dropped, bigram, sum(n)::DOUBLE AS a FROM c JOIN dr USING (Id, sentence_id) GROUP BY 1, 2), ta AS (SELECT dropped, sum(a) AS ta FROM aa GROUP BY 1),
z AS (SELECT dropped, bigram, a, w - a AS c, ta, g - ta AS tc FROM aa JOIN allc USING (bigram) JOIN ta USING (dropped), gr),
lo AS (SELECT dropped, bigram FROM z ANTI JOIN seed USING (bigram) QUALIFY row_number() OVER (PARTITION BY dropped ORDER BY round({_g2("a", "c", "ta", "tc")}, 6) DESC, bigram) <= 30)"""


@query(
    f"WITH {KEY}, {LOO}, found AS (SELECT bigram FROM key ANTI JOIN seed USING (bigram) ORDER BY G2 DESC, bigram LIMIT 30), dic AS (SELECT bigram FROM seed UNION SELECT bigram FROM found), me AS (SELECT dropped, bigram FROM lo UNION SELECT a.bigram, b.bigram FROM seed a JOIN seed b ON a.bigram <> b.bigram), cc AS (SELECT Id, bigram, sum(n) AS n FROM c GROUP BY 1, 2), f0 AS (SELECT Id, sum(n) AS B, coalesce(sum(n) FILTER (bigram IN (SELECT bigram FROM dic)), 0) AS h0 FROM cc GROUP BY 1), hh AS (SELECT Id, dropped, sum(n) AS h FROM cc JOIN me USING (bigram) GROUP BY 1, 2), ab AS (SELECT seed.bigram AS dropped, h0 / B AS a, coalesce(h, 0) / B AS b FROM f0 CROSS JOIN seed LEFT JOIN hh ON hh.Id = f0.Id AND hh.dropped = seed.bigram), rk AS (SELECT *, rank() OVER (PARTITION BY dropped ORDER BY a) + (count(*) OVER (PARTITION BY dropped, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY dropped ORDER BY b) + (count(*) OVER (PARTITION BY dropped, b) - 1) / 2 AS rb FROM ab) SELECT dropped, count(*) AS n, round(corr(a, b), 6) + 0.0 AS pearson, round(corr(ra, rb), 6) + 0.0 AS spearman FROM rk GROUP BY 1"
)
def perturbation_measure(spark: SparkSession, d: str) -> DataFrame:
    """Every call scored again with the dictionary found without each seed, against its own score."""
    c = hub(spark, d)
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), 30)
    lo = discovery.leave_one_out(c, SEEDS, KEYS, 30, spark)
    return rounded(discovery.perturbed_measure(stored(tokens.group(c, ["Id"])), dic, lo, SEEDS, "Id"), "pearson", "spearman")


@query(f"WITH {KEY}, top AS (SELECT bigram, G2 FROM key ORDER BY G2 DESC, bigram LIMIT 100), q AS (SELECT quantile_cont(G2, [0.2, 0.4, 0.6, 0.8]) AS b FROM top) SELECT bigram, G2, round(sqrt(greatest(G2, 0)), 6) + 0.0 AS size, (1 + len(list_filter(b, lambda x: G2 > x)))::INTEGER AS bin FROM top, q")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    """The hundred strongest terms in five bins by quantile breaks."""
    return rounded(discovery.top_terms(key_table(spark, d)), "size").withColumn("bin", F.col("bin").cast("int"))


def _theme(words: tuple[str, ...]) -> str:
    return f"(list_has_any(string_split(bigram, ' '), {_in(words)})" + "".join(f" OR contains(bigram, '{w}')" for w in words if len(w) > 4) + ")"


CLASS = f"""th AS (SELECT DISTINCT bigram, list_filter([{", ".join(f"CASE WHEN {_theme(ws)} THEN '{t}' END" for t, ws in THEMES.items())}], lambda x: x IS NOT NULL) AS l, list_has_any(string_split(bigram, ' '), {_in(GENERIC)}) AS g, list_contains({_in(LEADS)}, string_split(bigram, ' ')[1]) AS f FROM c),
cl AS (SELECT bigram, CASE WHEN f THEN CASE WHEN len(l) > 0 AND NOT g THEN 'domain' ELSE 'noise' END WHEN len(l) > 0 AND NOT g THEN 'domain' WHEN len(l) > 0 THEN 'domain+generic' WHEN g THEN 'generic' ELSE 'noise' END AS class, array_to_string(l, ',') AS themes FROM th)"""


@query(f"WITH {BIG}, {CLASS} SELECT bigram, class, themes FROM cl")
def bigram_class(spark: SparkSession, d: str) -> DataFrame:
    """Domain, generic or noise."""
    return discovery.classify(counts(spark, d).select("bigram").distinct(), THEMES, GENERIC, leads=LEADS)


@query(f"WITH {LOCK.replace('c AS (SELECT Id', 'c AS (SELECT Id')}, {CLASS.replace('FROM c)', 'FROM dic)')} SELECT class, count(*) AS n FROM cl GROUP BY 1")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the dictionary's bigrams."""
    dic = discovery.locked_dictionary(key_table(spark, d), seeds(spark), DICTIONARY_TOP)
    return discovery.classify(dic.select("bigram"), THEMES, GENERIC, leads=LEADS).groupBy("class").agg(F.count("*").alias("n"))


@query(f"WITH {LOCK}, {CLASS.replace('FROM c)', 'FROM dic)')}, pr AS (SELECT bigram, class, CASE class WHEN 'domain' THEN 'keep' WHEN 'domain+generic' THEN 'review' ELSE 'drop' END AS decision FROM cl) SELECT bigram, class, decision, CASE WHEN bigram IN (SELECT bigram FROM seed) OR decision = 'keep' THEN 'keep' ELSE 'drop' END AS final FROM pr")
def curation(spark: SparkSession, d: str) -> DataFrame:
    """Proposals, and what stays after the decision that all seeds are kept."""
    dic = discovery.locked_dictionary(key_table(spark, d), seeds(spark), DICTIONARY_TOP)
    p = discovery.propose(discovery.classify(dic.select("bigram"), THEMES, GENERIC, leads=LEADS))
    f = discovery.finalise(p, seeds(spark).withColumn("decision", F.lit("keep"))).withColumnRenamed("decision", "final")
    return p.select("bigram", "class", "decision").join(f, "bigram")


@query(f"WITH {LOCK}, {CLASS.replace('FROM c)', 'FROM dic)')}, dc AS (SELECT dic.bigram, origin, G2, class, themes FROM dic LEFT JOIN cl USING (bigram)) SELECT 'full' AS dictionary, bigram FROM dc UNION ALL SELECT 'pruned', bigram FROM dc WHERE origin = 'seed' OR class = 'domain' UNION ALL SELECT 'ex_energy', bigram FROM dc WHERE origin = 'seed' OR NOT list_contains(string_split(coalesce(themes, ''), ','), 'energy') UNION ALL SELECT 'small', bigram FROM dc WHERE origin = 'seed' UNION ALL SELECT 'small', bigram FROM (SELECT bigram FROM dc WHERE origin <> 'seed' ORDER BY G2 DESC NULLS LAST, bigram LIMIT 100)")
def dictionary_variants(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary whole, pruned, without a theme, and small."""
    dic = stored(discovery.locked_dictionary(key_table(spark, d), seeds(spark), DICTIONARY_TOP))
    return scoring.variants(dic, discovery.classify(dic.select("bigram"), THEMES, GENERIC, leads=LEADS), ["energy"], 100)


FLAG = f"fl AS (SELECT Id, sentence_id, list_has_any(t, {_in(RISK_WORDS)})::INTEGER AS risk, list_has_any(t, {_in(POSITIVE)})::INTEGER AS pos, list_has_any(t, {_in(NEGATIVE)})::INTEGER AS neg FROM w)"
SCORE = f"""{LOCK}, {FLAG}, h AS (SELECT Id, sentence_id, sum(n) AS B, coalesce(sum(n) FILTER (bigram IN (SELECT bigram FROM dic)), 0) AS h FROM c GROUP BY 1, 2),
sc AS (SELECT Id, sum(B) AS B, sum(h) AS h, sum(h * risk) AS hr, sum(h * pos) AS hp, sum(h * neg) AS hn FROM h JOIN fl USING (Id, sentence_id) GROUP BY 1)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    s, c = sentences(spark, d), hub(spark, d)
    f = scoring.flags(s, KEYS, "text", {"risk": RISK_WORDS, "pos": POSITIVE, "neg": NEGATIVE})
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), DICTIONARY_TOP)
    return scoring.exposure(c, dic, f, "Id", "sentence_id")


@query(f"WITH {SCORE} SELECT Id, CAST(B AS BIGINT) AS B, CAST(h AS BIGINT) AS h, round(h / B, 6) + 0.0 AS exposure, round(hr / B, 6) + 0.0 AS risk, round(hp / B - hn / B, 6) + 0.0 AS sentiment FROM sc")
def exposure_scores(spark: SparkSession, d: str) -> DataFrame:
    """Exposure, risk and sentiment of each call."""
    return rounded(scores(spark, d).select("Id", "B", "h", "exposure", "risk", "sentiment"), "exposure", "risk", "sentiment")


@query(f"WITH {SCORE} SELECT count(*) AS n, round(avg(h / B), 6) + 0.0 AS mean, round(stddev_samp(h / B), 6) + 0.0 AS sd, round(quantile_cont(h / B, 0.99), 6) + 0.0 AS p99, round(avg((h > 0)::INTEGER), 6) + 0.0 AS share_hit FROM sc")
def score_audit(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of the exposure."""
    return rounded(scoring.audit(scores(spark, d), [], "exposure"), "mean", "sd", "p99", "share_hit")


IDF = "nt AS (SELECT count(DISTINCT Id) AS nt FROM c), idf AS (SELECT bigram, count(DISTINCT Id) AS docfreq FROM c GROUP BY 1)"


@query(f"WITH {BIG}, {IDF} SELECT bigram, docfreq, round(ln(nt / docfreq), 6) + 0.0 AS w FROM idf, nt")
def idf_weights(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency over calls and its weight."""
    return rounded(scoring.idf(hub(spark, d), "Id"), "w")


@query(
    f"WITH {LOCK}, {IDF}, va AS (SELECT 'full' AS dictionary, bigram FROM dic UNION ALL SELECT 'seeds', bigram FROM seed), bb AS (SELECT Id, sum(n) AS B FROM c GROUP BY 1) SELECT Id, dictionary, round(sum(n * ln(nt / docfreq)) / any_value(B), 6) + 0.0 AS tfidf, round(sum(n) / any_value(B), 6) + 0.0 AS exposure FROM c JOIN va USING (bigram) JOIN idf USING (bigram) JOIN bb USING (Id), nt GROUP BY 1, 2"
)
def tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    """TF-IDF of each call by two dictionaries in one pass."""
    c = hub(spark, d)
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), DICTIONARY_TOP).select(F.lit("full").alias("dictionary"), "bigram")
    both = dic.unionByName(seeds(spark).select(F.lit("seeds").alias("dictionary"), "bigram"))
    return rounded(scoring.tfidf(tokens.group(c, ["Id"]), scoring.idf(c, "Id"), both, "Id"), "tfidf", "exposure")


@query(
    f"WITH {SCORE}, m AS (SELECT sc.Id, min(year) AS year, any_value(h / B) AS e FROM sc JOIN s USING (Id) GROUP BY 1) SELECT substring(Id, 1, 8) AS grp, year, round(avg(e), 6) + 0.0 AS exposure, count(*) AS n_calls FROM m GROUP BY 1, 2"
)
def period_mean(spark: SparkSession, d: str) -> DataFrame:
    """Means by firm and period, here by the leading characters of the call's id and its first year."""
    years = sentences(spark, d).groupBy("Id").agg(F.min("year").alias("year"))
    s = scores(spark, d).join(years, "Id").withColumn("grp", F.substring("Id", 1, 8))
    return rounded(scoring.period_mean(s, ["grp", "year"], ["exposure"]), "exposure")


@query(
    f"WITH {VINT}, fl AS (SELECT c.Id, c.year, sum(n) AS B, coalesce(sum(n) FILTER (vin.bigram IS NOT NULL), 0) AS h FROM c LEFT JOIN vin ON vin.vintage + 1 = c.year AND vin.bigram = c.bigram GROUP BY 1, 2) SELECT Id, year, CASE WHEN year - 1 IN (SELECT vintage FROM u) THEN round(h / B, 6) + 0.0 END AS exposure FROM fl"
)
def realtime_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each year scored with the dictionary of the year before; null in the first, which has none."""
    c = hub(spark, d)
    return rounded(scoring.realtime(c, stored(vintage_table(spark, d, c)), "Id", "year"), "exposure")


HITS = "ht AS (SELECT Id, sentence_id, bigram, n FROM c SEMI JOIN dic USING (bigram))"


@query(
    f"""WITH {LOCK}, {HITS}, tt AS (SELECT Id, bigram, sum(n) AS m FROM ht GROUP BY 1, 2), ft AS (SELECT Id, bigram FROM tt QUALIFY row_number() OVER (PARTITION BY Id ORDER BY m DESC, bigram) = 1),
ce AS (SELECT Id, sentence_id AS ctr FROM ht JOIN ft USING (Id, bigram) QUALIFY row_number() OVER (PARTITION BY Id ORDER BY n DESC, sentence_id) = 1),
nu AS (SELECT s.Id, s.sentence_id, text, row_number() OVER (PARTITION BY s.Id ORDER BY s.sentence_id) AS i, count(*) OVER (PARTITION BY s.Id) AS ns FROM s), cn AS (SELECT nu.Id, i AS c, ns FROM nu JOIN ce ON ce.Id = nu.Id AND ce.ctr = nu.sentence_id),
w2 AS (SELECT Id, least(ns, greatest(1, c - 4) + 9) AS hi FROM cn), w3 AS (SELECT Id, greatest(1, hi - 9) AS start, hi FROM w2)
SELECT nu.Id, start, md5(string_agg(text, ' ' ORDER BY sentence_id)) AS text_md5 FROM w3 JOIN nu ON nu.Id = w3.Id AND i BETWEEN start AND hi GROUP BY 1, 2"""
)
def audit_snippets(spark: SparkSession, d: str) -> DataFrame:
    """V5: ten sentences around the sentence where a call's most frequent dictionary bigram is densest."""
    c = hub(spark, d)
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), DICTIONARY_TOP)
    x = validate.snippets(sentences(spark, d), tokens.match(c, dic).select(*KEYS, "bigram", "n"), "Id", "sentence_id", "text")
    return x.select("Id", "start", F.md5("snippet").alias("text_md5"))


STRATA = f"{LOCK}, hi AS (SELECT Id, sentence_id, coalesce(sum(n) FILTER (bigram IN (SELECT bigram FROM dic WHERE origin = 'discovered' AND G2 > 3.84)), 0) AS n_hits, count(*) FILTER (bigram IN (SELECT bigram FROM seed)) AS k FROM c GROUP BY 1, 2), st AS (SELECT Id, sentence_id, n_hits::BIGINT AS n_hits, CASE WHEN n_hits >= 2 THEN 'many' WHEN n_hits = 1 THEN 'one' WHEN k > 0 THEN 'seed' ELSE 'clean' END AS stratum FROM hi)"


@query(f"WITH {STRATA} SELECT stratum, Id, sentence_id, row_number() OVER (PARTITION BY stratum ORDER BY (({SAMPLE_KEY} % 2147483647) * 48271 + 42) % 2147483647, {SAMPLE_KEY})::INTEGER AS draw FROM st QUALIFY draw <= 50")
def sentence_strata(spark: SparkSession, d: str) -> DataFrame:
    """V1: fifty sentences each with many hits, one hit, seeds only, and none."""
    c = hub(spark, d)
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), DICTIONARY_TOP).filter("origin = 'discovered' AND G2 > 3.84")
    x = validate.hit_strata(c, dic, seeds(spark), KEYS).withColumn("key", F.expr(SAMPLE_KEY))
    return validate.stratified(x, ["stratum"], "key", 50).select("stratum", *KEYS, "draw")


@query(
    f"WITH {LOCK}, ht AS (SELECT Id, sentence_id, sum(n) AS n FROM c WHERE bigram IN (SELECT bigram FROM dic WHERE G2 > 3.84) GROUP BY 1, 2), ca AS (SELECT Id, sum(n) AS h FROM ht GROUP BY 1), al AS (SELECT DISTINCT Id FROM c), bs AS (SELECT Id, sentence_id FROM ht QUALIFY row_number() OVER (PARTITION BY Id ORDER BY n DESC, sentence_id) <= 6), ex AS (SELECT Id, substring(string_agg(text, ' ' ORDER BY sentence_id), 1, 800) AS excerpt FROM bs JOIN s USING (Id, sentence_id) GROUP BY 1) SELECT al.Id, coalesce(h, 0)::BIGINT AS h, CASE WHEN coalesce(h, 0) >= 2 THEN 1 WHEN coalesce(h, 0) = 0 THEN 0 END AS geo, md5(excerpt) AS text_md5 FROM al LEFT JOIN ca USING (Id) LEFT JOIN ex USING (Id)"
)
def call_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """V1: calls with and without hits, and the excerpt of six sentences that a rater is shown."""
    c = hub(spark, d)
    dic = discovery.locked_dictionary(key_table(spark, d, c), seeds(spark), DICTIONARY_TOP).filter("G2 > 3.84")
    hits = stored(tokens.match(c, dic).groupBy(*KEYS).agg(F.sum("n").alias("n")))
    calls = validate.call_strata(hits, c, "Id")
    return calls.join(validate.excerpts(hits, sentences(spark, d), KEYS, "text"), "Id", "left").select("Id", F.col("h").cast("bigint").alias("h"), "geo", F.md5("excerpt").alias("text_md5"))
