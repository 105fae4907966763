"""Reading level by smoothed unigram language models, one per year of schooling.

Training: the grade of a labelled document is the median of its raters. Each grade's model is the word distribution of its own
documents and, with falling weight, of those of near grades; a linear mixture with the distribution of the whole training set takes the
rest of the weight, so no word is impossible. The level of a text is the grade with the highest posterior likelihood. The words are
counted where the documents lie: the driver gets one row for each word of the vocabulary.

What is measured is a document's prose: words of lines that are no tables, without speaker labels, marks of enumeration, stage
directions, bare figures and abbreviations with full stops. Whether it is English is decided by the text alone, by unigram models of the
languages, trained on the documents' own language labels; the text decides against a wrong label, as most labels are right. Words that no
model knows count by their script.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = 20
#: Share of the weight of a grade's model that lies on the whole training set, and the spread of a document's grade over its neighbours.
BACKGROUND, SPREAD = 0.2, 1.5
#: Words that the prior of a language counts for, and share of its weight that lies on all languages' words.
PRIOR_WORDS, SHARED = 1000.0, 0.01
PROSE_LEAST = 30

#: Frequent function words that tell the languages of the collection apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with was on are by this be at from or an have not which we our they will you has its their these but if when",
    "de": "der die das und ist nicht wir von mit den auf für im ein eine zu des sich dem bei aus hat sind werden an über wird einer",
    "fr": "le la les des et est que pour dans une du sur avec nous au aux ne pas par plus ce cette sont ont nos qui un de",
    "es": "el la los las del y es que para en una con por se no más su al sobre nuestra nuestro lo hay esta un de",
}
#: Codes of three letters for the same languages.
CODES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "jpn": "ja"}
#: Instead of words that no model knows, by script; and the language of what is in none of the above.
LATIN, FOREIGN, OTHER = "\x00latin", "\x00foreign", "?"
_STAGE = re.compile(r"\[[^\]\n]{0,40}\]|<[^>\n]{0,80}>|&[a-z]{2,8};|https?://\S+")
_SPEAKER = re.compile(r"^\s*(?:[A-Z][\w.'-]*(?: [A-Z][\w.'-]*){0,3}|[A-Z]{2,5}) ?:\s", re.M)
#: Abbreviations with a full stop.
ABBREVIATIONS = ("no", "art", "cf", "vs", "approx", "etc", "inc", "ltd", "corp", "co", "mr", "ms", "dr")
_ABBREVIATED = {f"{x}.": re.compile(rf"{x}\.(?<=\b{x}\.)") for x in ABBREVIATIONS}
_INITIALS, _INITIAL = re.compile(r"\b(?:[^\W\d_]\.){2,}"), re.compile(r"\.[^\W\d_]\.")
_HYPHEN = re.compile(r"(\w)-\n(\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)*")
_FIGURE, _FIGURES = re.compile(r"\d"), re.compile(r"\d+")


def prose(text: str | None) -> list[str]:
    """Lower-case words of the prose of a text."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).replace("\u200b", "").replace("\u00ad", "")
    if "[" in text or "<" in text or "&" in text or "://" in text:
        text = _STAGE.sub(" ", text)
    if "-\n" in text:
        text = _HYPHEN.sub(r"\1\2", text)
    lines = text.split("\n")
    if _FIGURE.search(text) or "|" in text or "\t" in text:
        lines = [x for x in lines if not _is_table(x)]
    text = "\n".join(lines)
    if ":" in text:
        text = _SPEAKER.sub(" ", text)
    return _words(text)


def _words(text: str) -> list[str]:
    text = text.lower()
    if "." in text:
        if _INITIAL.search(text):
            text = _INITIALS.sub(" ", text)
        for short, pattern in _ABBREVIATED.items():
            if short in text:
                text = pattern.sub(" ", text)
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text)


def _is_table(line: str) -> bool:
    """Whether a line has more figures, or cells, than words."""
    cells = line.count("|") + line.count("\t")
    if cells < 2 and not _FIGURE.search(line):
        return False
    tokens = line.split()
    if 3 * len(_FIGURES.findall(line)) + 2 * cells + 4 <= 0.7 * len(tokens):
        return False  # clearly prose
    words = len(_words(_SPEAKER.sub(" ", line)))
    figures = sum(1 for w in tokens if _FIGURE.search(w))
    return figures * 2 > words or (cells >= 2 and cells * 2 > words)


def script(word: str) -> str:
    return LATIN if word[0] < "\u0250" or "\u1e00" <= word[0] < "\u1f00" else FOREIGN


class Models:
    """Unigram models of grades and languages over one vocabulary. logs: a row of log-probabilities per word, then one for unknown words in
    Latin letters and one for others; columns: grades 1 to GRADES, then `languages`. prior: the same for no words at all."""

    def __init__(self, words: dict[str, int], logs: np.ndarray, prior: np.ndarray, languages: list[str], graded: bool):
        self.words, self.logs, self.prior, self.languages, self.graded = words, logs, prior, languages, graded

    def judge(self, words: Counter[str]) -> tuple[str | None, np.ndarray | None]:
        """The language of counted words (null if there are none) and the posterior of the grades (null without labelled texts)."""
        if not words:
            return None, None
        n = len(self.words)
        index = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        if (index < 0).any():
            index = np.fromiter((i if i >= 0 else n + (script(w) == FOREIGN) for i, w in zip(index, words, strict=True)), dtype=np.int64, count=len(words))
        times = np.fromiter(words.values(), dtype=np.float32, count=len(words))
        x = self.prior + times @ self.logs[index]
        language = self.languages[int(x[GRADES:].argmax())]
        if not self.graded:
            return language, None
        g = np.exp(x[:GRADES] - x[:GRADES].max())
        return language, g / g.sum()


def train(words: list[str], graded: np.ndarray, graded_docs: np.ndarray, spoken: dict[str, np.ndarray], spoken_docs: dict[str, float]) -> Models:
    """graded: (word, grade) counts, graded_docs: documents of each grade; spoken: counts of the words by language, spoken_docs its documents.

    A language that FUNCTION_WORDS has starts from them, so that it is known without any labelled text; one more language, OTHER, stands
    for scripts that none of them uses.
    """
    index = {w: i for i, w in enumerate(words)}
    for listed in FUNCTION_WORDS.values():
        for w in listed.split():
            index.setdefault(w, len(index))
    n = len(index)
    grades = np.arange(1, GRADES + 1)
    near = np.exp(-0.5 * ((grades[:, None] - grades[None, :]) / SPREAD) ** 2)
    near[near < 1e-3] = 0
    counts = np.zeros((n + 2, GRADES))
    counts[: len(words)] = graded @ near
    docs = graded_docs @ near
    total = counts.sum(axis=1, keepdims=True) + 0.01
    background = total / total.sum()
    own = counts / np.maximum(counts.sum(axis=0, keepdims=True), 1e-9)
    seen = counts.sum(axis=0) > 0
    p = np.where(seen, (1 - BACKGROUND) * own, 0) + np.where(seen, BACKGROUND, 1) * background

    languages = sorted({*FUNCTION_WORDS, *spoken, OTHER})
    said = np.zeros((n + 2, len(languages)))
    for k, name in enumerate(languages):
        if name in spoken:
            said[: len(words), k] = spoken[name]
        listed = FUNCTION_WORDS.get(name, "").split()
        for w in listed:
            said[index[w], k] += 0.4 * PRIOR_WORDS / len(listed)
        latin = 0.95 if listed else 0.05
        said[n, k] += (0.6 if listed else 1.0) * PRIOR_WORDS * latin
        said[n + 1, k] += (0.6 if listed else 1.0) * PRIOR_WORDS * (1 - latin)
    common = (said.sum(axis=1, keepdims=True) + 0.01) / (said.sum() + 0.01 * len(said))
    q = (1 - SHARED) * said / said.sum(axis=0, keepdims=True) + SHARED * common
    prior = np.concatenate([docs + 1e-6, [spoken_docs.get(x, 0.0) + 1.0 for x in languages]])
    prior[:GRADES] /= prior[:GRADES].sum()
    prior[GRADES:] /= prior[GRADES:].sum()
    return Models(index, np.log(np.concatenate([p, q], axis=1)).astype(np.float32), np.log(prior), languages, bool(graded_docs.sum()))


def is_english(words: list[str], models: Models | None = None) -> bool:
    """Of prose(); without trained models by the priors of the languages alone."""
    return (models or untrained()).judge(Counter(words))[0] == "en"


@cache
def untrained() -> Models:
    return train([], np.zeros((0, GRADES)), np.zeros(GRADES), {}, {})


def language_code(c: Column) -> Column:
    """Two letters of a language label, however it is spelt; null for what is no code."""
    low = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, low), F.when(low.rlike(r"^[a-z]{2}([-_].*)?$"), F.substring(low, 1, 2)))


def _counted(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(text, grade or null, language or null) to (class, word, n), added up until `most` are held: class is a grade's number or a language, and
    the empty word counts its documents. Only texts that the languages' priors call English count for a grade."""
    held: Counter[tuple[str, str]] = Counter()

    def flush() -> pa.RecordBatch:
        keys, n = list(held), list(held.values())
        held.clear()
        return pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(n, pa.int64())], names=["class", "word", "n"])

    for batch in batches:
        for text, grade, language in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = Counter(prose(text))
            if not words:
                continue
            of = [language] if language else []
            if grade is not None and untrained().judge(words)[0] == "en":
                of.append(str(int(math.floor(grade + 0.5))))
            for c in of:
                held[c, ""] += 1
                for w, n in words.items():
                    held[c, w] += n
            if len(held) >= most:
                yield flush()
    yield flush()


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", language: str | None = "lang", labelled: int = 20_000, per_language: int = 2_000, vocabulary: int = 100_000) -> Models:
    """From labels (id, rater_id, grade) and texts. Grades that are null or not 1 to 20 are dropped, a rater counts once per document
    (the median of their grades), and the median of the raters is the document's grade. Only English texts with prose are used.

    Bounds, the same at every size: the grades are learned from at most `labelled` labelled documents, the ones with the lowest hash of
    their id; each language from about `per_language` of the documents that the column `language` gives it (there may be no such column),
    by the hash too; the `vocabulary` most frequent words of these texts are known. Without labelled texts every grade is null.
    """
    one = labels.filter(F.col("grade").between(1, GRADES)).groupBy(id, "rater_id").agg(F.median("grade").alias("g")).groupBy(id).agg(F.median("g").alias("g"))
    chosen = one.orderBy(F.xxhash64(id), id).limit(labelled)
    share = F.lit(None).cast("string")
    source = docs.select(id, text)
    if language in docs.columns:
        source = docs.select(id, text, language_code(F.col(language)).alias("_l"))
        sizes = {r["_l"]: r["count"] for r in source.filter("_l IS NOT NULL").groupBy("_l").count().collect()}  # at most 676 codes
        if sizes:
            rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
            share = F.when(F.pmod(F.xxhash64(F.lit("language"), id), F.lit(1 << 20)) < F.try_element_at(rate, F.col("_l")) * (1 << 20), F.col("_l"))
    # Broadcast: at most `labelled` ids with a grade. So no text is moved.
    known = source.join(F.broadcast(chosen), id, "left").select(F.col(text).cast("string").alias("t"), "g", share.alias("l")).filter("t IS NOT NULL AND (g IS NOT NULL OR l IS NOT NULL)")
    per = known.mapInArrow(_counted, "class string, word string, n bigint").groupBy("class", "word").agg(F.sum("n").alias("n"))
    row = per.groupBy("word").agg(F.sum("n").alias("total"), F.collect_list(F.struct("class", "n")).alias("by"))  # a class is a grade or a language
    rows = row.orderBy(F.col("word") != "", F.col("total").desc(), "word").limit(vocabulary + 1).select("word", F.col("by.class").alias("c"), F.col("by.n").alias("n")).toPandas()
    words = [w for w in rows["word"] if w]
    graded, graded_docs = np.zeros((len(words), GRADES)), np.zeros(GRADES)
    spoken: dict[str, np.ndarray] = {}
    spoken_docs: dict[str, float] = {}
    at = 0
    for w, classes, ns in rows.itertuples(index=False):
        for c, n in zip(classes, ns, strict=True):
            if c.isdigit():
                if w:
                    graded[at, int(c) - 1] = n
                else:
                    graded_docs[int(c) - 1] = n
            elif w:
                spoken.setdefault(c, np.zeros(len(words)))[at] = n
            else:
                spoken_docs[c] = float(n)
        at += bool(w)
    return train(words, graded, graded_docs, spoken, spoken_docs)


def levels(docs: DataFrame, models: Models, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(<id>, n_words, english, grade, confidence): words of prose; whether it is English; the level of highest posterior and its
    posterior, null for texts that are not English or have no prose (null, empty, tables only)."""
    shared = docs.sparkSession.sparkContext.broadcast((models.words, models.logs, models.prior, models.languages, models.graded))  # bounded by the vocabulary
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string"))
    kind = source.schema[0].dataType.simpleString()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Models(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, english, grade, sure = [], [], [], []
                for row in range(part.num_rows):
                    ws = prose(part.column(1)[row].as_py())
                    n.append(len(ws))
                    language, p = m.judge(Counter(ws))
                    ok = language == "en"
                    english.append(ok)
                    grade.append(int(p.argmax()) + 1 if ok and p is not None else None)
                    sure.append(float(p.max()) if ok and p is not None else None)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int32()), pa.array(english, pa.bool_()), pa.array(grade, pa.int32()), pa.array(sure, pa.float64())], names=["id", "n_words", "english", "grade", "confidence"])

    return source.mapInArrow(judged, f"id {kind}, n_words int, english boolean, grade int, confidence double").withColumnRenamed("id", id)
