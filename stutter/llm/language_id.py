"""Language identification: words first, then shorter and shorter character n-grams.

Known words score by their log frequency in each language. A word that is not
known is covered from the left by the longest known n-grams, four characters
down to one, which score the same way; borders of words count as characters.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .text import slices
from .tokens import release, trim

LABELLED = 20_000  # labelled documents learned from, about; chosen by a hash in each language
RAREST = 1_000_000  # a word (n-gram) is learned if it is one in so many of some language, or more, and seen twice
LONGEST = 4  # characters of an n-gram
UNKNOWN = "und"
_PLACES = 1 << 30  # of rows by their hash
_AT_HAND = 200_000  # different n-grams that a task counts before it sends them on
_TOGETHER = 2 << 20  # bytes of text looked at together
_REMEMBERED = 100_000  # scores of unknown words that a task keeps
_LETTERS = re.compile(r"[^\W\d_]+")
_SMOOTH = 0.5


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def has_letter(words: list[str]) -> bool:
    return any(c.isalpha() for w in words for c in w)


def grams_of(word: str) -> Iterator[str]:
    marked = f"<{word}>"
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for lo, hi in slices(batch["text"], _TOGETHER):
            counts: Counter = Counter()
            part = batch.slice(lo, hi - lo)
            for lang, text in zip(part["lang"].to_pylist(), part["text"].to_pylist(), strict=True):
                counts.update(zip(itertools.repeat(lang), words_of(text)))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"],
            )
    trim()


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams of whole words, which are whole sentences in scripts without spaces; sent on when many are at hand."""
    counts: Counter = Counter()

    def sent() -> pa.RecordBatch:
        keys, n = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array(n, pa.int64())], ["lang", "word", "n"],
        )

    for batch in batches:
        for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n")), strict=True):
            grams = grams_of(word)
            while part := list(itertools.islice(grams, _AT_HAND)):
                for g in part:
                    counts[lang, g] += n
                if len(counts) > _AT_HAND:
                    yield sent()
    if counts:
        yield sent()
    trim()


class Model:
    """Log frequencies of words and n-grams in each language, and last a mark of what speaks for a language at all.

    Known words do, and n-grams of two letters or more.
    """

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]], totals: dict[str, int]):
        self.langs = sorted(totals)
        at = {lang: i for i, lang in enumerate(self.langs)}
        all_words = np.array([totals[lang] for lang in self.langs], np.float64)

        def table(rows, all_):
            names = {w: i for i, w in enumerate(dict.fromkeys(w for _, w, _ in rows))}
            counts = np.zeros((len(names), len(self.langs)))
            for lang, w, n in rows:
                counts[names[w], at[lang]] += n
            scores = np.log(counts + _SMOOTH) - np.log(all_ + _SMOOTH * max(1, len(names)))
            return names, scores.astype(np.float32)

        def marked(names, scores, marks):
            return names, np.column_stack([scores, np.array(marks, np.float32).reshape(len(names))])

        known, scores = table(words, all_words)
        self.words, self.word_scores = marked(known, scores, [1] * len(known))
        of_lang = np.zeros(len(self.langs))
        for lang, _, n in grams:
            of_lang[at[lang]] += n
        known, scores = table(grams, of_lang)
        self.grams, self.gram_scores = marked(known, scores, [len(g.strip("<>")) > 1 for g in known])

    def backoff(self, word: str) -> np.ndarray:
        """Scores of a word that is not known."""
        marked, i = f"<{word}>", 0
        score = np.zeros(len(self.langs) + 1, np.float32)
        while i < len(marked):
            for n in range(LONGEST, 0, -1):
                g = self.grams.get(marked[i : i + n])
                if g is not None:
                    score += self.gram_scores[g]
                    i += n
                    break
            else:
                i += 1
        return score


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.index = dict(self.model.words)
        self.table = np.concatenate([self.model.word_scores, np.zeros((1024, len(self.model.langs) + 1), np.float32)])

    def scores(self, texts: list[str | None]):
        """Language and score of each text, and whether the language can be told."""
        model = self.model
        if len(self.index) > len(model.words) + _REMEMBERED:
            self._clear()
        for text in texts:
            words = words_of(text)
            letter = has_letter(words)
            if not model.langs or not letter:
                yield UNKNOWN, 0.0, letter
                continue
            total = np.zeros(len(model.langs) + 1)
            for lo in range(0, len(words), 1 << 16):
                part = words[lo : lo + (1 << 16)]
                for w in part:
                    if w not in self.index:
                        k = len(self.index)
                        if k == len(self.table):
                            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                        self.index[w], self.table[k] = k, model.backoff(w)
                at = np.fromiter(map(self.index.__getitem__, part), np.int64, len(part))
                total += self.table[at].sum(axis=0, dtype=np.float64)
                if len(self.index) > len(model.words) + 4 * _REMEMBERED:  # one text of very many new words
                    self._clear()
            *total, known = total
            best = int(np.argmax(total))
            yield model.langs[best], float(1 / np.exp(np.array(total) - total[best]).sum()), known > 0


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = _Scorer(pickle.loads(shared.value))
        for batch in batches:
            for lo, hi in slices(batch["text"], _TOGETHER):
                part = batch.slice(lo, hi - lo)
                got = list(scorer.scores(part["text"].to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part["rest"], part["text"], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                     pa.array([g[2] for g in got], pa.bool_())],
                    ["rest", "text", "lang_pred", "score", "told"],
                )
        del scorer
        trim()

    return run


def shares(rows: dict[str, int], most: int) -> dict[str, float]:
    """Share of the rows of each language that is learned from, with about ``most`` rows in all: small languages whole."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        part = min(n, left / (len(rows) - k))
        out[lang], left = part / n, left - part
    return out


def learn(labelled: DataFrame, most: int = LABELLED) -> Model:
    """A model from ``labelled(doc_id, text, lang)``: all rows up to ``most``, beyond that a share by hash.

    Each language has the same share of ``most``; one with fewer rows is taken
    whole, and what it leaves goes to the others. At least the row with the
    smallest hash of each language is taken. Words make the model that are seen
    twice and are one in ``RAREST`` of the words of some language or more, and
    n-grams likewise, so no language can bring more than ``RAREST`` of them.
    """
    spark = labelled.sparkSession
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_PLACES))
    known = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
    if sum(r.n for r in known) > most:
        part = shares({r.lang: r.n for r in known}, most)
        upto = [(r.lang, max(int(part[r.lang] * _PLACES), r.least + 1)) for r in known]
        few = F.broadcast(spark.createDataFrame(upto, "lang string, upto long"))  # a row per language
        labelled = labelled.join(few, "lang").where(place < F.col("upto"))
    found = labelled.select("lang", "text").mapInArrow(_word_counts, "lang string, word string, n long")
    counts = written(found.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}

    def frequent(df: DataFrame) -> list[tuple[str, str, int]]:
        of_lang = F.broadcast(df.groupBy("lang").agg(F.sum("n").alias("total")))  # a row per language
        often = F.max(F.col("n") * RAREST >= F.col("total"))
        several = df.join(of_lang, "lang").groupBy("word").agg(F.sum("n").alias("all"), often.alias("often"))
        several = several.where("all > 1 and often").select("word")
        return [(r.lang, r.word, r.n) for r in df.join(several, "word").select("lang", "word", "n").collect()]

    grams = counts.mapInArrow(_gram_counts, "lang string, word string, n long")
    grams = written(grams.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    return Model(frequent(counts), frequent(grams), totals)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rest`` (the other columns as a struct), ``text``, ``lang_pred``, ``score`` and ``told`` (something speaks for it) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # with its code; at most 2 * RAREST rows a language
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    rows = docs.select(rest.alias("rest"), F.col(text).alias("text"))
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(_predicted(shared), f"rest {kind}, text string, lang_pred string, score double, told boolean")


def _third(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string")) % 3


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = LABELLED) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    Learns from rows with a language and a text whose crc32 of the id modulo 3
    is not 1. ``score`` is the share of the likeliest language. Texts that are
    null or hold no letter are ``und`` with score 0, and so is everything where
    no language was learned; ties go to the first language by name. A row with
    a null doc_id is not learned from and not held out. Equal rows get equal
    results. Extra columns are left out, and an empty table gives an empty result.
    """
    model = learn_from(docs, doc_id, text, lang, most)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(_third(doc_id) == 1, F.lit(False)).alias("held_out"),
        F.col(text).alias("text"),
    )
    out = predict(rows.select("doc_id", "held_out", "text"), model)
    return out.select("rest.doc_id", "rest.held_out", "lang_pred", "score")


def learn_from(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = LABELLED) -> Model:
    labelled = docs.where((_third(doc_id) != 1) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    return learn(labelled.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")), most)


def identified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = LABELLED, guesses: bool = True
) -> DataFrame:
    """``docs`` with all its columns, without texts of no language; a null ``lang`` is filled in where it can be told.

    Null texts and those without a letter go. A text without any known word or
    known n-gram of two letters would be a guess: it stays, so that clean texts of
    languages without labels are not lost, but its ``lang`` is not filled in;
    without ``guesses`` it goes too. Where no language was learned nothing is known
    of any text, only null texts and those without a letter go, and ``lang`` is as
    it was. A ``lang`` that is there is never changed. Equal rows get equal results.
    """
    model = learn_from(docs, doc_id, text, lang, most)
    out = predict(docs, model, text)
    out = out.where(F.col("told") | (F.col("lang_pred") != UNKNOWN) if guesses else F.col("told"))
    predicted = F.when(F.col("told") & (F.col("lang_pred") != UNKNOWN), F.col("lang_pred"))
    filled = {lang: F.coalesce(F.col("rest")[lang], predicted)}
    return out.select(*[(F.col("text") if c == text else filled.get(c, F.col("rest")[c])).alias(c) for c in docs.columns])
