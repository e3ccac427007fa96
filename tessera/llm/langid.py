"""Language identification by word-first backoff.

Training counts every word of every labelled text per language (block by block, then a partial
aggregate: a hot language or word is no hot task), and the character n-grams of those words,
weighted by the words' counts. The model keeps

* words with a relative frequency of at least ``MIN_WORD`` in some language, and
* n-grams (1 to ``ORDER`` characters, word ends marked) of at least ``MIN_GRAM`` in some language,

with their log frequency in every language. At most 1 / MIN_WORD words and ORDER / MIN_GRAM n-grams per
language can reach these, whatever the corpus, which bounds what the driver collects and
broadcasts; counting itself covers all words and texts.

A text's score in a language is the sum over its words. A known word scores its log frequency. An
unseen word backs off: the mean log frequency of its longest n-grams, if any of them is known,
otherwise of n-grams one shorter, down to single characters; unknown letters say nothing. The
prediction is the best language, its score the softmax over languages of sum / sqrt(words).

Words are looked up block by block: each distinct word of a block once, then one sum per text.

Defined cases: a null text, or one without letters (numerals such as a half sign are none), is ``und`` with score 0; ties go to the first
language in alphabetic order; without any training text all is ``und``; null languages are not
learned; repeated rows count as often as they occur; whole texts of any length are read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import crc_mod, stage

ORDER = 5
MIN_WORD = 2e-6
MIN_GRAM = 2e-6
#: A word is a run of letters and combining marks (Unicode categories L and M) with a letter in it.
BREAK, LETTER = r"[^\pL\pM]+", r"\pL"
#: Entries of a task's counter, unseen words that a worker remembers, bytes of text looked at together.
HELD = 150_000
CACHE = 300_000
BLOCK = 2 << 20
UND = "und"


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Lower-cased words of texts as (first word of each text and the end, number of each word in the
    dictionary or -1 if it has no letter, dictionary); every text has at least one entry."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), BREAK)
    coded = lists.flatten().dictionary_encode()
    known = pc.match_substring_regex(coded.dictionary, LETTER).to_numpy(zero_copy_only=False)
    ids = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return ends, np.where(known[ids], ids, -1) if len(ids) else ids, coded.dictionary


def words(text: str) -> list[str]:
    _, ids, names = split_words(pa.array([text]))
    return [names[int(i)].as_py() for i in ids if i >= 0]


def blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of blocks of about ``BLOCK`` bytes, a row at least."""
    sizes = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)) + 1
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0.0) + BLOCK, side="right")))
        yield at, to - at
        at = to


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between end marks (single characters: of the word itself)."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _counted(name: str, counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, c in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], ["lang", name, "n"])


def count_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts of a (lang, text) table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in blocks(batch.column(1)):
                part = batch.slice(at, n)
                ends, ids, names = split_words(part.column(1))
                langs = part.column(0).dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(ends))
                pairs, counts = np.unique(lang[ids >= 0].astype(np.int64) * len(names) + ids[ids >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(pairs // max(1, len(names)))), names.take(pa.array(pairs % max(1, len(names)))), pa.array(counts, pa.int64())],
                    ["lang", "word", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def count_grams(word_counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of the words, each as often as its word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = counts[lang]
                # words come in any length: a text without blanks is one word
                for size in range(1, order + 1):
                    for g in grams(word, size):
                        c[g] += n
                if len(c) > HELD:
                    yield from _counted("gram", {lang: counts.pop(lang)})
        yield from _counted("gram", counts)

    return word_counts.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies per language, and the backoff."""

    def __init__(self, langs: list[str], word_table: dict[str, np.ndarray], gram_table: dict[str, np.ndarray]):
        self.langs, self.word_table, self.gram_table = langs, word_table, gram_table
        self.gram_of = {g: i for i, g in enumerate(gram_table)}
        self.gram_rows = np.array(list(gram_table.values())) if gram_table else np.zeros((0, len(langs)))
        self.forget()

    def forget(self) -> None:
        """Start the table of looked-up words anew (its rows are scores by language)."""
        self.row_of = {w: i for i, w in enumerate(self.word_table)}
        self.rows = np.zeros((len(self.row_of) + CACHE, len(self.langs)))
        for w, i in self.row_of.items():
            self.rows[i] = self.word_table[w]

    def unseen(self, names: list[str]) -> np.ndarray:
        """Backed-off scores of words that are not in the model, one row each."""
        find, flat, sizes = self.gram_of.get, [], []
        for word in names:
            found: list[int] = []
            for n in range(min(ORDER, len(word) + 2), 0, -1):
                found = [i for i in map(find, grams(word, n)) if i is not None]
                if found:
                    break
            flat += found
            sizes.append(len(found))
        out, n = np.zeros((len(names), len(self.langs))), np.array(sizes, np.int64)
        some = np.flatnonzero(n)
        if len(some):
            out[some] = np.add.reduceat(self.gram_rows[flat], (np.cumsum(n) - n)[some], axis=0) / n[some, None]
        return out

    def predict_many(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(languages, scores): every distinct word of the texts is looked up once."""
        ends, ids, dictionary = split_words(texts)
        names, row_of = dictionary.to_pylist(), self.row_of
        at = np.fromiter((row_of.get(w, -1) for w in names), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        new = new[np.isin(new, ids)] if len(new) else new  # those with a letter
        table = np.zeros((len(names) + 1, len(self.langs)))  # the last row is that of no word
        table[:-1][at >= 0] = self.rows[at[at >= 0]]
        if len(new):
            table[new] = found = self.unseen([names[i] for i in new])
            if len(row_of) + len(new) > len(self.rows):
                self.forget()
                row_of = self.row_of
            kept = new[: len(self.rows) - len(row_of)]
            self.rows[len(row_of) : len(row_of) + len(kept)] = found[: len(kept)]
            row_of.update(zip([names[i] for i in kept], range(len(row_of), len(row_of) + len(kept))))
        n = np.add.reduceat(ids >= 0, ends[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        total = np.add.reduceat(table[ids], ends[:-1], axis=0) if len(texts) else np.zeros((0, len(self.langs)))
        best = total.argmax(1)
        scaled = np.exp((total - total[np.arange(len(best)), best][:, None]) / np.sqrt(np.maximum(n, 1))[:, None])
        return [self.langs[b] if k else UND for b, k in zip(best.tolist(), n.tolist())], np.where(n > 0, 1 / scaled.sum(1), 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score = self.predict_many(pa.array([text], pa.string()))
        return lang[0], float(score[0])


def _kept(counts: DataFrame, name: str, least: float) -> tuple[dict, pd.DataFrame]:
    """Totals per language, and the entries that some language has often enough, with all its counts."""
    totals = {r.lang: (r.total, r.kinds) for r in counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    rate = F.create_map(*[F.lit(x) for lang, (total, _) in totals.items() for x in (lang, max(2.0, least * total))]) if totals else None
    if rate is None:
        return totals, pd.DataFrame({"key": [], "by": []})
    often = counts.groupBy(F.col(name).alias("key")).agg(F.max(F.col("n") >= rate[F.col("lang")]).alias("often"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    return totals, often.filter("often").select("key", "by").toPandas()


def train(labelled: DataFrame, min_word: float = MIN_WORD, min_gram: float = MIN_GRAM) -> Model:
    """Learn from the rows of a (lang, text) table whose lang and text are not null."""
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null")
    word_counts = stage(count_words(rows), "langid-words")
    gram_counts = stage(count_grams(word_counts).withColumn("size", F.length("gram")), "langid-grams")
    totals, kept = _kept(word_counts, "word", min_word)
    langs = sorted(totals)

    def logs(frame: pd.DataFrame, totals: dict) -> dict[str, np.ndarray]:
        floor = np.array([math.log(0.5 / (totals[x][0] + 1)) if x in totals else -math.inf for x in langs])
        lowest = floor[np.isfinite(floor)].min(initial=-20.0)
        out = {}
        for key, by in zip(frame["key"], frame["by"]):
            v = np.where(np.isfinite(floor), floor, lowest)
            for lang, n in dict(by).items():
                v[langs.index(lang)] = math.log(n / totals[lang][0])
            out[key] = v
        return out

    word_table = logs(kept, totals)
    gram_table: dict[str, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        gram_totals, kept = _kept(gram_counts.filter(F.col("size") == n), "gram", min_gram)
        gram_table |= logs(kept, gram_totals)
    return Model(langs, word_table, gram_table)


_LOADED: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (columns of those names give way)."""
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.word_table, model.gram_table))

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        if token not in _LOADED:
            _LOADED.clear()
            _LOADED[token] = Model(*shared.value)
        langs, scores = [], [np.zeros(0)]
        for at, n in blocks(texts):
            found = _LOADED[token].predict_many(texts.slice(at, n))
            langs += found[0]
            scores.append(found[1])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    both = predict(F.col(text).cast("string"))
    return docs.withColumn(lang, both["lang"]).withColumn(score, both["score"])


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from four fifths of the ids."""
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs.select("lang", "text", held.alias("held")).filter("not held"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
