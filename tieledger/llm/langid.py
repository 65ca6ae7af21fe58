"""Language identification, word first with backing off.

A known word votes with its log frequency in every language.  An unseen word falls back to the longest character
n-grams of it that are known, then to shorter ones, down to single letters.  The votes of all words of the whole text
are added.

A letter is a character of Unicode's category L; number forms such as ``½`` or ``Ⅷ`` are none.

Defined cases: a text that is null or has no letter is ``und`` with score 0; where nothing of a text is known the most
frequent language of the training rows is returned; without training rows every text is ``und``; equal sums go to the
smaller language code; repeated rows are scored alike; input columns named like the new ones are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieledger.llm.batches import in_small_batches
from tieledger.llm.hashing import Lookup, Rolling, runs

#: Longest n-grams first.
ORDERS = (5, 4, 3, 2, 1)
#: Characters looked at together; longer texts are read in parts that end between words.
PART = 1 << 16


@cache
def letters() -> np.ndarray:
    """For every code point whether it is a letter: category L."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about ``PART`` characters, in lower case; no run of letters is cut, however long it is."""
    at, size = 0, PART
    while at < len(text):
        window = text[at : at + size]
        if at + len(window) < len(text):
            others = np.flatnonzero(~letters()[codes_of(window)])
            if not len(others):
                size *= 2  # all letters so far: one word
                continue
            window = window[: int(others[-1]) + 1]
        yield window.lower()
        at, size = at + len(window), PART


def words_of(text: str) -> list[str]:
    out = []
    for part in parts_of(text):
        starts, ends = runs(letters()[codes_of(part)])
        out += [part[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return out


@dataclass
class LangModel:
    """Languages, and for every word or n-gram a row of votes, sparse over the languages.

    The vote of key k for language l is ``base[group of k, l]``, plus the value that ``more`` has for (k, l) where the key was seen in
    that language; group 0 has the words, the others n-grams by length.  What is the same for all languages is left out.
    """

    langs: list[str]
    prior: int
    words: dict[str, int]
    grams: dict[str, int]
    base: np.ndarray
    begins: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    lang_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    more: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def votes(self, key: int, group: int) -> np.ndarray:
        out = self.base[group].astype(float)
        at = slice(self.begins[key], self.begins[key + 1])
        out[self.lang_of[at]] += self.more[at]
        return out


def _counts(what: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for rows in batches:
            for lang, key, n in zip(rows["lang"], rows["key"], rows["n"], strict=True):
                held = seen.setdefault(lang, Counter())
                if what == "words":
                    held.update(words_of(key))
                else:
                    padded = f" {key} "
                    for order in ORDERS:
                        for i in range(len(padded) - order + 1):
                            held[padded[i : i + order]] += n
            if sum(map(len, seen.values())) > 200_000:
                yield from _frames(seen)
                seen = {}
        yield from _frames(seen)

    return run


def _frames(seen: dict[str, Counter]) -> Iterator[pd.DataFrame]:
    for lang, held in seen.items():
        items = list(held.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pd.DataFrame({"lang": lang, "key": [k for k, _ in part], "n": [n for _, n in part]})


def fit(labelled: DataFrame, max_docs_per_lang: int = 2500, max_words: int = 40_000, max_grams: int = 60_000, least_keys: int = 500) -> LangModel:
    """Fit on rows (text, lang), both not null; every language of the rows is learnt.

    The counting is a Spark job over a bounded sample of the labelled rows: about ``max_docs_per_lang`` for each
    language, chosen by a hash of the text, so that rare languages are there in full.  Languages share ``max_words`` and
    ``max_grams`` keys, but each has ``least_keys`` of either, so what reaches the driver is bounded by them and by the number
    of languages.
    """
    labelled = in_small_batches(labelled).select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LangModel([], 0, {}, {}, np.zeros((len(ORDERS) + 1, 0)))
    keep = F.create_map(*[F.lit(x) for k in langs for x in (k, int(2**31 * min(1.0, max_docs_per_lang / sizes[k])))])
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(2**31)) < keep[F.col("lang")])
    schema = "lang string, key string, n long"
    total = lambda df: df.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    words = total(sample.select("lang", F.col("text").alias("key"), F.lit(1).alias("n")).mapInPandas(_counts("words"), schema)).persist()
    grams = total(words.mapInPandas(_counts("grams"), schema)).withColumn("o", F.length("key"))

    def top(df: DataFrame, most: int, by: list[str]) -> tuple[list, dict]:
        per = max(most // len(langs), least_keys) // (len(ORDERS) if len(by) > 1 else 1)
        order = Window.partitionBy(*by).orderBy(F.desc("n"), "key")
        keys = df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per).select("key").distinct()
        sums = df.groupBy(*by).agg(F.sum("n").alias("all")).collect()
        return df.join(keys, "key").select("key", "lang", "n").collect(), {(r["o"] if len(by) > 1 else 0, r["lang"]): r["all"] for r in sums}

    (word_rows, word_sums), (gram_rows, gram_sums) = top(words, max_words, ["lang"]), top(grams, max_grams, ["lang", "o"])
    words.unpersist()
    number = {k: i for i, k in enumerate(langs)}
    alls = np.zeros((len(ORDERS) + 1, len(langs)))
    for (group, lang), n in [*word_sums.items(), *gram_sums.items()]:
        alls[group, number[lang]] = n
    ids: list[dict[str, int]] = []
    begins, lang_of, more = [0], [], []
    for rows in (word_rows, gram_rows):
        seen: dict[str, list[tuple[int, int]]] = {}
        for r in rows:
            seen.setdefault(r["key"], []).append((number[r["lang"]], r["n"]))
        first = len(begins) - 1
        ids.append({key: first + i for i, key in enumerate(sorted(seen))})
        for key in sorted(seen):
            lang_of += [k for k, _ in sorted(seen[key])]
            more += [np.log((n + 0.5) / 0.5) for _, n in sorted(seen[key])]
            begins.append(len(more))
    prior = max(range(len(langs)), key=lambda i: (sizes[langs[i]], -i))
    return LangModel(langs, prior, *ids, np.log(0.5 / (alls + 1.0)), np.array(begins, np.int64), np.array(lang_of, np.int32), np.array(more, np.float32))


class Scorer:
    """Scores texts, many at a time, with arrays over all their letters."""

    def __init__(self, model: LangModel):
        self.langs, self.prior, self.base = model.langs, model.prior, model.base
        self.begins, self.lang_of, self.more = model.begins, model.lang_of, model.more
        self.words = self._table(model.words)
        self.grams = {n: self._table({g: i for g, i in model.grams.items() if len(g) == n}) for n in ORDERS}

    @staticmethod
    def _table(ids: dict[str, int]) -> tuple[Lookup, np.ndarray]:
        ends = np.cumsum([len(k) for k in ids]).astype(np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])[: len(ends)]
        return Lookup(Rolling(codes_of("".join(ids))).spans(starts, ends)), np.array(list(ids.values()), np.int64)

    def parts(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
        """Numbers of texts and the parts of them that are scored together."""
        of, own, size = [], [], 0
        for i, text in enumerate(texts):
            for part in parts_of(text or ""):
                of.append(i)
                own.append(part)
                size += len(part)
                if size >= PART:
                    yield of, own
                    of, own, size = [], [], 0
        if own:
            yield of, own

    def _add(self, sums: np.ndarray, group: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray) -> None:
        """Adds the votes of keys, each with its weight, to the sums of their texts."""
        n, k = sums.shape
        sums += np.bincount(doc, weight, n)[:, None] * self.base[group]
        each = self.begins[key + 1] - self.begins[key]
        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.begins[key], each)
        cells = np.repeat(doc, each) * k + self.lang_of[at]
        sums += np.bincount(cells, self.more[at] * np.repeat(weight, each), n * k).reshape(n, k)

    def votes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For every text the sums of its votes, and its number of words."""
        sums, n_words = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for of, own in self.parts(texts):
            codes = codes_of(" " + " ".join(own) + " ")
            inside = letters()[codes]
            starts, ends = runs(inside)
            if not len(starts):
                continue
            lo, hi = of[0], of[-1] + 1
            text_starts = np.cumsum([1] + [len(t) + 1 for t in own[:-1]])
            doc = np.asarray(of)[np.searchsorted(text_starts, starts, side="right") - 1] - lo
            part = np.zeros((hi - lo, len(self.langs)))
            n_words[lo:hi] += np.bincount(doc, minlength=hi - lo)
            rolling = Rolling(np.where(inside, codes, 32))
            lookup, ids = self.words
            at = lookup.find(rolling.spans(starts, ends))
            known = at >= 0
            self._add(part, 0, doc[known], ids[at[known]], np.ones(int(known.sum())))
            left = np.flatnonzero(~known)
            for order in ORDERS:
                lookup, ids = self.grams[order]
                if not len(left) or not len(ids):
                    continue
                each = np.maximum(0, ends[left] - starts[left] + 3 - order)
                word = np.repeat(np.arange(len(left)), each)
                begin = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + starts[left][word] - 1
                at = lookup.find(rolling.spans(begin, begin + order))
                hit = at >= 0
                word = word[hit]
                n = np.bincount(word, minlength=len(left))
                self._add(part, order, doc[left][word], ids[at[hit]], 1 / n[word])
                left = left[n == 0]
            sums[lo:hi] += part
        return sums, n_words

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        langs, prior = self.langs, self.prior
        if not langs:
            return [("und", 0.0)] * len(texts)
        sums, n_words = self.votes(texts)
        best = np.where(sums.max(axis=1) == sums.min(axis=1), prior, sums.argmax(axis=1)) if len(langs) > 1 else np.zeros(len(texts), np.int64)
        share = 1 / np.exp(np.clip(sums - np.take_along_axis(sums, best[:, None], 1), -700, 0)).sum(axis=1)
        return [(langs[b], float(s)) if n else ("und", 0.0) for b, s, n in zip(best, share, n_words, strict=True)]


def identify(df: DataFrame, model: LangModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` with the predicted language of every whole text and its share of the votes, from 0 to 1."""
    scorer_of = df.sparkSession.sparkContext.broadcast(Scorer(model))

    @F.pandas_udf("struct<lang:string,score:double>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of.value
        for texts in batches:
            yield pd.DataFrame(scorer.score(list(texts)), columns=["lang", "score"])

    # held to be random, so that a filter on the result does not score all texts once more
    out = in_small_batches(df).withColumn("__scored", scored.asNondeterministic()(F.col(f"`{text}`")))
    return out.withColumn(lang_pred, F.col("__scored.lang")).withColumn(score, F.col("__scored.score")).drop("__scored")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
