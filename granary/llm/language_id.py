"""Language identification: word frequencies first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import free_name, windows

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
UNKNOWN = "und"


def words_of(text: str) -> Iterator[list[str]]:
    for piece in windows(text):
        yield WORD.findall(piece.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with marks at its ends; single letters go without them."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _numbered(items: Iterator[str]) -> tuple[dict[str, int], np.ndarray]:
    """A number for each item in order of first sight, and the numbers of all items."""
    known: dict[str, int] = {}
    return known, np.fromiter((known.setdefault(x, len(known)) for x in items), np.int64)


@dataclass
class LanguageModel:
    """Log frequencies by language: rows of `logs` for words and, after them, for n-grams of each length."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    logs: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]], alpha: float = 0.5) -> LanguageModel:
        """From rows (lang, word, count)."""
        langs = sorted({lang for lang, _, _ in counts})
        place = {lang: k for k, lang in enumerate(langs)}
        lang = np.array([place[x] for x, _, _ in counts], np.int64)
        n = np.array([c for _, _, c in counts], np.float64)
        words, number = _numbered(w for _, w, _ in counts)
        tables = [cls._logs(number, lang, n, len(words), len(langs), alpha)]
        joined: dict[str, int] = {}
        for size in range(1, LONGEST + 1):
            known, number = _numbered(g for _, w, _ in counts for g in grams(w, size))
            lengths = [len(grams(w, size)) for _, w, _ in counts]
            tables.append(cls._logs(number, np.repeat(lang, lengths), np.repeat(n, lengths), len(known), len(langs), alpha))
            at = len(words) + sum(len(t) for t in tables[1:-1])
            joined |= {g: at + k for g, k in known.items()}
        return cls(langs, words, joined, np.concatenate(tables))

    @staticmethod
    def _logs(row: np.ndarray, lang: np.ndarray, n: np.ndarray, rows: int, langs: int, alpha: float) -> np.ndarray:
        x = np.bincount(row * langs + lang, n, rows * langs).reshape(rows, langs) + alpha
        return np.log(x / x.sum(axis=0)).astype(np.float32) if rows else np.zeros((0, langs), np.float32)

    def parts(self, word: str) -> list[int]:
        """The row of a word, or the rows of what n-grams it has: at each place that of the longest one known."""
        if (known := self.words.get(word)) is not None:
            return [known]
        marked, found, at = f"<{word}>", [], 0
        while at < len(marked):
            for size in range(min(LONGEST, len(marked) - at), 0, -1):
                if (g := self.grams.get(marked[at : at + size])) is not None:
                    found.append(g)
                    at += size
                    break
            else:
                at += 1
        return found

    def scores(self, words: list[str]) -> np.ndarray:
        """For each word its log frequencies, or the mean of those of its n-grams; zeros where it has none."""
        parts = [self.parts(w) for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = self.logs[[k for p in parts for k in p]]
        out = np.zeros((len(words), len(self.langs)), np.float32)
        some = sizes > 0
        if some.any():
            out[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0) / sizes[some][:, None]
        return out


class Predictor:
    """Scores whole texts; remembers the words that it has met, `most` of them at once."""

    def __init__(self, model: LanguageModel, most: int = 200_000):
        self.model, self.most = model, most
        self.forget()

    def forget(self) -> None:
        """A row for each word met: its scores by language, and 1 if it has a letter (other numerals are no evidence)."""
        self.place, self.table, self.used = {}, np.zeros((4096, len(self.model.langs) + 1), np.float32), 0

    def _meet(self, words: list[str]) -> None:
        end = self.used + len(words)
        if end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(end, 2 * len(self.table)) - len(self.table), self.table.shape[1]), np.float32)])
        self.place |= {w: k for k, w in enumerate(words, self.used)}
        self.table[self.used : end, :-1] = self.model.scores(words)
        self.table[self.used : end, -1] = [w.isalpha() or any(map(str.isalpha, w)) for w in words]
        self.used = end

    def predict(self, text: str | None) -> tuple[str, float]:
        total = np.zeros(len(self.model.langs) + 1)
        for words in words_of(text or ""):
            new = [w for w in set(words) if w not in self.place]
            if self.used + len(new) > self.most:
                self.forget()
                new = list(set(words))
            if new:
                self._meet(new)
            if words:
                total += self.table[list(map(self.place.__getitem__, words))].sum(axis=0, dtype=np.float64)
        n, total = total[-1], total[:-1]
        if not n or not self.model.langs:
            return UNKNOWN, 0.0
        x = np.exp((total - total.max()) / np.sqrt(n))
        best = int(np.argmax(total))
        return self.model.langs[best], float(x[best] / x.sum())


def fit_languages(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 2_000) -> LanguageModel:
    """Model from the labelled rows: null languages do not count.

    Its languages are those of all labelled rows with a word. max_docs bounds the sample, in equal parts by language; what
    languages of few rows leave of theirs goes to the others. Of a language with more rows than its part, those stay
    whose hashed id lies below the share that gives the part on average. All words of these rows, of all their text,
    are the model's, and give its n-grams; their counts, and one for each language, come to the driver. Repeated rows
    count as often as they occur; an empty table gives a model that knows no language.
    """
    rows = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    held = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not held:
        return LanguageModel.fit([])
    drawn = parts(held, max_docs)
    of = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("lang")]
    bounds = {k: int(min(1.0, drawn[k] / n) * (1 << 40)) for k, n in held.items()}
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40)) < of(bounds)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for words in words_of(text or ""):
                    found.update((lang, w) for w in words)
                if len(found) > 200_000:
                    yield pd.DataFrame([(*k, v) for k, v in found.items()], columns=["lang", "word", "n"])
                    found.clear()
        yield pd.DataFrame([(*k, v) for k, v in found.items()], columns=["lang", "word", "n"])

    counts = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return LanguageModel.fit(sorted(zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True)))


def parts(held: dict[str, int], most: int) -> dict[str, int]:
    """most dealt to the keys in equal parts, none more than it holds and, where it holds any, none less than one."""
    out, left = {}, most
    for k, n in enumerate(sorted(held, key=lambda x: (held[x], x))):
        out[n] = min(held[n], max(1, left // (len(held) - k)))
        left -= out[n]
    return out


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced).

    lang_pred: the language whose words make the whole text likeliest (ties: the first by name); `und` with score 0
    where text is null or has no letter, or where the model has no language. score: its share of the likelihoods,
    each tempered by the root of the number of words. Repeated rows get equal answers, an empty table gives an empty
    result, and very long texts are read piece by piece. The model, whose size is bounded, is sent to the executors;
    nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(sent.value)
        for texts in batches:
            yield pd.DataFrame([predictor.predict(t) for t in texts], columns=["lang", "score"])

    got: Column = predict(F.col(text_col).cast("string"))
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = free_name(docs, "_language_")
    return docs.select(*kept, got.alias(found)).select(*kept, F.col(f"{found}.lang").alias("lang_pred"), F.col(f"{found}.score").alias("score"))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, which are those to which a model of any language gives one."""

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([any(c.isalpha() for words in words_of(t or "") for w in words for c in w) for t in texts], dtype=bool)

    return docs.filter(lettered(F.col(text_col).cast("string")))
