"""Language identification: known words first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Shared, few, free, own_columns, place

ROWS_PER_LANGUAGE = 1_000
LONGEST_GRAM = 5
CACHE_WORDS = 250_000
UNKNOWN = "und"

RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    return RUNS.findall(text.lower())


def grams_of(word: str, k: int) -> list[str]:
    """Character n-grams of a word; those of two or more may hold the blank before or after it."""
    padded = f" {word} " if k > 1 else word
    return [padded[i:i + k] for i in range(len(padded) - k + 1)]


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """(lang, text) of at most ``rows`` rows per language, those whose id and text have the smallest hash.

    The languages are counted first. A row is then a candidate if its hash lies in the share of all hashes that is to
    hold four times ``rows``, so the tasks that order the candidates see a few thousand rows however many there are.
    """
    sizes = few(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_size")))
    near = labelled.withColumn("_h", place("doc_id", "text")).join(sizes, "lang")
    order = Window.partitionBy("lang").orderBy("_h", F.xxhash64("text"))
    return near.where(F.col("_h") < 4 * rows / F.col("_size")).withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= rows).select("lang", "text")


def train(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> dict:
    """The model from (doc_id, text, lang): counts per language of words and of 1- to 5-grams of distinct words.

    At most ``rows`` labelled rows per language are read, which bounds the model; nothing that they hold is left out.
    It comes as langs and, for each length of gram (0: words), the grams and a matrix of their counts.
    """
    fine = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def counts(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang").text:
                words = Counter(w for t in texts for w in letter_runs(t) if any(c.isalpha() for c in w))
                found = Counter()
                for w, n in words.items():
                    found[0, w] += n
                    for k in range(1, LONGEST_GRAM + 1):
                        for g in grams_of(w, k):
                            found[k, g] += n
                yield pd.DataFrame({"lang": lang, "kind": [k for k, _ in found], "gram": [g for _, g in found],
                                    "n": list(found.values())})

    each = sample(fine, rows).mapInPandas(counts, "lang string, kind int, gram string, n long").groupBy(
        "kind", "gram", "lang").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(each.column("lang").to_pylist()))
    kinds = []
    for kind in range(LONGEST_GRAM + 1):
        own = each.filter(pc.equal(each.column("kind"), kind))
        gram = own.column("gram").combine_chunks().dictionary_encode()
        table = np.zeros((len(gram.dictionary), len(langs)))
        place_of = pc.index_in(own.column("lang").combine_chunks(), pa.array(langs, pa.string())).to_numpy(zero_copy_only=False)
        table[gram.indices.to_numpy(), place_of] = own.column("n").to_numpy()
        kinds.append(("\n".join(gram.dictionary.to_pylist()), table))  # grams hold no line feed
    return {"langs": langs, "kinds": kinds}


class Scorer:
    """Log-probabilities per language: of a known word its own, of another those of its longest known n-grams."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.place: list[dict[str, int]] = []
        self.tables: list[np.ndarray] = []
        for grams, counts in model["kinds"]:
            names = grams.split("\n") if len(counts) else []
            self.place.append({g: i for i, g in enumerate(names)})
            table = counts + 0.5
            self.tables.append(np.log(table / table.sum(0, keepdims=True)) if len(names) else table)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)))

    def of_word(self, word: str) -> np.ndarray | None:
        if not any(c.isalpha() for c in word):
            return None
        if (found := self.place[0].get(word)) is not None:
            return self.tables[0][found]
        for k in range(LONGEST_GRAM, 0, -1):
            place = self.place[k]
            found = [at for g in grams_of(word, k) if (at := place.get(g)) is not None]
            if found:
                return self.tables[k][found].mean(axis=0)
        return np.zeros(len(self.langs))

    def _place(self, word: str) -> int:
        score = self.of_word(word)
        if score is None:
            at = self.known[word] = -1
            return at
        at = self.known[word] = self.used = getattr(self, "used", -1) + 1
        if at >= len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
        self.scores[at] = score
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        """The best language and its share of the probability; ties go to the first by name."""
        words = Counter(letter_runs(text)) if text else None
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.used = -1
        known = self.known
        at = np.fromiter((known[w] if w in known else self._place(w) for w in words), dtype=np.int64, count=len(words))
        n = np.fromiter(words.values(), dtype=np.float64, count=len(words))
        n, at = n[at >= 0], at[at >= 0]
        if not len(at):
            return UNKNOWN, 0.0
        total = n @ self.scores[at]
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return self.langs[best], float(share[best] / share.sum())


def predicted(df: DataFrame, labelled: DataFrame, into: str, text: str = "text", rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Adds ``into``, a struct of lang_pred and score; see ``identify``."""
    model = Shared(df.sparkSession, "languages", train(labelled, rows), Scorer)

    @F.pandas_udf("lang_pred string, score double")
    def predict(column: pd.Series) -> pd.DataFrame:
        score = model.get()
        return pd.DataFrame([score(t) for t in column], columns=["lang_pred", "score"])

    return df.withColumn(into, predict(F.col(f"`{text}`")))


def identify(df: DataFrame, labelled: DataFrame, text: str = "text", rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (its share of the posterior with equal priors, 0 to 1) to every row of ``df``.

    Learns from ``labelled`` (doc_id, text, lang); rows of it with a null text or lang are passed over. A null text and
    one without a letter give ``und`` and 0, as does everything if nothing could be learned. A text in which no word
    and no n-gram is known gives the first language by name with an equal share. Texts are read whole, however long;
    repeated rows come back as often as given, with the same result. Columns lang_pred and score of the input are
    replaced, all others come back as they are. Empty tables give empty results.
    """
    into, = free(df, "l")
    return predicted(df, labelled, into, text, rows).select(*own_columns(df, "lang_pred", "score"), f"{into}.*")


def held_out() -> Column:
    """Documents that training never sees: crc32 of the id's text leaves 2 when divided by 4; so are those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def predicted_documents(docs: DataFrame) -> DataFrame:
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), labelled).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame) -> DataFrame:
    """Documents with a letter, their columns unchanged. The model has no class for what is no language, so it never
    rejects such a document: a low score, as of a few unknown words, means that the languages are equally likely.
    Null and empty texts have no letter and go; repeated rows share their fate."""
    labelled = docs.where(~held_out()).select("doc_id", "text", "lang")
    into, = free(docs, "l")
    found = predicted(docs, labelled, into)
    return found.where((F.col(f"{into}.lang_pred") != UNKNOWN) | F.col("text").rlike(r"\p{L}")).select(*own_columns(docs))
