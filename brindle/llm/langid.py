"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public subword vocabulary. Each language has a probability for
each piece; a word's probability is the sum over all its segmentations into pieces (forward
algorithm), and a text's is the product over its words. Piece probabilities are fitted by
expectation-maximisation on the word counts of a bounded sample of labelled texts.

Bounds, all on what is learned from: about SAMPLE distinct texts of each language, the MOST_LANGS
languages with the most texts, words of at most TRAIN_LETTERS letters. Scoring knows no bound:
the sum runs over the segmentations of whole words, however long, into pieces of any length.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ship

#: About so many distinct labelled texts of each language are learned from, chosen by a hash of the text.
SAMPLE = 300
#: So many languages at most are learned, those with the most distinct texts, then by name (each costs memory in every worker).
MOST_LANGS = 500
#: Longer words teach nothing.
TRAIN_LETTERS = 40
ROUNDS = 3
SMOOTH = 0.02
CACHE = 200_000
#: Words of more letters are summed one by one, with rescaling, and not cached.
LONG = 60
#: Letters with the marks that follow them; numbers are no letters.
_LETTERS = regex.compile(r"(?:\p{L}\p{M}*)+")
START = "▁"

_models: dict[str, "Model"] = {}


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _LETTERS.findall(text.lower())


def vocabulary(path: str) -> set[str]:
    """The pieces of a sentencepiece file that consist of letters, with or without the word start, in lower case as all text is."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()))
    return {p for p in pieces if p != START and _LETTERS.fullmatch(p.removeprefix(START))}


def longest(pieces) -> int:
    return max(map(len, pieces), default=1)


class Lattice:
    """All segmentations of words of one length: for each span the table row of its piece, by word.

    Row 0 is no piece (probability 0), row 1 a letter without a piece.
    """

    def __init__(self, words: list[str], index: dict[str, int], most: int):
        strings = [START + w for w in words]
        self.size, self.n = len(strings[0]), len(words)
        self.spans: dict[tuple[int, int], np.ndarray] = {}
        get = index.get
        for a in range(self.size):
            for b in range(a + 1, min(self.size, a + most) + 1):
                none = 1 if b == a + 1 else 0
                rows = np.asarray([get(s[a:b], none) for s in strings])
                if rows.any():
                    self.spans[a, b] = rows

    def forward(self, table: np.ndarray) -> np.ndarray:
        alpha = np.zeros((self.size + 1, self.n, table.shape[1]))
        alpha[0] = 1
        for (a, b), rows in sorted(self.spans.items(), key=lambda x: x[0][1]):
            alpha[b] += alpha[a] * table[rows]
        return alpha

    def expect(self, table: np.ndarray, count: np.ndarray, gain: np.ndarray) -> None:
        """Add the expected counts of each table row (forward-backward)."""
        alpha = self.forward(table)
        beta = np.zeros_like(alpha)
        beta[-1] = 1
        for (a, b), rows in sorted(self.spans.items(), key=lambda x: -x[0][0]):
            beta[a] += beta[b] * table[rows]
        z = alpha[-1]
        w = np.divide(count, z, out=np.zeros_like(z), where=z > 0)
        for (a, b), rows in self.spans.items():
            part = alpha[a] * table[rows] * beta[b] * w
            for k in range(table.shape[1]):
                gain[:, k] += np.bincount(rows, part[:, k], len(gain))


def lattices(words: list[str], index: dict[str, int], most: int) -> Iterator[tuple[list[int], Lattice]]:
    by: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w)].append(i)
    for at in by.values():
        yield at, Lattice([words[i] for i in at], index, most)


class Model:
    """langs, the row of each piece, and the table of probabilities (row by language)."""

    def __init__(self, langs: list[str], index: dict[str, int], table: np.ndarray):
        self.langs, self.index, self.table = langs, index, table
        self.most = longest(index)
        self.cache: dict[str, int] = {}
        self.rows = np.empty((0, len(langs)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word by language, summed over all segmentations."""
        out = np.zeros((len(words), len(self.langs)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for at, lattice in lattices([words[i] for i in short], self.index, self.most):
            out[[short[i] for i in at]] = np.log(np.maximum(lattice.forward(self.table)[-1], 1e-300))
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.forward_long(w)
        return out

    def forward_long(self, word: str) -> np.ndarray:
        """As forward() of one word of any length: only the last `most` sums are held, rescaled at each letter."""
        s, most, get = START + word, self.most, self.index.get
        alpha = np.zeros((most, len(self.langs)))  # alpha[j]: the sum up to `most - j` letters back
        alpha[-1] = 1
        log = np.zeros(len(self.langs))
        for b in range(1, len(s) + 1):
            first = max(0, b - most)
            rows = [get(s[a:b], 0) for a in range(first, b - 1)] + [get(s[b - 1], 1)]
            z = (alpha[most - len(rows) :] * self.table[rows]).sum(axis=0)
            scale = np.maximum(z, 1e-300)
            log += np.log(scale)
            alpha[:-1] = alpha[1:] / scale
            alpha[-1] = z / scale
        return log

    def word_rows(self, words: list[str]) -> np.ndarray:
        if any(len(w) > LONG for w in words):
            out = np.empty((len(words), len(self.langs)))
            for long in (True, False):
                at = [i for i, w in enumerate(words) if (len(w) > LONG) is long]
                if at:
                    some = [words[i] for i in at]
                    out[at] = self.forward(some) if long else self.word_rows(some)
            return out
        cache = self.cache
        new = [w for w in words if w not in cache]
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                self.rows, new = np.empty((0, len(self.langs))), words
            base = len(cache)
            if base + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:base], np.empty((base + 2 * len(new), len(self.langs)))])
            self.rows[base : base + len(new)] = self.forward(new)
            for i, w in enumerate(new):
                cache[w] = base + i
        return self.rows[[cache[w] for w in words]]

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """For each text (language, its posterior probability under equal priors); und and 0 without letters."""
        counts = [Counter(words_of(t)) if isinstance(t, str) else Counter() for t in texts]
        out = []
        for at in range(0, len(counts), 64):
            some = counts[at : at + 64]
            words = list(set().union(*some))
            rows = self.word_rows(words) if words and self.langs else np.empty((0, len(self.langs)))
            place = {w: i for i, w in enumerate(words)}
            for c in some:
                if not c or not self.langs:
                    out.append(("und", 0.0))
                    continue
                logs = np.fromiter(c.values(), float, len(c)) @ rows[[place[w] for w in c]]
                p = np.exp(logs - logs.max())
                i = int(np.argmax(p))
                out.append((self.langs[i], float(p[i] / p.sum())))
        return out


def fit(counts: dict[str, dict[str, int]], pieces: set[str], rounds: int = ROUNDS) -> Model:
    """EM over word counts by language; ties between languages go to the first by name."""
    langs = sorted(counts)
    most = longest(pieces)
    whole = {lang: Counter({w: c for w, c in counts[lang].items() if len(w) <= TRAIN_LETTERS}) for lang in langs}
    words = sorted(set().union(*whole.values()))
    number = np.asarray([[whole[lang][w] for lang in langs] for w in words], float).reshape(len(words), len(langs))
    used = sorted({s[a:b] for s in (START + w for w in words) for a in range(len(s)) for b in range(a + 1, min(len(s), a + most) + 1)} & pieces)
    index = {p: i + 2 for i, p in enumerate(used)}
    table = np.full((len(used) + 2, len(langs)), 1.0 / (len(used) + 1))
    table[0] = 0
    made = list(lattices(words, index, longest(index)))
    for _ in range(rounds):
        gain = np.zeros_like(table)
        for at, lattice in made:
            lattice.expect(table, number[at], gain)
        gain[1:] += SMOOTH
        gain[0] = 0
        table = gain / gain.sum(axis=0)
    return Model(langs, index, table)


def train(labelled: DataFrame, vocabulary_path: str, sample: int = SAMPLE) -> Model:
    """A model of the languages in labelled (text, lang); rows without a label or text teach nothing, copies of a text teach once."""
    spark = labelled.sparkSession
    ship(spark)
    d = labelled.where("lang is not null and text is not null").select("text", "lang")
    near = F.approx_count_distinct(F.xxhash64("text"))
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(near.alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()}
    if not sizes:
        return Model([], {}, np.zeros((2, 0)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample / n))])
    u = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0
    chosen = d.where(u < share[F.col("lang")])
    # copies of a text teach once; partial sums keep one of each before the shuffle
    chosen = chosen.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = Counter((lang, w) for text, lang in zip(pdf["text"], pdf["lang"], strict=True) for w in words_of(text))
            yield pd.DataFrame([(a, b, n) for (a, b), n in c.items()], columns=["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    # bounded by the sample
    for r in chosen.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    return fit(counts, vocabulary(vocabulary_path))


def predict(docs: DataFrame, model: Model, keep: list) -> DataFrame:
    """keep, lang_pred, score for every row of docs; only the text is looked at.

    Null texts and texts without letters are und with score 0; whole texts are summed, however
    long; ties go to the first language by name; repeated rows get the same answer; an empty table
    gives an empty result; a model without languages answers und.
    """
    spark = docs.sparkSession
    ship(spark)
    given = spark.sparkContext.broadcast((model.langs, model.index, model.table))  # bounded by vocabulary and MOST_LANGS
    token = uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        m = _models.get(token)
        if m is None:
            _models.clear()
            m = _models[token] = Model(*given.value)
        return pd.DataFrame(m.score(list(text)), columns=["lang_pred", "score"])

    d = docs.select(*keep, run(F.col("text")).alias("__p"))
    return d.select(*d.columns[:-1], "__p.lang_pred", "__p.score")


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from documents whose crc32(doc_id) mod 4 is not 2."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held = F.coalesce(part == 2, F.lit(False))
    model = train(docs.where(part != 2), vocabulary_path)
    return predict(docs, model, ["doc_id", held.alias("held_out")])
