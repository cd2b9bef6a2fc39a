"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for each piece of the vocabulary, learned by expectation maximisation (the expected
count of a piece over all segmentations of the words) from a bounded sample of labelled documents: about SAMPLE_DOCS a
language, chosen by a hash of the id. The sample's bound is the parameter; prediction reads every whole text. A text is
lower-cased and read as its runs of letters. Pieces never cross words, so the forward algorithm, which sums over all
segmentations of a word, runs once for each different word of a task, and a text's likelihood is the product over
its words. Letters outside the vocabulary cost every language the same.

The score is the posterior of the predicted language among the learned ones, at equal priors. Ties go to the first
language by name. Null text and text without a letter are `und` with score 0, as is everything if no labelled row can
be learned from. Rows with a null label or a null id are predicted but never learned from. Repeated rows give repeated
rows; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import counted

SAMPLE_DOCS = 250
ROUNDS = 3
#: Count that each piece has before any text is read.
PRIOR = 0.02
#: Probability of a letter that is in no piece.
UNKNOWN = 1e-8
WORDS = re.compile(r"[^\W\d_]+")
#: Words whose likelihoods a worker remembers, and those that it computes together.
CACHE, TOGETHER = 150_000, 10_000
#: Likelihoods are scaled up by this before they leave the range of doubles.
SMALL = 1e-200
#: Words that are too short to.
SHORT = 20


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, int], frozenset[str]]:
    """Pieces by number (lower-case text only), and all that pieces begin with."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    known = {p: k for k, p in enumerate(sorted({p for p in pieces if p == p.lower()}))}
    return known, frozenset(p[:n] for p in known for n in range(1, len(p) + 1))


def arcs(word: str, pieces: dict[str, int], begins: frozenset[str]) -> list[tuple[int, int, int]]:
    """(from, to, piece) of each piece in a word, by its start; -1 for a letter that no piece has."""
    text = "▁" + word
    found, n = [], len(text)
    for i in range(n):
        if text[i] not in pieces:
            found.append((i, i + 1, -1))
        for j in range(i + 1, n + 1):
            part = text[i:j]
            if part not in begins:
                break
            if part in pieces:
                found.append((i, j, pieces[part]))
    return found


def forward(lattice: list[tuple[int, int, int]], n: int, p: list[float]) -> tuple[list[float], float]:
    """The summed probability of all segmentations up to each place, and the log of what it was scaled by."""
    alpha, scale = [1.0] + [0.0] * n, 0.0
    if n <= SHORT:
        for i, j, k in lattice:
            alpha[j] += alpha[i] * p[k]
        return alpha, scale
    for i, j, k in lattice:
        if 0.0 < alpha[i] < SMALL:
            alpha = [x / SMALL for x in alpha]
            scale += math.log(SMALL)
        alpha[j] += alpha[i] * p[k]
    return alpha, scale


def expected(lattice: list[tuple[int, int, int]], n: int, p: list[float], weight: float, counts: list[float]) -> None:
    """Adds each piece's expected count over all segmentations; of words too long for doubles, by logarithms."""
    alpha, scale = forward(lattice, n, p)
    if scale or alpha[n] < SMALL:
        return expected_by_logs(lattice, n, p, weight, counts)
    beta = [0.0] * n + [1.0]
    for i, j, k in reversed(lattice):
        x = p[k] * beta[j]
        counts[k] += weight * alpha[i] * x / alpha[n]
        beta[i] += x


def expected_by_logs(lattice: list[tuple[int, int, int]], n: int, p: list[float], weight: float, counts: list[float]) -> None:
    """What expected() does, for words of any length."""

    def plus(x: float, y: float) -> float:
        low, high = min(x, y), max(x, y)
        return high if low == -math.inf else high + math.log1p(math.exp(low - high))

    logs = [math.log(x) for x in p]
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, j, k in lattice:
        alpha[j] = plus(alpha[j], alpha[i] + logs[k])
    for i, j, k in reversed(lattice):
        counts[k] += weight * math.exp(min(0.0, alpha[i] + logs[k] + beta[j] - alpha[n]))
        beta[i] = plus(beta[i], logs[k] + beta[j])


def learn(words: dict[str, int], path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language; the last is an unknown letter's."""
    pieces, begins = vocabulary(path)
    p = [1.0 / len(pieces)] * len(pieces) + [UNKNOWN]
    for _ in range(rounds):
        counts = [PRIOR] * len(pieces) + [0.0]
        for word, weight in sorted(words.items()):
            expected(arcs(word, pieces, begins), len(word) + 1, p, weight, counts)
        total = sum(counts[:-1])
        p = [c / total for c in counts[:-1]] + [UNKNOWN]
    return np.array(p)


class Pieces:
    """The vocabulary for many words at once: substrings are found by a hash that grows by a letter at a time."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: dict[str, int]):
        hashes = np.array([self.of(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], np.array(list(pieces.values()))[order]
        assert len(np.unique(self.hashes)) == len(pieces)
        self.longest = max(map(len, pieces))

    def of(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % (1 << 64)
        return h

    def find(self, h: np.ndarray, missing: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], missing)

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-likelihoods of words of one length. p: a row for each piece, then one of zeros and one for unknown letters."""
        letters = np.frombuffer("".join(f"▁{w}" for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        n, zero = letters.shape[1], len(p) - 2
        alpha = np.zeros((n + 1, len(words), p.shape[1]))
        alpha[0] = 1.0
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * self.BASE + letters[:, j - 1]
                k = self.find(h, zero)
                if j == i + 1:
                    k = np.where(k == zero, zero + 1, k)
                elif not (k != zero).any() and j > i + 4:
                    continue
                alpha[j] += alpha[i] * p[k]
        return np.log(alpha[n])


class Scorer:
    """Log-likelihoods of words in each language, remembered by word."""

    def __init__(self, tables: list[list[float]], path: str):
        self.tables, (self.known, self.begins) = tables, vocabulary(path)
        self.pieces = Pieces(self.known)
        p = np.array(tables).T
        self.p = np.vstack([p[:-1], np.zeros((1, len(tables))), p[-1:]])
        self.rows: dict[str, int] = {}
        self.logs = np.empty((0, len(tables)))

    def learn(self, words: list[str]) -> None:
        """Adds the words that are not remembered: those of a length together, the long ones one by one, with scaling."""
        if len(self.rows) > CACHE:
            self.rows.clear()
        new: dict[int, list[str]] = {}
        for w in dict.fromkeys(words):
            if w not in self.rows:
                new.setdefault(len(w), []).append(w)
        for n, same in new.items():
            for k in range(0, len(same), TOGETHER):
                part = same[k : k + TOGETHER]
                at = len(self.rows)
                while len(self.logs) < at + len(part):
                    self.logs = np.vstack([self.logs, np.empty((max(4096, len(self.logs)), len(self.tables)))])
                self.logs[at : at + len(part)] = self.pieces.forward(part, self.p) if n < SHORT else [self.long(w) for w in part]
                self.rows.update(zip(part, range(at, at + len(part)), strict=True))

    def long(self, word: str) -> list[float]:
        lattice, n, out = arcs(word, self.known, self.begins), len(word) + 1, []
        for p in self.tables:
            alpha, scale = forward(lattice, n, p)
            out.append(math.log(alpha[n]) + scale)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        try:
            return self.logs[[self.rows[w] for w in words]]
        except KeyError:
            self.learn(words)
            return self.logs[[self.rows[w] for w in words]]

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The likelihoods of each text; None if it has no letter."""
        found = [WORDS.findall(t.lower()) if t else [] for t in texts]
        many: list[str] = []
        for words in found:
            many += words if len(words) <= TOGETHER else ()
        self.learn(many)
        out: list[np.ndarray | None] = []
        for words in found:
            if not any(c.isalpha() for w in words for c in w):
                out.append(None)
                continue
            total = np.zeros(len(self.tables))
            for k in range(0, len(words), TOGETHER):
                total += self.words(words[k : k + TOGETHER]).sum(axis=0)
            out.append(total)
        return out


def train(df: DataFrame, path: str, id_col: str, text_col: str, label_col: str, learnable: Column, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[float]]:
    """Piece probabilities by language. Only the bounded sample's piece tables come to the driver."""
    rows = df.where(learnable & F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("lang"), F.col(text_col).alias("text"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not many:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(many.items()) for x in (lang, min(1_000_000, math.ceil(1e6 * sample_docs / n)))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = Counter(w for t in texts for w in WORDS.findall(t.lower()))
                for words in counted(found, "word"):
                    yield words.assign(lang=lang)[["lang", "word", "n"]]

    def fit(key, words: pd.DataFrame) -> pd.DataFrame:
        p = learn(dict(zip(words["word"], words["n"].tolist(), strict=True)), path)
        return pd.DataFrame({"lang": [key[0]], "p": [p.tolist()]})

    words = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return {r["lang"]: list(r["p"]) for r in words.groupBy("lang").applyInPandas(fit, "lang string, p array<double>").collect()}


def identify(df: DataFrame, model: dict[str, list[float]], path: str, text_col: str = "text") -> Column:
    """struct<lang_pred, score> of a text column under a trained model."""
    languages = sorted(model)
    sent = df.sparkSession.sparkContext.broadcast([model[x] for x in languages])  # languages x vocabulary: no more with more rows

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value, path) if languages else None
        for texts in batches:
            found = []
            for logs in scorer.texts(texts.tolist()) if languages else [None] * len(texts):
                if logs is None:
                    found.append(("und", 0.0))
                else:
                    k = int(np.argmax(logs))
                    found.append((languages[k], float(1.0 / np.exp(np.maximum(logs - logs[k], -700.0)).sum())))
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(F.col(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fourth id or so by its CRC, and rows without an id: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def predictions(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    model = train(df, path, id_col, text_col, label_col, ~held_out(id_col), sample_docs)
    return df.select(F.col(id_col), held_out(id_col).alias("held_out"), identify(df, model, path, text_col).alias("found")).select(id_col, "held_out", "found.lang_pred", "found.score")
