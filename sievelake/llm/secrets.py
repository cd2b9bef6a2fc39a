"""Secret scans: fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

A text is read as tokens: runs of letters, digits and the marks + / _ -, and single other marks. The field tags each of
them begin, inside or outside of a secret: from its own shape, from the kinds of the two tokens before and the one after,
from key words and assignment signs near before it, from whether white space parts it from the token before, and from what
sort of file the text is. Any token may be a secret, short, of letters only or with marks inside; a secret holds no white
space. The weights are learned here, by gradient ascent on the conditional likelihood of made-up lines from a fixed seed
(see secret_lines.py), so that no document is needed, nor an internet service.

Whole texts are scored by table, and decoded exactly: where a token's score for outside is so far ahead that no choice
of its neighbours' tags can outweigh it, it is outside on every best path, and the stretches between such tokens are
decoded one by one.

Spans of the fixed patterns always stay. The field's spans are added where they touch none of these. Null text is
empty. Repeated rows give repeated rows; an empty table gives none. Of equally good taggings the one with the least tag
from the end is taken. A very long text is tokenised and decoded whole. Only the named columns are read.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.secret_lines import made_lines

#: The base patterns, by kind in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
HINT = re.compile(r"(?i)pass|secret|token|api")

#: A token, with one character of the white space before it, if any.
TOKEN = re.compile(r"\s?(?:[^\s!-*,.:-@\[-\^`{-~\x00-\x1f\x7f]+|\S)")
KEY_WORDS = frozenset("password passwd passphrase passcode pwd pass secret token key apikey api access auth authorization bearer basic credential credentials private aws akia client signature otp pin".split())
OUTSIDE, BEGIN, INSIDE = range(3)
#: Own features of tokens are hashed to so many bits.
BITS = 13
#: Kinds of tokens, as neighbours see them; NONE stands before the first and after the last.
KINDS_OF_TOKEN = ("none", "word", "number", "mixed", "sign", "quote", "key", "mark")
NONE, WORD, NUMBER, MIXED, SIGN, QUOTE, KEY, MARK = range(8)
#: How the token's surroundings are numbered: its kind, those of the two before and the one after, a key word within four before, a sign within two, white space before.
SHAPE_OF_PLACE = (8, 8, 8, 8, 2, 2, 2)
#: What a worker remembers of tokens.
MOST_TOKENS = 200_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    found = []
    if HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def shape(token: str) -> str:
    """Kinds of characters in a token, runs written once: `aA0` and so on."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^A-Z0-9+/_-]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", token))))[:6]


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in (token.count(x) for x in set(token)))


def is_key(token: str) -> bool:
    low = token.lower()
    return low in KEY_WORDS or any(w in KEY_WORDS for w in re.split("[_-]", low))


def kind_of(token: str) -> int:
    """Which of KINDS_OF_TOKEN."""
    if len(token) == 1 and not token.isalnum():
        return SIGN if token in "=:" else QUOTE if token in "\"'`" else MARK
    if is_key(token) and sum(c.isdigit() for c in token) < 3:
        return KEY
    if token.isdigit():
        return NUMBER
    return WORD if token.replace("-", "").isalpha() and (token[1:].islower() or token.isupper() and len(token) < 6 or len(token) == 1) else MIXED


def is_plain(token: str) -> bool:
    """Of letters only, small but for the first."""
    return token.isalpha() and (len(token) == 1 or token[1:].islower())


CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxz]+", re.I)


def summary(token: str) -> tuple[bool, int, int, int, bool]:
    """All that the field sees of a plain token."""
    runs = CONSONANTS.findall(token)
    return token[0].isupper(), min(2, len(token)), min(12, len(token) // 3), min(7, max(map(len, runs))) if runs else 0, token.lower() in KEY_WORDS


def own_features(token: str) -> list[str]:
    kind = kind_of(token)
    if kind in (SIGN, QUOTE, MARK):
        return ["bias", f"mark={token}", f"kind={kind}"]
    if is_plain(token):
        upper, letters, length, consonants, _ = summary(token)
        return ["bias", f"kind={kind}", f"plain={upper}{letters}", f"length={length}", f"length={length},kind={kind}", f"consonants={consonants},True"]
    low = token.lower()
    letters, digits = sum(c.isalpha() for c in token), sum(c.isdigit() for c in token)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
    consonants = max(map(len, CONSONANTS.findall(token)), default=0)
    length = min(12, len(token) // 3)
    return [
        "bias", f"kind={kind}", f"shape={shape(token)}", f"length={length}", f"length={length},kind={kind}", f"entropy={int(_entropy(token) * 2)}", f"switches={min(6, switches)}",
        f"consonants={min(7, consonants)},{letters == len(token)}", f"hex={not low.strip('0123456789abcdef')},{length}", f"marks={min(4, len(token) - letters - digits)}", f"mixed={digits > 0}{token != low}{low != token.upper().lower() or letters > 0}", f"parts={min(4, token.count('_') + token.count('-'))},{min(6, digits)}",
    ]


def numbers(names: list[str]) -> list[int]:
    """Features by hashed number; two of a token may share one."""
    return [zlib.crc32(x.encode()) % (1 << BITS) for x in names]


def file_number(text: str) -> int:
    """Of the whole text: what sort of file it is, by its share of assignment signs and by marks of code."""
    signs = text.count("=") + text.count(":")
    return 2 * min(3, signs * 200 // max(1, len(text))) + ("{" in text or ";" in text)


def places(kinds: np.ndarray, glued: np.ndarray) -> np.ndarray:
    """Each token's surroundings as a row of SHAPE_OF_PLACE."""
    n = len(kinds)
    padded = np.concatenate([np.zeros(4, kinds.dtype), kinds, np.zeros(1, kinds.dtype)])
    key, sign = padded == KEY, padded == SIGN
    near = key[:n] | key[1 : n + 1] | key[2 : n + 2] | key[3 : n + 3]
    return np.stack([kinds, padded[3 : n + 3], padded[2 : n + 2], padded[5:], near, sign[3 : n + 3] | sign[2 : n + 2], glued]).astype(np.int64)


#: Which parts of a place make one feature together, each with the token's own kind.
TEMPLATES = ((0, 1), (0, 2), (0, 3), (0, 1, 2), (0, 4, 5), (0, 4, 1), (0, 4, 5, 6), (0, 1, 3, 6))
_SIZES = [int(np.prod([SHAPE_OF_PLACE[k] for k in t])) for t in TEMPLATES]
_FIRST = np.cumsum([0, *_SIZES])
N_PLACE, N_FILE = int(_FIRST[-1]), 8 * 8


def place_features(place: np.ndarray) -> np.ndarray:
    """(tokens, templates): numbers of a token's place features."""
    return np.stack([_FIRST[k] + np.ravel_multi_index([place[x] for x in t], [SHAPE_OF_PLACE[x] for x in t]) for k, t in enumerate(TEMPLATES)], axis=1)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


#: A secret's inside comes after its begin or inside only.
FORBIDDEN = np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])


def _expected(e: np.ndarray, lengths: np.ndarray, tags: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed tags and moves of chains (chain, token, tag), by forward and backward passes over all of them at once."""
    t = move + FORBIDDEN
    m, n, _ = e.shape
    here = np.arange(n)[None] < lengths[:, None]
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = e[:, 0] + t[OUTSIDE]
    for k in range(1, n):
        a[:, k] = e[:, k] + log_sum(a[:, k - 1, :, None] + t, 1)
    for k in range(n - 2, -1, -1):
        b[:, k] = np.where(here[:, k + 1, None], log_sum(t + (e[:, k + 1] + b[:, k + 1])[:, None, :], 2), 0.0)
    z = log_sum(a[np.arange(m), lengths - 1], 1)
    p = np.exp(a + b - z[:, None, None]) * here[..., None]
    pair = np.zeros((3, 3))
    pair[OUTSIDE] += p[:, 0].sum(0)
    for k in range(1, n):
        both = np.exp(a[:, k - 1, :, None] + t + (e[:, k] + b[:, k])[:, None, :] - z[:, None, None])
        pair += (both * here[:, k, None, None]).sum(0)
    before = np.concatenate([np.full((m, 1), OUTSIDE), tags[:, :-1]], axis=1)
    np.add.at(pair, (before[here], tags[here]), -1)
    chain, at = np.nonzero(here)
    p[chain, at, tags[here]] -= 1
    return p, pair


def tagged(line: str, spans: list[tuple[int, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(tokens, glued, tags) of a line whose secrets are known."""
    found = [(m.start() + (len(m.group()) > 1 and m.group()[0].isspace()), m.end()) for m in TOKEN.finditer(line)]
    glued = np.array([a > 0 and not line[a - 1].isspace() for a, _ in found], bool)
    tags = [next((BEGIN if a == x else INSIDE for x, y in spans if x <= a < y), OUTSIDE) for a, _ in found]
    return [line[a:b] for a, b in found], glued, np.array(tags)


@functools.cache
def trained(n_lines: int = 6000, rounds: int = 10, rate: float = 0.25, decay: float = 1e-4, chains: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights by tag of own features, places (each of SHAPE_OF_PLACE, summed up) and files, and of moves between tags."""
    first_file = (1 << BITS) + N_PLACE
    w, move = np.zeros((first_file + N_FILE + 1, 3)), np.zeros((3, 3))
    w2, move2 = np.full(w.shape, 1e-6), np.full(move.shape, 1e-6)
    rows = []
    for line, spans in made_lines(7, n_lines):
        tokens, glued, tags = tagged(line, spans)
        if not tokens:
            continue
        own = [numbers(own_features(t)) for t in tokens]
        kinds = np.array([kind_of(t) for t in tokens])
        at = np.full((len(tokens), 13 + len(TEMPLATES)), len(w) - 1)  # the last row is no feature
        for k, x in enumerate(own):
            at[k, : len(x)] = x
        at[:, 12 : 12 + len(TEMPLATES)] = (1 << BITS) + place_features(places(kinds, glued))
        at[:, -1] = first_file + 8 * file_number(line) + kinds
        rows.append((at, glued, tags))
    order = sorted(range(len(rows)), key=lambda k: len(rows[k][2]))  # chains of like lengths together
    batches = [order[k : k + chains] for k in range(0, len(order), chains)]
    for turn in range(rounds):
        for b in np.random.default_rng(turn).permutation(len(batches)):
            some = [rows[k] for k in batches[b]]
            lengths = np.array([len(x[2]) for x in some])
            n = lengths.max()
            at = np.full((len(some), n, rows[0][0].shape[1]), len(w) - 1)
            tags = np.zeros((len(some), n), int)
            e = np.zeros((len(some), n, 3))
            for k, (x, glued, y) in enumerate(some):
                at[k, : len(y)], tags[k, : len(y)] = x, y
                e[k, : len(y), INSIDE] = np.where(glued, 0.0, -1e4)
            w[-1] = 0
            p, pair = _expected(e + w[at].sum(axis=2), lengths, tags, move)
            g = decay * w
            np.add.at(g, at.reshape(-1, at.shape[2]), p.reshape(-1, 1, 3) / 4)
            w2 += g * g
            w -= rate * g / np.sqrt(w2)
            move2 += pair * pair
            move -= rate * pair / np.sqrt(move2)
    w[-1] = 0
    every = np.indices(SHAPE_OF_PLACE).reshape(len(SHAPE_OF_PLACE), -1)
    by_place = w[(1 << BITS) :][place_features(every)].sum(axis=1)
    return w[: 1 << BITS].copy(), by_place, w[first_file:-1].copy(), move


def viterbi(scores: np.ndarray, move: np.ndarray) -> list[int]:
    """The best tags of a stretch that outside tokens enclose."""
    t = move + FORBIDDEN
    best, back = scores[0] + t[OUTSIDE], []
    for row in scores[1:]:
        ways = best[:, None] + t
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    tags = [int((best + t[:, OUTSIDE]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


class Field:
    """The trained field, with what it remembers of tokens: kinds and own scores by number."""

    def __init__(self, own: np.ndarray, by_place: np.ndarray, by_file: np.ndarray, move: np.ndarray):
        self.own, self.by_place, self.by_file, self.move = own, by_place, by_file, move
        self.spread = 3 * float(np.ptp(move))
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.plain: dict[tuple, tuple[int, np.ndarray]] = {}
        self.tables = np.zeros(4096, np.int64), np.zeros(4096, bool), np.zeros((4096, 3))

    def _add(self, found: str) -> int:
        token = found[1:] if len(found) > 1 and found[0].isspace() else found
        self.number[found] = at = len(self.number)
        if at == len(self.tables[0]):
            self.tables = tuple(np.concatenate([x, np.zeros_like(x)]) for x in self.tables)
        kinds, glued, scores = self.tables
        if is_plain(token):
            seen = summary(token)
            if seen not in self.plain:
                self.plain[seen] = self._scored(token)
            kinds[at], scores[at] = self.plain[seen]
        else:
            kinds[at], scores[at] = self._scored(token)
        glued[at] = token is found
        return at

    def _scored(self, token: str) -> tuple[int, np.ndarray]:
        return kind_of(token), self.own[numbers(own_features(token))].sum(axis=0)

    def tags(self, text: str) -> list[tuple[int, int]]:
        """(token, tag) of all tokens that are not outside, in order."""
        if len(self.number) > MOST_TOKENS:
            self._forget()
        number = self.number
        found = TOKEN.findall(text)
        at = np.array([number[x] if x in number else self._add(x) for x in found], np.int64)
        if not len(at):
            return []
        kinds, glued, own = (x[at] for x in self.tables)
        glued[0] &= False
        place = np.ravel_multi_index(places(kinds, glued), SHAPE_OF_PLACE)
        e = own + self.by_place[place] + self.by_file[8 * file_number(text) + kinds]
        e[~glued, INSIDE] = -1e4
        # outside for sure: no change of the tags beside it, nor of a next one that would have to begin, outweighs it
        rest = np.maximum(0.0, np.append(e[1:, INSIDE] - e[1:, BEGIN], 0.0))
        open_ = np.flatnonzero(e[:, OUTSIDE] - e[:, 1:].max(axis=1) <= self.spread + rest)
        out = []
        for stretch in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
            out += [(int(k), tag) for k, tag in zip(stretch, viterbi(e[stretch], self.move), strict=True) if tag != OUTSIDE]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        tags = dict(self.tags(text))
        if not tags:
            return []
        found: list[list[int]] = []
        for k, m in enumerate(TOKEN.finditer(text)):
            if tag := tags.get(k):
                start = m.start() + (len(m.group()) > 1 and m.group()[0].isspace())
                if tag == BEGIN or not found:
                    found.append([start, m.end()])
                else:
                    found[-1][1] = m.end()
        return [(a, b) for a, b in found]


def spans_of(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, all), by start and then by kind."""
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    base = sorted(base_spans(text), key=order)
    own = [(a, b, "crf") for a, b in field.spans(text) if not any(a < d and c < b for c, d, _ in base)]
    return base, sorted(base + own, key=order)


def written_out(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): every text's secrets, as arrays of (start, end, kind); code points, end exclusive."""
    weights = df.sparkSession.sparkContext.broadcast(trained())  # tables of a fixed size, whatever the input

    @F.pandas_udf("base array<struct<start:long,end:long,kind:string>>, spans array<struct<start:long,end:long,kind:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        field = Field(*weights.value)
        for texts in batches:
            rows = [spans_of(t or "", field) for t in texts]
            to = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            yield pd.DataFrame({"base": [to(b) for b, _ in rows], "spans": [to(s) for _, s in rows]})

    return df.select(F.col(id_col), run(F.col(text_col)).alias("found")).select(id_col, "found.base", "found.spans")


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    many = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(id_col, many("assign"), many("access"), many("hex"), F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redact(df: DataFrame, text_col: str = "text", with_: str = "<SECRET>") -> F.Column:
    """The text with every secret replaced; overlapping spans are one. Null stays null."""
    weights = df.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        field = Field(*weights.value)
        for texts in batches:
            out = []
            for t in texts:
                spans = spans_of(t, field)[1] if t else []
                parts, at = [], 0
                for a, b, _ in spans:
                    if a >= at:
                        parts += [t[at:a], with_]
                    at = max(at, b)
                out.append("".join([*parts, t[at:]]) if spans else t)
            yield pd.Series(out, dtype=object)

    return run(F.col(text_col))
