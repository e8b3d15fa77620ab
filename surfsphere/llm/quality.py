"""Text quality statistics per document (problem 9).

Every line that says something is one of four kinds: prose, list, table or junk. A hidden Markov model over
discrete line statistics labels them: its hidden states are the kinds, so the lines around a line count, and
each state emits the bins of the statistics independently. It starts from the stated priors below and is
trained on the whole corpus by expectation-maximisation.

Texts are parsed once: a job cuts them into lines and writes, for every chunk of documents, the different
lines with the bins of their form and their words as numbers and hashes. All later jobs read these chunks.
One counts in how many documents words, pairs and triples of words occur and how often they come back in
other lines of the same document: the lines of a list share a frame ("a pinch of", "platform 3"), while what
is said in prose seldom comes back. Then each round labels all lines and adds up expected counts, among them
the documents in which a word is of prose or of another kind. What reaches the driver are tables of fixed
size and the words, pairs and triples that are in a stated share of all lines, whose number that share
bounds. The weights of the statistics (WEIGHT) are stated, not trained. A document's result are the shares of
its lines by label and plain statistics of them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

KINDS = ("prose", "list", "table", "junk")
#: Training rounds; least lines (each once a document) of a word, pair or triple, and least share of all lines.
#: A line of w words has less than 4 w of them, so at most 4 w / MIN_SHARE reach the driver.
ROUNDS, MIN_LINES, MIN_SHARE = 3, 5, 2e-5
#: Words and triples in fewer documents count as unknown.
MIN_DOCS = 4
#: Weight of the stated priors against the counts when the model is estimated anew.
PRIOR = 0.3
#: A triple is common where it is in that share of the documents of its rarest word and comes back at most so many times as often as lines of prose usually do.
FIXED, SPREAD = 0.05, 1.7
#: How often a pair comes back before anything is known, and the pairs of lines that this counts for.
BACK, BACK_LINES = 0.04, 100
#: Weight of a statistic's evidence. Those of a line's form depend on each other and are damped.
WEIGHT = {"lexicon": 1.0, "triples": 2.0, "unknown": 1.5, "frames": 2.0}
#: Steps in which the usual rate of return is found.
RATES = np.geomspace(1e-3, 1, 121)
#: Words that count as common, the most frequent ones among those of prose.
COMMON = 500
#: Bytes of text handled at once.
CHUNK = 16_000_000

# Stated values: for each statistic its bins and, for the four kinds, how likely each bin is (in any unit).
STATS = {
    "digits": (("none", "few", "some", "many", "most"), ((85, 10, 4, 1, 0.3), (35, 12, 30, 18, 5), (4, 3, 15, 48, 30), (50, 12, 25, 11, 2))),
    "letters": (("none", "few", "half", "most", "all"), ((0.5, 0.7, 5, 25, 69), (0.7, 6, 25, 30, 40), (35, 40, 22, 2, 1), (25, 5, 20, 15, 35))),
    "word_length": (("other script", "one short", "tiny", "short", "usual", "long", "huge"), ((12, 9, 0.7, 25, 53, 1.3, 0.1), (3, 8, 1, 22, 60, 5, 0.1), (1, 4, 18, 30, 30, 12, 2), (8, 8, 9, 22, 25, 4, 24))),
    "end": (("sentence", "letter", "digit", "other"), ((80, 16, 1, 3), (25, 52, 8, 15), (4, 26, 40, 30), (30, 42, 6, 22))),
    "start": (("upper", "lower", "digit", "mark", "uncased"), ((70, 13, 2, 7, 8), (34, 26, 15, 20, 4), (6, 24, 35, 33, 2), (33, 32, 10, 20, 5))),
    "separators": (("none", "comma", "commas", "bars"), ((72, 24, 3, 1), (48, 8, 24, 20), (33, 5, 12, 50), (80, 8, 4, 8))),
    "variety": (("short", "one", "low", "usual", "high"), ((22, 0.1, 3, 60, 15), (15, 0.2, 5, 60, 20), (10, 1, 20, 60, 9), (8, 22, 35, 25, 10))),
    "lexicon": (("no words", "other", "rather other", "between", "rather prose", "prose"), ((16, 0.5, 3, 12, 18, 50), (8, 42, 20, 12, 10, 8), (40, 40, 10, 6, 3, 1), (40, 20, 12, 13, 8, 7))),
    "triples": (("too short", "rare", "some", "half", "most", "all"), ((20, 2.5, 4, 5.5, 14, 54), (14, 36, 24, 19, 5, 2), (50, 30, 10, 5, 3, 2), (40, 50, 6, 2, 1, 1))),
    "unknown": (("no words", "none", "few", "many", "most"), ((16, 62, 20, 1.8, 0.2), (8, 60, 20, 8, 4), (40, 30, 10, 10, 10), (33, 4, 5, 13, 45))),
    "frames": (("none known", "new", "seldom", "sometimes", "often", "always"), ((10, 40, 40, 8, 1.5, 0.5), (10, 4, 14, 22, 30, 20), (20, 6, 14, 20, 20, 20), (60, 16, 10, 6, 5, 3))),
}
WIDTH = max(len(bins) for bins, _ in STATS.values())
PLACE = {name: i for i, name in enumerate(STATS)}
#: Statistics of a line's form, those against the corpus, and those whose first bin is missing data: no evidence.
FORM, MISSING = [i for name, i in PLACE.items() if name not in WEIGHT], [PLACE[name] for name in WEIGHT]
STAY = ((0.97, 0.01, 0.01, 0.01), (0.02, 0.96, 0.01, 0.01), (0.02, 0.01, 0.96, 0.01), (0.02, 0.01, 0.01, 0.96))
START = (0.88, 0.05, 0.03, 0.04)

# Fixed patterns of what is set aside, and of words.
MARKUP = re.compile(r"<[^<>]*>|\{\\[^{}]*\}")
SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|【[^【】]*】|（[^（）]*）|\*[^*\n]*[^\W\d_][^*\n]*\*")
SONG = re.compile(r"[♪♫#]|â™ª|â™«|â\x99ª|â\x99«|Ã¢Â\x99Âª|Ã¢â„¢Âª")
ADVERT = re.compile(r"www\.|https?:|@\w|\w\.[a-z]{2,}\b|subtitles? by", re.I)
AD_SIGN, BRACKET, SONG_SIGN = re.compile(r"[./@]\w|[bB][yY]"), re.compile(r"[\[(*【（]"), re.compile(r"[♪♫#âÃ]")
CUE, TIME = re.compile(r"\d+\Z"), re.compile(r"\d{1,2}:\d{2}(?::\d{2})?[.,:]\d{1,3}\s*(?:,|-+>)?\s*\d{1,2}:")
HEADER = re.compile(r"WEBVTT\b|(?:NOTE|STYLE|REGION)\s*\Z")
TOKEN, SPLIT = re.compile(r"[^\W\d_]+|[0-9]+|[-,;:/|\t—–=+*&@#%$~<>{}()\[\]\\^、・：]"), re.compile(r"\r\n|\n|\r")
BARS = re.compile(r"[|\t;]| - | / |: ")
# Upper edges of the bins (a value on an edge belongs to the lower bin), and characters cut off lines.
DIGIT_EDGES, LETTER_EDGES, WORD_EDGES = (0, 0.1, 0.22, 0.6), (0.1, 0.4, 0.75, 0.93), (2.2, 3.2, 7.5, 13)
ODDS_EDGES, UNKNOWN_EDGES, TRIPLE_EDGES, FRAME_EDGES = (-1.5, -0.4, 0.6, 1.6), (0, 0.3, 0.65), (0.1, 0.35, 0.55, 0.75), (-0.05, 0.15, 0.3, 0.58)
DASHES = "-–—"
SIGNS, MARKS, EDGE = "-–— .", "-–—♪♫ .?", " \t\u3000\ufeff?"
SENTENCE_END, BULLETS = set(".?!…。？！»”\"'"), set("•*-–—|+~=#>/·")


def content(line: str) -> str | None:
    """What a line says, without markup, sounds, song marks and the speaker's dash; None where it's set aside."""
    if "-->" in line or (line[0] <= "9" and (CUE.match(line) or TIME.match(line))) or HEADER.match(line):
        return None
    if "<" in line or "{" in line:
        line = MARKUP.sub("", line)
    if AD_SIGN.search(line) and ADVERT.search(line):
        return None
    quiet = SOUND.sub("", line) if BRACKET.search(line) else line
    said = SONG.sub("", quiet) if SONG_SIGN.search(quiet) else quiet
    if said == line and line[:2] == "? " and line[-2:] == " ?":
        said = line.strip(EDGE) + " "
    if said == line:
        kept = line.strip()
        return kept if kept.strip(SIGNS) else (kept if kept.strip(MARKS) else None)
    said = said.strip(EDGE)  # a song mark may have come out as ?
    return said if said.strip(SIGNS) else None


def statistics(said: str, gaps: list[str], dense: str, plain: int, letters: int, figures: int) -> list[int]:
    """Bins of the statistics that need no lexicon, in the order of STATS.

    ``gaps`` are the line's parts between blanks, ``dense`` these together, ``plain`` its number of ASCII characters,
    ``letters`` that of letters, ``figures`` that of the digits 0 to 9.
    """
    n = max(1, len(dense))
    digits = figures / n
    if plain < 0.6 * n:
        length = 0
    elif len(gaps) == 1:
        length = 1 if n <= 14 else 6
    else:
        length = 2 + bisect_left(WORD_EDGES, n / max(1, len(gaps)))
    # A line of other script, or of letters that a wrong decoding has turned into letters and signs.
    other = plain < 0.6 * n and letters > 0.2 * n
    if other:
        letters = max(letters, 0.94 * n)
    last, first = said[-1], said.lstrip("-–— ")[:1] or said[0]
    end = 0 if last in SENTENCE_END else 1 if last.isalpha() else 2 if last.isdigit() else 3
    if said[0] in BULLETS and not (said[0] in "-–—" and first.isupper()):
        start = 3
    else:
        start = 0 if first.isupper() else 1 if first.islower() else 2 if first.isdigit() else 4 if first.isalpha() else 3
    if other:
        end = 1 if end == 3 and last >= "\x80" else end
        start = 4 if start in (1, 3) and said[0] >= "\x80" else start
    commas = said.count(",") + said.count("、")
    if BARS.search(said) and not other:
        separators = 3
    elif (commas > 1 or commas and last in ",;、") and end != 0 and len(gaps) <= 3 * (commas + 1):
        separators = 2
    else:
        separators = min(commas, 1)
    if n < 12:
        variety = 0
    else:
        kinds = len(set(dense))
        variety = 1 if kinds <= 2 else 2 if kinds / n < (0.3 if n < 40 else 0.2) and not other else 3 if kinds / n < 0.7 else 4
    return [bisect_left(DIGIT_EDGES, digits), bisect_left(LETTER_EDGES, letters / n), length, end, start, separators, variety]


@dataclass
class Chunk:
    """The lines of some documents: each document's line ids, and of every different line its form and tokens."""

    n: np.ndarray  #: lines of each document
    ids: np.ndarray  #: line ids, one document after the other
    form: np.ndarray  #: (lines, FORM) bins
    plain: np.ndarray  #: (lines, 6) letters, signs, characters, 1 if punctuated, 1 if unknown words are judged, 1 if frames and triples are
    begin: np.ndarray  #: (lines + 1) first token of each line
    token: np.ndarray  #: token ids
    hashed: np.ndarray  #: of each token id, the hash of its lower-case form
    kind: np.ndarray  #: of each token id: 0 separator, 1 number, 2 word, 3 capitalised word; 4 more for ASCII words

    TYPES = {"n": np.int32, "ids": np.int32, "form": np.uint8, "plain": np.int32, "begin": np.int32, "token": np.int32, "hashed": np.uint64, "kind": np.uint8}

    def row(self) -> list[bytes]:
        return [getattr(self, f).astype(t).tobytes() for f, t in self.TYPES.items()]

    @classmethod
    def of(cls, row: dict) -> Chunk:
        c = cls(*(np.frombuffer(row[f], t) for f, t in cls.TYPES.items()))
        c.form, c.plain = c.form.reshape(-1, len(FORM)), c.plain.reshape(-1, 6)
        return c

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of the words only, their lines)."""
        line = np.repeat(np.arange(len(self.form)), np.diff(self.begin))
        is_word = (self.kind & 3)[self.token] >= 2
        return self.token[is_word], line[is_word]


def parse(texts: list[str | None]) -> Chunk:
    """Blank and set-aside lines are left out. A null or empty text has no lines."""
    seen: dict[str, int] = {}
    vocabulary: dict[str, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    number, find = vocabulary.__getitem__, TOKEN.findall
    form, plain, token, begin = [], [], [], [0]

    def id_of(line: str) -> int:
        said = content(line)
        if said is None:
            return -1
        found = find(said)
        words = [t for t in found if t[0].isalpha()]
        letters = sum(map(len, words))
        gaps = said.split()
        dense = "".join(gaps)
        figures = 0 if dense.isalpha() else sum(map(dense.count, "0123456789"))
        if said.isascii():
            ascii_letters, foreign, ascii_signs, digits, joints = letters, 0, len(dense), figures, said.count("\t")
        else:
            ascii_letters, foreign = sum([len(w) for w in words if w.isascii()]), len(said) - len(said.encode("ascii", "ignore"))
            ascii_signs = len(dense.encode("ascii", "ignore"))
            digits, joints = sum(map(str.isdigit, dense)), sum(map(said.count, "’、・：\t"))
        form.append(statistics(said, gaps, dense, ascii_signs, letters, figures))
        signs = len(dense) - letters - digits
        # Words of other letters may be misdecoded: unknown ones say nothing there.
        judged = ascii_letters > 0 and 10 * foreign <= 2 * len(said) and 10 * ascii_letters >= 6 * letters
        # A wrong decoding breaks words into many pieces without blanks between them, which come back like letters.
        whole = 2 * len(words) <= 3 * (1 + said.count(" ") + said.count("'") + joints) + 2
        plain.append((letters, signs, len(said), said[-1] in SENTENCE_END, judged, whole))
        token.extend(map(number, found[1:] if found and found[0] in DASHES else found))
        begin.append(len(token))
        return len(form) - 1

    ids, n = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        before = len(ids)
        for line in SPLIT.split(text) if "\r" in text else text.split("\n"):
            if "-->" in line or line.isdigit():
                continue
            line = line.strip(" \t﻿　\xa0")
            if line:
                k = seen.get(line)
                if k is None:
                    seen[line] = k = id_of(line)
                if k >= 0:
                    ids.append(k)
        n[i] = len(ids) - before
    names = list(vocabulary)
    lower = ["0" if t[0] in "0123456789" else t.lower() for t in names]
    kind = [(0 if not t[0].isalnum() else 1 if s == "0" else 3 if t[0].isupper() else 2) + (4 if t[0].isalpha() and t.isascii() else 0) for t, s in zip(names, lower)]
    hashed = pd.util.hash_array(np.array(lower, object), categorize=False) if names else np.zeros(0, np.uint64)
    return Chunk(n, np.array(ids, np.int64), np.array(form, np.uint8).reshape(-1, len(FORM)), np.array(plain, np.int32).reshape(-1, 6), np.array(begin), np.array(token, np.int64), hashed, np.array(kind, np.uint8))


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """One 64-bit hash of two."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(salt)) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pairs_of(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(keys, their lines): two tokens in a row, every separator with the kinds of its neighbours, and every lower-case word behind a capitalised one."""
    line = np.repeat(np.arange(len(c.form)), np.diff(c.begin))
    h = c.hashed[c.token]
    same = line[1:] == line[:-1]
    keys, at = [_mixed(h[:-1], h[1:], 1)[same]], [line[1:][same]]
    kind = (c.kind & 3)[c.token].astype(np.uint64)
    named = same & (kind[:-1] == 3) & (kind[1:] == 2)
    keys.append(_mixed(h[1:][named], np.full(named.sum(), 3, np.uint64), 4))
    at.append(line[1:][named])
    sep = np.flatnonzero(kind == 0)
    none = np.uint64(4)
    if len(sep):
        before = np.where((sep > 0) & (line[sep] == line[np.maximum(sep - 1, 0)]), kind[np.maximum(sep - 1, 0)], none)
        last = np.minimum(sep + 1, len(kind) - 1)
        after = np.where((sep + 1 < len(kind)) & (line[sep] == line[last]), kind[last], none)
        keys.append(_mixed(h[sep], before * np.uint64(8) + after, 2))
        at.append(line[sep])
    return np.concatenate(keys), np.concatenate(at)


def triples_of(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their lines, (triples, 3) token ids): three words in a row."""
    word, line = c.words()
    same = line[2:] == line[:-2]
    t = np.stack([word[:-2], word[1:-1], word[2:]], 1)[same] if len(word) > 2 else np.zeros((0, 3), np.int64)
    h = c.hashed[t]
    return _mixed(_mixed(h[:, 0], h[:, 1], 1), h[:, 2], 3), line[2:][same] if len(word) > 2 else np.zeros(0, np.int64), t


def counts_of(c: Chunk) -> tuple[np.ndarray, ...]:
    """keys; documents, (document, line) pairs, pairs of different lines of a document one of which has the key, and pairs where both have it."""
    word, at = c.words()
    found = [(c.hashed[word], at), pairs_of(c), triples_of(c)[:2]]
    inverse, key = pd.factorize(np.concatenate([k for k, _ in found]))  # hashing takes less than sorting
    held = np.sort(np.concatenate([a for _, a in found]) * np.int64(len(key)) + inverse)
    held = held[np.append(True, held[1:] != held[:-1])] if len(held) else held  # each key once a line
    line_of, key_of = held // max(1, len(key)), held % max(1, len(key))
    first = np.searchsorted(line_of, np.arange(len(c.form) + 1))
    doc = np.repeat(np.arange(len(c.n)), c.n)
    mine = np.unique(doc * np.int64(max(1, len(c.form))) + c.ids)  # each line once a document
    d, line = mine // max(1, len(c.form)), mine % max(1, len(c.form))
    m = np.bincount(d, minlength=len(c.n))
    size = first[line + 1] - first[line]
    at = np.repeat(first[line] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    cell = np.sort(np.repeat(d, size) * np.int64(max(1, len(key))) + key_of[at])
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    k = np.diff(np.append(start, len(cell)))
    of, others = cell[start] % max(1, len(key)), m[cell[start] // max(1, len(key))] - 1

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(of, x, len(key))

    return key, total(np.ones(len(k))), total(k), total(k * others), total(k * (k - 1))


class Model:
    """Start, transition and emission probabilities, and what is known of words, pairs and triples by hash."""

    def __init__(self) -> None:
        self.start, self.move = np.array(START), np.array(STAY)
        self.emit = np.zeros((len(STATS), 4, WIDTH))
        for i, (bins, table) in enumerate(STATS.values()):
            t = np.array(table, float)
            self.emit[i, :, : len(bins)] = t / t.sum(1, keepdims=True)
        self.seed = self.emit.copy()
        #: Sorted hashes; of each, documents and how often it comes back; log odds of prose (NaN: not known), whether it's a common word.
        self.keys, self.docs, self.back = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.float32)
        self.odds, self.common = np.zeros(0, np.float32), np.zeros(0, bool)
        self.labelled, self.least = False, MIN_DOCS
        #: How often the pairs of a line of prose usually come back; None: not known yet.
        self.usual: float | None = None

    def know(self, keys: np.ndarray, docs: np.ndarray, lines: np.ndarray, pairs: np.ndarray, back: np.ndarray) -> None:
        order = np.argsort(keys)
        self.least = max(MIN_DOCS, lines.min(initial=2**31 - 1))
        self.keys, self.docs = keys[order], docs[order].astype(np.int32)
        self.back = ((back + BACK * BACK_LINES) / (pairs + BACK_LINES))[order].astype(np.float32)
        self.odds, self.common = np.full(len(keys), np.nan, np.float32), np.zeros(len(keys), bool)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """Places of hashes among the keys, -1 where they are unknown."""
        if not len(self.keys):
            return np.full(hashed.shape, -1)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[at] == hashed, at, -1)

    def learn_words(self, places: np.ndarray, prose: np.ndarray, other: np.ndarray) -> None:
        """Log odds from the documents in which a word is of prose or not; half a document each keeps them finite."""
        places, prose, other = (x[self.docs[places] >= MIN_DOCS] for x in (places, prose, other))
        whole = prose.max(initial=0) + 1, other.max(initial=0) + 1
        self.odds[places] = np.log((prose + 0.5) / whole[0]) - np.log((other + 0.5) / whole[1])
        mine = places[self.odds[places] > 0]
        top = mine[np.lexsort((self.keys[mine], -self.docs[mine]))][:COMMON]
        self.common = np.zeros(len(self.keys), bool)
        self.common[top] = True
        self.labelled = True

    def learn_rate(self, lines: np.ndarray) -> None:
        """The median over lines of prose, ``lines`` at each step of RATES, is the measure of what is often."""
        if lines.sum() > 0:
            self.usual = float(RATES[min(len(RATES) - 1, np.searchsorted(np.cumsum(lines), lines.sum() / 2))])

    def learn(self, counts: np.ndarray, moves: np.ndarray) -> None:
        """Counts and stated priors together; a kind that never occurs keeps its priors. Missing data teaches nothing."""
        for i in self.used():
            lo = 1 if i in MISSING else 0
            share = self.seed[i, :, lo:].sum(1, keepdims=True)
            total = counts[i, :, lo:].sum(1, keepdims=True)
            prior = PRIOR * np.maximum(total, 50)
            self.emit[i, :, lo:] = (share * counts[i, :, lo:] + prior * self.seed[i, :, lo:]) / (total + prior)
        moves = moves + 50 * np.array(STAY)
        self.move = moves / moves.sum(1, keepdims=True)

    def used(self) -> list[int]:
        ready = {"unknown": len(self.keys), "lexicon": self.labelled, "triples": self.usual, "frames": self.usual}
        return [i for i, name in enumerate(STATS) if i in FORM or ready[name]]

    def log_emissions(self, bins: np.ndarray) -> np.ndarray:
        log = np.log(np.maximum(self.emit, 1e-6))
        log[MISSING, :, 0] = 0
        names = list(STATS)
        return sum(WEIGHT.get(names[i], 0.7) * log[i][:, bins[:, i]].T for i in self.used())

    def rates(self, c: Chunk) -> np.ndarray:
        """How often the pairs of each line come back, in the quadratic mean; 0 where a line has too few to tell its frame."""
        key, at = pairs_of(c)
        there = self.find(key)
        at, back = at[there >= 0], self.back[there[there >= 0]].astype(float)
        of, size = np.bincount(at, minlength=len(c.form)), np.diff(c.begin)
        told = (c.plain[:, 5] > 0) & (size > 3) & (2 * of >= size)
        return np.where(told, np.sqrt(np.bincount(at, back * back, len(c.form)) / np.maximum(of, 1)), 0.0)

    def bins(self, c: Chunk) -> np.ndarray:
        """(lines, STATS) bins of the different lines of a chunk."""
        out = np.zeros((len(c.form), len(STATS)), np.int64)
        out[:, FORM] = c.form
        if not len(self.keys) or not len(c.form):
            return out
        n = len(c.form)
        place = self.find(c.hashed)
        place = np.where(self.docs[place] >= MIN_DOCS, place, -1)
        word, line = c.words()
        words = np.bincount(line, minlength=n)

        def share(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = np.bincount(at, minlength=n)
            return of, np.bincount(at, value, n) / np.maximum(of, 1)

        if self.labelled:
            odds = np.where(place >= 0, self.odds[place], np.nan)[word]
            known = ~np.isnan(odds)
            of, mean = share(line[known], odds[known])
            # If most words are unknown, what is left says little about the line.
            out[:, PLACE["lexicon"]] = np.where((of > 0) & (2 * of >= words), 1 + np.searchsorted(ODDS_EDGES, mean), 0)
        if self.usual:
            key, at, token = triples_of(c)
            rarest = np.where(place >= 0, self.docs[place], 0)[token].min(1, initial=2**31 - 1)
            there = self.find(key)
            # A word that is misread, or too rare for a common triple to be known, spoils its triples, which then say nothing.
            seen = (there >= 0) & (self.docs[there] >= MIN_DOCS)
            judged = seen | (FIXED * rarest >= self.least)
            common = seen & (self.docs[there] >= FIXED * rarest) & (self.back[there] <= SPREAD * self.usual)
            of, mean = share(at[judged], common[judged])
            out[:, PLACE["triples"]] = np.where((of > 0) & (words > 3) & (c.plain[:, 5] > 0), 1 + np.searchsorted(TRIPLE_EDGES, mean), 0)
            rate = self.rates(c)
            # 0 is the usual rate and 1 that of what is in every line, on a logarithmic scale.
            height = 1 - np.log(np.maximum(rate, 1e-9)) / np.log(min(self.usual, 0.9))
            out[:, PLACE["frames"]] = np.where(rate > 0, 1 + np.searchsorted(FRAME_EDGES, height), 0)
            # A list repeats its own triples, too: in a frame that comes back often they say nothing.
            out[out[:, PLACE["frames"]] > 3, PLACE["triples"]] = 0
        plain = (c.kind & 4)[word] > 0
        of, mean = share(line[plain], place[word[plain]] < 0)
        out[:, PLACE["unknown"]] = np.where(c.plain[:, 4] > 0, 1 + np.searchsorted(UNKNOWN_EDGES, mean), 0)
        return out


def posteriors(log_b: np.ndarray, n: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: (lines, 4) label probabilities, expected moves (4, 4).

    ``log_b`` holds the lines of all documents one after the other, ``n`` their numbers. Step t treats the
    t-th line of every document that has one.
    """
    b = np.exp(log_b - log_b.max(1, keepdims=True)) + 1e-12
    order = np.argsort(-n, kind="stable")
    first = (np.cumsum(n) - n)[order]
    length = n[order]
    alpha, beta, scale = np.empty_like(b), np.empty_like(b), np.empty(len(b))
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left") if steps else []
    for t in range(steps):
        at = first[: alive[t]] + t
        a = model.start * b[at] if t == 0 else (alpha[at - 1] @ model.move) * b[at]
        scale[at] = s = a.sum(1)
        alpha[at] = a / s[:, None]
    moves = np.zeros((4, 4))
    for t in range(steps - 1, -1, -1):
        at = first[: alive[t]] + t
        more = alive[t + 1] if t + 1 < steps else 0
        beta[at] = 1.0
        if more:
            nxt = at[:more] + 1
            ahead = b[nxt] * beta[nxt] / scale[nxt][:, None]
            moves += model.move * (alpha[at[:more]].T @ ahead)
            beta[at[:more]] = ahead @ model.move.T
    gamma = alpha * beta
    return gamma / gamma.sum(1, keepdims=True), moves


def parsed(docs: DataFrame) -> DataFrame:
    """The parsed documents, in a table that all later jobs read: doc_id (of a chunk's documents) and the parts of Chunk."""
    key = dict(docs.dtypes)["doc_id"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK)))
                part = b.slice(at, to - at)
                row = parse(part["text"].to_pylist()).row()
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part["doc_id"])
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([x], pa.binary()) for x in row)], ["doc_id", *Chunk.TYPES])
                at = to

    return durable(docs.select("doc_id", "text").mapInArrow(kernel, f"doc_id array<{key}>, " + ", ".join(f"{f} binary" for f in Chunk.TYPES)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1), Chunk.of({f: b[f][i].as_buffer() for f in Chunk.TYPES})


def _count(chunks: DataFrame) -> DataFrame:
    """key, docs, lines, pairs, back of every word, pair and triple of the corpus; key 0 has the numbers of all (document, line) pairs in ``lines``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, c in _read(batches):
            key, *sums = counts_of(c)
            every = len(np.unique(np.repeat(np.arange(len(c.n)), c.n) * np.int64(max(1, len(c.form))) + c.ids))
            cols = [np.append(key.view(np.int64), 0), *(np.append(s, x).astype(np.int64) for s, x in zip(sums, (len(c.n), every, 0, 0)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["key", "docs", "lines", "pairs", "back"])

    parts = chunks.drop("doc_id").mapInArrow(kernel, "key bigint, docs bigint, lines bigint, pairs bigint, back bigint")
    return parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("docs", "lines", "pairs", "back")))


def _round(chunks: DataFrame, model: Model) -> DataFrame:
    """One round's expected counts: (what, key, prose, other), summed over all documents.

    ``what`` is word (documents of the word at place ``key``, by label), emit or move (one row a cell of the tables)
    or rate (lines of prose at a step of RATES).
    """
    sent = chunks.sparkSession.sparkContext.broadcast(model)  # its size is bounded by MIN_SHARE

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        counts, moves = np.zeros((len(STATS), 4, WIDTH)), np.zeros((4, 4))
        words, rates = np.zeros((2, len(model.keys))), np.zeros(len(RATES))
        for _, c in _read(batches):
            if not len(c.ids):
                continue
            bins = model.bins(c)
            gamma, m = posteriors(model.log_emissions(bins)[c.ids], c.n.astype(np.int64), model)
            moves += m
            weight = np.stack([np.bincount(c.ids, gamma[:, k], len(bins)) for k in range(4)], 1)
            for i in range(len(STATS)):
                for k in range(4):
                    counts[i, k] += np.bincount(bins[:, i], weight[:, k], WIDTH)
            rate = model.rates(c)
            rates += np.bincount(np.minimum(np.searchsorted(RATES, rate[rate > 0]), len(RATES) - 1), weight[rate > 0, 0], len(RATES))
            # A document counts once for each of its words, shared between prose and the rest.
            place = model.find(c.hashed)
            word, line = c.words()
            word, line = place[word][place[word] >= 0], line[place[word] >= 0]
            first = np.searchsorted(line, np.arange(len(bins) + 1))
            size = (first[1:] - first[:-1])[c.ids]
            at = np.repeat(first[c.ids] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            cell = np.repeat(np.repeat(np.arange(len(c.n)), c.n), size) * np.int64(max(1, len(model.keys))) + word[at]
            cell, inverse = np.unique(cell, return_inverse=True)
            share = np.bincount(inverse, np.repeat(gamma[:, 0], size), len(cell)) / np.maximum(np.bincount(inverse, minlength=len(cell)), 1)
            words[0] += np.bincount(cell % max(1, len(model.keys)), share, len(model.keys))
            words[1] += np.bincount(cell % max(1, len(model.keys)), 1 - share, len(model.keys))
        some = np.flatnonzero(words.sum(0))
        tables = {"emit": counts.ravel(), "move": moves.ravel(), "rate": rates}
        what = pa.array(np.repeat(["word", *tables], [len(some), *map(len, tables.values())]))
        key = np.concatenate([some, *(np.arange(len(t)) for t in tables.values())])
        prose = np.concatenate([words[0, some], *tables.values()])
        other = np.concatenate([words[1, some], np.zeros(len(prose) - len(some))])
        yield pa.RecordBatch.from_arrays([what, pa.array(key), pa.array(prose), pa.array(other)], ["what", "key", "prose", "other"])

    parts = chunks.drop("doc_id").mapInArrow(kernel, "what string, key bigint, prose double, other double")
    return parts.groupBy("what", "key").agg(F.sum("prose").alias("prose"), F.sum("other").alias("other"))


def fit(chunks: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model trained on all chunks of ``parsed``; what reaches the driver is bounded by MIN_SHARE."""
    model = Model()
    counted = durable(_count(chunks))
    every = counted.where("key = 0").agg(F.sum("lines")).first()[0] or 0
    known = counted.where((F.col("key") != 0) & (F.col("lines") >= max(MIN_LINES, MIN_SHARE * every))).toArrow()
    cols = [known[c].to_numpy() for c in ("key", "docs", "lines", "pairs", "back")]
    model.know(cols[0].astype(np.int64).view(np.uint64), *cols[1:])
    for _ in range(rounds):
        rows = _round(chunks, model).toArrow()
        what, key, prose, other = (rows[c].to_numpy() for c in ("what", "key", "prose", "other"))
        tables = []
        for name, size in (("emit", model.emit.size), ("move", 16), ("rate", len(RATES))):
            table = np.zeros(size)
            table[key[what == name]] = prose[what == name]
            tables.append(table)
        if tables[0].sum() == 0:
            return model
        model.learn(tables[0].reshape(model.emit.shape), tables[1].reshape(4, 4))
        model.learn_rate(tables[2])
        mine = what == "word"
        model.learn_words(key[mine], prose[mine], other[mine])
    return model


RESULT = (
    "n_lines bigint, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_share double, common_share double, "
    + ", ".join(f"{k}_share double" for k in KINDS)
)


def document_quality(docs: DataFrame) -> DataFrame:
    """doc_id, counts, statistics and label shares of every document's lines.

    n_lines counts the lines left after blank lines, cue numbers, times, markup, sounds and adverts are set
    aside. A null, empty or blank text, or one with nothing left, has n_lines 0 and null shares. A text of
    one very long line is one line. Repeated rows stay repeated; other columns are ignored.
    """
    chunks = parsed(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit(chunks))
    key = dict(docs.dtypes)["doc_id"]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for row, c in _read(batches):
            ids, size = c.ids, len(c.n)
            doc = np.repeat(np.arange(size), c.n)
            sums = np.zeros((size, 10))
            if len(ids):
                word, line = c.words()
                place = model.find(c.hashed)
                common = (np.where(place >= 0, model.common[place], False) if len(model.keys) else np.zeros(len(place), bool))[word]
                n = len(c.form)
                figures = [np.bincount(line, minlength=n), *(c.plain[:, j] for j in range(4)), np.bincount(line, common, n)]
                for j, x in enumerate(figures):
                    sums[:, j] = np.bincount(doc, x[ids], size)
                gamma, _ = posteriors(model.log_emissions(model.bins(c))[ids], c.n.astype(np.int64), model)
                for k in range(4):
                    sums[:, 6 + k] = np.bincount(doc, gamma[:, k], size)

            def share(a: np.ndarray, of: np.ndarray) -> pa.Array:
                return pa.array(np.divide(a, of, out=np.zeros(len(a)), where=of > 0), mask=of <= 0)

            count = c.n.astype(float)
            cols = [pa.array(c.n.astype(np.int64)), pa.array(sums[:, 0].astype(np.int64)), share(sums[:, 1], sums[:, 0]), share(sums[:, 2], sums[:, 3]), share(sums[:, 4], count), share(sums[:, 5], sums[:, 0])]
            cols += [share(sums[:, 6 + k], count) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pc.list_flatten(row["doc_id"]), *cols], ["doc_id", *names])

    return chunks.mapInArrow(kernel, f"doc_id {key}, {RESULT}")


def not_speech(docs: DataFrame) -> DataFrame:
    """doc_id of the documents of whose lines less than half are prose, each once."""
    return document_quality(docs).where("prose_share < 0.5").select("doc_id").distinct()
