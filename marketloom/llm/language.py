"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, described, held, rows, written

LETTERS = regex.compile(r"\p{L}+")
SPACE = "▁"
#: Added to every count of a piece; the probability of a character that no piece has.
SMOOTH, STRANGE = 0.05, 1e-7
KEEP = 400_000
#: Different words that a task counts before it passes their counts on.
COUNTED = 100_000
#: Words of more characters go one by one, letter by letter, with no more than the last few places in memory; shorter ones of one length go together.
CUT = 32


@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return model, {model.id_to_piece(i): k for k, i in enumerate(plain)}, {i: k for k, i in enumerate(plain)}


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class _Trie:
    """The pieces letter by letter: keys are (node, letter) in rising order, child the node that each leads to, row the piece that ends at a node or none."""

    def __init__(self, piece: dict[str, int]):
        nodes: dict[tuple[int, int], int] = {}
        row = [len(piece)]
        for s, k in piece.items():
            at = 0
            for c in map(ord, s):
                at = nodes.setdefault((at, c), len(row))
                if at == len(row):
                    row.append(len(piece))
            row[at] = k
        pairs = sorted(nodes.items())
        self.keys = np.array([n << 21 | c for (n, c), _ in pairs] or [-1], np.int64)
        self.child, self.row = np.array([c for _, c in pairs] or [0], np.int64), np.array(row, np.int64)
        self.of = piece

    def onwards(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a way on by the letter at their side, and the nodes that it leads to."""
        key = node << 21 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        going = np.flatnonzero(self.keys[at] == key)
        return going, self.child[at[going]]


_tries: list[_Trie] = []


def _trie(piece: dict[str, int]) -> _Trie:
    """The trie of a vocabulary, kept for the last one asked for."""
    if not _tries or _tries[0].of is not piece:
        _tries[:] = [_Trie(piece)]
    return _tries[0]


class _Lattice:
    """Words of one length and the pieces that may stand at each place of theirs: spans (begin, end, row of P for every word).

    Rows of P are the pieces, then one for no such piece (0) and one for a character that no piece has."""

    def __init__(self, words: list[str], piece: dict[str, int], longest: int):
        self.n, none, trie = len(words[0]), len(piece), _trie(piece)
        self.spans: list[list[tuple[int, np.ndarray]]] = []
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), self.n).T.astype(np.int64)
        for i in range(self.n):
            here = []
            alive, node = np.arange(len(words)), np.zeros(len(words), np.int64)  # the words of which a piece begins so, and where in the trie they are
            for j in range(i + 1, min(self.n, i + longest) + 1):
                going, node = trie.onwards(node, letters[j - 1][alive])
                alive, rows_of = alive[going], trie.row[node]
                if j == i + 1 or (rows_of != none).any():
                    at = np.full(len(words), none)
                    at[alive] = rows_of
                    if j == i + 1:
                        at[at == none] = none + 1
                    here.append((j, at))
                if not len(alive):
                    break
            self.spans.append(here)


def _steps(s: str, piece: dict[str, int], longest: int) -> Iterator[tuple[list[int], list[int]]]:
    """At each place of a long word, how long the pieces are that may stand there, and their rows of P."""
    get, none = piece.get, len(piece)
    for i in range(len(s)):
        sizes, at = [], []
        for k in range(1, min(longest, len(s) - i) + 1):
            row = get(s[i : i + k])
            if row is not None:
                sizes.append(k)
                at.append(row)
            elif k == 1:
                sizes.append(1)
                at.append(none + 1)
        yield sizes, at


def forward_long(s: str, p: np.ndarray, piece: dict[str, int], longest: int) -> np.ndarray:
    """Log probabilities of a long word for each language. The places that are still open stand in a ring."""
    size = longest + 1
    ring, scale = np.zeros((size, p.shape[1])), np.zeros(p.shape[1])
    ring[0] = 1
    for i, (sizes, at) in enumerate(_steps(s, piece, longest)):
        here = i % size
        value = ring[here].copy()
        ring[here] = 0
        ring[(i + np.array(sizes)) % size] += value * p[at]
        if i % 8 == 7:
            top = ring.max(0)
            top[top <= 0] = 1
            ring /= top
            scale += np.log(top)
    return np.log(np.maximum(ring[len(s) % size], 1e-300)) + scale


def _sweep(steps: Iterator[tuple[list[int], list[int]]], n: int, p: list[float], size: int) -> np.ndarray:
    """Logs of the forward values of one language at all places of a long word: small ones are scaled up as they go."""
    ring, logs, level = [0.0] * size, np.full(n + 1, -np.inf), 0.0
    ring[0] = 1.0
    for i, (sizes, at) in enumerate(steps):
        here = i % size
        value, ring[here] = ring[here], 0.0
        if value <= 0:
            continue
        logs[i] = math.log(value) + level
        if value < 1e-80:
            up = 1 / value
            ring = [x * up for x in ring]
            value, level = 1.0, level - math.log(up)
        for k, row in zip(sizes, at):
            ring[(i + k) % size] += value * p[row]
    if ring[n % size] > 0:
        logs[n] = math.log(ring[n % size]) + level
    return logs


def counts_of_long(s: str, p: np.ndarray, piece: dict[str, int], longest: int) -> dict[int, float]:
    """Rows of P and how often each is expected in a long word under one language: forward from the left, backward as forward over the word turned round."""
    chances, turned = p.tolist(), _Turned(piece)
    forward = _sweep(_steps(s, piece, longest), len(s), chances, longest + 1)
    backward = _sweep(_steps(s[::-1], turned, longest), len(s), chances, longest + 1)[::-1]
    found: dict[int, float] = {}
    for i, (sizes, at) in enumerate(_steps(s, piece, longest)):
        base = forward[i] - forward[-1]
        if base > -math.inf:
            for k, row in zip(sizes, at):
                found[row] = found.get(row, 0.0) + math.exp(base + backward[i + k]) * chances[row]
    return found


class _Turned:
    """The pieces by their letters turned round."""

    def __init__(self, piece: dict[str, int]):
        self.piece = piece

    def get(self, s: str) -> int | None:
        return self.piece.get(s[::-1])

    def __len__(self) -> int:
        return len(self.piece)


class Languages:
    """Piece probabilities of each language over one public vocabulary, and the forward algorithm over words.

    A piece never spans words, so a text's probability is the product of its words' probabilities. A word's is the sum over
    all its segmentations: forward[j] = sum over pieces word[i:j] of forward[i] P(piece). Words' results are kept, KEEP at most."""

    def __init__(self, path: str, names: list[str], counts: np.ndarray):
        self.names = names
        _, self.piece, _ = _pieces(path)
        self.longest = max(map(len, self.piece))
        self.p = probabilities(counts)
        self.kept: dict[str, int] = {}
        self.logs = np.zeros((1 << 14, len(names)))

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities (words, languages) of words of one length."""
        if len(words[0]) > CUT:
            return np.array([forward_long(SPACE + w, self.p, self.piece, self.longest) for w in words])
        lattice = _Lattice([SPACE + w for w in words], self.piece, self.longest)
        a = np.zeros((len(words), lattice.n + 1, len(self.names)))
        a[:, 0] = 1
        scale = np.zeros((len(words), 1))
        for i, spans in enumerate(lattice.spans):
            if i and i % 8 == 0:  # keeps long words in the range of floats
                top = a[:, i : i + self.longest].max((1, 2))[:, None]
                top = np.where(top > 0, top, 1)
                a[:, i : i + self.longest] /= top[:, :, None]
                scale += np.log(top)
            for j, at in spans:
                a[:, j] += a[:, i] * self.p[at]
        return np.log(np.maximum(a[:, lattice.n], 1e-300)) + scale

    def learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for same in by_length.values():
            for k in range(0, len(same), 4096):
                part = same[k : k + 4096]
                n = len(self.kept)
                while n + len(part) > len(self.logs):
                    self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
                self.kept.update(zip(part, range(n, n + len(part))))
                self.logs[n : n + len(part)] = self.forward(part)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language and its posterior probability under equal priors; ("und", 0) without letters."""
        split = [words_of(t) for t in texts]
        if not self.names:
            return [("und", 0.0)] * len(texts)
        if len(self.kept) > KEEP:
            self.kept = {}
        new = {w for ws in split for w in ws if w not in self.kept}
        if new:
            self.learn(sorted(new))
        out = []
        for ws in split:
            if not ws:
                out.append(("und", 0.0))
                continue
            total = self.logs[np.fromiter(map(self.kept.__getitem__, ws), np.int64, len(ws))].sum(0)
            p = np.exp(total - total.max())
            k = int(p.argmax())
            out.append((self.names[k], float(p[k] / p.sum())))
        return out


def probabilities(counts: np.ndarray) -> np.ndarray:
    """P (pieces and two more rows, languages) from counts of pieces."""
    p = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * len(counts))
    return np.vstack([p, np.zeros(counts.shape[1]), np.full(counts.shape[1], STRANGE)])


def expected_counts(words: list[str], times: list[int], p: np.ndarray, piece: dict[str, int], longest: int) -> np.ndarray:
    """How often each piece stands in the words, over all segmentations by their probability under p (rows as in _Lattice, one language): forward, then backward."""
    by_length: dict[int, list[tuple[str, int]]] = {}
    places, amounts = [np.zeros(0, np.int64)], [np.zeros(0)]
    for w, k in zip(words, times):
        if len(w) > CUT:
            found = counts_of_long(SPACE + w, p, piece, longest)
            places.append(np.array(list(found), np.int64))
            amounts.append(np.array(list(found.values())) * k)
        else:
            by_length.setdefault(len(w), []).append((SPACE + w, k))
    for same in by_length.values():
        for k in range(0, len(same), 4096):
            part = same[k : k + 4096]
            lattice = _Lattice([s for s, _ in part], piece, longest)
            forward, backward = np.zeros((2, lattice.n + 1, len(part)))
            forward[0] = backward[lattice.n] = 1
            shares = [[p[at] for _, at in spans] for spans in lattice.spans]
            for i, spans in enumerate(lattice.spans):
                for (j, _), q in zip(spans, shares[i]):
                    forward[j] += forward[i] * q
            weight = np.array([n for _, n in part]) / forward[lattice.n]
            for i in range(lattice.n - 1, -1, -1):
                for (j, at), q in zip(lattice.spans[i], shares[i]):
                    through = q * backward[j]
                    backward[i] += through
                    places.append(at)
                    amounts.append(forward[i] * through * weight)
    return np.bincount(np.concatenate(places), np.concatenate(amounts), len(p))[:-2]


def train(docs: DataFrame, pieces: str, rounds: int = 2, most_languages: int = 500, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages by name and the expected counts of pieces (pieces, languages) over all rows with a language, by expectation-maximisation.

    Words are counted by language in one shuffle and written. A round counts pieces over all segmentations of each word, weighed by their
    probabilities, and the counts are the next round's probabilities; the first starts from Zipf's law over the vocabulary's order. The sums reach
    the driver as at most one number per language and piece; more than ``most_languages`` names are an error. Rows with a null language or text are left out."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        out = lambda: batched(((lang, w, n) for lang, words in by.items() for w, n in words.items()), schema, 20_000)
        for lang, text in rows(batches, "lang", "text"):
            by.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, by.values())) > COUNTED:
                yield from out()
                by = {}
        yield from out()

    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    words = written(known.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    names = [r["lang"] for r in words.select("lang").distinct().limit(most_languages + 1).collect()]
    if len(names) > most_languages:
        raise ValueError(f"more than {most_languages} languages; map their names first")
    names.sort()
    size = len(_pieces(pieces)[1])
    counts = np.tile(1 / (np.arange(size) + 10.0)[:, None] * size, (1, len(names)))
    for _ in range(rounds if names else 0):
        counts = _round(words, pieces, names, counts)
    return names, counts


def _round(words: DataFrame, pieces: str, names: list[str], counts: np.ndarray) -> np.ndarray:
    shared = words.sparkSession.sparkContext.broadcast((names, counts.astype(np.float32)))  # languages x vocabulary: bounded
    schema = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("n", pa.float64())])

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (_, piece, _) = {}, _pieces(pieces)
        longest, totals = max(map(len, piece)), {}
        for b in batches:
            by: dict[str, tuple[list, list]] = {}
            for lang, w, n in rows(iter([b]), "lang", "word", "n"):
                into = by.setdefault(lang, ([], []))
                into[0].append(w)
                into[1].append(n)
            for lang, (ws, times) in by.items():
                if lang not in of:
                    k = shared.value[0].index(lang)
                    of[lang] = probabilities(shared.value[1][:, k : k + 1].astype(float))[:, 0]
                totals[lang] = totals.get(lang, 0) + expected_counts(ws, times, of[lang], piece, longest)
        yield from batched(((lang, int(k), float(t[k])) for lang, t in totals.items() for k in np.flatnonzero(t > 1e-9)), schema, 20_000)

    sums = words.mapInArrow(expect, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(counts.shape)
    at = {x: k for k, x in enumerate(names)}
    out[sums.column("piece").to_numpy(), [at[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], pieces: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (posterior, 0 to 1) for every row. No shuffle.

    Texts that are null or without a letter, and all texts if no language was learned, give "und" with score 0. Repeated rows and null ids stay.
    A kept column named like a result is an error."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, *model))  # languages x vocabulary: bounded
    key = uuid.uuid4().hex
    fields = [("lang_pred", pa.string(), "string"), ("score", pa.float64(), "double")]
    return described(docs, text_col, fields, lambda: held(key, lambda: Languages(*shared.value)).predict, list(keep))
