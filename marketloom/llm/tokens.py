"""Token ids from the tokenizers library, with the ids of repeated words kept."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import held


#: Marks that the tokenizer splits from the letters before them, and joins with each other.
MARKS = ".,;:!?*$%&#|\"()"
#: Characters that str.lower might treat unlike the library, or that it takes apart into letters and marks; such texts and words go to it as they are.
OTHER = re.compile("[\u0130\u0180-\U0010ffff]")
_IS_MARK = np.isin(np.arange(256), list(MARKS.encode()))


def _buffers(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts one after another, and where each begins, with the end of the last."""
    _, offsets, data = pa.array(texts, pa.large_string()).buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets


def _rising(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of both, each once, by two sorted runs."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return both[np.diff(both, prepend=-1) > 0]


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts without ASCII white space, the edges of words there, and which of the edges each text begins at, with the end of the last.

    A-Z is lower-cased but in texts with characters of three bytes or from U+0180 on: before a mark a lower-case letter may be one character with it where the upper-case one isn't."""
    data, offsets = _buffers(texts)
    lower = data | (data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
    for k in np.unique(np.searchsorted(offsets, np.flatnonzero(data >= 0xC6), "right") - 1).tolist():
        lower[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
    space = (lower == 32) | (lower - np.uint8(9) < 5)
    spaces = np.flatnonzero(space)
    begins = offsets - np.searchsorted(spaces, offsets)
    edges = _rising(spaces - np.arange(len(spaces)), begins)
    return lower[~space], edges, np.searchsorted(edges, begins)


def _part_edges(data: np.ndarray) -> np.ndarray:
    """Where letters and MARKS meet in UTF-8 bytes; the tokenizer splits there, whatever stands around.

    Letters are those of ASCII and of U+00C0 to U+017F, but for U+0130: its lower case ends with a mark that isn't split from what follows."""
    letter = (data | 32) - np.uint8(97) < 26
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    first, second = data[lead], data[lead + 1]
    lead = lead[~((first == 0xC3) & (second & 0xDF == 0x97) | (first == 0xC4) & (second == 0xB0))]  # signs of multiplication and division
    letter[lead] = letter[lead + 1] = True
    mark = _IS_MARK[data]
    return np.flatnonzero(letter[1:] & mark[:-1] | mark[1:] & letter[:-1]) + 1


def _distinct(edges: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Of the strings between edges in UTF-8 bytes: which of the distinct ones each is, and those."""
    found = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()


class _Rows:
    """Ids of strings, one row after another, and an index by string."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin, self.length, self.asked = (np.zeros(1 << 15, np.int64) for _ in range(3))
        self.used = self.rows = 0

    def find(self, names: list[str]) -> tuple[np.ndarray, list[str]]:
        """The rows of distinct strings, and those that are new: they get the next rows, and their ids are to be added."""
        rows = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(rows < 0)
        new = list(map(names.__getitem__, unknown.tolist()))
        rows[unknown] = np.arange(self.rows, self.rows + len(new))
        self.index.update(zip(new, range(self.rows, self.rows + len(new))))
        return rows, new

    def add(self, ids: np.ndarray, n: np.ndarray, order: np.ndarray | None = None) -> None:
        """New rows of n[k] ids each. order: which of the new rows each is, where they don't come in order."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(n) > len(self.begin):
            self.begin, self.length, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.asked))
        self.ids[self.used : self.used + len(ids)] = ids
        to = slice(self.rows, self.rows + len(n)) if order is None else self.rows + order
        self.begin[to] = self.used + np.cumsum(n) - n
        self.length[to] = n
        self.used, self.rows = self.used + len(ids), self.rows + len(n)

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after another, and where each ends."""
        self.asked[: self.rows] += np.bincount(at, minlength=self.rows)
        size = self.length.take(at)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids.take(np.repeat(self.begin.take(at) - (ends - size), size) + np.arange(total)), ends

    def often(self, most: int, chars: int) -> _Rows:
        """The strings that were asked for most often, at least twice: at most so many, with at most so many characters and ids. Counts begin anew."""
        names = list(self.index)  # in the order of rows
        size = np.maximum(np.fromiter(map(len, names), np.int64, len(names)), self.length[: self.rows])
        asked, least = self.asked[: self.rows], 2
        while len(at := np.flatnonzero(asked >= least)) > most or size[at].sum() > chars:
            least *= 2
        kept = _Rows()
        kept.index.update(zip(map(names.__getitem__, at.tolist()), range(len(at))))
        kept.add(self.joined(at)[0], self.length[at])
        return kept


class WordEncoder:
    """ids of texts by a tokenizer that drops white space and never joins across it.

    The word_bpe files are so: their normaliser turns white space into a space, their splitting drops it.
    A text is therefore the concatenation of its words' ids, and a word is looked up once it is known. Words are made distinct
    in Arrow's columns, so only distinct ones are looked up. A new word is split where letters and marks meet, as the tokenizer does; the parts go to the library, those of letters alone many at once.
    The library finds special strings before it lowers case, so a text with one, in whatever case, goes to it whole.
    ``keep`` bounds the number of words held and ``keep_chars`` their characters, as texts without spaces are words of any length; beyond either, the words are forgotten
    but for those that came most often, which fill half of that at most."""

    def __init__(self, path: str, keep: int = 700_000, keep_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.letters, self.keep, self.keep_chars, self.chars = Tokenizer.from_file(path), Tokenizer.from_file(path), keep, keep_chars, 0
        # Lower-case letters below OTHER are normal already, and white space alone parts them: the library needs none of its patterns there, nor its bytes where they are given.
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(128, 0x180)}
        self.letters.model._resize_cache(0)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.I) if special else None
        self.hint = special[0][:2] if special and all(x[:2] == special[0][:2] for x in special) else ""  # a faster look for what all begin with
        ids = self.library.get_vocab()
        self.ends_word = np.zeros(max(ids.values()) + 1, bool)
        self.ends_word[[i for t, i in ids.items() if t.endswith("</w>")]] = True
        self.words, self.parts = _Rows(), _Rows()

    @staticmethod
    def _ids(library, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> None:
        """Encode new parts. Of joined parts of letters, each ends at the first id that ends a word."""
        plain, latin, rest = [], [], []
        for k, w in enumerate(parts):
            if w.isascii():
                parts[k] = w = w.lower()
                (plain if w.isalpha() else rest).append(k)
            elif OTHER.search(w):
                rest.append(k)
            else:
                parts[k] = w = w.lower()
                (latin if w.isalpha() else rest).append(k)
        order: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []
        batches = [x[i : i + 500] for x in (plain, latin) for i in range(0, len(x), 500)]
        joined = [" ".join(map(parts.__getitem__, x)) for x in batches]
        for part, got in zip(batches, self._ids(self.letters, [x if x.isascii() else x.translate(self.bytes) for x in joined])):
            ids = np.array(got, np.int64)
            to = np.flatnonzero(self.ends_word[ids]) + 1
            if len(to) == len(part) and to[-1] == len(ids):
                order += part
                found.append((ids, np.diff(to, prepend=0)))
            else:
                rest += part
        got = self._ids(self.library, [parts[k] for k in rest])
        found.append((np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got))))
        self.parts.add(*(np.concatenate(x) for x in zip(*found)), np.array(order + rest, np.int64))

    def _learn(self, words: list[str]) -> None:
        """Add new words' ids, from those of their parts."""
        self.chars += sum(map(len, words))
        data, offsets = _buffers(words)
        edges = _rising(_part_edges(data), offsets)
        at, names = _distinct(edges, data)
        rows, new = self.parts.find(names)
        if new:
            self._learn_parts(new)
        ids, ends = self.parts.joined(rows.take(at))
        self.words.add(ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(edges, offsets)]))

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after another, and the number of ids of each text; ``end`` is put behind each text."""
        if len(self.words.index) > self.keep or self.chars > self.keep_chars:
            self.words, self.parts = (x.often(self.keep // 2, self.keep_chars // 2) for x in (self.words, self.parts))
            self.chars = sum(map(len, self.words.index))
        odd = [k for k, t in enumerate(texts) if t and self.hint in t and self.special and self.special.search(t)]
        if odd:
            return self._with_whole(texts, odd, end)
        data, edges, begins = _words(texts)
        at, names = _distinct(edges, data)
        rows, new = self.words.find(names)
        if new:
            self._learn(new)
        ids, ends = self.words.joined(rows.take(at))
        to = np.concatenate([[0], ends])[begins[1:]]
        lengths = np.diff(to, prepend=0)
        if end is None:
            return ids, lengths
        return np.insert(ids, to, np.uint32(end)), lengths + 1

    def _with_whole(self, texts: list[str | None], odd: list[int], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with the texts ``odd`` encoded by the library as they are."""
        whole = set(odd)
        ids, lengths = self.encode([None if k in whole else t for k, t in enumerate(texts)], end)
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for k, found in zip(odd, self._ids(self.library, [texts[k] for k in odd])):
            parts[k] = np.array(found + ([] if end is None else [end]), np.uint32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker."""
    return held(("words", path), lambda: WordEncoder(path))
