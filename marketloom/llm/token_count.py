"""Token counts with a shortcut for pre-tokens that are one token."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, rows

#: The splitting rule of byte-level BPE vocabularies (a fixed value of the public file format).
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class TokenCounter(dict):
    """Chunk of text -> its number of tokens under a byte-level BPE file of the tokenizers library.

    ``whole`` has the vocabulary strings that are proven to encode alone as one token: the library itself, given the
    string, returns exactly one id. A pre-token in it counts as one; only the rest is merged, by the library.
    Special strings are found first, as the library's default has it. ``keep`` bounds the chunks held and ``keep_chars`` their characters."""

    def __init__(self, path: str, keep: int = 400_000, keep_chars: int = 16_000_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.keep, self.keep_chars, self.chars = Tokenizer.from_file(path), keep, keep_chars, 0
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        self.whole = self.prove()

    def prove(self) -> frozenset[str]:
        """The strings of the vocabulary that are one pre-token and that the library encodes alone as one id."""
        texts = self.library.decode_batch([[i] for i in range(self.library.get_vocab_size(with_added_tokens=False))], skip_special_tokens=False)
        texts = [t for t in texts if t and "�" not in t and t not in self.added and (m := PRE_TOKEN.match(t)) and m.end() == len(t)]
        return frozenset(t for t, e in zip(texts, self.library.encode_batch_fast(texts, add_special_tokens=False)) if len(e) == 1)

    def merged(self, pre_tokens: list[str]) -> int:
        rest = [p for p in pre_tokens if p not in self.whole]
        n = len(pre_tokens) - len(rest)
        return n + sum(map(len, self.library.encode_batch_fast(rest, add_special_tokens=False))) if rest else n

    def __missing__(self, chunk: str) -> int:
        n = 1 if chunk in self.whole else self.merged(PRE_TOKEN.findall(chunk))
        self[chunk] = n
        self.chars += len(chunk)
        return n

    def ordinary(self, text: str) -> int:
        """Text without special strings. A single space starts a new chunk: no pre-token goes over it from the left.
        Where spaces stand together they may be one pre-token, so such texts are split by the whole rule."""
        if not text:
            return 0
        if "  " in text:
            return self.merged(PRE_TOKEN.findall(text))
        first, *others = text.split(" ")
        return (self[first] if first else 0) + sum(map(self.__getitem__, [" " + x for x in others]))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > self.keep or self.chars > self.keep_chars:
            self.clear()
            self.chars = 0
        if self.special and any(a in text for a in self.added):
            return sum(1 if p in self.added else self.ordinary(p) for p in self.special.split(text))
        return self.ordinary(text)


def counter(path: str) -> TokenCounter:
    """One counter for each Python worker; the proof runs once there."""
    return held(("counts", path), lambda: TokenCounter(path))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row.

    Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids are kept. No shuffle; other columns are ignored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            n = [c.count(t) for (t,) in rows(iter([b]), "text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], schema=_OUT)

    text = F.col(text_col)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return chosen.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
