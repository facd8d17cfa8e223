"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them."""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import described, held, written
from .html_text import STOP

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
LETTER = re.compile(r"[^\W\d_]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
NO_LETTER = re.compile(r"[\W\d_]+")

#: The rules in the order of their votes. A vote is 2 for good, 1 for bad, 0 for none.
RULES = ("symbols", "shouting", "repeated_lines", "repeated_words", "bare_marks", "word_length", "function_words", "sentence_ends", "letters")


def measures(text: str | None) -> dict[str, int]:
    """Exact counts over the whole text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOL.findall(text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated_words(words), "n_lines": len(lines),
        "n_letters": len(LETTER.findall(text)), "n_upper": len(UPPER.findall(text)), "n_bare": sum(1 for w in words if not LETTER.search(w) and not w.isalnum()),
        "n_function": sum(1 for w in words if NO_LETTER.sub("", w.lower()) in STOP), "n_ended": sum(1 for x in lines if x.rstrip()[-1:] in ".!?…:\"”»"),
    }


def repeated_words(words: list[str], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more, its first place included."""
    if len(words) <= size:
        return 0
    number: dict[str, int] = {}
    a = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    key = a[: len(a) - size + 1]
    for k in range(1, size):  # exact: the key is made small again before it can overflow
        key = np.unique(key, return_inverse=True)[1] if k > 1 and int(key.max()) > (1 << 62) // max(1, len(number)) - 1 else key
        key = key * len(number) + a[k : len(a) - size + 1 + k]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(a) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def votes(m: dict[str, int]) -> str:
    """One digit per rule in RULES. Between its two bounds, or without enough to go by, a rule abstains."""
    n, lines, letters = m["n_words"], m["n_lines"], m["n_letters"]
    if not n:
        return "0" * len(RULES)
    high_bad = lambda x, good, bad: "1" if x > bad else "2" if x <= good else "0"
    low_bad = lambda x, bad, good: "1" if x < bad else "2" if x >= good else "0"
    mean = m["word_chars"] / n
    return "".join(
        (
            high_bad(m["n_symbols"] / n, 0.02, 0.15),
            high_bad(m["n_upper"] / letters, 0.15, 0.4) if letters >= 10 else "0",
            high_bad(m["n_dup_lines"] / lines, 0.1, 0.3) if lines > 2 else "0",
            high_bad(m["n_repeat_words"] / n, 0.05, 0.2) if n > 20 else "0",
            high_bad(m["n_bare"] / n, 0.02, 0.1),
            "1" if not 2 <= mean <= 14 else "2" if 3 <= mean <= 9 else "0",
            low_bad(m["n_function"] / n, 0.01, 0.08) if n >= 30 else "0",
            low_bad(m["n_ended"] / lines, 0.1, 0.6) if n >= 30 else "0",
            low_bad(letters / max(1, m["word_chars"]), 0.65, 0.88),
        )
    )


def fit(patterns: dict[str, int], rounds: int = 60, prior_votes: float = 5.0) -> dict[str, float]:
    """The probability that a text is good for every pattern of votes, by expectation-maximisation over how often patterns occur.

    Each rule has an unknown accuracy on good and on bad texts, P(vote bad | quality) among its votes; an abstention says nothing.
    A few imagined votes of the right sign start each rule and keep it the right way round."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    v = np.array([[int(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    bad_vote, voted = (v == 1).astype(float), (v > 0).astype(float)
    prior = np.tile(np.array([[0.02], [0.4]]), (1, v.shape[1]))  # P(vote bad) on good and on bad texts, before any is seen
    p_bad, share = prior.copy(), 0.9
    for _ in range(rounds):
        log = [np.log(s) + bad_vote @ np.log(p) + (voted - bad_vote) @ np.log(1 - p) for s, p in ((share, p_bad[0]), (1 - share, p_bad[1]))]
        good = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        share = float(np.clip((good @ n + 9) / (n.sum() + 10), 0.05, 0.995))
        for k, w in enumerate((good * n, (1 - good) * n)):
            p_bad[k] = (w @ bad_vote + prior_votes * prior[k]) / (w @ voted + prior_votes)
        p_bad = np.clip(p_bad, 1e-4, 1 - 1e-4)
        p_bad[1] = np.maximum(p_bad[1], p_bad[0])
    return dict(zip(keys, good.tolist()))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, threshold: float = 0.5, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with the counts, base_failed, votes, p_good and kept for every row.

    Votes of all rows are counted by pattern (at most 3 ** 9) and weighed on the driver. A row is kept if the base rules (10 words or more, at most 20 %
    repeated words) hold and p_good reaches the threshold. Null texts count as empty: all counts 0, base_failed. Rows with a
    null id and repeated rows are judged one by one. An empty table gives no rows. A kept column named like a result is an error."""
    spark = docs.sparkSession
    fields = [*((c, pa.int64(), "long") for c in COUNTS), ("votes", pa.string(), "string")]

    def measure(texts: list[str | None]) -> list[tuple]:
        return [(*(m[c] for c in COUNTS), votes(m)) for m in map(measures, texts)]

    measured = written(described(docs, text_col, fields, lambda: held("quality", lambda: measure), list(keep)))
    patterns = {r["votes"]: r["n"] for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    table = spark.createDataFrame(list(fit(patterns).items()) or [("", 0.5)], "votes string, p_good double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.join(F.broadcast(table), "votes", "left").withColumn("base_failed", failed)
    return judged.select(*keep, *COUNTS, "base_failed", "votes", "p_good", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))
