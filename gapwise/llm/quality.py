"""Quality rules under weak supervision: rules vote or abstain, EM estimates how accurate each is."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.llm.common import checkpoint, in_arrow, texts

_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_plain", "n_marks", "n_ends"]

#: A word of letters (of any script, as bytes beyond ASCII), with quotes, brackets or punctuation around it at most.
_PLAIN = re.compile(rb"(?<!\S)[\"'(\[]*[A-Za-z\x80-\xff]+(?:['-][A-Za-z\x80-\xff]+)*[.,;:!?\"')\]]*(?!\S)")
_NOT_MARKS = bytes(range(0x80, 0x100)) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + _SPACES


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Number of words in n-word windows that the text holds twice or more, the first included."""
    m = len(words) - n + 1
    if m < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:m].copy()
    for j in range(1, n):  # ranks stay below the number of windows, so a pair of them fits in a long
        code = code * (len(number) + 1) + ids[j : j + m]
        if j < n - 1:
            code = np.unique(code, return_inverse=True)[1].reshape(-1)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(m, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
    points = len(text) - len(text.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return (
        len(words), len(text) - points - (len(text) - len(text.translate(None, _SPACES))), len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), repeat_words(words), len(lines), upper, letters, len(_PLAIN.findall(text)), len(text.translate(None, _NOT_MARKS)),
        sum(x.rstrip(_SPACES).endswith((b".", b"!", b"?", b":", b'"')) for x in lines),
    )


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text; zeros for null or empty ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([measure(x) for x in texts(batch.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(len(COUNTS)))], names=["doc_id", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").transform(in_arrow, count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _ratio(a: str, b: str):
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good, bad):
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. At most 9 of them, so that there are 3 ** 9 patterns at most."""
    n, word_len = F.col("n_words"), _ratio("word_chars", "n_words")
    symbols, dup = _ratio("n_symbols", "n_words"), _ratio("n_dup_lines", "n_lines")
    repeat, upper, plain = _ratio("n_repeat_words", "n_words"), _ratio("n_upper", "n_letters"), _ratio("n_plain", "n_words")
    marks, ends = _ratio("n_marks", "word_chars"), _ratio("n_ends", "n_lines")
    return [
        _vote(n >= 100, n < 50).alias("v_length"),
        _vote(word_len.between(3, 10), ~word_len.between(2, 14)).alias("v_word_length"),
        _vote(symbols < 0.02, symbols > 0.1).alias("v_symbols"),
        _vote((dup < 0.05) & (F.col("n_lines") >= 4), dup > 0.3).alias("v_dup_lines"),
        _vote(repeat < 0.05, repeat > 0.3).alias("v_repeats"),
        _vote(upper < 0.2, upper > 0.6).alias("v_upper"),
        _vote(plain > 0.9, plain < 0.6).alias("v_plain_words"),
        _vote(marks < 0.06, marks > 0.12).alias("v_marks"),
        _vote(ends > 0.8, ends < 0.3).alias("v_line_ends"),
    ]


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 200, prior: float = 0.8, accuracy: float = 0.8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good for each vote pattern (rows of -1, 0, 1, seen n times); rates of -1, 0, 1 of each rule among good and bad texts.

    Each rule has its own rates by class (with a pseudo-count), so that abstaining may tell something as well.
    The start says that a rule's vote is right with probability ``accuracy``, which keeps the classes' meaning.
    """
    m = patterns.shape[1]
    start = np.array([1 - accuracy, 0.5, accuracy]) / 1.5
    rate = np.stack([np.tile(start, (m, 1)), np.tile(start[::-1], (m, 1))])  # class (good, bad), rule, vote
    pseudo = rate * 20
    pi, hot, post = prior, np.eye(3)[patterns + 1], np.zeros(len(n))
    for _ in range(rounds):
        ll = np.stack([np.log(p) + np.einsum("rmv,mv->r", hot, np.log(rate[c])) for c, p in enumerate((pi, 1 - pi))])
        new = 1 / (1 + np.exp(np.clip(ll[1] - ll[0], -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        for c, w in enumerate((post, 1 - post)):
            got = np.einsum("r,rmv->mv", w * n, hot) + pseudo[c]
            rate[c] = got / got.sum(axis=1, keepdims=True)
        pi = float(np.clip((post @ n + 8) / (n.sum() + 10), 1e-6, 1 - 1e-6))
        if done:
            break
    return post, rate[0], rate[1]


def weak_supervision(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: counts, votes' posterior quality and whether it is kept.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior. Null and empty
    texts have no words and fail the base rule; texts of any length are measured whole; repeated rows, and rows whose
    rules vote alike, are judged alike; an empty table gives an empty result; further columns are ignored. EM sees all
    rows, as counts of at most 3 ** 9 vote patterns.
    """
    rules = votes()
    names = [f"v{k}" for k in range(len(rules))]
    seen = checkpoint(counts(docs).select("*", *(r.alias(v) for r, v in zip(rules, names, strict=True))))
    got = seen.groupBy(*names).count().orderBy(*names).toPandas()
    patterns, n = got[names].to_numpy(np.int64).reshape(-1, len(names)), got["count"].to_numpy(np.float64)
    post, _, _ = expectation_maximisation(patterns, n) if len(n) else (np.empty(0), None, None)
    spark = docs.sparkSession
    rows = [(*map(int, p), float(x)) for p, x in zip(patterns, post, strict=True)]
    model = spark.createDataFrame(rows, ", ".join(f"{v} int" for v in names) + ", posterior double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.join(F.broadcast(model), names, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= least)).alias("kept"), "posterior"
    )
