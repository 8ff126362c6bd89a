"""Line-first cleaning: rules judge every line, failing lines go, and documents that lose too much go.

A line without a word is dropped and costs nothing. A line with words fails when

* symbols: it has at least one of ``#*$%&<>`` per two words;
* navigation: it has three or more of ``|>•»`` and at least one per three words, or
  it has fewer than four words and does not end a sentence (menus, buttons);
* punctuation: a third or more of its words end in doubled ``!`` or ``?``;
* boilerplate: it has at most 25 words and a phrase of :data:`PHRASES`, or it
  repeats an earlier line of the document.

A document is kept when its base figures pass and its failing lines hold at most
half of its words. All figures are integers, so the limits are exact.

Defined results: a null, empty or blank text has no words and is not kept; lines
are judged in order, the first of equal lines is the one that counts; repeated rows
are judged alike; an empty table gives no rows. All columns pass through but one
called ``cleaning``, which is replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.llm.common import SPACE, row_bytes, small_batches

SYMBOLS = "#*$%&|<>"
LINE_SYMBOLS = "#*$%&<>"
SEPARATORS = "|>•»"
PHRASES = [
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "click here",
    "sign up",
    "log in",
    "subscribe to",
    "share this",
    "skip to content",
    "back to top",
    "read more",
]
MAX_PHRASE_WORDS = 25
MIN_WORDS = 50
_SHOUT = re.compile(r"[!?]{2}(?=[\x20\x09-\x0D]|\Z)")
_ENDING = re.compile(r"[.!?…:;\"”’')\]][\x20\x09-\x0D]*\Z")
_PHRASE = re.compile("|".join(PHRASES))
TYPE = (
    "struct<text: string, n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, "
    "n_repeat_words: long, lost_words: long>"
)
FIELDS = ["text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * len(numbers) + ids[2:]
    _, where, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    if not again.any():
        return 0
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def line_fails(line: str, n: int) -> bool:
    """Whether a line of ``n`` words fails a rule."""
    if 2 * sum(map(line.count, LINE_SYMBOLS)) >= n:
        return True
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 3 and 3 * separators >= n:
        return True
    if n < 4 and not _ENDING.search(line):
        return True
    if 3 * len(_SHOUT.findall(line)) >= n:
        return True
    return n <= MAX_PHRASE_WORDS and bool(_PHRASE.search(line.lower()))


def clean_text(text: str | None) -> tuple:
    """The fields of :data:`TYPE` for one text."""
    text = text or ""
    raw = row_bytes(text)
    words = raw.split()
    blanks = sum(map(text.count, SPACE))
    seen: set[str] = set()
    kept, repeats, lost = [], 0, 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8", "surrogatepass").split())
        if not n:
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        if again or line_fails(line, n):
            lost += n
        else:
            kept.append(line)
    symbols = sum(map(text.count, SYMBOLS))
    return "\n".join(kept), len(words), len(text) - blanks, symbols, repeats, repeated_words(words), lost


def _cleaning(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clean_text(t) for t in texts], columns=FIELDS)


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``cleaning``: the cleaned text, the base figures, base_failed and kept."""
    small_batches(docs.sparkSession)
    held = docs.withColumn("cleaning", F.pandas_udf(_cleaning, TYPE)("text"))
    c = F.col("cleaning")
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    kept = ~failed & (2 * c["lost_words"] <= c["n_words"])
    return held.withColumn("cleaning", c.withField("base_failed", failed).withField("kept", kept))
