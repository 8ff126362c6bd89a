"""Texts that contain words of a table, by an automaton over the words.

All words are looked for in one walk over a text (Aho-Corasick), so the work is linear
in the texts, however many words there are, and no row is made per place of a text. A
word table of bounded size goes to every task, which builds the automaton once. A
larger one is cut into parts by hash; texts, in chunks, then meet every part, and one
task holds one part and one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factledger.operators.joins import table_bytes

#: Bytes of words that one automaton is built of.
PART_BYTES = 8 << 20
#: Bytes of texts that meet a part of a cut word table in one task.
CHUNK_BYTES = 64 << 20
PAIRS = "text string, word string"


def automaton(words: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in words:
        found.add_word(word, word)
    found.make_automaton()
    return found


def _pairs(texts: pd.Series, words: ahocorasick.Automaton) -> pd.DataFrame:
    """Every text with each distinct word in it."""
    out: list[tuple[str, str]] = []
    if len(words):
        for text in texts:
            out += [(text, word) for word in sorted({word for _, word in words.iter(text)})]
    return pd.DataFrame(out, columns=["text", "word"])


def containing(
    texts: DataFrame, text: str, words: DataFrame, word: str, part_bytes: int = PART_BYTES, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Pairs of distinct ``text`` and distinct ``word`` such that the text contains the word; all contain the empty word."""
    held = texts.select(F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    asked = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct()
    size = table_bytes(asked)
    some = asked.filter("word <> ''")
    if size <= part_bytes:
        listed = [r["word"] for r in asked.toLocalIterator()]
        sent = held.sparkSession.sparkContext.broadcast(sorted(w for w in listed if w))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            built = automaton(sent.value)
            for batch in batches:
                yield _pairs(batch["text"], built)

        found = held.mapInPandas(scan, PAIRS)
        return found.unionByName(held.withColumn("word", F.lit(""))) if "" in listed else found

    parts = -(-size // part_bytes)
    chunks = max(1, -(-table_bytes(held) // chunk_bytes))
    dealt_words = some.select(
        "word", F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    )
    dealt_texts = held.select(
        "text", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod(F.xxhash64("text"), F.lit(chunks)).alias("chunk")
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _pairs(left["text"], automaton(right["word"].tolist()))

    group = ["part", "chunk"]
    found = dealt_texts.groupBy(*group).cogroup(dealt_words.groupBy(*group)).applyInPandas(meet, PAIRS)
    blank = asked.filter("word = ''").limit(1)
    return found if blank.isEmpty() else found.unionByName(held.withColumn("word", F.lit("")))
