import re
from collections import Counter

from pyspark.sql import functions as F

from factledger.llm.line_cleaning import clean_lines, clean_text, repeated_words

CLEAN = "\n".join(" ".join(f"word{i}x{k}" for k in range(12)) + "." for i in range(8))


def brute_repeats(words):
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


def test_repeated_words():
    for text in ("a b c a b c", "a a a a", "a a a", "a b", "", "x a b c y a b c z", "p q " * 40, "a b c d e f g"):
        assert repeated_words(text.encode().split()) == brute_repeats(text.split())


def verdicts(make_docs, texts):
    out = clean_lines(make_docs(list(enumerate(texts)))).select("doc_id", "cleaning.*").collect()
    return {r["doc_id"]: r for r in out}


def test_verdicts(make_docs):
    menu = "Home | News | Sport | Contact | About | Help"
    texts = [
        CLEAN,
        CLEAN + "\n" + menu + "\nLog in\nClick here to read the rest.",
        "\n".join(f"Home{i} | News{i} | Sport{i} | Contact{i}" for i in range(20)),
        " ".join(f"word{i}!!" for i in range(80)),
        " ".join(f"word{i}###" for i in range(80)),
        "the same words again and " * 30,
        "too short.",
        None,
        "",
        " \t\n\n",
    ]
    got = verdicts(make_docs, texts)
    assert [got[i]["kept"] for i in range(len(texts))] == [True, True] + [False] * 8
    assert [got[i]["base_failed"] for i in range(len(texts))] == [False] * 5 + [True] * 5
    assert got[1]["text"] == CLEAN and got[7]["n_words"] == 0


def test_figures(make_docs, odd_rows):
    got = verdicts(make_docs, [t for _, t, *_ in odd_rows] + ["é #a\né #a\n \n*$", "a\r\nb\x0bc"])
    for r, text in zip((got[i] for i in sorted(got)), [t for _, t, *_ in odd_rows] + ["é #a\né #a\n \n*$", "a\r\nb\x0bc"], strict=True):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == sum((text or "").count(c) for c in "#*$%&|<>")
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == brute_repeats(words)


def test_repeated_lines_count_once():
    assert clean_text(CLEAN + "\n" + CLEAN)[0] == CLEAN


def test_empty_and_clashing_names(make_docs):
    assert clean_lines(make_docs([])).count() == 0
    clash = make_docs([(1, CLEAN)]).withColumns({c: F.lit(1) for c in ("cleaning", "kept", "n_words")})
    row = clean_lines(clash).first()
    assert row["kept"] == 1 and row["cleaning"]["kept"] is True
