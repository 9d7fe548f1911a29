"""Quality rules: clean line by line, then reject documents that lose too much.

Every line with a word is held against these rules, in this order; the first
that it breaks removes it:

* ``navigation``: separators (``| > » · •``) for at least a fifth of its words;
* ``symbols``: over 30 symbols ``#*$%&<>`` per 100 words;
* ``shouting``: at least 10 letters, over half of them upper case;
* ``stutter``: over 30 of 100 words equal the word before them;
* ``repeated``: equal to an earlier line of the document;
* ``boilerplate``: under 60 words and holds a phrase of ``PHRASES``;
* ``punctuation``: no word of it ends as a sentence does.

A document whose removed lines hold over ``max_loss`` of its word characters is
rejected, as is one that fails the base rules. Null and empty texts have no
words, fail the base and are rejected; rows are judged one by one, so repeated
rows get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorlab.llm.common import SPACE, map_arrow, slices

# Phrases of page furniture, lower case.
PHRASES = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "lorem ipsum",
    "privacy policy",
    "sign up for",
    "skip to content",
    "subscribe to",
    "terms of service",
    "terms of use",
)
#: Share of a document's word characters that its removed lines may hold, per cent.
MAX_LOSS = 60
#: Words of a window, and the words below which a document fails.
WINDOW, LEAST_WORDS = 8, 20

RULES = (
    "navigation",
    "symbols",
    "shouting",
    "stutter",
    "repeated",
    "boilerplate",
    "punctuation",
)

_SYMBOL = re.compile(r"[#*$%&|<>]")
_LINE_SYMBOL = re.compile(r"[#*$%&<>]")
_SEPARATOR = re.compile(r"[|>»·•]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
# Sentence terminals of the world's scripts, marks that may close a sentence behind
# them, and letters of scripts that end sentences by a space (Thai, Lao, Tai Tham and others).
TERMINALS = (
    ".!?…:;‼‽⁇⁈⁉。！？｡．：；︒﹒﹖﹗"
    "؟؛۔।॥։՞՜׃܀܁܂߹۝።፤፧፨။၊។៕៖།༎᠃᠉෴᙮᥄᥅᪨᪩᪪᪫᭚᭛᭞᭟᰻᰼᱾᱿⸮⸼꓿꘎꘏꛳꛷꡶꡷꣎꣏꤯꧈꧉꩝꩞꩟꫰꫱꯫"
)
CLOSING = "\"'”’»›)」』】〉》〕〗）］｝｣＂＇"
UNSTOPPED = "\u0e01-\u0e2e\u0e81-\u0eae\u1950-\u1974\u1980-\u19ab\u1a20-\u1a54\uaa80-\uaaaf"
_END = re.compile(rf"[{TERMINALS}][{CLOSING}\]]*(?:[\x20\x09-\x0D]|$)|[{UNSTOPPED}]")

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_failed_lines long, lost_chars long, base_failed boolean, kept boolean, cleaned string"
)


def line_rule(line: str, words: list[bytes], seen: bool) -> str | None:
    """The first rule that a line with words breaks."""
    n = len(words)
    if 5 * len(_SEPARATOR.findall(line)) >= n:
        return "navigation"
    if 100 * len(_LINE_SYMBOL.findall(line)) > 30 * n:
        return "symbols"
    letters = len(_LETTER.findall(line))
    if letters >= 10 and 2 * len(_UPPER.findall(line)) > letters:
        return "shouting"
    if 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n:
        return "stutter"
    if seen:
        return "repeated"
    if n < 60:
        lower = line.lower()
        if any(phrase in lower for phrase in PHRASES):
            return "boilerplate"
    if not _END.search(line):
        return "punctuation"
    return None


def visible(text: str) -> int:
    """Code points of the words of a text."""
    return len(text) - sum(text.count(c) for c in SPACE)


def repeated_words(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that stand in a window found twice or more in that text.

    ``codes`` numbers the words of all texts in a row, equal words alike. Windows
    of 2, 4 and 8 words are numbered in turn, each as a pair of shorter ones, so
    equal numbers mean equal words.
    """
    total = len(codes)
    owner = np.repeat(np.arange(len(counts)), counts)
    if total < WINDOW:
        return np.zeros(len(counts), np.int64)
    window = codes.astype(np.int64)
    width = 1
    while width < WINDOW:
        window = pd.factorize(window[:-width] * total + window[width:])[0].astype(np.int64)
        width *= 2
    inside = owner[: len(window)] == owner[WINDOW - 1 :]
    place = np.flatnonzero(inside)
    numbers = pd.factorize(owner[place] * (total + 1) + window[place])[0]
    twice = np.bincount(numbers)[numbers] > 1 if len(numbers) else np.zeros(0, bool)
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, place[twice], 1)
    np.add.at(edge, place[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(counts))


def clean_texts(texts: list[str], max_loss: int = MAX_LOSS) -> list[tuple]:
    """Rows of ``SCHEMA`` for texts."""
    split = [t.encode().split() for t in texts]
    counts = np.fromiter((len(w) for w in split), np.int64, len(split))
    codes = pd.factorize(np.array([w for ws in split for w in ws], dtype=object))[0]
    repeats = repeated_words(codes, counts).tolist()
    out = []
    for text, words, repeat in zip(texts, split, repeats):
        n, chars = len(words), visible(text)
        seen: set[str] = set()
        kept_lines, dup, failed, lost = [], 0, 0, 0
        for line in text.split("\n"):
            line_words = line.encode().split()
            if line_words:
                again = line in seen
                seen.add(line)
                dup += again
                if line_rule(line, line_words, again):
                    failed += 1
                    lost += visible(line)
                    continue
            kept_lines.append(line)
        base = n < LEAST_WORDS or 100 * repeat > 30 * n
        kept = not base and 100 * lost <= max_loss * chars
        out.append(
            (
                *(n, chars, len(_SYMBOL.findall(text)), dup, repeat, failed, lost, base, kept),
                "\n".join(kept_lines),
            )
        )
    return out


def clean_lines(df: DataFrame, text: str = "text", max_loss: int = MAX_LOSS) -> DataFrame:
    """Add the counts, the verdict ``kept`` and the text without failed lines, ``cleaned``.

    Columns of the table with a name of ``SCHEMA`` are replaced.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    rest = [c for c in df.columns if c not in names or c == text]
    place = df.select(*rest).schema
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in place])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(rest.index(text))
        texts = ["" if x is None else x for x in column.to_pylist()]
        rows: list[tuple] = []
        for a, b in slices([x.encode() for x in texts]):
            rows += clean_texts(texts[a:b], max_loss)
        kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.string()]
        new = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*rest, *names])

    return map_arrow(df.select(*rest), run, f"{types}, {SCHEMA}")


def keep_clean(df: DataFrame, text: str = "text", max_loss: int = MAX_LOSS) -> DataFrame:
    """Documents that the rules keep, without their failed lines; all other columns as they are."""
    at = df.columns.index(text)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(at).to_pylist()]
        rows: list[tuple] = []
        for a, b in slices([x.encode() for x in texts]):
            rows += clean_texts(texts[a:b], max_loss)
        columns = list(batch.columns)
        columns[at] = pa.array([row[-1] for row in rows], pa.string())
        whole = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        return whole.filter(pa.array([row[-2] for row in rows], pa.bool_()))

    return map_arrow(df, run, types)
