"""Quality rules on repetition: how many characters lie inside duplicated word n-grams and duplicated lines.

Words are runs of bytes other than ASCII white space. All texts of a chunk are handled at once in numpy: word hashes
come from prefix sums, n-gram hashes roll over the numbers of the words, and equal hashes of one text are found by sorting.
Behind equal hashes the words, lines and n-grams themselves are compared, so none count as equal that are not.
Longer n-grams are only looked for where a shorter one already repeats.

Nulls count as empty texts: no words, ``base_failed``. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placewise.llm import common as C

SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, dup_line_char_share double, worst_ngram int, "
          "worst_ngram_share double, kept boolean")

# The largest accepted share of characters inside duplicated n-grams, per n-gram length.
MAX_NGRAM_SHARE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
MAX_DUP_LINE_CHARS = 0.20
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
FOLD = np.uint64(0xD6E8FEB86659FD93)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  max_ngram_share: dict[int, float] | None = None) -> DataFrame:
    """One row per document with its figures and the verdict ``kept``.

    ``kept`` is false if the base rule fails (under 20 words, or over 30 % of the words in repeated 8-word windows) or
    if the share of characters in duplicated lines, or in duplicated n-grams of one length, is above its limit.
    """
    limits = max_ngram_share or MAX_NGRAM_SHARE
    rows = C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col)
    return C.per_chunk(rows, SCHEMA, lambda batch: {"doc_id": batch.column("doc_id"),
                                                    **measures(batch.column("text"), limits)})


def measures(texts: pa.Array, limits: dict[int, float] = MAX_NGRAM_SHARE) -> dict[str, np.ndarray]:
    """The figures of ``quality_rules`` for every text of an Arrow column."""
    data, offsets = C.text_buffer(texts)
    n = len(offsets) - 1
    start, end, row = C.split_words(data, offsets)
    hashes = C.RangeHash(data)
    counted = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = counted[end] - counted[start]
    out = {"n_words": C.per_row(row, n), "word_chars": C.per_row(row, n, chars)}
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    out["n_symbols"] = symbols[offsets[1:]] - symbols[offsets[:-1]]

    line_again, line_row, line_chars = _lines(data, offsets, hashes, start, row, chars)
    out["n_dup_lines"] = C.per_row(line_row[line_again], n)
    out["dup_line_char_share"] = C.per_row(line_row[line_again], n, line_chars[line_again]) / np.maximum(
        out["word_chars"], 1)

    word = C.same_ranges(data, start, end, hashes.of(start, end))  # equal words have equal numbers
    failed = out["dup_line_char_share"] > MAX_DUP_LINE_CHARS
    worst, worst_share = np.zeros(n, np.int32), np.zeros(n)
    at = np.arange(len(word))
    for size in sorted({WINDOW, *limits}):
        at = at[at + size <= len(word)]
        at = at[row[at] == row[np.minimum(at + size - 1, len(word) - 1)]]
        gram = row[at].astype(np.uint64)
        for j in range(size):
            gram = gram * FOLD + C.mix(word[at + j])
        twice, _ = C.repeated(gram)
        at, gram = at[twice], gram[twice]
        # windows of two texts are never equal
        twice, _ = C.repeated(C.same_ranges(word, at, at + size, C.mix(gram)) * n + row[at])
        at = at[twice]
        edge = np.zeros(len(word) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        covered = np.cumsum(edge[:-1]) > 0
        if size == WINDOW:
            out["n_repeat_words"] = C.per_row(row[covered], n)
        if size in limits:
            share = C.per_row(row[covered], n, chars[covered]) / np.maximum(out["word_chars"], 1)
            failed |= share > limits[size]
            worse = share > worst_share
            worst[worse], worst_share[worse] = size, share[worse]
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
        100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return {**out, "worst_ngram": worst, "worst_ngram_share": worst_share, "kept": ~out["base_failed"] & ~failed}


def _lines(data, offsets, hashes, start, row, chars) -> tuple[np.ndarray, ...]:
    """Lines that hold a word: whether an earlier line of the text is equal, their row, their word characters."""
    breaks = np.flatnonzero(data == 10)
    begins = np.union1d(offsets[:-1], breaks + 1)
    begins = begins[begins < len(data)] if len(data) else begins[:0]
    ends = np.minimum(np.append(begins[1:], len(data)), len(data))
    ends = ends - (data[ends - 1] == 10) if len(begins) else ends
    line = np.searchsorted(begins, start, side="right") - 1
    used, first, which = np.unique(line, return_index=True, return_inverse=True)
    begins, ends = begins[used], ends[used]
    key = C.mix(hashes.of(begins, ends) + C.mix(row[first]))
    again = C.repeated(key)[0]
    again[again] = C.repeated(C.same_ranges(data, begins[again], ends[again], key[again]) * len(offsets) + row[first][again])[1]
    return again, row[first], np.bincount(which, weights=chars, minlength=len(used))
