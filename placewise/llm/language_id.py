"""Language identification by interpolated Kneser-Ney character models, one per language.

Characters are lower-cased; each run of characters that are no letters is one boundary, and a text starts after three
start marks. The models are fitted on a bounded sample of labelled documents: ``docs_per_lang`` of each language, chosen
by a hash of the id but no more than four in five, and a quarter of that for calibration. n-grams live in sorted arrays of 64-bit hashes shared by all
languages, with one fully interpolated log-probability per language, and contexts likewise with their back-off weights.
A text gets the language with the lowest cross-entropy per character (ties: the smaller name); it is rejected if that is
above the language's calibrated limit, which widens for short texts.

A null text, or one without a letter, is ``und`` and rejected; so is everything if nothing could be learnt. Null
languages and, for training, null texts are left out. Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placewise.llm import common as C
from placewise.session import stage

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean"
ORDER = 4
DOCS_PER_LANG = 1000  # the bound of the training sample, in documents of each language
START, BOUNDARY = 1, 32
UNKNOWN = "und"
CALIBRATED_SHARE = 0.995  # of the calibration documents lie under a third of the limit's distance from the median
LEAST_WIDTH = 0.4  # nats per character; few calibration documents would make the limit too narrow
CHUNK_BYTES = 1 << 19  # text scored at once: a character takes some hundred bytes on the way
SURE_AFTER = 40  # characters after which the score no longer sharpens
STEP = np.uint64(0x9E3779B97F4A7C15)

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts end to end, each after its start marks, and the text each symbol belongs to."""
    marks = "\x01" * (ORDER - 1)
    lowered = [marks + t.lower() for t in texts]
    length = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), length)
    codes = np.where(letters()[points], points, BOUNDARY)
    codes[C.ranges(length) < ORDER - 1] = START
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != BOUNDARY) | (codes[:-1] != BOUNDARY)
    return codes[keep].astype(np.uint64), text[keep]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of symbols that stand side by side (a collision has a chance of about 2**-64 per pair)."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = C.mix(out * STEP + c)
    return out


class Models:
    """Models of all languages in shared hash arrays."""

    def __init__(self, grams: np.ndarray, langs: np.ndarray, counts: np.ndarray, names: list[str]):
        """``grams``: a row of ``ORDER`` symbols per distinct n-gram of a language, with its count."""
        self.names = names
        n = len(names)
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.context_keys: list[np.ndarray] = [np.empty(0, np.uint64)]
        self.context_logs: list[np.ndarray] = [np.empty((0, n))]
        levels = []  # per order: distinct grams, their counts per language
        for k in range(ORDER, 0, -1):
            types, which = np.unique(grams, axis=0, return_inverse=True)
            table = np.zeros((len(types), n))
            np.add.at(table, (which.ravel(), langs), counts)
            levels.append((types, table))
            # a shorter gram counts once for every different symbol before it
            row, langs = np.nonzero(table)
            grams, counts = types[row][:, 1:], np.ones(len(row))
        self.floor = np.full(n, 1.0 / (len(levels[-1][0]) + 1))  # one share for a symbol never seen
        lower = None
        for k, (types, table) in enumerate(reversed(levels), start=1):
            columns = [types[:, i] for i in range(k)]
            once, twice = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
            discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            context = gram_hash(columns[:-1]) if k > 1 else np.zeros(len(types), np.uint64)
            heads, head = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(heads), n)), np.zeros((len(heads), n))
            np.add.at(total, head, table)
            np.add.at(kinds, head, table > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(table - discount, 0) / np.maximum(total[head], 1)
            if k == 1:
                base = np.broadcast_to(self.floor, table.shape)
                self.unseen = np.log(weight[0] * self.floor) if len(heads) else np.log(self.floor)
            else:
                base = lower[C.lookup_sorted(self.keys[-1], gram_hash(columns[1:]))[0]]
                self.context_keys.append(heads)
                self.context_logs.append(np.log(np.maximum(weight, 1e-12)))
            keys = gram_hash(columns)
            order = np.argsort(keys)
            lower = (own + weight[head] * base)[order]
            self.keys.append(keys[order])
            self.logp.append(np.log(np.maximum(lower, 1e-300)))
        self.center = np.zeros(n)
        self.width = np.full(n, np.inf)

    def losses(self, codes: np.ndarray, text: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and the number of characters."""
        at = np.flatnonzero(codes != START)
        length = np.bincount(text[at], minlength=n_texts)
        sums = np.zeros((n_texts, len(self.names)))
        todo = at
        gained = np.zeros((len(at), len(self.names)))
        open_rows = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            place, found = C.lookup_sorted(self.keys[k - 1], gram_hash([codes[todo - j] for j in range(k - 1, -1, -1)]))
            gained[open_rows[found]] += self.logp[k - 1][place[found]]
            todo, open_rows = todo[~found], open_rows[~found]
            if k > 1:
                place, known = C.lookup_sorted(self.context_keys[k - 1], gram_hash([codes[todo - j] for j in range(k - 1, 0, -1)]))
                gained[open_rows[known]] += self.context_logs[k - 1][place[known]]
        gained[open_rows] += self.unseen
        for i in range(len(self.names)):
            sums[:, i] = np.bincount(text[at], weights=gained[:, i], minlength=n_texts)
        return -sums / np.maximum(length, 1)[:, None], length

    def calibrate(self, lang: np.ndarray, loss: np.ndarray, length: np.ndarray) -> None:
        """Limits from documents of known language: three times the distance that nearly all of them keep."""
        for i in range(len(self.names)):
            mine = (lang == i) & (length > 0)
            if mine.any():
                self.center[i] = np.median(loss[mine, i])
                spread = np.maximum(loss[mine, i] - self.center[i], 0) / self.slack(length[mine])
                self.width[i] = max(3 * float(np.quantile(spread, CALIBRATED_SHARE)), LEAST_WIDTH)

    @staticmethod
    def slack(length: np.ndarray) -> np.ndarray:
        return 1 + 20 / np.sqrt(np.maximum(length, 1))

    def predict(self, texts: list[str]) -> dict[str, np.ndarray]:
        """lang_pred, score, cross_entropy (nats per character) and rejected of each text."""
        codes, text = symbols(texts)
        has_letter = np.bincount(text[(codes != START) & (codes != BOUNDARY)], minlength=len(texts)) > 0
        if not self.names:
            has_letter[:] = False
        if not has_letter.any():
            n = len(texts)
            return {"lang_pred": np.full(n, UNKNOWN, object), "score": np.zeros(n), "cross_entropy": np.full(n, np.nan),
                    "rejected": np.ones(n, bool)}
        loss, length = self.losses(codes, text, len(texts))
        best = np.argmin(loss, axis=1)
        least = loss[np.arange(len(texts)), best]
        odds = np.exp(-(loss - least[:, None]) * np.minimum(length, SURE_AFTER)[:, None])
        over = least - self.center[best] > self.width[best] * self.slack(length)
        return {"lang_pred": np.where(has_letter, np.array(self.names, object)[best], UNKNOWN),
                "score": np.where(has_letter, 1 / odds.sum(axis=1), 0.0),
                "cross_entropy": np.where(has_letter, least, np.nan), "rejected": ~has_letter | over}


def fit_models(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               docs_per_lang: int = DOCS_PER_LANG) -> Models:
    """Models from a bounded sample of the labelled documents: the hash of the id decides who is in it."""
    rows = C.narrow(labelled, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Models(np.empty((0, ORDER), np.uint64), np.empty(0, np.int64), np.empty(0), [])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for n in names for x in (n, min(docs_per_lang / sizes[n], 0.8))))[F.col("lang")]
    number = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))[F.col("lang")]
    part = F.when(draw < share, 0).when(draw < 1.25 * share, 1)
    sample = stage(rows.select(number.alias("lang"), "text", part.alias("part")).where("part is not null"), "sample")

    def count(batches):
        for batch in C.chunks(batches, size=CHUNK_BYTES):
            codes, text = symbols(batch.column("text").to_pylist())
            lang = batch.column("lang").to_numpy()[text]
            at = np.flatnonzero(codes != START)
            rows = np.stack([lang[at].astype(np.uint64), *(codes[at - j] for j in range(ORDER - 1, -1, -1))], axis=1)
            packed = np.stack([rows[:, 0], rows[:, 1] << np.uint64(32) | rows[:, 2],
                               rows[:, 3] << np.uint64(32) | rows[:, 4]], axis=1).astype(np.int64)
            found, n = np.unique(packed, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)] + [pa.array(n)],
                                             ["lang", "head", "tail", "n"])

    fitted = sample.where("part = 0").select("lang", "text").mapInArrow(count, "lang long, head long, tail long, n long")
    grams = fitted.groupBy("lang", "head", "tail").agg(F.sum("n").alias("n")).toArrow()
    head, tail = (grams.column(c).to_numpy().astype(np.uint64) for c in ("head", "tail"))
    low = np.uint64(0xFFFFFFFF)
    columns = np.stack([head >> np.uint64(32), head & low, tail >> np.uint64(32), tail & low], axis=1)
    models = Models(columns, grams.column("lang").to_numpy(), grams.column("n").to_numpy().astype(float), names)

    shared = labelled.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for batch in C.chunks(batches, size=CHUNK_BYTES):
            codes, text = symbols(batch.column("text").to_pylist())
            loss, length = shared.value.losses(codes, text, batch.num_rows)
            lang = batch.column("lang").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(loss[np.arange(len(lang)), lang]), pa.array(length)], ["lang", "loss", "length"])

    held = sample.where("part = 1").select(F.col("lang").cast("long"), "text").mapInArrow(
        score, "lang long, loss double, length long").toArrow()
    lang, own, length = (held.column(c).to_numpy() for c in ("lang", "loss", "length"))
    loss = np.zeros((len(lang), len(names)))
    loss[np.arange(len(lang)), lang] = own
    models.calibrate(lang, loss, length)
    return models


def predict_languages(df: DataFrame, models: Models, held_out: Column, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the best among all languages' likelihoods), cross_entropy, rejected."""
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the training sample

    def one(batch):
        found = shared.value.predict([t or "" for t in batch.column("text").to_pylist()])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), **found,
                "lang_pred": pa.array(found["lang_pred"], pa.string()),
                "cross_entropy": pa.array(found["cross_entropy"], from_pandas=True)}

    rows = df.select(df[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), df[text_col].alias("text"))
    return C.per_chunk(rows, SCHEMA, one, size=CHUNK_BYTES)


def keep_identified(df: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """Rows whose text is not rejected, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    return C.keep_rows(df, text_col, lambda column: ~shared.value.predict(
        [t or "" for t in column.to_pylist()])["rejected"], size=CHUNK_BYTES)
