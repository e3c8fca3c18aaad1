"""Near-duplicates by SimHash: fingerprints within two bits, found through Golay-code keys.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most two bits agree in one whole
segment (pigeonhole), and in each other segment they differ in at most two bits. The perfect binary Golay code maps every
23-bit word to one codeword; the codewords of a word and of its neighbours at one bit are its fuzzy keys, six at most,
and two words within two bits share one of them: the word half-way. So a key is an exact segment together with a fuzzy
key of the next one, about 16 keys a fingerprint, and candidates of a key are verified on all 64 bits.

Equal fingerprints are one class from the start, so copies never meet in a join. A key passes on only the links that
hold its fingerprints together, not all pairs; its work is linear in its size.

Nulls: a null text is empty, a document without words has fingerprint zero and is linked like any other; a null id takes
part but is never a component's id (null if nothing else is reachable). Repeated rows give repeated results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from placewise.llm import common as C
from placewise.llm.components import connected_components
from placewise.session import stage

SEED = 42
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
GOLAY = 0b101011100011  # generator polynomial of the [23, 12] code
SMALL = 64  # runs up to this length are compared pair by pair, longer ones by looking up all near words


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 values of the text's word shingles (repeats count)."""
    words = text.translate(C.LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash_fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, **ids: Column) -> DataFrame:
    """The given long columns and fp, the fingerprint as a signed long."""
    names = list(ids)

    def one(batch):
        fps = [fingerprint(t, shingle) for t in C.raw_texts(batch.column("text"))]
        return {**{c: batch.column(c) for c in names}, "fp": pa.array(np.array(fps, np.uint64).view(np.int64))}

    rows = df.select(df[text_col].alias("text"), *(col.cast("long").alias(name) for name, col in ids.items()))
    return C.per_chunk(rows, ", ".join(f"{c} long" for c in (*names, "fp")), one)


def _syndromes() -> np.ndarray:
    """Remainders of all 23-bit single bits; the remainder of a word is their exclusive or."""
    out, word = [], 1
    for _ in range(23):
        out.append(word)
        word <<= 1
        if word >> 11:
            word ^= GOLAY
    return np.array(out, np.int64)


def _corrections() -> np.ndarray:
    """The error of up to three bits that each of the 2,048 remainders stands for."""
    bits, table = _syndromes(), np.zeros(2048, np.int64)
    for k in (1, 2, 3):
        for places in combinations(range(23), k):
            rest = 0
            for p in places:
                rest ^= int(bits[p])
            table[rest] = sum(1 << p for p in places)
    return table


def golay_index(words: np.ndarray) -> np.ndarray:
    """Number (12 bits) of the codeword nearest to each 23-bit word."""
    rest = np.zeros(words.shape, np.int64)
    for p, r in enumerate(_syndromes()):
        rest ^= ((words >> p) & 1) * r
    return (words ^ _corrections()[rest]) >> 11


def fingerprint_keys(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): pairs within ``max_bits`` share at least one key."""
    fps = fps.astype(np.uint64)
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for i, part in enumerate(parts):
        j = (i + 1) % 3
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))] if max_bits else [0], np.int64)
        fuzzy = np.sort(golay_index(parts[j][:, None] ^ flips[None, :]), axis=1)
        new = np.ones(fuzzy.shape, bool)
        new[:, 1:] = fuzzy[:, 1:] != fuzzy[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(i) << 60) | (part[row] << 12) | fuzzy[row, col])
    return np.concatenate(rows), np.concatenate(keys)


class Forest:
    """Sets of numbers, joined many pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.settle()

    def settle(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up


def run_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between equal keys' fingerprints within ``max_bits`` (rows sorted by key, then fingerprint).

    Each fingerprint is linked to the smallest one its key connects it with; others are left out.
    """
    fps = fps.astype(np.uint64)
    forest = Forest(len(fps))
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.append(begin, len(keys)))
    left = np.repeat(length, length) - C.ranges(length)  # rows of the run from here on
    left[np.repeat(length > SMALL, length)] = 0
    for step in range(1, SMALL):
        at = np.flatnonzero(left > step)
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= max_bits
        forest.join(at[near], at[near] + step)
    words = [0, *(1 << p for p in range(64))] if max_bits == 1 else [
        0, *(1 << p for p in range(64)), *((1 << p) | (1 << q) for p, q in combinations(range(64), 2))]
    for k in np.flatnonzero(length > SMALL):
        run = fps[begin[k]:begin[k] + length[k]]
        varying = np.bitwise_or.reduce(run ^ run[0])
        for word in words:
            if word & ~int(varying):
                continue
            there = np.searchsorted(run, run ^ np.uint64(word))
            hit = np.flatnonzero(run[np.minimum(there, len(run) - 1)] == run ^ np.uint64(word))
            forest.join(begin[k] + hit, begin[k] + there[hit])
    linked = np.flatnonzero(forest.parent != np.arange(len(fps)))
    return fps[linked].view(np.int64), fps[forest.parent[linked]].view(np.int64)


def simhash_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that hold every component together."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("three segments with fuzzy keys find pairs of up to two bits")

    def spread(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 1 << 15):
                part = fps[at:at + (1 << 15)]
                row, key = fingerprint_keys(part, max_bits)
                order = np.argsort(part.view(np.uint64)[row], kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array(key[order]), pa.array(part[row][order])], ["key", "fp"])

    def link(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(n):
            a, b = run_links(keys[:n], fps[:n], max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy()))
            fps = np.concatenate((fps, batch.column("fp").to_numpy()))
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last key may go on in the next batch
            yield out(whole)
            keys, fps = keys[whole:], fps[whole:]
        yield out(len(keys))

    # signed order of fp with the top bit flipped is the unsigned order run_links relies on
    keyed = classes.select("fp").mapInArrow(spread, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", F.col("fp").bitwiseXOR(F.lit(-1 << 63)))
    return dealt.mapInArrow(link, "a long, b long").distinct()


def _components(prints: DataFrame, order: Column, max_bits: int) -> DataFrame:
    """fp, first (the least ``order`` in its component) and class_size (rows with this fingerprint)."""
    classes = stage(prints.groupBy("fp").agg(F.min(order).alias("first"), F.count("*").alias("class_size")), "classes")
    if not max_bits:
        return classes
    roots = connected_components(simhash_links(classes, max_bits))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first", "class_size", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return stage(rooted.drop("first").join(least, "root").drop("root"), "components")


def simhash_near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable through links), class_size.

    ``class_size`` is the number of documents that share the fingerprint.
    """
    prints = stage(simhash_fingerprints(df, text_col, shingle, doc_id=df[id_col]), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")
    named = _components(prints, first, max_bits).select("fp", F.col("first.doc_id").alias("component_id"), "class_size")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size")


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id, of equal ids any one.

    The rows get numbers of their own, written with them, since ids may repeat or be null.
    """
    number = "_row_number_"
    while number in df.columns:
        number += "_"
    rows = stage(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
    prints = stage(simhash_fingerprints(rows, text_col, shingle, id=rows[id_col], number=rows[number]), "fingerprints")
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "number")
    kept = _components(prints, first, max_bits).select(F.col("first.number").alias(number)).distinct()
    return rows.join(kept, number, "left_semi").drop(number)
