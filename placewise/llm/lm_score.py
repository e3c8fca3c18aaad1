"""Language-model scores of whole texts by a weighted back-off automaton over words.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; every text ends with one end token. Each word seen
``LEAST_SEEN`` times in training is a state, as are the start and the root, which stands for any other history. A state has
an arc for every pair seen ``LEAST_SEEN`` times, weighted with its discounted probability; for other tokens its failure arc
leads to the root, at the cost of the mass the pairs leave over. The root accepts every token with its add-one probability,
an unseen word with that of count 0. Reading a token leads to its own state, or to the root. (A word seen less often could
only have pairs seen less often: as a state it would be the root.)

The automaton grows with the corpus and is never in one place. Documents are written once in blocks, as numbers of the
block's words. Each block sends its words to buckets by their hash and gets back counts and states, sends its pairs to
buckets by theirs and gets back arcs; what arcs take from a history is added up in the bucket of its word.

A null text is empty: one token, the end. A null id counts as empty text in the training rule. Repeated rows count and
score as often as they stand. Without training documents every token has probability 1 / 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placewise.llm import common as C
from placewise.llm.blocks import block_tables, pack, unpack
from placewise.session import stage

SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20  # text whose words, or pairs, one bucket counts, on average
STATE_SHARE = 0.0  # share of the training tokens that a state needs; above 0 the model no longer grows with the corpus
ARC_SHARE = 0.0  # the same for an arc
LEAST_SEEN = 2  # sightings a state or an arc needs at any corpus size
DISCOUNT = 0.5


class Automaton:
    """States 0..n-1 are words, n is the start, -1 the root; token n stands for the end."""

    def __init__(self, words: list[bytes], counts: np.ndarray, pairs: np.ndarray, seen: np.ndarray, n_docs: int,
                 n_tokens: int, n_types: int, sums: np.ndarray | None = None):
        """``pairs`` are history * (n + 1) + token, ascending, with ``seen`` sightings each. Where they are not all pairs
        of their histories, ``sums`` has what ``arc_sums`` gives for all of them, by history."""
        n = len(words)
        self.n, self.n_docs, self.n_tokens = n, n_docs, n_tokens
        self.whole = n_tokens + n_types + 1
        self.arcs = pairs
        counts = np.append(counts, n_docs)
        history, token = pairs // (n + 1), pairs % (n + 1)
        self.weights = np.log10((seen - DISCOUNT) / counts[history])
        if sums is None:
            sums = np.zeros((3, n + 1), np.int64)
            at, found = arc_sums(history, seen, counts[token])
            sums[:, at] = found
        arcs, taken, freed = sums
        left = 1 - (taken - DISCOUNT * arcs) / np.maximum(counts, 1)
        self.failure = np.log10(left * self.whole / (self.whole - freed - arcs))

    def traverse(self, state: np.ndarray, token: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Log-probability of reading each token in its state; ``root`` has the root's weights, token -1 no state."""
        known = (state >= 0) & (token >= 0)
        at, there = C.lookup_sorted(self.arcs, np.where(known, state * (self.n + 1) + token, -1))
        out = root + np.where(state >= 0, self.failure[state], 0.0)
        out[there] = self.weights[at[there]]
        return out


def arc_sums(history: np.ndarray, seen: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Histories of the arcs, which ascend by history, and for each: arcs, their sightings, and their tokens' counts."""
    at, first = np.unique(history, return_index=True)
    if not len(at):
        return at, np.zeros((3, 0), np.int64)
    return at, np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (np.ones(len(history)), seen, count)])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(C.LOWER).split()


def planes(*rows: np.ndarray, kind: type = np.int64) -> bytes:
    """Integers, as many in each row, byte by byte: small if they are."""
    table = np.stack([np.asarray(r, kind) for r in rows])
    raw = np.ascontiguousarray(table.view(np.uint8).reshape(*table.shape, table.itemsize).transpose(0, 2, 1)).tobytes()
    return table.shape[1].to_bytes(8, "little") + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def from_planes(blob: bytes, rows: int, kind: type = np.int64) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], rows * n * size, asbytes=True), np.uint8)
    return np.array(raw.reshape(rows, size, n).transpose(0, 2, 1), order="C").view(kind).reshape(rows, n)


class Block:
    """Tokens of a block's documents: ``token`` is a place in the block's words, their number the end or the start."""

    def __init__(self, docs: bytes, places: bytes, ids: np.ndarray, buckets: int):
        """``ids`` number the words in the corpus, -1 if they are no states; the end has 0."""
        self.docs = unpack(docs)
        held = self.docs.column("held_out").fill_null(True).to_numpy(zero_copy_only=False)
        n = len(ids)
        self.lengths = self.docs.column("n_tokens").to_numpy()
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        inner = np.ones(len(self.doc), bool)
        inner[np.cumsum(self.lengths) - 1] = False
        self.token = np.full(len(self.doc), n, np.int64)
        self.token[inner] = from_planes(places, 1, np.int32)[0]
        self.before = np.concatenate(([n], self.token[:-1]))  # the end of a text is the start of the next
        self.id = np.append(ids, 0)
        both = (self.id[self.before] >= 0) & (self.id[self.token] >= 0)
        self.pairs, which = np.unique((self.before * (n + 1) + self.token)[both], return_inverse=True)
        self.seen = C.per_row(which[~held[self.doc[both]]], len(self.pairs))
        a, b = self.id[self.pairs // (n + 1)], self.id[self.pairs % (n + 1)]
        bucket = (C.mix(C.mix(a) + b.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((b, a, bucket))  # how the pairs are sent to their buckets
        self.buckets, first = np.unique(bucket[self.order], return_index=True)
        self.cuts = np.append(first, len(bucket))


def found_words(parts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Total and state of each word of a block, by place, from what the buckets sent back."""
    got = sorted(zip(parts.column("bucket").to_pylist(), parts.column("data").to_pylist()))
    totals, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for bucket, blob in got:
        total, rank = from_planes(blob, 2)
        totals.append(total)
        ids.append(np.where(rank > 0, (bucket << 32) + rank, -1))
    return np.concatenate(totals), np.concatenate(ids)


def lm_scores(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
              state_share: float = STATE_SHARE, arc_share: float = ARC_SHARE,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document. The model learns from the rows where ``held_out`` is false."""
    rows = df.select(df[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), df[text_col].alias("text"))
    n_docs, n_bytes = rows.agg(F.count_if(~F.col("held_out")),
                               F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = -(-n_bytes // BUCKET_BYTES) or 1

    def encode(batches):
        for number, _, table in block_tables(batches, "text", block_bytes):
            first: dict[bytes, int] = {}
            texts = []
            for text in C.raw_texts(table.column("text")):
                texts.append(np.array([first.setdefault(w, len(first)) for w in words_of(text)], np.int32))
            lengths = np.array([len(t) for t in texts], np.int64)
            token = np.concatenate(texts)
            trained = np.repeat(~table.column("held_out").fill_null(True).to_numpy(zero_copy_only=False), lengths)
            counts = C.per_row(token[trained], len(first))
            words = list(first)
            bucket = np.array([zlib.crc32(w) for w in words], np.int64) % buckets
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            order = order[np.argsort(bucket[order], kind="stable")]
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words))
            docs = pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": lengths + 1})
            kinds, cuts = np.unique(bucket[order], return_index=True)
            sent = [[words[i] for i in order[x:y]] for x, y in zip(cuts, [*cuts[1:], len(order)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * (len(kinds) + 1)), pa.array([-1, *kinds.tolist()], pa.int64()),
                 pa.array([pack(docs)] + [None] * len(kinds), pa.binary()),
                 pa.array([planes(place[token], kind=np.int32)] + [None] * len(kinds), pa.binary()),
                 pa.array([None, *(pa.Codec("zstd").compress(b"\n".join(w), asbytes=True) for w in sent)], pa.binary()),
                 pa.array([None, *(sum(map(len, w)) + len(w) - 1 for w in sent)], pa.int64()),
                 pa.array([None, *(planes(counts[order[x:x + len(w)]]) for x, w in zip(cuts, sent))], pa.binary())],
                ["block", "bucket", "docs", "places", "words", "length", "counts"])

    blocks = stage(rows.mapInArrow(encode, "block long, bucket long, docs binary, places binary, words binary, length long, "
                                           "counts binary"), "blocks")

    def count_words(sent: pa.Table) -> pa.Table:
        """What each block sent, as totals and states (from 1; 0: seen too seldom). A word comes once from a block."""
        number: dict[bytes, int] = {}
        parts = []
        for blob, length in zip(sent.column("words").to_pylist(), sent.column("length").to_pylist()):
            words = pa.Codec("zstd").decompress(blob, length, asbytes=True).split(b"\n")
            parts.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
        counts = np.concatenate([from_planes(d, 1)[0] for d in sent.column("counts").to_pylist()])
        total = C.per_row(np.concatenate(parts), len(number), counts)
        often = np.flatnonzero(total >= LEAST_SEEN)
        state = np.zeros(len(number), np.int64)
        state[often[np.argsort(-total[often], kind="stable")]] = np.arange(1, len(often) + 1)
        n = len(parts)
        return pa.table({"block": sent.column("block"), "bucket": sent.column("bucket"),
                         "data": [planes(total[p], state[p]) for p in parts],
                         "tokens": np.array([total.sum()] + [0] * (n - 1)),
                         "types": np.array([(total > 0).sum()] + [0] * (n - 1))})

    part = "block long, bucket long, data binary"
    words = stage(blocks.where("bucket >= 0").select("block", "bucket", "words", "length", "counts").groupBy("bucket").applyInArrow(
        count_words, part + ", tokens long, types long"), "words")
    tokens, types = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    tokens, types = tokens + n_docs, types + (n_docs > 0)
    least_word, least_pair = max(LEAST_SEEN, state_share * tokens), max(LEAST_SEEN, arc_share * tokens)
    words = words.select("block", "bucket", "data")
    docs = blocks.where("bucket < 0").select("block", "docs", "places")

    def block_of(block: pa.Table, found: pa.Table) -> tuple[Block, np.ndarray]:
        totals, ids = found_words(found)
        ids[totals < least_word] = -1
        return Block(block.column("docs")[0].as_py(), block.column("places")[0].as_py(), ids, buckets), totals

    def list_pairs(block: pa.Table, found: pa.Table) -> pa.Table:
        b, totals = block_of(block, found)
        n, sent = len(totals), b.pairs[b.order]
        a, t, seen = b.id[sent // (n + 1)], sent % (n + 1), b.seen[b.order]
        count, token = np.append(totals, n_docs)[t], b.id[t]
        data = [planes(np.diff(a[x:y], prepend=0), token[x:y], seen[x:y], count[x:y]) for x, y in zip(b.cuts, b.cuts[1:])]
        return pa.table({"block": pa.array(np.full(len(data), block.column("block")[0].as_py())),
                         "bucket": pa.array(b.buckets), "data": pa.array(data, pa.binary())})

    def count_pairs(sent: pa.Table) -> pa.Table:
        """What each block sent, as the sightings of its arcs (0: no arc); without a block, what arcs take from the histories
        of a bucket of words (-1: the start)."""
        parts = [from_planes(d, 4) for d in sent.column("data").to_pylist()]
        cuts = np.cumsum([0, *(p.shape[1] for p in parts)])
        for p in parts:
            np.cumsum(p[0], out=p[0])
        history, token, seen, count = np.concatenate(parts, axis=1)
        del parts
        order = np.lexsort((token, history))
        a, b = history[order], token[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        first = np.flatnonzero(new)
        total = np.add.reduceat(seen[order], first)
        arc = total >= least_pair
        back = np.empty(len(order), np.int64)
        back[order] = np.where(arc, total, 0)[np.cumsum(new) - 1]
        at, sums = arc_sums(a[first][arc], total[arc], count[order][first][arc])
        home, begins = np.unique(np.where(at > 0, at >> 32, -1), return_index=True)
        data = [planes(back[x:y]) for x, y in zip(cuts, cuts[1:])]
        data += [planes(at[x:y] & 0xFFFFFFFF, *sums[:, x:y]) for x, y in zip(begins, [*begins[1:], len(at)])]
        return pa.table({"block": pa.array([*sent.column("block").to_pylist(), *[None] * len(home)], pa.int64()),
                         "bucket": pa.array([*sent.column("bucket").to_pylist(), *home.tolist()], pa.int64()),
                         "data": pa.array(data, pa.binary())})

    pairs = docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(list_pairs, part)
    arcs = stage(pairs.groupBy("bucket").applyInArrow(count_pairs, part), "arcs")

    def add_sums(asked: pa.Table, sums: pa.Table) -> pa.Table:
        """What arcs take from each word that a block has in the bucket."""
        ranks = [from_planes(d, 2)[1] for d in asked.column("data").to_pylist()]
        all_sums = np.zeros((3, max((int(r.max()) for r in ranks), default=0) + 1), np.int64)
        for blob in sums.column("data").to_pylist():
            at, *more = from_planes(blob, 4)
            all_sums[:, at] += more  # a state is once in a part
        return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"),
                         "data": pa.array([planes(*all_sums[:, r]) for r in ranks], pa.binary())})

    takes = arcs.where("block is null")
    start = np.zeros(3, np.int64)
    for r in takes.where("bucket = -1").select("data").toLocalIterator():  # a row of 4 numbers per bucket
        start += from_planes(bytes(r.data), 4)[1:, 0]
    histories = words.groupBy("bucket").cogroup(takes.where("bucket >= 0").groupBy("bucket")).applyInArrow(add_sums, part)
    found = words.withColumn("kind", F.lit("word")).union(
        arcs.where("block is not null").withColumn("kind", F.lit("arc"))).union(histories.withColumn("kind", F.lit("history")))

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        kind = found.column("kind").to_numpy()
        of = {k: found.filter(pa.array(kind == k)) for k in ("word", "arc", "history")}
        b, totals = block_of(block, of["word"])
        n, rows = len(totals), len(b.lengths)
        seen = np.zeros(len(b.pairs), np.int64)
        for bucket, blob in zip(of["arc"].column("bucket").to_pylist(), of["arc"].column("data").to_pylist()):
            at = int(np.searchsorted(b.buckets, bucket))
            seen[b.order[b.cuts[at]:b.cuts[at + 1]]] = from_planes(blob, 1)[0]
        own = sorted(zip(of["history"].column("bucket").to_pylist(), of["history"].column("data").to_pylist()))
        sums = np.concatenate([*(from_planes(blob, 3) for _, blob in own), start[:, None]], axis=1)
        machine = Automaton([b""] * n, totals, b.pairs[seen > 0], seen[seen > 0], n_docs, tokens, types, sums)
        state = np.where(b.id >= 0, np.arange(n + 1), -1)
        count = np.append(totals, n_docs)
        root = np.log10((count + 1) / machine.whole)[b.token]
        weights = machine.traverse(state[b.before], state[b.token], root)
        return pa.table({
            "doc_id": b.docs.column("doc_id"), "held_out": b.docs.column("held_out"), "n_tokens": b.lengths,
            "n_known": C.per_row(b.doc[count[b.token] > 0], rows), "train_tokens": np.full(rows, tokens, np.int64),
            "base_score": np.bincount(b.doc, weights=root, minlength=rows),
            "score": np.bincount(b.doc, weights=weights, minlength=rows)})

    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, SCHEMA)
