"""Removal of repeated passages: byte windows of a threshold length that also start in a document with a smaller id.

Depth-limited radix sort: suffixes are told apart only through the threshold length, most significant digits first, and
those alone in their class drop out after each pass; the classes left at the end are exactly the repeated windows.

* The first digit is a part of the window, two thirds of it, that the content itself picks: the one with the
  smallest hash among all parts of that length. Equal windows pick equal parts, and neighbouring windows mostly the same
  one, so a text has one such digit for every nine bytes or so. Digits are exchanged as sorted integers, and those
  found in one document only drop out with all their windows. The answer names a digit by its place in what was sent.
* The last digit is the rest of the window. Runs of remaining windows go, as text, to the first block that holds their
  digit, where the windows are sorted through the threshold length and compared byte by byte.

Windows that repeat inside a block are settled there, and only one of each leaves it, so a group of copies costs one copy
per block. Runs whose digit is in more than ``NEAR`` blocks are dealt by the digit, not to its first block, so that what is
common does not gather at the first blocks. Beyond ``HOT`` blocks each window goes on its own, by the hash of the whole
window, so that its documents do not meet in one task; that sends its bytes many times over, a run only once. Nothing is
capped: a digit's width follows the input size, and a false match of two digits only costs the comparison.

Matches never cross documents. A null text is empty. A document with a null id has no order: it is kept whole and takes
nothing from others. Documents that share an id take nothing from each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from placewise.llm import common as C
from placewise.llm.blocks import blocks_of, expand, from_planes, pack, pack_blocks, planes, squeeze, unpack

DEPTH = 50
BLOCK_BYTES = 1 << 20
BLOCKS_PER_HOME = 4  # blocks whose shared windows meet in one task
GROUP = 8  # blocks at most that send and get what they exchange as one row
PLACE_BITS = 40  # of a place in a block; above them stands the number of the block in its group
NEAR = 128  # blocks that share a digit; beyond, its runs do not go to the first of them
HOT = 1 << 16  # blocks that share a digit (some 60 bytes of each meet in one task); beyond, its windows travel one by one
SPARE_BITS = 8  # of a digit, beyond those that number all digits: one in 256 or fewer matches another by chance
PIECE = 1 << 18  # bytes hashed or windows sorted at once
SORTED = 1 << 22  # windows whose hashes can lose the bits of a place and still hardly ever meet by chance
BUCKET = 1 << 20  # digits sorted by one task
LOCAL, ALONE = -1, -2  # homes of digits that only one block holds, and of those that travel window by window

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
                 block_bytes: int = BLOCK_BYTES, hot: int = HOT, near: int = NEAR) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs and the SHA-256 of the rest."""
    def digest(table, data, offsets, removed):
        begins = removed & ~np.concatenate(([False], removed[:-1])) if len(removed) else removed
        begins[offsets[:-1][offsets[:-1] < len(removed)]] |= removed[offsets[:-1][offsets[:-1] < len(removed)]]
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (removed, begins)]
        kept = [hashlib.sha256(k).hexdigest() for k in _kept(data, offsets, removed)]
        gone, spans = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": np.diff(offsets), "n_removed": gone,
                         "n_spans": spans, "kept_sha256": pa.array(kept, pa.string())})

    rows = C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col)
    return _dedup(rows, "doc_id", "text", depth, block_bytes, hot, near, SCHEMA, digest)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
                   depth: int = DEPTH) -> DataFrame:
    """The same rows and columns with what is left of each text; a character cut in half goes with the cut.

    ``length_col``, if given, becomes the number of characters left. A null text stays null.
    """
    def replaced(table, data, offsets, removed):
        kept = pa.array([k.decode("utf-8", "ignore") for k in _kept(data, offsets, removed)], pa.string())
        texts = pa.array([k if had else None for k, had in
                          zip(kept.to_pylist(), table.column(text_col).is_valid().to_pylist())], pa.string())
        new = {text_col: texts}
        if length_col:
            new[length_col] = pc.utf8_length(texts).cast(table.schema.field(length_col).type)
        return pa.table({c: new.get(c, table.column(c)) for c in table.column_names})

    return _dedup(df, id_col, text_col, depth, BLOCK_BYTES, HOT, NEAR, df.schema, replaced)


def _dedup(df: DataFrame, id_col: str, text_col: str, depth: int, block_bytes: int, hot: int, near: int, schema,
           finish: Callable) -> DataFrame:
    blocks = pack_blocks(df, text_col, block_bytes, sort_by=id_col)
    n_blocks, total, most = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0)), F.max("n_bytes")).first()
    group = max(min(n_blocks // 64, GROUP, GROUP * 2 * block_bytes // max(most or 0, 1)), 1)  # few or long ones go alone
    meeting = max(1, n_blocks // BLOCKS_PER_HOME)
    digits = max(2 * total // (depth - digit_length(depth) + 2), 1)
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket_bits = max(int(digits // BUCKET), partitions - 1, 15).bit_length()  # no partition idles
    homes = 1 << bucket_bits
    bits = min(max(int(digits).bit_length(), bucket_bits) + SPARE_BITS, 62)

    def windows(table):
        ids = table.column(id_col)
        data, offsets = C.text_buffer(table.column(text_col))
        return data, offsets, ids.to_numpy(), ids.is_valid().to_numpy()

    def send_digits(batches):
        numbers, keys = [], []
        for number, table in blocks_of(batches):
            data, offsets, ids, valid = windows(table)
            starts, doc, digit = first_digits(data, offsets, valid, depth)
            runs, short = digit_runs(doc, digit, bits)
            owner = ids[doc[runs]]
            order = np.argsort(short, kind="stable")  # ids ascend within a block, and stay so within a digit
            short, owner = short[order], owner[order]
            first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1]))[:len(short)])
            last = np.append(first[1:], len(short)) - 1
            numbers.append(number)
            keys.append(short[first] << 1 | (owner[first] != owner[last[:len(first)]]))
            if len(numbers) == group:
                yield digits_sent(numbers, keys)
                numbers, keys = [], []
        if numbers:
            yield digits_sent(numbers, keys)

    def digits_sent(numbers, keys):
        cuts = np.array([np.searchsorted(k >> (bits - bucket_bits + 1), np.arange(homes + 1)) for k in keys])
        full = np.flatnonzero(np.diff(cuts).sum(axis=0))
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array([numbers] * len(full), pa.list_(pa.int64())),
             pa.array([squeeze(cuts[:, b + 1] - cuts[:, b], ascend=False) for b in full], pa.binary()),
             pa.array([squeeze(np.concatenate([k[c[b]:c[b + 1]] for k, c in zip(keys, cuts)])) for b in full], pa.binary())],
            ["bucket", "blocks", "counts", "keys"])

    def match_digits(table: pa.Table) -> pa.Table:
        number = np.concatenate([np.array(n, np.int64) for n in table.column("blocks").to_pylist()])
        counts = np.concatenate([expand(c, ascend=False) for c in table.column("counts").to_pylist()])
        keys = np.concatenate([expand(k) for k in table.column("keys").to_pylist()])
        by_number = np.argsort(number)  # blocks of one group stand together
        rank = np.empty(len(number), np.int32)
        rank[by_number] = np.arange(len(number))
        source, place = np.repeat(rank, counts), C.ranges(counts)
        number = number[by_number]
        order = np.argsort(keys >> 1, kind="stable")
        short = keys[order] >> 1
        first = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1])))
        size = np.diff(np.append(first, len(short)))
        several = np.bitwise_or.reduceat(keys[order] & 1, first) > 0
        home = np.where(size > near, short[first], np.minimum.reduceat(number[source[order]], first))
        home = (C.mix(home) % np.uint64(meeting)).astype(np.int64)
        home = np.where(size > hot, ALONE, np.where(size == 1, LOCAL, home))
        stays = np.repeat((size > 1) | several, size)
        place, home, source = place[order][stays], np.repeat(home, size)[stays], source[order][stays]
        order = np.argsort(source, kind="stable")
        place, home, source = place[order], home[order], source[order]
        cuts = np.append(np.flatnonzero(np.diff(number // group, prepend=-1)), len(number))
        ends = np.searchsorted(source, cuts)
        parts = [(a, b, c, d) for a, b, c, d in zip(cuts, cuts[1:], ends, ends[1:]) if d > c]
        return pa.table({
            "group": pa.array([number[a] // group for a, *_ in parts], pa.int64()),
            "bucket": pa.array(np.full(len(parts), table.column("bucket")[0].as_py()), pa.int32()),
            "blocks": pa.array([number[a:b] for a, b, *_ in parts], pa.list_(pa.int64())),
            "counts": pa.array([squeeze(np.bincount(source[c:d] - a, minlength=b - a), ascend=False) for a, b, c, d in parts],
                               pa.binary()),
            "places": pa.array([squeeze(place[c:d]) for *_, c, d in parts], pa.binary()),
            "homes": pa.array([squeeze(home[c:d] - ALONE, ascend=False) for *_, c, d in parts], pa.binary())})

    def send_windows(group_blocks: pa.Table, found: pa.Table) -> pa.Table:
        out = {"home": [], "block": [], "state": [], "payload": []}
        texts, runs_of = [], []
        found = found.sort_by("bucket")
        counts = [expand(c, ascend=False) for c in found.column("counts").to_pylist()]
        owner, bucket, place, answer = (np.concatenate([np.empty(0, np.int64), *x]) for x in (
            (np.repeat(np.array(n, np.int64), c) for n, c in zip(found.column("blocks").to_pylist(), counts)),
            (np.full(c.sum(), b) for b, c in zip(found.column("bucket").to_pylist(), counts)),
            (expand(p) for p in found.column("places").to_pylist()),
            (expand(h, ascend=False) + ALONE for h in found.column("homes").to_pylist())))
        for number, table in blocks_of(group_blocks.to_batches()):
            mine = np.flatnonzero(owner == number)
            if not len(mine):
                continue
            data, offsets, ids, valid = windows(table)
            starts, doc, digit = first_digits(data, offsets, valid, depth)
            runs, short = digit_runs(doc, digit, bits)
            sent = _distinct(short)
            known = sent[np.searchsorted(sent >> (bits - bucket_bits), bucket[mine]) + place[mine]]
            home = answer[mine]
            at, there = C.lookup_sorted(known, short)
            size = np.diff(np.append(runs, len(doc)))
            home, there = np.repeat(home[at[there]], size[there]), np.repeat(there, size)
            starts, doc = starts[there], doc[there]
            del digit, at, there, known, sent, mine, runs, short, size
            names = C.RangeHash(data).of(starts, starts + depth)
            head = equal_windows(data, starts, names, depth)
            own = head == np.arange(len(head))
            out["home"].append(-1 - number)
            out["block"].append(number)
            out["state"].append(True)
            out["payload"].append(pack(pa.table({"start": [squeeze(starts[~own])], "head": [squeeze(starts[head[~own]])]})))
            starts, doc, home, names = starts[own], doc[own], home[own], names[own]
            alone = home == ALONE
            home = np.where(alone, meeting + (C.mix(names) % np.uint64(homes)).astype(np.int64), home)
            begin = np.ones(len(starts), bool)
            begin[1:] = (starts[1:] != starts[:-1] + 1) | (home[1:] != home[:-1]) | alone[1:]
            begin = np.flatnonzero(begin)
            end = starts[np.append(begin[1:], len(starts)) - 1] + depth if len(begin) else begin
            home, doc, begin = home[begin], doc[begin], starts[begin]
            leaves = home != LOCAL
            home, doc, begin, length = home[leaves], doc[leaves], begin[leaves], (end - begin)[leaves]
            runs_of.append((home, ids[doc], begin + (number % group << PLACE_BITS), length, begin + sum(map(len, texts))))
            texts.append(data)
        if runs_of:
            home, owner, place, length, begin = (np.concatenate(x) for x in zip(*runs_of))
            data = np.concatenate(texts)
            order = np.argsort(home, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], home[order][1:] != home[order][:-1]))) if len(order) else []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                part = order[a:b]
                text = data[np.repeat(begin[part], length[part]) + C.ranges(length[part])]
                out["home"].append(int(home[part[0]]))
                out["block"].append(number)
                out["state"].append(False)
                out["payload"].append(pack_segments(owner[part], place[part], length[part], text))
        return pa.table({"home": pa.array(out["home"], pa.int64()), "block": pa.array(out["block"], pa.int64()),
                         "state": pa.array(out["state"], pa.bool_()), "payload": pa.array(out["payload"], pa.binary())})

    def match_windows(table: pa.Table) -> pa.Table:
        if table.column("state")[0].as_py():  # what a block has settled inside: it goes back to that block
            return table.select(["block", "state", "payload"])
        parts = [unpack_segments(p) for p in table.column("payload").to_pylist()]
        number = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        ids, start, length, text = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ids, kind="stable")
        at = np.cumsum(length) - length
        data = text[np.repeat(at[order], length[order]) + C.ranges(length[order])]
        offsets = np.concatenate(([0], np.cumsum(length[order])))
        del parts, text
        flagged = later_windows(data, offsets, ids[order], depth)
        segment = np.searchsorted(offsets, flagged, side="right") - 1
        source = number[order[segment]]
        position = start[order[segment]] + flagged - offsets[segment]
        out = [(int(table.column("block")[int(i)].as_py()), p) for i, p in by_source(source, position)]
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()),
                         "state": pa.array([False] * len(out), pa.bool_()),
                         "payload": pa.array([squeeze(p) for _, p in out], pa.binary())})

    def apply(group_blocks: pa.Table, news: pa.Table) -> pa.Table:
        if not group_blocks.num_rows:
            raise ValueError("news of a block that does not exist")
        states = [(to, unpack(payload)) for to, payload in zip(*(
            news.filter(news.column("state")).column(c).to_pylist() for c in ("block", "payload")))]
        found = news.filter(pc.invert(news.column("state"))).column("payload")
        hits = np.concatenate([np.empty(0, np.int64), *(expand(p.as_py()) for p in found)])
        return pa.concat_tables([settle(table, [s for to, s in states if to == number],
                                        hits[hits >> PLACE_BITS == number % group] & (1 << PLACE_BITS) - 1)
                                 for number, table in blocks_of(group_blocks.to_batches())])

    def settle(table: pa.Table, states: list[pa.Table], hits: np.ndarray) -> pa.Table:
        data, offsets, ids, valid = windows(table)
        hit = np.zeros(len(data) + 1, bool)
        hit[hits] = True
        for s in states:
            start, head = expand(s.column("start")[0].as_py()), expand(s.column("head")[0].as_py())
            owner = np.searchsorted(offsets, np.concatenate((start, head)), side="right") - 1
            later = ids[owner[:len(start)]] > ids[owner[len(start):]]
            hit[start[later | hit[head]]] = True
        edge = np.zeros(len(data) + depth + 1, np.int32)
        at = np.flatnonzero(hit)
        edge[at] += 1
        edge[at + depth] -= 1
        return finish(table, data, offsets, np.cumsum(edge)[:len(data)] > 0)

    by_group = blocks.withColumn("group", F.expr(f"block div {group}"))
    sent = blocks.mapInArrow(send_digits, "bucket int, blocks array<long>, counts binary, keys binary")
    found = sent.groupBy("bucket").applyInArrow(
        match_digits, "group long, bucket int, blocks array<long>, counts binary, places binary, homes binary")
    moved = by_group.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(
        send_windows, "home long, block long, state boolean, payload binary")
    news = moved.groupBy("home").applyInArrow(match_windows, "block long, state boolean, payload binary")
    news = news.withColumn("group", F.expr(f"block div {group}"))
    return by_group.groupBy("group").cogroup(news.groupBy("group")).applyInArrow(apply, schema)


def digit_length(depth: int) -> int:
    """Bytes of the first digit: about two thirds of the window. Longer ones repeat less often by chance, shorter ones are
    fewer: a text has two for each depth - length + 2 bytes."""
    return 2 * depth // 3 + 1


def first_digits(data: np.ndarray, offsets: np.ndarray, valid: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Start of every window, its document and the hash of its first digit."""
    gram = digit_length(depth)
    span = depth - gram + 1
    counts = np.where(valid, np.maximum(np.diff(offsets) - depth + 1, 0), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    starts = offsets[doc] + C.ranges(counts)
    digit = np.empty(len(starts), np.uint64)
    done = begin = 0
    while begin < len(counts):
        end = max(int(np.searchsorted(offsets, offsets[begin] + PIECE, side="right")) - 1, begin + 1)
        part = data[offsets[begin]:offsets[end]]
        n = int(counts[begin:end].sum())
        if n:
            least = _sliding_min(C.RangeHash(part).windows(gram), span)
            digit[done:done + n] = least[starts[done:done + n] - offsets[begin]]
        done, begin = done + n, end
    return starts, doc, digit


def digit_runs(doc: np.ndarray, digit: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of windows of one document with one digit begin, and ``bits`` bits of each run's digit.

    A digit is a minimum of hashes, and minima crowd near zero: it is mixed again before bits are taken.
    """
    runs = np.flatnonzero(np.concatenate(([True], (digit[1:] != digit[:-1]) | (doc[1:] != doc[:-1])))[:len(doc)])
    return runs, (C.mix(digit[runs]) >> np.uint64(64 - bits)).astype(np.int64)


def by_source(source: np.ndarray, position: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each source and its different positions, ascending: one sort, however many sources there are."""
    bits = int(position.max(initial=0)).bit_length()
    if int(source.max(initial=0)).bit_length() + bits < 64:
        both = _distinct(source.astype(np.int64) << bits | position)
        source, position = both >> bits, both & (1 << bits) - 1
    else:
        order = np.lexsort((position, source))
        source, position = source[order], position[order]
        new = (source[1:] != source[:-1]) | (position[1:] != position[:-1])
        new = np.concatenate(([True], new))[:len(source)]
        source, position = source[new], position[new]
    first = np.flatnonzero(np.concatenate(([True], source[1:] != source[:-1]))[:len(source)])
    return [(int(source[a]), position[a:b]) for a, b in zip(first, np.append(first[1:], len(source)))]


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """``np.unique``, which hashes integers since numpy 2.3, at the speed of a sort."""
    numbers = np.sort(numbers)
    return numbers[np.concatenate(([True], numbers[1:] != numbers[:-1]))[:len(numbers)]]


def _sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def equal_windows(data: np.ndarray, starts: np.ndarray, names: np.ndarray, depth: int) -> np.ndarray:
    """For each window the first (in the given order) that has the same bytes. ``names`` are hashes of the windows."""
    bits = np.uint64(max(len(names) - 1, 1).bit_length())
    if len(names) <= SORTED:  # numbers sort faster than places: a window's place stands in the low bits of its hash
        ranked = np.sort(names >> bits << bits | np.arange(len(names), dtype=np.uint64))
        order = (ranked & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        ranked >>= bits
    else:
        order = np.argsort(names, kind="stable")
        ranked = names[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))[:len(order)]
    head = np.empty(len(order), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    twins = np.flatnonzero(head != np.arange(len(head)))
    same = np.ones(len(twins), bool)
    for at in range(0, len(twins), PIECE):
        some = slice(at, at + PIECE)
        a, b = starts[twins[some]], starts[head[twins[some]]]
        for place in [*range(0, depth - 7, 8), max(depth - 8, 0)]:
            same[some] &= _eight(data, a + place, depth) == _eight(data, b + place, depth)
    for w in twins[~same]:  # two windows with one hash: look for an equal one among that hash's others
        rivals = np.flatnonzero(names == names[w])
        text = data[starts[w]:starts[w] + depth].tobytes()
        head[w] = next(r for r in rivals if data[starts[r]:starts[r] + depth].tobytes() == text)
    return head


def _eight(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes (or as many as a short window has) from each place on, as one integer."""
    if depth < 8:
        out = np.zeros(len(at), np.uint64)
        for i in range(depth):
            out = out << np.uint64(8) | data[at + i].astype(np.uint64)
        return out
    return np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))[at]


def later_windows(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of windows whose bytes also stand in a segment with a smaller id (segments come in order of ids).

    Windows are sorted by parts of their hash range, one part at a time: memory follows the text, not the windows.
    """
    counts = np.diff(offsets) - depth + 1
    starts = np.repeat(offsets[:-1], counts) + C.ranges(counts)
    names = C.RangeHash(data).of(starts, starts + depth)
    parts = max(1, len(starts) // (8 * PIECE))
    out = []
    for p in range(parts):
        mine = np.flatnonzero(names % np.uint64(parts) == p) if parts > 1 else np.arange(len(names))
        head = equal_windows(data, starts[mine], names[mine], depth)
        owner = ids[np.searchsorted(offsets, starts[mine], side="right") - 1]
        out.append(starts[mine[owner > owner[head]]])
    return np.sort(np.concatenate(out))


def pack_segments(ids: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> bytes:
    """Ids, places and texts as one compressed piece; there are many, most of them small."""
    steps = [planes(np.diff(x.astype(np.int64), prepend=np.int64(0))) for x in (ids, start, length)]
    raw = b"".join((*steps, text.tobytes()))
    head = np.array([len(ids), len(raw)], np.int64).tobytes()
    return head + pa.Codec("zstd", 6).compress(raw, asbytes=True)


def unpack_segments(blob: bytes) -> tuple[np.ndarray, ...]:
    n, size = np.frombuffer(blob[:16], np.int64)
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[16:], size, asbytes=True), np.uint8)
    return (*(np.cumsum(from_planes(raw[8 * n * i:8 * n * (i + 1)])) for i in range(3)), raw[24 * n:])


def _kept(data: np.ndarray, offsets: np.ndarray, removed: np.ndarray) -> list[bytes]:
    """What is left of each document."""
    left = data[~removed].tobytes()
    gone = np.concatenate(([0], np.cumsum(removed)))
    at = (offsets - gone[offsets]).tolist()
    return [left[a:b] for a, b in zip(at, at[1:])]
