"""Random forests of 0/1 labels whose rows and trees never stand in one place.

Feature values become numbers of bins. A node with many rows is split as a job: tasks count their own rows by feature, bin
and label, and only the counts move. Once a node has at most ``LOCAL`` rows, they are sent to one task, which grows all that
is below it; these parts of trees, of bounded size, are the rows of a written table. The driver holds the nodes above them,
a few for every ``LOCAL`` rows and tree. Scoring sends rows to the parts in the same way.

Where a whole tree is such a part, a task gets the rows once for all trees of a group and draws from them itself; scored rows
meet the group's trees likewise, and only their sums are sent on.

Counts are whole numbers and draws are fixed by the place of a row and the number of a node, so the same settled rows give
the same forest in any order of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placewise.session import stage

LOCAL = 1 << 23  # rows of a node (with copies) below which one task grows it
MEET = 1 << 21  # scored rows that meet a tree at once
SLICE = 1 << 17  # rows whose nodes are split at once
GROUPS = 24  # of whole trees, each grown by one task and adding up its scores; fixed, as sums depend on their order
SPREAD = 117  # tasks that numbers below GROUPS are dealt to: their hashes fall on different ones
CHUNK = 1 << 15  # rows packed together
OPEN = 1 << 12  # nodes split in one pass over the rows
MESSAGES = 1 << 22  # bytes a task hands on at once
BAG = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]  # Poisson(1): chance of at most k copies
NO_SPLIT = 1e-12  # gain, beside the node's purity, that is not one of rounding


@dataclass
class Top:
    """The nodes above the parts; node ``t`` is the root of tree ``t``. ``feature`` is -1 where a part begins."""

    tree: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    size: np.ndarray

    def walk(self, bins: np.ndarray, tree: int) -> np.ndarray:
        """The node whose part each row (a column of ``bins``) belongs to."""
        return _walk(self.feature, self.cut, self.left, bins, np.full(bins.shape[1], tree))


@dataclass
class Forest:
    """``parts``: (node, nodes), the tree below a node of ``top``. ``importances``: shares of the gain, one a feature."""

    cuts: list[np.ndarray]
    num_trees: int
    top: Top
    parts: DataFrame
    importances: np.ndarray

    def score(self, df: DataFrame, features: str, out: str = "probability_1") -> DataFrame:
        """``df`` with the mean over the trees of the share of label 1 in the row's leaf."""
        top, num_trees = self.top, self.num_trees
        rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "forest_rows")
        chunks = stage(_chunks(rows.select(features, F.lit(0).alias("label"), "_row"), features, self.cuts), "forest_chunks")
        deals = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // MEET + 1
        if len(top.tree) == num_trees:
            return rows.join(_whole_scores(chunks, self.parts, num_trees, deals, out), "_row").select(*df.columns, out)

        def send(batches):
            def messages():
                for chunk, _, _, bins, _ in _unchunk(batches):
                    deal = int(_mix(np.array([chunk], np.uint64))[0]) % deals
                    for tree in range(num_trees):
                        at = top.walk(bins, tree)
                        for node, pick in _groups(at):
                            yield int(node), deal, chunk, _pack(pick.astype(np.int32), bins[:, pick])

            yield from _batches(messages(), ["node", "deal", "chunk", "payload"])

        def meet(rows: pa.Table, part: pa.Table) -> pa.Table:
            if not rows.num_rows or not part.num_rows:  # a tree that drew no row has no say
                return pa.table({"chunk": [], "node": [], "payload": []}, _schema("chunk long, node int, payload binary"))
            words, share = _unpack_nodes(part.column("nodes")[0].as_py())
            out = []
            for blob in rows.column("payload").to_pylist():
                pick, bins = _unpack(blob)
                out.append(_pack(pick, share[_leaves(words, _records_of(bins))]))
            return pa.table({"chunk": rows.column("chunk"), "node": rows.column("node"), "payload": out},
                            _schema("chunk long, node int, payload binary"))

        def add_up(chunk: pa.Table, news: pa.Table) -> pa.Table:
            ids = _unpack(chunk.column("ids")[0].as_py())[0]
            total, voters = np.zeros(len(ids)), np.zeros(len(ids))
            for blob in news.sort_by("node").column("payload").to_pylist():  # one order, one sum
                pick, share = _unpack(blob)
                total[pick] += share
                voters[pick] += 1
            return pa.table({"_row": ids, out: total / voters})

        tasks = _tasks(df, num_trees)
        parts = self.parts.select("node", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "nodes")
        sent = chunks.mapInArrow(send, "node int, deal long, chunk long, payload binary").repartition(tasks, "node", "deal")
        parts = parts.withColumn("deal", F.col("deal").cast("long")).repartition(tasks, "node", "deal")
        news = sent.groupBy("node", "deal").cogroup(parts.groupBy("node", "deal")).applyInArrow(
            meet, "chunk long, node int, payload binary")
        found = chunks.select("chunk", "ids").groupBy("chunk").cogroup(news.groupBy("chunk")).applyInArrow(
            add_up, f"_row long, {out} double")
        return rows.join(found, "_row").select(*df.columns, out)


def fit_forest(rows: DataFrame, features: str, label: str, weights: list[float], num_trees: int, max_depth: int, max_bins: int,
               seed: int) -> Forest:
    """A forest of bootstrapped trees over a column of vectors. ``rows`` are settled: the place of a row fixes its draws.

    Each node tries the square root of the number of features, all cuts between their bins, and takes the greatest gain in
    Gini impurity, with rows weighted by label; on ties the first feature and the lowest cut. Neighbouring leaves of a
    part with the same majority become one.
    """
    cuts = _cuts(rows, features, max_bins)
    n_features, n_bins = len(cuts), max([len(c) for c in cuts], default=0) + 1
    tries = ceil(sqrt(n_features))
    placed = rows.select(features, F.col(label).cast("int").alias("label"), F.monotonically_increasing_id().alias("_row"))
    chunks = stage(_chunks(placed, features, cuts), "forest_chunks")
    n_rows = chunks.agg(F.sum("n")).first()[0]
    roots = np.arange(num_trees)
    top = Top(roots, np.full(num_trees, -1), np.zeros(num_trees, int), np.full(num_trees, -1), np.zeros(num_trees, int),
              np.full(num_trees, n_rows))
    gains = np.zeros((num_trees, n_features))
    closed = np.zeros(num_trees, bool)
    while True:
        wide = np.flatnonzero((top.feature < 0) & ~closed & (top.size > LOCAL) & (top.depth < max_depth))[:OPEN]
        if not len(wide):
            break
        found = {r.node: r for r in _wide_splits(chunks, top, wide, n_features, n_bins, tries, weights, num_trees, seed).collect()}
        for node in wide.tolist():
            split = found.get(node)
            if split is None or split.feature < 0:
                closed[node] = True  # a leaf, which its part says as well
                continue
            gains[top.tree[node], split.feature] += split.gain
            top.feature[node], top.cut[node], top.left[node] = split.feature, split.cut, len(top.tree)
            new = dict(tree=[top.tree[node]] * 2, feature=[-1, -1], cut=[0, 0], left=[-1, -1], depth=[top.depth[node] + 1] * 2,
                       size=[split.n_left, split.n_right])
            top = Top(**{k: np.append(getattr(top, k), v) for k, v in new.items()})
            closed = np.append(closed, [False, False])

    def send(batches):
        def messages():
            for _, ids, _, bins, labels in _unchunk(batches):
                for tree in range(num_trees):
                    copies = _copies(ids, tree, seed)
                    drawn = np.flatnonzero(copies)
                    at = top.walk(bins[:, drawn], tree)
                    for node, pick in _groups(at):
                        pick = drawn[pick]
                        if closed[node]:  # a leaf needs no more than its sums
                            sums = [int(copies[pick][labels[pick] == k].sum()) for k in (0, 1)]
                            yield int(node), _pack(np.array(sums), np.zeros((n_features, 0), bins.dtype))
                        else:
                            yield int(node), _pack((copies[pick] << 1 | labels[pick]).astype(np.uint8), bins[:, pick])

        yield from _batches(messages(), ["node", "payload"])

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        payloads = [_unpack(p) for p in table.column("payload").to_pylist()]
        if closed[node]:
            n0, n1 = np.sum([p[0] for p in payloads], axis=0) * weights
            leaf = (np.array([-1], np.int16), np.zeros(1, np.uint16), np.array([-1], np.int32), np.array([n1 / (n0 + n1)]))
            nodes, gain = leaf, np.zeros(n_features)
        else:
            packed, bins = (np.concatenate([p[i] for p in payloads], axis=-1) for i in (0, 1))
            del payloads
            nodes, gain = grow_part(bins, packed >> 1, packed & 1, weights, tries, max_depth - int(top.depth[node]), n_bins,
                                    np.random.default_rng([seed & 0xffffffff, 1, node]))
        return pa.table({"node": [node], "tree": [int(top.tree[node])], "nodes": [_pack_nodes(*nodes)], "gain": [gain.tolist()]},
                        _schema(PARTS))

    def grow_whole(key: tuple, table: pa.Table) -> pa.Table:
        out = {"node": [], "tree": [], "nodes": [], "gain": []}
        for tree in np.flatnonzero(group_of == key[0].as_py()).tolist():
            copies = (_copies(_unpack(b.as_py())[0], tree, seed).astype(np.uint8) for b in table.column("ids"))
            drawn = [(c, np.flatnonzero(c)) for c in copies]
            n = sum(len(d) for _, d in drawn)
            if not n:
                continue
            nodes, gain = grow_part(*_drawn_rows(table, drawn, n, n_features), weights, tries, max_depth, n_bins,
                                    np.random.default_rng([seed & 0xffffffff, 1, tree]))
            for k, v in zip(out, (tree, tree, _pack_nodes(*nodes), gain.tolist())):
                out[k].append(v)
        return pa.table(out, _schema(PARTS))

    if n_rows <= LOCAL:  # a task gets the rows once for all its trees
        group_of = _tree_groups(num_trees)
        sent = _to_groups(chunks.select("ids", "rows"), num_trees).repartition(SPREAD, "part")
        grown = sent.groupBy("part").applyInArrow(grow_whole, PARTS)
    else:
        sent = chunks.mapInArrow(send, "node int, payload binary").repartition(_tasks(rows, len(top.tree)), "node")
        grown = sent.groupBy("node").applyInArrow(grow, PARTS)
    parts = stage(grown, "forest_parts")
    sums = parts.groupBy("tree").agg(F.array(*[F.sum(F.get("gain", F.lit(i))) for i in range(n_features)]).alias("gain"))
    for r in sums.collect():  # a row a tree
        gains[r.tree] += r.gain
    each = gains.sum(axis=1, keepdims=True)
    total = (gains / np.where(each > 0, each, 1)).sum(axis=0)
    return Forest(cuts, num_trees, top, parts.select("node", "nodes"), total / (total.sum() or 1))


def _whole_scores(chunks: DataFrame, parts: DataFrame, num_trees: int, deals: int, out: str) -> DataFrame:
    """_row and mean share, where each part is a whole tree: rows meet the trees of a group in one task, which sends on sums."""
    def meet(rows: pa.Table, trees: pa.Table) -> pa.Table:
        bins = [_records_of(_unpack(r)[0]) for r in rows.column("rows").to_pylist()] if trees.num_rows else []
        totals = [np.zeros(len(b)) for b in bins]
        for blob in trees.sort_by("node").column("nodes") if bins else []:
            words, share = _unpack_nodes(blob.as_py())
            for total, b in zip(totals, bins):
                total += share[_leaves(words, b)]
        n = len(bins)
        return pa.table({"chunk": rows.column("chunk").slice(0, n), "part": rows.column("part").slice(0, n),
                         "voters": [trees.num_rows] * n, "payload": [_pack(t) for t in totals]},
                        _schema("chunk long, part int, voters int, payload binary"))

    def add_up(chunk: pa.Table, news: pa.Table) -> pa.Table:
        ids = _unpack(chunk.column("ids")[0].as_py())[0]
        total = np.zeros(len(ids))
        for blob in news.sort_by("part").column("payload"):  # one order, one sum
            total += _unpack(blob.as_py())[0]
        return pa.table({"_row": ids, out: total / sum(news.column("voters").to_pylist())})

    groups, tasks = int(_tree_groups(num_trees).max()) + 1, SPREAD * deals
    deal = F.pmod(F.xxhash64("chunk"), F.lit(deals)).cast("int").alias("deal")
    met = (F.col("deal") * GROUPS + F.col("part")).alias("met")
    sent = _to_groups(chunks.select("chunk", "rows", deal), num_trees).select("*", met).repartition(tasks, "met")
    trees = parts.select("node", "nodes", F.expr(f"int(node * {groups} div {num_trees})").alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal")).select("*", met).repartition(tasks, "met")
    news = sent.groupBy("met").cogroup(trees.groupBy("met")).applyInArrow(
        meet, "chunk long, part int, voters int, payload binary")
    return chunks.select("chunk", "ids").groupBy("chunk").cogroup(news.groupBy("chunk")).applyInArrow(
        add_up, f"_row long, {out} double")


def _tree_groups(num_trees: int) -> np.ndarray:
    return np.arange(num_trees) * min(GROUPS, num_trees) // num_trees


def _to_groups(chunks: DataFrame, num_trees: int) -> DataFrame:
    """A copy of each row for each group of trees, whose number is ``part``."""
    last = int(_tree_groups(num_trees).max())
    return chunks.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part"))


def _drawn_rows(table: pa.Table, drawn: list[tuple[np.ndarray, np.ndarray]], n: int, n_features: int) -> tuple[np.ndarray, ...]:
    """Bins, copies and labels of the drawn rows."""
    bins, copies, labels, at = None, np.empty(n, np.uint8), np.empty(n, np.uint8), 0
    for blob, (number, pick) in zip(table.column("rows"), drawn):
        some, label = _unpack(blob.as_py())
        bins = np.empty((n_features, n), some.dtype) if bins is None else bins
        to = slice(at, at := at + len(pick))
        bins[:, to], copies[to], labels[to] = some[:, pick], number[pick], label[pick]
    return bins, copies, labels


def _cuts(rows: DataFrame, features: str, max_bins: int) -> list[np.ndarray]:
    """Cuts between bins: halfway between neighbouring values if there are at most ``max_bins`` of them, else between bins of
    equal counts in a bounded draw of rows. They place the cuts only; every row is counted."""
    from pyspark.ml.functions import vector_to_array

    wanted = max(max_bins ** 2, 10000)
    placed = rows.select(vector_to_array(features).alias("x"), F.xxhash64(F.monotonically_increasing_id()).alias("h"))
    n = rows.count()
    if not n:
        raise ValueError("no rows to learn from")
    share = (F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < F.lit(wanted / n)
    drawn = np.array([r.x for r in (placed.where(share) if n > wanted else placed).select("x").collect()])
    return [_column_cuts(drawn[:, f], max_bins) for f in range(drawn.shape[1])]


def _column_cuts(x: np.ndarray, max_bins: int) -> np.ndarray:
    values, counts = np.unique(x, return_counts=True)
    if len(values) > max_bins:
        ends = np.searchsorted(np.cumsum(counts), np.arange(1, max_bins) * (len(x) / max_bins))
        below = np.unique(np.minimum(ends, len(values) - 2))
    else:
        below = np.arange(len(values) - 1)
    return values[below] / 2 + values[below + 1] / 2


def _chunks(rows: DataFrame, features: str, cuts: list[np.ndarray]) -> DataFrame:
    """Packed rows: bins (a row a feature), labels and ids; ``chunk`` is the first id."""
    from pyspark.ml.functions import vector_to_array

    kind = np.uint8 if max([len(c) for c in cuts], default=0) < 256 else np.uint16

    def run(batches):
        for batch in _regroup(batches):
            x = batch.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)]).astype(kind)
            ids, labels = (batch.column(c).to_numpy() for c in ("_row", "label"))
            yield pa.RecordBatch.from_pydict({"chunk": [int(ids[0])], "n": [len(ids)], "ids": [_pack(ids)],
                                              "rows": [_pack(bins, labels.astype(np.uint8))]},
                                             _schema("chunk long, n long, ids binary, rows binary"))

    placed = rows.select(vector_to_array(features).alias("x"), "label", "_row")
    return placed.mapInArrow(run, "chunk long, n long, ids binary, rows binary")


def _regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _unchunk(batches: Iterator[pa.RecordBatch]):
    """(chunk, ids, n, bins, labels)"""
    for batch in batches:
        for chunk, n, ids, rows in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "ids", "rows"))):
            yield chunk, _unpack(ids)[0], n, *_unpack(rows)


def _copies(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) copies of each row in a tree."""
    start = _mix(np.array([seed & 0xffffffff], np.uint64) << np.uint64(32) | np.uint64(tree))
    drawn = (_mix(_mix(ids.astype(np.uint64)) ^ start) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(BAG, drawn, side="left")


def _mix(h: np.ndarray) -> np.ndarray:
    """Hash of 64-bit integers (SplitMix)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _groups(at: np.ndarray):
    """Each value and the places where it stands."""
    if len(at) and (at == at[0]).all():
        yield at[0], np.arange(len(at))
        return
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1]))[:len(at)])
    for a, b in zip(first, np.append(first[1:], len(at))):
        yield at[order[a]], order[a:b]


def _walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.flatnonzero(feature[at] >= 0)
    while len(rows):
        here = at[rows]
        at[rows] = left[here] + (bins[feature[here], rows] > cut[here])
        rows = rows[feature[at[rows]] >= 0]
    return at


def _records_of(bins: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(bins.T)


def _leaves(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The leaf of each row of bins in a tree of ``_unpack_nodes``."""
    n, width = rows.shape
    flat, at, base, which = rows.ravel(), np.zeros(n, np.int64), np.arange(n) * width, np.arange(n)
    out = np.zeros(n, np.int64)
    while len(which):
        for _ in range(3):
            here = at
            word = words.take(at)
            at = (word >> 32) + (flat.take(base + (word >> 16 & 0xffff)) > (word & 0xffff))
        live = np.flatnonzero(at != here)
        out[which] = at
        at, base, which = at[live], base[live], which[live]
    return out


def _pack_nodes(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, share: np.ndarray) -> bytes:
    """Children follow one another in the order of their parents, so ``left`` need not be kept."""
    return _pack(feature, cut, share)


def _unpack_nodes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Left child, feature and cut of each node as one integer, and the shares; a leaf leads to itself."""
    feature, cut, share = _unpack(blob)
    inner = feature >= 0
    left = np.where(inner, 2 * np.cumsum(inner) - 1, np.arange(len(inner)))
    return left << 32 | np.where(inner, feature, 0).astype(np.int64) << 16 | np.where(inner, cut, 0xffff), share


def _tried(rng: np.random.Generator, nodes: int, n_features: int, tries: int) -> np.ndarray:
    """``tries`` features for each node, ascending."""
    return np.sort(rng.random((nodes, n_features)).argpartition(tries - 1, axis=1)[:, :tries], axis=1)


def _wide_splits(chunks: DataFrame, top: Top, wide: np.ndarray, n_features: int, n_bins: int, tries: int, weights: list[float],
                 num_trees: int, seed: int) -> DataFrame:
    """node, feature (-1: none), cut, gain, n_left, n_right of nodes whose rows stay where they are."""
    tried = {n: _tried(np.random.default_rng([seed & 0xffffffff, 0, n]), 1, n_features, tries)[0] for n in wide.tolist()}

    def count(batches):
        sums = {}
        for _, ids, _, bins, labels in _unchunk(batches):
            for tree in range(num_trees):
                copies = _copies(ids, tree, seed)
                for node, pick in _groups(top.walk(bins, tree)):
                    if node in tried:
                        held = sums.setdefault(int(node), np.zeros((tries, n_bins * 2), np.int64))
                        for i, f in enumerate(tried[node]):
                            held[i] += np.bincount(bins[f, pick].astype(np.int64) << 1 | labels[pick], copies[pick],
                                                   n_bins * 2).astype(np.int64)
        yield from _batches(((node, _pack(held)) for node, held in sums.items()), ["node", "payload"])

    def split(key: tuple, table: pa.Table) -> pa.Table:
        node = key[0].as_py()
        n = sum(_unpack(p)[0] for p in table.column("payload").to_pylist()).reshape(tries, n_bins, 2)
        left = n.cumsum(axis=1)
        whole = left[0, -1]
        best = (float(_purity(*(whole * weights))) * (1 + NO_SPLIT), -1, 0, 0)
        start = float(_purity(*(whole * weights)))
        for i, f in enumerate(tried[node]):
            ends = np.flatnonzero((n[i].sum(axis=1) > 0) & (left[i].sum(axis=1) < whole.sum()))
            if whole.all() and len(ends):
                sides = left[i, ends]
                purity = _purity(*(sides * weights).T) + _purity(*((whole - sides) * weights).T)
                j = int(purity.argmax())
                if purity[j] > best[0]:
                    best = (float(purity[j]), int(f), int(ends[j]), int(sides[j].sum()))
        found = {"node": node, "feature": best[1], "cut": best[2], "gain": best[0] - start, "n_left": best[3],
                 "n_right": int(whole.sum()) - best[3]}
        return pa.table({k: [v] for k, v in found.items()}, _schema(SPLIT))

    counts = chunks.select("chunk", "n", "ids", "rows").mapInArrow(count, "node int, payload binary")
    return counts.groupBy("node").applyInArrow(split, SPLIT)


PARTS = "node int, tree int, nodes binary, gain array<double>"
SPLIT = "node int, feature int, cut int, gain double, n_left long, n_right long"


def _purity(w0, w1):
    return (w0 * w0 + w1 * w1) / (w0 + w1)


def grow_part(bins: np.ndarray, copies: np.ndarray, labels: np.ndarray, weights: list[float], tries: int, max_depth: int,
              n_bins: int, rng: np.random.Generator) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The tree over rows (columns of ``bins``), level by level: feature (-1 in a leaf), cut, left child (the right one
    follows it) and share of label 1 of each node, and the gain of each feature.

    Rows stand in the order of their nodes and only while their node can be split; a level is worked off in slices of nodes.
    """
    n_features = bins.shape[0]
    w = np.array(weights)[:, None]
    packed = copies.astype(np.uint8) << np.uint8(1) | labels.astype(np.uint8)
    rows, col, code = _records(bins, tries)
    del bins
    sums = np.bincount(packed & 1, packed >> 1, 2).astype(np.int64)[:, None]
    sizes = np.array([len(packed)])
    levels, below = [], 1
    for depth in range(max_depth + 1):
        m = sums.shape[1]
        feature, cut, left, gain = np.full(m, -1, np.int16), np.zeros(m, np.uint16), np.full(m, -1, np.int32), np.zeros(m)
        levels.append((feature, cut, left, gain, sums))
        mixed = np.flatnonzero(sums.all(axis=0))
        if depth == max_depth or not len(mixed):
            break
        done, new = [], []
        ends = np.concatenate(([0], np.cumsum(sizes)))
        a = 0
        while a < len(mixed):
            b = max(int(np.searchsorted(ends, ends[a] + SLICE, side="right")) - 1, a + 1)
            some = slice(ends[a], ends[b])
            tried = _tried(rng, b - a, n_features, tries)
            on, place, best, sides = _best_splits(rows[some], packed[some], sizes[a:b], sums[:, mixed[a:b]], tried, col, code, w, n_bins)
            done.append((on, place, best, sides))
            new.append(_parted(rows[some], packed[some], sizes[a:b], sums[:, mixed[a:b]], on, place, sides, col, code))
            a = b
        on, place, best, sides = (np.concatenate(x, axis=-1) for x in zip(*done))
        splits = on >= 0
        if not splits.any():
            break
        rows, packed, sizes = (np.concatenate(x) for x in zip(*new))
        inner, whole = mixed[splits], sums[:, mixed[splits]]
        feature[inner], cut[inner], gain[inner] = on[splits], place[splits], best[splits] - _purity(*(whole * w))
        left[inner] = below + 2 * np.arange(len(inner))
        sums = np.stack((sides[:, splits], whole - sides[:, splits]), axis=-1).reshape(2, -1)
        below += 2 * len(inner)
    feature, cut, left, gain = (np.concatenate([lv[i] for lv in levels]) for i in range(4))
    w0, w1 = np.concatenate([lv[4] for lv in levels], axis=1) * w
    starts = np.cumsum([0, *[len(lv[0]) for lv in levels]])
    agree = w1 > w0
    for a, b in reversed(list(zip(starts, starts[1:]))):  # neighbouring leaves with the same majority become one
        inner = a + np.flatnonzero(feature[a:b] >= 0)
        child = left[inner]
        same = (feature[child] < 0) & (feature[child + 1] < 0) & (agree[child] == agree[child + 1])
        feature[inner[same]] = -1
    reached = np.zeros(len(feature), bool)
    reached[0] = True
    for a, b in zip(starts, starts[1:]):
        inner = a + np.flatnonzero(reached[a:b] & (feature[a:b] >= 0))
        reached[left[inner]] = reached[left[inner] + 1] = True
    number = np.cumsum(reached) - 1
    split = feature >= 0
    left = np.where(split, number[np.where(split, left, 0)], -1).astype(np.int32)
    kept = split & reached
    gains = np.bincount(feature[kept], gain[kept], n_features)
    return (feature[reached], cut[reached], left[reached], (w1 / (w0 + w1))[reached]), gains


def _records(bins: np.ndarray, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``bins`` end to end, the place of each feature in one, and its code there.

    Features of two bins whose second one is rare share a place where no row has two of them: the code (from 1) says which
    has its second bin. The code of any other feature is 0, and what stands there is its bin.
    """
    n_features, n = bins.shape
    most = bins.max(axis=1, initial=0)
    code, bundle, shared = np.zeros(n_features, np.int64), np.full(n_features, -1), []
    for f in np.flatnonzero(most <= 1):
        ones = np.flatnonzero(bins[f])
        if len(ones) > n // 8:
            continue
        free = next((i for i, (held, _) in enumerate(shared) if not held[ones].any()), len(shared))
        if free == len(shared):
            if free == tries:
                continue
            shared.append([np.zeros(n, np.uint16), 0])
        shared[free][1] += 1
        bundle[f], code[f] = free, shared[free][1]
        shared[free][0][ones] = code[f]
    alone = np.flatnonzero(code == 0)
    col = np.where(code > 0, len(alone) + bundle, 0)
    col[alone] = np.arange(len(alone))
    kind = np.uint8 if max(int(most.max(initial=0)), int(code.max(initial=0))) < 256 else np.uint16
    rows = np.empty((n, len(alone) + len(shared)), kind)
    for i, f in enumerate(alone):
        rows[:, i] = bins[f]
    for i, (held, _) in enumerate(shared):
        rows[:, len(alone) + i] = held
    return rows, col, code


def _best_splits(rows: np.ndarray, packed: np.ndarray, sizes: np.ndarray, whole: np.ndarray, tried: np.ndarray, col: np.ndarray,
                 code: np.ndarray, w: np.ndarray, n_bins: int) -> tuple[np.ndarray, ...]:
    """Of each node: feature (-1: none), cut, purity and sums of the left side. Rows stand in the order of their nodes."""
    k, tries = tried.shape
    best = _purity(*(whole * w)) * (1 + NO_SPLIT)
    on, place, left = np.full(k, -1, np.int16), np.zeros(k, np.uint16), np.zeros((2, k), np.int64)

    def take(nodes, feature, cut, purity, sides):
        hit = purity > best[nodes]
        nodes = nodes[hit]
        best[nodes], on[nodes], place[nodes], left[:, nodes] = purity[hit], feature[nodes], cut[hit], sides[:, hit]

    def purity_of(sides, nodes):
        return _purity(*(sides * w)) + _purity(*((whole[:, nodes] - sides) * w))

    coded = code[tried]
    ones = _coded_sums(rows, packed, sizes, tried, col, code) if coded.any() else None
    first = np.cumsum(sizes) - sizes
    for i in range(tries):
        feature = tried[:, i]
        nodes = np.flatnonzero(coded[:, i])
        if len(nodes):
            sides = whole[:, nodes] - ones[:, nodes, i]
            right = ones[:, nodes, i]
            some = (sides[0] + sides[1] > 0) & (right[0] + right[1] > 0)
            nodes, sides = nodes[some], sides[:, some]
            take(nodes, feature, np.zeros(len(nodes), np.uint16), purity_of(sides, nodes), sides)
        nodes = np.flatnonzero(coded[:, i] == 0)
        if len(nodes):
            number, cut, sides = _cut_sums(rows, packed, first[nodes], sizes[nodes], col[feature[nodes]], n_bins)
            if len(number):
                purity = purity_of(sides, nodes[number])
                begin = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
                most = np.maximum.reduceat(purity, begin)
                hit = np.flatnonzero(purity == np.repeat(most, np.diff(np.append(begin, len(number)))))
                hit = hit[np.concatenate(([True], number[hit][1:] != number[hit][:-1]))]  # the lowest cut
                take(nodes[number[hit]], feature, cut[hit], purity[hit], sides[:, hit])
    return on, place, best, left


def _coded_sums(rows, packed, sizes, tried, col, code) -> np.ndarray:
    """Copies by label of rows in the second bin of each coded feature that their node tries: label, node, try."""
    k, tries = tried.shape
    sums = np.zeros(k * tries * 2)
    which = col[tried]
    for c in np.unique(col[code > 0]):
        width = int(code[col == c].max()) + 1
        slot = np.full((k, width), -1, np.int8 if tries < 128 else np.int64)
        node, i = np.nonzero((which == c) & (code[tried] > 0))
        slot[node, code[tried[node, i]]] = i
        start = np.repeat(np.arange(k) * width, sizes)
        start += rows[:, c]
        at = slot.ravel()[start]
        hit = np.flatnonzero(at >= 0)
        cell = start[hit] // width * tries
        cell += at[hit]
        cell <<= 1
        cell |= packed[hit] & 1
        sums += np.bincount(cell, packed[hit] >> 1, k * tries * 2)
    return np.moveaxis(sums.astype(np.int64).reshape(k, tries, 2), 2, 0)


def _cut_sums(rows, packed, first, sizes, col, n_bins) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every cut between bins that hold rows of a node, ascending: number of the node, cut, copies by label left of it.

    ``first`` and ``sizes`` are the nodes' rows, ``col`` the place of the feature that each tries.
    """
    n, k, width = int(sizes.sum()), len(sizes), rows.shape[1]
    shift = max(int(n_bins - 1).bit_length(), 1)
    flat = rows.ravel()

    def cells(begin, end):
        """Node and bin of rows ``begin`` to ``end`` of all these nodes, and the rows' copies and labels."""
        if k == 1:
            some = slice(int(first[0]) + begin, int(first[0]) + end)
            return rows[some, int(col[0])].astype(np.int64), packed[some]
        if n == len(rows):
            where, held = np.arange(n) * width, packed
        else:
            where = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
            held = packed[where]
            where *= width
        where += np.repeat(col, sizes)
        key = np.repeat(np.arange(k) << shift, sizes)
        key |= flat[where]
        return key, held

    if k << shift <= 2 * n:
        sums = np.zeros(k << shift + 1)
        for begin in range(0, n, SLICE) if k == 1 else [0]:
            key, held = cells(begin, min(begin + SLICE, n) if k == 1 else n)
            key <<= 1
            key |= held & 1
            sums += np.bincount(key, held >> 1, len(sums))
        sums = sums.astype(np.int64).reshape(-1, 2)
        full = np.flatnonzero(sums[:, 0] | sums[:, 1])
        run = np.cumsum(sums[full], axis=0).T
        cell = full
    else:
        key, held = cells(0, n)
        key <<= 5
        key |= held
        if k << shift + 5 < 1 << 32:
            key = key.astype(np.uint32)
        key.sort()
        cell = key >> 5
        last = np.flatnonzero(cell[1:] != cell[:-1])
        last = np.append(last, n - 1)
        copies = (key >> 1 & 15).astype(np.int64)
        run = np.stack((np.cumsum(copies)[last], np.cumsum(copies * (key & 1))[last]))
        run[0] -= run[1]
        cell = cell[last].astype(np.int64)
    node = cell >> shift
    ends = np.flatnonzero(node[1:] == node[:-1])  # the last bin of a node: nothing is right of it
    begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    before = np.concatenate((np.zeros((2, 1), np.int64), run[:, begin[1:] - 1]), axis=1)
    node = node[ends]
    return node, (cell[ends] & ((1 << shift) - 1)).astype(np.uint16), run[:, ends] - before[:, node]


def _parted(rows, packed, sizes, whole, on, place, sides, col, code) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and packed labels in the order of the children that hold both labels, and the numbers of rows of these."""
    splits = on >= 0
    f = np.where(splits, on, 0)
    low = np.where(code[f] > 0, code[f] - 1, place).astype(rows.dtype)
    high = np.where(code[f] > 0, code[f], np.iinfo(rows.dtype).max).astype(rows.dtype)
    if len(sizes) == 1:
        value = rows[:, col[f[0]]]
        right = (value > low[0]) & (value <= high[0])
    else:
        where = np.repeat(col[f], sizes)
        where += np.arange(0, rows.size, rows.shape[1])
        value = rows.ravel()[where]
        right = (value > np.repeat(low, sizes)) & (value <= np.repeat(high, sizes))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    run = np.concatenate(([0], np.cumsum(right)))[ends] if len(sizes) > 1 else np.array([0, np.count_nonzero(right)])
    rights = np.diff(run)
    children = np.stack((sizes - rights, rights), axis=1)
    mixed = np.stack((sides.all(axis=0) & splits, (whole - sides).all(axis=0) & splits), axis=1)
    kept = np.where(mixed, children, 0)
    begin = np.cumsum(kept).reshape(-1, 2) - kept
    order = np.empty(int(kept.sum()), np.int64)
    for side, there in enumerate((~right, right)):
        if not mixed[:, side].all():
            there &= np.repeat(mixed[:, side], sizes)
        found, n = np.flatnonzero(there), kept[:, side]
        if len(sizes) == 1:
            order[begin[0, side]:begin[0, side] + len(found)] = found
        else:
            order[np.repeat(begin[:, side] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    return rows.take(order, axis=0), packed.take(order), children[mixed]


def _tasks(df: DataFrame, groups: int) -> int:
    """Enough tasks that each holds a few nodes' rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups)


def _pack(*arrays: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    for a in arrays:
        pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(a)), sink)
    raw = sink.getvalue()
    return raw.size.to_bytes(8, "little") + len(arrays).to_bytes(1, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    source = pa.BufferReader(pa.Codec("zstd").decompress(blob[9:], int.from_bytes(blob[:8], "little")))
    return [pa.ipc.read_tensor(source).to_numpy() for _ in range(blob[8])]


def _batches(rows: Iterator[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that end in a payload, in batches of bounded bytes."""
    kinds = {"node": "node int", "deal": "deal long", "chunk": "chunk long", "payload": "payload binary"}
    schema = _schema(", ".join(kinds[n] for n in names))
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > MESSAGES:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held))), schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(),
             "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])
