"""Benchmark decontamination: words of training texts that stand in a window of a benchmark item.

The windows of all items (ten consecutive normalised words; an item of fewer words is one window) become a hash set that is
broadcast once its size is known to be within ``broadcast_bytes``; a larger set is joined by a shuffle, with the same rows.
Every position of every text is looked up by the hash of its words, and each hit is verified word by word. Hit words
form maximal spans, which can be cut out (``remove_spans``) or cost the document its place (``drop_contaminated``).

Built from DataFrame functions alone. Positions are rows of the scan that leave it only if they hit; per document one row
more. Rows are grouped by id, text and input partition, so that neither a frequent id nor a text with many copies meets in
one task, and repeated rows are counted there and come back as often as they went in.

A null or empty text has no words and no hits; an item without words has no window. An item without an id marks words but
is not counted or listed. Items that share an id count once. Empty tables are fine on either side. Other columns are kept by
``remove_spans`` and ``drop_contaminated``, whatever their names, and not read otherwise. A text is one row throughout: a
task holds the words of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placewise.llm import common as C
from placewise.session import stage

WINDOW = 10
BROADCAST_BYTES = 64 << 20
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # of texts as they are; word characters are the others
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contamination(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` words inside windows, ``n_items`` whose windows occur, the SHA-256 of their sorted
    ids, and ``contaminated``. Options as for ``find_hits``."""
    return find_hits(df, benchmark, **options).select(
        "doc_id", "n_words", _span_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def find_hits(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, ``spans`` (maximal runs of hit words, as start and end word from 0) and the sorted
    ids of the ``items`` whose windows occur."""
    rows = C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col)
    items = C.narrow(benchmark, item=benchmark[item_col].cast("string"), text=item_text_col)
    found = _found(rows, items, window, broadcast_bytes)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies", "text_key", "part")


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", min_hit: int = 1, **options) -> DataFrame:
    """The rows whose text has fewer than ``min_hit`` hit words, with all their columns."""
    kept = F.coalesce(_span_words(F.col("spans")), F.lit(0)) < min_hit
    return _with_spans(df, benchmark, text_col, options).where(kept).select("row.*")


def remove_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows and columns, each maximal run of hit words cut out of the text from its first to its last character."""
    text = F.col("row").getField(text_col)
    cut = F.when(F.size("spans") > 0, _without(text, F.col("spans"))).otherwise(text)
    return _with_spans(df, benchmark, text_col, options).select(
        *((cut if c == text_col else F.col("row").getField(c)).alias(c) for c in df.columns))


def _with_spans(df: DataFrame, benchmark: DataFrame, text_col: str, options: dict) -> DataFrame:
    """``row`` (all columns of ``df``) and its ``spans``, null where there are none."""
    options = {"item_col": "item_id", "item_text_col": "text", "window": WINDOW, "broadcast_bytes": BROADCAST_BYTES} | options
    items = benchmark.select(benchmark[options["item_col"]].cast("string").alias("item"),
                             benchmark[options["item_text_col"]].alias("text"))
    texts = df.select(F.lit(0).cast("long").alias("doc_id"), df[text_col].alias("text"))
    spans = (_found(texts, items, options["window"], options["broadcast_bytes"]).where(F.size("spans") > 0)
             .groupBy("text_key").agg(F.first("spans").alias("spans")))
    rows = df.select(F.struct("*").alias("row"), _text_key(df[text_col]).alias("text_key"))
    return rows.join(spans, "text_key", "left")


def _found(rows: DataFrame, items: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    """A row per id, text and input partition, with the number of its ``copies``."""
    windows = stage(benchmark_windows(items, window), "benchmark_windows")
    sizes = F.array_distinct(F.transform("found", lambda x: F.size(x["words"])))  # one, unless hashes are equal by chance
    figures = windows.agg(F.array_distinct(F.flatten(F.collect_set(sizes))).alias("lengths"),
                          F.sum(F.length(F.to_json("found"))).alias("size")).first()
    lengths, small = sorted(figures["lengths"]) or [window], (figures["size"] or 0) <= broadcast_bytes

    word = lambda k: F.get("words", F.col("pos") + k)
    keys = [F.struct(F.lit(n).alias("length"), window_key(n, [F.col("word"), *map(word, range(1, n))]).alias("key"))
            for n in lengths]
    # outer: a text without words keeps its row, and no filter that splits the text again is put before it
    places = rows.select("doc_id", _text_key(F.col("text")).alias("text_key"), F.spark_partition_id().alias("part"),
                         words_of(F.col("text")).alias("words"))
    places = places.select("doc_id", "text_key", "part", "words", F.posexplode_outer("words").alias("pos", "word"))
    if len(keys) == 1:
        places = places.select("*", keys[0].getField("length").alias("length"), keys[0].getField("key").alias("key"))
    else:
        places = places.select("*", F.explode(F.array(*keys)).alias("at")).select("*", "at.length", "at.key")
    here = F.slice("words", F.col("pos") + 1, F.col("length"))
    columns = ["doc_id", "text_key", "part", "pos", "length", "key", F.size("words").cast("long").alias("n_words")]
    if small:
        met = places.join(F.broadcast(windows), "key", "left").select(*columns, "found", here.alias("here"))
    else:  # the words of a place travel with it, not those of the whole text
        met = places.select(*columns, here.alias("here")).join(windows, "key", "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    met = met.where(first | F.col("found").isNotNull())
    same = F.filter("found", lambda x: x["words"] == F.col("here"))
    # `here` is used twice, so that its slice is taken once, below: the rows of hits do not carry the words of their text
    met = met.select("doc_id", "text_key", "part", "n_words", "pos", F.size("here").alias("length"),
                     (first & (F.col("length") == lengths[0])).alias("first"), F.get(same, F.lit(0)).alias("hit"))
    found = met.groupBy("doc_id", "text_key", "part").agg(
        F.max("n_words").alias("n_words"), F.count_if("first").alias("copies"),
        F.collect_set(F.when(F.col("hit").isNotNull(), F.struct("pos", "length"))).alias("hits"),
        F.collect_set("hit.items").alias("items"))
    return found.select("doc_id", "text_key", "part", "copies", F.greatest("n_words", F.lit(0)).alias("n_words"),
                        _spans(F.col("hits")).alias("spans"),
                        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The hash set: ``key``, and ``found``, the windows of that hash with their ``words`` and the ids of their items."""
    words = items.select("item", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    cut = words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1),
                                                     lambda i: F.slice("words", i, length))).alias("words"))
    listed = cut.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    keys = [window_key(n, [F.get("words", F.lit(k)) for k in range(n)]) for n in range(1, window + 1)]
    key = F.coalesce(*(F.when(F.size("words") == n, k) for n, k in enumerate(keys, 1)))
    return listed.groupBy(key.alias("key")).agg(F.collect_list(F.struct("words", "items")).alias("found"))


def window_key(length: int, words: list[Column]) -> Column:
    return F.xxhash64(F.lit(length), *words)


def words_of(text: Column) -> Column:
    """Runs of word characters with A-Z in lower case; other letters stay as they are. None for null."""
    plain = F.octet_length(text) == F.char_length(text)  # lower() changes other letters too, which ASCII has not
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), NO_WORD), "")


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _spans(hits: Column) -> Column:
    """Maximal runs of the words inside any hit."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(
        hits, lambda h: F.sequence(h["pos"], h["pos"] + h["length"] - 1)))))
    return F.transform(F.array(covered), lambda c: F.arrays_zip(
        F.filter(F.transform(c, lambda p, i: F.when((i == 0) | (F.get(c, i - 1) < p - 1), p)), lambda p: p.isNotNull())
        .alias("start"),
        F.filter(F.transform(c, lambda p, i: F.when((i == F.size(c) - 1) | (F.get(c, i + 1) > p + 1), p + 1)),
                 lambda p: p.isNotNull()).alias("end")))[0].cast("array<struct<start:int,end:int>>")


def _span_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of each span and what stands between them."""
    words = F.array_remove(F.split(text, NO_WORD), "")
    gaps = F.split(text, WORD)  # one more than words: what stands before each word, and after the last
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.lit(-1)))
    units = F.struct(words.alias("words"), gaps.alias("gaps"))

    def kept(u):
        whole = F.zip_with(F.slice(u["gaps"], F.lit(1), F.size(u["words"])), u["words"], lambda gap, word: F.concat(gap, word))
        return F.transform(F.array(whole), lambda w: F.array_join(F.zip_with(ends, starts, lambda end, start: F.transform(
            F.array(F.when(start < 0, F.size(w)).otherwise(start)),
            lambda stop: F.concat(F.array_join(F.slice(w, end + 1, stop - end), ""), F.get(u["gaps"], stop)))[0]), ""))[0]

    return F.transform(F.array(units), kept)[0]
