"""Benchmark decontamination: training windows looked up in a hash set of test n-grams.

Column expressions only. Words are runs of characters other than ASCII
punctuation, white space and control characters, with A-Z in lower case. Each
document is scanned once: the hash of every window goes through a broadcast
hash join on the item windows, and a hit counts only if the words themselves
are equal. Only hits are shuffled. The broadcast is made if the item windows
are counted to be at most ``max_broadcast``, and their bytes at most
``max_broadcast_bytes``; beyond that, the windows themselves are joined by
shuffling, with the same result. The cost of a text is in proportion to its
length, however long it is.

Defined cases: a null or wordless text has no words and is never hit; a null or
wordless item has no windows; an item shorter than the window is one window of
its own length. A null document id is kept. Repeated documents are scanned and
returned row by row, repeated items count once, and an item with a null id
marks words but is not listed. Empty tables: no items, no hits; no documents,
no rows. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

WINDOW = 10
_RUN = 2048
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def words(text: Column) -> Column:
    """The normalised words of a text. Only texts with non-ASCII characters need the slower mapping."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(lower, _GAP), "")


def item_windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """``(gram array<string>, n int, items array<long>)``: each distinct window and the items it is in."""
    w = (id_text(items, id_col, text_col).select(F.col("doc_id").alias("item"), words(F.col("text")).alias("w"))
         .where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(window))))
    grams = w.select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    return (grams.select("item", "n", F.slice("w", F.col("i"), F.col("n")).alias("gram"))
            .groupBy("gram", "n").agg(F.collect_set("item").alias("items")))


def scan(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
         max_broadcast: int = 1_000_000, max_broadcast_bytes: int = 128 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, hits, items``.

    ``hits``: sorted array of ``(start, end)`` word positions of the matched
    windows, from 0, end exclusive; ``items``: sorted ids of the items with a
    window in the document.
    """
    doc = id_text(docs, id_col, text_col).select("doc_id", words(F.col("text")).alias("w"))
    return _scan(doc, item_windows(items, id_col=item_id_col, text_col=item_text_col, window=window),
                 max_broadcast, max_broadcast_bytes)


def _scan(doc: DataFrame, grams: DataFrame, max_broadcast: int = 1_000_000, max_broadcast_bytes: int = 128 << 20) -> DataFrame:
    """``scan`` for documents ``(doc_id, w)``, whose id may be of any type."""
    size_of = F.octet_length(F.array_join("gram", " ")) + 64
    sizes = grams.groupBy("n").agg(F.count("*").alias("k"), F.sum(size_of).alias("bytes")).collect()  # a row a length
    lengths = sorted((r.n for r in sizes), reverse=True)
    small = sum(r.k for r in sizes) <= max_broadcast and sum(r.bytes for r in sizes) <= max_broadcast_bytes

    # A document in runs of `_RUN` windows, so that neither a row nor the array of a run grows with the text.
    n_words, longest = F.size("w"), max(lengths, default=1)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n_words / _RUN), F.lit(1)).cast("int") - 1),
                       lambda k: F.slice("w", k * _RUN + 1, F.lit(_RUN + longest - 1)))
    run = (doc.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), runs.alias("runs"))
           .select("row", "doc_id", "n_words", F.posexplode("runs").alias("run", "w")))

    def windows_of(n: int) -> Column:
        """Of each window of n words that begins in the run: its hash, or, for the join by shuffling, the words themselves."""
        count = F.least(F.lit(_RUN), n_words - n + 1)
        gram = lambda i: F.slice("w", i, n)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(gram(i)) if small else gram(i)))

    # Element 0 stands for the document itself, so that documents without a hit stay.
    none = F.array(F.lit(0).cast("long") if small else F.array().cast("array<string>"))
    parts = [F.coalesce(windows_of(n), F.slice(none, 1, 0)) for n in lengths]
    end, first = F.lit(1), []  # of each length, the element of its first window
    for n in lengths:
        first.append(end)
        end = end + F.greatest(F.least(F.lit(_RUN), F.col("n_run") - n + 1), F.lit(0))
    n_col, in_run = F.lit(0), F.lit(0)
    for n, begin in zip(lengths, first, strict=True):
        n_col, in_run = F.when(F.col("pos") >= begin, F.lit(n)).otherwise(n_col), \
            F.when(F.col("pos") >= begin, F.col("pos") - begin).otherwise(in_run)
    at_col = F.when(F.col("pos") > 0, F.col("run") * _RUN).otherwise(0) + in_run
    # The words stay in the run's row; those of a window are cut from it where its hash is found.
    marks = (run.select("row", "doc_id", "n_words", "run", n_words.alias("n_run"), *(["w"] if small else []),
                        F.concat(none, *parts).alias("all"))
             .select("row", "doc_id", "n_words", "run", "n_run", *(["w"] if small else []),
                     F.posexplode("all").alias("pos", "key" if small else "gram")))

    itself = grams.sparkSession.createDataFrame([([], 0, [])], "gram array<string>, n int, items array<long>")
    table = itself.unionByName(grams).withColumnsRenamed({"gram": "g_gram", "n": "g_n", "items": "g_items"})
    same = (F.col("pos") == 0) == (F.col("g_n") == 0)
    if small:
        table = table.withColumn("g_key", F.when(F.col("g_n") == 0, F.lit(0).cast("long"))
                                 .otherwise(F.xxhash64("g_gram")))
        found = (marks.join(F.broadcast(table), (F.col("key") == F.col("g_key")) & same)
                 .where(F.slice("w", in_run + 1, n_col) == F.col("g_gram")))
    else:
        found = marks.join(table, (F.col("gram") == F.col("g_gram")) & same)
    hit = F.when(F.col("pos") > 0, F.struct(at_col.alias("start"), (at_col + n_col).alias("end")))
    rows = found.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("hit"),
                        F.when(F.col("pos") > 0, F.col("g_items")).alias("own"))
    return (rows.groupBy("row", "doc_id", "n_words")
            .agg(F.array_sort(F.collect_list("hit")).alias("hits"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"))
            .drop("row"))


def covered(hits: Column) -> Column:
    """How many words the sorted, possibly overlapping spans cover."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, h: F.struct(
        (a.n + F.greatest(F.lit(0), h.end - F.greatest(a.upto, h.start))).alias("n"),
        F.greatest(a.upto, h.end).alias("upto"))
    return F.aggregate(hits, zero, step, lambda a: a.n.cast("long"))


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
          item_text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """The documents without those that hold a benchmark window; their columns stay as they are.

    Documents are told by the digest of their text, which alone decides: rows without an id go if they
    are hit, and rows that share an id with one that is hit stay if they aren't.
    """
    digest = lambda text: F.unhex(F.md5(text.cast("string")))
    text = F.col(f"`{text_col}`")
    doc = docs.select(digest(text).alias("doc_id"), words(text.cast("string")).alias("w"))
    found = _scan(doc, item_windows(items, id_col=item_id_col, text_col=item_text_col, window=window), **options)
    hit = found.where(F.size("hits") > 0).select(F.col("doc_id").alias("__llm_digest")).distinct()
    return docs.join(hit, digest(text) == F.col("__llm_digest"), "left_anti")
