"""Benchmark decontamination by a distributed positional inverted index.

1. Windows: every run of ``width`` words of an item (a shorter item is one
   window); equal windows are one, with all its items.
2. Corpus frequencies of the benchmark's terms choose, per window, the three
   rarest distinct terms among those that occur at all, with their offsets.
3. The index stores the postings (document, position) of those terms, and one
   row per document with its word count. It serves the benchmark it was made for.
4. Offset-adjusted lists intersect: two of a window's three terms at a distance d are
   a pair, and windows that overlap share most of theirs. A posting of the pair's rarer
   term at p asks for the other one at p + d; sorted by position inside the document
   and term, the nearest posting on either side answers.
5. Exact phrases: where the pair of the two rarest terms of a window whose words all occur
   is met at that very place, the document is read again and the words at the start are
   compared with the window's.
6. Proximity: a pair met within ``slop`` words of its place. A passage with one word
   replaced, however rare that word is and whether it stands elsewhere or nowhere, keeps
   two of its three terms.

All steps are joins and aggregations. Broadcast tables hold 64-bit hashes of at
most BLOCK terms or pairs; a larger benchmark is worked off in blocks of that size.
Documents are known by 128 hashed bits of (doc_id, text), so repeated rows share
their matches and null ids need no special case.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_text, keyed, row_key, written

#: what separates words, after A-Z were lower-cased
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: benchmark terms of one broadcast block (a hash and a flag each, some 50 MB at most)
BLOCK = 1 << 20
KEY = ["k1", "k2"]


def words_of(text: Column) -> Column:
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, NO_WORD), "")


def windows_of(items: DataFrame, width: int, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(window_id, phrase, n) of the distinct windows and (window_id, item_id as string)."""
    w = items.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window"))
    each = written(each.select("item_id", F.array_join("window", " ").alias("phrase"), F.size("window").alias("n")).distinct(), "decon-items")
    distinct = written(each.select("phrase", "n").distinct().withColumn("window_id", F.monotonically_increasing_id()), "decon-windows")
    return distinct, each.join(distinct, ["phrase", "n"]).select("window_id", "item_id").distinct()


def _blocks(terms: DataFrame, key: str = "h") -> list[DataFrame]:
    """``terms`` (a hash ``key`` and a few numbers) in parts of about BLOCK rows at most, each small enough to broadcast."""
    n = -(-terms.count() // (BLOCK // 2)) or 1
    return [F.broadcast(terms.where(F.pmod(key, F.lit(n)) == i)) if n > 1 else F.broadcast(terms) for i in range(n)]


def _met(postings: DataFrame, terms: DataFrame, key: str = "h") -> DataFrame:
    """``postings`` joined to ``terms`` by hash, in place, block by block."""
    out = None
    for block in _blocks(terms.withColumnRenamed(key, "wanted"), "wanted"):
        got = postings.join(block, F.col("h") == F.col("wanted"))
        out = got if out is None else out.unionAll(got)
    return out


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, freq): occurrences in all documents of the terms ``h``."""
    out = None
    for block in _blocks(terms):
        got = docs.select(F.explode(words_of(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("h")).join(block, "h").groupBy("h").agg(F.count("*").alias("freq"))
        out = got if out is None else out.unionAll(got)
    return out


def rarest_terms(windows: DataFrame, docs: DataFrame, keep: int = 3) -> DataFrame:
    """(window_id, n, rank, h, off, whole, alone): the ``keep`` rarest distinct terms of every window
    among those that occur; ``whole``: all its words do; ``alone``: it has a single distinct word."""
    terms = (windows.select("window_id", "n", F.posexplode(F.split("phrase", " ")).alias("off", "word"))
             .groupBy("window_id", "n", F.xxhash64("word").alias("h")).agg(F.min("off").alias("off")))
    terms = written(terms, "decon-terms")
    freq = written(frequencies(docs, terms.select("h").distinct()), "decon-frequencies")
    known = terms.join(freq, "h", "left")
    per = Window.partitionBy("window_id")
    ranked = (known.withColumn("whole", F.count("freq").over(per) == F.count("h").over(per)).withColumn("alone", F.count("h").over(per) == 1)
              .where(F.col("freq").isNotNull()).withColumn("rank", F.row_number().over(per.orderBy("freq", "off"))))
    return written(ranked.where(F.col("rank") <= keep).select("window_id", "n", "rank", "h", "off", "whole", "alone"), "decon-rarest")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The stored index: postings (k1, k2, h, pos) of the terms ``h``; and per row of
    ``docs`` one row with h null and its doc_id and n_words."""
    out = None
    cut = keyed(docs).select("doc_id", *KEY, words_of(F.col("text")).alias("words"))
    each = cut.select("doc_id", *KEY, F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    each = each.withColumn("wh", F.xxhash64("word"))
    for k, block in enumerate(_blocks(terms.select("h").distinct())):
        first = F.coalesce(F.col("pos") == 0, F.lit(True)) if k == 0 else F.lit(False)
        got = each.join(block, F.col("wh") == F.col("h"), "left").where(F.col("h").isNotNull() | first)
        # a first word that is a term stands for both: its posting and its document's row
        two = F.array_compact(F.array(
            F.when(first, F.struct(F.col("doc_id"), F.col("n_words"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("pos"))),
            F.when(F.col("h").isNotNull(), F.struct(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("n_words"), F.col("h"), F.col("pos")))))
        got = got.select(*KEY, F.inline(two))
        out = got if out is None else out.unionAll(got)
    return written(out, "decon-index")


def pairs_of(rare: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair_id, near_h, far_h, delta) of the distinct pairs of terms, the rarer first, and their uses
    (pair_id, window_id, n, far_off, exact: the two rarest terms of a window whose words all occur)."""
    a = rare.select("window_id", "n", "whole", F.col("rank").alias("ra"), F.col("h").alias("near_h"), F.col("off").alias("oa"))
    b = rare.select("window_id", F.col("rank").alias("rb"), F.col("h").alias("far_h"), F.col("off").alias("far_off"))
    each = written(a.join(b, "window_id").where("ra < rb").withColumn("delta", F.col("far_off") - F.col("oa"))
                   .withColumn("exact", F.col("whole") & (F.col("rb") == 2)), "decon-pairs")
    key = ["near_h", "far_h", "delta"]
    distinct = written(each.select(*key).distinct().withColumn("pair_id", F.monotonically_increasing_id()), "decon-distinct")
    return distinct, each.join(distinct, key).select("pair_id", "window_id", "n", "far_off", "exact")


def meetings(postings: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(k1, k2, pair_id, at, exact) wherever the far term of a pair stands within ``slop`` words of ``at``, the place
    that a posting of the near one gives it; ``exact``: at that place."""
    asks = _met(postings, pairs, "near_h").select(*KEY, F.col("far_h").alias("h"), (F.col("pos") + F.col("delta")).alias("at"), "pair_id")
    line = postings.select(*KEY, "h", F.col("pos").alias("at"), F.lit(None).cast("long").alias("pair_id")).unionAll(asks)
    per, until = Window.partitionBy(*KEY, "h"), (Window.unboundedPreceding, Window.currentRow)
    stands = F.when(F.col("pair_id").isNull(), F.col("at"))  # at one place the posting sorts first
    line = line.withColumn("before", F.last(stands, True).over(per.orderBy("at", F.asc_nulls_first("pair_id")).rowsBetween(*until)))
    line = line.withColumn("after", F.last(stands, True).over(per.orderBy(F.desc("at"), F.asc_nulls_first("pair_id")).rowsBetween(*until)))
    close = F.coalesce(F.col("at") - F.col("before") <= slop, F.lit(False)) | F.coalesce(F.col("after") - F.col("at") <= slop, F.lit(False))
    return line.where(F.col("pair_id").isNotNull() & close).select(*KEY, "pair_id", "at", F.coalesce(F.col("before") == F.col("at"), F.lit(False)).alias("exact"))


def narrowed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose (k1, k2) is not among ``keys``, so that few texts are shuffled to meet
    them: a bitmap of k1 with 64 * BLOCK bits, at most BLOCK broadcast rows of 64 each whatever the number of keys.
    Rows of the keys are never lost; with very many keys fewer others are dropped."""
    bits = f"pmod(k1, {64 * BLOCK}L)"
    cell, bit = f"{bits} div 64", f"shiftleft(1L, int({bits} % 64))"
    marks = keys.select(F.expr(cell).alias("cell"), F.expr(bit).alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("marks"))
    return rows.join(F.broadcast(marks), F.expr(cell) == F.col("cell")).where(F.expr(f"(marks & {bit}) <> 0")).drop("cell", "marks")


def exact_matches(docs: DataFrame, windows: DataFrame, met: DataFrame, uses: DataFrame, postings: DataFrame, rare: DataFrame) -> DataFrame:
    """(k1, k2, window_id, n, start) of every occurrence of a window."""
    columns = [*KEY, "window_id", "n", "start"]
    several = met.where("exact").join(uses.where("exact"), "pair_id").select(*KEY, "window_id", "n", (F.col("at") - F.col("far_off")).alias("start"))
    single = _met(postings, rare.where("alone").select("h", "window_id", "n")).select(*KEY, "window_id", "n", F.col("pos").alias("start"))
    found = written(several.unionAll(single).where("start >= 0").distinct(), "decon-found")
    keys = found.select(*KEY).distinct()
    # an inner join, since a semi join would be moved below the narrowing
    suspects = narrowed(keyed(docs), keys).join(keys, KEY).dropDuplicates(KEY)
    suspects = suspects.select(*KEY, words_of(F.col("text")).alias("words"))
    phrase = F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ")
    got = suspects.join(found, KEY).select(*columns, phrase.alias("phrase")).join(windows, ["window_id", "n", "phrase"]).select(*columns)
    return written(got, "decon-exact")


def matches(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 4, item_col: str = "item_id",
            text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (k1, k2, doc_id, n_words), exact matches (k1, k2,
    start, n, item_id), proximity matches (k1, k2, item_id), which include the exact ones."""
    windows, owners = windows_of(items, width, item_col, text_col)
    rare = rarest_terms(windows, docs)
    stored = index(docs, rare)
    postings = written(stored.where("h is not null").select(*KEY, "h", "pos").distinct(), "decon-postings")  # read twice
    pairs, uses = pairs_of(rare)
    met = written(meetings(postings, pairs, slop), "decon-met")
    exact = exact_matches(docs, windows, met, uses, postings, rare).join(owners, "window_id").select(*KEY, "start", "n", "item_id")
    near = met.select(*KEY, "pair_id").distinct().join(uses.join(owners, "window_id").select("pair_id", "item_id").distinct(), "pair_id")
    return (stored.where("h is null").select(*KEY, "doc_id", "n_words"), exact,
            near.select(*KEY, "item_id").unionAll(exact.select(*KEY, "item_id")).distinct())


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 4, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) per row of ``docs``.

    ``n_hit``: words inside any occurrence of a window; ``n_items``: items with
    such windows; ``n_near``: items with a window of which two of the three rarest
    terms that occur stand within ``slop`` words of their distance there, or that occurs.
    Null or empty texts have no words; an item without words has no window.
    Repeated rows stay repeated, repeated items count once by their id.
    """
    base, exact, near = matches(id_text(docs, id_col, text_col), items, width, slop, item_col)
    covered = (exact.select(*KEY, "start", "n").distinct().select(*KEY, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("at"))
               .distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit")))
    names = exact.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(
        F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("items"))
    close = near.groupBy(*KEY).agg(F.count("*").alias("n_near"))
    out = base.join(covered, KEY, "left").join(names, KEY, "left").join(close, KEY, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
                      F.col("n_hit").isNotNull().alias("contaminated"), zero("n_near"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without any exact match, with all their columns."""
    inner = id_text(docs, id_col, text_col)
    windows, _ = windows_of(items, width, item_col, "text")
    rare = rarest_terms(windows, inner, keep=2).where("whole")  # no other window can occur
    postings = written(index(inner, rare).where("h is not null").select(*KEY, "h", "pos").distinct(), "decon-postings")
    pairs, uses = pairs_of(rare)
    hit = exact_matches(inner, windows, meetings(postings, pairs, 0), uses, postings, rare).select(*KEY).distinct()
    a, b = row_key(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return docs.join(hit, (a == hit.k1) & (b == hit.k2), "left_anti")
