"""Benchmark decontamination with a distributed positional inverted index.

The benchmark asks for phrases: every run of 13 words of an item. From all text the index
stores the positions of the terms that the phrases need, the rarest two of each. Lists of
these terms, moved by their offsets in the phrase, are intersected; what is left is
compared with the words of the document. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.session import cut_lineage

PHRASE_WORDS = 13
ANCHORS = 2
BROADCAST_ROWS = 200_000
# Words: lower-case a-z, digits, and every character beyond ASCII.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, with A-Z lower-cased and no other letter changed; null has none."""
    text = F.coalesce(text, F.lit(""))
    # For a text of single bytes the fast lower() changes nothing else.
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _SEPARATORS), "")


def _if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where the table is counted to be small; beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def phrases(items: DataFrame, size: int = PHRASE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(distinct phrases: phrase_id, phrase, n; which items have them: phrase_id, item_id).

    An item of fewer words is one phrase; an item without words has none.
    """
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.lit(size), F.size("w"))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    every = split.select("item_id", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("phrase"))
    every = cut_lineage(every.distinct())
    distinct = cut_lineage(every.select("phrase", "n").distinct().withColumn("phrase_id", F.monotonically_increasing_id()))
    return distinct, every.join(distinct, ["phrase", "n"]).select("phrase_id", "item_id")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: together the identity of a row; equal rows share it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _terms(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text_key", F.posexplode(words(F.col("text"))).alias("pos", "term"))


def anchors(docs: DataFrame, distinct: DataFrame, count: int = ANCHORS) -> DataFrame:
    """phrase_id, term, offset, bit, all_bits: the ``count`` rarest terms of each phrase.

    Rarity is the number of occurrences in all of ``docs``. A phrase with a term that never
    occurs is left out.
    """
    split = distinct.select("phrase_id", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    wanted = cut_lineage(split.select("term").distinct())
    found = _terms(docs).select("term").join(_if_small(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    counted = split.join(cut_lineage(found), "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_phrase = Window.partitionBy("phrase_id")
    ranked = counted.withColumns(
        {
            "rank": F.row_number().over(by_phrase.orderBy("df", "offset")),
            "rarest": F.min("df").over(by_phrase),
            "terms": F.count(F.lit(1)).over(by_phrase),
        }
    )
    chosen = ranked.filter((F.col("rarest") > 0) & (F.col("rank") <= count))
    all_bits = (F.pow(F.lit(2), F.least("terms", F.lit(count))) - 1).cast("int")
    bit = F.pow(F.lit(2), F.col("rank") - 1).cast("int")
    return chosen.select("phrase_id", "term", "offset", bit.alias("bit"), all_bits.alias("all_bits"))


def build_index(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The stored postings of all anchor terms: term, doc_id, text_key, pos."""
    wanted = _if_small(chosen.select("term").distinct())
    return cut_lineage(_terms(docs).join(wanted, "term", "left_semi").select("term", "doc_id", "text_key", "pos"))


def intersect(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text_key, start, phrase_id where all anchors of the phrase stand in place."""
    moved = index.join(_if_small(chosen), "term").select("doc_id", "text_key", (F.col("pos") - F.col("offset")).alias("start"), "phrase_id", "bit", "all_bits")
    met = moved.groupBy("doc_id", "text_key", "start", "phrase_id").agg(F.bit_or("bit").alias("bits"), F.first("all_bits").alias("all_bits"))
    return met.filter((F.col("bits") == F.col("all_bits")) & (F.col("start") >= 0)).select("doc_id", "text_key", "start", "phrase_id")


def exact_matches(docs: DataFrame, distinct: DataFrame, placed: DataFrame) -> DataFrame:
    """All rows of ``docs`` with n_words and matches: array of (start, n, phrase_id), by start.

    The candidates of a document, a few for each of its words at most, meet its text once.
    """
    named = placed.join(_if_small(distinct), "phrase_id")
    listed = named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "n", "phrase_id", "phrase"))).alias("candidates"))
    d, c = docs.alias("d"), listed.alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.text_key") == F.col("c.text_key"))
    both = d.join(c, same, "left").select("d.doc_id", "d.text_key", words(F.col("d.text")).alias("w"), "c.candidates")
    holds = F.filter(
        F.coalesce("candidates", F.array().cast("array<struct<start:int,n:int,phrase_id:bigint,phrase:string>>")),
        lambda m: F.array_join(F.slice(F.col("w"), m["start"] + 1, m["n"]), " ") == m["phrase"],
    )
    slim = F.transform(holds, lambda m: F.struct(m["start"].alias("start"), m["n"].alias("n"), m["phrase_id"].alias("phrase_id")))
    return both.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), slim.alias("matches"))


def words_hit(matches: Column) -> Column:
    """Number of words inside at least one match; matches come by ascending start."""
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def step(seen: Column, m: Column) -> Column:
        end = m["start"] + m["n"]
        fresh = F.greatest(end - F.greatest(m["start"], seen["end"]), F.lit(0)).cast("long")
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["hit"] + fresh).alias("hit"))

    return F.aggregate(matches, begin, step, lambda s: s["hit"])


def find_contamination(docs: DataFrame, items: DataFrame, size: int = PHRASE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated where at least a twentieth of its words, and at least one,
    lies in a phrase of the benchmark. Equal rows get equal results; null texts and items
    have no words; with no items nothing is hit. Other columns are ignored.
    """
    rows = keyed(docs)
    distinct, owners = phrases(items, size)
    chosen = cut_lineage(anchors(rows, distinct))
    placed = intersect(build_index(rows, chosen), chosen)
    found = exact_matches(rows, distinct, placed).withColumn("n_hit", words_hit(F.col("matches")))
    # Only the few documents with a match go on to the items.
    found = cut_lineage(found.select("doc_id", "text_key", "n_words", "n_hit", F.transform("matches", lambda m: m["phrase_id"]).alias("ids")))
    hit = found.filter("n_hit > 0").dropDuplicates(["doc_id", "text_key"])
    pairs = hit.select("doc_id", "text_key", F.explode("ids").alias("phrase_id")).distinct().join(_if_small(owners), "phrase_id")
    owned = pairs.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    d, o = found.alias("d"), owned.alias("o")
    same = F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_key") == F.col("o.text_key"))
    n_items = F.coalesce(F.size("o.items"), F.lit(0))
    return d.join(o, same, "left").select(
        "d.doc_id",
        "d.text_key",
        "d.n_words",
        "d.n_hit",
        F.greatest(n_items, F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("o.items", ","), F.lit("")), 256).alias("items_sha256"),
        ((F.col("d.n_hit") > 0) & (20 * F.col("d.n_hit") >= F.col("d.n_words"))).alias("contaminated"),
    )


def proximity_matches(index: DataFrame, chosen: DataFrame, slack: int) -> DataFrame:
    """doc_id, text_key, phrase_id, pos, gap: both anchors within ``slack`` words of their distance.

    ``gap`` is the closest difference from the distance in the phrase (0: in place).
    Positions are cut into cells of ``slack`` + 1 words, so a posting meets those of its own
    and the neighbouring cells only.
    """
    cell = F.lit(slack + 1)
    moved = index.join(_if_small(chosen.filter("all_bits = 3")), "term").withColumn("start", F.col("pos") - F.col("offset"))
    first = moved.filter("bit = 1").select("doc_id", "text_key", "phrase_id", "pos", "start", F.floor(F.col("start") / cell).alias("cell"))
    around = F.explode(F.array(*[F.floor(F.col("start") / cell) + i for i in (-1, 0, 1)]))
    second = moved.filter("bit = 2").select("doc_id", "text_key", "phrase_id", F.col("start").alias("other"), around.alias("cell"))
    f, s = first.alias("f"), second.alias("s")
    same = F.col("f.doc_id").eqNullSafe(F.col("s.doc_id"))
    for c in ("text_key", "phrase_id", "cell"):
        same &= F.col(f"f.{c}") == F.col(f"s.{c}")
    gap = F.abs(F.col("s.other") - F.col("f.start"))
    met = f.join(s, same).select("f.doc_id", "f.text_key", "f.phrase_id", "f.pos", gap.alias("gap")).filter(F.col("gap") <= slack)
    return met.groupBy("doc_id", "text_key", "phrase_id", "pos").agg(F.min("gap").alias("gap"))
