"""Citation and relation edges: coverage, shared references, neighbours, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions.scalars import grade_rank, pair_key, round4, weaker_grade
from corroborate.operators.entity import match_any_key
from corroborate.operators.skew import skew_join


def top_reviews(records: DataFrame, eligible: Column, top: int = 2) -> DataFrame:
    """The most cited eligible reviews; a total order and a limit, nothing is collected."""
    return (
        records.filter(eligible)
        .orderBy(F.desc(F.coalesce("citations", F.lit(-1))), F.asc("record_id"))
        .limit(top)
    )


def reference_state(edges: DataFrame, resolved: DataFrame, corpus: DataFrame, keys: list[str]) -> DataFrame:
    """Each (review, ref) with flags: resolved and already in the corpus.

    ``edges``: review, ref; ``resolved``: ref and its key columns; ``corpus``: ref
    ids known directly plus key columns. Matching is one equi-join per key.
    """
    refs = edges.select("ref").distinct()
    known_ids = corpus.select(F.col("ref")).filter("ref IS NOT NULL").distinct()
    by_id = refs.join(known_ids, "ref", "left_semi").select("ref", F.lit(True).alias("by_id"))
    found = refs.join(resolved, "ref")
    by_key = match_any_key(found, corpus, "ref", keys).withColumn("by_key", F.lit(True))
    flags = (
        refs.join(by_id, "ref", "left")
        .join(found.select("ref").distinct().withColumn("has_meta", F.lit(True)), "ref", "left")
        .join(by_key, "ref", "left")
        .select(
            "ref",
            F.coalesce(F.col("by_id"), F.col("has_meta"), F.lit(False)).alias("is_resolved"),
            F.coalesce(F.col("by_id"), F.col("by_key"), F.lit(False)).alias("in_corpus"),
        )
    )
    return skew_join(edges, flags, "ref")


def review_coverage(state: DataFrame) -> DataFrame:
    counted = state.groupBy("review").agg(
        F.count(F.lit(1)).alias("references_total"),
        F.count_if("is_resolved").alias("references_resolved"),
        F.count_if(F.col("in_corpus")).alias("references_in_corpus"),
    )
    return counted.withColumn(
        "coverage",
        F.when(
            F.col("references_resolved") > 0,
            round4(F.col("references_in_corpus") / F.col("references_resolved")),
        ),
    )


def shared_references(state: DataFrame, min_reviews: int = 2) -> DataFrame:
    """Missing, resolvable references that several reviews cite."""
    missing = state.filter(F.col("is_resolved") & ~F.col("in_corpus"))
    return (
        missing.groupBy("ref")
        .agg(F.countDistinct("review").alias("reviews"))
        .filter(F.col("reviews") >= min_reviews)
    )


def expand_anchors(
    candidates: DataFrame, edges: DataFrame, anchor_limit: int = 20, neighbour_limit: int = 25
) -> DataFrame:
    """One-hop neighbours of the first topical anchors, in both directions.

    ``candidates``: anchor, seq, topical; ``edges``: src, dst. Limits are the
    operator's own; ranking inside a direction prunes map-side.
    """
    anchors = (
        candidates.filter("topical").groupBy("anchor").agg(F.min("seq").alias("seq")).orderBy("seq").limit(anchor_limit)
    )
    anchors = F.broadcast(anchors.select("anchor"))  # at most anchor_limit rows
    back = edges.join(anchors, edges.src == F.col("anchor")).select("anchor", F.lit("backward").alias("direction"), F.col("dst").alias("neighbour"))
    forward = edges.join(anchors, edges.dst == F.col("anchor")).select("anchor", F.lit("forward").alias("direction"), F.col("src").alias("neighbour"))
    both = back.unionByName(forward).distinct()
    order = Window.partitionBy("anchor", "direction").orderBy("neighbour")
    return both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= neighbour_limit).drop("rn")


def anchor_counters(candidates: DataFrame) -> DataFrame:
    return candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("topical").alias("confirmed"),
        F.count_if(~F.col("topical")).alias("rejected"),
        F.when(F.count(F.lit(1)) > 0, round4(F.count_if("topical") / F.count(F.lit(1)))).otherwise(F.lit(0.0)).alias("confirmation_rate"),
    )


# --- pairs inside packs -----------------------------------------------------------------
def connected_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct unordered (pack, a, b) joined by a relation of two members of the pack.

    ``members``: pack, topic_id; ``edges``: a, b in any direction. Only existing
    edges are joined, pairs are never enumerated.
    """
    undirected = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = members.select("pack", F.col("topic_id").alias("a"))
    right = members.select("pack", F.col("topic_id").alias("b"))
    return undirected.join(left, "a").join(right, ["pack", "b"]).select("pack", "a", "b").distinct()


def interaction_coverage(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected share of all member pairs per pack; one member alone counts as covered."""
    size = members.groupBy("pack").agg(F.countDistinct("topic_id").alias("members"))
    linked = connected_pairs(members, edges).groupBy("pack").agg(F.count(F.lit(1)).alias("connected"))
    possible = F.col("members") * (F.col("members") - 1) / 2
    return size.join(linked, "pack", "left").select(
        "pack",
        "members",
        F.coalesce("connected", F.lit(0)).alias("connected"),
        F.when(F.col("members") < 2, F.lit(1.0))
        .otherwise(F.coalesce("connected", F.lit(0)) / possible)
        .alias("coverage"),
    )


def missing_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Unconnected member pairs. The report is the complement inside authored packs,
    so its size is that of the answer; it streams through an equi-join on the pack."""
    left = members.select("pack", F.col("topic_id").alias("a"))
    right = members.select("pack", F.col("topic_id").alias("b"))
    return left.join(right, "pack").filter("a < b").join(connected_pairs(members, edges), ["pack", "a", "b"], "left_anti")


RELATION_KINDS = {"enables": "sequence-amplifying", "enabled_by": "sequence-amplifying", "hybrid_with": "reinforcing", "adjacent": "noted"}


def pack_interactions(members: DataFrame, authored: DataFrame, relations: DataFrame, grades: DataFrame) -> DataFrame:
    """Authored pairs first, then relations of pairs nobody authored, one per kind and pair.

    ``authored``: a, b, type, fact, grade; ``relations``: src, dst, type, note, seq.
    """
    left = members.select("pack", F.col("topic_id").alias("a"))
    right = members.select("pack", F.col("topic_id").alias("b"))
    own = (
        authored.join(left, "a")
        .join(right, ["pack", "b"])
        .select("pack", "a", "b", F.col("type").alias("kind"), "fact", "grade", F.lit("authored").alias("origin"))
    )
    kind = F.lit(None).cast("string")
    for name, mapped in RELATION_KINDS.items():
        kind = F.when(F.col("type") == name, F.lit(mapped)).otherwise(kind)
    turned = F.col("type") == "enabled_by"
    mapped = relations.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("a"),
        F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("b"),
        "kind",
        F.col("note").alias("fact"),
        "seq",
    )
    inside = mapped.join(left, "a").join(right, ["pack", "b"]).withColumn("pair", pair_key(F.col("a"), F.col("b")))
    taken = own.select("pack", pair_key(F.col("a"), F.col("b")).alias("pair")).distinct()
    fresh = inside.join(taken, ["pack", "pair"], "left_anti")
    first = fresh.groupBy("pack", "kind", "pair").agg(F.min_by(F.struct("a", "b", "fact"), "seq").alias("r")).select("pack", "kind", "r.*")
    graded = first.join(grades.select(F.col("topic_id").alias("a"), F.col("grade").alias("ga")), "a").join(
        grades.select(F.col("topic_id").alias("b"), F.col("grade").alias("gb")), "b"
    )
    derived = graded.filter(grade_rank(F.col("ga")).isNotNull() & grade_rank(F.col("gb")).isNotNull()).select(
        "pack", "a", "b", "kind", "fact", weaker_grade(F.col("ga"), F.col("gb")).alias("grade"), F.lit("relation").alias("origin")
    )
    return own.unionByName(derived)


def pair_backlog(cells: DataFrame, missing: DataFrame, authored: DataFrame) -> DataFrame:
    """Missing pairs over all cells that ask for them, ranked by their best importance.

    ``cells``: pack, segment, importance (one row per authoring task).
    """
    asked = missing.join(cells, "pack").withColumn("pair", pair_key(F.col("a"), F.col("b")))
    done = authored.select(pair_key(F.col("a"), F.col("b")).alias("pair"), F.lit(True).alias("authored")).distinct()
    return (
        asked.groupBy("pair")
        .agg(F.max("importance").alias("importance"), F.count(F.lit(1)).alias("cells"))
        .join(done, "pair", "left")
        .withColumn("authored", F.coalesce("authored", F.lit(False)))
    )
