"""Scope resolution, eligibility, overrides and set operations on entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators.skew import latest_per_key


def eligible_records(records: DataFrame, body: str) -> DataFrame:
    """Records with an id and a body that is not blank."""
    has_id = F.coalesce(F.length(F.col("record_id").cast("string")), F.lit(0)) > 0
    return records.filter(has_id & (F.coalesce(F.length(X.js_trim(F.col(body))), F.lit(0)) > 0))


def mode_eligible(topics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Topics that do not have the artifact of the mode's kind yet."""
    return topics.join(artifacts.select("topic_id").distinct(), "topic_id", "left_anti")


def resolve_scopes(
    requests: DataFrame, topics: DataFrame, packs: DataFrame, cross_cutting: DataFrame, effects: DataFrame, segments: DataFrame
) -> DataFrame:
    """kind, ident, topic_id, refused: the known topics of each request, or why there are none.

    ``requests``: kind (topic, pack, segment or effect) and ident; ``topics``: topic_id;
    ``packs``: pack, topic_id; ``effects``: effect_id, topic_id; ``segments``: segment, status.
    A pack stands for its topics and those that cut across packs, an active segment for the topics of all packs
    and those. An unknown kind or ident, an inactive segment, and an effect whose topics are
    all unknown are refused: one row without topic_id. A known scope without known topics has
    a row with neither. Repeated requests count once; a null ident is unknown.
    """
    asked = requests.select("kind", F.col("ident").cast("string").alias("ident")).distinct()

    def of(kind: str) -> DataFrame:
        return asked.filter(F.col("kind") == kind)

    full = topics.select("topic_id").distinct()
    pack_ids = packs.select(F.col("pack").cast("string").alias("ident"), "topic_id").distinct()
    effect_ids = effects.select(F.col("effect_id").cast("string").alias("ident"), "topic_id").distinct()
    topic_ids = full.select(F.col("topic_id").cast("string").alias("ident"), "topic_id")
    active = segments.filter("status = 'active'").select(F.col("segment").cast("string").alias("ident")).distinct()
    whole_packs = of("pack").join(pack_ids.select("ident").distinct(), "ident", "left_semi")
    whole_segments = of("segment").join(active, "ident", "left_semi")
    every = packs.select("topic_id").unionByName(cross_cutting.select("topic_id")).distinct()
    one = F.lit(1)
    named = (
        of("topic").join(topic_ids, "ident")
        .unionByName(of("effect").join(effect_ids, "ident"))
        .unionByName(whole_packs.join(pack_ids, "ident"))
        .unionByName(whole_packs.withColumn("_all", one).join(cross_cutting.select("topic_id", one.alias("_all")), "_all").drop("_all"))
        .unionByName(whole_segments.withColumn("_all", one).join(every.select("topic_id", one.alias("_all")), "_all").drop("_all"))
    )
    found = named.join(full, "topic_id", "left_semi").select("kind", "ident", "topic_id").distinct()
    known = whole_packs.unionByName(whole_segments).select("kind", "ident")
    left = asked.join(found, (asked["kind"] == found["kind"]) & (asked["ident"] == found["ident"]), "left_anti")
    accepted = known.withColumn("_known", F.lit(True))
    left = left.join(accepted, ["kind", "ident"], "left").join(effect_ids.select("ident", F.lit(True).alias("_effect")).distinct(), "ident", "left")
    reason = (
        F.when(F.col("_known"), None)
        .when(F.col("kind") == "segment", "unknown_active_segment")
        .when((F.col("kind") == "effect") & F.col("_effect"), "effect_without_full_topic")
        .when(F.col("kind").isin("topic", "pack", "effect"), F.concat(F.lit("unknown_"), "kind"))
        .otherwise("unknown_kind")
    )
    none = F.lit(None).cast(topics.schema["topic_id"].dataType).alias("topic_id")
    refused = left.select("kind", "ident", none, reason.alias("refused"))
    return found.withColumn("refused", F.lit(None).cast("string")).unionByName(refused)


def is_live(status: Column) -> Column:
    return status.isin(V.LIVE_STATUSES)


def is_actionable(status: Column) -> Column:
    return status.isin(V.ACTIONABLE_STATUSES)


def is_valid_full_record(implementations: Column, hard_rules: Column) -> Column:
    measured = F.forall(implementations, lambda i: F.coalesce(F.size(i["metrics"]) > 0, F.lit(False)))
    return F.coalesce(
        (F.size(implementations) > 0) & measured & (F.size(hard_rules) > 0), F.lit(False)
    )


def bootstrap_segments(segments: DataFrame, stages: DataFrame) -> DataFrame:
    """Active segments nobody mapped to stages yet."""
    return segments.filter("status = 'active'").join(stages.select("segment").distinct(), "segment", "left_anti")


def overlay(preferred: DataFrame, fallback: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``preferred``; a key it lacks comes from the newest of ``fallback``."""
    ranked = preferred.withColumn("_p", F.lit(1)).unionByName(fallback.withColumn("_p", F.lit(0)))
    return latest_per_key(ranked, [key], ["_p", order]).drop("_p")


def upsert_latest(history: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Batch rows replace history rows of the same key; the rest stays."""
    both = history.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    return latest_per_key(both, keys, ["_batch", order]).drop("_batch")


def unresolved(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """References without a target: what a strict join would raise on."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def terminal_union(previous: DataFrame, delta: DataFrame) -> DataFrame:
    keys = ["topic_id", "kind", "mode", "effect_id", "record_id"]
    return previous.select(*keys).unionByName(delta.select(*keys)).distinct()


def contradictory_states(coverage: DataFrame) -> DataFrame:
    keys = ["topic_id", "kind", "mode", "record_id"]
    done = coverage.filter("state = 'processed'").select(*keys)
    skipped = coverage.filter("state = 'skipped_irrelevant'").select(*keys)
    return done.intersect(skipped)


def text_from_inverted_index(df: DataFrame, row_id: str, index: str) -> DataFrame:
    """Rebuild text from map<word, positions>: a later word wins a position.

    Words are placed with a map keyed by position inside the row; gaps vanish.
    """
    entries = F.map_entries(index)
    placed = F.flatten(
        F.transform(
            entries,
            lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), (-i).alias("late"), e["key"].alias("word"))),
        )
    )
    ordered = F.array_sort(placed)

    def words(sorted_entries: Column) -> Column:
        kept = F.filter(
            sorted_entries,
            lambda e, i: (i == 0) | (e["pos"] != F.get(sorted_entries, i - 1)["pos"]),
        )
        return F.array_join(F.filter(F.transform(kept, lambda e: e["word"]), lambda w: w != ""), " ")

    text = F.trim(X.bind(ordered, words))
    return df.select(row_id, F.when(F.length(text) > 0, text).alias("text"))
