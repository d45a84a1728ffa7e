"""Duplicate resolution across sources: clusters, merged records, curated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.functions.scalars import quarter_key
from corroborate.operators.skew import latest_per_key, prefix_scan, skew_join
from corroborate.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for undirected edges ``a``-``b``; the root is the smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Lineage is
    cut every round in the reliable checkpoint folder.
    """
    pairs = (
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .filter("hi <> lo")
        .distinct()
    )
    pairs = cut_lineage(pairs)
    mark = _edge_mark(pairs)
    while mark[0]:
        pairs = cut_lineage(_small_star(_large_star(pairs)))
        now = _edge_mark(pairs)
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def _edge_mark(pairs: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))
    return tuple(pairs.agg(F.count(F.lit(1)), digest).first())


def _with_minimum(near: DataFrame) -> DataFrame:
    """Attach to every (u, v) the smallest v of u."""
    return skew_join(near, near.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(pairs: DataFrame) -> DataFrame:
    there = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    back = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    near = _with_minimum(there.unionByName(back))
    target = F.least("u", "m")
    return (
        near.filter("v > u").select(F.col("v").alias("hi"), target.alias("lo")).distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    down = _with_minimum(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    ends = F.array(
        F.struct(F.col("v").alias("hi"), F.col("m").alias("lo")),
        F.struct(F.col("u").alias("hi"), F.col("m").alias("lo")),
    )
    return down.select(F.inline(ends)).filter("hi <> lo").distinct()


def resolve_entities(df: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """Add ``cluster``: rows sharing any non-null key, transitively.

    The graph has key values as nodes: a row with several keys only links those
    keys, so copies of one record collapse to a handful of edges before anything
    is joined.
    """
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k))) for k in keys]
    rows = df.withColumn("_keys", F.array_compact(F.array(*tagged))).withColumn(
        "node", F.get("_keys", F.lit(0))
    )
    edges = (
        rows.filter(F.size("_keys") > 1)
        .select(F.col("node").alias("a"), F.explode("_keys").alias("b"))
        .filter("a <> b")
        .distinct()
    )
    labelled = skew_join(rows, connected_components(edges), "node", how="left")
    alone = F.concat(F.lit("row:"), F.col(row_id).cast("string"))
    return labelled.withColumn("cluster", F.coalesce("root", "node", alone)).select(
        *df.columns, "cluster"
    )


RECORD_FIELDS = [
    "topic_id", "title", "authors", "year", "venue", "doi", "citations", "abstract", "openalex_id",
    "openalex_type", "referenced_works_count", "source_api",
]
FILLED = [
    "doi", "year", "venue", "citations", "abstract", "openalex_id", "openalex_type",
    "referenced_works_count",
]


def merge_cluster(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One record per cluster: most cited base, gaps filled in input order."""
    present = [c for c in RECORD_FIELDS if c in df.columns]
    strength = F.struct(
        F.coalesce(F.col("citations"), F.lit(-1)), F.col("doi").isNotNull(), -F.col(seq)
    )
    aggs = [
        F.max_by(F.struct(*present), strength).alias("_base"),
        F.min(seq).alias(seq),
        F.count(F.lit(1)).alias("cluster_size"),
    ]
    for c in FILLED:
        if c in present:
            aggs.append(_first_known(F.col(c), F.col(c).isNotNull(), seq).alias(f"_fill_{c}"))
    if "authors" in present:
        known = F.coalesce(F.size("authors"), F.lit(0)) > 0
        aggs.append(_first_known(F.col("authors"), known, seq).alias("_fill_authors"))
    if "search_angles" in df.columns:
        for angle in V.ANGLES:
            seen = F.coalesce(F.array_contains("search_angles", angle), F.lit(False))
            aggs.append(F.bool_or(seen).alias(f"_angle_{angle}"))
    merged = df.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col(seq), F.col("cluster_size")]
    for c in present:
        base = F.col(f"_base.{c}")
        if c == "authors":
            out.append(
                F.when(F.coalesce(F.size(base), F.lit(0)) > 0, base)
                .otherwise(F.coalesce("_fill_authors", base))
                .alias(c)
            )
        elif c in FILLED:
            out.append(F.coalesce(base, F.col(f"_fill_{c}")).alias(c))
        else:
            out.append(base.alias(c))
    if "search_angles" in df.columns:
        flags = [F.when(F.col(f"_angle_{a}"), F.lit(a)) for a in V.ANGLES]
        out.append(F.array_compact(F.array(*flags)).alias("search_angles"))
    return merged.select(*out)


def _first_known(value: Column, known: Column, seq: str) -> Column:
    return F.min_by(value, F.when(known, F.col(seq)))


def match_any_key(left: DataFrame, right: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """Ids of ``left`` rows sharing at least one non-null key with ``right``.

    One equi-join per key and a union; an OR condition would force a nested loop.
    """
    hits = None
    for key in keys:
        known = right.select(key).filter(F.col(key).isNotNull()).distinct()
        part = left.join(known, key, "left_semi").select(row_id)
        hits = part if hits is None else hits.unionByName(part)
    return hits.distinct()


def merge_pinned(records: DataFrame, pins: DataFrame, seq: str) -> DataFrame:
    """Curated rows win over the first record with their DOI or title key, else append."""
    found = None
    for key in ["doi", "title_key"]:
        part = (
            pins.select("pin_id", key)
            .filter(F.col(key).isNotNull())
            .join(records.groupBy(key).agg(F.min(seq).alias(seq)), key)
            .select("pin_id", seq)
        )
        found = part if found is None else found.unionByName(part)
    target = found.groupBy("pin_id").agg(F.min(seq).alias(seq))
    placed = pins.join(target, "pin_id", "left")
    owner = latest_per_key(placed.filter(F.col(seq).isNotNull()), [seq], ["pin_id"])
    gaps = [c for c in FILLED if c in records.columns and c in pins.columns]
    shared = [c for c in RECORD_FIELDS if c in records.columns and c not in ("source_api",)]
    p, r = owner.alias("p"), records.alias("r")
    pinned_wins = F.coalesce(F.col("p.citations"), F.lit(-1)) >= F.coalesce(
        F.col("r.citations"), F.lit(-1)
    )
    # Equal citation counts keep the curated row unless only the other one has a DOI.
    pinned_wins = pinned_wins & ~(
        F.coalesce(F.col("p.citations"), F.lit(-1)).eqNullSafe(
            F.coalesce(F.col("r.citations"), F.lit(-1))
        )
        & F.col("p.doi").isNull()
        & F.col("r.doi").isNotNull()
    )
    cols = []
    for c in shared:
        if c not in pins.columns:
            cols.append(F.col(f"r.{c}").alias(c))
            continue
        first = F.when(pinned_wins, F.col(f"p.{c}")).otherwise(F.col(f"r.{c}"))
        if c in gaps:
            first = F.coalesce(first, F.col(f"p.{c}"), F.col(f"r.{c}"))
        plain = F.when(F.col("p.pin_id").isNull(), F.col(f"r.{c}")).otherwise(first)
        cols.append(plain.alias(c))
    is_pin = F.col("p.pin_id").isNotNull()
    overlay = r.join(p, seq, "left").select(
        *cols,
        F.when(is_pin, "pinned").otherwise(F.col("r.source_api")).alias("source_api"),
        F.col("p.pin_reason").alias("pin_reason"),
        F.lit(False).alias("appended"),
    )
    fresh = placed.filter(F.col(seq).isNull())
    appended = fresh.select(
        *[F.col(c) if c in pins.columns else F.lit(None).alias(c) for c in shared],
        F.lit("pinned").alias("source_api"),
        "pin_reason",
        F.lit(True).alias("appended"),
    )
    return overlay.unionByName(appended)


def id_violations(df: DataFrame, identity: str, record_id: str) -> DataFrame:
    """Collisions (one id, two identities), duplicates and rows without an identity."""
    groups = df.groupBy(record_id).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(identity).alias("identities")
    )
    kind = (
        F.when(F.col(record_id).isNull(), "empty_identity")
        .when(F.col("identities") > 1, "collision")
        .when(F.col("rows") > 1, "duplicate_identity")
    )
    return groups.withColumn("violation", kind).filter(F.col("violation").isNotNull())


def union_citations(citations: DataFrame) -> DataFrame:
    """Distinct by (item, topic, record, normalised quote); the last one wins."""
    keyed = citations.withColumn("_norm", X.norm_quality(F.col("quote")))
    kept = latest_per_key(keyed, ["item_id", "topic_id", "record_id", "_norm"], ["pos"])
    return kept.drop("_norm")


def register_spans(spans: DataFrame) -> DataFrame:
    """Give identical spans one reference number per item, in first-seen order."""
    unique = spans.groupBy("item_id", "record_id", "start", "end").agg(
        F.min("pos").alias("first_pos"), F.min_by("span_role", "pos").alias("span_role")
    )
    return prefix_scan(unique, ["item_id"], [F.col("first_pos")], position="ref_no").withColumn(
        "ref", F.concat(F.lit("p"), F.col("ref_no").cast("string"))
    )


def longer_text(left: Column, right: Column) -> Column:
    """The text with the longer normalised form; the left one on a tie."""
    longer = F.length(X.norm_quality(right)) > F.length(X.norm_quality(left))
    return F.when(longer, right).otherwise(left)


def proposal_identity(kind: Column, target: Column, name: Column, field: Column) -> Column:
    clean = X.norm_quality(name)
    return (
        F.when(kind.isin("effect", "realization"), F.concat_ws(":", kind, target, clean))
        .when(kind == "interaction", F.concat_ws(":", kind, name))
        .when(kind == "dossier_section", F.concat_ws(":", F.lit("dossier"), target, field, clean))
        .otherwise(F.concat_ws(":", kind, target, name))
    )


def first_per_quarter(captures: DataFrame, domain: str, ts: str, tie: str) -> DataFrame:
    keyed = captures.withColumn("quarter", quarter_key(F.col(ts)))
    rest = [c for c in captures.columns if c != domain]
    first = F.min_by(F.struct(*rest), F.struct(ts, tie)).alias("_row")
    return keyed.groupBy(domain, "quarter").agg(first).select(domain, "quarter", "_row.*")
