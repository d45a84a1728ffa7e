"""Grounding of quotes to character spans, span audits and role checks.

Offsets are 0-based code points, end exclusive. ``X.norm_quality`` is the
comparison form on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import arrow
from corroborate.functions import text as X
from corroborate.functions import vocabulary as V
from corroborate.operators.sieve import keep_wanted
from corroborate.operators.skew import skew_join
from corroborate.session import cut_lineage

GRAM = 5
SHORT_GRAM = 8


def needle_pattern(needle: Column) -> Column:
    """Pattern over lower-cased text that a normalised needle corresponds to."""
    return F.replace(needle, F.lit(" "), F.lit("[^a-z0-9]+"))


def plain_folding(source: Column) -> Column:
    """True where folding keeps one character per character, so offsets carry over."""
    return ~source.rlike(X.NFKC_UNSTABLE) & (F.length(F.lower(source)) == F.length(source))


def span_of(source: Column, needle: Column, occurrence: Column | None = None) -> Column:
    """struct(start, end) of a normalised needle known to occur, else null.

    First occurrences in plainly folding text use the regex engine of the JVM;
    only the others reach the Arrow UDF.
    """
    nth = F.lit(0) if occurrence is None else occurrence
    native = plain_folding(source) & (nth == 0)

    def quick(folded: Column) -> Column:
        hit = F.call_function("regexp_extract", folded, needle_pattern(needle), F.lit(0))
        at = F.regexp_instr(folded, needle_pattern(needle))
        return F.when(
            at > 0,
            F.struct(
                (at - 1).cast("bigint").alias("start"),
                (at - 1 + F.length(hit)).cast("bigint").alias("end"),
            ),
        )

    slow = arrow.locate_span(F.when(~native, source), needle, nth)
    return F.coalesce(
        X.bind(F.when(native, F.lower(source)), quick), F.when(slow["start"].isNotNull(), slow)
    )


def slice_text(source: Column, start: Column, end: Column) -> Column:
    return F.substring(source, (start + 1).cast("int"), (end - start).cast("int"))


def derive_quote(source: Column, start: Column, end: Column) -> Column:
    """The slice of a valid span; null when out of range or blank."""
    fits = (start >= 0) & (end > start) & (end <= F.length(source))
    piece = F.when(fits, slice_text(source, start, end))
    return F.when(F.length(X.js_trim(piece)) > 0, piece)


def ground_quotes(quotes: DataFrame, sources: DataFrame, row_id: str) -> DataFrame:
    """Locate each quote in the source text of its own record.

    ``quotes``: row_id, record_id, quote[, occurrence]; ``sources``: record_id,
    source_text. Containment prunes natively before any span is computed; texts
    that no quote cites are neither normalised nor moved.
    """
    nth = F.col("occurrence") if "occurrence" in quotes.columns else F.lit(0)
    prepared = quotes.withColumn("needle", X.norm_quality(F.col("quote"))).withColumn("_nth", nth)
    cited = keep_wanted(sources, F.col("record_id"), quotes, F.col("record_id"))
    hay = cited.select(
        "record_id", "source_text", X.norm_quality(F.col("source_text")).alias("hay")
    )
    joined = skew_join(prepared, hay, "record_id", how="left")
    inside = (F.col("needle") != "") & F.contains("hay", "needle")
    span = span_of(F.when(inside, F.col("source_text")), F.col("needle"), F.col("_nth"))
    return (
        joined.withColumn("_span", F.when(inside, span))
        .withColumn("start", F.col("_span.start"))
        .withColumn("end", F.col("_span.end"))
        .withColumn(
            "derived",
            F.when(F.col("start").isNotNull(), slice_text(F.col("source_text"), F.col("start"), F.col("end"))),
        )
        .drop("_span", "_nth", "needle", "hay", "source_text")
    )


def find_passages(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """Which documents contain which passages, and where.

    ``passages``: passage_id, passage; ``documents``: doc_id, text. Containment is
    not token-aligned: the first and last word of a passage may be cut in a document,
    the words between are whole. Anchors are runs of up to five of these; passages of
    one or two words use their own leading bytes. The anchors of all passages form
    a bounded bit set that the scan of the documents probes, so only rows that meet one
    leave it. Per passage the rarest anchor joins, texts move only where there is a
    candidate, and each is verified as a whole, so the result is exact.
    """
    needles = passages.select("passage_id", X.norm_quality(F.col("passage")).alias("needle")).filter("needle <> ''")
    distinct = needles.select("needle").distinct().withColumn("words", F.split("needle", " "))
    inside = F.least(F.size("words") - 2, F.lit(GRAM))
    leading = F.least(F.octet_length("needle"), F.lit(SHORT_GRAM))
    whole = inside > 0
    grams = F.when(whole, _interior_grams(F.col("words"))).otherwise(
        F.array(_char_gram(F.substring(F.col("needle").cast("binary"), F.lit(1), leading)))
    )
    anchors = cut_lineage(
        distinct.select(
            "needle", F.when(whole, inside).otherwise(-leading).alias("kind"), F.explode(F.array_distinct(grams)).alias("gram")
        )
    )
    kinds = [row.kind for row in anchors.select("kind").distinct().collect()]  # at most GRAM + SHORT_GRAM values
    hay = documents.select("doc_id", X.norm_quality(F.col("text")).alias("hay"))
    met = keep_wanted(
        hay.select("doc_id", F.explode(_grams_of(F.col("hay"), kinds)).alias("gram")), F.col("gram"), anchors, F.col("gram")
    )
    shared = cut_lineage(met.join(anchors.select("gram").distinct(), "gram", "left_semi").distinct())
    counted = shared.groupBy("gram").agg(F.count(F.lit(1)).alias("docs"))
    rarest = (
        anchors.join(counted, "gram", "left")
        .groupBy("needle")
        .agg(F.min_by(F.struct("gram", "docs"), F.struct(F.coalesce("docs", F.lit(0)), "gram")).alias("a"))
        .filter("a.docs > 0")
        .select("needle", "a.gram")
    )
    candidates = cut_lineage(skew_join(shared, rarest, "gram").select("doc_id", "needle"))
    texts = keep_wanted(documents.select("doc_id", "text"), F.col("doc_id"), candidates, F.col("doc_id"))
    checked = skew_join(candidates, texts, "doc_id").filter(F.contains(X.norm_quality(F.col("text")), F.col("needle")))
    hits = checked.withColumn("_span", span_of(F.col("text"), F.col("needle"))).select(
        "needle",
        "doc_id",
        F.col("_span.start").alias("start"),
        F.col("_span.end").alias("end"),
        slice_text(F.col("text"), F.col("_span.start"), F.col("_span.end")).alias("quote"),
    )
    return skew_join(needles, hits, "needle").drop("needle")


def _spots(count: Column) -> Column:
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def _word_grams(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words; each word is hashed once."""
    return X.bind(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(
            _spots(F.size(h) - size + 1), lambda i: F.xxhash64(F.lit("w"), *[F.get(h, i + (k - 1)) for k in range(size)])
        ),
    )


def _interior_grams(words: Column) -> Column:
    """Runs of whole words of a passage: five of them, or all where there are fewer."""
    inside = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    grams = F.array().cast("array<bigint>")
    for size in range(GRAM, 0, -1):
        fits = F.size(words) - 2 >= GRAM if size == GRAM else F.size(words) - 2 == size
        grams = F.when(fits, _word_grams(inside, size)).otherwise(grams)
    return grams


def _grams_of(hay: Column, kinds: list[int]) -> Column:
    """Grams of a text of the kinds that occur: n words (n > 0) or -n bytes."""
    sizes = sorted(k for k in kinds if k > 0)
    words = X.bind(F.split(hay, " "), lambda w: F.concat(*[_word_grams(w, n) for n in sizes])) if sizes else None
    parts = [p for p in (words, *[_char_grams(hay, -k) for k in sorted(kinds) if k < 0]) if p is not None]
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def _char_gram(piece: Column) -> Column:
    return F.xxhash64(F.lit("c"), piece)


def _char_grams(hay: Column, n: int) -> Column:
    """Hashes of all runs of ``n`` bytes; a slice of bytes does not walk the text to its place."""
    return X.bind(
        hay.cast("binary"),
        lambda h: F.transform(
            _spots(F.length(h) - n + 1), lambda i: _char_gram(F.substring(h, i, F.lit(n)))
        ),
    )


# --- audits -----------------------------------------------------------------------
def span_conditions(
    source: Column, start: Column, end: Column, quote: Column, digest: Column
) -> Column:
    """Named conditions of a stored span; out of range ends the checks."""
    fits = (start >= 0) & (end > start) & (end <= F.length(source))
    stale = F.when(F.sha2(source, 256) != digest, "span_stale")
    outside = F.when(~fits, "span_out_of_range")
    differs = F.when(fits & (slice_text(source, start, end) != quote), "span_does_not_reslice")
    named = F.array_compact(F.array(stale, outside, differs))
    return F.when(start.isNull() | end.isNull(), F.array().cast("array<string>")).otherwise(named)


def span_audit(citations: DataFrame, sources: DataFrame, row_id: str) -> DataFrame:
    cited = keep_wanted(sources, F.col("record_id"), citations, F.col("record_id"))
    joined = skew_join(citations, cited, "record_id", how="left")
    checks = span_conditions(
        F.col("source_text"), F.col("start"), F.col("end"), F.col("quote"), F.col("source_sha256")
    )
    found = F.when(F.col("source_text").isNull(), F.array(F.lit("unknown_record"))).otherwise(checks)
    return joined.withColumn("conditions", found).drop("source_text")


def source_context(citations: DataFrame, sources: DataFrame, row_id: str, window: int) -> DataFrame:
    """Text before, inside and after each valid span, or the failing condition."""
    cited = keep_wanted(sources, F.col("record_id"), citations, F.col("record_id"))
    joined = skew_join(citations, cited, "record_id", how="left")
    text, start, end = F.col("source_text"), F.col("start"), F.col("end")
    conditions = span_conditions(text, start, end, F.col("quote"), F.col("source_sha256"))
    failing = F.when(text.isNull(), "unknown_record").otherwise(F.get(conditions, F.lit(0)))
    low = F.greatest(start - window, F.lit(0))
    high = F.least(end + window, F.length(text))
    ok = failing.isNull() & start.isNotNull()
    return joined.select(
        *citations.columns,
        failing.alias("condition"),
        F.when(ok, slice_text(text, low, start)).alias("before"),
        F.when(ok, slice_text(text, start, end)).alias("span"),
        F.when(ok, slice_text(text, end, high)).alias("after"),
    )


# --- labelled sections ---------------------------------------------------------------
def allowed_roles(label: Column) -> Column:
    clean = F.lower(X.collapse(label))
    chain = F.lit(None).cast("array<string>")
    for labels, roles in reversed(V.SECTION_ROLES):
        chain = F.when(clean.isin(labels), X.literals(roles)).otherwise(chain)
    return chain


def sections(source: Column) -> Column:
    """array<struct(label, at, allowed)>; empty unless two known labels occur."""
    pattern = X.regex(V.SECTION_LABEL, ignore_case=False)
    # Two labels need two colons; most texts are answered by that alone.
    candidate = F.when(source.rlike(":[^:]*:"), source)
    whole = F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(
        whole.alias("whole"),
        F.transform(whole, lambda w: F.regexp_extract(w, pattern, 1)).alias("label"),
        F.transform(F.split(candidate, pattern, -1), lambda g: F.length(g)).alias("gap"),
    )

    def place(zipped: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            before = F.aggregate(
                F.slice(zipped, F.lit(1), i),
                F.lit(0),
                lambda acc, p: acc + p["gap"] + F.length(p["whole"]),
            )
            lead = F.length(part["whole"]) - F.length(part["label"]) - 2
            return F.struct(
                F.trim(part["label"]).alias("label"),
                (before + part["gap"] + lead).cast("bigint").alias("at"),
                allowed_roles(part["label"]).alias("allowed"),
            )

        return F.transform(zipped, one)

    found = F.filter(X.bind(parts, place), lambda s: s["allowed"].isNotNull())
    return X.bind(found, lambda f: F.when(F.size(f) >= 2, f).otherwise(F.slice(f, 1, 0)))


def section_at(found: Column, offset: Column) -> Column:
    reached = F.filter(found, lambda s: s["at"] <= offset)
    return X.bind(reached, lambda r: F.get(r, F.size(r) - 1))


# --- contradiction and roles ----------------------------------------------------------
def first_marker(text: Column, markers: list[tuple[str, str]]) -> Column:
    fired = [F.when(X.matches(text, pattern), F.lit(name)) for name, pattern in markers]
    return F.coalesce(*fired)


def any_marker(text: Column, markers: list[tuple[str, str]]) -> Column:
    return text.rlike(X.any_of([pattern for _, pattern in markers]))


def contradiction(
    source: Column,
    span_end: Column,
    quote: Column,
    markers: list[tuple[str, str]] = V.REVERSAL_MARKERS,
    shared_words: int = V.SHARED_WORDS,
) -> Column:
    """First later sentence that reverses the quote, or null."""
    def search(topic: Column) -> Column:
        tail = F.substring(source, (span_end + 1).cast("int"), F.length(source))
        # Content words are costly; most sentences have too few words of the topic in any form.
        reversing = X.bind(
            X.word_forms(topic),
            lambda forms: F.filter(
                X.sentences(F.when(any_marker(tail, markers), tail)),
                lambda s: any_marker(s, markers)
                & (F.size(F.array_intersect(X.raw_words(s), forms)) >= shared_words)
                & (F.size(F.array_intersect(X.content_words(s), topic)) >= shared_words),
            ),
        )
        return X.bind(
            F.get(reversing, F.lit(0)),
            lambda found: F.when(
                found.isNotNull(),
                F.struct(
                    found.alias("sentence"),
                    first_marker(found, markers).alias("marker"),
                    F.array_sort(F.array_intersect(X.content_words(found), topic)).alias("shared"),
                ),
            ),
        )

    open_tail = F.when(~any_marker(quote, markers), X.content_words(quote))
    return X.bind(open_tail, lambda topic: F.when(topic.isNotNull(), search(topic)))


def role_verdict(
    role: Column,
    source: Column,
    start: Column,
    end: Column,
    markers: list[tuple[str, str]] = V.REVERSAL_MARKERS,
) -> Column:
    """Refusal reason of a citation's asserted role; null when it stands.

    A span that could not be located passes here: refusing it is the business of
    the containment check.
    """
    known = F.coalesce(role.isin(V.SPAN_ROLES), F.lit(False))
    section = section_at(sections(F.when(known & start.isNotNull(), source)), start)
    misplaced = X.bind(
        section, lambda s: s.isNotNull() & ~F.coalesce(F.array_contains(s["allowed"], role), F.lit(True))
    )
    quote = slice_text(source, start, end)
    reversed_later = (role == "finding") & contradiction(source, end, quote, markers).isNotNull()
    return (
        F.when(~known, "span_role_missing")
        .when(start.isNull(), F.lit(None))
        .when(misplaced, "span_role_contradicted_by_structure")
        .when(reversed_later, "premise_contradicted_downstream")
    )


# What a citation asks of a text; citations that ask the same are judged once.
ASKED = ["needle", "start", "end"]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where null keys are equal to each other; the keys stand once."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return left.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def _judged_texts(citations: DataFrame, records: DataFrame, require_roles: bool) -> DataFrame:
    """record_id, needle, start, end, span_role: what the text of the record says to them.

    Each needle is searched once per record and each role judged once per place, however many
    citations share them; texts meet only these rows.
    """
    asked = citations.filter("record_id IS NOT NULL").groupBy("record_id", *ASKED)
    asked = asked.agg(F.collect_set(F.struct("span_role")).alias("_roles"))
    cited = keep_wanted(records, F.col("record_id"), citations, F.col("record_id"))
    known = cited.withColumn("hay", X.norm_quality(F.col("source_text")))
    joined = skew_join(asked, known, "record_id")
    needle, source = F.col("needle"), F.col("source_text")
    inside = F.contains(F.col("hay"), needle)
    given = F.col("start").isNotNull() & F.col("end").isNotNull()
    located = span_of(F.when(inside & ~given & (needle != ""), source), needle)
    anchored = derive_quote(source, F.col("start"), F.col("end")).isNotNull()
    placed = joined.select(
        "record_id",
        *ASKED,
        *[c for c in records.columns if c.startswith("r_")],
        "source_text",
        source.isNotNull().alias("_known"),
        inside.alias("_inside"),
        anchored.alias("_anchored"),
        F.when(anchored, F.sha2(source, 256)).alias("_digest"),
        F.when(given, F.col("start")).otherwise(located["start"]).alias("_start"),
        F.when(given, F.col("end")).otherwise(located["end"]).alias("_end"),
        "_roles",
    )
    placed = placed.withColumn("_r", F.explode("_roles")).withColumn("span_role", F.col("_r.span_role"))
    role = role_verdict(F.col("span_role"), source, F.col("_start"), F.col("_end")) if require_roles else F.lit(None).cast("string")
    return placed.withColumn("_role", role).drop("source_text", "_start", "_end", "_roles", "_r")


def grounding_gate(
    items: DataFrame,
    citations: DataFrame,
    records: DataFrame,
    require_spans: bool = False,
    require_roles: bool = True,
) -> DataFrame:
    """(item_id, reason, record_id): why an item is refused; null reason = admitted.

    ``citations``: item_id, pos, record_id, quote, span_role, start, end, doi,
    title, topic_id, source_sha256; ``records``: record_id, source_text, and the
    record's own doi, title and topic prefixed ``r_``.
    """
    # The needle becomes a column before the join: later lambdas may not hold a Python UDF.
    prepared = cut_lineage(citations.withColumn("needle", X.norm_quality(F.col("quote"))))
    needle = F.col("needle")
    joined = _same(prepared, _judged_texts(prepared, records, require_roles), ["record_id", *ASKED, "span_role"])
    known, anchored = F.coalesce(F.col("_known"), F.lit(False)), F.coalesce(F.col("_anchored"), F.lit(False))
    blank = F.col("record_id").isNull() | (
        F.coalesce(F.length(X.js_trim(F.col("quote"))), F.lit(0)) == 0
    )
    first_pass = (
        F.when(blank, "malformed_citation")
        .when(~known, "unknown_record_id")
        .when(~F.col("_inside"), "quote_not_in_source")
        .when(F.col("_role").isNotNull(), F.col("_role"))
        .when(F.lit(require_spans) & ~anchored, "malformed_citation")
    )
    second_pass = (
        F.when(~F.col("topic_id").eqNullSafe(F.col("r_topic_id")), "provenance_mismatch")
        .when(F.col("r_doi").isNull() | ~F.col("doi").eqNullSafe(F.col("r_doi")), "doi_unresolved")
        .when(~F.col("title").eqNullSafe(F.col("r_title")), "title_mismatch")
        .when(needle == "", "quote_not_in_source")
        .when(
            anchored & F.col("source_sha256").isNotNull() & (F.col("_digest") != F.col("source_sha256")),
            "provenance_mismatch",
        )
    )
    judged = joined.select(
        "item_id",
        "pos",
        "record_id",
        "span_role",
        first_pass.alias("first"),
        second_pass.alias("second"),
    )
    folded = judged.groupBy("item_id").agg(
        F.min_by(F.struct("first", "record_id"), F.when(F.col("first").isNotNull(), F.col("pos"))).alias("a"),
        F.min_by(F.struct("second", "record_id"), F.when(F.col("second").isNotNull(), F.col("pos"))).alias("b"),
        F.bool_or(F.coalesce(F.col("span_role") == "finding", F.lit(False))).alias("found"),
        F.min_by("record_id", "pos").alias("lead"),
    )
    no_finding = F.lit(require_roles) & ~F.col("found")
    reason = (
        F.when(F.col("lead").isNull() & F.col("a").isNull() & F.col("found").isNull(), "no_citations")
        .when(F.col("a").isNotNull(), F.col("a.first"))
        .when(no_finding, "span_role_not_finding")
        .when(F.col("b").isNotNull(), F.col("b.second"))
    )
    subject = F.when(F.col("a").isNotNull(), F.col("a.record_id")).otherwise(
        F.when(no_finding, F.col("lead")).otherwise(F.col("b.record_id"))
    )
    return items.join(folded, "item_id", "left").select(
        *items.columns, reason.alias("reason"), F.when(reason.isNotNull(), subject).alias("refused_record")
    )


def grounding_errors(citations: DataFrame, records: DataFrame, row_id: str) -> DataFrame:
    """Every error of every citation, by corpus kind, one row per error.

    Evidence and observation citations check against ``records`` (source_text and
    ``r_`` columns); inference citations against the statements of the effect
    they name (``r_fact``, ``r_boundary``, ``r_cited``).
    """
    cited = keep_wanted(records, F.col("record_id"), citations, F.col("record_id"))
    known = cited.withColumn("hay", X.norm_quality(F.col("source_text")))
    joined = skew_join(citations, known, "record_id", how="left")
    needle = X.norm_quality(F.col("quote"))
    source = F.col("source_text")
    missing = source.isNull()
    evidence = F.col("corpus_kind") == "evidence"
    observed = F.col("corpus_kind") == "realization"
    unresolved = ~missing & ((needle == "") | ~F.contains(F.col("hay"), needle))
    errors = [
        F.when(missing, "missing_record"),
        F.when(~missing & ~F.col("topic_id").eqNullSafe(F.col("r_topic_id")), "topic_mismatch"),
        F.when(
            evidence
            & ~missing
            & (F.col("r_doi").isNull() | ~F.col("doi").eqNullSafe(F.col("r_doi"))),
            "doi_unresolved",
        ),
        F.when(
            observed & ~missing & ~F.col("source_id").eqNullSafe(F.col("r_source_id")),
            "source_mismatch",
        ),
        F.when(~missing & ~F.col("title").eqNullSafe(F.col("r_title")), "title_mismatch"),
        F.when(unresolved, "quote_unresolved"),
    ]
    conditions = F.when(
        evidence & ~missing,
        span_conditions(source, F.col("start"), F.col("end"), F.col("quote"), F.col("source_sha256")),
    ).otherwise(F.array().cast("array<string>"))
    named = F.concat(F.array_compact(F.array(*errors)), conditions)
    return joined.select(row_id, "record_id", F.explode(named).alias("error"))


def inference_errors(inferences: DataFrame, effects: DataFrame, cited: DataFrame, row_id: str) -> DataFrame:
    """Errors of inference citations against the effect each one names."""
    basis = skew_join(inferences, effects, "effect_id", how="left")
    edge = cited.select("effect_id", "record_id", F.lit(True).alias("_cited")).distinct()
    joined = basis.join(edge, ["effect_id", "record_id"], "left")
    absent = F.col("e_fact").isNull()
    own = X.js_trim(F.col("quote"))
    stated = own.eqNullSafe(X.js_trim(F.col("e_fact"))) | own.eqNullSafe(X.js_trim(F.col("e_boundary")))
    errors = [
        F.when(absent, "missing_effect"),
        F.when(~absent & (F.col("topic_id") != F.col("e_topic_id")), "topic_mismatch"),
        F.when(~absent & ~stated, "not_own_statement"),
        F.when(~absent & F.col("_cited").isNull(), "record_not_cited"),
    ]
    return joined.select(row_id, F.explode(F.array_compact(F.array(*errors))).alias("error"))
