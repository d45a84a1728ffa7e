"""Text normalisers, token sets and splitters as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions import arrow
from corroborate.functions import vocabulary as V

SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# Characters that may change their a-z0-9 content under NFKC or combine with a
# neighbour; only texts holding one need the Unicode UDF. Latin letters, dashes and
# quotation marks are not among them.
NFKC_UNSTABLE = (
    r"[\u00aa\u00b2\u00b3\u00b9\u00ba\u00bc-\u00be\u0132\u0133\u013f\u0140\u0149"
    r"\u017f-\u200f\u2024\u2025\u2027-\u202f\u203b-\uffff\x{10000}-\x{10ffff}]"
)


def _boundary(before: str, after: str) -> str:
    """The cheapest lookaround that ``\\b`` means between two pattern parts."""
    opens = re.match(r"(?:\((?:\?:)?)*\w", after)
    if opens and re.search(r"(?:^|\(\?:|[(|])$", before):
        return f"(?<!{_WORD})"
    if re.search(r"(?<!\\)\w$", before):
        return f"(?!{_WORD})"
    return _BOUNDARY


def regex(pattern: str, ignore_case: bool = True) -> str:
    """Java form of a pattern written with ASCII ``\\b`` and Unicode-aware ``\\s``."""
    inner = SPACE[1:-1]
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\b" and not in_class:
            out.append(_boundary(pattern[:i], pattern[i + 2 :]))
            i += 2
        elif pair == r"\s":
            out.append(inner if in_class else SPACE)
            i += 2
        elif pattern[i] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = {"[": True, "]": False}.get(pattern[i], in_class)
            out.append(pattern[i])
            i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def any_of(patterns: list[str]) -> str:
    """One Java pattern for several; the word boundary most start with is tested once."""
    parts = [alt for pattern in patterns for alt in alternatives(pattern)]
    words = [p[2:] for p in parts if re.match(r"\\b(?:\((?:\?:)?)*\w", p)]
    others = [p for p in parts if not re.match(r"\\b(?:\((?:\?:)?)*\w", p)]
    joined = [regex(r"\b(?:" + "|".join(words) + ")", False)] if words else []
    return "(?i)" + "|".join([*joined, *[regex(p, False) for p in others]])


def matches(col: Column, pattern: str) -> Column:
    return col.rlike(regex(pattern))


def opening_words(pattern: str) -> list[str] | None:
    """Lower-case text that each alternative of a pattern begins with; None if one has less than three letters."""
    found = []
    for part in alternatives(pattern):
        run = re.match(r"\\b([a-z ]*)([?*{]?)", part)
        text = run[1][:-1] if run and run[2] else run[1] if run else ""
        if len(text) < 3:
            return None
        found.append(text)
    return found


def matches_folded(col: Column, lower: Column, pattern: str) -> Column:
    """``matches`` where the lower-cased text holds what the pattern opens with; elsewhere it cannot match."""
    words = opening_words(pattern)
    if words is None:
        return matches(col, pattern)
    return reduce(Column.__or__, [lower.contains(w) for w in words]) & matches(col, pattern)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a higher-order function an expression is evaluated per element unless
    it reaches the lambda as a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def js_trim(col: Column) -> Column:
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def collapse(col: Column) -> Column:
    return js_trim(F.regexp_replace(col, f"{SPACE}+", " "))


def _compat(col: Column, form) -> Column:
    odd = F.when(col.rlike(NFKC_UNSTABLE), col)
    return F.coalesce(form(odd), col)


def nfkc(col: Column) -> Column:
    """NFKC as far as a-z0-9 content is concerned."""
    return _compat(col, arrow.nfkc)


def norm_doi(col: Column) -> Column:
    bare = F.regexp_replace(js_trim(col), r"(?i)^https?://(dx\.)?doi\.org/", "")
    bare = F.lower(F.regexp_replace(bare, "(?i)^doi:", ""))
    return F.when(bare.startswith("10."), bare)


def norm_provider_id(col: Column) -> Column:
    bare = F.upper(F.regexp_replace(js_trim(col), r"(?i)^https?://openalex\.org/", ""))
    return F.when(bare.rlike(r"^W[0-9]+$"), bare)


def norm_title(col: Column) -> Column:
    """Accent-free, lower-cased title with punctuation turned into single spaces."""
    decomposed = F.coalesce(arrow.nfkd(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)
    bare = F.regexp_replace(decomposed, r"[\u0300-\u036f]", "")
    blocks = (
        r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\u2000-\u206f\u2e00-\u2e7f\u3000-\u303f"
        r"\ufe10-\ufe1f\ufe30-\ufe4f\uff00-\uff65&&[^\p{Ll}\p{Lu}\p{Lt}]]"
    )
    return collapse(F.lower(F.regexp_replace(bare, blocks, " ")))


def title_key(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "))


def norm_quality(col: Column) -> Column:
    """Comparison form: a-z0-9 words joined by single spaces (accents become spaces)."""
    return F.trim(F.regexp_replace(F.lower(nfkc(col)), "[^a-z0-9]+", " "))


def slug(col: Column, width: int = 72) -> Column:
    dashed = F.regexp_replace(F.lower(_compat_d(col)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, width)


def snake(col: Column) -> Column:
    joined = F.regexp_replace(F.lower(_compat_d(col)), "[^a-z0-9]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def _compat_d(col: Column) -> Column:
    return F.coalesce(arrow.nfkd(F.when(col.rlike(r"[^\x00-\x7F]"), col)), col)


def source_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.coalesce(body, F.lit("")))


def probe_text(title: Column, body: Column) -> Column:
    return js_trim(F.concat(title, F.lit(" "), F.coalesce(body, F.lit(""))))


def estimate_tokens(col: Column) -> Column:
    return F.ceil(F.octet_length(col) / F.lit(4)).cast("bigint")


def compact(col: Column, limit: int = 6000) -> Column:
    """Bounded text projection for a prompt."""
    return F.substring(col, 1, limit)


# --- token sets ---------------------------------------------------------------
def quality_tokens(col: Column) -> Column:
    return normalised_tokens(norm_quality(col))


def quality_words(col: Column) -> Column:
    """quality_tokens for use inside a lambda, where a Python UDF cannot run.

    Equal to it on text whose compatibility characters are already folded.
    """
    return normalised_tokens(F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " ")))


def normalised_tokens(normalised: Column) -> Column:
    words = F.array_distinct(F.split(normalised, " "))
    return F.filter(words, lambda w: F.length(w) > 1)


def relevance_tokens(col: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(col), "[^a-z0-9]+"))
    return F.filter(words, lambda w: F.length(w) >= 4)


def core_keywords(terms: Column, generic: list[str] = V.GENERIC_TERM_TOKENS) -> Column:
    """Distinct long tokens of an array of terms, without the generic ones."""
    return F.array_except(relevance_tokens(F.array_join(terms, " ")), literals(generic))


def raw_words(col: Column) -> Column:
    """Words that ``content_words`` chooses from, as they stand."""
    return F.split(F.lower(col), r"[^a-z\u00c0-\u024f]+")


def word_forms(words: Column) -> Column:
    """Every raw word that ``content_words`` may turn into one of ``words``."""
    return F.array_union(words, F.transform(words, lambda w: F.concat(w, F.lit("s"))))


def content_words(col: Column) -> Column:
    """Topic words of a sentence: long, naively singular, without stop words."""
    stop = literals(V.OVERLAP_STOPWORDS)
    raw = F.filter(
        F.array_distinct(raw_words(col)),
        lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w),
    )
    singular = F.transform(
        raw,
        lambda w: F.when(
            w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)
        ).otherwise(w),
    )
    kept = F.filter(singular, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))
    return F.array_distinct(kept)


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def keyword_hits(col: Column, keywords: Column) -> Column:
    words = F.array_distinct(F.split(F.lower(col), "[^a-z0-9]+"))
    return F.size(F.array_intersect(words, keywords))


# --- splitters ----------------------------------------------------------------
def _pieces(col: Column, pattern: str) -> Column:
    trimmed = F.transform(F.split(col, pattern), js_trim)
    return F.filter(trimmed, lambda s: F.length(s) > 0)


def sentences(col: Column) -> Column:
    return _pieces(col, f"(?<=[.!?]){SPACE}+")


def clauses(col: Column) -> Column:
    return _pieces(
        col, f"(?i),{SPACE}*(?:but|and|yet){SPACE}+|;{SPACE}*|(?<=[.!?]){SPACE}+"
    )


def first_sentence(col: Column) -> Column:
    head = F.regexp_extract(col, f"^.*?[.!?](?={SPACE}|$)", 0)
    return js_trim(F.when(head != "", head).otherwise(col))


def first_sentence_end(col: Column) -> Column:
    """0-based offset just past the first sentence mark that a space follows; -1 if none."""
    at = F.regexp_instr(col, F.lit(f"[.!?]{SPACE}"))
    return F.when(at > 0, at).otherwise(F.lit(-1)).cast("bigint")


# --- html -----------------------------------------------------------------------
_NAMED = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("amp", "&")]


def visible_text(html: Column) -> Column:
    """Text a reader of the page sees; the whole page, without a length cap."""
    bare = F.regexp_replace(
        html, r"(?is)<(script|style|svg|noscript)(?![A-Za-z0-9_])[^>]*>.*?</\1>", " "
    )
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    # "&" is decoded last, behind a private marker, so that decoding is one pass.
    bare = F.regexp_replace(bare, "(?i)&amp;", "\ue000")
    bare = F.coalesce(arrow.numeric_entities(F.when(bare.contains("&#"), bare)), bare)
    for name, char in _NAMED[:-1]:
        bare = F.regexp_replace(bare, f"(?i)&{name};", char)
    return collapse(F.replace(bare, F.lit("\ue000"), F.lit("&")))


def raw_replay_url(url: Column) -> Column:
    return F.regexp_replace(url, r"/web/([0-9]{14})/", "/web/$1id_/")


# --- directives -----------------------------------------------------------------
def _drop_number_words(col: Column) -> Column:
    words = "|".join(V.NUMBER_WORDS)
    return F.regexp_replace(col, regex(rf"\b(?:{words})\b"), " ")


def trigger_action(col: Column) -> Column:
    """Split a directive at its first trigger word into (trigger, action)."""
    cleaned = _drop_number_words(F.regexp_replace(col, r"(?i)\{[a-z0-9_]*\}", " "))
    marker = regex(r"\b(?:" + "|".join(V.TRIGGER_WORDS) + r")\b")
    at = F.regexp_instr(cleaned, F.lit(marker))
    return F.struct(
        F.when(at > 0, F.substring(cleaned, at, F.length(cleaned))).otherwise("").alias("trigger"),
        F.when(at > 0, F.substring(cleaned, F.lit(1), at - 1)).otherwise(cleaned).alias("action"),
    )


def strip_predicate(col: Column) -> Column:
    return js_trim(F.regexp_replace(col, f"{SPACE}*=={SPACE}*true(?!{_WORD})", ""))


def humanize(col: Column) -> Column:
    return F.replace(col, F.lit("_"), F.lit(" "))


VOICE = r"\b(?:you|your|should|prefer)\b"


def boundary_reason(rule: Column) -> Column:
    """A hard rule as a status fact; instruction voice collapses to the bare status."""
    bare = F.regexp_replace(js_trim(rule), f"(?i)^(?:do not|don't|never){SPACE}+", "")
    return F.when(matches(bare, VOICE), "forbidden").otherwise(
        F.concat(F.lit("forbidden \u2014 "), bare)
    )


def dissent_citation(col: Column) -> Column:
    """Citation-shaped lead of a dissent text, else null."""
    lead = js_trim(F.element_at(F.split(col, f":{SPACE}"), 1))
    shaped = (
        matches(lead, r"\b(?:19|20)[0-9]{2}\b") & ~lead.contains(". ") & (F.length(lead) <= 160)
    )
    return F.when(shaped, lead)


def display_authors(authors: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, "\u2014")
        .when(F.size(authors) == 1, F.element_at(authors, 1))
        .otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    )


def longest_contained_prefix(hay: Column, needle: Column) -> Column:
    """Length of the longest prefix of ``needle`` inside ``hay``.

    Containment of a prefix is monotone in its length, so the answer comes from
    a fixed number of halvings instead of trying every length.
    """
    low, high = F.lit(0), F.length(needle)
    steps = F.sequence(F.lit(1), F.lit(32))
    state = F.struct(low.alias("low"), high.alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.ceil((acc["low"] + acc["high"]) / 2).cast("int")
        inside = F.contains(hay, F.substring(needle, F.lit(1), mid))
        return F.struct(
            F.when(inside, mid).otherwise(acc["low"]).alias("low"),
            F.when(inside, acc["high"])
            .otherwise(F.greatest(mid - 1, acc["low"]))
            .alias("high"),
        )

    return F.aggregate(steps, state, halve, lambda acc: acc["low"]).cast("bigint")


def first_divergence(left: Column, right: Column) -> Column:
    """Index of the first differing character, or the common length."""
    steps = F.sequence(F.lit(1), F.lit(32))
    state = F.struct(
        F.lit(0).alias("low"), F.least(F.length(left), F.length(right)).alias("high")
    )

    def halve(acc: Column, _: Column) -> Column:
        mid = F.ceil((acc["low"] + acc["high"]) / 2).cast("int")
        same = F.substring(left, F.lit(1), mid) == F.substring(right, F.lit(1), mid)
        return F.struct(
            F.when(same, mid).otherwise(acc["low"]).alias("low"),
            F.when(same, acc["high"]).otherwise(F.greatest(mid - 1, acc["low"])).alias("high"),
        )

    return F.aggregate(steps, state, halve, lambda acc: acc["low"]).cast("bigint")
