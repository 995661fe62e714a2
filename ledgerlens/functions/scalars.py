"""Scalar rules as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(value: Column) -> Column:
    """Value limited to 0..1; null and NaN give 0."""
    value = value.cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def ramp(value: Column, low: float, high: float) -> Column:
    """0 at ``low`` and below, 1 at ``high`` and above, linear between."""
    return clamp01((value - F.lit(float(low))) / F.lit(float(high) - float(low)))


def falling_ramp(value: Column, low: float, high: float) -> Column:
    """1 at ``low`` and below, 0 at ``high`` and above."""
    return clamp01((F.lit(float(high)) - value) / F.lit(float(high) - float(low)))


def attribution_value(attributed: Column, ratio: Column) -> Column:
    """Signal value of an attributed share: material from a tenth on."""
    return (
        F.when(attributed == 0, 0.0)
        .when(ratio >= 0.1, F.greatest(F.lit(0.6), ratio))
        .otherwise(ratio / F.lit(0.1) * F.lit(0.6))
    )


def half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


# Lower bounds of the bands of each dimension, and the corpus
# baseline (p90 and maximum).
BANDS = {
    "authorship": ((75, "near-certain"), (50, "likely"), (30, "possible"), (0, "unlikely")),
    "health": ((75, "poor"), (50, "rough"), (25, "minor-issues"), (0, "solid")),
    "security": ((70, "widespread"), (40, "several"), (15, "some"), (0, "none")),
}
BASELINE = {"authorship": (21, 24), "security": (0, 0), "health": (23, 42)}


def band(dimension: str, score: Column) -> Column:
    *upper, (_, last) = BANDS[dimension]
    out = F.lit(last)
    for start, name in reversed(upper):
        out = F.when(score >= start, name).otherwise(out)
    return out


def corpus_standing(dimension: str, score: Column) -> Column:
    p90, most = BASELINE[dimension]
    return F.when(score > most, "beyond").when(score > p90, "above").otherwise("at-or-below")


SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high", "certain")


def rank_in(order: tuple[str, ...], value: Column) -> Column:
    """Position from 1, or 0 for a value that is not listed."""
    return F.array_position(F.array(*map(F.lit, order)), value)


# --- words of code and comments ----------------------------------------------

# Words that carry no meaning in a comment.
STOP_WORDS = (
    "the a an to for of and or this that is are we it in on with from all our then if as by "
    "into up out new its be will now here each any"
).split()


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def identifier_words(text: Column) -> Column:
    """Distinct words of two or more characters inside identifiers."""
    names = F.regexp_extract_all(text, F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), 1)
    parts = F.transform(
        names, lambda n: F.split(F.lower(F.regexp_replace(split_camel(n), r"[_$]+", " ")), r"\s+")
    )
    return F.array_distinct(F.filter(F.flatten(parts), lambda w: F.length(w) > 1))


def comment_words(text: Column) -> Column:
    """Meaningful words of a comment, repeats included."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9\s]", " ")
    words = F.split(F.lower(split_camel(plain)), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def word_overlap(comment: Column, code: Column) -> Column:
    """Share of the comment's words that the code's identifiers hold."""
    shared = F.filter(comment, lambda w: F.array_contains(code, w))
    return F.when(F.size(comment) > 0, F.size(shared) / F.size(comment))


# --- licences ------------------------------------------------------------------

# Phrases of licence texts, the first matching row decides.
LICENSE_PHRASES = (
    ("AGPL-3.0", ("gnu affero general public license",)),
    ("LGPL-3.0", ("gnu lesser general public license", "version 3")),
    ("LGPL-2.1", ("gnu lesser general public license",)),
    ("GPL-3.0", ("gnu general public license", "version 3")),
    ("GPL-2.0", ("gnu general public license",)),
    ("MPL-2.0", ("mozilla public license", "2.0")),
    ("Apache-2.0", ("apache license", "version 2.0")),
    ("MIT", ("permission is hereby granted, free of charge, to any person",)),
    ("ISC", ("permission to use, copy, modify, and/or distribute this software",)),
    ("BSD-3-Clause", ("redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    ("BSD-2-Clause", ("redistribution and use in source and binary forms",)),
    ("Unlicense", ("free and unencumbered software released into the public domain",)),
)


def identify_license(text: Column) -> Column:
    """SPDX id of a licence text, null if no phrase matches."""

    def rule(flat: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, phrases in reversed(LICENSE_PHRASES):
            hit = F.lit(True)
            for phrase in phrases:
                hit = hit & flat.contains(phrase)
            out = F.when(hit, name).otherwise(out)
        return out

    # an array of one: its element is flattened once and not for every phrase
    flat = F.array(F.lower(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.element_at(F.transform(flat, rule), 1)


def license_matches(declared: Column, identified: Column) -> Column:
    """Is the identified id, or a family of it, a term of the declaration?"""
    terms = F.filter(F.split(F.upper(declared), r"[^A-Z0-9.+-]+"), lambda t: t != "")
    target = F.upper(identified)
    return F.exists(terms, lambda t: target.startswith(t) | t.startswith(target))


# --- packages ------------------------------------------------------------------


def package_of(specifier: Column) -> Column:
    """Package of a bare module specifier (two parts for scoped names)."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def is_bare(specifier: Column) -> Column:
    return ~(specifier.startswith(".") | specifier.startswith("/") | specifier.startswith("@/") | specifier.startswith("~/"))


def npm_spec(spec: Column) -> Column:
    """``name, version`` of ``name@version(peers)``."""
    plain = F.regexp_replace(spec, r"\(.*$", "")
    return F.struct(
        F.regexp_extract(plain, r"^/?(.+)@(\d[^(]*)$", 1).alias("name"),
        F.regexp_extract(plain, r"^/?(.+)@(\d[^(]*)$", 2).alias("version"),
    )


def normal_severity(text: Column) -> Column:
    """Severity name of an advisory, null if it has none."""
    plain = F.lower(F.trim(text))
    return F.when(plain.isin("low", "high", "critical"), plain).when(plain.isin("medium", "moderate"), "medium")
