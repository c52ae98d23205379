"""Scalar text functions, all built from expressions that stay in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of credentials, categories and keys.
CREDENTIAL_PARTS = (
    r"-----BEGIN [^-\r\n]*PRIVATE KEY-----",
    r"(?:^|[^A-Za-z0-9])(?:sk-[A-Za-z0-9_-]{8,}|(?:sk|pk)_(?:live|test)_[A-Za-z0-9_-]{8,}|gh[opsu]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,}|xox[baprs]-[0-9A-Za-z-]{10,})",
    r"(?i:(?:^|\s)Bearer\s+[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:$|\s))",
    r"(?:^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:$|[^A-Za-z0-9_-])",
    r"(?i:(?:api[ _-]?key|access[ _-]?token|auth[ _-]?token|password|secret)\s*[:=]\s*\S{4,})",
)
CREDENTIAL = "|".join(CREDENTIAL_PARTS)
CREDENTIAL_CATEGORY = r"(?i)(?:credential|token|secret|password|api[-_]?key|private[-_]?key)"
GENERIC_MARKERS = ("loaded a tool, ran commands", "read files, ran commands", "ran commands")


def is_credential(text: Column) -> Column:
    """Whether a text holds a credential. Each pattern is tried only on texts with one of the words that it needs."""
    low = F.lower(text)
    any_of = lambda t, words: functools.reduce(Column.__or__, [F.contains(t, F.lit(w)) for w in words.split()])
    needs = (
        any_of(text, "-----BEGIN"),
        any_of(text, "sk- sk_live_ sk_test_ pk_live_ pk_test_ gho_ ghp_ ghs_ ghu_ github_pat_ glpat- npm_ AKIA AIza xox"),
        any_of(low, "bearer"),
        any_of(text, "eyJ"),
        any_of(low, "key token password secret") & any_of(text, ": ="),
    )
    return functools.reduce(Column.__or__, [need & text.rlike(part) for need, part in zip(needs, CREDENTIAL_PARTS, strict=True)])


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return (F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def slug(text: Column) -> Column:
    """Runs of other characters than letters, digits and ._- become one hyphen; item if nothing is left."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(plain, r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("item"))


def claim_normal(text: Column) -> Column:
    """A claim for comparison: lower case, letters, digits and _./:+- only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_./:+-]+", " "), r" +", " "))


#: What an instruction to add something starts with, once normal.
DIRECTIONS = ("^(please )?(add|include)( that)? ", "^(请)?(补充|加入|加上)(说明)? ")


def claim_variants(instruction: Column) -> Column:
    """The normal claim of an instruction, with its direction and without; none of under three UTF-16 units. A null instruction has none."""
    whole = claim_normal(instruction)
    bare = whole
    for pattern in DIRECTIONS:
        bare = F.regexp_replace(bare, pattern, "")
    return F.filter(F.array_distinct(F.array(whole, F.trim(bare))), lambda v: utf16_length(v) >= 3)


def claim_supported(instruction: Column, contents: Column) -> Column:
    """Whether a variant of the claim stands in one of the contents, each made normal; null counts as empty."""
    sources = F.transform(F.coalesce(contents, F.array().cast("array<string>")), lambda c: claim_normal(F.coalesce(c, F.lit(""))))
    claims = claim_variants(F.coalesce(instruction, F.lit("")))
    return F.exists(claims, lambda v: F.exists(sources, lambda c: F.contains(c, v)))


def language_class(text: Column) -> Column:
    """zh or en where that script has four fifths of the letters of both, else mixed."""
    han, latin = F.regexp_count(text, F.lit(r"\p{IsHan}")), F.regexp_count(text, F.lit(r"[A-Za-z]"))
    return F.when(han + latin == 0, "mixed").when(han * 5 >= (han + latin) * 4, "zh").when(latin * 5 >= (han + latin) * 4, "en").otherwise("mixed")


def generic_marker(text: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), r"[.! ]+$", "")
    return plain.isin(*GENERIC_MARKERS)


def pasted(html: Column) -> Column:
    """Pasted markup as text: no script or style bodies, tags, carriage returns or nulls."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", ""), r"[\r\x00]", "")


def safe_category(category: Column) -> Column:
    return F.when(category.rlike(r"^[a-z0-9][a-z0-9-]{0,63}$"), category).otherwise("sensitive")


def option_normal(text: Column) -> Column:
    """Answers for comparison: trimmed, without final dots, ASCII lower case."""
    return F.translate(F.regexp_replace(F.trim(text), r"\.+$", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def skeleton(line: Column) -> Column:
    """A line's layout: every run of letters or digits becomes {}."""
    return F.regexp_replace(line, r"[\p{L}\p{N}]+", "{}")


def mask_assignments(text: Column) -> Column:
    """Values assigned to secret names become <REDACTED>; comparisons, empty values and masked ones stay."""
    pattern = r"""(?i)\b(api[_-]?key|access[_-]?token|auth[_-]?token|token|password|passwd|secret)(["']?\s*[:=]\s*)(?!=)("[^"\s]+"|'[^'\s]+'|(?!<REDACTED>)[^\s"',;<=]+)"""
    return F.regexp_replace(text, pattern, "$1$2<REDACTED>")
