"""Case folding, word order, edit distance and confidence as Column expressions; all stay in generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(x: Column | str) -> Column:
    """Case-insensitive key of a name; Cyrillic folds as well as Latin."""
    return F.lower(F.trim(F.col(x) if isinstance(x, str) else x))


def same_name(column: Column | str, value: str) -> Column:
    return fold(column) == value.strip().lower()


def either_name(ru: Column | str, en: Column | str, value: str) -> Column:
    """Either spelling; an empty English name never matches."""
    key = value.strip().lower()
    return (fold(ru) == key) | ((F.col(en) if isinstance(en, str) else en) != "") & (fold(en) == key)


def words_in_order(column: Column | str, query: str) -> Column:
    """All words of the query, one after another, without overlap."""
    words = query.strip().lower().split()
    return fold(column).rlike("(?s)" + ".*".join(re.escape(w) for w in words))


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty names are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def deliberate_variant(name: Column, candidate: Column) -> Column:
    """Whether ``name`` is ``candidate`` with an intended affix: digits or two characters and more behind or before it,
    or one lower-case letter before a capital (``sName``)."""
    a, b = F.lower(name), F.lower(candidate)
    extra = F.length(a) - F.length(b)
    behind = F.substring(a, F.length(b) + 1, F.greatest(extra, F.lit(0)))
    before = F.substring(a, F.lit(1), F.greatest(extra, F.lit(0)))
    digits = r"^[0-9]+$"
    affix = a.startswith(b) & ((extra >= 2) | behind.rlike(digits)) | a.endswith(b) & ((extra >= 2) | before.rlike(digits) | name.rlike(r"^\p{Ll}\p{Lu}"))
    return (F.length(b) > 0) & (extra > 0) & affix


def confidence(name: Column, candidate: Column) -> Column:
    """``high``, ``low`` or null: how likely ``name`` is a typo of ``candidate``."""
    d, n = F.levenshtein(F.lower(name), F.lower(candidate)), F.length(name)
    near = F.when((n >= 5) & (d <= 2) | (n < 5) & (d <= 1), F.lit("high")).when((n >= 6) & (d <= 3), F.lit("low"))
    return F.when((d == 0) | deliberate_variant(name, candidate), F.lit(None).cast("string")).otherwise(near)


def _path(path: Column) -> Column:
    return F.lower(F.translate(path, "\\", "/"))


def form_module(path: Column) -> Column:
    """Whether a path is that of a form's module: in a dump, of a common form, or of an unpacked external one. False for null."""
    p = _path(path)
    return F.coalesce(p.rlike(r"(?:^|/)(?:common)?forms/[^/]+/ext/form/module\.bsl$") | p.rlike(r"(?:^|/)form/[^/]+/form\.obj\.bsl$"), F.lit(False))


def common_module(path: Column) -> Column:
    return F.coalesce(_path(path).rlike(r"(?:^|/)commonmodules/[^/]+/ext/module\.bsl$"), F.lit(False))


def module_of_xml(path: Column) -> Column:
    """Path of the module that belongs to a common module's description; null for other paths."""
    return F.when(path.endswith(".xml"), F.regexp_replace(path, r"\.xml$", "/Ext/Module.bsl"))


def xml_of_module(path: Column) -> Column:
    return F.when(path.endswith("/Ext/Module.bsl"), F.regexp_replace(path, r"/Ext/Module\.bsl$", ".xml"))


def range_upper(name: Column) -> Column:
    """Last number of a parameter that stands for several (``Value1-Value10``), else null."""
    return F.nullif(F.regexp_extract(name, r"(\d+)\D*-\D*(\d+)", 2), F.lit("")).cast("int")


def group_or_null(column: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def two_names(title: Column) -> Column:
    """``Russian (English)`` as a struct of both; English is empty where the last parentheses hold other letters."""
    pattern = r"^(.*)\(([\x20-\x27\x2A-\x7E]+)\)\s*$"
    return F.when(title.rlike(pattern), F.struct(F.trim(F.regexp_extract(title, pattern, 1)).alias("ru"), F.trim(F.regexp_extract(title, pattern, 2)).alias("en"))).otherwise(
        F.struct(F.trim(title).alias("ru"), F.lit("").alias("en"))
    )


def one_space(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))
