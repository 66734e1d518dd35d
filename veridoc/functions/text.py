"""Column functions over text: normal forms, tokens, figures, dates and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens, query stop words, figures, dates, months.
TOKEN = r"[a-z]+(?:-[a-z]+)*|[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+"
STOPWORDS = tuple("a an the of to for in on at as is are was were be do does did what which who whom how much many and or by from this that these those with about into over under apple apples".split())
FIGURE = r"\(?[0-9]{1,3}(?:,[0-9]{3})+\)?|\b[0-9]+(?:\.[0-9]+)?%"
DATE = r"\b[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space made one space, ends stripped."""
    return F.btrim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def normalize_text(c: Column) -> Column:
    """Without byte order marks at the start, with line feeds for all line ends."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿+", ""), "\r\n?", "\n")


def doc_id_for(path: Column) -> Column:
    """Document id of a file name: its stem with white space as _ and slashes as -."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(stem, r"\s+", "_"), "/", "-")


def is_doc_id(c: Column) -> Column:
    """Whether an id stays below the store: no separators, no dot segments, starts with a letter or digit."""
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def featurize(c: Column, is_query: bool = False) -> Column:
    """Tokens and adjacent pairs; queries lose stop words and bare numbers first."""
    tokens = tokenize(c)
    if is_query:
        tokens = F.filter(tokens, lambda t: ~t.isin(*STOPWORDS) & ~t.rlike("^[0-9]+$"))
    pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))


def salient_tokens(c: Column) -> Column:
    """Figures (parentheses stripped) and full dates, in that order, with repeats."""
    figures = F.transform(F.regexp_extract_all(c, F.lit(f"({FIGURE})"), 1), lambda f: F.btrim(f, F.lit("()")))
    return F.concat(figures, F.regexp_extract_all(c, F.lit(f"({DATE})"), 1))


def numeric_core(c: Column) -> Column:
    """The first figure of a literal, null if it has none."""
    found = F.regexp_extract(c, f"({FIGURE})", 1)
    return F.when(found != "", F.btrim(found, F.lit("()")))


def to_number(c: Column) -> Column:
    """The first number, commas dropped; negative if both parentheses occur; null without a number."""
    value = F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(c.contains("(") & c.contains(")"), -F.abs(value)).otherwise(value)


def decimals(c: Column) -> Column:
    """Digits written after the first decimal point."""
    return F.length(F.regexp_extract(F.regexp_replace(c, ",", ""), r"\.([0-9]+)", 1))


def to_date(c: Column) -> Column:
    """Date of a literal such as September 28, 2024 or Sep. 28 2024; null for anything else."""
    shape = r"^\s*([A-Za-z]+)\.?\s+([0-9]{1,2}),?\s+([0-9]{4})\s*$"
    name = F.lower(F.regexp_extract(c, shape, 1))
    month = reduce(lambda acc, im: acc.when(name.isin(*({im[1], im[1][:3]} | ({"sept"} if im[0] == 9 else set()))), im[0]), enumerate(MONTHS[1:], 2), F.when(name.isin("january", "jan"), 1))
    parts = F.concat_ws("-", F.regexp_extract(c, shape, 3), month.cast("string"), F.regexp_extract(c, shape, 2))
    return F.when(month.isNotNull(), F.try_to_timestamp(parts, F.lit("yyyy-M-d")).cast("date"))


def python_round(x: Column, digits: Column) -> Column:
    """Half-even rounding to a number of decimals that is a column (0 to 6 told apart)."""
    out = F.bround(x, 6)
    for d in range(5, -1, -1):
        out = F.when(digits == d, F.bround(x, d)).otherwise(out)
    return out


def line_class(c: Column) -> Column:
    """blank, h (heading), sub (short line that ends in a colon, without figure) or ln."""
    s = strip(c)
    caps = (F.length(s) <= 90) & (F.upper(s) == s) & s.rlike(r"\p{L}")
    sub = s.endswith(":") & (F.length(s) <= 60) & ~s.rlike(FIGURE)
    return F.when(s == "", "blank").when(caps | s.startswith("PART ") | s.startswith("Item ") | s.startswith("ITEM "), "h").when(sub, "sub").otherwise("ln")


def natural_key(c: Column) -> Column:
    """Sorts labels that start with digits by number and suffix, before all others."""
    digits = F.regexp_extract(c, r"^([0-9]+)", 1)
    return F.when(digits != "", F.struct(F.lit(0).alias("kind"), digits.try_cast("long").alias("number"), F.regexp_extract(c, r"^[0-9]+(.*)$", 1).alias("rest"))).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("number"), c.alias("rest")))
