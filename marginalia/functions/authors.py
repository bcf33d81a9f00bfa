"""Author strings of references and catalogues as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def last_name(author: Column) -> Column:
    """Lower-case last word of an author string; of several joined by `` and `` the last that ends in a word counts.

    Null and ``''`` stay as they are; where no part ends in a word the string stays unchanged.
    """
    parts = F.split(F.when(F.length(author) > 6, F.regexp_replace(author, r"^ and ", "")).otherwise(author), " and ", -1)
    words = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, r"(?U)(\w+)$", 1)), lambda w: w != "")
    return F.when(F.size(words) > 0, F.lower(F.element_at(words, -1))).otherwise(author)


def author_list(authors: Column, parity: bool = False) -> Column:
    """Authors of a catalogue string: split on commas and, unless parity is asked for, on `` and ``; affiliations go."""
    if parity:
        return F.split(authors, ",", -1)
    parts = F.split(F.regexp_replace(authors, r"\s*\([^()]*\)", ""), r",|\s+and\s+|;", -1)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def first_author_of_entry(info: Column) -> Column:
    """Last name of the first author of a bibliography entry; null where it has at most one letter."""
    head = F.split(F.split(info, ",", 2)[0], " and ", 2)[0]
    tie = F.locate("~", head)
    head = F.when((tie > 0) & ~F.substring(head, F.lit(1), tie).contains("\\url"), F.substring(head, tie + 1, F.length(head))).otherwise(head)
    head = F.regexp_replace(head, r"^(?:.?[ .~-])+", "")
    word = F.element_at(F.split(F.element_at(F.split(F.split(head, r"\.", 2)[0], " ", -1), -1), "~", -1), -1)
    return F.when(F.length(word) > 1, word)


def longest_segment(info: Column) -> Column:
    """The longest of the ``;`` segments, the first of several; the part of an entry most likely to be its title."""
    parts = F.split(info, ";", -1)
    most = F.array_max(F.transform(parts, F.length))
    return F.filter(parts, lambda p: F.length(p) == most)[0]
