"""Text functions: search keys, labels, cleaning, dates, costs, hop classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: what Unicode calls space separators
SPACES = "\u0020\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def trim(value: Column) -> Column:
    """Without space separators at its ends. F.trim drops only U+0020 and, as the function of F.transform, takes an item's index for what to trim."""
    return F.trim(value, F.lit(SPACES))


def search_str(value: Column) -> Column:
    r"""Runs of anything but letters, digits and white space become one space; lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(value, r"[^\s\p{L}\p{N}]+", " "), r"\s+", " ")))


def label_from(value: Column) -> Column:
    """CamelCase of the words of a class name."""
    words = F.split(F.trim(F.regexp_replace(value, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def relationship_name(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", "_"))


def clean(value: Column) -> Column:
    """Underscores as spaces, without bracketed parts, leading article and final full stop."""
    v = F.trim(F.regexp_replace(F.translate(value, "_", " "), r"\s*\([^)]*\)", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(v, r"^(?i)(the|an|a)\s+", ""), r"\.$", ""))


def iso_datetime(value: Column) -> Column:
    """A timestamp as ISO text without fractions; null if it doesn't parse."""
    return F.date_format(F.try_to_timestamp(value), "yyyy-MM-dd'T'HH:mm:ss")


def long_date(value: Column) -> Column:
    """January 5, 2024; null if it doesn't parse."""
    return F.date_format(F.try_to_timestamp(value), "MMMM d, yyyy")


def token_cost(value: Column) -> Column:
    """A quarter of the characters."""
    return F.floor(F.length(value) / 4).cast("long")


#: several conjunctions or a word that joins, a time, a comparison, a step from one fact to another
MULTI = [
    r"\band\b.*\band\b", r"\bboth\b", r"\bas well as\b", r"\bbefore\b", r"\bafter\b", r"\bwhile\b", r"\bduring\b",
    r"\bcompared to\b", r"\bversus\b", r"\bmore than\b", r"\bless than\b", r"\bdifference between\b",
    r"\bhow many\b.*\bthat\b", r"\bwhich\b.*\balso\b", r"\bwhat\b.*\band\b.*\b(what|who|where|when|how)\b",
]
SINGLE = r"^((what|who|when|where) (is|was)|(what|who|where) are|when did|(what|who) does)\b"


def hop_given(hops: Column, kind: Column) -> Column:
    """The class that a dataset tells: by a number of hops (1 or less is single-hop) or its name, else by a kind of question."""
    h, k = F.trim(F.lower(hops)), F.lower(F.trim(kind))
    number = h.try_cast("double")
    by_hops = F.when(h.isin("single-hop", "single_hop", "single"), "single-hop").when(h.isin("multi-hop", "multi_hop", "multi", "multiple"), "multi-hop").when(number <= 1, "single-hop").when(number > 1, "multi-hop")
    by_kind = F.when(k.contains("multi") | k.contains("complex"), "multi-hop").when(k.contains("single") | k.contains("simple"), "single-hop")
    return F.coalesce(by_hops, by_kind)


def hop_class(question: Column, given: Column | None = None) -> Column:
    """The class that is given, else multi-hop for joining, timing, comparing or reasoning words, single-hop for plain openings."""
    q = F.trim(F.lower(question))
    said = F.coalesce(*(F.when(q.rlike(p), "multi-hop") for p in MULTI), F.when(q.rlike(SINGLE), "single-hop"), F.lit("unknown"))
    return said if given is None else F.coalesce(given, said)


def section(text: Column, tag: str) -> Column:
    return F.trim(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


#: statements that change data, after comments are gone
WRITES = r"(?i)\b(create|merge|set|remove|delete|drop|detach|call|insert|update|alter|truncate)\b"


def is_write(query: Column) -> Column:
    """Whether a query text would change data; comments don't count."""
    bare = F.regexp_replace(F.regexp_replace(query, r"(?s)/\*.*?\*/", " "), r"(//|--)[^\n]*", " ")
    return bare.rlike(WRITES)
