"""Text normalisers and features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that count as missing.
NULL_STRINGS = ["nan", "-", "unknown", "other (unknown)", "null", "na", "", " "]


def alnum(c: Column) -> Column:
    """Lower case without anything but ASCII letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def alnum_spaced(c: Column) -> Column:
    """Lower case, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def attribute_name(c: Column) -> Column:
    """Lower case without bracketed parts and white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"\(.*?\)", ""), r"\s+", "")


def is_null_string(c: Column) -> Column:
    return F.lower(c).isin(NULL_STRINGS)


def is_text_value(c: Column) -> Column:
    """Not all digits, and at most half of the characters digits."""
    return (~c.rlike("^[0-9]+$")) & (2 * F.length(F.regexp_replace(c, "[^0-9]", "")) <= F.length(c))


def qgrams(c: Column, q: int = 3) -> Column:
    """The distinct q-grams of a string; one of q characters or fewer is its own gram."""
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - q + 1), lambda i: F.substring(c, i, q))
    return F.when(F.length(c) <= q, F.array(c)).otherwise(F.array_distinct(grams))


#: Between shingles stand runs of characters other than word characters, white space, - @ &.
SHINGLE_BREAK = r"[^\p{L}\p{N}_\s@&-]+"
#: A token of a shingle has two word characters or more.
SHINGLE_TOKEN = r"[\p{L}\p{N}_]{2,}"


def shingle_list(c: Column) -> Column:
    """A value's shingles: lower case, trimmed, white space as one space, not empty."""
    return F.filter(F.transform(F.split(F.lower(c), SHINGLE_BREAK), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


#: All digits and nothing else: keys and numbers, most values of many lakes.
DIGITS = r"^[0-9]+\z"


def shingle_tokens(c: Column) -> Column:
    """A value's shingles as lists of their tokens; shingles without tokens are left out."""
    lists = F.transform(shingle_list(c), lambda x: F.regexp_extract_all(x, F.lit(SHINGLE_TOKEN), F.lit(0)))
    # A whole number is one token, which needs none of the patterns.
    return F.when(c.rlike(DIGITS) & (F.length(c) > 1), F.array(F.array(c))).otherwise(F.filter(lists, lambda t: F.size(t) > 0))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


_SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_NUMBER = r"[0-9]+(?:,[0-9]+)*"
#: The classes of a value's parts, tried in this order at each place: letters and digits
#: mixed, decimals with and without minus, whole numbers likewise, currency signs or @ with digits,
#: capitalised words, upper case, lower case, punctuation, signs alone, white space. The part of q and s
#: is one and the same: s where no digit, comma or full stop is in it or follows.
FORMAT_PARTS = [
    ("a", r"(?:[0-9]+[a-zA-Z]|[a-zA-Z]+[0-9])[a-zA-Z0-9]*"),
    ("d", rf"\+?{_NUMBER}\.[0-9]+"),
    ("e", rf"-{_NUMBER}\.[0-9]+"),
    ("i", rf"\+?{_NUMBER}"),
    ("j", rf"-{_NUMBER}"),
    ("q", r"[@\p{Sc}][0-9@\p{Sc}]*"),
    ("c", r"[A-Z][a-z][a-z-]*"),
    ("u", r"[A-Z][A-Z.-]*"),
    ("l", r"[a-z][a-z-]*"),
    ("p", r"""[!"#%&'()*+,\-./:;<=>?\[\\\]^_`{|}~]+"""),
    ("w", rf"[{_SPACE}]+"),
]
#: Parts in order; any other character is a part of its own, where the descriptor ends.
FORMAT_PATTERN = "(?s)" + "|".join(part for _, part in FORMAT_PARTS) + "|."


def format_descriptor(c: Column) -> Column:
    """A string's form: the class letters of its parts up to the first character of no class; line breaks read as spaces, ends are stripped.

    A mark goes before each part; class after class, a marked part becomes a sign of its own. So a
    text is passed over a dozen times, whatever the number of its parts, and none is read twice.
    """
    whole = c
    mark, odd = chr(0xE000), chr(0xF8FF)
    own = "".join(chr(0xE000 + k) for k in range(len(FORMAT_PARTS) + 2))
    c = F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), f"^[{_SPACE}]+|[{_SPACE}]+$", "")
    c = F.regexp_replace(F.translate(c, own, odd * len(own)), FORMAT_PATTERN, f"{mark}$0")
    sign = dict(FORMAT_PARTS)["q"]
    letters = ["q", "s", *(k for k, _ in FORMAT_PARTS if k != "q")]
    patterns = [rf"(?s)(?=[@\p{{Sc}}])(?=.*[0-9,.])(?:{sign})", sign, *(part for k, part in FORMAT_PARTS if k != "q")]
    for k, pattern in enumerate(patterns):
        c = F.regexp_replace(c, f"{mark}(?:{pattern})(?![^{own}])", own[k + 1])
    c = F.regexp_replace(c, f"(?s){mark}.*$", "")
    return F.when(whole.rlike(DIGITS), "i").otherwise(F.translate(c, own[1 : len(letters) + 1], "".join(letters)))


#: What a sentence's tokens are: words, and other characters one by one.
SENTENCE_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def sentence(column: Column, n: Column, longest: Column, shortest: Column, mean: Column, values: Column, most: int) -> Column:
    """The first `most` tokens of '{column} contains {n} values ({longest}, {shortest}, {mean}): v1, v2, ...', a space between."""
    whole = F.concat(column, F.lit(" contains "), n.cast("string"), F.lit(" values ("), longest.cast("string"), F.lit(", "), shortest.cast("string"), F.lit(", "), mean.cast("string"), F.lit("): "), F.array_join(values, ", "))
    return F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(SENTENCE_TOKEN), F.lit(0)), 1, most), " ")


def shuffled(c: Column, seed: int) -> Column:
    """The words of a text in an order that a hash of word, place and seed gives."""
    words = F.split(c, " ")
    keyed = F.transform(words, lambda w, i: F.struct(F.md5(F.concat_ws(":", w, (i + 1).cast("string"), F.lit(str(seed)))).alias("k"), w.alias("w")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["w"]), " ")
