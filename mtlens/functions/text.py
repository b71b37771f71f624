"""Column-level text functions: tokenizers and lexicon membership.

Everything here returns a ``Column`` built from JVM built-ins (regexp,
split, higher-order array functions), so it stays inside whole-stage
codegen and never crosses into Python.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------
# Negation lexicons used by the three stages of the reference pipeline, in
# the order it lists them. Multi-word entries can never equal a single token;
# they are kept for fidelity and are inert in token matching.
NEG_RULE = (
    "नहीं", "न", "मत", "ना", "नहि", "बिना",
    "अभी नहीं", "कभी नहीं", "कहीं नहीं",
    "कोई नहीं", "कुछ नहीं", "न जाने", "हरगिज़ नहीं",
    "अभी तक नहीं", "बिलकुल नहीं", "कभी भी नहीं",
    "नकार", "इन्कार", "अस्वीकृत", "अस्वीकार",
    "वर्जित", "रद्द", "नहीं किया", "नहीं होगा",
    "नहीं था", "नहीं है", "ना ही",
)
NEG_CONTRA = (
    "नहीं", "ना", "मत", "न",
    "अभी तक नहीं", "कभी नहीं", "बिलकुल नहीं", "कभी भी नहीं",
    "नकार", "इन्कार", "अस्वीकृत", "अस्वीकार",
    "वर्जित", "रद्द", "बिना",
    "नहीं किया", "नहीं होगा", "नहीं था", "नहीं है", "ना ही",
)
NEG_PARA = (
    "नहीं", "ना", "मत", "न", "अभी तक नहीं", "कभी नहीं",
    "बिलकुल नहीं", "कभी भी नहीं", "इन्कार", "वर्जित",
    "रद्द", "बिना", "नहीं किया", "नहीं होगा", "नहीं था",
    "नहीं है", "ना ही",
)
# Category domain of the sample table: similar (label P) and dissimilar (NP).
SIMILAR_CATEGORIES = ("Word_synm", "Mixd_lang", "Negt_anto", "Identical", "Fluent", "Default_similar")
DISSIMILAR_CATEGORIES = (
    "Anto_flip", "Negt_flip", "Gend_flip", "Sing_plul", "Tens_chng",
    "Word_ordr", "Word_rplc", "Add_extra", "Omission", "Neutral", "Default_dissimilar",
)
# --- end of fixed values -------------------------------------------------

# Unicode whitespace as Python's str.split() sees it, written with \x{..}
# escapes that mean the same in Java regex and RE2.
WS_CLASS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
WS_RUN = WS_CLASS + "+"
CONTROL_WS = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}]"  # all of ASCII but the blank
WIDE_WS = r"[\x{85}\x{A0}\x{1680}-\x{3000}](?<=" + WS_CLASS + ")"  # all others; a range goes by faster than the class
DANDA = "।"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_col(c), rf"^{WS_RUN}|{WS_RUN}$", "")


def tokens_ws(c: Column | str) -> Column:
    """Python ``str.split()``: whitespace tokens without empty strings.

    A text whose only whitespace is the blank is cut at each of them, without a regular expression.
    """
    return _cut(_col(c), _col(c))


def _cut(c: Column, raw: Column) -> Column:
    """Whitespace tokens of ``c``, which holds no whitespace but that of ``raw`` and blanks."""
    wide = (F.octet_length(raw) != F.length(raw)) & raw.rlike(WIDE_WS)
    return F.array_remove(F.split(c, F.when(raw.rlike(CONTROL_WS), F.lit(WS_RUN)).when(wide, F.lit(WS_RUN)).otherwise(F.lit(" "))), F.lit(""))


def tokens_word(c: Column | str, split_danda: bool = False) -> Column:
    """Lowercase word tokens (tokenizer contract, see README).

    Lowercase; space out ``; ? ! @ # $ % & * ( ) [ ] { } < > "``, ``,`` and
    ``:`` unless a digit follows, runs of two or more dots and ``--``, and a
    period that ends a sentence (followed by whitespace or the end); then
    split on whitespace. The danda is split only when ``split_danda``.
    """
    punct = r';?!@#$%&*()\[\]{}<>"' + (DANDA if split_danda else "")
    s = F.lower(_col(c))
    # the look at the first character lets most go by without trying the three
    s = F.regexp_replace(s, rf"(?=[{punct}.\-])([{punct}]|\.\.+|--)", " $1 ")  # none of these is touched by the blanks around commas and colons
    s = F.regexp_replace(s, r"([,:])([^0-9]|$)", " $1 $2")
    s = F.regexp_replace(s, rf"\.(?<=[^.]\.)(?={WS_CLASS}|$)", " .")
    return _cut(s, _col(c))


def lexicon_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def neg_count(tokens: Column | str, lexicon: Iterable[str] = NEG_RULE) -> Column:
    """Number of tokens (with repeats) that are in the negation lexicon."""
    rest = tokens = _col(tokens)
    for word in dict.fromkeys(lexicon):
        rest = F.array_remove(rest, F.lit(word))
    return F.when(tokens.isNull(), F.size(tokens)).otherwise(F.size(tokens) - F.size(rest))


def has_negation(tokens: Column | str, lexicon: Iterable[str] = NEG_PARA) -> Column:
    lex = lexicon_array(lexicon)
    return F.exists(_col(tokens), lambda t: F.array_contains(lex, t))


def neg_parity(tokens1: Column | str, tokens2: Column | str, lexicon: Iterable[str] = NEG_CONTRA) -> Column:
    """(neg1 + neg2) mod 2 as a double."""
    return ((neg_count(tokens1, lexicon) + neg_count(tokens2, lexicon)) % 2).cast("double")


def label_is_p(c: Column | str = "label") -> Column:
    """``label.strip() == 'P'``; a null label is not P (null-safe)."""
    return strip(c).eqNullSafe(F.lit("P"))


def label_is_np(c: Column | str = "label") -> Column:
    return strip(c).eqNullSafe(F.lit("NP"))
