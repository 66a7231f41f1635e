"""Devanagari text: normal form, comparison key, units. The rules are patterns shared by columns and plain strings."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the orthography.
STOPS_OF_NASAL = {"ङ": "कखगघ", "ञ": "चछजझ", "ण": "टठडढ", "न": "तथदध", "म": "पफबभ"}
CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळऩऱ"
VOWELS = "अआइईउऊऋएऐओऔऑऍ"
SIGNS = "ािीुूृेैोौॅॉ"
TOP_SIGNS = "िीेैोौॅॉ"
VIRAMA, NUKTA, ANUSVARA, CHANDRABINDU = "्", "़", "ं", "ँ"
MATCH_PAIRS = [("ँ", "ं"), ("ऋ", "रि"), ("ृ", "्रि"), ("ष", "श"), ("ॉ", "ो"), ("ॅ", "े"), (" ", "")]

_STOPS = "".join(STOPS_OF_NASAL.values())
_BEFORE = f"(?=[{_STOPS}{''.join(STOPS_OF_NASAL)}])"
_AFTER_ALL = f"(?![{_STOPS}{''.join(STOPS_OF_NASAL)}])"
#: In order: what is replaced and by what. Each rule looks one character around at most.
RULES = [
    ("[‌‍]", ""),
    (r"^\s+|\s+$", ""),
    (r"\s+", " "),
    ("|".join(f"{n}{VIRAMA}(?=[{s}])" for n, s in STOPS_OF_NASAL.items()), ANUSVARA),
    (f"{CHANDRABINDU}{_BEFORE}", ANUSVARA),
    (f"(?<=[{TOP_SIGNS}]){CHANDRABINDU}", ANUSVARA),
    (f"(?<![{TOP_SIGNS}]){ANUSVARA}{_AFTER_ALL}", CHANDRABINDU),
]
_COMPILED = [(re.compile(p), r) for p, r in RULES]


def normalise_text(s: str | None) -> str:
    s = unicodedata.normalize("NFC", s or "")
    for pattern, by in _COMPILED:
        s = pattern.sub(by, s)
    return s


def match_key_text(s: str | None) -> str:
    s = normalise_text(s)
    for a, b in MATCH_PAIRS:
        s = s.replace(a, b)
    return s


@F.arrow_udf(T.StringType())
def nfc(s: pa.Array) -> pa.Array:
    """Canonical composition; Spark has no function for it."""
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in s.to_pylist()], pa.string())


def normalise(s: Column) -> Column:
    out = nfc(F.coalesce(s, F.lit("")))
    for pattern, by in RULES:
        out = F.regexp_replace(out, pattern.replace(r"\s", r"[\s   -     　]"), by)
    return out


def match_key(s: Column) -> Column:
    """Coarse key of a spelling. s is normalised first."""
    out = normalise(s)
    for a, b in MATCH_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def letters_only(s: Column) -> Column:
    """Only Devanagari code points and spaces."""
    return F.regexp_replace(s, r"[^\u0900-\u097F ]", "")


def units(s: Column) -> Column:
    """Letters with their nukta, signs, marks and spaces, in order."""
    return F.regexp_extract_all(s, F.lit(f"(?s)[{CONSONANTS}]{NUKTA}|."), F.lit(0))
