"""Canonical forms of entity surfaces, entity classes and pseudonym prefixes.

Surfaces of ASCII characters alone stay in column expressions; NFKC and case folding have
no built-in, so the others are first folded by an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERSION = "1.0.0"

# They decide which surfaces link.
HONORIFICS = ("dr", "mr", "mrs", "ms", "miss", "mx", "prof", "professor", "sir", "madam", "shri", "smt", "kum", "rev", "hon")
LEGAL_FORMS = ("ltd", "limited", "inc", "incorporated", "pvt", "private", "llc", "llp", "plc", "gmbh", "corp", "corporation", "co", "company", "sa", "ag", "pte", "bv", "oy", "ab")
STRUCTURED = ("PHONE", "CREDIT_CARD", "SSN", "AADHAAR", "PAN", "ACCOUNT", "ACCOUNT_NUMBER", "NATIONAL_ID", "PASSPORT", "IBAN", "ROUTING_NUMBER", "MRN", "IP")
CLASSES = {
    "person": ("PERSON", "PER", "NAME"),
    "org": ("ORG", "ORGANIZATION", "COMPANY"),
    "loc": ("LOCATION", "LOC", "GPE", "ADDRESS"),
    "email": ("EMAIL",),
}
PREFIXES = {"person": "User", "org": "Org", "loc": "Loc", "email": "Email"}

#: What Python calls white space in text, and marks that are neither word nor white space.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
_MARKS = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, _SPACE, " "))


def _plain(s: Column) -> Column:
    return _squeezed(F.regexp_replace(s, _MARKS, " "))


def canonical(entity_type: Column, surface: Column, ascii_only: bool = False) -> Column:
    """The form under which surfaces of an entity link.

    With ascii_only the caller vouches that all surfaces are ASCII: no Python runs then.
    """
    kind = F.upper(entity_type)
    is_ascii = F.lit(True) if ascii_only else surface.rlike(r"^\p{ASCII}*$")
    bare = surface if ascii_only else F.when(is_ascii, surface).otherwise(_nfkc(F.when(~is_ascii, surface)))
    folded = F.lower(surface) if ascii_only else F.when(is_ascii, F.lower(surface)).otherwise(_folded(F.when(~is_ascii, surface)))
    s = F.regexp_replace(folded, f"^{_SPACE}|{_SPACE}$", "")
    # one comma: "last, first"
    commas = F.length(s) - F.length(F.translate(s, ",", ""))
    turned = F.when(commas == 1, F.concat_ws(" ", F.substring_index(s, ",", -1), F.substring_index(s, ",", 1))).otherwise(s)
    titles = "|".join(HONORIFICS)
    person = F.trim(F.regexp_replace(_plain(turned), f"^(?:(?:{titles})(?: |$))+", ""))
    org = F.regexp_replace(_plain(s), f"(?<=\\S)(?: (?:{'|'.join(LEGAL_FORMS)}))+$", "")
    return (
        F.when(kind.isin(*STRUCTURED), F.lower(F.regexp_replace(bare, "[^0-9a-zA-Z]", "")))
        .when(kind == "PERSON", person)
        .when(kind.isin(*CLASSES["org"]), org)
        .when(kind == "EMAIL", F.regexp_replace(s, _SPACE, ""))
        .otherwise(_plain(s))
    )


def entity_class(entity_type: Column) -> Column:
    kind = F.upper(entity_type)
    out = F.lower(entity_type)
    for name, kinds in CLASSES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def type_prefix(entity_type: Column) -> Column:
    """What stands before a pseudonym's digits: a class's own, or its name in title case."""
    of = entity_class(entity_type)
    # title case: a letter after a letter is lower; underscores part words and are dropped
    words = F.transform(F.split(of, "_"), lambda w: F.initcap(F.regexp_replace(w, r"(?<=[^\p{L}])(?=\p{L})", " ")))
    title = F.substring(F.regexp_replace(F.array_join(words, ""), " ", ""), 1, 12)
    out = F.when(F.length(title) == 0, "Ent").otherwise(title)
    for name, prefix in PREFIXES.items():
        out = F.when(of == name, prefix).otherwise(out)
    return out
