"""Text on plans: printed dimensions, areas, floors and room names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planwright.functions import lexicon as X

NUM = r"(\d{1,2}[.,]\d{1,3})"
FT = r"(\d{1,3})\s*['’′]\s*-?\s*(?:(\d{1,2}(?:\.\d)?)\s*(?:[\"”″]|'')?)?"
_ACCENTED, _BASE = X.accents()


def _decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def parse_dimension(text: Column) -> Column:
    """A printed dimension as (values in metres, unit), or null: pairs before singles, metric before imperial.

    Feet and inches are read only where nothing is in metres; a number alone is in metres with
    decimals and in millimetres from 300 on.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(text, "[×X]", "x"), r"\s+", " "))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)
    metres = lambda pattern, k: _decimal(part(pattern, k))
    millimetres = lambda pattern, k: part(pattern, k).try_cast("double") / 1000
    inches = lambda pattern, k: F.coalesce(part(pattern, k).try_cast("double"), F.lit(0.0))
    feet = lambda pattern, k: F.round(part(pattern, k).try_cast("double") * 0.3048 + inches(pattern, k + 1) * 0.0254, 4)
    imperial = t.rlike("['\"’”′″]") & ~t.rlike(r"\d\s*m\b")

    def found(pattern: str, unit: str, *values: Column) -> tuple[Column, Column]:
        return t.rlike(pattern), F.struct(F.array(*values).alias("values"), F.lit(unit).alias("unit"))

    foot_pair, foot = rf"(?i){FT}\s*x\s*{FT}", rf"(?i)^{FT}$"
    pair, whole_pair = rf"(?i){NUM}\s*m?\s*x\s*{NUM}\s*m\b", rf"(?i)^{NUM}\s*m?\s*x\s*{NUM}\s*m?$"
    mm_pair, single, mm = r"(?i)\b(\d{3,5})\s*x\s*(\d{3,5})\s*(mm)?\b", rf"(?i)^{NUM}\s*m?$", r"(?i)^(\d{3,5})\s*(mm)?$"
    ladder = [(imperial & ok, v) for ok, v in (found(foot_pair, "ft", feet(foot_pair, 1), feet(foot_pair, 3)), found(foot, "ft", feet(foot, 1)))]
    ladder += [
        (~imperial & ok, v)
        for ok, v in (
            found(pair, "m", metres(pair, 1), metres(pair, 2)),
            found(whole_pair, "m", metres(whole_pair, 1), metres(whole_pair, 2)),
            found(mm_pair, "mm", millimetres(mm_pair, 1), millimetres(mm_pair, 2)),
            found(single, "m", metres(single, 1)),
        )
    ]
    ladder.append((~imperial & t.rlike(mm) & (part(mm, 1).try_cast("int") >= 300), found(mm, "mm", millimetres(mm, 1))[1]))
    out = F.when(*ladder[0])
    for ok, v in ladder[1:]:
        out = out.when(ok, v)
    return out


def looks_like_dimension(text: Column) -> Column:
    """Numeric text worth a second reading."""
    return text.rlike(r"\d[.,]\d") | F.trim(text).rlike(r"^\d{3,5}$")


def parse_area(text: Column) -> Column:
    """Square metres of a printed area."""
    found = F.regexp_extract(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(?:sq\.?\s*(?:m\b|metres|meters)|m²|m2|square\s+met)", 1)
    return F.when(found != "", _decimal(found))


def parse_floor(text: Column) -> Column:
    """A floor label in title case, or null."""
    found = F.regexp_extract(text, r"(?i)\b((?:ground|first|second|third|fourth|fifth|lower ground|upper|basement|top)\s+floor)\b", 1)
    return F.when(found != "", F.initcap(F.lower(found)))


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents, combining marks dropped."""
    return F.regexp_replace(F.translate(text, _ACCENTED, _BASE), "[\\u0300-\\u036F]", "")


def normalized(text: Column) -> Column:
    """Upper case letters and digits alone, accents stripped."""
    return F.regexp_replace(F.upper(strip_accents(text)), "[^A-Z0-9]", "")


def edit_bound(length: Column) -> Column:
    """Edits allowed for a word of a length."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def label_tokens(raw: Column) -> Column:
    """The words of a room label; none for text in parentheses, which is a note."""
    t = F.regexp_replace(F.upper(strip_accents(raw)), "[’']", "")
    t = F.regexp_replace(t, r"[^A-Z0-9/&.\-| ]", " ")
    # words that scans split
    for pattern, word in ((r"\bBED\s+ROOM\b", "BEDROOM"), (r"\bBATH\s+ROOM\b", "BATHROOM"), (r"\bT\s*&\s*B\b", "T&B"), (r"\bW\s*/\s*C\b", "WC"), (r"\bW\s*/\s*D\b", "WD")):
        t = F.regexp_replace(t, pattern, word)
    words = F.filter(F.split(t, r"(?:[\s,+]|\bAND\b)+|(?<=[A-Z.])/(?=[A-Z])|(?<=[A-Z])/(?=\s)"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, r"^[.\-|]+|[.\-|]+$", "")
    return F.when(raw.rlike("[()]"), F.array().cast("array<string>")).otherwise(F.transform(words, lambda w: F.when(bare(w) == "", w).otherwise(bare(w))))


def as_letters(token: Column) -> Column:
    """A token with the letters that scans mistake for digits."""
    return F.translate(token, "".join(X.ALPHA_CONFUSIONS), "".join(X.ALPHA_CONFUSIONS.values()))
