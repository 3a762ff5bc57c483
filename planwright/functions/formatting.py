"""Measures as text, with what is known about where they come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provenances that are no estimates, the class of each provenance and what the classes mean.
EXACT = ("plan-label", "user")
CLASSES = {"plan-label": "known", "plan-geometry": "measured", "detected": "estimated", "ocr": "read", "estimated": "estimated", "inferred": "inferred", "assumed": "assumed", "user": "user"}
HELP = {
    "known": "Printed on the plan",
    "read": "Read from the plan automatically (OCR) — the reading may contain errors",
    "measured": "Measured from the drawing at the calibrated scale",
    "estimated": "Estimated (automatic detection or uncalibrated scale)",
    "inferred": "Inferred from drawing conventions",
    "assumed": "Not on the plan — a documented default",
    "user": "Entered by a user",
}
#: Classes that need no word behind the value.
PLAIN = ("measured", "known", "user")


def _fixed(value: Column, digits: int) -> Column:
    """Half-up decimals of the printed number."""
    return F.format_string(f"%.{digits}f", F.round(value.cast("decimal(20,9)"), digits).cast("double"))


def length(metres: Column, source: Column) -> Column:
    """Metres with two decimals, one where assumed; marked as approximate unless read or set."""
    text = F.when(source == "assumed", _fixed(metres, 1)).otherwise(_fixed(metres, 2))
    return F.concat(F.when(source.isin(*EXACT), F.lit("")).otherwise(F.lit("≈ ")), text, F.lit(" m"))


def area(square_metres: Column, source: Column | None = None) -> Column:
    source = F.lit("plan-geometry") if source is None else source
    return F.concat(F.when(source.isin(*EXACT), F.lit("")).otherwise(F.lit("≈ ")), _fixed(square_metres, 1), F.lit(" m²"))


def degrees(radians: Column) -> Column:
    return F.concat(F.floor(F.degrees(radians) + 0.5).cast("string"), F.lit("°"))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def provenance_class(source: Column) -> Column:
    return _looked_up(CLASSES, source)


def provenance_help(source: Column) -> Column:
    return _looked_up(HELP, provenance_class(source))


def measured(metres: Column, source: Column) -> Column:
    """A length with the class of its provenance, unless it was measured, printed or set."""
    kind = provenance_class(source)
    return F.concat(length(metres, source), F.when(kind.isin(*PLAIN), F.lit("")).otherwise(F.concat(F.lit(" ("), kind, F.lit(")"))))


def confidence(share: Column) -> Column:
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit(" %")), F.lit("not assessed"))
