"""Expressions for marks, flags and badges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# What an image can be taken for, in the order of the rules.
DIAGRAM_KINDS = [
    "use-case-like (actors/ovals detected)",
    "sequence-like (wide, many connecting lines + participant boxes)",
    "component/class-like (boxes + connectors detected)",
    "no diagram-like structure detected (may be a photo, logo, or text screenshot)",
    "diagram-like structure present, type unclear",
]


def clamp(value: Column, top: Column) -> Column:
    """An integer between 0 and top out of a JSON score's text: numbers lose their fraction, whole-number strings count, all else is 0.

    value is the JSON text of the score, strings with their quotes.
    """
    raw = F.trim(value)
    quoted = raw.startswith('"')
    inner = F.regexp_replace(raw, '^"\\s*|\\s*"$', "")
    number = F.when(quoted, F.when(inner.rlike(r"^[+-]?\d{1,18}$"), inner.try_cast("double"))).otherwise(F.when(raw == "true", 1.0).when(raw == "false", 0.0).otherwise(raw.try_cast("double")))
    whole = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.when(whole.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(top.cast("bigint"), whole))).cast("int")


def flag_tone(flags: Column) -> Column:
    return F.when(flags.isNull() | flags.isin("", "None"), F.lit(None).cast("string")).when(flags.startswith("SCORING ERROR"), "red").otherwise("amber")


def score_badge(percentage: Column) -> Column:
    return F.when(percentage.isNull(), "neutral").when(percentage >= 75, "green").when(percentage >= 50, "amber").otherwise("red")


def grounding_badge(cited: Column, fraction: Column) -> tuple[Column, Column]:
    """(label, tone)."""
    none = F.coalesce(cited, F.lit(0)) == 0
    pct = F.floor(fraction * 100 + 0.5)
    tone = F.when(none, "neutral").when(pct >= 90, "green").when(pct >= 70, "amber").otherwise("red")
    return F.when(none, "n/a").otherwise(F.concat(pct.cast("string"), F.lit("%"))), tone


def short_flags(flags: Column) -> Column:
    return F.when(F.length(flags) > 60, F.concat(F.substring(flags, 1, 57), F.lit("..."))).otherwise(flags)


def diagram_kind(width: Column, height: Column, boxes: Column, ellipses: Column, n_lines: Column) -> tuple[Column, Column]:
    """(type_guess, has_diagram_structure) from shape counts; the first rule that fits decides."""
    structure = (boxes >= 2) | (ellipses >= 2) | (n_lines >= 15)
    aspect = F.try_divide(width.cast("double"), height.cast("double"))
    kind = (
        F.when((ellipses >= 2) & (boxes <= 2), DIAGRAM_KINDS[0]).when((aspect >= 1.3) & (boxes >= 1) & (n_lines >= 30), DIAGRAM_KINDS[1])
        .when((boxes >= 3) & (n_lines >= 10), DIAGRAM_KINDS[2]).when(~structure, DIAGRAM_KINDS[3]).otherwise(DIAGRAM_KINDS[4])
    )
    return kind, structure


def scaled(system: Column, system_max: Column, hand: Column, hand_max: Column) -> dict[str, Column]:
    """Percentages of both marks, the system's on the hand scale, and hand less system there and in percentage points."""
    own, other = F.try_divide(system * 100.0, system_max), F.try_divide(hand * 100.0, hand_max)
    to_hand = system * F.try_divide(hand_max, system_max)
    return {"sys_pct": own, "hand_pct": other, "sys_scaled_to_hand": to_hand, "diff_scaled": hand - to_hand, "diff_pct": other - own}
