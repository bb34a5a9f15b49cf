"""Rename templates: compiled on the driver into one column expression."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curatrix.functions.scalars import once, stem, validate_name

DATES = {"yyyy-MM-dd": "yyyy-MM-dd", "yyyyMMdd": "yyyyMMdd", "yyyy-MM": "yyyy-MM", "dd-MM-yyyy": "dd-MM-yyyy"}
CASES = ("original", "lower", "upper", "title")
SPACES = ("keep", "dash", "underscore")


@dataclass(frozen=True)
class Preset:
    id: str
    name: str
    format: str
    letter_case: str = "original"
    space_replacement: str = "keep"
    collapse_spaces: bool = True
    remove_accents: bool = False


class InvalidPreset(ValueError):
    pass


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _titled(text: str) -> str:
    out, word = [], False
    for c in text:
        out.append(c.lower() if word else c.upper())
        word = c.isalnum()
    return "".join(out)


@F.pandas_udf(StringType())
def fold_accents(text: pd.Series) -> pd.Series:
    return text.map(_plain, na_action="ignore")


@F.pandas_udf(StringType())
def title_case(text: pd.Series) -> pd.Series:
    return text.map(_titled, na_action="ignore")


def tokens(template: str) -> list[tuple[str, str]]:
    """('text', literal) and ('token', name) in order; InvalidPreset for stray braces."""
    out, at = [], 0
    for m in re.finditer(r"\{([^{}]*)\}", template):
        out += [("text", template[at : m.start()]), ("token", m[1])]
        at = m.end()
    out.append(("text", template[at:]))
    if any(kind == "text" and re.search(r"[{}]", s) for kind, s in out):
        raise InvalidPreset("INVALID_PRESET")
    return out


def render_name(preset: Preset, name: Column, period: Column, day: Column, counter: Column) -> Column:
    """The new name of a file: template, accents, letter case, reserved characters, spaces; then its own extension."""
    if preset.letter_case not in CASES or preset.space_replacement not in SPACES:
        raise InvalidPreset("INVALID_PRESET")
    parts = []
    for kind, s in tokens(preset.format):
        if kind == "text":
            parts.append(F.lit(s))
        elif s in ("name", "period"):
            parts.append(stem(name) if s == "name" else period)
        elif s in ("year", "month", "day"):
            parts.append(F.date_format(day, {"year": "yyyy", "month": "MM", "day": "dd"}[s]))
        elif s == "counter":
            parts.append(counter.cast("string"))
        elif s.startswith("date:") and s[5:] in DATES:
            parts.append(F.date_format(day, DATES[s[5:]]))
        elif re.fullmatch(r"counter:[0-9]{1,8}", s):
            text, width = counter.cast("string"), len(s) - 8
            parts.append(F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))
        else:
            raise InvalidPreset("INVALID_PRESET")
    out = F.concat(*parts)
    if preset.remove_accents:
        out = fold_accents(out)
    if preset.letter_case != "original":
        out = {"lower": F.lower, "upper": F.upper, "title": title_case}[preset.letter_case](out)
    out = F.regexp_replace(out, r"[\p{Cc}<>:\"/?*\\|]", "")
    if preset.collapse_spaces:
        out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(F.trim(out), r"\.+$", "")
    if preset.space_replacement != "keep":
        out = F.replace(out, F.lit(" "), F.lit("-" if preset.space_replacement == "dash" else "_"))
    own = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return once(out, lambda made: F.when(made != "", F.concat(made, own)))


def name_error(new_name: Column) -> Column:
    return F.when(new_name.isNull(), "INVALID_NAME").otherwise(validate_name(new_name))


def validate_presets(presets: list[Preset], rule_presets: dict[str, str], default_id: str | None) -> str | None:
    """INVALID_PRESET, or None. Presets are few (at most 200), so this is driver work."""
    ids = [p.id for p in presets]
    bad = len(presets) > 200 or len(set(ids)) < len(ids) or not all(ids)
    bad = bad or any(not p.name.strip() or len(p.name.encode()) > 120 or not p.format or len(p.format.encode()) > 240 for p in presets)
    bad = bad or any(v not in ids for v in rule_presets.values()) or (default_id is not None and default_id not in ids)
    for p in [] if bad else presets:
        try:
            render_name(p, F.lit("Example.pdf"), F.lit("Periodo 3"), F.lit("2026-09-21").cast("date"), F.lit(1))
        except InvalidPreset:
            bad = True
        literal = re.sub(r"\{[^{}]*\}", "x" if "{" in p.format else "", p.format).strip(" .")
        bad = bad or not literal or re.fullmatch(r"(?i)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?", literal) is not None
    return "INVALID_PRESET" if bad else None


__all__ = ["InvalidPreset", "Preset", "fold_accents", "name_error", "render_name", "title_case", "tokens", "validate_presets"]
