"""Parameter files: sections of keyed lines, comments after a hash, field lists by position."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Section:
    """One section: its file, header lines, delimiter, fields by position, and other keys with their values."""

    file: str | None = None
    header: int = 0
    delimiter: str = "SPACE"
    fields: dict[str, int] = field(default_factory=dict)
    keys: dict[str, list[str]] = field(default_factory=dict)


_SECTIONS = ("PEDFILE", "DATAFILE", "REFFILE", "MAPFILE", "FRFILE", "GENOFILE", "CANDIDATE_GENOFILE", "REFERENCE_GENOFILE", "FRQC", "POPQC", "IMPUTE", "MENDEL", "HAPLOTYPE", "LD", "QC", "OUTPUT", "INPUT", "G_OPTIONS")
# Other spellings of keys.
_SPELLINGS = {"HAPLOTYE": "HAPLOTYPE", "NO_VAIABLES": "NO_VARIABLES", "SEX_CONCORDENCE": "SEX_CONCORDANCE", "CALL_RATE": "ANIMAL_CR", "CALL_RATE_THRESHOLD": "ANIMAL_CR", "MIN_MAF": "MAF"}


def to_logical(value: str) -> bool:
    """True for true, t, yes, y, 1 and .true. in any case."""
    return value.strip().strip(".").lower() in ("true", "t", "yes", "y", "1")


def parse(text: str) -> dict[str, Section]:
    """Sections by name; keys before any section are under the empty name. Quotes around values fall away."""
    out: dict[str, Section] = {"": Section()}
    now, listing = out[""], 0
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        m = re.match(r"([A-Za-z_][\w]*)\s*:\s*(.*)$", line)
        key = _SPELLINGS.get(m[1].upper(), m[1].upper()) if m else ""
        values = re.findall(r"\"[^\"]*\"|'[^']*'|[^\s,]+", m[2]) if m else []
        values = [v.strip("\"'") for v in values]
        if m and key in _SECTIONS:
            now = out.setdefault(key, Section())
            now.file, listing = (values[0] if values else now.file), 0
        elif m and key == "NO_VARIABLES":
            listing = int(values[0])
        elif listing > 0 and (pair := line.replace(":", " ").split()) and len(pair) >= 2 and any(p.isdigit() for p in pair[:2]):
            name, at = (pair[0], pair[1]) if pair[1].isdigit() else (pair[1], pair[0])
            now.fields[name.upper()] = int(at)
            listing -= 1
        elif m and key == "HEADER" and values and values[0].isdigit():
            now.header = int(values[0])
        elif m and key in ("DELIM", "DELIMITER") and values:
            now.delimiter = values[0]
        elif m:
            now.keys[key] = values
        else:
            now.keys.setdefault(line.split()[0].upper(), line.split()[1:])
    return out
