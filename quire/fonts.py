"""Font sets for drawing: a set counts only if all its faces exist and can draw the target language's letters.

A font that lacks letters draws boxes without a word of warning, so a set that was named is used or refused, never replaced.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass
from pathlib import Path

# Letters that Latin fonts lack most often, and sets that systems bring along (regular, bold, italic).
PROBE = "ặữổỹằẵợựỡẫĐđỨƯờáàảãạêôơưêế"
DEJAVU = "/usr/share/fonts/truetype/dejavu"
LIBERATION = "/usr/share/fonts/truetype/liberation"
SYSTEM_SETS = (
    (f"{DEJAVU}/DejaVuSerif.ttf", f"{DEJAVU}/DejaVuSerif-Bold.ttf", f"{DEJAVU}/DejaVuSerif-Italic.ttf"),
    (f"{LIBERATION}/LiberationSerif-Regular.ttf", f"{LIBERATION}/LiberationSerif-Bold.ttf", f"{LIBERATION}/LiberationSerif-Italic.ttf"),
)
VARIABLE = "QUIRE_FONT"


class MissingFont(ValueError):
    """No font set that can be used; the message says why."""


@dataclass(frozen=True)
class FontSet:
    name: str
    regular: str
    bold: str
    italic: str


def _ranges(data: bytes) -> list[tuple[int, int]]:
    """Code points that the character maps (formats 4 and 12) of a TrueType or OpenType font name."""
    tables = {data[i : i + 4]: struct.unpack(">II", data[i + 8 : i + 16]) for i in range(12, 12 + 16 * struct.unpack(">H", data[4:6])[0], 16)}
    at, _ = tables[b"cmap"]
    out: list[tuple[int, int]] = []
    for k in range(struct.unpack(">H", data[at + 2 : at + 4])[0]):
        sub = at + struct.unpack(">I", data[at + 8 + 8 * k : at + 12 + 8 * k])[0]
        kind = struct.unpack(">H", data[sub : sub + 2])[0]
        if kind == 4:
            n = struct.unpack(">H", data[sub + 6 : sub + 8])[0] // 2
            ends = struct.unpack(f">{n}H", data[sub + 14 : sub + 14 + 2 * n])
            starts = struct.unpack(f">{n}H", data[sub + 16 + 2 * n : sub + 16 + 4 * n])
            out += [(a, b) for a, b in zip(starts, ends) if a != 0xFFFF]
        elif kind == 12:
            n = struct.unpack(">I", data[sub + 12 : sub + 16])[0]
            out += [struct.unpack(">II", data[sub + 16 + 12 * i : sub + 24 + 12 * i]) for i in range(n)]
    return out


def missing(path: str, letters: str = PROBE) -> list[str]:
    """The letters that a font file can't draw."""
    try:
        found = _ranges(Path(path).read_bytes())
    except (struct.error, KeyError, IndexError) as e:
        raise MissingFont(f"{Path(path).name} can't be read as a font: {e}") from e
    return [c for c in letters if not any(a <= ord(c) <= b for a, b in found)]


def named_set(value: str | None = None, separator: str = os.pathsep) -> tuple[str, str, str] | None:
    """The set named by QUIRE_FONT: one path for all faces, or three."""
    value = os.environ.get(VARIABLE) if value is None else value
    if not value:
        return None
    paths = [p for p in value.split(separator) if p]
    paths = paths * 3 if len(paths) == 1 else paths
    if len(paths) != 3:
        raise MissingFont(f"{VARIABLE} takes one path or three (regular, bold, italic), not {len(paths)}")
    return paths[0], paths[1], paths[2]


def choose(sets: tuple[tuple[str, str, str], ...] | None = None) -> FontSet:
    """The first set with all faces there and complete; a named one alone, where one is named."""
    named = named_set() if sets is None else None
    reasons = []
    for faces in sets if sets is not None else ((named,) if named else SYSTEM_SETS):
        absent = [f for f in faces if not Path(f).exists()]
        if absent:
            reasons.append(f"{absent[0]} isn't there")
            continue
        lacking = next(((f, m) for f in faces if (m := missing(f))), None)
        if lacking:
            reasons.insert(0, f"{Path(lacking[0]).name} lacks {len(lacking[1])} letters ({''.join(lacking[1][:8])})")
            continue
        return FontSet(Path(faces[0]).name, *faces)
    raise MissingFont(f"no font set can be used: {'; '.join(reasons[:3]) or 'none is named'}")


def css(fonts: FontSet, size: float, line_height: float) -> str:
    """Style of drawn text with the set's three faces."""
    face = lambda path, extra: f"@font-face{{font-family:t;src:url('{Path(path).name}');{extra}}}"
    return face(fonts.regular, "") + face(fonts.bold, "font-weight:bold;") + face(fonts.italic, "font-style:italic;") + f"*{{font-family:t;font-size:{size:g}pt;line-height:{line_height:g};}}"
