"""Drawing translated pages into PDF files: fonts, lines of text in frames, and books of double pages.

``draw_book`` takes a file and the items of its pages and gives a file whose pages show the source on the left and the translated
page on the right. ``overlay`` takes the source's text out of the frames of items that fit and draws the targets there; ``reflow``
draws all items on a white page, at the places that ``operators.packing`` gave them.
"""

from __future__ import annotations

import html
import re
import struct
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from .fonts import FontSet
from .operators.packing import BOX_LADDER, FLOOR
from .sources.pdffile import Name, Page, Pdf, Ref, Stream

LINE = 1.2  # height of a line for a line height of 1, in sizes
LABEL = 7.0


class Face:
    """A TrueType file: glyphs, widths, and the objects that embed it."""

    def __init__(self, path: str):
        self.data = Path(path).read_bytes()
        self.name = re.sub(r"[^A-Za-z0-9-]", "", Path(path).stem)
        d = self.data
        self.tables = {d[i : i + 4]: struct.unpack(">II", d[i + 8 : i + 16]) for i in range(12, 12 + 16 * struct.unpack(">H", d[4:6])[0], 16)}
        self.units = struct.unpack(">H", d[self.tables[b"head"][0] + 18 :][:2])[0]
        hhea = self.tables[b"hhea"][0]
        self.ascent, self.descent = (x / self.units for x in struct.unpack(">hh", d[hhea + 4 : hhea + 8]))
        self.long = struct.unpack(">H", d[hhea + 34 : hhea + 36])[0]
        self.glyphs = self._glyphs()
        self.used: dict[int, str] = {}

    def _glyphs(self) -> dict[int, int]:
        d, at = self.data, self.tables[b"cmap"][0]
        out: dict[int, int] = {}
        for k in range(struct.unpack(">H", d[at + 2 : at + 4])[0]):
            sub = at + struct.unpack(">I", d[at + 8 + 8 * k : at + 12 + 8 * k])[0]
            kind = struct.unpack(">H", d[sub : sub + 2])[0]
            if kind == 4:
                n = struct.unpack(">H", d[sub + 6 : sub + 8])[0] // 2
                part = lambda i, code="H": struct.unpack(f">{n}{code}", d[sub + 14 + 2 * n * i + 2 * (i > 0) :][: 2 * n])  # noqa: E731, B023
                ends, starts, deltas, offsets = part(0), part(1), part(2), part(3)
                for i, (a, b) in enumerate(zip(starts, ends)):
                    for c in range(a, min(b, 0xFFFE) + 1):
                        if not offsets[i]:
                            out[c] = c + deltas[i] & 0xFFFF
                            continue
                        spot = sub + 16 + 6 * n + 2 * i + offsets[i] + 2 * (c - a)
                        g = struct.unpack(">H", d[spot : spot + 2])[0]
                        out[c] = g + deltas[i] & 0xFFFF if g else 0
            elif kind == 12:
                for i in range(struct.unpack(">I", d[sub + 12 : sub + 16])[0]):
                    a, b, g = struct.unpack(">III", d[sub + 16 + 12 * i : sub + 28 + 12 * i])
                    out |= {c: g + c - a for c in range(a, b + 1)}
        return {c: g for c, g in out.items() if g}

    def width(self, glyph: int) -> float:
        at = self.tables[b"hmtx"][0] + 4 * min(glyph, self.long - 1)
        return struct.unpack(">H", self.data[at : at + 2])[0] / self.units

    def length(self, text: str) -> float:
        return sum(self.width(self.glyphs.get(ord(c), 0)) for c in text)

    def codes(self, text: str) -> str:
        out = [self.glyphs.get(ord(c), 0) for c in text]
        self.used |= dict(zip(out, text))
        return "".join(f"{g:04x}" for g in out)

    def embed(self, out: Book) -> Ref:
        """The font's objects: the file whole, and what its used glyphs say."""
        pairs = sorted((g, c) for g, c in self.used.items() if g)
        said = "".join(f"<{g:04x}> <{c.encode('utf-16-be').hex()}>\n" for g, c in pairs)
        cmap = f"/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /U def /CMapType 2 def 1 begincodespacerange <0000> <ffff> endcodespacerange\n{len(pairs)} beginbfchar\n{said}endbfchar endcmap end end"
        box = [round(x * 1000 / self.units) for x in struct.unpack(">4h", self.data[self.tables[b"head"][0] + 36 :][:8])]
        file = out.add(Stream({"Length1": len(self.data)}, self.data))
        about = out.add({"Type": Name("FontDescriptor"), "FontName": Name(self.name), "Flags": 4, "FontBBox": box, "ItalicAngle": 0, "Ascent": round(self.ascent * 1000), "Descent": round(self.descent * 1000), "CapHeight": 700, "StemV": 80, "FontFile2": file})
        widths = [x for g, _ in pairs for x in (g, [round(self.width(g) * 1000)])]
        kin = out.add({"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name(self.name), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": about, "W": widths, "CIDToGIDMap": Name("Identity")})
        return out.add({"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name(self.name), "Encoding": Name("Identity-H"), "DescendantFonts": [kin], "ToUnicode": out.add(Stream({}, cmap.encode()))})


def written(x) -> bytes:
    """An object in the file's syntax."""
    if isinstance(x, dict):
        return b"<<" + b"".join(written(Name(k)) + b" " + written(v) + b" " for k, v in x.items()) + b">>"
    if isinstance(x, list):
        return b"[" + b" ".join(map(written, x)) + b"]"
    if isinstance(x, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"()<>[]{}/%#" else b"#%02x" % c for c in x.encode("latin-1", "replace"))
    if isinstance(x, bytes):
        return b"<" + x.hex().encode() + b">"
    if isinstance(x, Ref):
        return b"%d 0 R" % x.number
    if isinstance(x, bool) or x is None:
        return {True: b"true", False: b"false", None: b"null"}[x]
    return b"%d" % x if isinstance(x, int) else f"{x:.4f}".rstrip("0").rstrip(".").encode()


class Book:
    """A file in the making."""

    def __init__(self, source: Pdf):
        self.source = source
        self.objects: dict[int, object] = {1: None, 2: None}
        self.taken: dict[int, Ref] = {}
        self.pages: list[Ref] = []

    def add(self, x) -> Ref:
        n = len(self.objects) + 1
        if isinstance(x, Stream) and "Filter" not in x.info:
            x = Stream(x.info | {"Filter": Name("FlateDecode")}, zlib.compress(x.raw))
        self.objects[n] = x
        return Ref(n)

    def copy(self, x):
        """An object of the source with all that it refers to, each of these once."""
        if isinstance(x, Ref):
            if x.number not in self.taken:
                self.objects[len(self.objects) + 1] = None
                self.taken[x.number] = Ref(len(self.objects))
                self.objects[self.taken[x.number].number] = self.copy(self.source.get(x))
            return self.taken[x.number]
        if isinstance(x, dict):
            return {k: self.copy(v) for k, v in x.items() if k not in ("Parent", "StructParent", "StructParents")}
        if isinstance(x, Stream):
            return Stream({k: self.copy(v) for k, v in x.info.items() if k != "Length"}, x.raw)
        return [self.copy(v) for v in x] if isinstance(x, list) else x

    def form(self, page: Page, contents: bytes) -> Ref:
        """A page's contents as a form that stands upright in a box from 0, 0 to its size."""
        a, b, c, d, e, f = page.display
        upright = [a, -b, c, -d, e, page.size[1] - f]
        return self.add(Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": list(page.box), "Matrix": upright, "Resources": self.copy(page.pdf.get(page.held.get("Resources")) or {})}, contents))

    def page(self, width: float, height: float, contents: str, fonts: dict, forms: dict) -> Ref:
        stream = self.add(Stream({}, contents.encode("latin-1")))
        return self.add({"Type": Name("Page"), "Parent": Ref(2), "MediaBox": [0, 0, width, height], "Contents": stream, "Resources": {"Font": fonts, "XObject": forms}})

    def bytes(self) -> bytes:
        self.objects[1] = {"Type": Name("Catalog"), "Pages": Ref(2)}
        self.objects[2] = {"Type": Name("Pages"), "Kids": self.pages, "Count": len(self.pages)}
        out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
        for n, x in self.objects.items():
            places.append(len(out))
            out += b"%d 0 obj\n" % n
            out += written(x.info | {"Length": len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream" if isinstance(x, Stream) else written(x)
            out += b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return bytes(out + b"trailer\n" + written({"Size": len(places) + 1, "Root": Ref(1)}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


@dataclass
class Pen:
    """The three faces, and text in frames."""

    faces: dict[str, Face]

    @classmethod
    def of(cls, fonts: FontSet) -> Pen:
        by_path: dict[str, Face] = {p: Face(p) for p in (fonts.regular, fonts.bold, fonts.italic)}
        return cls({"R": by_path[fonts.regular], "B": by_path[fonts.bold], "I": by_path[fonts.italic]})

    def words(self, markup: str) -> list[list[tuple[str, str]]]:
        """Words as runs (face, text) of simple markup; a face changes inside a word too."""
        out: list[list[tuple[str, str]]] = [[]]
        bold = italic = 0
        for piece in re.split(r"(<[^>]*>)", markup):
            if tag := re.match(r"<(/?)(b|strong|i|em|br)\b", piece, re.I):
                step = -1 if tag[1] else 1
                bold += step * (tag[2].lower() in ("b", "strong"))
                italic += step * (tag[2].lower() in ("i", "em"))
                out += [[]] if tag[2].lower() == "br" else []
            elif not piece.startswith("<"):
                for k, w in enumerate(re.split(r"\s+", html.unescape(piece))):
                    if k:
                        out.append([])
                    if w:
                        out[-1].append(("B" if bold > 0 else "I" if italic > 0 else "R", w))
        return [w for w in out if w]

    def length(self, word: list[tuple[str, str]]) -> float:
        return sum(self.faces[f].length(t) for f, t in word)

    def broken(self, words: list, width: float, size: float) -> list[list]:
        """Lines of words; a word longer than a line stands alone."""
        lines, used, space = [], 0.0, self.faces["R"].length(" ") * size
        for w in words:
            n = self.length(w) * size
            if lines and used + space + n <= width + 1e-6:
                lines[-1].append(w)
                used += space + n
            else:
                lines.append([w])
                used = n
        return lines

    def fit(self, words: list, width: float, height: float, size: float) -> tuple[float, float, list[list]] | None:
        """The first rung of the ladder at which the words stand in the frame: scale, line height, lines."""
        for scale, spacing in BOX_LADDER:
            lines = self.broken(words, width, size * scale)
            wide = max((self.length(w) * size * scale for l in lines for w in l), default=0.0)
            if len(lines) * size * scale * LINE * spacing <= height + 0.5 and wide <= width + 0.5:
                return scale, spacing, lines
        return None

    def draw(self, lines: list[list], x: float, top: float, size: float, spacing: float) -> str:
        """Operators that show lines from ``top`` (upwards from the page's foot) down."""
        out, space = [], self.faces["R"].length(" ")
        for n, line in enumerate(lines):
            y, at = top - size * LINE * spacing * (n + 0.5) - size * 0.3, x
            for w in line:
                for f, t in w:
                    out.append(f"/{f} {size:.3f} Tf 1 0 0 1 {at:.3f} {y:.3f} Tm <{self.faces[f].codes(t)}> Tj")
                    at += self.faces[f].length(t) * size
                out.append(f"<{self.faces[w[-1][0]].codes(' ')}> Tj")
                at += space * size
        return "BT " + "\n".join(out) + " ET\n" if out else ""


def framed(item: dict, size: tuple[float, float]) -> tuple[float, float, float, float] | None:
    """The frame of an item, clipped to the page; None where it has none that can be used."""
    x0, y0, x1, y1 = map(float, item["bbox"].split(","))
    if x1 <= x0 or y1 <= y0 or x0 < 0 or y0 < 0 or x0 >= size[0] or y0 >= size[1]:
        return None
    return x0, y0, min(x1, size[0]), min(y1, size[1])


def draw_book(content: bytes, pages: dict[int, list[dict]], fonts: FontSet, mode: str = "overlay", only: tuple[int, int] | None = None, report: Iterable[str] = ()) -> tuple[bytes, list[tuple[int, int, float, bool]]]:
    """The file of double pages, and (page, block_id, ratio, overflow) of every item drawn or tried.

    ``pages``: items (block_id, bbox, shown, done, size, and for reflow left, right, top, height) by page, in order. Overlay leaves items
    without a target as they are, keeps the source of what doesn't fit, and of what forms show. Pages without items show the source
    twice in overlay and a white page in reflow.
    """
    source, pen = Pdf(content), Pen.of(fonts)
    out, stats, sheets = Book(source), [], []
    for n, page in enumerate(source.pages):
        if only and not only[0] <= n <= only[1]:
            continue
        (w, h), items, drawn, gone = page.size, pages.get(n, []), [], []
        for i in items:
            frame, words, size = framed(i, page.size), pen.words(i["shown"] or ""), float(i.get("size") or 10.0)
            if frame is None or not words or (mode == "overlay" and not i["done"]):
                continue
            x0, y0, x1, y1 = frame
            if mode == "reflow" and i.get("left") is not None:
                x0, y0, x1, y1 = i["left"], i["top"], i["right"], i["top"] + i["height"]
            found = pen.fit(words, x1 - x0, y1 - y0, size)
            stats.append((n, i["block_id"], found[0] if found else FLOOR, found is None))
            if found is None and mode == "overlay":
                continue
            scale, spacing, lines = found or (FLOOR, BOX_LADDER[-1][1], pen.broken(words, x1 - x0, size * FLOOR))
            drawn.append(pen.draw(lines, w + x0, h - y0, size * scale, spacing))
            gone.append(frame)
        forms = {"A": out.form(page, page.contents)}
        right = ""
        if mode == "overlay":
            forms["B"] = out.form(page, page.without_text(gone)) if gone else forms["A"]
            right = f"q 1 0 0 1 {w:.3f} 0 cm /B Do Q\n"
        label = str(n + 1)
        told = pen.draw([[[("R", label)]]], w - pen.length([("R", label)]) * LABEL / 2, 6 + LABEL * LINE, LABEL, 1.0)
        sheets.append((2 * w, h, f"q /A Do Q\n{right}{''.join(drawn)}{told}", forms))
    first = [pen.words(html.escape(l)) or [[("R", " ")]] for l in report]
    if first:
        w, h = sheets[0][:2] if sheets else (1224.0, 792.0)
        sheets.insert(0, (w, h, pen.draw([l for ws in first for l in pen.broken(ws, w - 80, 11.0)], 40, h - 40, 11.0, 1.4), {}))
    faces = {k: f.embed(out) for k, f in pen.faces.items() if f.used}
    out.pages = [out.page(w, h, told, faces, forms) for w, h, told, forms in sheets]
    return out.bytes(), stats
