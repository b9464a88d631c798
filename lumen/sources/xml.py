"""XML helpers that look at local names only, and colours of office documents."""

from __future__ import annotations

import colorsys
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from lumen.sources.html import contrast, hex_colour

WHITE, BLACK = (255, 255, 255), (0, 0, 0)

# Theme colours where a document has none, and the names that stand for them.
SCHEME = {
    "dk1": "000000", "lt1": "FFFFFF", "dk2": "44546A", "lt2": "E7E6E6", "accent1": "4472C4", "accent2": "ED7D31", "accent3": "A5A5A5", "accent4": "FFC000", "accent5": "5B9BD5", "accent6": "70AD47",
    "hlink": "0563C1", "folHlink": "954F72",
}
ALIAS = {"dark1": "dk1", "light1": "lt1", "dark2": "dk2", "light2": "lt2", "text1": "dk1", "background1": "lt1", "text2": "dk2", "background2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink", "bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"}
SHEET_ORDER = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
# Named colours of highlights and presets.
HIGHLIGHT = {"yellow": "FFFF00", "green": "00FF00", "cyan": "00FFFF", "magenta": "FF00FF", "blue": "0000FF", "red": "FF0000", "darkBlue": "000080", "darkCyan": "008080", "darkGreen": "008000", "darkMagenta": "800080", "darkRed": "800000", "darkYellow": "808000", "darkGray": "808080", "lightGray": "C0C0C0", "black": "000000", "white": "FFFFFF"}
PRESET = {"white": "FFFFFF", "black": "000000", "red": "FF0000", "green": "008000", "blue": "0000FF", "yellow": "FFFF00", "cyan": "00FFFF", "magenta": "FF00FF", "gray": "808080", "grey": "808080", "silver": "C0C0C0", "ltgray": "D3D3D3", "whitesmoke": "F5F5F5", "snow": "FFFAFA", "ivory": "FFFFF0", "ghostwhite": "F8F8FF", "navy": "000080"}
# The indexed palette of sheets.
INDEXED = """000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF
000000 FFFFFF FF0000 00FF00 0000FF FFFF00 FF00FF 00FFFF
800000 008000 000080 808000 800080 008080 C0C0C0 808080
9999FF 993366 FFFFCC CCFFFF 660066 FF8080 0066CC CCCCFF
000080 FF00FF FFFF00 00FFFF 800080 800000 008080 0000FF
00CCFF CCFFFF CCFFCC FFFF99 99CCFF FF99CC CC99FF FFCC99
3366FF 33CCCC 99CC00 FFCC00 FF9900 FF6600 666699 969696
003366 339966 003300 333300 993300 993366 333399 333333""".split()


class Unsafe(ValueError):
    """XML that declares a document type or entities."""


def parse(data: bytes) -> ET.Element | None:
    """The root, or None if the XML is broken. Nothing with a document type is parsed: no entity is ever expanded."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", data.replace(b"\0", b"")):
        raise Unsafe("document type or entity declarations")
    try:
        return ET.fromstring(data)
    except ET.ParseError:
        return None


def local(name: str) -> str:
    return name.rsplit("}", 1)[-1] if isinstance(name, str) else ""


def kids(el: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in el if local(c.tag) == name] if el is not None else []


def kid(el: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        el = next(iter(kids(el, name)), None)
    return el


def all_of(el: ET.Element | None, name: str) -> list[ET.Element]:
    return [c for c in el.iter() if local(c.tag) == name] if el is not None else []


def att(el: ET.Element | None, name: str, otherwise: str | None = None) -> str | None:
    if el is not None:
        for k, v in el.attrib.items():
            if local(k) == name:
                return v
    return otherwise


def rid(el: ET.Element, name: str = "id") -> str | None:
    return next((v for k, v in el.attrib.items() if "relationships" in k and local(k) == name), None)


def whole(value: str | None, otherwise: int | None = None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return otherwise


def is_on(value: str | None) -> bool:
    return value in ("1", "true")


def switch(el: ET.Element) -> bool:
    """Whether a toggle element is on; without a value it is."""
    return att(el, "val", "1") not in ("0", "false", "off", "none")


def texts(el: ET.Element | None, *names: str) -> str:
    return "".join(c.text or "" for c in el.iter() if local(c.tag) in (names or ("t",))) if el is not None else ""


def words(el: ET.Element | None) -> str:
    return " ".join(t.strip() for t in el.itertext() if t.strip()) if el is not None else ""


def above(el: ET.Element) -> Iterator[tuple[ET.Element, ET.Element]]:
    for parent in el.iter():
        for child in parent:
            yield child, parent


class Theme:
    """Theme colours by name, by word processor attributes, and by sheet index."""

    def __init__(self, root: ET.Element | None = None):
        self.colours = {k: hex_colour(v) for k, v in SCHEME.items()}
        for entry in next(iter(all_of(root, "clrScheme")), []):
            for c in entry:
                if found := self._plain(c):
                    self.colours[local(entry.tag)] = found

    def _plain(self, c: ET.Element) -> tuple | None:
        kind, value = local(c.tag), att(c, "val") or ""
        if kind == "srgbClr":
            return hex_colour(value)
        if kind == "sysClr":
            return hex_colour(att(c, "lastClr") or "") or (WHITE if value == "window" else BLACK)
        if kind == "schemeClr":
            return self.colours.get(ALIAS.get(value, value))
        if kind == "prstClr":
            return hex_colour(PRESET.get(value.lower(), ""))
        if kind == "scrgbClr":
            parts = [whole(att(c, k)) for k in "rgb"]
            return tuple(int(p / 100_000 * 255) for p in parts) if None not in parts else None
        return None

    def word(self, name: str | None, tint: str | None = None, shade: str | None = None) -> tuple | None:
        rgb = self.colours.get(ALIAS.get(name, name))
        try:
            if rgb and tint:
                rgb = tuple(int(v + (255 - v) * (1 - int(tint, 16) / 255)) for v in rgb)
            if rgb and shade:
                rgb = tuple(int(v * int(shade, 16) / 255) for v in rgb)
        except ValueError:
            pass
        return rgb

    def sheet(self, el: ET.Element | None) -> tuple | None:
        """A sheet's colour element: rgb, theme with tint, or palette index."""
        if el is None or is_on(att(el, "auto")):
            return None
        if att(el, "rgb"):
            return hex_colour(att(el, "rgb"))
        index = whole(att(el, "theme"))
        if index is not None and index < len(SHEET_ORDER):
            rgb = self.colours[SHEET_ORDER[index]]
            try:
                t = float(att(el, "tint") or 0)
            except ValueError:
                t = 0.0
            return tuple(int(v + (255 - v) * t) if t > 0 else int(v * (1 + t)) for v in rgb)
        index = whole(att(el, "indexed"))
        return hex_colour(INDEXED[index]) if index is not None and index < len(INDEXED) else None

    def drawing(self, box: ET.Element | None) -> tuple[tuple | None, float | None]:
        """(colour, percent opaque) of a drawing's colour container, its modifiers applied in order."""
        for c in box if box is not None else ():
            if local(c.tag) not in ("srgbClr", "schemeClr", "sysClr", "prstClr", "scrgbClr"):
                continue
            rgb, alpha, light = self._plain(c), 100.0, {}
            if rgb is None:
                return None, None
            for m in c:
                share, name = whole(att(m, "val")), local(m.tag)
                if share is None:
                    continue
                share /= 100_000
                if name == "alpha":
                    alpha = share * 100
                elif name in ("lumMod", "lumOff"):
                    light[name] = share
                elif name in ("tint", "shade"):
                    rgb = tuple(int(v * share + (255 * (1 - share) if name == "tint" else 0)) for v in rgb)
            if light:
                h, lum, s = colorsys.rgb_to_hls(*(v / 255 for v in rgb))
                lum = min(1.0, max(0.0, lum * light.get("lumMod", 1) + light.get("lumOff", 0)))
                rgb = tuple(round(v * 255) for v in colorsys.hls_to_rgb(h, lum, s))
            return rgb, alpha
        return None, None


def unseen(fore: tuple | None, back: tuple | None, what: str = "background", least: float = 1.5) -> str | None:
    """A reason if a colour cannot be told from what is behind it; unknown colours give none."""
    if fore is None or back is None or (ratio := contrast(fore, back)) >= least:
        return None
    return "font color #%02X%02X%02X on %s #%02X%02X%02X (contrast %.2f:1)" % (*fore, what, *back, ratio)


__all__ = ["HIGHLIGHT", "Theme", "Unsafe", "above", "all_of", "att", "hex_colour", "is_on", "kid", "kids", "local", "parse", "rid", "switch", "texts", "unseen", "whole", "words"]
