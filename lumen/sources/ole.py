"""Compound files: legacy Office documents and Outlook messages."""

from __future__ import annotations

import re
import struct

from lumen.sources.unpack import Artifact

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE

# Streams and storages that legacy documents are known to have.
KNOWN = {
    "WordDocument", "1Table", "0Table", "Data", "\x05SummaryInformation", "\x05DocumentSummaryInformation", "\x01CompObj", "ObjectPool", "Macros", "_VBA_PROJECT_CUR", "MsoDataStore", "Workbook", "Book",
    "PowerPoint Document", "Current User", "Pictures", "_signatures", "\x06DataSpaces", "EncryptedPackage", "EncryptionInfo", "VBA", "PROJECT", "PROJECTwm", "_xmlsignatures", "\x01Ole", "Ole", "CompObj",
    "Contents", "Quill", "Escher", "Envelope", "VisioDocument", "EncryptedSummary", "Revision Log", "User Names", "Workspace",
}
# Extensions of packaged files that run.
RUNNING = tuple("." + x for x in "exe dll scr js jse vbs vbe ps1 bat cmd hta lnk msi jar wsf cpl com pif".split())


class Compound:
    """Directory, streams and sector table of a compound file."""

    def __init__(self, raw: bytes):
        if len(raw) < 512 or not raw.startswith(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"):
            raise ValueError("no compound file header")
        self.raw, self.size = raw, 1 << struct.unpack("<H", raw[30:32])[0]
        if self.size not in (512, 4096):
            raise ValueError("odd sector size")
        fats, start, _, self.cutoff, mini, _, difat, _ = struct.unpack("<IIIIIIII", raw[44:76])
        places = [x for x in struct.unpack("<109I", raw[76:512]) if x < END - 1]
        seen = set()
        while difat < END - 1 and difat not in seen:
            seen.add(difat)
            part = struct.unpack(f"<{self.size // 4}I", self.sector(difat).ljust(self.size, b"\xff"))
            places += [x for x in part[:-1] if x < END - 1]
            difat = part[-1]
        self.fat: list[int] = []
        for x in places[:fats]:
            self.fat += struct.unpack(f"<{self.size // 4}I", self.sector(x).ljust(self.size, b"\xff"))
        entries = self.chain(start)
        self.mini_fat = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := self.chain(mini)) else []
        self.entries = [self._entry(entries[k : k + 128]) for k in range(0, len(entries) - 127, 128)]
        self.mini = self.chain(self.entries[0]["start"]) if self.entries else b""
        self.streams: dict[str, dict] = {}
        self.storages: list[str] = []
        if self.entries:
            self._walk(self.entries[0]["child"], "", set())

    def sector(self, k: int) -> bytes:
        return self.raw[(k + 1) * self.size : (k + 2) * self.size]

    def chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < len(self.fat) and k not in seen:
            seen.add(k)
            out.append(self.sector(k))
            k = self.fat[k]
        return b"".join(out)

    @staticmethod
    def _entry(e: bytes) -> dict:
        n, kind = struct.unpack("<H", e[64:66])[0], e[66]
        left, right, child = struct.unpack("<III", e[68:80])
        start, size = struct.unpack("<IQ", e[116:128])
        return {"name": e[: max(0, n - 2)].decode("utf-16-le", "replace"), "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size & 0xFFFFFFFF}

    def _walk(self, k: int, folder: str, seen: set) -> None:
        todo = [k]
        while todo:
            k = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            path = f"{folder}/{e['name']}".lstrip("/")
            todo += [e["left"], e["right"]]
            if e["kind"] == 1:
                self.storages.append(path)
                self._walk(e["child"], path, seen)
            elif e["kind"] == 2:
                self.streams[path] = e

    def read(self, path: str, a: Artifact) -> bytes:
        e = self.streams.get(path)
        if e is None:
            return b""
        a.budget.charge(e["size"], path)
        if e["size"] >= self.cutoff:
            return self.chain(e["start"])[: e["size"]]
        out, k, seen = [], e["start"], set()
        while k < len(self.mini_fat) and k not in seen:
            seen.add(k)
            out.append(self.mini[k * 64 : (k + 1) * 64])
            k = self.mini_fat[k]
        return b"".join(out)[: e["size"]]


def read(a: Artifact) -> None:
    try:
        c = Compound(a.raw)
    except (ValueError, struct.error) as e:
        a.file_type = "OLE compound file"
        a.error(f"Invalid OLE file: {e}")
        return
    if a.kind == "msg" and any(p.startswith("__substg1.0_") for p in c.streams):
        _message(a, c)
    else:
        _document(a, c)
    _slack(a, c)


def _document(a: Artifact, c: Compound) -> None:
    from lumen.sources.formats import strings

    tops = list(dict.fromkeys(p.split("/")[0] for p in [*c.streams, *c.storages]))
    kinds = (("WordDocument", "Word document (legacy .doc)"), ("Workbook", "Excel workbook (legacy .xls)"), ("Book", "Excel workbook (legacy .xls)"), ("PowerPoint Document", "PowerPoint presentation (legacy .ppt)"), ("VisioDocument", "Visio drawing"), ("Quill", "Publisher document"))
    a.file_type = next((label for name, label in kinds if name in tops), "OLE compound file")
    if "EncryptedPackage" in tops:
        a.file_type = "Encrypted Office document"
        a.found("INFO", "Encrypted document", "file", "The document is protected by a password; its content cannot be looked at.")
        return
    for name, value in _summary(c.read("\x05SummaryInformation", a)).items():
        a.fact("meta", value, "summary", name=name)
        a.text(value, f"summary [{name}]", True, "document property")
    if any(re.search(r"(^|/)(VBA|Macros|_VBA_PROJECT_CUR)(/|$)", p) for p in [*c.storages, *c.streams]):
        a.found("HIGH", "VBA macros", "VBA storage", "The document holds a VBA macro project.")
        for path in c.streams:
            if re.search(r"(^|/)VBA/", path) and not path.endswith(("dir", "_VBA_PROJECT")):
                if code := macro_text(c.read(path, a)):
                    a.fact("macro", code, path)
                    a.text(" ".join(re.findall(r'"([^"]{8,})"', code)), path, True, "macro strings")
    if "WordDocument" in tops:
        text = word_text(c, a)
        if re.search(r"\x13\s*(DDEAUTO|DDE|INCLUDETEXT)\b", text):
            a.found("HIGH", "Field code", "document", "A field starts programs or pulls in other files.", text[:600])
        a.text(re.sub(r"[\x00-\x08\x0b-\x1f]", "\n", text), "document text")
        a.found("INFO", "Limited analysis", "document", "Formatting of legacy documents is not looked at; a copy as .docx can be scanned in full.")
    elif "PowerPoint Document" in tops:
        a.text("\n".join(slide_texts(c.read("PowerPoint Document", a))), "slides text")
        a.found("INFO", "Limited analysis", "presentation", "Formatting of legacy slides is not looked at; a copy as .pptx can be scanned in full.")
    elif "Workbook" in tops or "Book" in tops:
        data = c.read("Workbook" if "Workbook" in tops else "Book", a)
        for kind, name, state, macro in book_sheets(data):
            if kind == "locked":
                a.found("INFO", "Encrypted workbook", "workbook", "The workbook is encrypted.")
            else:
                a.fact("sheet", "", f"Sheet '{name}'", ("visible", "hidden", "veryHidden")[min(state, 2)], hidden=macro, name=name)
        a.text("\n".join(strings(data, 5000)), "workbook strings")
        a.found("INFO", "Limited analysis", "workbook", "Cells of legacy workbooks are not looked at; a copy as .xlsx can be scanned in full.")
    for path in c.streams:
        base = path.rsplit("/", 1)[-1]
        if base == "\x01Ole10Native":
            name, data = packaged(c.read(path, a))
            a.found("HIGH" if name.lower().endswith(RUNNING) else "MEDIUM", "Embedded package", path, f"Packaged file '{name}'.")
            a.child(name or "package.bin", data)
        elif base == "Package" or base == "CONTENTS":
            data = c.read(path, a)
            if base == "Package" or data.startswith(b"%PDF"):
                a.found("MEDIUM", "Embedded document", path, f"{len(data):,} bytes, scanned below.")
                a.child("embedded.pdf" if data.startswith(b"%PDF") else "embedded.bin", data)
    objects = sorted({p for p in c.storages if re.search(r"(^|/)(ObjectPool/[^/]+|MBD[0-9A-F]+)$", p)})[:30]
    if objects:
        a.found("MEDIUM", "Embedded OLE objects", "storages", f"{len(objects)} embedded objects.", "\n".join(objects))
    odd = sorted(t for t in tops if t not in KNOWN and not t.startswith(("MBD", "_", "\x03")))
    if odd:
        a.found("LOW", "Non-standard streams", "file", f"{len(odd)} streams that such documents do not have.", ", ".join(odd))


def _summary(data: bytes) -> dict[str, str]:
    """Title, subject, author, keywords and comments of a summary stream."""
    names, out = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments"}, {}
    try:
        base = struct.unpack("<I", data[44:48])[0]
        for k in range(min(64, struct.unpack("<I", data[base + 4 : base + 8])[0])):
            key, at = struct.unpack("<II", data[base + 8 + 8 * k : base + 16 + 8 * k])
            kind, size = struct.unpack("<II", data[base + at : base + at + 8])
            if key in names and kind in (30, 31):
                raw = data[base + at + 8 : base + at + 8 + size * (kind - 29)]
                if text := raw.decode("cp1252" if kind == 30 else "utf-16-le", "replace").strip("\0 "):
                    out[names[key]] = text
    except struct.error:
        pass
    return out


def macro_text(data: bytes) -> str:
    """The compressed source at the end of a module stream, by the published container format."""
    for at in [m.start() for m in re.finditer(b"\x01[\x00-\xff][\xb0-\xbf]", data)]:
        try:
            text = _decompressed(data[at:]).decode("cp1252", "replace")
        except (IndexError, ValueError):
            continue
        if text.startswith("Attribut"):
            return "\n".join(x for x in text.splitlines() if not x.startswith("Attribute ")).strip()
    return ""


def _decompressed(data: bytes) -> bytes:
    out, at = bytearray(), 1
    while at + 2 <= len(data):
        head = struct.unpack("<H", data[at : at + 2])[0]
        stop, begin = at + (head & 0xFFF) + 3, len(out)
        if (head >> 12) & 7 != 3:
            break
        at += 2
        if not head & 0x8000:
            out += data[at : at + 4096]
            at += 4096
            continue
        while at < min(stop, len(data)):
            flags, at = data[at], at + 1
            for bit in range(8):
                if at >= min(stop, len(data)):
                    break
                if not flags >> bit & 1:
                    out.append(data[at])
                    at += 1
                    continue
                token = struct.unpack("<H", data[at : at + 2])[0]
                at += 2
                bits = max(4, (len(out) - begin - 1).bit_length())
                size, back = (token & (0xFFFF >> bits)) + 3, (token >> (16 - bits)) + 1
                if back > len(out):
                    raise ValueError("bad copy")
                for _ in range(size):
                    out.append(out[-back])
    return bytes(out)


def word_text(c: Compound, a: Artifact) -> str:
    """The text of a legacy document by its piece table."""
    main = c.read("WordDocument", a)
    if len(main) < 426 or struct.unpack("<H", main[:2])[0] != 0xA5EC:
        return ""
    flags = struct.unpack("<H", main[10:12])[0]
    if flags & 0x100:
        a.found("INFO", "Encrypted document", "file", "The document is encrypted.")
        return ""
    table = c.read("1Table" if flags & 0x200 else "0Table", a)
    start, size = struct.unpack("<II", main[418:426])
    clx, out = table[start : start + size], []
    while clx[:1] == b"\x01":
        clx = clx[3 + struct.unpack("<H", clx[1:3])[0] :]
    if clx[:1] != b"\x02":
        return ""
    body = clx[5 : 5 + struct.unpack("<I", clx[1:5])[0]]
    n = (len(body) - 4) // 12
    ends = struct.unpack(f"<{n + 1}I", body[: 4 * n + 4])
    for k in range(n):
        place = struct.unpack("<I", body[4 * n + 4 + 8 * k + 2 : 4 * n + 4 + 8 * k + 6])[0]
        size = ends[k + 1] - ends[k]
        if place & 0x40000000:
            place = (place & 0x3FFFFFFF) // 2
            out.append(main[place : place + size].decode("cp1252", "replace"))
        else:
            out.append(main[place : place + 2 * size].decode("utf-16-le", "replace"))
    return "".join(out)


def slide_texts(data: bytes) -> list[str]:
    """Text atoms of legacy slides; containers are stepped into."""
    out, at = [], 0
    while at + 8 <= len(data):
        version, kind, size = struct.unpack("<HHI", data[at : at + 8])
        at += 8
        if version & 0xF == 0xF:
            continue
        if kind in (0x0FA0, 0x0FBA):
            out.append(data[at : at + size].decode("utf-16-le", "replace"))
        elif kind == 0x0FA8:
            out.append(data[at : at + size].decode("cp1252", "replace"))
        at += size
    return out


def book_sheets(data: bytes) -> list[tuple]:
    """(kind, name, state, is macro sheet) of a legacy workbook; kind 'locked' if it is encrypted."""
    out, at = [], 0
    while at + 4 <= len(data):
        kind, size = struct.unpack("<HH", data[at : at + 4])
        body = data[at + 4 : at + 4 + size]
        if kind == 0x2F:
            return [("locked", "", 0, False)]
        if kind == 0x85 and len(body) > 7:
            n, wide = body[6], body[7] & 1
            out.append(("sheet", body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace"), body[4] & 3, body[5] == 1))
        at += 4 + size
    return out


def packaged(data: bytes) -> tuple[str, bytes]:
    """(name, content) of a packaged file."""
    try:
        parts = data[6:].split(b"\0", 2)
        rest = parts[2][4:]
        size = struct.unpack("<I", rest[:4])[0]
        rest = rest[4 + size :]
        n = struct.unpack("<I", rest[:4])[0]
        return parts[0].decode("cp1252", "replace"), rest[4 : 4 + n]
    except (IndexError, struct.error):
        return "", data


def _message(a: Artifact, c: Compound) -> None:
    a.file_type = "Outlook message (.msg)"

    def prop(tag: str, folder: str = "") -> str:
        wide, narrow = (c.read(f"{folder}__substg1.0_{tag}{kind}", a) for kind in ("001F", "001E"))
        return wide.decode("utf-16-le", "replace") if wide else narrow.decode("cp1252", "replace")

    heads = dict(re.findall(r"(?m)^([\w-]+): (.*(?:\r?\n[ \t].*)*)", prop("007D")))
    sender = prop("5D01") or prop("0C1F")
    told = {"from": f"{prop('0C1A')} <{sender}>".strip(), "to": prop("0E04"), "subject": prop("0037")} | {k.lower(): v for k, v in heads.items()}
    for k, v in told.items():
        a.fact("header", v, "headers", name=k)
    body, html = prop("1000"), c.read("__substg1.0_10130102", a).decode("utf-8", "replace") or prop("1013")
    if body:
        a.fact("mail_plain", body, "body")
        a.text(body, "body (text)")
    if html:
        a.fact("html", html, "body (HTML)", hidden=True)
    for folder in sorted({p.split("/")[0] + "/" for p in c.streams if p.startswith("__attach_version1.0_")}):
        name, data = prop("3707", folder) or prop("3704", folder) or "attachment", c.read(f"{folder}__substg1.0_37010102", a)
        flags = c.read(f"{folder}__properties_version1.0", a)
        gone = any(flags[k : k + 4] == b"\x0b\x00\xfe\x7f" and flags[k + 8 : k + 9] == b"\x01" for k in range(8, len(flags) - 15, 16))
        a.fact("attachment", "", "message", "attachment", hidden=gone, name=name, n=[len(data)])
        a.child(name, data)


def _slack(a: Artifact, c: Compound) -> None:
    """Sectors that belong to nothing, and bytes behind the last one in use."""
    from lumen.sources.formats import strings

    free = b"".join(c.sector(k) for k, x in enumerate(c.fat) if x == FREE)
    if free.strip(b"\0") and free.strip(b"\xff") and free.replace(b"\0", b"").replace(b"\xff", b""):
        a.fact("ole_slack", "\n".join(strings(free, 20)), "file", n=[len(free)])
        a.text("\n".join(strings(free, 20)), "unallocated sectors", True)
    used = max((k for k, x in enumerate(c.fat) if x != FREE), default=-1)
    extra = a.raw[(used + 2) * c.size :]
    if len(extra) > c.size and extra.strip(b"\0"):
        a.fact("appended", "\n".join(strings(extra, 15)), "file", "the last sector in use", n=[len(extra)])
