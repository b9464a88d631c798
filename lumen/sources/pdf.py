"""PDF: objects, links between them, keys that act, and text with its place, as far as simple content goes."""

from __future__ import annotations

import re
import zlib

from lumen.sources.unpack import Artifact

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
MAX_OBJECTS = 200_000


def unfiltered(a: Artifact, body: bytes) -> bytes:
    """The content of a stream object; of filters only Flate and ASCII hex are known."""
    m = STREAM.search(body)
    data = m[1] if m else b""
    head = body[: m.start()] if m else body
    for name in re.findall(rb"/(FlateDecode|Fl|ASCIIHexDecode|AHx)\b", head):
        try:
            if name in (b"FlateDecode", b"Fl"):
                d = zlib.decompressobj()
                data = d.decompress(data, a.budget.part + 1)
            else:
                data = bytes.fromhex(re.sub(rb"[^0-9a-fA-F]", b"", data).decode())
        except (zlib.error, ValueError):
            return b""
        a.budget.charge(len(data), "PDF stream")
    return data


def literal(raw: bytes) -> str:
    """A string's text."""
    if raw.startswith(b"<"):
        digits = re.sub(rb"[^0-9a-fA-F]", b"", raw).decode()
        data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        names = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else names.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")


STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9a-fA-F\s]*>"
TOKEN = re.compile(rb"%[^\r\n]*|(" + STRING + rb")|(\[)|(\])|/([^\s()<>\[\]{}/%]*)|([-+]?\d*\.?\d+)|([A-Za-z'\"*]+[01]?)|<<|>>", re.S)


def page_items(content: bytes, fonts_alpha: dict[str, float]) -> list[tuple]:
    """('span', text, x, y, size, mode, alpha, rgb) and ('fill', x0, y0, x1, y1, alpha, rgb) in painting order.

    Text matrices are followed for place and scale, without rotation; widths are taken as half the size a letter.
    """
    out, args, path, saved = [], [], [], []
    s = {"size": 12.0, "mode": 0, "rgb": (0, 0, 0), "alpha": 1.0, "ctm": (1.0, 1.0, 0.0, 0.0)}
    line, lead, array = (1.0, 1.0, 0.0, 0.0), 0.0, None
    x = y = 0.0

    def show(text: str) -> None:
        nonlocal x
        scale = abs(line[1]) * abs(s["ctm"][1])
        if text:
            out.append(("span", text, s["ctm"][2] + (line[2] + x) * s["ctm"][0], s["ctm"][3] + (line[3] + y) * s["ctm"][1], s["size"] * scale, s["mode"], s["alpha"], s["rgb"]))
            x += 0.5 * s["size"] * line[0] * len(text)

    for m in TOKEN.finditer(content):
        text, opens, closes, name, number, op = m.groups()
        if text is not None:
            (array if array is not None else args).append(literal(text))
        elif opens:
            array = []
        elif closes:
            args.append(array or [])
            array = None
        elif name is not None:
            args.append("/" + name.decode("latin-1"))
        elif number is not None:
            (array if array is not None else args).append(float(number))
        elif op is not None:
            op, a = op.decode("latin-1"), args
            nums = [v for v in a if isinstance(v, float)]
            if op == "q":
                saved.append(dict(s))
            elif op == "Q" and saved:
                s = saved.pop()
            elif op == "cm" and len(nums) == 6:
                c = s["ctm"]
                s["ctm"] = (c[0] * nums[0], c[1] * nums[3], c[2] + c[0] * nums[4], c[3] + c[1] * nums[5])
            elif op == "gs" and a:
                s["alpha"] = fonts_alpha.get(str(a[-1])[1:], s["alpha"])
            elif op == "Tf" and nums:
                s["size"] = abs(nums[-1])
            elif op == "Tr" and nums:
                s["mode"] = int(nums[-1])
            elif op in ("g", "rg", "k", "sc", "scn") and nums:
                v = [min(1.0, max(0.0, n)) for n in nums[-4:]]
                v = [v[0]] * 3 if len(v) == 1 else [(1 - n) * (1 - v[3]) for n in v[:3]] if len(v) == 4 else v
                s["rgb"] = tuple(round(n * 255) for n in v) if len(v) == 3 else s["rgb"]
            elif op == "BT":
                line, x, y = (1.0, 1.0, 0.0, 0.0), 0.0, 0.0
            elif op == "Tm" and len(nums) == 6:
                line, x, y = (nums[0], nums[3], nums[4], nums[5]), 0.0, 0.0
            elif op in ("Td", "TD") and len(nums) == 2:
                line, x, y = (line[0], line[1], line[2] + nums[0] * line[0], line[3] + nums[1] * line[1]), 0.0, 0.0
                lead = -nums[1] if op == "TD" else lead
            elif op == "TL" and nums:
                lead = nums[-1]
            elif op in ("T*", "'", '"'):
                line, x = (line[0], line[1], line[2], line[3] - lead * line[1]), 0.0
                if op != "T*" and a and isinstance(a[-1], str):
                    show(a[-1])
            elif op == "Tj" and a and isinstance(a[-1], str):
                show(a[-1])
            elif op == "TJ" and a and isinstance(a[-1], list):
                show("".join(v if isinstance(v, str) else " " if v < -200 else "" for v in a[-1]))
            elif op == "re" and len(nums) == 4:
                c = s["ctm"]
                xs, ys = sorted((c[2] + c[0] * v) for v in (nums[0], nums[0] + nums[2])), sorted((c[3] + c[1] * v) for v in (nums[1], nums[1] + nums[3]))
                path.append((xs[0], ys[0], xs[1], ys[1]))
            elif op in ("f", "F", "f*", "B", "B*", "b", "b*"):
                out += [("fill", *box, s["alpha"], s["rgb"]) for box in path]
                path = []
            elif op in ("S", "s", "n"):
                path = []
            elif op == "Do" and a:
                c = s["ctm"]
                out.append(("image", c[2], c[3], c[2] + c[0], c[3] + c[1], s["alpha"], (0, 0, 0), str(a[-1])[1:]))
            args = []
    return out


def objects_of(a: Artifact, raw: bytes) -> dict[int, bytes]:
    """Objects by number, the last definition of each; those in object streams included."""
    found = {int(n): body for n, _, body in OBJECT.findall(raw)[:MAX_OBJECTS]}
    for body in [b for b in found.values() if b"/ObjStm" in b]:
        data, first = unfiltered(a, body), re.search(rb"/First\s+(\d+)", body)
        if data and first:
            head = [int(v) for v in data[: int(first[1])].split()]
            places = [(head[k], int(first[1]) + head[k + 1]) for k in range(0, len(head) - 1, 2)]
            for (n, at), stop in zip(places, [*(p for _, p in places[1:]), len(data)], strict=True):
                found.setdefault(n, data[at:stop])
    return found


def page_texts(a: Artifact, found: dict[int, bytes]) -> list[list[tuple]]:
    alphas = {n.decode("latin-1"): float(v) for b in found.values() for n, v in re.findall(rb"/(\w+)\s*<<[^<>]*/ca\s+([\d.]+)", b)}
    for b in found.values():
        for n, ref in re.findall(rb"/(\w+)\s+(\d+)\s+0\s+R", b):
            m = re.search(rb"/ca\s+([\d.]+)", found.get(int(ref), b"")[:400])
            if m and b"stream" not in found[int(ref)]:
                alphas.setdefault(n.decode("latin-1"), float(m[1]))
    out = []
    for _, body in sorted(found.items()):
        if re.search(rb"/Type\s*/Page\b(?!s)", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            numbers = [int(v) for v in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
            box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", body)
            content = b"\n".join(unfiltered(a, found.get(n, b"")) for n in numbers)
            out.append([("page", *(float(v) for v in (box.groups() if box else (0, 0, 612, 792)))), *page_items(content, alphas)])
    return out


def read(a: Artifact) -> None:
    from lumen.sources.formats import strings

    raw = a.raw
    a.file_type = "PDF document"
    start = raw.find(b"%PDF")
    if start > 0:
        a.fact("prepended", "\n".join(strings(raw[:start], 10)), "file", "PDF", n=[start])
    ends = [m.end() for m in re.finditer(rb"%%EOF", raw)]
    extra = raw[ends[-1] :] if ends else b""
    if len(extra.strip(b"\0\r\n\t ")) > 32:
        a.fact("appended", "\n".join(strings(extra, 15)), "file", "%%EOF", n=[len(extra)])
        a.text(extra.decode("utf-8", "ignore"), "appended data", True)
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
        a.found("INFO", "Encrypted document", "file", "The document is encrypted; its content is not looked at.")
        return
    found = objects_of(a, raw)
    if not found:
        a.error("Cannot open PDF: no objects")
        return
    trailers = re.findall(rb"trailer(.*?)(?:startxref|$)", raw, re.S) + [b for b in found.values() if b"/Type/XRef" in b.replace(b" ", b"")]
    roots = {int(v) for t in trailers for v in re.findall(rb"(\d+)\s+\d+\s+R", t.split(b"stream")[0])}
    for n in roots:
        a.fact("pdf_start", "", n=[n])
    info = {int(v) for t in trailers for v in re.findall(rb"/Info\s+(\d+)", t)}
    for n, body in found.items():
        bare, stream = body.split(b"stream", 1)[0], b"stream" in body
        shown = bare.decode("latin-1")
        a.fact("pdf_object", shown[:100_000], n=[n, stream], name="ObjStm" if "/ObjStm" in shown else "XRef" if "/XRef" in shown else "")
        for v in set(re.findall(rb"(\d+)\s+\d+\s+R\b", bare)):
            a.fact("pdf_edge", n=[n, int(v)])
        if n in info:
            for key, value in re.findall(rb"/(\w+)\s*(" + STRING + rb")", bare):
                if said := literal(value).strip():
                    a.fact("meta", said, "document info", name=key.decode("latin-1"))
                    a.text(said, f"document info [{key.decode('latin-1')}]", True, "document property")
        for value in re.findall(rb"/JS\s*(" + STRING + rb")", bare):
            a.fact("pdf_js", literal(value), f"object {n}")
        for ref in re.findall(rb"/JS\s+(\d+)\s+\d+\s+R", bare):
            a.fact("pdf_js", unfiltered(a, found.get(int(ref), b"")).decode("latin-1"), f"object {n}")
        for value in re.findall(rb"/URI\s*(" + STRING + rb")", bare):
            a.fact("pdf_uri", literal(value))
        if re.search(rb"/Type\s*/Filespec", bare) and (file := re.search(rb"/EF\s*<<[^>]*?/U?F\s+(\d+)", bare)):
            m = re.search(rb"/U?F\s*(" + STRING + rb")", bare)
            name = literal(m[1]) if m else "attachment"
            data = unfiltered(a, found.get(int(file[1]), b""))
            a.found("MEDIUM", "Embedded file attachment", name, f"{len(data):,} bytes, scanned below.")
            a.child(name, data)
        if re.search(rb"/Subtype\s*/(Text|FreeText|Popup|Link|FileAttachment|Widget)", bare) and (flags := re.search(rb"/F\s+(\d+)", bare)):
            said = " ".join(literal(v) for v in re.findall(rb"/(?:Contents|V)\s*(" + STRING + rb")", bare))
            field = b"/Widget" in bare
            a.fact("pdf_annotation", said, f"object {n}", "field" if field else "annotation", n=[int(flags[1])])
        if re.search(rb"/Type\s*/Metadata", bare):
            told = unfiltered(a, body).decode("utf-8", "replace")
            a.fact("pdf_xmp", told, "XMP metadata")
            a.text(re.sub(r"<[^>]+>", " ", told), "XMP metadata", True)
        if re.search(rb"/Type\s*/OCProperties|/OCProperties", bare) and (off := re.search(rb"/OFF\s*\[([^\]]*)\]", bare)):
            for ref in re.findall(rb"(\d+)\s+\d+\s+R", off[1]):
                label = re.search(rb"/Name\s*(" + STRING + rb")", found.get(int(ref), b""))
                a.fact("pdf_layer_off", literal(label[1]) if label else f"object {int(ref)}")
    pages = page_texts(a, found)
    for k, items in enumerate(pages, 1):
        edges, spans = items[0][1:], []
        for z, item in enumerate(items[1:]):
            if item[0] == "span":
                _, text, x, y, size, mode, alpha, rgb = item
                spans.append(text)
                a.fact("pdf_span", text, f"Page {k}", n=[k, z, x, y - 0.2 * size, x + 0.5 * size * len(text), y + 0.8 * size, size, mode, alpha, *rgb, *edges])
            else:
                a.fact("pdf_" + item[0], "", f"Page {k}", n=[k, z, *item[1:6], *item[6]])
    if len(ends) > 1:
        a.fact("pdf_revisions", n=[len(ends)])
        final = {t.strip() for items in pages for i in items if i[0] == "span" for t in i[1].splitlines()}
        for t in sorted(final):
            a.fact("pdf_final_line", t)
        for k, stop in enumerate(ends[-7:-1], 1):
            for items in page_texts(a, objects_of(a, raw[:stop])):
                for i in items:
                    if i[0] == "span":
                        for t in i[1].splitlines():
                            a.fact("pdf_old_line", t.strip(), f"revision {k}")
