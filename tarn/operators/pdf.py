"""Text of PDF files with the standard library alone: page order, plain and Flate streams, simple and Unicode-mapped fonts.

Not read: encrypted files (an error), other stream filters (such a page is unreadable), and text that is an image (a warning).
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
REF = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
TOKEN = re.compile(rb"\[|\]|<<|>>|<[0-9A-Fa-f\s]*>|\(|/[^\s<>\[\]()/%]*|[-+.\d]+|[A-Za-z'\"*]+[0-9]*|%[^\r\n]*")


class Encrypted(ValueError):
    pass


class Unreadable(ValueError):
    pass


def inflate(data: bytes, most: int) -> bytes:
    """A Flate stream of at most ``most`` bytes of output."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most)
    except zlib.error as e:
        raise Unreadable(str(e)) from None
    if d.unconsumed_tail:
        raise Unreadable("stream is too large")
    return out


class Pdf:
    """Objects of a file by number; the last definition counts. Object streams are opened."""

    def __init__(self, data: bytes, most: int = 64 << 20):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF header")
        self.most, self.objects = most, {}
        for m in OBJECT.finditer(data):
            end = data.find(b"endobj", m.end())
            self.objects[int(m[1])] = data[m.end() : end if end >= 0 else len(data)]
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise Encrypted("the document is encrypted")
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._open(body)

    def _open(self, body: bytes) -> None:
        try:
            inner = self.stream(body)
        except Unreadable:
            return
        n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
        head = [int(x) for x in inner[:first].split()[: 2 * n]]
        at = [*head[1::2], len(inner) - first]
        for i, number in enumerate(head[::2]):
            self.objects.setdefault(number, inner[first + at[i] : first + at[i + 1]])

    def get(self, body: bytes, key: bytes) -> bytes:
        """The value of a key in an object's dictionary, references followed."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if r := REF.match(rest):
            return self.objects.get(int(r[1]), b"")
        return rest

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return b""
        end = body.rfind(b"endstream")
        data = body[m.end() : end if end >= 0 else len(body)]
        names = re.findall(rb"/(\w+Decode)\b", body[: m.start()])
        if not names:
            return data.rstrip(b"\r\n")
        if names != [b"FlateDecode"]:
            raise Unreadable(f"filter {names[0].decode()}")
        return inflate(data, self.most)

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        top, out, seen = self.get(root, b"Pages"), [], set()
        todo = [top] if top else []
        while todo:
            node = todo.pop()
            if re.search(rb"/Type\s*/Page(?!s)", node):
                out.append(node)
                continue
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", node)
            numbers = [int(r[0]) for r in REF.findall(kids[1])] if kids else []
            fresh = [n for n in numbers if n not in seen]
            seen.update(fresh)
            todo += [self.objects[n] for n in reversed(fresh) if n in self.objects]
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page(?!s)", b)]

    def maps(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """Unicode maps of a page's fonts by name."""
        resources = self.get(page, b"Resources") or self.get(self.get(page, b"Parent"), b"Resources")
        fonts = self.get(resources, b"Font")
        fonts = fonts[: fonts.find(b">>") + 2] if fonts else b""
        out = {}
        for name, number, _ in re.findall(rb"/([^\s/]+)\s+(\d+)\s+(\d+)\s+R", fonts):
            font = self.objects.get(int(number), b"")
            if mapped := self.get(font, b"ToUnicode"):
                out[name] = cmap(self.stream(mapped))
        return out

    def text(self, page: bytes) -> str:
        """What a page's text operators show; a new line for each move to another one."""
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        numbers = [int(r[0]) for r in REF.findall(contents[1])] if contents else []
        bodies = []
        for n in numbers:
            own = self.objects.get(n, b"")
            # a reference to an array of streams
            inner = own.strip()
            bodies += [self.objects.get(int(r[0]), b"") for r in REF.findall(inner)] if inner.startswith(b"[") else [own]
        return shown(b"\n".join(self.stream(b) for b in bodies), self.maps(page))


def cmap(data: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first, start = text(c), int(a, 16)
            for i in range(min(int(b, 16) - start + 1, 1 << 16)):
                out[start + i] = first[:-1] + chr(ord(first[-1]) + i)
    return out


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """(a string in parentheses that starts at ``at``, where it ends)."""
    out, depth, i = bytearray(), 1, at + 1
    while i < len(data) and depth:
        c = data[i : i + 1]
        if c == b"\\":
            n = data[i + 1 : i + 2]
            if n in ESCAPES:
                out += ESCAPES[n]
            elif m := re.match(rb"[0-7]{1,3}", data[i + 1 : i + 4]):
                out.append(int(m[0], 8) & 255)
                i += len(m[0]) - 1
            elif n not in b"\r\n":
                out += n
            i += 2
            continue
        depth += (c == b"(") - (c == b")")
        if depth:
            out += c
        i += 1
    return bytes(out), i


def decode(raw: bytes, mapped: dict[int, str] | None) -> str:
    if mapped:
        width = 2 if max(mapped) > 255 or (len(raw) % 2 == 0 and raw[:1] == b"\0") else 1
        codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
        return "".join(mapped.get(c, "") for c in codes)
    if raw.startswith(b"\xfe\xff"):
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def shown(data: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The text that a content stream shows."""
    out: list[str] = []
    stack: list = []
    font, i = None, 0
    while m := TOKEN.search(data, i):
        token, i = m[0], m.end()
        if token == b"(":
            raw, i = literal(data, m.start())
            stack.append(raw)
        elif token[:1] == b"<" and token != b"<<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            stack.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()))
        elif token[:1] in b"/[]<>%" or token[0] in b"+-.0123456789":
            if token[:1] != b"%":
                stack.append(token.decode("latin-1"))
        else:
            if token == b"Tf":
                names = [x for x in stack if isinstance(x, str) and x.startswith("/")]
                font = fonts.get(names[-1][1:].encode("latin-1")) if names else None
            elif token in (b"Tj", b"'", b'"', b"TJ"):
                if token in (b"'", b'"'):
                    out.append("\n")
                for x in stack:
                    if isinstance(x, bytes):
                        out.append(decode(x, font))
                    elif token == b"TJ" and re.fullmatch(r"-\d{3,}(\.\d*)?", x):
                        out.append(" ")  # a wide gap between two pieces
            elif token in (b"Td", b"TD"):
                numbers = [x for x in stack if isinstance(x, str)]
                out.append("\n" if len(numbers) >= 2 and float(numbers[-1] or 0) != 0 else " ")
            elif token in (b"T*", b"Tm", b"ET"):
                out.append("\n")
            stack = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")
