"""Old binary workbooks: the compound file they lie in, and the cells of their sheets.

A compound file is a small file system: sectors in chains that a table links, a
directory, and a stream of its own for short streams. The workbook is a stream
of records, of which those with cells and text are read here. Cells are numbers
or text, as they are stored; formats, formulas and drawings are passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quern.sources.statements import NotReadable

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
# Sector numbers from here on are marks, and the numbers of records.
END = 0xFFFFFFFA
BOF, EOF, SHEET, SST, CONTINUE, ENCRYPTED = 0x0809, 0x000A, 0x0085, 0x00FC, 0x003C, 0x002F
LABEL_SST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0x00FD, 0x0204, 0x0203, 0x027E, 0x00BD, 0x0006, 0x0207, 0x0205
BIFF8 = 0x0600

Cell = str | float


class _Compound:
    """The streams of a compound file by name."""

    def __init__(self, raw: bytes):
        if not raw.startswith(MAGIC) or len(raw) < 512:
            raise NotReadable("not a compound file")
        self.raw = raw
        shift, short_shift = struct.unpack_from("<HH", raw, 30)
        directory, _, self.cutoff, short_table, _, more, more_count = struct.unpack_from("<IIIIIII", raw, 48)
        if not 7 <= shift <= 16 or not 4 <= short_shift <= shift:
            raise NotReadable("sectors of no known size")
        self.size, self.short_size = 1 << shift, 1 << short_shift
        places = list(struct.unpack_from("<109I", raw, 76))
        for _ in range(more_count):
            if more >= END:
                break
            *listed, more = struct.unpack(f"<{self.size // 4}I", self._sector(more))
            places += listed
        self.next = [x for at in places if at < END for x in struct.unpack(f"<{self.size // 4}I", self._sector(at))]
        listed = self._chain(directory)
        self.entries = {}
        for at in range(0, len(listed) - 127, 128):
            entry = listed[at : at + 128]
            length, kind = struct.unpack_from("<HB", entry, 64)
            start, size = struct.unpack_from("<II", entry, 116)
            if kind:
                self.entries[entry[: max(0, length - 2)].decode("utf-16-le", "replace")] = (kind, start, size)
        root = next((e for e in self.entries.values() if e[0] == 5), None)
        self.short = self._chain(root[1]) if root and root[1] < END else b""
        table = self._chain(short_table) if short_table < END else b""
        self.short_next = struct.unpack(f"<{len(table) // 4}I", table)

    def _sector(self, at: int) -> bytes:
        start = (at + 1) * self.size
        if start >= len(self.raw):
            raise NotReadable("a sector lies outside of the file")
        return self.raw[start : start + self.size].ljust(self.size, b"\0")

    def _chain(self, at: int) -> bytes:
        out = []
        while at < END:
            if at >= len(self.next) or len(out) > len(self.next):
                raise NotReadable("a chain of sectors without an end")
            out.append(self._sector(at))
            at = self.next[at]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        if name not in self.entries:
            raise NotReadable(f"no stream {name}")
        _, at, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(at)[:size]
        out, steps = [], 0
        while at < END:
            if at >= len(self.short_next) or steps > len(self.short_next):
                raise NotReadable("a chain of sectors without an end")
            out.append(self.short[at * self.short_size : (at + 1) * self.short_size])
            at, steps = self.short_next[at], steps + 1
        return b"".join(out)[:size]


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(place, kind, content) of each record from a place on."""
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        yield at, kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Pieces:
    """Content that goes on in further records; text that does so says again how wide its letters are."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.k, self.at = pieces, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.k >= len(self.pieces):
                raise NotReadable("text ends before its length")
            got = self.pieces[self.k][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
            if len(out) < n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self, letters: int) -> str:
        """A string with its flags, of as many letters, without its fonts and readings."""
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = [], flags & 1
        while letters:
            if self.k < len(self.pieces) and self.at == len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            if self.k >= len(self.pieces):
                raise NotReadable("text ends before its length")
            n = min(letters, (len(self.pieces[self.k]) - self.at) >> wide)
            if not n:
                raise NotReadable("half a letter")
            out.append(self.take(n << wide).decode("utf-16-le" if wide else "latin-1", "replace"))
            letters -= n
        self.take(4 * runs + extra)
        return "".join(out)


def _packed_number(x: int) -> float:
    """A number in 30 bits: a whole one or the upper half of a double, maybe of hundredths."""
    value = float((x >> 2) - ((x >> 31) << 30)) if x & 2 else struct.unpack("<d", struct.pack("<II", 0, x & 0xFFFFFFFC))[0]
    return value / 100 if x & 1 else value


def _shared(stream: bytes) -> tuple[dict[str, int], list[str]]:
    """The sheets' names and places, and the texts that cells share."""
    sheets, pieces, open_ = {}, [], False
    for _, kind, body in _records(stream):
        open_ = kind == SST or open_ and kind == CONTINUE
        if open_:
            pieces.append(body)
        elif kind == BOF and struct.unpack_from("<H", body)[0] != BIFF8:
            raise NotReadable("a workbook of another version")
        elif kind == ENCRYPTED:
            raise NotReadable("an encrypted workbook")
        elif kind == SHEET and body[5] == 0:
            sheets[_Pieces([body[7:]]).text(body[6])] = struct.unpack_from("<I", body)[0]
        elif kind == EOF:
            break
    if not pieces:
        return sheets, []
    count, at = struct.unpack_from("<I", pieces[0], 4)[0], _Pieces(pieces)
    at.take(8)
    texts = []
    for _ in range(count):
        if at.k < len(at.pieces) and at.at == len(at.pieces[at.k]):
            at.k, at.at = at.k + 1, 0
        texts.append(at.text(struct.unpack("<H", at.take(2))[0]))
    return sheets, texts


def _cells(stream: bytes, at: int, texts: list[str]) -> Iterator[tuple[int, int, Cell]]:
    """(row, column, value) of a sheet's cells."""
    waiting = None
    for _, kind, body in _records(stream, at):
        if kind == EOF:
            return
        if kind == STRING and waiting is not None:
            yield *waiting, _Pieces([body[2:]]).text(struct.unpack_from("<H", body)[0])
            waiting = None
        elif kind in (LABEL_SST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
            row, column = struct.unpack_from("<HH", body)
            if kind == LABEL_SST:
                yield row, column, texts[struct.unpack_from("<I", body, 6)[0]]
            elif kind == LABEL:
                yield row, column, _Pieces([body[8:]]).text(struct.unpack_from("<H", body, 6)[0])
            elif kind == NUMBER:
                yield row, column, struct.unpack_from("<d", body, 6)[0]
            elif kind == RK:
                yield row, column, _packed_number(struct.unpack_from("<I", body, 6)[0])
            elif kind == MULRK:
                for k in range((len(body) - 6) // 6):
                    yield row, column + k, _packed_number(struct.unpack_from("<I", body, 6 + 6 * k)[0])
            elif kind == BOOLERR:
                yield row, column, float(body[6])
            elif body[12:14] != b"\xff\xff":
                yield row, column, struct.unpack_from("<d", body, 6)[0]
            elif body[6] == 0:
                waiting = (row, column)  # the text of a formula follows it
            elif body[6] in (1, 2):
                yield row, column, float(body[8])


def sheet_names(raw: bytes) -> list[str]:
    return list(_shared(_workbook(raw))[0])


def _workbook(raw: bytes) -> bytes:
    file = _Compound(raw)
    return file.stream("Workbook" if "Workbook" in file.entries else "Book")


def sheet_rows(raw: bytes, sheet: str | None = None) -> list[list[Cell]]:
    """A sheet's rows, the first one's if none is named; cells that are not there are empty text."""
    stream = _workbook(raw)
    try:
        sheets, texts = _shared(stream)
        if not sheets or sheet is not None and sheet not in sheets:
            raise NotReadable(f"no sheet {sheet or ''}".strip())
        rows: list[list[Cell]] = []
        for r, c, value in _cells(stream, sheets[sheet] if sheet is not None else next(iter(sheets.values())), texts):
            rows += [[] for _ in range(r + 1 - len(rows))]
            rows[r] += [""] * (c + 1 - len(rows[r]))
            rows[r][c] = value
        return rows
    except (struct.error, IndexError) as e:
        raise NotReadable(f"damaged workbook: {e}") from e
