"""Whether JPEG data is whole: every segment, table and coded coefficient is read, none is transformed.

Baseline, extended and progressive frames with Huffman coding, eight bits a sample. A page is read in one pass over its bytes; beside them, a
progressive frame keeps one number a block.
"""

from __future__ import annotations

import struct

#: Bits that a code is looked up by: the longest that there are.
_BITS = 16


class BadImage(ValueError):
    """What the data has against being an image."""


class _Bits:
    """Bits of one stretch between markers, stuffed zeros taken out; reading on beyond the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def _more(self) -> None:
        some = self.data[self.at : self.at + 6]
        self.at += 6
        self.held = (self.held & ((1 << self.n) - 1)) << 48 | int.from_bytes(some.ljust(6, b"\xff"), "big")
        self.n += 48

    def take(self, n: int) -> int:
        if self.n < n:
            self._more()
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def take_many(self, n: int) -> None:
        while n > 0:
            self.take(min(n, 32))
            n -= 32

    def symbol(self, table: list[int]) -> int:
        if self.n < _BITS:
            self._more()
        found = table[self.held >> (self.n - _BITS) & 0xFFFF]
        if not found:
            raise BadImage("a code that no table has")
        self.n -= found >> 8
        return found & 0xFF

    def over(self) -> bool:
        """Whether more has been read than there is."""
        return self.at * 8 - self.n > len(self.data) * 8


def _table(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits, the length of the code that they begin with and its symbol; 0 for none."""
    out, code, at = [0] * (1 << _BITS), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >= 1 << length:
                raise BadImage("a table of too many codes")
            low = code << (_BITS - length)
            out[low : low + (1 << (_BITS - length))] = [length << 8 | symbols[at]] * (1 << (_BITS - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Part:
    """A component: its sampling, its blocks in a frame, and of each which coefficients are not zero."""

    def __init__(self, number: int, across: int, down: int, quantiser: int):
        self.number, self.across, self.down, self.quantiser = number, across, down, quantiser
        self.seen = False


class _Frame:
    def __init__(self, kind: int, body: bytes):
        if len(body) < 6 or len(body) != 6 + 3 * body[5] or not 1 <= body[5] <= 4:
            raise BadImage("broken frame")
        bits, self.height, self.width = struct.unpack_from(">BHH", body)
        if bits != 8 or not self.width or not self.height:
            raise BadImage("unsupported frame")
        self.progressive = kind == 0xC2
        self.parts = [_Part(n, hv >> 4, hv & 15, q) for n, hv, q in zip(body[6::3], body[7::3], body[8::3], strict=True)]
        if any(not 1 <= p.across <= 4 or not 1 <= p.down <= 4 for p in self.parts) or len({p.number for p in self.parts}) < len(self.parts):
            raise BadImage("broken frame")
        most_across, most_down = max(p.across for p in self.parts), max(p.down for p in self.parts)
        self.columns, self.rows = -(-self.width // (8 * most_across)), -(-self.height // (8 * most_down))
        for p in self.parts:
            p.own = -(-(-(-self.width * p.across // most_across)) // 8), -(-(-(-self.height * p.down // most_down)) // 8)
            p.stride = self.columns * p.across
            p.masks = [0] * (p.stride * self.rows * p.down) if self.progressive else []

    def places(self, parts: list[_Part]):
        """Lists of (component, block) that one unit of a scan holds, in order."""
        if len(parts) == 1:
            (p,) = parts
            for y in range(p.own[1]):
                for x in range(p.own[0]):
                    yield [(p, y * p.stride + x)]
        else:
            for y in range(self.rows):
                for x in range(self.columns):
                    yield [(p, (y * p.down + v) * p.stride + x * p.across + h) for p in parts for v in range(p.down) for h in range(p.across)]


def _whole_block(bits: _Bits, dc: list[int], ac: list[int]) -> None:
    """A block of a sequential scan."""
    size = bits.symbol(dc)
    if size > 16:
        raise BadImage("a difference too large")
    bits.take(size)
    k = 1
    while k < 64:
        code = bits.symbol(ac)
        if not code & 15:
            if code != 0xF0:
                return
            k += 16
            continue
        k += code >> 4
        if k > 63:
            break
        bits.take(code & 15)
        k += 1
    if k > 64:
        raise BadImage("a block of too many coefficients")


def _first_pass(bits: _Bits, ac: list[int], start: int, end: int) -> tuple[int, int]:
    """(mask of the coefficients told of, blocks after this one that end at once) in a band's first scan."""
    k, mask = start, 0
    while k <= end:
        code = bits.symbol(ac)
        run, size = code >> 4, code & 15
        if not size:
            if run < 15:
                return mask, (1 << run) - 1 + bits.take(run)
            k += 16
            continue
        k += run
        if k > end:
            raise BadImage("a block of too many coefficients")
        bits.take(size)
        mask |= 1 << k
        k += 1
    if k > end + 1:
        raise BadImage("a block of too many coefficients")
    return mask, 0


def _later_pass(bits: _Bits, ac: list[int], start: int, end: int, mask: int) -> tuple[int, int]:
    """The same of a scan that refines: a bit for each coefficient that is told of already, wherever it is passed."""
    k, new = start, 0
    while k <= end:
        code = bits.symbol(ac)
        run, size = code >> 4, code & 15
        if size > 1:
            raise BadImage("a refinement of several bits")
        if size:
            bits.take(1)
        elif run < 15:
            blocks = (1 << run) - 1 + bits.take(run)
            bits.take_many((mask >> k & ((1 << (end - k + 1)) - 1)).bit_count())
            return mask | new, blocks
        while k <= end:
            if mask >> k & 1:
                bits.take(1)
            elif run:
                run -= 1
            else:
                break
            k += 1
        if size:
            if k > end:
                raise BadImage("a block of too many coefficients")
            new |= 1 << k
        k += 1
    return mask | new, 0


def _scan(frame: _Frame, body: bytes, stretches: list[bytes], tables: dict[tuple[int, int], list[int]], every: int) -> None:
    n = body[0] if body else 0
    if not 1 <= n <= 4 or len(body) != 4 + 2 * n:
        raise BadImage("broken scan")
    by = {p.number: p for p in frame.parts}
    chosen = [(by.get(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
    start, end, high, low = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
    if any(p is None for p, _, _ in chosen):
        raise BadImage("a scan of what the frame hasn't got")
    if not frame.progressive:
        start, end, high = 0, 63, 0
    elif start > end or end > 63 or (start == 0) != (end == 0) or (start and n > 1) or low > 13:
        raise BadImage("broken scan")
    use = {}
    for p, dc, ac in chosen:
        need = ([(0, dc)] if start == 0 and not high else []) + ([(1, ac)] if end else [])
        if any(t not in tables for t in need):
            raise BadImage("a table is missing")
        use[p.number] = tables.get((0, dc)), tables.get((1, ac))
        p.seen |= start == 0
    units = frame.places([p for p, _, _ in chosen])
    left = 0  # units before the next stretch
    ahead, blocks, bits = iter(stretches), 0, None
    for unit in units:
        if left == 0:
            if bits is not None and bits.over():
                raise BadImage("data ends early")
            stretch = next(ahead, None)
            if stretch is None:
                raise BadImage("data ends early")
            bits, left, blocks = _Bits(stretch), every or -1, 0
        left -= 1
        for p, at in unit:
            dc, ac = use[p.number]
            if not frame.progressive:
                _whole_block(bits, dc, ac)
            elif start == 0:
                size = 1 if high else bits.symbol(dc)
                if size > 16:
                    raise BadImage("a difference too large")
                bits.take(size)
            elif blocks:
                blocks -= 1
                if high:
                    bits.take_many((p.masks[at] >> start & ((1 << (end - start + 1)) - 1)).bit_count())
            elif high:
                p.masks[at], blocks = _later_pass(bits, ac, start, end, p.masks[at])
            else:
                told, blocks = _first_pass(bits, ac, start, end)
                p.masks[at] |= told
        if bits.at > len(bits.data) + 12:
            raise BadImage("data ends early")
    if bits.over():
        raise BadImage("data ends early")


def _stretches(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The coded data from `at` on, parted at restart markers, and where the marker after it stands (the end, if there is none)."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        follows = data[at + 1]
        if follows == 0:
            at += 2
        elif 0xD0 <= follows <= 0xD7:
            out.append(data[start:at])
            start = at = at + 2
        elif follows == 0xFF:
            at += 1
        else:
            return [*out, data[start:at]], at


def size_of(data: bytes, most: int) -> tuple[int, int]:
    """(width, height) of an image whose data is whole; of one with more than `most` pixels, nothing beyond the frame is read."""
    frame, tables, quantisers, every, at, ended = None, {}, set(), 0, 2, False
    while at < len(data):
        if data[at] != 0xFF:
            raise BadImage("no marker where one must be")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at == len(data):
            break
        marker, at = data[at], at + 1
        if marker == 0xD9:
            ended = True
            break
        if marker == 1 or 0xD0 <= marker <= 0xD8:
            continue
        n = struct.unpack_from(">H", data, at)[0] if at + 2 <= len(data) else 0
        if n < 2 or at + n > len(data):
            raise BadImage("broken segment")
        body, at = data[at + 2 : at + n], at + n
        if marker == 0xDB:
            while body:
                length = 1 + 64 * (1 + (body[0] >> 4))
                if body[0] >> 4 > 1 or body[0] & 15 > 3 or len(body) < length:
                    raise BadImage("broken quantisation table")
                quantisers.add(body[0] & 15)
                body = body[length:]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                if body[0] >> 4 > 1 or body[0] & 15 > 3 or len(body) < 17 + sum(counts):
                    raise BadImage("broken code table")
                tables[body[0] >> 4, body[0] & 15] = _table(counts, body[17 : 17 + sum(counts)])
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            if len(body) != 2:
                raise BadImage("broken restart interval")
            every = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC2):
            if frame is not None:
                raise BadImage("two frames")
            frame = _Frame(marker, body) if len(body) > 5 and struct.unpack_from(">H", body, 1)[0] * struct.unpack_from(">H", body, 3)[0] <= most else None
            if frame is None:
                raise BadImage("too large" if len(body) > 5 else "broken frame")
        elif 0xC3 <= marker <= 0xCF and marker != 0xC8:
            raise BadImage("unsupported frame")
        elif marker == 0xDA:
            if frame is None:
                raise BadImage("no frame")
            if any(p.quantiser not in quantisers for p in frame.parts):
                raise BadImage("a quantisation table is missing")
            stretches, at = _stretches(data, at)
            _scan(frame, body, stretches, tables, every)
    if frame is None:
        raise BadImage("no frame")
    if not all(p.seen for p in frame.parts):
        raise BadImage("no data")
    if frame.progressive and not ended:  # another scan may have been cut off
        raise BadImage("no end")
    return frame.width, frame.height
