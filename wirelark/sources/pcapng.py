"""Block-structured capture files (pcapng): sections of either byte order, interfaces with clocks of their own.

A block holds its length at both ends, so a chain of blocks is found again in the middle of a file, in either
byte order. What a frame's time and link type mean stands in the interface blocks of its section, maybe far in
front of it: a walk over a range collects them, and `contexts` hands each range those that hold at its start.
"""

from __future__ import annotations

import json
import struct

SECTION, INTERFACE, OLD_PACKET, SIMPLE, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
SECTION_START = b"\x0a\x0d\x0d\x0a"
LONGEST = 1 << 24                # bytes of a block
CHAIN = 20


class Blocks:
    """One file; `at(place, size)` reads its bytes."""

    def __init__(self, at, length: int, damaged):
        self.at, self.length, self.damaged = at, length, damaged

    def _block(self, data: bytes, place: int, order: str) -> tuple[int, int, str]:
        """(type, length, byte order) of the block at a place of some bytes; length 0 if there is none."""
        kind, = struct.unpack_from(order + "I", data, place)
        if kind == SECTION and place + 12 <= len(data):
            order = {b"\x1a\x2b\x3c\x4d": ">", b"\x4d\x3c\x2b\x1a": "<"}.get(data[place + 8:place + 12], "")
            if not order:
                return kind, 0, "<"
        size, = struct.unpack_from(order + "I", data, place + 4)
        return kind, size if 12 <= size <= LONGEST and size % 4 == 0 else 0, order

    def _plausible(self, window: bytes, place: int, base: int, order: str) -> bool:
        for _ in range(CHAIN):
            if place + 12 > len(window):
                return base + place <= self.length
            _, size, order = self._block(window, place, order)
            if not size or base + place + size > self.length:
                return False
            if place + size > len(window):
                return True
            if struct.unpack_from(order + "I", window, place + size - 4)[0] != size:
                return False
            place += size
        return True

    def order_at(self, place: int) -> str | None:
        """The byte order in which blocks follow one another from here."""
        window = self.at(place, 1 << 20)
        return next((o for o in "<>" if len(window) >= 12 and self._plausible(window, 0, place, o)), None)

    def guess(self, start: int) -> int | None:
        """First place at or after `start` that looks like a block."""
        if start == 0:
            return 0
        start += -start % 4
        window = self.at(start, 4 << 20)
        for place in range(0, min(len(window) - 12, 2 << 20) + 1, 4):
            if any(self._plausible(window, place, start, o) for o in "<>"):
                return start + place
        return None

    def _blocks(self, start: int, stop: int, order: str, whole: bool, block: int = 8 << 20):
        """(place, length, type, byte order, bytes) of the blocks that begin in start..stop; the bytes of packets only if
        `whole`, so that a walk steps over them."""
        data, base, place = b"", start, start
        while place < stop and place + 12 <= self.length:
            if place + 12 > base + len(data):
                data, base = self.at(place, block if whole else 1 << 16), place
            kind, size, order = self._block(data, place - base, order)
            if not size or place + size > self.length:
                raise self.damaged(place)
            needed = whole or kind in (SECTION, INTERFACE)
            if needed and place + size > base + len(data):
                data, base = self.at(place, max(block if whole else 1 << 16, size)), place
            yield place, size, kind, order, data[place - base:place - base + size] if needed else b""
            place += size

    def walk(self, start: int, stop: int) -> tuple[int, int | None, str]:
        """(place of the first block at or past `stop`, place of any damage, what a reader further on has to know)."""
        known, place = [], start
        if start + 12 > self.length:                       # the last block began in a range before
            return start, None, "[]"
        order = self.order_at(start)
        if order is None:
            return start, start, "[]"
        try:
            for place, size, kind, order, body in self._blocks(start, stop, order, False):
                if kind == SECTION:
                    known.append(["section"])
                elif kind == INTERFACE:
                    known.append(list(interface(body, order)))
                place += size
        except self.damaged as damage:
            return damage.args[0], damage.args[0], json.dumps(known)
        return place, None, json.dumps(known)

    def frames(self, start: int, stop: int, interfaces: list):
        """(place, microseconds, link type, frame) of the packets in start..stop."""
        order = self.order_at(start)
        for place, _, kind, order, body in self._blocks(start, stop, order or "<", True):
            if kind == SECTION:
                interfaces = []
            elif kind == INTERFACE:
                interfaces = [*interfaces, list(interface(body, order))]
            elif kind in (PACKET, OLD_PACKET, SIMPLE):
                if kind == SIMPLE:
                    number, high, low, lead = 0, 0, 0, 12
                    whole, = struct.unpack_from(order + "I", body, 8)
                    kept = min(whole, len(body) - 16)
                else:
                    lead = 28
                    number, high, low, kept = struct.unpack_from(order + ("IIII" if kind == PACKET else "HxxIII"), body, 8)
                if number >= len(interfaces) or lead + kept > len(body) - 4:
                    raise self.damaged(place)
                linktype, units, offset = interfaces[number]
                yield place, offset * 10**6 + ((high << 32) | low) * 10**6 // units, linktype, body[lead:lead + kept]


def interface(body: bytes, order: str) -> tuple[int, int, int]:
    """(link type, units of its clock per second, seconds to add) of an interface block."""
    linktype, = struct.unpack_from(order + "H", body, 8)
    units, offset, place = 10**6, 0, 16
    while place + 4 <= len(body) - 4:
        code, size = struct.unpack_from(order + "HH", body, place)
        if code == 0:
            break
        value = body[place + 4:place + 4 + size]
        if code == 9 and size == 1:
            units = 2 ** (value[0] & 0x7F) if value[0] & 0x80 else 10 ** value[0]
        elif code == 14 and size == 8:
            offset, = struct.unpack(order + "q", value)
        place += 4 + size + -size % 4
    return linktype, units, offset


def contexts(walked: list[str | None]) -> list[str]:
    """For each range of a file, in order, the interfaces that hold at its start."""
    out, now = [], []
    for known in walked:
        out.append(json.dumps(now))
        for entry in json.loads(known or "[]"):
            now = [] if entry == ["section"] else [*now, entry]
    return out
