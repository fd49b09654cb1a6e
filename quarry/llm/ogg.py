"""Media columns: Ogg streams in a binary column, verified, reassembled, demultiplexed and timed.

Each page's checksum (CRC-32, polynomial 0x04C11DB7, unreflected, over the page with the field zeroed) is
verified; a bad or torn page is dropped, and the search for the next capture pattern goes on behind
its first byte. Lacing values give the packets, which may run over pages; a packet that a lost page tears
is dropped and counted. Pages go by serial number to their logical stream. A granule position becomes
seconds by the codec that the first packet names: Opus (48 kHz less the pre-skip), Vorbis, Speex, FLAC (sample
rate), Theora (frames, key frame and offset), Skeleton and unknown codecs have none. It is the end of the last packet that its page completes; of the packets
before that on the page, Opus packets end where their own durations put them, those of other codecs are spread evenly since the page before.
Header packets have no time.

Defined results: a null cell gives no rows; very long cells are read whole; pages of one number count as they come (ties); an empty one, or one without a whole page, gives one row of null serial
and codec 'none' with its bytes counted as skipped; a null doc_id is kept as any row; repeated rows are each listed;
two links of a chain with one serial number are one stream; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_REV = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_ZERO = b"\0\0\0\0"
SCHEMA = "serial long, codec string, rate double, pages int, bad_pages int, gaps int, packets int, torn int, payload_bytes long, payload_md5 string, packet_s array<double>, first_s double, last_s double, ended boolean, skipped_bytes long"


def checksum(page: bytes) -> int:
    """The Ogg CRC, by the reflected CRC of the mirrored bytes."""
    c = zlib.crc32(page.translate(_REV), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REV), "big")


@dataclass
class Page:
    serial: int
    sequence: int
    granule: int  # -1 where no packet ends
    flags: int  # 1 goes on, 2 first, 4 last
    lacing: bytes
    body: bytes


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    done: list[tuple[int, int, bool]] = field(default_factory=list)  # of each page with a granule: packets so far, granule, whether pages before it are lost
    pages: int = 0
    gaps: int = 0
    torn: int = 0
    ended: bool = False
    held: list[bytes] | None = None
    next: int | None = None
    behind: bool = False  # in a packet already counted as torn
    lost: bool = False  # pages since the last granule

    def add(self, page: Page) -> None:
        lost = self.next is not None and page.sequence != self.next
        self.gaps += lost
        self.next = (page.sequence + 1) & 0xFFFFFFFF
        self.pages += 1
        goes_on = bool(page.flags & 1)
        broken = self.held is not None and (lost or not goes_on)
        if broken:
            self.held = None
        skip = goes_on and self.held is None  # the rest of a packet whose head is lost
        self.torn += broken or (skip and not self.behind)
        self.behind = skip and bool(page.lacing) and min(page.lacing) == 255
        at, size, first = 0, 0, True
        begin = 0
        for v in page.lacing:
            size += v
            at += v
            if v < 255:
                if not (first and skip):
                    self.packets.append(b"".join([*(self.held or []), page.body[begin:at]]))
                self.held, first = None, False
                begin, size = at, 0
        if page.lacing and page.lacing[-1] == 255 and not (first and skip):
            self.held = [*(self.held or []), page.body[begin:at]]
        self.lost |= lost
        if page.granule != -1:
            self.done.append((len(self.packets), page.granule, self.lost))
            self.lost = False
        self.ended |= bool(page.flags & 4)

    def close(self) -> None:
        if self.held is not None:
            self.torn, self.held = self.torn + 1, None


def pages(data: bytes) -> tuple[list[Page], int, int]:
    """Whole pages of right checksum, how many had a wrong one, and bytes that belong to no page."""
    out, bad, skipped, at = [], 0, 0, 0
    while at < len(data):
        to = data.find(b"OggS", at)
        if to < 0:
            return out, bad, skipped + len(data) - at
        skipped += to - at
        at = to
        if at + 27 <= len(data) and data[at + 4] == 0:
            n = data[at + 26]
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if len(lacing) == n and end <= len(data):
                flags, granule, serial, sequence, crc = struct.unpack_from("<BqIII", data, at + 5)
                if checksum(data[at : at + 22] + _ZERO + data[at + 26 : end]) == crc:
                    out.append(Page(serial, sequence, granule, flags, lacing, data[at + 27 + n : end]))
                    at = end
                    continue
                bad += 1
        skipped += 1
        at += 1
    return out, bad, skipped


def demultiplex(data: bytes) -> tuple[list[Stream], int, int]:
    found, bad, skipped = pages(data)
    streams: dict[int, Stream] = {}
    for p in found:
        streams.setdefault(p.serial, Stream(p.serial)).add(p)
    for s in streams.values():
        s.close()
    return list(streams.values()), bad, skipped


def codec(first: bytes) -> tuple[str, float, int, int]:
    """Name, granules a second, pre-skip, and the shift of key frames."""
    if first[:8] == b"OpusHead" and len(first) >= 12:
        return "opus", 48000.0, int.from_bytes(first[10:12], "little"), 0
    if first[:7] == b"\x01vorbis" and len(first) >= 16:
        return "vorbis", float(int.from_bytes(first[12:16], "little")), 0, 0
    if first[:8] == b"Speex   " and len(first) >= 40:
        return "speex", float(int.from_bytes(first[36:40], "little")), 0, 0
    if first[:5] == b"\x7fFLAC" and len(first) >= 30:
        return "flac", float(int.from_bytes(first[27:30], "big") >> 4), 0, 0
    if first[:7] == b"\x80theora" and len(first) >= 42:
        top, low = int.from_bytes(first[22:26], "big"), int.from_bytes(first[26:30], "big")
        return "theora", top / low if low else 0.0, 0, (int.from_bytes(first[40:42], "big") >> 5) & 31
    if first[:8] == b"fishead\0":
        return "skeleton", 0.0, 0, 0
    return "unknown", 0.0, 0, 0


def seconds(granule: int, rate: float, preskip: int, shift: int) -> float | None:
    if rate <= 0:
        return None
    if shift:
        granule = (granule >> shift) + (granule & ((1 << shift) - 1))
    return max(0, granule - preskip) / rate


def opus_samples(packet: bytes) -> int:
    """The duration that a packet's first bytes tell, at 48 kHz; 0 for a broken one."""
    if not packet:
        return 0
    config, code = packet[0] >> 3, packet[0] & 3
    each = (480, 960, 1920, 2880)[config & 3] if config < 12 else (480, 960)[config & 1] if config < 16 else (120, 240, 480, 960)[config & 3]
    return each * ((packet[1] & 63 if len(packet) > 1 else 0) if code == 3 else (1, 2, 2)[code])


def times(s: Stream, name: str, headers: int, rate: float, preskip: int, shift: int) -> list[float | None]:
    """When each packet after the headers ends, in seconds; none where nothing tells."""
    out: list[float | None] = [None] * len(s.packets)
    begin, before = headers, 0
    for end, granule, lost in s.done:
        fresh = range(max(begin, headers), end)
        if fresh and name == "opus":
            at = granule
            for k in reversed(fresh):
                out[k] = seconds(at, rate, preskip, shift)
                at -= opus_samples(s.packets[k])
        elif fresh:
            last = seconds(granule, rate, preskip, shift)
            first = seconds(before, rate, preskip, shift)
            for n, k in enumerate(fresh, 1):
                out[k] = None if last is None or (lost and n < len(fresh)) else last - (last - first) * (len(fresh) - n) / len(fresh)
        begin, before = max(begin, end), granule
    return out[headers:]


def rows(data: bytes) -> list[tuple]:
    """A row a logical stream, as in ``SCHEMA``. The payload is all packets but the codec's headers."""
    streams, bad, skipped = demultiplex(data)
    if not streams:
        return [(None, "none", None, 0, bad, 0, 0, 0, 0, None, None, None, None, False, skipped)]
    out = []
    for s in streams:
        name, rate, preskip, shift = codec(s.packets[0] if s.packets else b"")
        headers = {"opus": 2, "speex": 2, "vorbis": 3, "theora": 3}.get(name, 1 if name in ("flac", "skeleton") else 0)
        payload = s.packets[headers:]
        digest = hashlib.md5()
        for p in payload:
            digest.update(p)
        ends = times(s, name, headers, rate, preskip, shift)
        told = [t for t in ends if t is not None]
        out.append((s.serial, name, rate or None, s.pages, bad, s.gaps, len(payload), s.torn, sum(map(len, payload)), digest.hexdigest(), ends, min(told, default=None), max(told, default=None), s.ended, skipped))
    return out


def probe(table: DataFrame, media: str = "media") -> DataFrame:
    """doc_id and ``SCHEMA``: the logical streams of each cell of the binary column ``media``."""

    def run(batches):
        for b in batches:
            got = [(d, *r) for d, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True) if m is not None for r in rows(m)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema)

    kind = table.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    full = StructType([StructField("doc_id", kind), *_parse_datatype_string(SCHEMA).fields])
    schema = to_arrow_schema(full)
    return table.select("doc_id", table[media].alias("media")).mapInArrow(run, full)


def write_page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = b"OggS\0" + struct.pack("<BqII", flags, granule, serial, sequence)
    tail = bytes([len(lacing)]) + lacing + body
    return head + struct.pack("<I", checksum(head + _ZERO + tail)) + tail


def write_stream(serial: int, packets: list[bytes], granules: list[int], headers: int, page_bytes: int = 4096) -> list[bytes]:
    """Pages of one logical stream; ``granules``: that at the end of each packet. The first packet has a page of its own."""
    out: list[bytes] = []
    lacing, body, size, ends, goes_on = bytearray(), [], 0, -1, False

    def flush(last: bool, more: bool) -> None:
        nonlocal lacing, body, size, ends, goes_on
        out.append(write_page(serial, len(out), ends, goes_on | (2 if not out else 0) | (4 if last else 0), bytes(lacing), b"".join(body)))
        lacing, body, size, ends, goes_on = bytearray(), [], 0, -1, more

    for k, (p, g) in enumerate(zip(packets, granules, strict=True)):
        at = 0
        values = [255] * (len(p) // 255) + [len(p) % 255]
        for i, v in enumerate(values):
            if len(lacing) == 255 or size >= page_bytes:
                flush(False, i > 0)
            lacing.append(v)
            body.append(p[at : at + v])
            at, size = at + v, size + v
        ends = g
        if k == len(packets) - 1 or k == 0 or k == headers - 1:
            flush(k == len(packets) - 1, False)
    return out


def opus(serial: int, lines: list[bytes]) -> list[bytes]:
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48000, 0, 0)
    packets = [head, b"OpusTags" + struct.pack("<II", 0, 0), *(b"\xf8" + x for x in lines)]  # one frame of 20 ms
    return write_stream(serial, packets, [0, 0, *(312 + 960 * (k + 1) for k in range(len(lines)))], 2)


def vorbis(serial: int, parts: list[bytes], rate: int = 44100) -> list[bytes]:
    head = b"\x01vorbis" + struct.pack("<IBIiiiBB", 0, 1, rate, 0, 0, 0, 0xB8, 1)
    packets = [head, b"\x03vorbis", b"\x05vorbis", *parts]
    return write_stream(serial, packets, [0, 0, 0, *(1024 * (k + 1) for k in range(len(parts)))], 3)


def multiplex(*streams: list[bytes]) -> bytes:
    """First pages first, as the format asks; then the streams in turn."""
    out = [s[0] for s in streams]
    for k in range(1, max(map(len, streams))):
        out += [s[k] for s in streams if k < len(s)]
    return b"".join(out)


def from_documents(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an Ogg file of two streams, its lines as Opus packets (behind a byte that tells 20 ms) and its words' lengths, 64 a packet, as Vorbis packets.

    No table has a media column; this makes one of every whole text.
    """

    def run(batches):
        for b in batches:
            media = []
            for t in b.column("text").to_pylist():
                if t is None:
                    media.append(None)
                    continue
                lines = t.encode().split(b"\n")
                sizes = bytes(min(255, len(w)) for w in t.encode().split(b" "))
                media.append(multiplex(opus(1, lines), vorbis(2, [sizes[k : k + 64] for k in range(0, len(sizes), 64)])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary")
