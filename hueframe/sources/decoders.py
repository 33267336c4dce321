"""PNG and TIFF files as arrays, decoded by what their headers say; a task decodes one image at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The limits on an image's size, PNG's signature, its passes of interlacing (first x and y, steps of x and y), channels by colour type.
MAX_SIDE, MAX_PIXELS = 16_384, 100_000_000
PNG = b"\x89PNG\r\n\x1a\n"
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def check_size(width: int, height: int) -> None:
    if width < 1 or height < 1 or max(width, height) > MAX_SIDE or width * height > MAX_PIXELS:
        raise ValueError(f"{width} x {height} is outside 1 to {MAX_SIDE} a side and {MAX_PIXELS} pixels")


def dimensions(raw: bytes) -> tuple[int, int]:
    """Width and height from the header alone."""
    if raw[:8] == PNG:
        return struct.unpack(">II", raw[16:24])
    tags = _tiff_tags(raw)
    return tags[256][0], tags[257][0]


def decode(raw: bytes) -> np.ndarray:
    """(height, width, 3) doubles, 0 to 1 for integer samples; grey is repeated, alpha dropped, palettes looked up."""
    width, height = dimensions(raw)
    check_size(width, height)
    out = _png(raw, width, height) if raw[:8] == PNG else _tiff(raw, width, height)
    return np.repeat(out[:, :, :1], 3, axis=2) if out.shape[2] < 3 else out[:, :, :3]


def _samples(lines: np.ndarray, width: int, channels: int, bits: int, order: str = ">") -> np.ndarray:
    """Integers (height, width, channels) from lines of bytes, in which samples of under 8 bits are packed, the first highest."""
    if bits >= 8:
        return np.ascontiguousarray(lines).view(f"{order}u{bits // 8}").reshape(len(lines), width, channels)
    each = np.unpackbits(lines, axis=1).reshape(len(lines), -1, bits)[:, : width * channels]
    return (each @ (1 << np.arange(bits - 1, -1, -1))).reshape(len(lines), width, channels)


# ---- PNG


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Lines of bytes from lines behind their filter bytes; `step` bytes are a pixel.

    Pixels on one antidiagonal depend on earlier ones only, so that all of them are done at once.
    """
    height, size = rows.shape[0], rows.shape[1] - 1
    kinds = rows[:, 0]
    if kinds.max(initial=0) > 4:
        raise ValueError("a line of a PNG has an unknown filter")
    if kinds.max(initial=0) < 3:
        out, above = np.empty((height, size), np.uint8), np.zeros(size, np.uint8)
        for y in range(height):
            line = rows[y, 1:]
            if kinds[y] == 1:
                line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
            above = out[y] = line + above if kinds[y] == 2 else line
        return out
    width = size // step
    # A line above and a pixel to the left, both zero.
    full = np.zeros((height + 1, width + 1, step), np.uint8)
    full[1:, 1:] = rows[:, 1:].reshape(height, width, step)
    flat, stride = full.reshape(-1, step), width + 1
    for t in range(width + height - 1):
        top, bottom = max(0, t - width + 1), min(height, t + 1)
        first = (top + 1) * stride + t - top + 1
        ends = [slice(first - back, first - back + (bottom - top - 1) * width + 1, width) for back in (0, 1, stride, stride + 1)]
        left, up, corner = (flat[e].astype(np.int16) for e in ends[1:])
        kind = kinds[top:bottom, None]
        p, q, r = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        paeth = np.where((p <= q) & (p <= r), left, np.where(q <= r, up, corner))
        guess = np.where(kind == 4, paeth, np.where(kind == 3, (left + up) >> 1, np.where(kind == 2, up, np.where(kind == 1, left, 0))))
        flat[ends[0]] += guess.astype(np.uint8)
    return full[1:, 1:].reshape(height, size)


def _png(raw: bytes, width: int, height: int) -> np.ndarray:
    bits, kind, _, _, interlaced = raw[24:29]
    channels = PNG_CHANNELS.get(kind)
    if channels is None or bits not in (1, 2, 4, 8, 16) or interlaced > 1:
        raise ValueError("a PNG of an unknown kind")
    at, parts, palette = 8, [], b""
    while at < len(raw):
        (size,), name = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        if name == b"IDAT":
            parts.append(raw[at + 8 : at + 8 + size])
        elif name == b"PLTE":
            palette = raw[at + 8 : at + 8 + size]
        at += size + 12
    data, at = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8), 0
    out = np.zeros((height, width, channels), np.uint16 if bits == 16 else np.uint8)
    for x0, y0, dx, dy in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w > 0 and h > 0:
            size = -(-w * channels * bits // 8) + 1
            lines = _unfilter(data[at : at + h * size].reshape(h, size), max(1, channels * bits // 8))
            out[y0::dy, x0::dx] = _samples(lines, w, channels, bits)
            at += h * size
    if kind == 3:
        return _looked_up(np.frombuffer(palette, np.uint8).reshape(-1, 3) / 255.0, out[:, :, 0])
    return out / (2.0**bits - 1)


def _looked_up(colours: np.ndarray, places: np.ndarray) -> np.ndarray:
    if places.max(initial=0) >= len(colours):
        raise ValueError("a pixel is outside the palette")
    return colours[places]


# ---- TIFF


def _tiff_tags(raw: bytes) -> dict[int, tuple]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or struct.unpack(order + "H", raw[2:4])[0] != 42:
        raise ValueError("neither PNG nor TIFF")
    (at,) = struct.unpack(order + "I", raw[4:8])
    (n,) = struct.unpack(order + "H", raw[at : at + 2])
    tags: dict[int, tuple] = {0: (order,)}
    for i in range(n):
        tag, kind, count, _ = struct.unpack(order + "HHII", raw[at + 2 + 12 * i : at + 14 + 12 * i])
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code:
            size, place = struct.calcsize(code) * count, at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack(order + "I", raw[place : place + 4])
            tags[tag] = struct.unpack(order + code * count, raw[place : place + size])
    return tags


def _packbits(body: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(body):
        n = body[at]
        if n < 128:
            out += body[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += body[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _lzw(body: bytes) -> bytes:
    """Strings of codes of 9 to 12 bits, highest bit first; 256 clears the table and 257 ends. Codes widen one entry early."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, before, bits, have, held, out = first.copy(), b"", 9, 0, 0, []
    for byte in body:
        held, have = (held << 8 | byte) & 0xFFFFFF, have + 8
        if have < bits:
            continue
        have -= bits
        code = held >> have & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, before, bits = first.copy(), b"", 9
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise ValueError("an LZW code is out of reach")
        out.append(now)
        if before:
            table.append(before + now[:1])
        before, bits = now, min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


# TIFF's kinds of compression.
UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def _tiff(raw: bytes, width: int, height: int) -> np.ndarray:
    """Strips or tiles, samples side by side or in planes of their own, differences along lines undone."""
    tags = _tiff_tags(raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    order, bits, channels, packing, predictor, light = tags[0][0], one(258, 1), one(277, 1), one(259, 1), one(317, 1), one(262, 1)
    real, planes = one(339, 1) == 3, channels if one(284, 1) == 2 else 1
    if packing not in UNPACK or bits not in ((32,) if real else (1, 2, 4, 8, 16)) or len(set(tags.get(258, (bits,)))) > 1 or predictor not in (1, 2, 3) or light not in (0, 1, 2, 3):
        raise ValueError(f"a TIFF of {bits} bits, compression {packing}, predictor {predictor} and colours {light} isn't read here")
    if (predictor == 2 and (real or bits < 8)) or (predictor == 3 and not real):
        raise ValueError(f"predictor {predictor} doesn't go with these samples")
    each = channels // planes
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(one(278, height), height))
    starts, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // w), -(-height // h)
    out = np.zeros((height, width, channels), np.float32 if real else np.uint16)
    size = -(-w * each * bits // 8)
    for i, (start, n) in enumerate(zip(starts, sizes)):
        plane, place = divmod(i, across * down)
        y, x = place // across * h, place % across * w
        lines = h if tiled else min(h, height - y)
        body = np.frombuffer(UNPACK[packing](raw[start : start + n]), np.uint8, lines * size).reshape(lines, size)
        if real and predictor == 3:
            # Bytes of a line stand highest first, each kind together, as differences.
            summed = np.cumsum(body.reshape(lines, -1, each), axis=1, dtype=np.uint8).reshape(lines, 4, -1)
            values = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(">f4").reshape(lines, w, each)
        elif real:
            values = body.view(order + "f4").reshape(lines, w, each)
        else:
            values = _samples(body, w, each, bits, order)
            if predictor == 2:
                values = np.cumsum(values, axis=1, dtype=np.uint8 if bits == 8 else np.uint16)
        out[y : y + lines, x : x + w, plane * each : (plane + 1) * each] = values[: height - y, : width - x]
    if light == 3:
        return _looked_up(np.array(tags[320]).reshape(3, -1).T / 65535.0, out[:, :, 0])
    scaled = out / (1.0 if real else 2.0**bits - 1)
    return 1.0 - scaled if light == 0 else scaled
