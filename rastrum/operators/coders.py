"""Entropy coders for one group of symbols, in Python with NumPy where the work isn't sequential.

`tans`: a table-driven asymmetric numeral system; `rans`: its range variant with eight
interleaved states; `huffman`: canonical prefix codes with an escape.  Each encoder
returns bytes that its decoder needs nothing else for.  What other engines gain by
several interleaved states is gained by groups here.
"""

from __future__ import annotations

import struct

import numpy as np

from rastrum.operators.codebook import chosen, code_lengths
from rastrum.operators.stats import BASE_LOG, LEAST_LOG, MOST_LOG, ROUND_UP


class NotCompressible(ValueError):
    """Raised where a stream has one symbol only, or counts too even to gain by; callers store it another way."""


def table_log(n: int, sym_len: int) -> int:
    source = (n - 1).bit_length() - 3
    least = min((n - 1).bit_length(), (sym_len - 1).bit_length() + 1)
    log, density = max(min(BASE_LOG, source), least), n // sym_len
    if sym_len > 512 and density > 16 and log < 13:
        log = 13
    elif log < 12 and (density > 64 and sym_len > 256 or density > 32 and sym_len > 128):
        log = 12
    return min(max(min(log, source), LEAST_LOG), MOST_LOG)


def normalized(counts: np.ndarray, log: int) -> np.ndarray:
    """Counts by symbol scaled to 2**log; used but rare symbols get -1."""
    n, size, used = int(counts.sum()), 1 << log, np.flatnonzero(counts)
    scale = 62 - log
    step = (1 << 62) // n
    norm = np.zeros(len(counts), dtype=np.int64)
    for s in used.tolist():
        c = int(counts[s])
        if c <= n >> log:
            norm[s] = -1
            continue
        p = c * step >> scale
        if p < len(ROUND_UP) and c * step - (p << scale) > (1 << (scale - 20)) * ROUND_UP[p]:
            p += 1
        norm[s] = p
    left, top = size - int(np.abs(norm).sum()), int(norm.argmax())
    if -left < norm[top] >> 1:
        norm[top] += left
        return norm
    return _proportional(counts, log)


def _proportional(counts: np.ndarray, log: int) -> np.ndarray:
    """Where the first method leaves too much to the commonest symbol: a slot for each used symbol, and the others by shares, the largest remainders first."""
    used = np.flatnonzero(counts)
    spare = (1 << log) - len(used)
    if spare < 0:
        raise NotCompressible("no slot is left for a symbol")
    whole, part = np.divmod(counts[used].astype(np.int64) * spare, int(counts.sum()))
    norm = np.zeros(len(counts), dtype=np.int64)
    norm[used] = 1 + whole
    norm[used[np.argsort(-part, kind="stable")[: spare - int(whole.sum())]]] += 1
    return norm


def _model(data: np.ndarray) -> tuple[np.ndarray, int]:
    if len(data) < 2:
        raise NotCompressible("too few symbols")
    counts = np.bincount(data)
    most = int(counts.max())
    if most == len(data):
        raise NotCompressible("a single symbol")
    if most == 1 or most < len(data) >> 15:
        raise NotCompressible("counts are too even")
    log = table_log(len(data), len(counts))
    while np.count_nonzero(counts) > 1 << log:
        log += 1
    return normalized(counts, log), log


def _header(kind: bytes, n: int, norm: np.ndarray, log: int) -> bytes:
    used = np.flatnonzero(norm)
    return struct.pack("<cBII", kind, log, n, len(used)) + used.astype("<u4").tobytes() + norm[used].astype("<i4").tobytes()


def _read_header(blob: bytes) -> tuple[int, int, np.ndarray, int]:
    _, log, n, used = struct.unpack_from("<cBII", blob)
    at = struct.calcsize("<cBII")
    syms = np.frombuffer(blob, "<u4", used, at)
    norm = np.zeros(int(syms.max()) + 1, dtype=np.int64)
    norm[syms] = np.frombuffer(blob, "<i4", used, at + 4 * used)
    return log, n, norm, at + 8 * used


def _spread(norm: np.ndarray, log: int) -> np.ndarray:
    """The symbol of each slot: rare ones at the end, others strewn with a step that is coprime to the size."""
    size = 1 << log
    slots = np.full(size, -1, dtype=np.int64)
    rare = np.flatnonzero(norm == -1)
    if len(rare):
        slots[size - len(rare) :] = rare[::-1]
    free = size - len(rare)
    order = np.arange(size, dtype=np.int64) * ((size >> 1) + (size >> 3) + 3) % size
    order = order[order < free]
    slots[order] = np.repeat(np.arange(len(norm)), np.maximum(norm, 0))
    return slots


def _table(norm: np.ndarray, log: int):
    """Per slot its symbol, the bits it reads, and the slot that they are added to; and per symbol its slots by state."""
    size, slots = 1 << log, _spread(norm, log)
    freq = np.abs(norm)
    order = np.argsort(slots, kind="stable")
    first = np.concatenate([[0], np.cumsum(freq)])
    state = np.empty(size, dtype=np.int64)
    state[order] = np.arange(size) - np.repeat(first[:-1], freq) + np.repeat(freq, freq)
    bits = log - (np.frexp(state.astype(np.float64))[1] - 1)
    return slots, bits, (state << bits) - size, order, first


def tans_encode(data: np.ndarray) -> bytes:
    norm, log = _model(data)
    size = 1 << log
    _, _, _, order, first = _table(norm, log)
    freq, order, first = np.abs(norm).tolist(), order.tolist(), first.tolist()
    state, out = size, []
    for s in reversed(data.tolist()):  # backwards, so that decoding runs forwards
        f = freq[s]
        k = max(0, state.bit_length() - f.bit_length())
        if state >> k < f:
            k -= 1
        elif state >> k >= 2 * f:
            k += 1
        out.append((state & ((1 << k) - 1), k))
        state = size + order[first[s] + (state >> k) - f]
    return _header(b"T", len(data), norm, log) + struct.pack("<I", state - size) + _bits(reversed(out))


def _bits(parts) -> bytes:
    """Values with their numbers of bits, low bits first."""
    out, stream, fill = bytearray(), 0, 0
    for value, k in parts:
        stream |= value << fill
        fill += k
        if fill >= 4096:
            whole = fill >> 3
            out += (stream & ((1 << (8 * whole)) - 1)).to_bytes(whole, "little")
            stream >>= 8 * whole
            fill -= 8 * whole
    return bytes(out + stream.to_bytes((fill + 7) // 8, "little"))


def tans_decode(blob: bytes) -> np.ndarray:
    log, n, norm, at = _read_header(blob)
    (state,) = struct.unpack_from("<I", blob, at)
    slots, bits, base, _, _ = (x.tolist() for x in _table(norm, log))
    body, pos, out = blob[at + 4 :], 0, []
    for _ in range(n):
        out.append(slots[state])
        k = bits[state]
        if k:
            word = int.from_bytes(body[pos >> 3 : (pos + k + 7) >> 3], "little") >> (pos & 7)
            state = base[state] + (word & ((1 << k) - 1))
            pos += k
        else:
            state = base[state]
    return np.array(out, dtype=np.int64)


LANES = 8


def rans_encode(data: np.ndarray) -> bytes:
    """Range variant with eight states that take turns; states stay within [2**16, 2**32) and give off 16 bits at a time."""
    norm, log = _model(data)
    freq = np.abs(norm)
    start = np.concatenate([[0], np.cumsum(freq)]).tolist()
    freq, states, out = freq.tolist(), [1 << 16] * LANES, []
    for i in range(len(data) - 1, -1, -1):
        s, x = int(data[i]), states[i % LANES]
        if x >= freq[s] << (32 - log):
            out.append(x & 65535)
            x >>= 16
        states[i % LANES] = (x // freq[s] << log) + x % freq[s] + start[s]
    return _header(b"R", len(data), norm, log) + struct.pack(f"<{LANES}I", *states) + np.array(out[::-1], dtype="<u2").tobytes()


def rans_decode(blob: bytes) -> np.ndarray:
    log, n, norm, at = _read_header(blob)
    states = list(struct.unpack_from(f"<{LANES}I", blob, at))
    words, pos = np.frombuffer(blob, "<u2", offset=at + 4 * LANES).tolist(), 0
    freq = np.abs(norm)
    slot = np.repeat(np.arange(len(norm)), freq).tolist()
    start, freq, mask, out = np.concatenate([[0], np.cumsum(freq)]).tolist(), freq.tolist(), (1 << log) - 1, []
    for i in range(n):
        x = states[i % LANES]
        s = slot[x & mask]
        out.append(s)
        x = freq[s] * (x >> log) + (x & mask) - start[s]
        if x < 1 << 16:
            x = x << 16 | words[pos]
            pos += 1
        states[i % LANES] = x
    return np.array(out, dtype=np.int64)


def huffman_encode(data: np.ndarray) -> bytes:
    """Canonical codes of at most 14 bits; symbols without one follow an escape in full."""
    counts = np.bincount(data)
    used = np.flatnonzero(counts)
    used = used[np.lexsort((used, -counts[used]))]
    keep = used[: chosen(counts[used].tolist())]
    rest = int(counts[used[len(keep) :]].sum())
    depth = max(1, int(data.max()).bit_length())
    escape = len(counts)
    syms = [*keep.tolist(), escape]
    lengths = dict(zip(syms, code_lengths([*counts[keep].tolist(), max(rest, 1)]), strict=True))
    codes = _canonical(lengths)
    width = max(lengths.values())
    value, size = np.zeros(escape + 1, dtype=np.int64), np.zeros(escape + 1, dtype=np.int64)
    for s, (code, k) in codes.items():
        value[s], size[s] = code, k
    coded = size[data] > 0
    parts = np.where(coded, value[data], value[escape] << depth | data)
    bits = np.where(coded, size[data], size[escape] + depth)
    ends = np.cumsum(bits)
    flat = np.repeat(parts, bits) >> (np.repeat(ends, bits) - 1 - np.arange(int(ends[-1]) if len(ends) else 0))
    head = struct.pack("<cBBIII", b"H", depth, width, len(data), escape, len(codes))
    book = sorted(lengths.items())
    return head + np.array([s for s, _ in book], dtype="<u4").tobytes() + bytes(k for _, k in book) + np.packbits((flat & 1).astype(np.uint8)).tobytes()


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    code, last, out = 0, 0, {}
    for s, k in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= k - last
        out[s], last = (code, k), k
        code += 1
    return out


def huffman_decode(blob: bytes) -> np.ndarray:
    _, depth, width, n, escape, used = struct.unpack_from("<cBBIII", blob)
    at = struct.calcsize("<cBBIII")
    syms = np.frombuffer(blob, "<u4", used, at).tolist()
    codes = _canonical(dict(zip(syms, blob[at + 4 * used : at + 5 * used], strict=True)))
    table = [(0, 1)] * (1 << width)
    for s, (code, k) in codes.items():
        for low in range(1 << (width - k)):
            table[code << (width - k) | low] = (s, k)
    body = blob[at + 5 * used :] + bytes(8)
    take = lambda pos, k: int.from_bytes(body[pos >> 3 : (pos >> 3) + 8], "big") >> (64 - (pos & 7) - k) & ((1 << k) - 1)
    out, pos = [], 0
    for _ in range(n):
        s, k = table[take(pos, width)]
        pos += k
        if s == escape:
            s = take(pos, depth)
            pos += depth
        out.append(s)
    return np.array(out, dtype=np.int64)


CODERS = {"tans": (tans_encode, tans_decode), "rans": (rans_encode, rans_decode), "huffman": (huffman_encode, huffman_decode)}


def decode_any(blob: bytes) -> np.ndarray:
    """By the first byte."""
    return {b"T": tans_decode, b"R": rans_decode, b"H": huffman_decode, b"P": plain_decode}[blob[:1]](blob)


def plain_encode(data: np.ndarray) -> bytes:
    return b"P" + np.asarray(data).astype("<u4").tobytes()


def plain_decode(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4", offset=1).astype(np.int64)


def encode(data: np.ndarray, coder: str = "tans") -> bytes:
    """With the named coder, or as plain words where it can't gain."""
    try:
        coded = CODERS[coder][0](np.asarray(data, dtype=np.int64))
    except NotCompressible:
        return plain_encode(data)
    return coded if len(coded) < 4 * len(data) else plain_encode(data)
