"""Static range asymmetric numeral coding of token ids, and its file format.

A block holds up to ``LANES * STEPS`` ids. Lane j codes ids j, j + LANES, ... with
its own 64-bit state; all lanes move together, one vector operation per step, and
share one stream of 32-bit words. Every ``CHECKPOINT`` steps the file keeps all
states and the word position, so decoding can begin there. Blocks need nothing
but the file's frequency table, which all of them share.

File: magic; blocks; a footer of Arrow-free little-endian arrays (documents, block
directory, frequencies); footer offset and CRC-32; magic. Each block has a CRC-32
of its bytes and one of its ids.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"IDRANS01"
SCALE = 20
LANES, STEPS, CHECKPOINT = 1024, 256, 64
BLOCK = LANES * STEPS
_LOW = np.uint64(1 << 31)
_U = np.uint64


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2**scale, at least 1 for every id that occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    freqs = np.zeros(len(counts), dtype=np.int64)
    if total == 0:
        return freqs
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << scale:
        raise ValueError("more distinct ids than frequency slots")
    exact = counts[seen] * float(1 << scale) / total
    part = np.maximum(1, np.floor(exact).astype(np.int64))
    left = (1 << scale) - int(part.sum())
    order = np.argsort(-part, kind="stable")
    if left > 0:
        part[order[0]] += left
    for i in order:
        if left >= 0:
            break
        cut = min(-left, int(part[i]) // 2)
        part[i] -= cut
        left += cut
    while left < 0:  # only ones and twos are left to take from
        i = int(np.argmax(part))
        part[i] -= 1
        left += 1
    freqs[seen] = part
    return freqs


@dataclass
class Block:
    n: int
    words: np.ndarray
    states: np.ndarray  # checkpoints x lanes
    places: np.ndarray  # word position of each checkpoint


def encode_block(ids: np.ndarray, freqs: np.ndarray, lows: np.ndarray, scale: int = SCALE) -> Block:
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, dtype=np.uint64)
    shift, limit = _U(scale), _U(63 - scale)
    f_all, c_all = freqs[ids].astype(np.uint64), lows[ids].astype(np.uint64)
    words: list[np.ndarray] = [None] * steps  # type: ignore[list-item]
    marks: dict[int, np.ndarray] = {}
    for t in range(steps - 1, -1, -1):
        a, b = t * LANES, min(n, (t + 1) * LANES)
        f, c = f_all[a:b], c_all[a:b]
        x = state[: b - a]
        full = x >= (f << limit)
        words[t] = x[full].astype(np.uint32)
        x = np.where(full, x >> _U(32), x)
        quotient = x // f
        state[: b - a] = (quotient << shift) + (x - quotient * f) + c
        if t % CHECKPOINT == 0:
            marks[t] = state.copy()
    sizes = np.cumsum([0, *map(len, words)])
    at = sorted(marks)
    return Block(n, np.concatenate(words), np.stack([marks[t] for t in at]), sizes[at].astype(np.int64))


def decode_steps(block: Block, freqs, lows, slots, first: int, last: int, scale: int = SCALE) -> np.ndarray:
    """Ids of steps ``first`` (a checkpoint) up to ``last``; no earlier word is looked at."""
    mark = first // CHECKPOINT
    state, at = block.states[mark].copy(), int(block.places[mark])
    low = _U((1 << scale) - 1)
    shift, words = _U(scale), block.words
    out = np.empty(max(0, min(block.n, last * LANES) - first * LANES), dtype=np.uint32)
    for t in range(first, last):
        a, b = t * LANES, min(block.n, (t + 1) * LANES)
        x = state[: b - a]
        slot = x & low
        ids = slots[slot]
        x = freqs[ids] * (x >> shift) + slot - lows[ids]
        short = np.flatnonzero(x < _LOW)
        if len(short):
            x[short] = (x[short] << _U(32)) | words[at : at + len(short)]
            at += len(short)
        state[: b - a] = x
        out[a - first * LANES : b - first * LANES] = ids
    return out


def pack_block(block: Block) -> bytes:
    head = struct.pack("<qqq", block.n, len(block.words), len(block.places))
    return head + block.states.astype("<u8").tobytes() + block.places.astype("<i8").tobytes() + block.words.astype("<u4").tobytes()


def unpack_block(data: bytes) -> Block:
    n, n_words, marks = struct.unpack_from("<qqq", data)
    at = 24
    states = np.frombuffer(data, "<u8", marks * LANES, at).reshape(marks, LANES)
    at += states.nbytes
    places = np.frombuffer(data, "<i8", marks, at)
    at += places.nbytes
    return Block(n, np.frombuffer(data, "<u4", n_words, at), states, places)


def write_file(out, ids: np.ndarray, doc_ids: np.ndarray, doc_nulls: np.ndarray, lengths: np.ndarray, vocabulary: int) -> None:
    """Writes all ids of some documents, with one frequency table for the whole file."""
    freqs = scaled(np.bincount(ids, minlength=vocabulary))
    lows = np.concatenate([[0], np.cumsum(freqs)[:-1]])
    out.write(MAGIC)
    directory = []
    for a in range(0, len(ids), BLOCK):
        part = ids[a : a + BLOCK]
        data = pack_block(encode_block(part, freqs, lows))
        directory.append((out.write(data), len(data), zlib.crc32(data), zlib.crc32(part.astype("<u4").tobytes())))
    footer = struct.pack("<qqqqq", len(doc_ids), len(directory), vocabulary, SCALE, len(ids))
    footer += doc_ids.astype("<i8").tobytes() + doc_nulls.astype("<u1").tobytes() + lengths.astype("<i8").tobytes()
    footer += np.array(directory, dtype="<i8").reshape(-1, 4).tobytes() + zlib.compress(freqs.astype("<u4").tobytes(), 6)
    at = out.write(footer)
    out.write(struct.pack("<qI", at, zlib.crc32(footer)) + MAGIC)


class Reader:
    """Random access to one file: any range of ids, from the nearest checkpoint on."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(20, size - 20)
        at, crc = struct.unpack_from("<qI", tail)
        footer = source.read_at(size - 20 - at, at)
        if tail[12:] != MAGIC or zlib.crc32(footer) != crc:
            raise ValueError("not a complete token file")
        docs, blocks, vocabulary, self.scale, self.n = struct.unpack_from("<qqqqq", footer)
        at = 40
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.doc_nulls = np.frombuffer(footer, "<u1", docs, at + 8 * docs).astype(bool)
        self.lengths = np.frombuffer(footer, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        self.directory = np.frombuffer(footer, "<i8", 4 * blocks, at).reshape(blocks, 4)
        freqs = np.frombuffer(zlib.decompress(footer[at + 32 * blocks :]), "<u4").astype(np.int64)
        self.freqs = freqs.astype(np.uint64)
        self.lows = np.concatenate([[0], np.cumsum(freqs)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(vocabulary, dtype=np.int64), freqs)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last``, exclusive; a block's checksums are tested, that of its ids when it is decoded whole."""
        parts = [np.zeros(0, dtype=np.uint32)]
        for b in range(first // BLOCK, -(-last // BLOCK)):
            offset, size, crc, ids_crc = map(int, self.directory[b])
            data = self.source.read_at(size, offset)
            if zlib.crc32(data) != crc:
                raise ValueError(f"block {b} is damaged")
            block = unpack_block(data)
            a, z = max(0, first - b * BLOCK), min(block.n, last - b * BLOCK)
            step = a // LANES // CHECKPOINT * CHECKPOINT
            got = decode_steps(block, self.freqs, self.lows, self.slots, step, -(-z // LANES), self.scale)
            if step == 0 and z == block.n and zlib.crc32(got.astype("<u4").tobytes()) != ids_crc:
                raise ValueError(f"block {b} decodes to other ids")
            parts.append(got[a - step * LANES : z - step * LANES])
        return np.concatenate(parts)
