"""Contract addresses: the last 20 bytes of keccak-256 over the RLP of (creator, nonce), over Arrow batches.

The permutation runs on numpy arrays, one column for each row of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 136


def _round_constants() -> list[int]:
    """The round constants of Keccak-f[1600], from its shift register (x^8 + x^6 + x^5 + x^4 + 1)."""
    out, state = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if state & 1:
                value |= 1 << ((1 << j) - 1)
            state = (state << 1) ^ (0x171 if state & 0x80 else 0)
        out.append(value)
    return out


def _rotations() -> dict[tuple[int, int], int]:
    """Rotation of each lane: triangular numbers along the walk (x, y) -> (y, 2x + 3y)."""
    out, x, y = {(0, 0): 0}, 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


CONSTANTS, ROTATE = _round_constants(), _rotations()


def _rot(v: np.ndarray, n: int) -> np.ndarray:
    return v if not n else v << np.uint64(n) | v >> np.uint64(64 - n)


def keccak256(messages: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digests of messages shorter than one block. messages: uint8, a row each, zero beyond its size."""
    block = np.zeros((len(messages), RATE), np.uint8)
    block[:, : messages.shape[1]] = messages
    block[np.arange(len(block)), sizes] ^= 0x01
    block[:, RATE - 1] ^= 0x80
    lanes = {(i % 5, i // 5): np.zeros(len(block), np.uint64) for i in range(25)}
    for i, lane in enumerate(np.ascontiguousarray(block).view("<u8").T):
        lanes[i % 5, i // 5] = lane.copy()
    for constant in CONSTANTS:
        column = [lanes[x, 0] ^ lanes[x, 1] ^ lanes[x, 2] ^ lanes[x, 3] ^ lanes[x, 4] for x in range(5)]
        mix = [column[x - 1] ^ _rot(column[(x + 1) % 5], 1) for x in range(5)]
        moved = {(y, (2 * x + 3 * y) % 5): _rot(lanes[x, y] ^ mix[x], ROTATE[x, y]) for x, y in lanes}
        lanes = {(x, y): moved[x, y] ^ (~moved[(x + 1) % 5, y] & moved[(x + 2) % 5, y]) for x, y in moved}
        lanes[0, 0] = lanes[0, 0] ^ np.uint64(constant)
    return np.stack([lanes[i, 0] for i in range(4)], axis=1).astype("<u8").view(np.uint8).reshape(-1, 32)


def rlp_of(address: bytes, nonce: int) -> bytes:
    """RLP of the list (20-byte address, integer)."""
    number = nonce.to_bytes((nonce.bit_length() + 7) // 8, "big")
    item = number if len(number) == 1 and number[0] < 0x80 else bytes([0x80 + len(number)]) + number
    body = b"\x94" + address + item
    return bytes([0xC0 + len(body)]) + body


def created(addresses: list[bytes | None], nonces: list[int | None]) -> list[bytes | None]:
    ok = [i for i, (a, n) in enumerate(zip(addresses, nonces, strict=True)) if a is not None and n is not None]
    out: list[bytes | None] = [None] * len(addresses)
    if ok:
        encoded = [rlp_of(addresses[i], nonces[i]) for i in ok]
        messages = np.zeros((len(ok), max(map(len, encoded))), np.uint8)
        for row, e in zip(messages, encoded, strict=True):
            row[: len(e)] = np.frombuffer(e, np.uint8)
        for i, digest in zip(ok, keccak256(messages, np.array([len(e) for e in encoded])), strict=True):
            out[i] = digest[12:].tobytes()
    return out


@F.arrow_udf(T.BinaryType())
def contract_address(address: pa.Array, nonce: pa.Array) -> pa.Array:
    """The address of the contract that a transaction of this sender and nonce creates."""
    return pa.array(created(address.to_pylist(), nonce.to_pylist()), pa.binary())
