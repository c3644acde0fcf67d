"""FF1 format-preserving encryption (NIST SP 800-38G) as an Arrow UDF over whole batches.

A batch is split by value length; each length group runs the ten rounds on numpy arrays. The
two halves are little-endian limbs in base radix^k (below 2^31), so every alphabet size and
every length is exact, with no wide-integer loop per row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.aes_blocks import encrypt_blocks, round_keys
from cloakframe.plans.runtime import ship_package

ROUNDS = 10
_U64 = np.uint64


class HalfNumber:
    """Limb layout of a numeral string of ``width`` symbols."""

    def __init__(self, radix: int, width: int) -> None:
        self.radix, self.width = radix, width
        self.step = 1
        while radix ** (self.step + 1) <= 2**31:
            self.step += 1
        self.limbs = -(-width // self.step)
        sizes = [self.step] * (self.limbs - 1) + [width - self.step * (self.limbs - 1)]
        self.sizes = sizes
        self.mods = [_U64(radix**s) for s in sizes]

    def from_digits(self, digits: np.ndarray) -> list[np.ndarray]:
        out, end = [], self.width
        for size in self.sizes:
            acc = np.zeros(len(digits), _U64)
            for pos in range(end - size, end):
                acc = acc * _U64(self.radix) + digits[:, pos].astype(_U64)
            out.append(acc)
            end -= size
        return out

    def to_digits(self, limbs: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(limbs[0]), self.width), np.int64)
        end = self.width
        for size, limb in zip(self.sizes, limbs):
            rest = limb
            for pos in range(end - 1, end - size - 1, -1):
                out[:, pos] = rest % _U64(self.radix)
                rest = rest // _U64(self.radix)
            end -= size
        return out

    def to_bytes(self, limbs: list[np.ndarray], size: int) -> np.ndarray:
        """Big-endian bytes of the number, exactly ``size`` wide."""
        count = -(-size // 4)
        words = [np.zeros(len(limbs[0]), _U64) for _ in range(count)]
        for limb, mod in zip(reversed(limbs), reversed(self.mods)):
            carry = limb
            for i in range(count):
                full = words[i] * mod + carry
                words[i] = full & _U64(0xFFFFFFFF)
                carry = full >> _U64(32)
        big = np.stack(words[::-1], axis=1).astype(">u4")
        return big.view(np.uint8).reshape(len(big), 4 * count)[:, 4 * count - size :]

    def from_words(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """A big-endian list of 32-bit words, reduced modulo radix^width."""
        limbs = [np.zeros(len(words[0]), _U64) for _ in self.mods]
        for word in words:
            carry = word
            for i, mod in enumerate(self.mods):
                full = (limbs[i] << _U64(32)) + carry
                limbs[i] = full % mod
                carry = full // mod
        return limbs

    def add(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        out, carry = [], _U64(0)
        for x, y, mod in zip(a, b, self.mods):
            full = x + y + carry
            out.append(full % mod)
            carry = full // mod
        return out

    def subtract(self, a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
        out, borrow = [], _U64(0)
        for x, y, mod in zip(a, b, self.mods):
            full = x + mod - y - borrow
            out.append(full % mod)
            borrow = _U64(1) - full // mod
        return out


class _RoundFunction:
    """The keyed round function for one value length."""

    def __init__(self, keys: np.ndarray, radix: int, n: int, tweak: bytes) -> None:
        self.keys = keys
        u, v = n // 2, n - n // 2
        self.number_bytes = ((radix**v - 1).bit_length() + 7) // 8
        self.out_bytes = 4 * (-(-self.number_bytes // 4)) + 4
        head = (
            bytes([1, 2, 1])
            + radix.to_bytes(3, "big")
            + bytes([10, u % 256])
            + n.to_bytes(4, "big")
            + len(tweak).to_bytes(4, "big")
        )
        fixed = head + tweak + bytes((-len(tweak) - self.number_bytes - 1) % 16)
        whole = len(fixed) // 16 * 16
        self.tail = np.frombuffer(fixed[whole:], np.uint8)
        chain = np.zeros((1, 16), np.uint8)
        for at in range(0, whole, 16):
            block = np.frombuffer(fixed[at : at + 16], np.uint8)
            chain = encrypt_blocks(keys, chain ^ block)
        self.chain = chain

    def words(self, i: int, number: np.ndarray) -> list[np.ndarray]:
        rows = len(number)
        message = np.concatenate(
            [
                np.broadcast_to(self.tail, (rows, len(self.tail))),
                np.full((rows, 1), i, np.uint8),
                number,
            ],
            axis=1,
        )
        mac = np.broadcast_to(self.chain, (rows, 16))
        for at in range(0, message.shape[1], 16):
            mac = encrypt_blocks(self.keys, mac ^ message[:, at : at + 16])
        parts, counter = [mac], 1
        while 16 * len(parts) < self.out_bytes:
            tag = np.frombuffer(counter.to_bytes(16, "big"), np.uint8)
            parts.append(encrypt_blocks(self.keys, mac ^ tag))
            counter += 1
        stream = np.ascontiguousarray(np.concatenate(parts, axis=1)[:, : self.out_bytes])
        big = stream.view(">u4").astype(_U64)
        return [big[:, j] for j in range(big.shape[1])]


def ff1_digits(
    digits: np.ndarray, key: bytes, radix: int, tweak: bytes, encrypt: bool
) -> np.ndarray:
    """Run FF1 over an (N, n) array of digit values of equal length."""
    n = digits.shape[1]
    u = n // 2
    left, right = HalfNumber(radix, u), HalfNumber(radix, n - u)
    rounds = _RoundFunction(round_keys(key), radix, n, tweak)
    a, b = left.from_digits(digits[:, :u]), right.from_digits(digits[:, u:])
    for i in range(ROUNDS) if encrypt else reversed(range(ROUNDS)):
        # Even rounds rewrite the left-width half, odd rounds the right-width half.
        target, other = (left, right) if i % 2 == 0 else (right, left)
        keep, change = (b, a) if encrypt else (a, b)
        pad = target.from_words(rounds.words(i, other.to_bytes(keep, rounds.number_bytes)))
        if encrypt:
            a, b = keep, target.add(change, pad)
        else:
            a, b = target.subtract(change, pad), keep
    return np.concatenate([left.to_digits(a), right.to_digits(b)], axis=1)


def ff1_texts(
    texts: np.ndarray, key: bytes, alphabet: str, tweak: bytes, encrypt: bool
) -> np.ndarray:
    """FF1 over equal-length texts whose characters all belong to the alphabet."""
    n = len(texts[0])
    symbols = np.array([ord(ch) for ch in alphabet], np.uint32)
    order = np.argsort(symbols)
    points = np.array(texts, dtype=f"<U{n}").view(np.uint32).reshape(-1, n)
    digits = order[np.searchsorted(symbols[order], points)]
    out = ff1_digits(digits, key, len(alphabet), tweak, encrypt)
    return np.ascontiguousarray(symbols[out]).view(f"<U{n}").ravel()


def ff1_udf(alphabet: str, tweak: str, encrypt: bool):
    """Arrow UDF ``(text, key) -> text``; NULL text stays NULL."""
    ship_package()

    @F.arrow_udf("string")
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        values = np.array(texts.to_pylist(), dtype=object)
        out = np.full(len(values), None, dtype=object)
        lengths = np.array([-1 if v is None else len(v) for v in values])
        by_key = keys.dictionary_encode()
        slots = np.array([-1 if i is None else i for i in by_key.indices.to_pylist()])
        for slot, key in enumerate(by_key.dictionary.to_pylist()):
            for n in np.unique(lengths[(slots == slot) & (lengths > 0)]):
                rows = np.nonzero((slots == slot) & (lengths == n))[0]
                out[rows] = ff1_texts(values[rows], key, alphabet, tweak.encode(), encrypt)
        return pa.array(out.tolist(), type=pa.string())

    return run


def ff1(text: Column, key: Column, *, alphabet: str, tweak: str, encrypt: bool) -> Column:
    """Encrypt or decrypt a column of valid numeral strings."""
    return ff1_udf(alphabet, tweak, encrypt)(text, key)
