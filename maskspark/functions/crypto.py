"""Keyed digests, format-preserving encryption and the sealing of originals.

Keys never enter a plan as literals: they are columns of a one-row table that is joined
by broadcast (hmac, sealing), or held by an Arrow function (FF3-1).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64


def hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and outer key blocks of HMAC-SHA256."""
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def key_table(spark: SparkSession, salt: bytes) -> DataFrame:
    """One row (inner, outer) to be joined by broadcast."""
    if len(salt) < 16:
        raise ValueError("a salt has 16 bytes or more")
    inner, outer = hmac_pads(salt)
    return spark.createDataFrame([(bytearray(inner), bytearray(outer))], "inner_pad binary, outer_pad binary")


def hmac_sha256(message: Column, inner: Column, outer: Column) -> Column:
    """Lower-case hex."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def _aes_tables() -> tuple[np.ndarray, np.ndarray]:
    """The S-box from inverses in GF(2^8), and doubling there."""
    double = np.array([(x << 1) ^ (0x11B if x & 0x80 else 0) for x in range(256)], np.uint8)
    log, power, x = {}, [0] * 255, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= int(double[x])  # times three
    box = []
    for b in range(256):
        inverse = power[-log[b] % 255] if b else 0
        out = 0x63
        for turn in range(5):
            out ^= (inverse << turn | inverse >> (8 - turn)) & 0xFF
        box.append(out)
    return np.array(box, np.uint8), double


SBOX, DOUBLE = _aes_tables()
_ROWS = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])


class AES:
    """AES of many blocks at once: encrypt((n, 16) bytes)."""

    def __init__(self, key: bytes):
        words = [list(key[i : i + 4]) for i in range(0, len(key), 4)]
        n, rounds, constant = len(words), len(words) + 6, 1
        while len(words) < 4 * (rounds + 1):
            word = list(words[-1])
            if len(words) % n == 0:
                word = [int(SBOX[b]) for b in word[1:] + word[:1]]
                word[0] ^= constant
                constant = int(DOUBLE[constant])
            elif n > 6 and len(words) % n == 4:
                word = [int(SBOX[b]) for b in word]
            words.append([a ^ b for a, b in zip(word, words[-n])])
        self.keys = np.array(words, np.uint8).reshape(rounds + 1, 16)

    def encrypt(self, blocks: np.ndarray) -> np.ndarray:
        state = blocks ^ self.keys[0]
        for key in self.keys[1:-1]:
            state = SBOX[state][:, _ROWS].reshape(-1, 4, 4)
            twice, all_ = DOUBLE[state], state[:, :, :1] ^ state[:, :, 1:2] ^ state[:, :, 2:3] ^ state[:, :, 3:]
            following = np.roll(state, -1, axis=2)
            state = (twice ^ DOUBLE[following] ^ state ^ all_).reshape(-1, 16) ^ key
        return SBOX[state][:, _ROWS] ^ self.keys[-1]


class FF3:
    """FF3-1 over decimal digits (NIST SP 800-38G revision 1); 8-byte tweaks give FF3."""

    LEAST, MOST = 6, 56

    def __init__(self, key: bytes, tweak: bytes):
        self.aes = AES(key[::-1])
        if len(tweak) == 7:
            self.left = tweak[:3] + bytes([tweak[3] & 0xF0])
            self.right = tweak[4:7] + bytes([(tweak[3] & 0x0F) << 4])
        elif len(tweak) == 8:
            self.left, self.right = tweak[:4], tweak[4:]
        else:
            raise ValueError("a tweak has 7 bytes")

    def encrypt(self, numbers: list[str]) -> list[str]:
        """Numbers of one length."""
        n = len(numbers[0])
        u = n - n // 2
        a = [int(x[:u][::-1]) for x in numbers]  # halves as numbers, the first digit least
        b = [int(x[u:][::-1]) for x in numbers]
        for i in range(8):
            width, side = (u, self.right) if i % 2 == 0 else (n - u, self.left)
            head = side[:3] + bytes([side[3] ^ i])
            blocks = np.frombuffer(b"".join((head + x.to_bytes(12, "big"))[::-1] for x in b), np.uint8).reshape(-1, 16)
            y = self.aes.encrypt(blocks)
            a, b = b, [(x + int.from_bytes(row.tobytes()[::-1], "big")) % 10**width for x, row in zip(a, y)]
        return [f"{x:0{u}d}"[::-1] + f"{y:0{n - u}d}"[::-1] for x, y in zip(a, b)]


def digits_of(surface: Column) -> Column:
    return F.regexp_replace(surface, r"(?U)\D", "")


def with_digits(surface: Column, digits: Column) -> Column:
    """The surface with its digits replaced by others, in their places.

    digits must be a plain column: lambdas can't hold the result of a Python function.
    """
    letters = F.filter(F.split(surface, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(state: Column, c: Column) -> Column:
        digit = c.rlike(r"(?U)^\d$")
        return F.struct(
            F.concat(state["out"], F.when(digit, F.substring(digits, state["next"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(digit, state["next"] + 1).otherwise(state["next"]).alias("next"),
        )

    return F.aggregate(letters, start, put, lambda s: s["out"])


def fpe_digits(digits: Column, key: bytes, tweak: bytes) -> Column:
    """Digits encrypted by FF3-1; null where their number is outside its domain."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        cipher = FF3(key, tweak)
        out: list[str | None] = [None] * len(column)
        lengths: dict[int, list[int]] = {}
        for i, x in enumerate(column):
            if x is not None and FF3.LEAST <= len(x) <= FF3.MOST:
                lengths.setdefault(len(x), []).append(i)
        for rows in lengths.values():
            for i, y in zip(rows, cipher.encrypt([str(int("1" + column[i]))[1:] for i in rows])):
                out[i] = y
        return pd.Series(out)

    return run(digits)


def sealed(original: Column, key: Column, pseudonym: Column) -> Column:
    """AES-256-GCM: nonce, ciphertext and tag in a row; the pseudonym is authenticated."""
    return F.aes_encrypt(F.encode(original, "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.encode(pseudonym, "UTF-8"))


def opened(ciphertext: Column, key: Column, pseudonym: Column) -> Column:
    return F.decode(F.aes_decrypt(ciphertext, key, F.lit("GCM"), F.lit("DEFAULT"), F.encode(pseudonym, "UTF-8")), "UTF-8")
