"""Spark's 64-bit hash of strings and of pairs of hashes, for brute-force versions."""

import struct

import xxhash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(word):
    return signed(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42))


def pair_hash(a, b):
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)))


def grams(words, buckets=8192):
    """Buckets of words, then of pairs of neighbours."""
    h = [word_hash(w) for w in words]
    return [x & (buckets - 1) for x in (*h, *map(pair_hash, h, h[1:]))]
