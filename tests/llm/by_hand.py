"""Words, hashes, features and signatures as plain numbers, one at a time."""

import math
import re

M = 1 << 64
BASE, GRAM = 0x9E3779B97F4A7C15, 0x9FB21C651E98DF25
SALTS = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89]

_WORD = re.compile("[0-9a-zªµºÀ-῿₀-⿿぀-\U0010ffff]+")


def mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD % M
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 % M
    return h ^ h >> 33


def words(text):
    return [w.encode() for w in _WORD.findall((text or "").lower())]


def word_hash(word):
    total, power = 0, 1
    for b in word:
        total, power = (total + (b + 1) * power) % M, power * BASE % M
    return mix(total)


def toxic_buckets(text, bits):
    own, out = words(text), set()
    h = [word_hash(w) for w in own]
    for w, x in zip(own, h):
        out.add(mix(x ^ SALTS[0]) >> 64 - bits)
        for k, size in enumerate((4, 5, 6), 1):
            out.add(mix(word_hash(w[:size]) ^ (SALTS[2] + k) % M) >> 64 - bits)
    two = [mix((a * GRAM + b) % M) for a, b in zip(h, h[1:])]
    out |= {mix(x ^ SALTS[1]) >> 64 - bits for x in two}
    out |= {mix((x * GRAM + c) % M) >> 64 - bits for x, c in zip(two, h[2:])}
    out |= {mix((a * GRAM + c) % M ^ SALTS[3]) >> 64 - bits for a, c in zip(h, h[2:])}
    return out


def toxicity(text, model):
    """(probability, whether toxic)"""
    weights = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    evidence = sum(weights.get(b, 0.0) for b in toxic_buckets(text, model.bits))
    p = 1 / (1 + math.exp(-max(-35.0, min(35.0, evidence + model.bias))))
    return p, p >= 0.3 and evidence > 0


def signature(text):
    """256 bits as a number, None for a text without words."""
    h = [word_hash(w) for w in words(text)]
    features = set(h) | {mix((a * GRAM + b) % M) for a, b in zip(h, h[1:])}
    if not features:
        return None
    votes = [0] * 256
    for f in features:
        raw = b"".join(mix(f ^ s).to_bytes(8, "little") for s in SALTS)
        for i, bit in enumerate(f"{int.from_bytes(raw, 'big'):0256b}"):
            votes[i] += bit == "1"
    return int("".join("1" if 2 * v > len(features) else "0" for v in votes), 2)


def near_groups(rows, radius=50):
    """Lists of ids, of (id, text) rows whose signatures are in reach of each other."""
    signed = [(d, s) for d, t in rows if (s := signature(t)) is not None]
    up = list(range(len(signed)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(signed)):
        for j in range(i):
            if (signed[i][1] ^ signed[j][1]).bit_count() <= radius:
                up[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i, (d, _) in enumerate(signed):
        out.setdefault(root(i), []).append(d)
    return [g for g in out.values() if len(g) > 1]
