"""Brute-force decontamination for tests."""

import hashlib
import re


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def report(docs, items, window=13):
    wins = {}
    for key, text in items:
        w = words(text) if key is not None else []
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(key))
    sizes = sorted({len(k) for k in wins})
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (t := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[t]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out
