"""Rows that every operator must get through, and brute-force versions of what they compute."""

import re

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, fp int, digest double, size string, draw int"
CLASH = (7, "x", 1, 0.5, "s", 2)[1:]


def docs(spark, rows=None):
    """Documents with null, empty, very long and repeated texts, and columns named like inner ones."""
    plain = "the quick brown fox jumps over the lazy dog and runs away from the very old house near the river"
    rows = rows or [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", None),
        (4, plain, "en", "a"),
        (5, plain.replace(" ", "  \n"), "en", "b"),
        (5, plain.replace(" ", "  \n"), "en", "b"),
        (None, plain, "de", "b"),
        (6, "Straße über Bäume und Häuser " * 4000, "de", "c"),
        (7, "123 456 !!", "en", "b"),
        (8, plain.upper(), None, "a"),
        (9, "x" * 50_000, "en", ""),
        (10, plain + " today", "en", "a"),
        (11, " 　 漢字  a <|endoftext|> it's  x\n\n\ny z", "zz", "c"),
    ]
    return spark.createDataFrame([(*r, None, *CLASH) for r in rows], DOCS)


def no_docs(spark):
    return docs(spark).where("false")


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def smallest_linked(values, ids, radius):
    """The smallest id reachable from each value over links of at most `radius` bits."""
    top = list(range(len(values)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    v = np.array(values, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= radius).tolist():
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(v))]
