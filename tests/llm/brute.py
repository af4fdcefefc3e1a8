"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

EXTRA = ("id", "key", "doc", "mark", "size", "n", "hashed", "bucket", "text_key", "skey",
         "words", "body", "uid", "block", "digest", "shard", "kept", "target", "lines")


def prose(seed: int, n: int) -> str:
    chance = random.Random(seed)
    letters = "abcdefghijklmnop"
    return " ".join("".join(chance.choices(letters, k=chance.randint(2, 8)))
                    for _ in range(n))


def edited(text: str, seed: int, changes: int) -> str:
    chance, found = random.Random(seed), text.split(" ")
    for _ in range(changes):
        found[chance.randrange(len(found))] = f"x{chance.randrange(10 ** 6)}"
    return " ".join(found)


def edge_rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars with every odd case the operators define."""
    base, passage = prose(1, 120), prose(2, 70)
    texts = [None, "", " \n\t ", "one two three", "ONE two Three", "one two three", base,
             base, base.upper(), edited(base, 3, 3), edited(base, 4, 40),
             base.replace(" ", "\n\x0b"), prose(5, 60) + " " + passage,
             passage + "\n" + prose(6, 30), prose(7, 10) + " " + passage + " " + prose(8, 9),
             "äöü ÄÖÜ ß 東京 " * 30, prose(9, 30_000), "w" * 100_000,
             "same line\n" * 40, "a b c d e f " * 50, "#### $$$$ !!!! **** " * 40,
             "\x1c\x85\xa0 odd blanks　here", prose(2, 70)]
    rows = [(i, t, None if i % 7 == 3 else "en", None if i % 5 == 4 else f"s{i % 3}", i)
            for i, t in enumerate(texts)]
    rows += [(None, base, "en", "s0", 1), (None, "no id at all", None, None, None),
             (6, base, "en", "s0", 6), (6, base, "en", "s0", 6), (7, "same id", "en", None, 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra: bool = False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({n: F.lit(None).cast("string") for n in EXTRA}) if extra else df


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def grams(text: str | None, n: int = 5) -> frozenset:
    w = (text or "").encode().lower().split()
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def components(rows) -> Counter:
    """(doc_id, set size, least reachable id) of every row."""
    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= 75 * len(x | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], len(sets[i]), min(least[find(i)], default=None))
                   for i, r in enumerate(rows))


def without_repeats(rows, k: int = 50) -> Counter:
    first: dict[tuple, int] = {}
    for i, t, *_ in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            key = tuple(w[j:j + k])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j:j + k])] < i:
                gone[j:j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    """Water filling, round by round, over sources in code point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, found = float(sum(sizes.values())), set(order), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return found | share
        for s in full:
            found[s] = 3.0 * sizes[s]
            left -= found[s]
        open_ -= full
    return found


def rule_counts(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def crc(ids) -> int:
    import numpy as np

    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
