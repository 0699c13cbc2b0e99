"""Plain Python answers for small fixtures."""

import hashlib
import math
from collections import Counter, defaultdict


def gsums(pairs):
    """{key: (entropy, l2, l1, card)} of (key, value) pairs."""
    freq = defaultdict(Counter)
    for key, value in pairs:
        freq[key][value] += 1
    return {
        key: (
            sum(f * math.log2(f) for f in c.values()),
            sum(f * f for f in c.values()),
            sum(c.values()),
            len(c),
        )
        for key, c in freq.items()
    }


def lanes(text, n=8):
    h = hashlib.md5(text.encode()).hexdigest()
    return [int(h[4 * i : 4 * i + 4], 16) for i in range(n)]


def layer_of(lane, levels):
    ones = 0
    while lane >> ones & 1:
        ones += 1
    return min(ones, levels - 1)


def sketch_answers(pairs, params, combine):
    """{key: (entropy, l2, l1, card)} of a sketch with md5 lanes."""
    freq = Counter(pairs)
    layers = defaultdict(list)
    for (key, value), f in freq.items():
        item = lanes(f"item|{len(key)}|{key}|{value}")
        order = (-f, item[0] << 16 | item[1], key, value)
        for d in range(params.d):
            cell = (d, lanes(f"cell|{key}")[d] % params.w)
            layers[cell, layer_of(item[3], params.levels)].append((order, key, value, f))
    kept = {at: sorted(found)[: params.k] for at, found in layers.items()}
    sums = defaultdict(lambda: [0.0, 0, 0, 0])
    for cell in {cell for cell, _ in kept}:
        done = set()
        for m in range(params.levels):
            candidates = [x for (c, l), found in kept.items() if c == cell and l >= m for x in found]
            for _, key, value, f in sorted(candidates)[: params.k]:
                if (key, value) not in done:
                    done.add((key, value))
                    for i, g in enumerate((f * math.log2(f), f * f, f, 1)):
                        sums[key, cell[0]][i] += (1 << m) * g
    out = {}
    for key in {k for k, _ in pairs}:
        rows = [sums.get((key, d), [0, 0, 0, 0]) for d in range(params.d)]
        pick = min if combine == "min" else (lambda xs: sorted(xs)[params.d // 2])
        out[key] = tuple(pick([r[i] for r in rows]) for i in range(4))
    return out
