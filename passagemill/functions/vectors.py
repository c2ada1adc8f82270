"""Small vector kernels that run in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import chain

import numpy as np

_WORD = re.compile(r"\w+")


def tfidf_neighbours(windows: list[str], features: int = 4096) -> list[float]:
    """Cosines of neighbouring windows under TF-IDF fitted to these windows alone."""
    bags = [Counter(_WORD.findall(w.lower())) for w in windows]
    df = Counter(chain.from_iterable(bags))
    kept = df if len(df) <= features else sorted(df, key=lambda t: (-df[t], t))[:features]
    by_df = {n: math.log((1 + len(bags)) / (1 + n)) + 1 for n in set(df.values())}
    idf = {t: by_df[df[t]] for t in kept}
    out, last = [], None
    for b in bags:
        v = {t: idf[t] if n == 1 else (1 + math.log(n)) * idf[t] for t, n in b.items() if t in idf}
        norm = math.sqrt(sum([x * x for x in v.values()])) or 1.0
        row = {t: x / norm for t, x in v.items()}
        if last is not None:
            out.append(sum([x * row[t] for t, x in last.items() if t in row], 0.0))
        last = row
    return out


def hashed(text: str, dimensions: int = 256, seed: int = 0) -> np.ndarray:
    """Words hashed to signed buckets by BLAKE2b, weighted 1 + ln(count), of length one."""
    out = np.zeros(dimensions, np.float32)
    for word, n in Counter(_WORD.findall(text.lower())).items():
        key = b"\0".join((str(seed).encode(), word.encode()))
        h = hashlib.blake2b(key, digest_size=16).digest()
        out[int.from_bytes(h[:8], "big") % dimensions] += (1 if h[8] & 1 else -1) * (1 + math.log(n))
    norm = float(np.linalg.norm(out))
    return out / norm if norm else out
