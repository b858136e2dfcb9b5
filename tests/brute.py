"""Direct, single-machine definitions to compare operators with."""

from collections import deque
from itertools import product

import numpy as np

NEIGHBOURS = [o for o in product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


def components(mask):
    """List of sets of voxels, flood fill over the 26-neighbourhood."""
    left = set(map(tuple, np.argwhere(mask)))
    out = []
    while left:
        start = left.pop()
        part, queue = {start}, deque([start])
        while queue:
            z, y, x = queue.popleft()
            for dz, dy, dx in NEIGHBOURS:
                n = (z + dz, y + dy, x + dx)
                if n in left:
                    left.remove(n)
                    part.add(n)
                    queue.append(n)
        out.append(part)
    return out


def lesions(pred, ref):
    p, r = components(pred), components(ref)
    tp = sum(any(a & b for b in p) for a in r)
    fp = sum(not any(a & b for a in r) for b in p)
    return tp, fp, len(r) - tp


def interior(mask):
    padded = np.pad(mask, 1)
    out = mask.copy()
    for dz, dy, dx in NEIGHBOURS:
        z, y, x = (slice(1 + d, 1 + d + s) for d, s in zip((dz, dy, dx), mask.shape))
        out &= padded[z, y, x]
    return out


def dice(p, r):
    den = p.sum() + r.sum()
    return None if den == 0 else 2 * (p & r).sum() / den


def borders(mask):
    """Dual-grid corners that have both kinds of voxels around them."""
    padded = np.pad(mask, 1).astype(int)
    total = sum(
        padded[a : a + mask.shape[0] + 1, b : b + mask.shape[1] + 1, c : c + mask.shape[2] + 1]
        for a, b, c in product((0, 1), repeat=3)
    )
    return np.argwhere((total > 0) & (total < 8))


def surface_dice(p, r, tolerance):
    if not p.any() and not r.any():
        return None
    a, b = borders(p), borders(r)
    if not len(a) or not len(b):
        return 0.0
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return ((d.min(axis=1) <= tolerance).sum() + (d.min(axis=0) <= tolerance).sum()) / (len(a) + len(b))
