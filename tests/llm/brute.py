"""Plain versions of the operators' results, for small tables in memory."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

_TOKENIZER = []


def token_ids(text: str | None) -> list[int]:
    if not _TOKENIZER:
        _TOKENIZER.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    return [*_TOKENIZER[0].encode(text or "", add_special_tokens=False).ids, 2]


def crc_of_ids(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def components(nodes: list, links: list[tuple]) -> dict:
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def vector_links(rows: list[tuple[int, list | None]], threshold: float) -> dict[int, tuple[int, int]]:
    units = {}
    for i, v in rows:
        x = np.array([] if v is None or None in v else v, float)
        if len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            x = x / np.abs(x).max()
            units[i] = x / np.linalg.norm(x)
    by_size = defaultdict(list)
    for i, u in units.items():
        by_size[len(u)].append(i)
    links = []
    for ids in by_size.values():
        m = np.stack([units[i] for i in ids])
        a, b = np.nonzero(np.triu(m @ m.T >= threshold, 1))
        links += [(ids[p], ids[q]) for p, q in zip(a, b, strict=True)]
    n = Counter(x for link in links for x in link)
    root = components([i for i, _ in rows], links)
    return {i: (n[i], root[i]) for i, _ in rows}


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text: str | None, words: int = 5) -> set:
    w = _WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard_components(rows: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t)) for i, t in rows]
    holders, links = defaultdict(list), []
    for k, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(k)
    for k, (i, s) in enumerate(sets):
        common = Counter(j for x in s for j in holders[x] if j < k)
        links += [(sets[j][0], i) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j][1]) - n)]
    root = components([i for i, _ in rows], links)
    return {i: (len(s), root[i]) for i, s in sets}


def without_repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    raws = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = {}
    for i, r in raws:
        cut = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if n[r[k : k + length]] > 1:
                cut[k : k + length] = b"\1" * length
        kept = bytes(b for b, c in zip(r, cut, strict=True) if not c)
        spans = len(re.findall(rb"\x01+", bytes(cut)))
        out[i] = (len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def archives(rows: list[tuple[int, str | None]]) -> dict[int, tuple]:
    raws = [(i, (h or "").encode()) for i, h in rows]
    first: dict[bytes, int] = {}
    for i, r in raws:
        first[r] = min(i, first.get(r, i))
    return {i: (len(r), base64.b32encode(hashlib.sha1(r).digest()).decode(), "response" if first[r] == i else "revisit", None if first[r] == i else first[r]) for i, r in raws}


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))


def bins_by_plain_best_fit(lengths: list[int], capacity: int) -> int:
    """Bins that best-fit decreasing opens, each piece looked up among all bins."""
    open_bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(open_bins) if left >= n]
        if fits:
            open_bins[min(fits, key=lambda k: open_bins[k])] -= n
        else:
            open_bins.append(capacity - n)
    return len(open_bins)


def auc(labels: list[int], scores: list[float]) -> float:
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(labels)[order]
    _, start, count = np.unique(s, return_index=True, return_counts=True)
    rank = np.repeat(start + (count + 1) / 2, count)
    n1, n0 = y.sum(), (1 - y).sum()
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
