"""Joining sets by Jaccard similarity through a trie, for sets that fit in one task."""

from __future__ import annotations

import numpy as np

STEP = 64


def joined(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set: the first set of those it is connected with, and the sum of the weights of those it links with.

    Two sets link if 100 * intersection >= percent * union.  ``side``: only sets of different sides are compared.

    Elements are put in a global order, the most frequent first, and the sets, as sorted sequences, form a trie, which
    is walked in preorder: sets in lexicographic order, each entered at the length of the prefix that it shares with
    the one before.  ``overlap`` holds, for the current node, how many elements of its path every set has; a node adds
    one along its element's posting list when it is entered and takes it off when it is left, so paths that are shared
    are counted once.  Below the last branch, a set's own elements are added in steps as long as some earlier set can
    still reach its threshold with all elements that remain.  Elements of one set only, and sets of which too few
    elements are shared, go first.
    """
    m = len(sets)
    label, links = np.arange(m), np.zeros(m, np.int64)
    weight = np.ones(m, np.int64) if weight is None else weight
    size = np.array([len(s) for s in sets], np.int64)
    if m < 2:
        return label, links
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, token = np.unique(flat, return_inverse=True)
    while True:  # elements that two sets share, of sets of which enough are shared
        if not len(token):
            return label, links
        count = np.bincount(token)
        shared = count[token] > 1
        own = np.bincount(owner[shared], minlength=m)
        use = shared & (own * 100 >= percent * size)[owner]
        if use.all():
            break
        token, owner = token[use], owner[use]
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
    token = rank[token]
    by = np.lexsort((token, owner))
    token, owner = token[by], owner[by]
    alive, first = np.unique(owner, return_index=True)
    paths = np.split(token, first[1:])
    order = sorted(range(len(alive)), key=lambda k: paths[k].astype(">u4").tobytes())
    paths, ids = [paths[k] for k in order], alive[order]
    size, n = size[ids], len(ids)
    sides = None if side is None else np.asarray(side)[ids]
    place = np.repeat(np.arange(n), [len(p) for p in paths])
    flat = np.concatenate(paths)
    by = np.argsort(flat, kind="stable")
    ends = np.cumsum(np.bincount(flat))
    postings = np.split(place[by], ends[:-1])

    def common(p: np.ndarray, q: np.ndarray) -> int:
        k = min(len(p), len(q))
        differ = np.flatnonzero(p[:k] != q[:k])
        return int(differ[0]) if len(differ) else k

    overlap, depth, before, path = np.zeros(n, np.int64), 0, 0, np.empty(0, np.int64)
    for k, own in enumerate(paths):
        after = common(own, paths[k + 1]) if k + 1 < n else 0
        for e in path[before:depth]:
            overlap[postings[e]] -= 1
        depth, stay = before, max(before, after)
        for e in own[before:stay]:
            overlap[postings[e]] += 1
        depth, path = stay, own
        if k:
            need = percent * (size[:k] + size[k])
            near = np.flatnonzero(((overlap[:k] + len(own) - stay) * (100 + percent) >= need) & (True if sides is None else sides[:k] != sides[k]))
            at, extra = stay, np.zeros(n, np.int64)
            while len(near) and at < len(own):
                extra += np.bincount(np.concatenate([postings[e] for e in own[at : at + STEP]]), minlength=n)
                at = min(at + STEP, len(own))
                near = near[(overlap[near] + extra[near] + len(own) - at) * (100 + percent) >= need[near]]
            if len(near):
                hit = ids[near]
                links[ids[k]] += weight[hit].sum()
                links[hit] += weight[ids[k]]
                old = np.unique(np.append(label[hit], label[ids[k]]))
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
        before = after
    return label, links
