"""The order-dependent learning step of one leaf, in Python (no Spark import)."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass(slots=True)
class Cluster:
    key: int | None  # seq of the record that created it; None if restored
    seed_id: int | None
    texts: list[str]
    lead: str | None
    trail: str | None
    suffix: str | None
    size: int = 0
    created_ms: int | None = None
    updated_ms: int | None = None
    first_ms: int | None = None
    last_ms: int | None = None
    last_used: int = 0
    members: dict[str, None] = field(default_factory=dict)

    def observe(self, seq: int, event_ms: int | None, observed_ms: int | None, member: str | None) -> None:
        self.size += 1
        self.last_used = seq
        if observed_ms is not None:
            self.updated_ms = observed_ms
        if event_ms is not None:
            self.first_ms = event_ms if self.first_ms is None else min(self.first_ms, event_ms)
            self.last_ms = event_ms if self.last_ms is None else max(self.last_ms, event_ms)
        if member is not None:
            self.members[member] = None


class _Index:
    """Finds a leaf's templates that can reach the threshold, without a look at each.

    A line that reaches it differs from the template in at most ``slack`` positions, so of any slack + 1 literal positions of the
    template it agrees in one: each template is listed under that many (position, token) pairs, those with the shortest lists. Templates
    with fewer literals are met by every line. Rows of ``codes`` are the clusters in scan order; the wildcard has code 0.
    """

    def __init__(self, n: int, threshold: float, wildcard: str) -> None:
        self.n, self.slack = n, n - next(m for m in range(n + 1) if m / n >= threshold or m == n)
        self.ids = {wildcard: 0}
        self.codes = np.zeros((64, n), np.int32)
        self.uids: list[int] = []  # by row
        self.rows: dict[int, int] = {}  # by uid
        self.under: dict[int, list[int]] = {}  # positions by uid
        self.lists: dict[tuple[int, int], dict[int, None]] = {}
        self.always: dict[int, None] = {}
        self.made = 0

    def append(self, texts: list[str]) -> None:
        row, uid = len(self.uids), self.made
        self.made += 1
        if row == len(self.codes):
            self.codes = np.concatenate([self.codes, np.zeros_like(self.codes)])
        self.codes[row] = [self.ids.setdefault(t, len(self.ids)) for t in texts]
        self.uids.append(uid)
        self.rows[uid], self.under[uid] = row, []
        self._cover(uid, self.codes[row].tolist())

    def _cover(self, uid: int, codes: list[int]) -> None:
        held = self.under[uid]
        if len(held) <= self.slack:
            free = [p for p in range(self.n) if codes[p] and p not in held]
            free.sort(key=lambda p: len(self.lists.get((p, codes[p]), ())))
            for p in free[: self.slack + 1 - len(held)]:
                self.lists.setdefault((p, codes[p]), {})[uid] = None
                held.append(p)
        if len(held) <= self.slack:
            self.always[uid] = None

    def _unlist(self, uid: int, position: int, code: int) -> None:
        at = self.lists[position, code]
        del at[uid]
        if not at:
            del self.lists[position, code]

    def generalize(self, row: int, texts: list[str]) -> None:
        uid, old = self.uids[row], self.codes[row].tolist()
        new = [self.ids[t] for t in texts]
        for p in [p for p in self.under[uid] if not new[p]]:
            self._unlist(uid, p, old[p])
            self.under[uid].remove(p)
        self.codes[row] = new
        self._cover(uid, new)

    def remove(self, row: int) -> None:
        """The last row takes its place."""
        uid, codes = self.uids[row], self.codes[row].tolist()
        for p in self.under.pop(uid):
            self._unlist(uid, p, codes[p])
        self.always.pop(uid, None)
        del self.rows[uid]
        last = self.uids.pop()
        if last != uid:
            self.codes[row] = self.codes[len(self.uids)]
            self.uids[row], self.rows[last] = last, row

    def best(self, texts: list[str]) -> tuple[int | None, float]:
        """Row and similarity of the most similar template, the earliest on ties; exact if any reaches the threshold."""
        x = [self.ids.get(t, -1) for t in texts]
        lists = [at for k in enumerate(x) if (at := self.lists.get(k))]
        size = len(self.uids)
        if sum(map(len, lists)) + len(self.always) > size // 4:
            rows, codes = None, self.codes[:size]
        else:
            rows = sorted(self.rows[u] for u in set(self.always).union(*lists))
            if not rows:
                return None, -1.0
            codes = self.codes[rows]
        hits = ((codes == np.array(x, np.int32)) | (codes == 0)).sum(1)
        k = int(hits.argmax())
        return (k if rows is None else rows[k]), int(hits[k]) / self.n


class LeafFold:
    """Clusters of a leaf in scan order.

    A memo from token vector to cluster holds until a template changes or a cluster goes: repeats of a known vector then need no
    scan. It is cleared at MEMO entries, so memory follows the number of templates and not the number of records. Beyond SCAN clusters
    an index takes the place of the scan.
    """

    MEMO = 100_000
    SCAN = 24

    def __init__(self, threshold: float, cap: int, wildcard: str) -> None:
        self.threshold, self.cap, self.wildcard = threshold, cap, wildcard
        self.clusters: list[Cluster] = []
        self.memo: dict[str, Cluster] = {}
        self.index: _Index | None = None

    def seed(self, c: Cluster) -> None:
        if len(self.clusters) >= self.cap:
            self._evict()
        self.put(c)

    def put(self, c: Cluster) -> None:
        self.clusters.append(c)
        if self.index is not None:
            self.index.append(c.texts)
        elif len(self.clusters) > self.SCAN and c.texts:
            self.index = _Index(len(c.texts), self.threshold, self.wildcard)
            for x in self.clusters:
                self.index.append(x.texts)

    def _evict(self) -> None:
        at = min(range(len(self.clusters)), key=lambda i: self.clusters[i].last_used)
        self.clusters[at] = self.clusters[-1]
        self.clusters.pop()
        if self.index is not None:
            self.index.remove(at)
        self.memo.clear()

    def best(self, texts: list[str]) -> tuple[int | None, float]:
        """Place and similarity of the most similar cluster, the earliest on ties; exact if any reaches the threshold."""
        if self.index is not None:
            return self.index.best(texts)
        n, w, top, best = len(texts), self.wildcard, -1.0, None
        for i, c in enumerate(self.clusters):
            sim = sum(a == b or a == w for a, b in zip(c.texts, texts)) / n if n else 1.0
            if sim > top:
                top, best = sim, i
                if sim == 1.0:
                    break
        return best, top

    def add(self, vec: str, texts: list[str], seq: int, *, lead: str | None = None, trail: str | None = None, suffix: str | None = None, event_ms: int | None = None, observed_ms: int | None = None, member: str | None = None) -> tuple[Cluster, str]:
        c = self.memo.get(vec)
        if c is not None:
            c.observe(seq, event_ms, observed_ms, member)
            return c, "None"
        at, sim = self.best(texts)
        if at is not None and sim >= self.threshold:
            c, w = self.clusters[at], self.wildcard
            new = [a if a == b or a == w else w for a, b in zip(c.texts, texts)]
            update = "None"
            if new != c.texts:
                c.texts, update = new, "TemplateChanged"
                if self.index is not None:
                    self.index.generalize(at, new)
                self.memo.clear()
        else:
            if len(self.clusters) >= self.cap:
                self._evict()
            c = Cluster(seq, None, list(texts), lead, trail, suffix, created_ms=observed_ms, updated_ms=observed_ms)
            self.put(c)
            update = "Created"
        c.observe(seq, event_ms, observed_ms, member)
        if len(self.memo) >= self.MEMO:
            self.memo.clear()
        self.memo[vec] = c
        return c, update

    #: Rows that a settled leaf must have waiting, rows that show whether it has settled, the changes they may have, and literals compared a row at most.
    BLOCK, TRIAL, CHANGES, WORK = 64, 256, 4, 4000
    settled = False

    def _holds(self, c: Cluster, codes: np.ndarray, ids: dict[str, int]) -> np.ndarray:
        """Rows that the template matches in every position."""
        out = np.ones(codes.shape[1], bool)
        for k, t in enumerate(c.texts):
            if t != self.wildcard:
                out &= codes[k] == ids.get(t, -1)
        return out

    def _first(self, codes: np.ndarray, ids: dict[str, int]) -> np.ndarray:
        """By row the first template that matches in every position, or -1."""
        who = np.full(codes.shape[1], -1)
        for at, c in enumerate(self.clusters):
            who[(who < 0) & self._holds(c, codes, ids)] = at
        return who

    def _observe_all(self, who: np.ndarray, start: int, seq: np.ndarray, cols: dict[str, pa.Array], size: np.ndarray) -> None:
        """``observe`` for rows from START on, whose templates don't change."""
        for at in np.unique(who):
            c, rows = self.clusters[at], np.flatnonzero(who == at) + start
            size[rows] = c.size + np.arange(1, len(rows) + 1)
            c.size, c.last_used = c.size + len(rows), int(seq[rows[-1]])
            pick = {k: x.take(pa.array(rows)).drop_null() for k, x in cols.items() if k in ("event_ms", "observed_ms", "member") and x.null_count < len(x)}
            if len(x := pick.get("observed_ms", ())):
                c.updated_ms = x[-1].as_py()
            if len(x := pick.get("event_ms", ())):
                low, high = pc.min_max(x).values()
                c.first_ms = low.as_py() if c.first_ms is None else min(c.first_ms, low.as_py())
                c.last_ms = high.as_py() if c.last_ms is None else max(c.last_ms, high.as_py())
            if len(x := pick.get("member", ())):
                c.members.update(dict.fromkeys(x.unique().to_pylist()))

    def add_block(self, n: int, cols: dict[str, pa.Array]) -> tuple[list, list, list, np.ndarray, list]:
        """``add`` for many rows of N tokens in order: by row key, seed_id, update, and size and texts (joined) after it.

        cols: seq, vec, lead, trail, suffix, event_ms, observed_ms, member. A row that a template matches in every position changes
        none, and as the greatest similarity goes to the first of equals, the first such template has it. In a leaf that changes
        seldom such rows are taken all at once, up to the next row that none matches so; that one goes through ``add``.
        """
        total, seq = len(cols["seq"]), cols["seq"].to_numpy()
        keys, seeds, updates, size, texts = [], [], [], np.zeros(total, np.int64), []
        plain = codes = None
        i = 0

        def one(i: int) -> tuple[Cluster, str]:
            nonlocal plain
            if plain is None:
                plain = {k: [None] * total if x.null_count == total else x.to_pylist() for k, x in cols.items() if k not in ("seq", "vec")}
            vec = cols["vec"][i].as_py()
            c, update = self.add(vec, vec.split(" ") if n else [], int(seq[i]), **{k: x[i] for k, x in plain.items()})
            keys.append(c.key), seeds.append(c.seed_id), updates.append(update), texts.append(" ".join(c.texts))
            size[i] = c.size
            return c, update

        while i < total:
            if not self.settled or total - i < self.BLOCK or not n or len(self.clusters) * n > self.WORK:
                trial = range(i, min(total, i + self.TRIAL))
                changes = sum(one(k)[1] != "None" for k in trial)
                self.settled = changes <= self.CHANGES
                i = trial.stop
                continue
            if codes is None:
                flat = pc.split_pattern(cols["vec"], " ").flatten().dictionary_encode()
                codes = flat.indices.to_numpy().reshape(total, n).T.copy()
                ids = {t: k for k, t in enumerate(flat.dictionary.to_pylist())}
            who, start, loud = self._first(codes[:, i:], ids), i, 0
            while i < total:
                open_rows = np.flatnonzero(who[i - start :] < 0)
                stop = i + int(open_rows[0]) if len(open_rows) else total
                if stop > i:
                    part = who[i - start : stop - start]
                    self._observe_all(part, i, seq, cols, size)
                    for out, of in ((keys, [c.key for c in self.clusters]), (seeds, [c.seed_id for c in self.clusters]), (texts, [" ".join(c.texts) for c in self.clusters])):
                        out.extend(map(of.__getitem__, part.tolist()))
                    updates.extend(["None"] * len(part))
                    i = stop
                if i == total:
                    break
                held = len(self.clusters)
                c, update = one(i)
                i, loud = i + 1, loud + 1
                if update == "None":
                    continue
                if loud > self.CHANGES * max(1, total // self.TRIAL):
                    self.settled = False
                    break
                rest = who[i - start :]
                if update == "Created" and len(self.clusters) == held:  # one was evicted
                    rest[:] = self._first(codes[:, i:], ids)
                else:
                    at = next(k for k, x in enumerate(self.clusters) if x is c)
                    rest[self._holds(c, codes[:, i:], ids) & ((rest < 0) | (rest > at))] = at
        return keys, seeds, updates, size, texts
