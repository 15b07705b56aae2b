"""All pairs of token sequences within the edit distance of a near duplicate, without pairs of shingles.

Two sequences of at most ``n`` tokens within distance ``k`` share all but ``k``
tokens of the longer one, so the ``k + 1`` rarest tokens of each have one in
common.  Only these are keys of the shuffle; pairs are made, checked and given
out inside one task and never shuffled, so the disk in use grows with the
variants and not with their pairs.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens are counted by hash. What shares a number only looks more frequent: any order finds all pairs, rare first finds them sooner.
WEIGHTS = 1 << 18
#: A key with more rows is split into parts; each two parts meet in a group of their own.
PART = 20_000
#: Pairs looked at in one step, and pairs a task should make about.
BLOCK, TASK = 1 << 20, 400_000_000
#: A key of so many rows is gone through by tiles of so many pairs, which fit the cache, and of so many columns.
LARGE, TILE, COLUMNS = 64, 1 << 15, 1 << 13
#: Factors by which tokens are hashed to bits.
WAYS = (2654435769, 2246822519, 3266489917, 668265263)
#: The bit of all keys that have none of their own.
LAST = np.uint64(1 << 63)
#: Lists travel as text, which a row holds in a third of the bytes: tokens joined, and small numbers (side, place of the
#: key, places of all keys in the tokens) as characters.
SEP = "\x1f"
_COLUMNS = ("key", "places", "variant_id", "seen_at", "tokens")
_PAIR = pa.schema([("left_id", pa.string()), ("right_id", pa.string()), ("longest", pa.int32()), ("d", pa.int32())])


def most_edits(n: int) -> int:
    """Edits that near duplicates of which the longer has ``n`` tokens may differ by."""
    return int(n * (1 - (2 / 3 if n <= 3 else 0.7 if n <= 5 else 0.74)) + 1e-9)


def _copies(tokens: list[str]) -> list[int]:
    """How often each token stood before."""
    seen: dict[str, int] = {}
    out = []
    for t in tokens:
        out.append(seen.get(t, 0))
        seen[t] = out[-1] + 1
    return out


def _keyed(v: DataFrame, weights: np.ndarray, heavy: dict[str, int], narrow: bool) -> DataFrame:
    """A row per variant and key; with ``narrow``, keys and how many variants of a batch have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[str] = Counter()
            keys: list[str] = []
            places: list[str] = []
            rows: list[int] = []
            hashes = b.column("hashes")
            rarity, ends = weights[hashes.flatten().to_numpy()].tolist(), np.cumsum(pc.list_value_length(hashes).to_numpy()).tolist()
            for r, (vid, joined, end) in enumerate(zip(b.column("variant_id").to_pylist(), b.column("tokens").to_pylist(), ends)):
                tokens = joined.split(SEP)
                n = len(tokens)
                copies = _copies(tokens) if len(set(tokens)) < n else [0] * n
                best = [x[3] for x in sorted(zip(rarity[end - n : end], tokens, copies, range(n)))[: most_edits(n) + 1]]
                if narrow:
                    found.update(f"{copies[p]} {tokens[p]}" for p in best)
                    continue
                chosen = "".join(map(chr, best))
                for k, p in enumerate(best):
                    key = f"{copies[p]} {tokens[p]}"
                    parts = heavy.get(key, 1)
                    own = zlib.crc32(vid.encode()) % parts
                    for other in range(parts):
                        keys.append(key if parts == 1 else f"{key}{SEP}{min(own, other)} {max(own, other)}")
                        places.append(chr(0 if own == other else 1 if own < other else 2) + chr(k) + chosen)
                        rows.append(r)
            if narrow:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["key", "n"])
                continue
            for s in range(0, len(rows), 10_000):
                cut = slice(s, s + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut], pa.string()), pa.array(places[cut], pa.string()), *b.select(_COLUMNS[2:]).take(pa.array(rows[cut], pa.int64())).columns], _COLUMNS)

    hashed = v.select("variant_id", "seen_at", F.array_join("tokens", SEP).alias("tokens"), F.transform("tokens", _number).alias("hashes"))
    kinds = dict.fromkeys(_COLUMNS, "string") | {"seen_at": v.schema["seen_at"].dataType.simpleString()}
    return hashed.mapInArrow(run, "key string, n long" if narrow else ", ".join(f"{c} {kinds[c]}" for c in _COLUMNS))


def _number(t):
    return F.pmod(F.hash(t), F.lit(WEIGHTS))


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by key, cut where a key ends."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("key")
        start = pc.index(keys, keys[-1]).as_py()
        if start:
            yield pa.Table.from_batches([*held, b.slice(0, start)])
            held = [b.slice(start)]
        elif held and held[0].column("key")[0] != keys[0]:
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _distances(a: np.ndarray, b: np.ndarray, longer: np.ndarray, lacking: int, k: int) -> np.ndarray:
    """Edit distances of columns of ``a`` and ``b`` (padded, ``longer`` long, those of ``a`` shorter by ``lacking``); any number above ``k`` beyond ``k``.

    Within ``k`` edits the places of equal tokens are at most ``lacking`` and half of the other edits apart.
    """
    n, width = b.shape
    kind = np.int8 if n < 100 else np.int16
    ahead = (k - lacking) // 2
    band = lacking + 2 * ahead + 1
    far = np.full(width, k + 1, kind)
    row = [far if o < lacking + ahead else np.full(width, o - lacking - ahead, kind) for o in range(band)]
    out = np.zeros(width, np.int16)
    for i in range(1, n + 1):
        new: list[np.ndarray] = []
        for o in range(band):
            j = i + o - lacking - ahead
            if j < 0 or j > n:
                cell = far
            elif j == 0:
                cell = np.full(width, i, kind)
            else:
                cell = row[o] + (b[i - 1] != a[j - 1])
                if o < band - 1:
                    np.minimum(cell, row[o + 1] + kind(1), out=cell)
                if o:
                    np.minimum(cell, new[o - 1] + kind(1), out=cell)
            new.append(cell)
        row = new
        ends = longer == i
        out[ends] = row[ahead][ends]
    return out


def _numbers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers in columns (0 beyond the end), and how many each text has."""
    held = pc.utf8_length(texts).to_numpy().astype(np.int64)
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(len(held)), held)
    out = np.zeros((int(held.max()), len(held)), np.int64)
    out[np.arange(len(flat)) - (np.cumsum(held) - held)[rows], rows] = flat
    return out, held


def _gathered(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs in larger steps."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for part in parts:
        held.append(part)
        waiting += len(part[0])
        if waiting >= BLOCK // 4:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, waiting = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


class _Group:
    """Variants of some keys as numbers."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        key = t["key"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        tokens = pc.split_pattern(t["tokens"].combine_chunks(), SEP)
        size = pc.list_value_length(tokens).to_numpy().astype(np.int64)
        order = np.lexsort((size, key))
        t = t.take(pa.array(order))
        self.key, self.size = key[order], size[order]
        self.ids = t["variant_id"].combine_chunks()
        self.seen = pc.rank(t["seen_at"].combine_chunks(), tiebreaker="dense").to_numpy()
        flat = pc.list_flatten(tokens.take(pa.array(order))).dictionary_encode().indices.to_numpy().astype(np.int32)
        n, self.width = len(order), int(self.size.max())
        ends = np.cumsum(self.size)
        starts = ends - self.size
        rows = np.repeat(np.arange(n), self.size)
        self.codes = np.full((self.width, n), -1, np.int32)
        self.codes[np.arange(len(flat)) - starts[rows], rows] = flat
        # Each token sets a bit, and one more in each other way; what two sequences lack of each other shows in most of them.
        ways = [flat & 63, *((flat.astype(np.uint32) * np.uint32(x)) >> 26 for x in WAYS)]
        bits = [np.bitwise_or.reduceat(np.left_shift(np.uint64(1), x.astype(np.uint64)), starts) for x in ways]
        self.marks = [(x, np.bitwise_count(x).astype(np.int8)) for x in bits]
        self.bits, self.ones = self.marks[0]
        # The keys a variant stands under, as numbers of token and copy, in the order all variants share.
        places, held = _numbers(t["places"].combine_chunks())
        self.side, self.at = places[0], places[1]
        self.prefix = np.full((len(places) - 2, n), -1, np.int64)
        repeats = np.max([ones for _, ones in self.marks], axis=0) < self.size
        for x in range(len(self.prefix)):
            r = np.flatnonzero(held > x + 2)
            at = places[x + 2, r]
            own = self.codes[at, r]
            self.prefix[x, r] = own.astype(np.int64) * self.width
            again = np.flatnonzero(repeats[r])
            r, at, own = r[again], at[again], own[again]
            self.prefix[x, r] += ((self.codes[:, r] == own) & (np.arange(self.width)[:, None] < at)).sum(0)
        edits = np.array([most_edits(x) for x in range(2 * self.width + 2)])
        self.edits = edits[: self.width + 1].astype(np.int16)
        self.most = self.edits.astype(np.int8)[self.size]
        # The longest that a sequence may be paired with.
        self.reach = np.array([max(y for y in range(x, self.width + 1) if y - edits[y] <= x) for x in range(self.width + 1)])

    def shingles(self, r: int) -> set:
        own = self.codes[: self.size[r], r].tolist()
        return set(own) if len(own) <= 3 else set(zip(own, own[1:]))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(shorter, longer) rows of one key whose tokens may be alike enough, each pair under its first common key only."""
        ends = np.flatnonzero(np.diff(self.key, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        large = ends - starts >= LARGE
        yield from self._of_small(np.repeat(~large, ends - starts))
        yield from _gathered(x for a, b in zip(starts[large].tolist(), ends[large].tolist()) for x in self._of_large(a, b))

    def _of_small(self, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the rows marked in ``some``, of many keys at once."""
        n = len(self.key)
        place = self.key * (self.width + 1) + self.size
        ends = np.searchsorted(place, self.key * (self.width + 1) + self.reach[self.size], side="right")
        count = np.where(some, ends - np.arange(n) - 1, 0)
        before = np.concatenate([[0], np.cumsum(count)])
        r0 = 0
        while r0 < n:
            r1 = max(r0 + 1, int(np.searchsorted(before, before[r0] + BLOCK, side="right")) - 1)
            i = np.repeat(np.arange(r0, r1), count[r0:r1])
            j = np.arange(before[r0], before[r1]) - (before[:-1] - np.arange(n) - 1)[i]
            x, y, k = self.bits[i], self.bits[j], self.edits[self.size[j]]
            ok = np.flatnonzero((np.bitwise_count(x & ~y) <= k) & (np.bitwise_count(y & ~x) <= k))
            i, j = i[ok], j[ok]
            ok = np.flatnonzero(((self.side[i] == 0) | (self.side[i] != self.side[j])) & ((self.size[i] <= 3) == (self.size[j] <= 3)))
            i, j = self._first(*self._closer(i[ok], j[ok]))
            if len(i):
                yield i, j
            r0 = r1

    def _of_large(self, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the rows ``a`` to ``b`` of one key, tile by tile."""
        early = self._early(a, b)
        lots = [a + np.flatnonzero(self.side[a:b] == s) for s in np.unique(self.side[a:b])]
        if len(lots) == 1 and self.side[a]:
            return
        for i, j in _gathered(self._tiles(lots[0], lots[-1])):
            i, j = self._once(i, j, early, a)
            if len(i):
                yield i, j

    def _once(self, i: np.ndarray, j: np.ndarray, early: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray]:
        i, j = self._closer(i, j)
        both = early[i - a] & early[j - a]
        ok = np.flatnonzero(both & ~LAST == 0)
        i, j, unsure = i[ok], j[ok], both[ok] != 0
        if unsure.any():
            i, j = (np.concatenate(x) for x in zip((i[~unsure], j[~unsure]), self._first(i[unsure], j[unsure])))
        return i, j

    def _tiles(self, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of one and of the other (each by size; the same ones: each two once) whose bits differ by few."""
        same = one is two
        runs = [[(int(n), *np.searchsorted(self.size[x], [n, n + 1]).tolist()) for n in np.unique(self.size[x])] for x in (one, two)]
        x_bits, y_bits = self.bits[one], self.bits[two]
        x_ones, y_ones = self.ones[one], self.ones[two]
        rooms = [np.empty(TILE, kind) for kind in (np.uint64, np.int8, np.int8, bool)]
        for m, a0, a1 in runs[0]:
            for n, b0, b1 in runs[1]:
                short, long = min(m, n), max(m, n)
                if (same and m > n) or long > self.reach[short] or (m <= 3) != (n <= 3):
                    continue
                k = np.int8(self.edits[long])
                for c0 in range(b0, b1, COLUMNS):
                    c1 = min(b1, c0 + COLUMNS)
                    y, y_least = y_bits[c0:c1], y_ones[c0:c1] - k
                    step = max(1, TILE // (c1 - c0))
                    # Of two runs that are one, only what stands behind the row.
                    for r0 in range(a0, min(a1, c1) if same and m == n else a1, step):
                        r1 = min(a1, r0 + step)
                        shape = (r1 - r0, c1 - c0)
                        both, common, least, ok = (room[: shape[0] * shape[1]].reshape(shape) for room in rooms)
                        np.bitwise_and(x_bits[r0:r1, None], y, out=both)
                        np.bitwise_count(both, out=common.view(np.uint8))
                        np.maximum((x_ones[r0:r1] - k)[:, None], y_least, out=least)
                        at = np.flatnonzero(np.greater_equal(common, least, out=ok))
                        if not len(at):
                            continue
                        r, c = np.divmod(at.astype(np.int32), np.int32(c1 - c0))
                        r += r0
                        c += c0
                        if same and m == n and r1 > c0:
                            ok = r < c
                            r, c = r[ok], c[ok]
                        yield (one[r], two[c]) if m <= n else (two[c], one[r])

    def _closer(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those seen at different times whose other bits differ by few, too."""
        k = self.most.take(j)
        for bits, ones in self.marks[1:]:
            ok = np.flatnonzero(self._missing(bits, ones, i, j) <= k)
            i, j, k = i[ok], j[ok], k[ok]
        ok = self.seen.take(i) != self.seen.take(j)
        return (i, j) if ok.all() else (i[ok], j[ok])

    def _early(self, a: int, b: int) -> np.ndarray:
        """The keys before this one of each row as bits: one for each of the commonest, LAST for all others."""
        early = np.where(np.arange(len(self.prefix))[:, None] < self.at[a:b], self.prefix[:, a:b], -1)
        keys, place, n = np.unique(early, return_inverse=True, return_counts=True)
        bit = np.full(len(keys), LAST)
        best = np.argsort(-np.where(keys < 0, 0, n), kind="stable")[:63]
        bit[best] = np.left_shift(np.uint64(1), np.arange(len(best), dtype=np.uint64))
        bit[(keys < 0) | (n < 2)] = 0
        return np.bitwise_or.reduce(bit[place.reshape(early.shape)], axis=0)

    def _first(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those without a common key before the one they stand under."""
        for c in range(len(self.prefix) - 1):
            late = np.flatnonzero(self.at[i] > c)
            if len(late):
                own, theirs = self.prefix[c, i[late]], j[late]
                gone = np.zeros(len(late), bool)
                for p in self.prefix:
                    gone |= own == p[theirs]
                keep = np.ones(len(i), bool)
                keep[late[gone]] = False
                i, j = i[keep], j[keep]
        return i, j

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edit distances of shorter and longer rows; any number above the most edits beyond those."""
        d = np.empty(len(i), np.int16)
        sure = np.empty(len(i), bool)
        sizes = self.size.take(j) * (self.width + 1) + self.size.take(i)
        for both in np.flatnonzero(np.bincount(sizes)).tolist():
            n, m = divmod(both, self.width + 1)
            some = np.flatnonzero(sizes == both)
            for s in range(0, len(some), BLOCK // 8):
                o = some[s : s + BLOCK // 8]
                d[o], sure[o] = self._bounds(i[o], j[o], m, n)
        rest = np.flatnonzero(~sure)
        longer = self.size[j[rest]]
        lacking, edits = longer - self.size[i[rest]], self.edits[longer]
        kinds = edits.astype(np.int64) * (self.width + 1) + lacking
        for both in np.flatnonzero(np.bincount(kinds)).tolist():
            k, g = divmod(both, self.width + 1)
            some = np.flatnonzero(kinds == both)
            for s in range(0, len(some), BLOCK // 8):
                o = rest[some[s : s + BLOCK // 8]]
                n = longer[some[s : s + BLOCK // 8]]
                d[o] = _distances(*(self.codes[: n.max()].take(x[o], axis=1) for x in (i, j)), n, g, k)
        return d

    def _bounds(self, i: np.ndarray, j: np.ndarray, m: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Edits that are enough, and whether no fewer are, of rows with ``m`` and ``n`` tokens."""
        a, b = (self.codes[:n].take(x, axis=1) for x in (i, j))
        # Tokens that differ place by place, from the front up to the best place and from the back behind it, with the gap
        # between them, are as many edits as surely do.
        enough = np.full(len(i), n - m, np.int16)
        if m == n:
            for p in range(m):
                enough += a[p] != b[p]
        else:
            ahead, best = np.zeros((2, len(i)), np.int16)
            for p in range(m):
                behind = a[p] != b[p + n - m]
                enough += behind
                ahead += a[p] != b[p]
                ahead -= behind
                np.minimum(best, ahead, out=best)
            enough += best
        # No fewer will do than tokens are missing; of equal lengths, two are the fewest where two places differ, as a shift takes two.
        sure = enough <= (2 if m == n else n - m)
        rest = np.flatnonzero(~sure)
        least = np.max([self._missing(bits, ones, i[rest], j[rest]) for bits, ones in self.marks], axis=0)
        sure[rest] = enough[rest] <= least
        return enough, sure

    def _missing(self, bits: np.ndarray, ones: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.maximum(ones.take(i), ones.take(j)) - np.bitwise_count(bits.take(i) & bits.take(j)).view(np.int8)

    def similar(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(left, right, distance) of all near duplicates; the left one was seen first."""
        distinct = np.full(len(self.key), -1)
        for i, j in self.candidates():
            d = self.distances(i, j)
            ok = np.flatnonzero(d <= self.most.take(j))
            i, j, d = i[ok], j[ok], d[ok]
            # An edit takes two shingles at most; where that may leave too few, they are counted. There are as many as
            # different tokens, but for one.
            least = np.where(self.size.take(i) <= 4, 1, 2)
            few = np.flatnonzero(np.maximum(self.ones.take(i), self.ones.take(j)) - 1 - 2 * d < least)
            new = np.unique(np.concatenate([i[few], j[few]]))
            new = new[distinct[new] < 0]
            distinct[new] = [len(self.shingles(r)) for r in new]
            few = few[np.maximum(distinct[i[few]], distinct[j[few]]) - 2 * d[few] < least[few]]
            if len(few):
                ok = np.ones(len(i), bool)
                ok[few] = [len(self.shingles(i[x]) & self.shingles(j[x])) >= least[x] for x in few]
                i, j, d = i[ok], j[ok], d[ok]
            first = self.seen.take(i) < self.seen.take(j)
            yield np.where(first, i, j), np.where(first, j, i), d


def _tasks(v: DataFrame, part: int, batch: Callable, schema: str) -> DataFrame:
    """What ``batch`` makes of (left ids, right ids, longest, distance) of all pairs, a step of a task at a time."""
    spark = v.sparkSession
    v = v.where(F.size("tokens") > 0)
    counts = v.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy(_number(F.col("t")).alias("h")).agg(F.count("*").alias("n")).toPandas()
    weights = np.zeros(WEIGHTS, np.int64)
    weights[counts.h.to_numpy(np.int64)] = counts.n.to_numpy(np.int64)
    sizes = _keyed(v, weights, {}, True).groupBy("key").agg(F.sum("n").alias("n"))
    # Comes to the driver: two figures, and the keys of more than ``part`` rows.
    big = F.when(F.col("n") > part, F.struct("key", "n"))
    sums = sizes.agg(F.sum(F.col("n") * F.col("n") / 2).alias("pairs"), F.collect_list(big).alias("heavy")).first()
    heavy = {r.key: -(-r.n // part) for r in sums.heavy}
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, int((sums.pairs or 0) // TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            g = _Group(t)
            for left, right, d in g.similar():
                for s in range(0, len(d), 50_000):
                    x, y = left[s : s + 50_000], right[s : s + 50_000]
                    yield batch(g.ids.take(pa.array(x)), g.ids.take(pa.array(y)), np.maximum(g.size[x], g.size[y]), d[s : s + 50_000])

    return _keyed(v, weights, heavy, False).repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def similar(v: DataFrame, part: int = PART) -> DataFrame:
    """v(variant_id, tokens, seen_at) -> (left_id, right_id, longest, d): all pairs that share shingles enough, within ``most_edits``."""
    return _tasks(v, part, lambda x, y, n, d: pa.RecordBatch.from_arrays([x, y, pa.array(n, pa.int32()), pa.array(d, pa.int32())], schema=_PAIR), "left_id string, right_id string, longest int, d int")


def scored(v: DataFrame, part: int = PART) -> DataFrame:
    """The same pairs as (left_id, right_id, similarity): 1 - d / longest to six digits, looked up, as rounding billions of rows takes the JVM long."""
    score = lambda d, n: float(Decimal(repr(1 - d / n)).quantize(Decimal("0.000001"), ROUND_HALF_UP))

    def batch(x: pa.Array, y: pa.Array, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        width = int(n.max()) + 1
        place = n * width + d
        used = np.flatnonzero(np.bincount(place))
        table = np.zeros(used[-1] + 1)
        table[used] = [score(int(p) % width, int(p) // width) for p in used]
        return pa.RecordBatch.from_arrays([x, y, pa.array(table[place])], ["left_id", "right_id", "similarity"])

    return _tasks(v, part, batch, "left_id string, right_id string, similarity double")
