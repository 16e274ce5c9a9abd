"""Candidate pairs from lists of rows that share a key, and the components that their links make.

Rows are (key, id, facts). Their facts tell whether two rows are near, so that a link is possible;
what is near is verified by the caller. Only connectivity is wanted:

* Keys are dealt as sorted arrays, not as rows: a task writes one array for each part of the key
  space. A part's lists are looked at in memory. Of lists of at most FEW rows all near pairs are
  passed on; of longer ones the rows that are near another, each with the nearest one before it.
* These pairs are verified. What links is components. Then, in the longer lists, near pairs of
  different components meet: the nearest of each row first, in a few rounds, then all. If the caller
  can decide a link from a row's own column, these are decided where they meet, and only links leave.

So a group of copies costs a few checks for each member, not one for each pair, and no near pair of
two components stays unseen. Lists of more than LIST rows are not gathered in one task: their rows
go on, and meet in cells of SQUARE by SQUARE rows, some cells after the other, as all would be on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cells_of_pairs, components
from .kernels import mix, order_of
from .util import Sieve, discard, lean, stash

#: Records that a task gathers before it writes them out, or before it looks for lists that are too long.
FLUSH = 1 << 19
#: Lists of more rows than this are passed on without a look at their pairs.
LIST = 4096
#: All pairs of lists of at most so many rows are passed on as pairs.
FEW = 16
#: Lists of more rows than this are looked at one by one, TILE rows against all.
SHORT, TILE = 64, 256
#: Rounds that look for the nearest of each row, before all pairs that are left meet; fewer, if under
#: one in WORTH of a round's pairs links.
ROUNDS, WORTH = 3, 4
#: So many of a row's smallest keys go with it, so that few pairs are made in two lists.
FIRST = [f"first{i}" for i in range(4)]
#: So many pairs are decided before those of what they connect are left out.
CHECKED = 1 << 12
#: Parts of the key space for each task that reads them.
PARTS = 4
#: Bytes of rows sorted by key that are looked at together: many small batches cost more than their rows.
GATHER = 1 << 21
#: Apart by more than any two near rows.
FAR = 1 << 30

Facts = dict[str, np.ndarray]
#: A column, and whether rows i and j of its values link.
Decide = tuple[str, Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class Nearness:
    """facts: their names and numpy kinds. near and apart: from facts and two arrays of row numbers,
    whether each two rows may link, and how far apart they are."""

    facts: dict[str, str]
    near: Callable[[Facts, np.ndarray, np.ndarray], np.ndarray]
    apart: Callable[[Facts, np.ndarray, np.ndarray], np.ndarray]

    def columns(self) -> str:
        return ", ".join(f"{name} {'long' if np.dtype(kind).itemsize == 8 else 'int'}" for name, kind in self.facts.items())

    def arrow(self, facts: Facts, at: np.ndarray) -> list[pa.Array]:
        return [pa.array(facts[name][at].view(np.int64) if np.dtype(kind).itemsize == 8 else facts[name][at].astype(np.int32)) for name, kind in self.facts.items()]

    def numpy(self, columns: dict[str, np.ndarray]) -> Facts:
        return {name: columns[name].view(kind) if np.dtype(kind).itemsize == 8 else columns[name].astype(kind) for name, kind in self.facts.items()}


def _sorted(key: np.ndarray, id_: np.ndarray, facts: Facts, alone: bool = True) -> tuple[np.ndarray, np.ndarray, Facts]:
    """Rows ordered by key, equal ones once; key has 64 bits, of which the upper 40 order rows. alone: also rows whose key no other has."""
    both = (key & ~np.uint64(0xFFFFFF)) | (id_.view(np.uint64) >> np.uint64(40))
    order = order_of(both)
    if not alone:
        both = both[order] >> np.uint64(24)
        same = both[1:] == both[:-1]
        order = order[np.append(same, False) | np.append(False, same)]
    key, id_, facts = key[order], id_[order], {c: x[order] for c, x in facts.items()}
    new = np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in (key, id_, *facts.values())], axis=0))) if len(key) else order
    return key[new], id_[new], {c: x[new] for c, x in facts.items()}


class Dealer:
    """Gathers records of a task and deals them: part, n and the n records of a part, as arrays one behind the other."""

    KIND = "part int, n int, blob binary"

    def __init__(self, kind: Nearness, parts: int):
        self.kind, self.parts = kind, parts
        self.held: list[tuple[np.ndarray, np.ndarray, Facts]] = []

    def add(self, key: np.ndarray, id_: np.ndarray, facts: Facts) -> Iterator[pa.RecordBatch]:
        if len(key):
            self.held.append((key, id_, facts))
        if sum(len(h[0]) for h in self.held) >= FLUSH:
            yield from self.finish()

    def finish(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, id_ = (np.concatenate([h[k] for h in self.held]) for k in (0, 1))
        key, id_, facts = _sorted(key, id_, {c: np.concatenate([h[2][c] for h in self.held]) for c in self.kind.facts})
        self.held = []
        part = ((key >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(key))
        arrays = [key.astype("<u4"), id_, *[facts[c].astype(kind) for c, kind in self.kind.facts.items()]]
        blobs = [b"".join(x[a:b].tobytes() for x in arrays) for a, b in zip(cut, cut[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array(np.diff(cut), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "n", "blob"])


def undealt(kind: Nearness, n: int, raw: bytes) -> tuple[np.ndarray, np.ndarray, Facts]:
    """The records of a blob that a Dealer made: lower halves of keys, ids, facts."""
    at, record = 0, {}
    for name, form in {"key": "<u4", "id": "<i8", **kind.facts}.items():
        record[name] = np.frombuffer(raw, form, n, at)
        at += n * np.dtype(form).itemsize
    return record.pop("key"), record.pop("id"), record


def list_sizes(key: np.ndarray) -> np.ndarray:
    """Of rows sorted by key, how many rows have each row's key."""
    sizes = np.diff(np.append(_starts(key), len(key)))
    return np.repeat(sizes, sizes)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def _near_pairs(kind: Nearness, key: np.ndarray, facts: Facts, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (i, j), i before j, among `rows`, which are whole lists of rows sorted by key."""
    key, on, shift = key[rows], np.arange(len(rows)), 1
    while len(on):
        on = on[on + shift < len(key)]
        on = on[key[on] == key[on + shift]]
        hit = on[kind.near(facts, rows[on], rows[on + shift])]
        yield rows[hit], rows[hit + shift]
        shift += 1


def gathered(batches: Iterator[pa.RecordBatch], bytes_: int = GATHER) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, a few that follow each other as one of about so many bytes."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= bytes_:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _distinct(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where each pair of ids is found, once, unless hashes of pairs are equal, when it can be again."""
    order = order_of(mix(one.view(np.uint64)) ^ two.view(np.uint64))
    x, y = one[order], two[order]
    return order[np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))]


def _tiles(rows: np.ndarray) -> Iterator[np.ndarray]:
    """rows in tiles, as a column: with a row of others, a Nearness gives the whole table of pairs."""
    for a in range(0, len(rows), TILE):
        yield rows[a : a + TILE, None]


def _nearest_before(kind: Nearness, facts: Facts, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows low to high, a long list: rows, whether another is near, the nearest one before, and how far that is."""
    others = np.arange(low, high)[None, :]
    for rows in _tiles(np.arange(low, high)):
        i, j = (kind.near(facts, rows, others) & (rows != others)).nonzero()
        hit, best, far = np.zeros(len(rows), bool), np.full(len(rows), low), np.full(len(rows), FAR)
        hit[i] = True
        i, j = (x[low + j < rows[i, 0]] for x in (i, j))
        apart = kind.apart(facts, rows[i, 0], low + j)
        order = np.lexsort((j, apart, i))
        order = order[_starts(i[order])]
        best[i[order]], far[i[order]] = low + j[order], apart[order]
        yield rows[:, 0], hit, best, far


def _nearest(kind: Nearness):
    """part, n, blob, sorted by part -> key, id, facts, near, apart.

    Of short lists, the near pairs: id and near, without a key. Of others the records that have a near
    one of their key; `near` is the nearest one before a record in its list, `apart` how far it is.
    Lists of more than LIST rows are passed on whole; there it is the first row, if that is near.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, count, hubs = None, [], 0, {}

        def out(key: np.ndarray, id_: np.ndarray, facts: Facts, near: np.ndarray, apart: np.ndarray, take: np.ndarray) -> pa.RecordBatch:
            whole = (np.int64(part) << np.int64(32)) | key[take].astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(whole), pa.array(id_[take]), *kind.arrow(facts, take), pa.array(near[take], mask=apart[take] == FAR), pa.array(apart[take].astype(np.int32))],
                names=["key", "id", *kind.facts, "near", "apart"],
            )

        def to_hubs(key: np.ndarray, id_: np.ndarray, facts: Facts) -> pa.RecordBatch:
            """All rows; the first row of a key that is ever seen is its hub."""
            for k in _starts(key):
                hubs.setdefault(int(key[k]), (id_[k], {c: x[k] for c, x in facts.items()}))
            names, which = np.unique(key, return_inverse=True)
            hub = [hubs[int(k)] for k in names]
            both = {c: np.append(x, np.array([h[1][c] for h in hub], x.dtype)) for c, x in facts.items()}
            i, j, ids = np.arange(len(key)), len(key) + which, np.array([h[0] for h in hub], np.int64)[which]
            near = kind.near(both, i, j) & (ids != id_)
            return out(key, id_, facts, ids, np.where(near, kind.apart(both, i, j), FAR), i)

        def looked(last: bool) -> Iterator[pa.RecordBatch]:
            """Look at the lists, or, before the part is complete, only send the long ones on."""
            nonlocal held, count
            low = np.concatenate([h[0] for h in held]).astype(np.uint64) << np.uint64(32)
            low, id_, facts = _sorted(low, np.concatenate([h[1] for h in held]), {c: np.concatenate([h[2][c] for h in held]) for c in kind.facts}, not last or bool(hubs))
            key = low >> np.uint64(32)
            long = (list_sizes(key) > LIST) | np.isin(key, np.array(list(hubs), np.uint64))
            if long.any():
                yield to_hubs(key[long], id_[long], {c: x[long] for c, x in facts.items()})
                key, id_, facts = key[~long], id_[~long], {c: x[~long] for c, x in facts.items()}
            held, count = [(key.astype("<u4"), id_, facts)], len(key)
            if not last or not len(key):
                return
            best, near, take = np.full(len(key), FAR), np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            rows, starts = list_sizes(key), _starts(key)
            few = [p for p in _near_pairs(kind, key, facts, np.flatnonzero((rows > 1) & (rows <= FEW))) if len(p[0])]
            if few:
                i, j = (np.concatenate(x) for x in zip(*few, strict=True))
                one, two = np.minimum(id_[i], id_[j]), np.maximum(id_[i], id_[j])
                first = _distinct(one, two)
                none = [pa.nulls(len(first), a.type) for a in kind.arrow(facts, i[:0])]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(first), pa.int64()), pa.array(two[first]), *none, pa.array(one[first]), pa.array(np.zeros(len(first), np.int32))], names=["key", "id", *kind.facts, "near", "apart"]
                )
            few = _near_pairs(kind, key, facts, np.flatnonzero((rows > FEW) & (rows <= SHORT)))
            for i, j in few:
                if not len(i):
                    continue
                far = kind.apart(facts, i, j)
                take[i] = take[j] = True
                closer = far < best[j]
                best[j[closer]], near[j[closer]] = far[closer], id_[i[closer]]
            for a in starts[rows[starts] > SHORT]:
                for own, hit, before, far in _nearest_before(kind, facts, a, a + rows[a]):
                    take[own], best[own], near[own] = hit, far, id_[before]
            if take.any():
                yield out(key, id_, facts, near, best, np.flatnonzero(take))

        for batch in batches:
            for p, n, blob in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("blob"), strict=True):
                if held and p != part:
                    yield from looked(True)
                    held, count, hubs = [], 0, {}
                part = p
                held.append(undealt(kind, n, blob.as_py()))
                count += n
                if count > 4 * FLUSH:
                    yield from looked(False)
        if held:
            yield from looked(True)

    return run


def _apart_rows(kind: Nearness):
    """key, id, component, facts, sorted by key -> those that have a near one of their key in another component.

    The last key of a batch waits for the next batch. Lists of more than LIST rows are passed on as
    `long`, whatever is in them.
    """
    names = ["key", "id", "component", *kind.facts]

    def found(columns: dict[str, np.ndarray], long: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, component, facts, take = columns["key"], columns["component"], kind.numpy(columns), long.copy()
        rows, starts = list_sizes(key), _starts(key)
        for i, j in _near_pairs(kind, key, facts, np.flatnonzero(~long & (rows > 1) & (rows <= SHORT))):
            other = component[i] != component[j]
            take[i[other]] = take[j[other]] = True
        for a in starts[(rows[starts] > SHORT) & ~long[starts]]:
            own = np.arange(a, a + rows[a])
            _, which, n = np.unique(component[own], return_inverse=True, return_counts=True)
            for odd in _tiles(own[which != n.argmax()]):
                near = kind.near(facts, odd, own[None, :]) & (component[odd] != component[own][None, :])
                take[odd[:, 0]] |= near.any(axis=1)
                take[own] |= near.any(axis=0)
        if take.any():
            at = np.flatnonzero(take)
            yield pa.RecordBatch.from_arrays([*[pa.array(columns[c][at]) for c in names], pa.array(long[at])], names=[*names, "long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_key = None, None
        for batch in gathered(batches):
            columns = {c: batch.column(c).to_numpy() for c in names}
            if held is not None:
                columns = {c: np.append(held[c], columns[c]) for c in names}
            key = columns["key"]
            rows = list_sizes(key)
            long = (rows > LIST) | (key == long_key if long_key is not None else False)
            if long[-1]:
                long_key = key[-1]
            keep = len(key) if long[-1] else len(key) - int(rows[-1])
            held = {c: x[keep:] for c, x in columns.items()}
            if keep:
                yield from found({c: x[:keep] for c, x in columns.items()}, long[:keep])
        if held is not None and len(held["key"]):
            yield from found(held, np.zeros(len(held["key"]), bool))

    return run


def _connecting(component: np.ndarray, x: np.ndarray, y: np.ndarray, links: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links among the pairs (x, y) of rows, which connect all that these pairs' links do: pairs of what is connected aren't decided."""
    label, found = np.unique(component, return_inverse=True)[1], []
    while len(x):
        own = links(x[:CHECKED], y[:CHECKED])
        found.append((x[:CHECKED][own], y[:CHECKED][own]))
        for i, j in zip(*found[-1], strict=True):
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
        x, y = x[CHECKED:], y[CHECKED:]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (x, y)


def _pairs(kind: Nearness, nearest: bool = False, decide: Decide | None = None):
    """key, i, j, side, id, component, top, FIRST, facts, sorted by key, i and j -> near pairs (a, b) of two components.

    Rows with one key, i and j are a cell: a short list (side 0), or a block of a long one, where rows
    outside the list's component `top` (side 1) meet all rows (side 2). With `nearest`, only the
    nearest pair of each row with components that come before its own: larger ones in a large cell.
    A pair that shares a key under this one among the first of both rows is left to that key's list.
    With `decide`, only links, enough to connect what links connect.
    """
    names = ["key", "i", "j", "side", "id", "component", "top", *FIRST, *kind.facts, *([decide[0]] if decide else [])]

    def here(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key, before = rows["key"][x], np.zeros(len(x), bool)
        for one in FIRST:
            for two in FIRST:
                before |= (rows[one][x] == rows[two][y]) & (rows[one][x] < key)
        return ~before

    def pairs(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, i, j, ids, component, side = (rows[c] for c in ("key", "i", "j", "id", "component", "side"))
        starts = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)))
        facts, out = kind.numpy(rows), []
        ends = np.append(starts[1:], len(key))
        cell = np.repeat(np.arange(len(starts)), ends - starts)
        few = np.flatnonzero((side == 0) & ((ends - starts)[cell] <= SHORT))
        for x, y in _near_pairs(kind, cell, facts, few):
            other, later = component[x] != component[y], component[x] > component[y]
            out.append((np.where(later, x, y)[other], np.where(later, y, x)[other]))
        for a, b in zip(starts, ends, strict=True):
            if side[a] == 0 and b - a <= SHORT:
                continue
            own = np.arange(a, b)
            _, which, n = np.unique(component[a:b], return_inverse=True, return_counts=True)
            others, largest = own[None, :], (which == n.argmax())[None, :]
            rank = np.empty(len(n), np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
            for odd in _tiles(own[side[a:b] == 1] if side[a] else own[which != n.argmax()]):
                if side[a]:
                    meet = (side[others] == 2) & ((component[others] == rows["top"][a]) | (ids[others] > ids[odd]))
                else:
                    meet = largest | (others > odd)
                i, j = np.nonzero(meet & (component[odd] != component[others]) & kind.near(facts, odd, others))
                x, y = odd[i, 0], own[j]
                later = rank[which[x - a]] > rank[which[y - a]]
                out.append((np.where(later, x, y), np.where(later, y, x)))
        x, y = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (few[:0], few[:0])
        own = here(rows, x, y)
        x, y = x[own], y[own]
        if nearest and len(x):
            order = np.lexsort((kind.apart(facts, x, y), x))
            first = order[_starts(x[order])]
            x, y = x[first], y[first]
        if decide and len(x):
            first = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1, return_index=True)[1]
            x, y = _connecting(component, x[first], y[first], lambda i, j: decide[1](rows[decide[0]], i, j))
        if len(x):
            pairs = np.unique(np.stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in gathered(batches):
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                rows = {c: np.append(held[c], rows[c]) for c in names}
            last = (rows["key"] == rows["key"][-1]) & (rows["i"] == rows["i"][-1]) & (rows["j"] == rows["j"][-1])
            held = {c: x[last] for c, x in rows.items()}
            if not last.all():
                yield from pairs({c: x[~last] for c, x in rows.items()})
        if held is not None and len(held["key"]):
            yield from pairs(held)

    return run


def tasks_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def nearest_rows(dealt: DataFrame, kind: Nearness, facts: bool = True) -> DataFrame:
    """From what Dealers deal: near pairs (no key), and the rows of longer lists that have a near one, with or without facts."""
    tasks = tasks_of(dealt)
    rows = dealt.repartition(tasks, "part").sortWithinPartitions("part")
    rows = rows.mapInArrow(lean(_nearest(kind)), f"key long, id long, {kind.columns()}, near long, apart int")
    return stash(rows if facts else rows.drop(*kind.facts), "near")


def link(shared: DataFrame, kind: Nearness, verify: Callable[[DataFrame], DataFrame], closer: Nearness | None = None, facts: DataFrame | None = None, among: Callable[[DataFrame, Sieve], DataFrame] | None = None, decide: Decide | None = None) -> DataFrame:
    """(node, component) of the ids of nearest_rows' rows that verified links connect.

    verify: candidate pairs (a, b) -> those that link. closer, facts: a stricter nearness, and a table
    with its facts by id, for what is left after the first round. among: verify for a few of the ids, with
    a sieve of them, so that what it knows of the others isn't shuffled again in each round. decide: verify
    by a column of facts, for the last round: all pairs of long lists are decided there, not passed on.
    """
    tasks, closer = tasks_of(shared), closer or kind
    few = shared.where("key IS NULL").select(F.col("near").alias("a"), F.col("id").alias("b"))
    best = shared.where("key IS NOT NULL AND near <> id").groupBy("id").agg(F.min(F.struct("apart", "near")).alias("m"))
    best = best.select(F.least("id", "m.near").alias("a"), F.greatest("id", "m.near").alias("b"))
    pairs = stash(few.where("a <> b").unionByName(best).distinct(), "pairs")
    found = stash(verify(pairs), "links")
    spent, groups = [pairs, found], components(found)

    def named(rows: DataFrame, *columns: str) -> DataFrame:
        both = rows.join(groups.withColumnRenamed("node", "id"), "id", "left")
        return both.withColumn("component", F.coalesce("component", "id")).select("key", "id", "component", *columns)

    rows = shared.where("key IS NOT NULL").select("key", "id", *(kind.facts if facts is None else []))
    rows = named(rows if facts is None else rows.join(facts.select("id", *closer.facts), "id"), *closer.facts)
    rows = rows.repartition(tasks, "key").sortWithinPartitions("key", "id")
    rest = rows.mapInArrow(lean(_apart_rows(closer)), f"key long, id long, component long, {closer.columns()}, long boolean")
    rest = stash(rest.drop("component"), "rest")
    spent.append(rest)
    if rest.isEmpty():
        discard(*spent)
        return groups
    keys = rest.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    first = keys.select("id", *[F.coalesce(F.get("keys", F.lit(i)), F.lit(2**63 - 1)).alias(c) for i, c in enumerate(FIRST)])
    rest = stash(rest.join(first, "id"), "rest")
    spent.append(rest)
    long = not rest.where("long").isEmpty()

    def met(cells: DataFrame, nearest: bool, last: Decide | None) -> DataFrame:
        cells = cells.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")
        return stash(cells.mapInArrow(lean(_pairs(closer, nearest, last)), "a long, b long").distinct(), "pairs")

    zero, turn = F.lit(0).cast("long"), 0
    while turn <= ROUNDS:
        rows, last, whole = named(rest, "long", *FIRST, *closer.facts), decide if turn == ROUNDS else None, []
        if last:
            with Sieve(rest.select("id")) as ids:
                spent.append(stash(facts.where(ids(F.col("id"))).select("id", last[0]), "whole"))
            rows, whole = rows.join(spent[-1], "id"), [last[0]]
        cells = rows.where("NOT long").select("key", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "id", "component", zero.alias("top"), *FIRST, *closer.facts, *whole)
        pairs = [met(cells, turn < ROUNDS, last)]
        if long:
            pairs += [met(more.select(*cells.columns), turn < ROUNDS, last) for more in cells_of_pairs(rows.where("long").drop("long"), tasks)]
            spent += pairs
            pairs = [stash(reduce(DataFrame.unionByName, pairs).distinct(), "pairs")]
        pairs = pairs[0]
        spent.append(pairs)
        n = pairs.count()
        if not n:
            break
        if last:
            more = pairs
        elif among is None:
            more = stash(verify(pairs), "more-links")
        else:
            with Sieve(pairs.select("a", "b")) as ids:
                more = stash(among(pairs, ids), "more-links")
        if more is not pairs:
            spent.append(more)
        linked = more.count()
        if linked:
            found = found.unionByName(more)
            groups = components(found)
        turn = turn + 1 if turn == ROUNDS or WORTH * linked >= n else ROUNDS
    # components are tables of their own
    discard(*spent)
    return groups
