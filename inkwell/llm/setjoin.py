"""Similarity join of documents on their word shingles: exact Jaccard, size-aware heavy-light.

Two sets of sizes a and b link when their overlap reaches ``o(a, b) = ceil(t (a + b) / (1 + t))``.

* *Light* sets (below the boundary) enumerate their subsets of the fixed sizes o that a partner may ask for; two light sets
  that link share one.
* *Heavy* sets, and the light ones just below the boundary that may link with them, are entered in inverted lists of
  elements.  A set of n elements is entered under its ``n - ceil(t n) + 1`` rarest ones only: two linked sets share one of
  these, whatever order of the elements is used, as long as it is the same for all.  The order is by the number of sets
  that hold an element, counted over the whole corpus; one that no other set holds needs no list.
* The boundary is the one with the least cost over the whole table's histogram of set sizes.

Lists are scanned with a filter on sizes and places: if the element is the first that two sets share, what follows it in
both must still hold the overlap they need.  Every member of a list is compared with its first member (so a list costs as
many pairs as it has members), and only lists whose members are not all connected by then are scanned for their other pairs,
those of different components.  Pairs are held against each other by parity bitmaps first (the distance of these never
exceeds the sets' symmetric difference, so nothing is lost) and what remains is verified on the sets themselves.  So
components are those of all links, without all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HASHED, drop_written, give_back, mix, runs, small_batches, table, text_bytes, words, written
from .components import components
from .ngram_counts import SHORT, block_counts, blocks, shards_for, told

#: Members of a list that meet in one group, and what an entry in a list costs in enumerated subsets.
CHUNK, LIST_COST = 512, 4.0
#: Subsets are only ever weighed for sets up to this size; larger ones are heavy in any case.
LIGHT_LIMIT = 40
#: Elements whose hash lies in the lower half are counted over the corpus and come first in the order, by their number; the
#: others follow by their hash.  A set seldom needs these: its rarest elements are a tenth or a fifth of all.
COUNTED = np.uint64(1 << 63)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and the rows' offsets in them.

    Rows are taken HASHED bytes at a time: what is worked with weighs several times the hashes that come out.
    """
    parts = [_shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width) for i, j in runs(offsets, HASHED)]
    values = np.concatenate([np.zeros(0, np.uint64), *(v for v, _ in parts)])
    return values, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))]).astype(np.int64)


def _shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``shingle_sets`` gives, with the number in each row instead of offsets, all rows at once."""
    h, row, count = words(raw, offsets)
    rows = len(offsets) - 1
    with np.errstate(over="ignore"):
        if len(h) >= width:
            n = len(h) - width + 1
            value = np.full(n, width, np.uint64)
            for i in range(width):
                value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
            whole = row[:n] == row[width - 1 :]
            value, owner = value[whole], row[:n][whole]
        else:
            value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Rows with fewer words than a shingle: the whole sequence is the one element.
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            first = np.concatenate([[0], np.cumsum(count)])[short]
            few = np.zeros(len(short), np.uint64) + count[short].astype(np.uint64)
            for i in range(width - 1):
                has = count[short] > i
                few[has] = mix(few[has] * np.uint64(0x9E3779B97F4A7C15) + h[first[has] + i])
            value, owner = np.concatenate([value, few]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], np.bincount(owner[keep], minlength=rows)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def set_names(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    return mix(row_sums(mix(values), offsets)), mix(row_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), offsets))


class Rule:
    """The arithmetic of one threshold, in per cent."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, total):
        """Least overlap of two linked sets whose sizes add up to ``total``."""
        return -(-self.percent * total // (100 + self.percent))

    def least(self, n):
        return -(-self.percent * n // 100)

    def most(self, n: int) -> int:
        return 100 * n // self.percent

    def entered(self, n):
        """Elements under which a set of n is entered: it shares one of them with each set that it links with."""
        return n - self.least(n) + 1

    def subset_sizes(self, n: int) -> list[int]:
        """The overlaps that a set of n elements may be asked for, by partners of any size (equal sets aside)."""
        smaller = {self.overlap(a + n) for a in range(self.least(n), n)}
        larger = {self.overlap(n + b) for b in range(n + 1, self.most(n) + 1)}
        same = {c for c in [self.overlap(2 * n)] if c < n}
        return sorted(c for c in smaller | larger | same if c <= n)

    def light_cost(self, n: int) -> float:
        return float(sum(math.comb(n, c) for c in self.subset_sizes(n)))

    def may_link(self, n: Column, place: Column, other: Column, other_place: Column) -> Column:
        """Whether two members of a list can reach the overlap they need, if they share nothing before its element."""
        need = F.ceil(F.lit(self.percent) * (n + other) / F.lit(float(100 + self.percent)) - 1e-9)
        return F.least(n - place, other - other_place) >= need


def boundary(sizes: dict[int, int], rule: Rule) -> int:
    """Sets below it are light: the value of the least total cost, by the histogram of the small sizes.

    A light set costs its subsets; a set in lists costs the counting of its elements and its entries.
    """
    heavy = {n: n + LIST_COST * rule.entered(n) for n in sizes}
    best, least = 1, math.inf
    for x in range(1, LIGHT_LIMIT + 1):
        cost = sum(c * rule.light_cost(n) for n, c in sizes.items() if n < x) + sum(c * heavy[n] for n, c in sizes.items() if n >= rule.least(x))
        if cost < least:
            best, least = x, cost
    return best


def parity(values: np.ndarray) -> bytes:
    """The parity bitmap of a set: a power of two of at least twice its size in bits, 64 to 32,768."""
    bits = 1 << min(15, max(6, (2 * len(values) - 1).bit_length()))
    odd = np.bincount((values >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def mark_fresh(key: str):
    """Adds a column ``fresh`` to batches: whether the row has a key and no earlier row of the partition has its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            fresh = np.zeros(batch.num_rows, bool)
            keyed = batch.column(key).is_valid().to_pylist()
            for i, name in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
                if keyed[i] and name not in seen:
                    seen.add(name)
                    fresh[i] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fresh)], names=[*batch.schema.names, "fresh"])

    return run


def whole_text(part: pa.Table, text: str) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(part[text].combine_chunks())


def describe_sets(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row for each row of ``docs``: key, n (size), two hashes of the set, and the number of its block if it is fresh."""
    fresh = mark_fresh(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in blocks(fresh(batches), text):
            values, offsets = shingle_sets(*whole_text(part, text), width)
            one, two = set_names(values, offsets)
            own = part["fresh"].to_numpy()
            yield pa.RecordBatch.from_arrays([part[key].combine_chunks(), pa.array(np.diff(offsets)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.full(len(own), number), mask=~own)], names=[key, "n", "one", "two", "block"])

    return docs.mapInArrow(run, f"{key} long, n long, one long, two long, block long")


class BlockSets:
    """The sets of a block's texts (each distinct one once), and which of their elements are counted over the corpus."""

    def __init__(self, part: pa.Table, text: str, width: int, smallest: int):
        values, offsets = shingle_sets(*whole_text(part, text), width)
        self.one = set_names(values, offsets)[0]
        _, first = np.unique(self.one, return_index=True)
        self.rows = np.sort(first)
        self.values, self.offsets = values, offsets
        heavy = np.zeros(len(offsets) - 1, bool)
        heavy[first] = np.diff(offsets)[first] >= smallest
        of_heavy = np.repeat(heavy, np.diff(offsets))
        self.counted = values[of_heavy & (values < COUNTED)] << np.uint64(1)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.counted, return_counts=True)


def enter_sets(docs: DataFrame, heads: DataFrame, answers: DataFrame, key: str, text: str, width: int, rule: Rule, limit: int, shards: int) -> DataFrame:
    """A row for each distinct set that may have a partner: key (its class), n, the lists it is entered in and its places in
    the order of its elements there, its bitmap and its elements.

    ``heads``: block, ids and names (hashes) of the classes that are entered from that block.
    """
    fresh, smallest = mark_fresh(key), max(1, rule.least(limit))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in blocks(fresh(batches), text):
            own = part.filter(part["fresh"]).select([text])
            for batch in own.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), batch.column(0)], names=["block", text])

    names = [key, "n", "lists", "places", "bitmap", "elements"]

    def enter(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {x: [] for x in names}
        kinds = np.array(right["kind"].to_pylist(), np.int64)
        if left.num_rows and (kinds < 0).any():
            own = BlockSets(left, text, width, smallest)
            counted, _ = own.keys()
            held = told(right.filter(pa.array(kinds >= 0)), 0, counted, shards)
            at = int(np.flatnonzero(kinds < 0)[0])
            ids = dict(zip(right["names"][at].as_py(), right["ids"][at].as_py(), strict=True))
            for row in own.rows.tolist():
                mine = ids.get(int(own.one[row : row + 1].view(np.int64)[0]))
                values = own.values[own.offsets[row] : own.offsets[row + 1]]
                n = len(values)
                if mine is None or not n:
                    continue
                lists, places = [], []
                if n >= smallest:
                    cut = int(np.searchsorted(values, COUNTED))
                    low = values[:cut] << np.uint64(1)
                    often = held[np.searchsorted(counted, low)]
                    order = np.argsort(often, kind="stable")[: rule.entered(n)]
                    place = np.flatnonzero(often[order] > 1)
                    lists.append(low[order[place]] >> np.uint64(1))
                    places.append(place)
                    rest = rule.entered(n) - cut
                    if rest > 0:
                        lists.append((values[cut : cut + rest] << np.uint64(1)) >> np.uint64(1) | np.uint64(1 << 62))
                        places.append(np.arange(cut, cut + rest))
                if n < limit:
                    subsets = light_subsets(values, rule)
                    lists.append(subsets | np.uint64(1 << 63))
                    places.append(np.zeros(len(subsets), np.int64))
                lists, places = np.concatenate(lists), np.concatenate(places)
                if len(lists):
                    for column, value in zip(out.values(), (mine, n, lists.view(np.int64), places.astype(np.int32), parity(values), values.tobytes()), strict=True):
                        column.append(value)
        kinds_ = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        made = pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds_, strict=True)], names=names)
        give_back()
        return made

    texts = docs.mapInArrow(number, f"block long, {text} string")
    none = lambda kind: F.lit(None).cast(kind)
    right = answers.select("block", "shard", "kind", "totals", none("array<long>").alias("ids"), none("array<long>").alias("names"))
    right = right.unionByName(heads.select("block", F.lit(-1).alias("shard"), F.lit(-1).alias("kind"), none("binary").alias("totals"), "ids", "names"))
    return texts.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(enter, f"{key} long, n long, lists array<long>, places array<int>, bitmap binary, elements binary")


def light_subsets(values: np.ndarray, rule: Rule) -> np.ndarray:
    """Hashes of a light set's subsets of the sizes that partners may ask for."""
    with np.errstate(over="ignore"):
        spread = mix(values ^ np.uint64(0xD1B54A32D192ED03))
        total, out = spread.sum(dtype=np.uint64), [np.zeros(0, np.uint64)]
        for c in rule.subset_sizes(len(values)):
            left_out = np.array([spread[list(x)].sum(dtype=np.uint64) for x in combinations(range(len(values)), len(values) - c)], np.uint64)
            out.append(mix(total - left_out + mix(np.full(1, c, np.uint64))))
        return np.concatenate(out)


class Store:
    """Writes intermediate tables to the shared folder and deletes them once nothing reads them any more."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __call__(self, df: DataFrame, what: str) -> DataFrame:
        self.held.append(written(df, what))
        return self.held[-1]

    def clear(self) -> None:
        for df in self.held:
            drop_written(df)
        self.held = []


def shared_lists(entries: DataFrame, key: str, store: Store) -> DataFrame:
    """bucket, key, n, place, first, first_n, first_place: the members of lists with at least two, beside the list's first
    member.  Lists with the same members become one, with the earliest place of each."""
    members = entries.select(key, "n", F.explode(F.arrays_zip("lists", "places")).alias("e")).select(key, "n", F.col("e.lists").alias("list"), F.col("e.places").alias("place"))
    other = F.xxhash64(F.lit(3), key).bitwiseAND(F.lit((1 << 30) - 1))
    known = members.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64(F.lit(2), key)).alias("x"), F.sum(other).alias("s"), F.min(F.struct(key, "n", "place")).alias("first"))
    known = written(known.where("m > 1").select("list", "first", F.xxhash64("m", "x", "s").alias("bucket")), "lists")
    held = members.join(known, "list").groupBy("bucket", key, "n").agg(F.min("place").alias("place"), F.min("first").alias("first"))
    held = store(held.select("bucket", key, "n", "place", F.col(f"first.{key}").alias("first"), F.col("first.n").alias("first_n"), F.col("first.place").alias("first_place")), "members")
    drop_written(known)
    return held


def verify(pairs: DataFrame, entries: DataFrame, key: str, rule: Rule, store: Store, mapped: bool) -> DataFrame:
    """(u, v, ok) for distinct pairs: by the bitmaps (unless ``mapped``: they were looked at), then by the sets themselves."""

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        left = entries.select(F.col(key).alias("u"), F.col("n").alias("n_u"), F.col(column).alias("a"))
        right = entries.select(F.col(key).alias("v"), F.col("n").alias("n_v"), F.col(column).alias("b"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "n_u", "n_v", "a", "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n_u").to_numpy(), batch.column("n_v").to_numpy()
            allowed = n + m - 2 * rule.overlap(n + m)
            may = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                x, y = fold([a.as_buffer(), b.as_buffer()])
                may[i] = np.bitwise_count(x ^ y).sum() <= allowed[i]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(may)], names=["u", "v", "may"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    refused = None
    if not mapped:
        looked = store(beside(pairs, "bitmap").mapInArrow(near, "u long, v long, may boolean").groupBy("u", "v").agg(F.bool_or("may").alias("may")), "looked")
        pairs, refused = looked.where("may").select("u", "v"), looked.where("NOT may").select("u", "v", F.lit(False).alias("ok"))
    known = beside(pairs, "elements").mapInArrow(count, "u long, v long, ok boolean").groupBy("u", "v").agg(F.bool_or("ok").alias("ok"))
    return store(known.unionByName(refused) if refused is not None else known, "known")


def fold(maps: list) -> np.ndarray:
    """Parity bitmaps, cut down to the size of the smallest, as rows of 64-bit words."""
    width = min(len(m) for m in maps)
    grid = np.zeros((len(maps), width), np.uint8)
    for i, m in enumerate(maps):
        grid[i] = np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0)
    return grid.view(np.uint64)


def open_groups(held: DataFrame, labels: DataFrame, key: str, store: Store) -> DataFrame:
    """bucket, g, key, n, place, label, major: the groups in which members of lists meet that are not all connected.

    The first member has met all others and is left out.  In each list, the component with most members is its major one,
    whose members need not meet each other.  Those of the other components and of the major one are dealt to chunks of about
    CHUNK by a hash, and a group is a pair of chunks; so no group grows with its list.
    """
    rest = held.where((F.col(key) != F.col("first")) | (F.col("n") != F.col("first_n"))).select("bucket", key, "n", "place")
    rest = rest.join(labels.select(F.col("node").alias(key), "component"), key, "left").withColumn("label", F.coalesce("component", key)).drop("component")
    rest = store(rest, "labelled")
    per_label = rest.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    shape = per_label.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("most"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    shape = shape.select("bucket", F.col("most.label").alias("major_label"), F.ceil((F.col("m") - F.col("most.c")) / CHUNK).cast("long").alias("A"), F.ceil(F.col("most.c") / CHUNK).cast("long").alias("B"))
    rows = rest.join(store(shape, "open"), "bucket").withColumn("major", F.col("label") == F.col("major_label"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), key), F.when(F.col("major"), F.col("B")).otherwise(F.col("A"))))
    # Group a * B + b: chunk a of the others with chunk b of the major ones; for b = 0 the others meet among themselves, too.
    # Group A * B + a * A + c (a < c): two chunks of the others.
    of_major = F.transform(F.sequence(F.lit(0).cast("long"), F.col("A") - 1), lambda a: a * F.col("B") + F.col("chunk"))
    with_major = F.transform(F.sequence(F.lit(0).cast("long"), F.col("B") - 1), lambda b: F.col("chunk") * F.col("B") + b)
    with_others = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("A") - 1), lambda a: a != F.col("chunk")), lambda a: F.col("A") * F.col("B") + F.least(a, F.col("chunk")) * F.col("A") + F.greatest(a, F.col("chunk")))
    groups = F.when(F.col("major"), of_major).otherwise(F.concat(with_major, with_others))
    return rows.withColumn("g", F.explode(groups)).withColumn("within", (F.col("g") < F.col("A") * F.col("B")) & (F.col("g") % F.col("B") == 0)).select("bucket", "g", key, "n", "place", "label", "major", "within", "chunk")


def compare_members(held: dict[str, np.ndarray], maps: list, rule: Rule) -> list[tuple[int, int]]:
    """Pairs of one group, of different components, that sizes, places and bitmaps don't rule out."""
    grid, out = fold(maps), []
    ids, n, place, label, major, chunk = (held[c] for c in ("ids", "n", "place", "label", "major", "chunk"))
    left = n - place
    for i in np.flatnonzero(~major).tolist():
        # Major ones come after; others of the same chunk meet in one group only.
        after = np.arange(len(ids)) > i
        with_ = (label != label[i]) & (major | (after & ((chunk != chunk[i]) | held["within"][i])))
        rest = np.flatnonzero(with_)
        need = rule.overlap(n[i] + n[rest])
        rest = rest[np.minimum(left[i], left[rest]) >= need]
        if len(rest):
            total = n[i] + n[rest]
            rest = rest[np.bitwise_count(grid[rest] ^ grid[i]).sum(1) <= total - 2 * rule.overlap(total)]
            out += [(int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in rest.tolist() if ids[i] != ids[j]]
    return out


def other_pairs(groups: DataFrame, entries: DataFrame, key: str, rule: Rule) -> DataFrame:
    """(u, v), distinct, to be verified: from ``open_groups``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            own = pa.Table.from_batches(parts).combine_chunks()
            columns = {c: own[name].to_numpy() for c, name in (("ids", key), ("n", "n"), ("place", "place"), ("label", "label"), ("major", "major"), ("within", "within"), ("chunk", "chunk"))}
            bucket, g, maps = own["bucket"].to_numpy(), own["g"].to_numpy(), own["bitmap"]
            begin = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (g[1:] != g[:-1])]))
            found: list[tuple[int, int]] = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(bucket)], strict=True):
                if b - a > 1:
                    found += compare_members({c: x[a:b] for c, x in columns.items()}, [m.as_buffer() for m in maps[a:b]], rule)
            found = list(dict.fromkeys(found))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # All but the last group of a batch are complete; a group holds about 2 CHUNK members at most.
            at = [(int(x), int(y)) for x, y in zip(batch.column("bucket").to_numpy()[[0, -1]], batch.column("g").to_numpy()[[0, -1]], strict=True)]
            same = (batch.column("bucket").to_numpy() == at[1][0]) & (batch.column("g").to_numpy() == at[1][1])
            last = int(np.flatnonzero(same)[0])
            if held and (held[-1].column("bucket")[-1].as_py(), held[-1].column("g")[-1].as_py()) != at[0]:
                yield finish(held)
                held = []
            if last:
                yield finish([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield finish(held)

    rows = groups.join(entries.select(key, "n", "bitmap"), [key, "n"])
    return rows.repartition("bucket", "g").sortWithinPartitions("bucket", "g").mapInArrow(run, "u long, v long").distinct()


def jaccard_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links), a row for each row of ``docs``.

    Rows with a null or wordless text have no shingles and link with nothing.  A row without key is not linked either; its
    component is null.  Rows that repeat a key are one document: what links with one of them links with all.  A text of any
    length is one set; a block of texts holds it whole.  An empty table gives no rows.  Other columns are not looked at.
    ``docs`` is read three times and must give the same rows in the same order each time, as stored tables do.
    """
    with small_batches(docs.sparkSession):
        sets, found = _components(docs, key, text, width, Rule(percent))
    out = sets.select(key, F.col("n").alias("n_shingles"))
    out = out.join(found.withColumnRenamed("node", key), key, "left").withColumn("component_id", F.coalesce("component", key))
    return out.select(key, "n_shingles", "component_id")


def _components(docs: DataFrame, key: str, text: str, width: int, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Stored: the description of each row's set, and the component of each key that is linked with another."""
    store = Store()
    docs = docs.select(F.col(key).cast("long").alias(key), text, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    sets = written(describe_sets(docs, key, text, width), "sets")
    full = sets.where((F.col("n") > 0) & F.col(key).isNotNull())
    sizes = {r["n"]: r["count"] for r in full.where(F.col("n") <= 2 * LIGHT_LIMIT).groupBy("n").count().collect()}  # a row a small size
    total = full.agg(F.sum("n")).first()[0]
    # Stored first, so that Spark can split the join where very many rows have one set.
    distinct = store(full.groupBy("one", "two", "n").agg(F.min(key).alias("class_id"), F.min("block").alias("block")), "classes")
    classes = full.join(distinct.drop("block"), ["one", "two", "n"]).where(F.col(key) != F.col("class_id"))
    links = classes.select(F.col(key).alias("u"), F.col("class_id").alias("v"))
    if total:
        limit = boundary(sizes, rule)
        shards, smallest = shards_for(total / 2), max(1, rule.least(limit))

        def counted(part: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
            return [BlockSets(part.filter(part["fresh"]), text, width, smallest).keys()]

        answers = block_counts(docs, text, counted, [SHORT], shards, "counts", prepare=mark_fresh(key))
        # Distinct sets of a block: as many as the block has rows at most.
        heads = distinct.groupBy("block").agg(F.collect_list(F.struct("one", "class_id")).alias("c")).select("block", F.col("c.class_id").alias("ids"), F.col("c.one").alias("names"))
        entries = store(enter_sets(docs, heads, answers, key, text, width, rule, limit, shards), "entries")
        drop_written(answers)
        held = shared_lists(entries, key, store)
        first = held.where((F.col(key) != F.col("first")) & rule.may_link(F.col("n"), F.col("place"), F.col("first_n"), F.col("first_place")))
        known = verify(first.select(F.col("first").alias("u"), F.col(key).alias("v")).distinct(), entries, key, rule, store, mapped=False)
        # Lists in which not all are connected by now: their other pairs.
        labels = store(components(known.where("ok").select("u", "v")), "labels")
        again = other_pairs(open_groups(held, labels, key, store), entries, key, rule).join(known, ["u", "v"], "left_anti")
        again = verify(store(again, "pairs"), entries, key, rule, store, mapped=True).where("ok").select("u", "v")
        links = links.unionByName(labels.select(F.col("node").alias("u"), F.col("component").alias("v"))).unionByName(again)
    found = components(links)
    store.clear()
    return sets, found


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
