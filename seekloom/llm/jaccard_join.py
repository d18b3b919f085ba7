"""Exact Jaccard join of word-shingle sets in metric space, to classes of linked documents.

Jaccard distance is a metric, so pivots can rule pairs out. Two steps come first
because almost all sets are at distance one from each other, where no pivot
separates anything:

* Equal sets are one class (128-bit digest of the set).
* Linked sets share one of their rarest shingles (the first n - ceil(t * n) + 1 in
  one global order), and their sizes differ by a factor of t at most. Sets of like
  size connected by such shingles form the top regions; no link leaves one. Each
  task sends one set for each of its shingles and size steps, so that a shingle
  of very many sets costs a row a task, and a range of shingles is merged once.

The order comes from a count sketch: any order is exact, a good one keeps the
regions small. Only shingles of the lowest hashes are counted, enough of them to
fill a prefix several times. Tasks send the counters they raised as packed sorted
numbers; each range of counters is summed once and stored as a file that workers
map, so neither the driver nor a broadcast holds the sketch.

A region is cut around pivots: a set belongs to the cell of its nearest pivot, or
to the far cell if every pivot is at least 1 - r away. It is also copied to each
cell it may have links into, by the triangle inequality: distance to that pivot at
most the distance to the nearest one + 2r (for a far set any) and at most the
cell's radius + r. Links to pivots fall out of the distances. Cells are cut again
as long as they shrink; one of at most LEAF sets, or one whose sets lie within the
windows of each other, is compared pair by pair, but for pairs that are in one
class already. Regions of up to REGION_SHINGLES shingles recur within a task;
larger ones are cut by Spark until their cells fit, and where cells do not shrink,
their sets are dealt into blocks and every two blocks meet in a task.

Defined cases: a text without words has an empty set and is linked with
nothing; fewer words than a shingle make one shingle; rows of one doc_id are one
document; a row with a null doc_id gets a null component and links nothing; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, few, new_path, save
from .components import components
from .packed import mapped, pack, slices, store, tidy, unpack
from .shingles import mix64, sets_of

WIDTH = 3
#: Linked: 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Sets that are compared without a further cut.
LEAF = 8
#: Pivots of one cut.
PIVOTS = 4
#: A region of so many shingles (8 bytes each) is joined within a task.
REGION_SHINGLES = 1_500_000
#: Lists of sets to compare are broadcast up to so many rows (some 25 MB); beyond, texts are shuffled to them.
BROADCAST_ROWS = 400_000
#: Bytes of text for each range that tokens and counters are merged by.
RANGE_BYTES = 16_000_000
#: Counters of the sketch: about one for two counted shingles, within these powers of two.
LEAST_BITS, MOST_BITS = 16, 36
#: Tokens, or counted shingles, that a task holds before it packs them.
HELD = 2_000_000
#: Shingles whose counters are read at once.
LOOKED_UP = 250_000


class Plan:
    """Numbers that follow from the size of the corpus and the threshold."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent = width, percent
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = lambda n, least, most: int(np.clip(np.ceil(np.log2(max(1, n))), least, most))
        #: Share of the hashes that is counted.
        self.share = min(1.0, 3.5 * (1 - percent / 100))
        shingles = self.share * size / 6  # about six bytes a word
        self.part_bits = bits(size / RANGE_BYTES, 2, 20)
        self.bits = max(bits(shingles / 2, LEAST_BITS, MOST_BITS), self.part_bits + 1)
        self.usual = shingles / 2**self.bits
        #: Tokens keep so many top bits: enough that few agree by chance.
        self.token_bits = bits(size / 6 * 65536, 40, 64)
        self.folder = new_path(docs.sparkSession, "sketch")

    def counters(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which shingles are below the counted share, and the counters of these."""
        low = np.flatnonzero(shingles <= np.uint64(min(self.share * 2.0**64, 2.0**64 - 2049)))
        at = (shingles[low].astype(np.float64) * (2.0 ** (self.bits - 64) / self.share)).astype(np.uint64)
        return low, np.minimum(at, np.uint64((1 << self.bits) - 1))

    def orders(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """Sort keys in the global order of each set's shingles: rare ones first, uncounted ones last."""
        shingles = np.concatenate(sets)
        low, at = self.counters(shingles)
        inner = self.bits - self.part_bits
        part = (at >> np.uint64(inner)).astype(np.uint16 if self.part_bits <= 16 else np.uint32)
        by_part = np.argsort(part, kind="stable")
        parts, starts = np.unique(part[by_part], return_index=True)
        level = np.full(len(shingles), 15, np.uint64)
        for p, s in zip(parts.tolist(), np.split(by_part, starts[1:]), strict=True):
            place = at[s] & np.uint64((1 << inner) - 1)
            stored = mapped(self.folder, f"level-{p}", "u1")
            level[low[s]] = (stored[place >> np.uint64(1)] >> ((place & np.uint64(1)) << np.uint64(2)).astype(np.uint8)) & 15
        return np.split((level << np.uint64(60)) | (shingles >> np.uint64(4)), np.cumsum([len(x) for x in sets])[:-1])

    def prefix(self, shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
        take = len(shingles) - (len(shingles) * self.percent + 99) // 100 + 1
        return shingles[np.argpartition(order, take - 1)[:take]] & ~np.uint64((1 << (64 - self.token_bits)) - 1)


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return a, b


def _scan(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, n, s, s2) of every row, and a task's part of the sketch as (part, data)."""
    names = ["doc_id", "n", "s", "s2", "part", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches):
        held, size = [], 0

        def flush():
            at = np.concatenate(held)
            at.sort()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            n = np.minimum(np.diff(np.append(first, len(at))), 255).astype(np.uint8)
            at = at[first]
            parts = [(part, pack(at_sorted=at[x], n=n[x])) for part, x in slices(at, plan.part_bits)]
            none = pa.nulls(len(parts), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 4 + [pa.array([p for p, _ in parts], pa.int32()), pa.array([d for _, d in parts], pa.binary())], names=names)

        for batch in batches:
            n, s, s2 = [], [], []
            for found in sets_of(batch.column("text").to_pylist(), plan.width):
                n.append(len(found))
                a, b = _digest(found) if len(found) else (None, None)
                s.append(a)
                s2.append(b)
                held.append(plan.counters(found)[1] << np.uint64(64 - plan.bits))
                size += len(held[-1])
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, s, s2)], pa.nulls(len(n), kinds[4]), pa.nulls(len(n), kinds[5])], names=names)
        if size:
            yield flush()
        tidy()

    return docs.mapInArrow(run, "doc_id long, n long, s long, s2 long, part int, data binary")


def _store_levels(plan: Plan):
    """One range of counters: sum and store it at four bits a counter, fine steps around the usual count and coarse ones above."""
    limits = max(0.0, plan.usual - 2) + max(1.0, (plan.usual / 2) ** 0.5) * np.array([1.5, 2.5, 3.5, 4.5, 5.5, 7.5, 10, 14, 20, 40, 80, 160, 500, 2000, 10000])

    def run(key, table):
        part, inner = key[0].as_py(), plan.bits - plan.part_bits
        sums = np.zeros(1 << inner, np.uint32)
        for data in table.column("data"):
            block = unpack(data.as_py())
            at = (block["at_sorted"] >> np.uint64(64 - plan.bits)) & np.uint64((1 << inner) - 1)
            sums[at] += block["n"]
        level = np.minimum(np.searchsorted(limits, sums), 15).astype(np.uint8).reshape(-1, 2)
        store(plan.folder, f"level-{part}", level[:, 0] | level[:, 1] << 4)
        tidy()
        return pa.table({"part": pa.array([part], pa.int32())})

    return run


def _rows_of_tokens(docs: DataFrame, plan: Plan) -> DataFrame:
    """(part, data): rarest shingles of the sets as sorted tokens with size step and set, and edges known already."""
    scale = 0.999999 / -np.log(plan.percent / 100)

    def run(batches):
        held, size = [], 0

        def flush():
            token, step, s = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((s, step, token))
            token, step, s = token[order], step[order], s[order]
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (step[1:] != step[:-1])])
            head = s[first][np.cumsum(first) - 1]
            edges = np.unique(np.stack([s, head], 1)[s != head], axis=0)
            token, step, s = token[first], step[first], s[first]
            parts = {part: {"token_sorted": token[x], "step": step[x], "s": s[x]} for part, x in slices(token, plan.part_bits)}
            key = mix64(edges[:, 0].astype(np.uint64))
            order = np.argsort(key)
            for part, x in slices(key[order], plan.part_bits):
                parts.setdefault(part, {}).update(a=edges[order[x], 0].copy(), b=edges[order[x], 1].copy())
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([pack(**x) for x in parts.values()], pa.binary())], names=["part", "data"])

        def groups():
            sets, n = [], 0
            for batch in batches:
                for found in sets_of(batch.column("text").to_pylist(), plan.width):
                    if len(found):
                        sets.append(found)
                        n += len(found)
                    if n >= LOOKED_UP:
                        yield sets
                        sets, n = [], 0
            if sets:
                yield sets

        for sets in groups():
            for found, order in zip(sets, plan.orders(sets), strict=True):
                token = plan.prefix(found, order)
                held.append((token, np.full(len(token), int(np.log(len(found)) * scale), np.uint16), np.full(len(token), _digest(found)[0], np.int64)))
                size += len(token)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        tidy()

    return docs.select("text").mapInArrow(run, "part int, data binary")


def _edges_of_range(key, table):
    """(a, b): the sets of one token whose size steps are equal or neighbours, hung on the smallest of them."""
    blocks = [unpack(d.as_py()) for d in table.column("data")]
    edges = [np.stack([b["a"], b["b"]], 1) for b in blocks if "a" in b]
    own = [b for b in blocks if "s" in b]
    if own:
        token, step, s = (np.concatenate([b[x] for b in own]) for x in ("token_sorted", "step", "s"))
        blocks.clear()
        order = np.lexsort((step, token))
        token, step, s = token[order], step[order].astype(np.int64), s[order]
        first = np.concatenate([[True], (token[1:] != token[:-1]) | (step[1:] - step[:-1] > 1)])
        head = np.minimum.reduceat(s, np.flatnonzero(first))[np.cumsum(first) - 1]
        edges.append(np.stack([s, head], 1)[s != head])
    found = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    tidy()
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(region, rep, s, shingles) of rows that still carry text and the set wanted of them."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            want = [batch.column(c).to_pylist() for c in ("region", "rep", "s", "s2")]
            for region, rep, s, s2, found in zip(*want, sets_of(batch.column("text").to_pylist(), width), strict=True):
                if len(found) and _digest(found) == (s, s2):
                    out.append((region, rep, s, found.view(np.int64)))
                    size += len(found)
                    if size >= HELD // 4:
                        yield batch_of(out)
                        out, size = [], 0
            yield batch_of(out)
        tidy()

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.list_(pa.int64()))], names=["region", "rep", "s", "shingles"])

    return docs.select("region", "rep", "s", "s2", "text").mapInArrow(run, "region long, rep long, s long, shingles array<long>")


def linked(a, b, common, percent: int = PERCENT):
    return 100 * common >= percent * (a + b - common)


class Region:
    """Sets of one region, joined by recursive cuts around pivots; links are kept as a forest, never as a list of pairs."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.n = percent, np.array([len(x) for x in sets], np.int64)
        self.root, self.cuts = list(range(len(sets))), 0
        _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        df = np.bincount(inverse)
        # shingles of one set count for its size only
        keep = df[inverse] > 1
        self.col = (np.cumsum(df > 1) - 1)[inverse[keep]]
        self.off = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sets)), self.n)[keep], minlength=len(sets)))])
        self.mark = np.zeros(int((df > 1).sum()) + 1, bool)

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def _gathered(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.off[members + 1] - self.off[members]
        off = np.concatenate([[0], np.cumsum(size)])
        return self.col[np.repeat(self.off[members] - off[:-1], size) + np.arange(off[-1])], off

    def _compare(self, x: int, members: np.ndarray, col: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distance of set x to each member; x and its links become one class."""
        own = self.col[self.off[x] : self.off[x + 1]]
        self.mark[own] = True
        sums = np.concatenate([[0], np.cumsum(self.mark[col], dtype=np.int32)])
        self.mark[own] = False
        common = (sums[off[1:]] - sums[off[:-1]]).astype(np.int64)
        common[members == x] = self.n[x]
        for y in members[linked(self.n[x], self.n[members], common, self.percent)].tolist():
            a, b = sorted((self.find(x), self.find(y)))
            self.root[b] = a
        return 1 - common / (self.n[x] + self.n[members] - common)

    def _pairwise(self, members: np.ndarray) -> None:
        """Every pair of members that is not in one class yet: the largest class waits, the others are compared with all."""
        classes = np.array([self.find(x) for x in members.tolist()])
        names, sizes = np.unique(classes, return_counts=True)
        if len(names) < 2:
            return
        col, off = self._gathered(members)
        left = len(names)
        for x in members[classes != names[np.argmax(sizes)]].tolist():
            self._compare(x, members, col, off)
            if left > 1 and (left := left - 1) < 2 and len({self.find(y) for y in members.tolist()}) < 2:
                return

    def join(self) -> list[tuple[int, int]]:
        """(set, first set of its class) where they differ."""
        r, slack, todo = 1 - self.percent / 100, 1e-9, [np.arange(len(self.n))]
        while todo:
            members = todo.pop()
            if len(members) < 2:
                continue
            self.cuts += 1
            col, off = self._gathered(members)
            chosen = members[np.argsort(mix64(members.astype(np.uint64) + np.uint64(self.cuts)), kind="stable")[: 1 if len(members) <= LEAF else PIVOTS]]
            d = np.stack([self._compare(x, members, col, off) for x in chosen.tolist()], 1)
            nearest, near = np.argmin(d, 1), d.min(1)
            far = near >= 1 - r - slack
            cells = [members[far]]
            for j in range(len(chosen)):
                inner = ~far & (nearest == j)
                radius = near[inner].max() if inner.any() else -1
                cells.append(members[(d[:, j] <= radius + r + slack) & (far | (d[:, j] <= near + 2 * r + slack))])
            for cell in cells:
                if len(cell) > LEAF and 2 * len(cell) <= len(members):
                    todo.append(cell)
                elif len(cell) > 1:
                    self._pairwise(cell)
        return [(x, self.find(x)) for x in range(len(self.n)) if self.find(x) != x]


def _join_regions(regions: DataFrame, percent: int) -> DataFrame:
    """(region, rep, s, shingles) -> links (a, b) between reps. A region fits in memory."""

    def run(batches):
        region, ids, sets = None, [], []

        def close():
            out = Region(sets, percent).join() if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[x][0] for x, _ in out], pa.int64()), pa.array([ids[y][0] for _, y in out], pa.int64())], names=["a", "b"])

        for batch in batches:
            column = batch.column("shingles")
            values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
            for k, (r, *one) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("region", "rep", "s")], strict=True)):
                if r != region:
                    if len(ids) > 1:
                        yield close()
                    region, ids, sets = r, [], []
                if not ids or one != ids[-1]:
                    ids.append(one)
                    sets.append(values[offsets[k] : offsets[k + 1]].copy())
        if len(ids) > 1:
            yield close()
        tidy()

    return regions.repartition("region").sortWithinPartitions("region", "rep", "s").mapInArrow(run, "a long, b long")


def _cut(members: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One cut of regions too large for a task: cells that shrank enough, and pairs of blocks of regions that did not."""
    r = 1 - percent / 100
    slack = 1e-9
    names = ["rep", "s", "shingles"]
    pick = lambda j: F.min(F.struct(F.xxhash64("s", F.lit(level * 100 + j)), "rep", "s"))
    sizes = members.groupBy("region").agg(F.sum(F.size("shingles")).alias("k"), *[pick(j).alias(f"p{j}") for j in range(PIVOTS)])
    chosen = F.array_distinct(F.array(*[F.struct(F.col(f"p{j}")["rep"].alias("rep"), F.col(f"p{j}")["s"].alias("s")) for j in range(PIVOTS)]))
    pivots = save(
        sizes.select("region", "k", F.posexplode(chosen).alias("cell", "pivot"))
        .join(members.select(F.col("region").alias("_r"), F.col("rep").alias("_i"), F.col("s").alias("_s"), F.col("shingles").alias("_p")), (F.col("region") == F.col("_r")) & (F.col("pivot.rep") == F.col("_i")) & (F.col("pivot.s") == F.col("_s")))
        .select("region", "k", "cell", "_p"), "pivots")
    packed = pivots.groupBy("region").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct("cell", "_p"))).alias("pivots"))  # PIVOTS entries
    common = lambda p: F.size(F.array_intersect("shingles", p["_p"]))
    distance = F.transform("pivots", lambda p: F.struct((1 - common(p) / (F.size("shingles") + F.size(p["_p"]) - common(p))).alias("d"), p["cell"].alias("cell")))
    measured = save(members.join(packed.withColumnRenamed("region", "_r"), F.col("region") == F.col("_r")).withColumn("d", distance).withColumn("near", F.array_min("d")).select("region", "k", *names, "d", "near"), "measured")
    far = F.col("near.d") >= 1 - r - slack
    radius = measured.where(~far).groupBy("region", F.col("near.cell").alias("cell")).agg(F.max("near.d").alias("radius"))
    radius = radius.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("cell", "radius"))).alias("radius"))  # PIVOTS entries
    cells = measured.join(radius.withColumnRenamed("region", "_r"), F.col("region") == F.col("_r"), "left")
    into = F.filter("d", lambda x: F.coalesce(x["d"] <= F.try_element_at("radius", x["cell"]) + r + slack, F.lit(False)) & (far | (x["d"] <= F.col("near.d") + 2 * r + slack)))
    into = F.concat(F.transform(into, lambda x: x["cell"]), F.when(far, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    cells = save(cells.select("region", "k", *names, F.explode(into).alias("cell")), "cells")
    shrunk = cells.groupBy("region", "k", "cell").agg(F.sum(F.size("shingles")).alias("c")).groupBy("region").agg((F.max("c") <= 0.5 * F.max("k")).alias("shrunk"))
    shrunk = save(shrunk, "shrunk").withColumnRenamed("region", "_r")
    again = cells.join(shrunk.where("shrunk"), F.col("region") == F.col("_r"), "left_semi").select(F.xxhash64("region", "cell", F.lit(level)).alias("region"), *names)
    dense = measured.join(shrunk.where("not shrunk"), F.col("region") == F.col("_r"), "left_semi")
    # two blocks hold two thirds of what a task may on average, so that uneven ones fit
    blocks = F.ceil(F.col("k") / (REGION_SHINGLES / 3.0)).cast("int")
    own = F.pmod(F.xxhash64("rep", "s", F.lit(-1 - level)), blocks).cast("int")
    dense = dense.withColumn("_n", blocks).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dense = dense.select(F.xxhash64("region", F.least("_own", "_other"), F.greatest("_own", "_other"), F.lit(-level)).alias("region"), *names)
    return again, dense


def classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id), one row per row of docs."""
    docs = bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    plan = Plan(docs, width, percent)
    scan = save(_scan(docs, plan), "shingle-scan")
    rows = scan.where("part is null").select("doc_id", "n", "s", "s2")
    kinds = rows.where("s is not null and doc_id is not null").groupBy("s", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"))
    kinds = save(kinds, "classes")

    scan.where("part is not null").select("part", "data").groupBy("part").applyInArrow(_store_levels(plan), "part int").agg(F.count("*")).first()
    near = _rows_of_tokens(docs.where("doc_id is not null"), plan).groupBy("part").applyInArrow(_edges_of_range, "a long, b long")
    regions = save(components(near).join(kinds.withColumnRenamed("s", "node"), "node").select("root", F.col("node").alias("s"), "s2", "rep", "n"), "regions")
    sized = regions.groupBy("root").agg(F.sum("n").alias("size")).withColumnRenamed("root", "_root")
    wanted = save(few(regions.join(sized, F.col("root") == F.col("_root")).select("rep", "s", "s2", F.col("root").alias("region"), "size"), regions.count()), "wanted")

    def fetched(part: DataFrame) -> DataFrame:
        part = F.broadcast(part) if part.count() <= BROADCAST_ROWS else part
        return _sets(docs.join(part, F.col("doc_id") == F.col("rep")), width)

    links = save(_join_regions(fetched(wanted.where(F.col("size") <= REGION_SHINGLES)), percent), "links")
    large = wanted.where(F.col("size") > REGION_SHINGLES)
    level = 0
    if not large.isEmpty():
        members = save(fetched(large), "large")
        while True:
            level += 1
            again, dense = _cut(members, percent, level)
            again = save(again, "members")
            sizes = save(again.groupBy("region").agg(F.sum(F.size("shingles")).alias("size"), F.count("*").alias("sets")), "sizes").withColumnRenamed("region", "_r")
            leaves = again.join(sizes.where((F.col("size") <= REGION_SHINGLES) & (F.col("sets") > 1)), F.col("region") == F.col("_r"), "left_semi")
            links = links.unionByName(save(_join_regions(leaves.unionByName(dense), percent), "links"))
            large = sizes.where((F.col("size") > REGION_SHINGLES) & (F.col("sets") > 1))
            if large.isEmpty():
                break
            members = save(again.join(large, F.col("region") == F.col("_r"), "left_semi"), "large")
    # rows of one doc_id join their sets; a set is named by its smallest doc_id
    several = rows.where("doc_id is not null and s is not null").groupBy("doc_id").agg(F.min(F.struct("s", "s2")).alias("lo"), F.max(F.struct("s", "s2")).alias("hi")).where("lo != hi").select(F.col("doc_id").alias("_d"))
    several = rows.where("s is not null").join(several, F.col("doc_id") == F.col("_d")).join(kinds.select("s", "s2", "rep"), ["s", "s2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    roots = components(links.unionByName(several))
    named = kinds.join(roots, F.col("rep") == F.col("node"), "left").where("root is not null or copies > 1").select(F.col("s").alias("_s"), F.col("s2").alias("_s2"), F.coalesce("root", "rep").alias("component_id"))
    known = save(named, "known")
    return rows.join(known, (F.col("s") == F.col("_s")) & (F.col("s2") == F.col("_s2")), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class left: that of the smallest doc_id. Same columns.

    Rows that repeat a kept doc_id are reduced to one; rows without a doc_id stay.
    """
    found = save(classes(docs, width, percent), "near-classes")
    repeated = save(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__near_id")), "repeated")
    losers = save(found.where("doc_id != component_id").select(F.col("doc_id").alias("__near_id")).unionByName(repeated).distinct(), "losers")
    gone = F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers
    kept = docs.join(gone, docs["doc_id"] == F.col("__near_id"), "left_anti")
    if repeated.isEmpty():
        return kept
    heads = repeated.join(found.where("doc_id = component_id").select("doc_id"), F.col("__near_id") == F.col("doc_id"), "left_semi")
    one = docs.join(heads, docs["doc_id"] == F.col("__near_id"), "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), F.xxhash64(*docs.columns))
    return kept.unionByName(one.withColumn("__near_n", F.row_number().over(first)).where("__near_n = 1").drop("__near_n"))


def op10_jaccard(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, n_shingles, component_id."""
    return classes(docs)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.n
"""
