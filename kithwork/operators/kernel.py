"""Distances from many sources by level-synchronous sets of packed bits.

Bit s of row v says that source s is within d hops of v. A level ORs every open row with its neighbours; what is newly
set lies at distance d. Vertices are numbered by component and falling degree: a chunk of sources works on the rows of
its own components only, a tile of rows takes its first neighbours, then its second ones, and so on, and a row that has
all sources of its chunk is left alone. Tasks take chunks of sources, so no task holds all pairs; the edges are
broadcast, which the caller allows only for at most MAX_EDGES or MAX_PLAIN of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Directed edges with weights that may be collected and broadcast (16 bytes each).
MAX_EDGES = 5_000_000
#: Directed edges without weights that may be (4 bytes each, 8 on the way).
MAX_PLAIN = 16_000_000
#: Bytes of reached bits that a task may hold.
LEVEL_BYTES = 256 << 20
#: Words of sources in a chunk at most: a row of them is two lines of a processor's cache.
MAX_WORDS = 16
#: Bytes of a tile of rows, and of the rows whose new bits are looked at together; both stay in a processor's cache.
TILE_BYTES, GROUP_BYTES = 1 << 17, 1 << 21
#: A row with more neighbours than this is reduced by itself.
HEAVY = 256
#: Walks that are counted exactly; more of them bound nothing.
MANY = 1e15


def _components(first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component: hooks to the least neighbour and pointer jumps until nothing changes."""
    label = np.arange(len(first) - 1)
    start = np.repeat(label, np.diff(first))
    while True:
        a, b = label[start], label[after]
        differ = a != b
        if not differ.any():
            return label
        start, after, a, b = start[differ], after[differ], a[differ], b[differ]
        high, low = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        top = np.concatenate(([True], high[1:] != high[:-1]))
        label[high[top]] = low[top]
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further


class Graph:
    """Symmetric edges by start vertex; vertices are numbered by component, those of more neighbours first."""

    ordered = True

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        known = np.unique(src)
        a, b = (np.searchsorted(known, x).astype(np.int32) for x in (src, dst))
        n = len(known)
        first, after = _rows(a, b, n)
        label, degree = _components(first, after), np.diff(first)
        order = np.lexsort((-degree, label))
        number = np.empty(n, np.int32)
        number[order] = np.arange(n, dtype=np.int32)
        self.known, self.number, self.ids = known, number, known[order]
        self.first, self.next = _rows(number[a], number[b], n)
        self.degree = np.diff(self.first)
        label = label[order]
        self.starts = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1]))) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.append(self.starts, n))

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of ``ids``, -1 of those that are no vertex."""
        if not len(self.known):
            return np.full(len(ids), -1, np.int64)
        at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
        return np.where(self.known[at] == ids, self.number[at], -1).astype(np.int64)

    def span(self, low: int, high: int) -> tuple[int, int]:
        """The rows of the components of vertices ``low`` to ``high``."""
        a, b = np.searchsorted(self.starts, [low, high], side="right") - 1
        return int(self.starts[a]), int(self.starts[b] + self.sizes[b])

    def chunks(self, sources: np.ndarray) -> list[tuple[int, int]]:
        """Slices of ``sources`` (rising numbers) that are done together."""
        out, low = [], 0
        while low < len(sources):
            width = self.width(sources[low], sources[min(low + 64 * MAX_WORDS, len(sources)) - 1])
            out.append((low, min(low + width, len(sources))))
            low += width
        return out

    def width(self, low: int, high: int) -> int:
        a, b = self.span(low, high)
        return 64 * max(1, min(MAX_WORDS, LEVEL_BYTES // (16 * (b - a))))

    def levels(self, sources: np.ndarray, max_depth: int | None) -> Iterator[tuple[int, int | np.ndarray, np.ndarray, bool]]:
        """From ``sources`` (rising numbers), level by level from 0 until nothing is new:

        (distance, numbers of rows, their new bits, False) for the rows of distance 1 or more, a group at a time, then
        (distance, first row, bits reached within it [row, 64-bit word], True). It holds until the next is asked for.
        """
        if not len(sources):
            return
        low, high = self.span(sources[0], sources[-1])
        words, bit = -(-len(sources) // 64), np.arange(len(sources))
        now, then = np.zeros((high - low, words), np.uint64), np.zeros((high - low, words), np.uint64)
        np.bitwise_or.at(now, (sources - low, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        full = np.bitwise_or.reduce(now, axis=0)
        sorted_ = self.ordered and high - low == self.sizes[np.searchsorted(self.starts, low)]
        first, degree = self.first[low : high + 1], self.degree[low:high]
        tile, group = max(1, TILE_BYTES // (8 * words)), max(1, GROUP_BYTES // (8 * words))
        buffer, new = np.empty((tile, words), np.uint64), np.empty((group, words), np.uint64)
        touched, open_ = np.zeros(high - low, bool), np.ones(high - low, bool)
        edge, closed, rows, d = np.unique(sources) - low, np.zeros(0, np.int64), None, 0
        touched[edge] = True
        yield 0, low, now, True
        while max_depth is None or d < max_depth:
            d += 1
            if len(edge):
                near = touched.copy()
                near[self._beside(first, edge) - low] = True
                edge = np.flatnonzero(near & ~touched)
                touched, rows = near, None if len(edge) else rows
            then[closed] = full
            if rows is None or len(closed):
                rows = np.flatnonzero(touched & open_)
                if not sorted_:
                    rows = rows[np.argsort(-degree[rows], kind="stable")]
            done, some_new = [], False
            for at in range(0, len(rows), group):
                own = rows[at : at + group]
                bits = new[: len(own)]
                for inner in range(0, len(own), tile):
                    part, out = own[inner : inner + tile], bits[inner : inner + tile]
                    self._gather(now, low, first, degree, part, out, buffer)
                    old = np.take(now, part, axis=0, out=buffer[: len(part)], mode="clip")
                    np.bitwise_or(out, old, out=out)
                    then[part] = out
                    done.append(part[(out == full).all(1)])
                    np.bitwise_xor(out, old, out=out)
                changed = np.flatnonzero(bits.any(1))
                if len(changed):
                    some_new = True
                    yield d, own[changed] + low, bits[changed] if len(changed) < len(own) else bits, False
            closed = np.concatenate(done) if done else closed[:0]
            open_[closed] = False
            now, then = then, now
            if not some_new:
                return
            yield d, low, now, True

    def _beside(self, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
        n = first[rows + 1] - first[rows]
        return self.next[np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def _gather(self, now: np.ndarray, low: int, first: np.ndarray, degree: np.ndarray, rows: np.ndarray, out: np.ndarray, buffer: np.ndarray) -> None:
        """``out``: the OR of the neighbours of ``rows``, which come by falling degree."""
        n, start = degree[rows], first[rows]
        heavy = int(np.searchsorted(-n, -HEAVY, side="left"))
        for i in range(heavy):
            out[i] = 0
            for at in range(start[i], start[i] + n[i], len(buffer)):
                own = self.next[at : min(at + len(buffer), start[i] + n[i])] - low
                out[i] |= np.bitwise_or.reduce(np.take(now, own, axis=0, out=buffer[: len(own)], mode="clip"), axis=0)
        out, start, n = out[heavy:], start[heavy:], n[heavy:]
        if not len(n):
            return
        counts = np.searchsorted(-n, -np.arange(int(n[0])), side="left").tolist()  # rows of more than j neighbours
        if not counts:
            out[:] = 0
        for j, c in enumerate(counts):
            own = self.next[start[:c] + j] - low
            if j:
                np.bitwise_or(out[:c], np.take(now, own, axis=0, out=buffer[:c], mode="clip"), out=out[:c])
            else:
                np.take(now, own, axis=0, out=out[:c], mode="clip")
                out[c:] = 0

    def least_sums(self, deepest: int = 40) -> tuple[np.ndarray, np.ndarray]:
        """(r, s): vertices that each vertex reaches, and a bound from below of the sum of their distances.

        At distance d lie no more vertices than walks of d steps that never turn back at once. Their number is that of
        the neighbours' walks of d - 1 steps without those that begin by coming back.
        """
        r = np.repeat(self.sizes, self.sizes) - 1
        left, s = r.astype(np.float64), np.zeros(len(r))
        before, walks = np.ones(len(r)), self.degree.astype(np.float64)
        for d in range(1, deepest + 1):
            here = np.minimum(left, walks)
            s += d * here
            left -= here
            if not left.any():
                break
            total = np.add.reduceat(walks[self.next], self.first[:-1])
            further = total - (before * (self.degree - 1) if d > 1 else self.degree)
            before, walks = walks, np.where(total < MANY, further, np.inf)
        return r, (s + left * (deepest + 1)).astype(np.int64)


def _rows(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the ``n`` rows, and their entries: ``b`` by ``a``."""
    first = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a, minlength=n), out=first[1:])
    return first, b[np.argsort(a, kind="stable")].astype(np.int32)


def column_counts(bits: np.ndarray) -> np.ndarray:
    """How many rows of ``bits`` [row, 64-bit word] have each bit: rows are added three to two, as adders do, until few are left."""
    total, weight = np.zeros(64 * bits.shape[1], np.int64), 1
    while len(bits):
        carries = []
        while len(bits) > 8:
            third = len(bits) // 3
            a, b, c, rest = bits[:third], bits[third : 2 * third], bits[2 * third : 3 * third], bits[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            half ^= c
            bits = np.concatenate([half, rest]) if len(rest) else half
        total += weight * np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits, weight = np.concatenate(carries) if carries else bits[:0], 2 * weight
    return total


def collect(edges: DataFrame) -> Graph:
    """The graph of symmetric ``edges`` (src, dst); refused beyond MAX_PLAIN. Each edge is sent in one direction."""
    table = edges.select("src", "dst").filter("src <= dst").limit(MAX_PLAIN + 1).toArrow()
    a, b = table.column(0).to_numpy(), table.column(1).to_numpy()
    if 2 * len(a) > MAX_PLAIN:
        raise ValueError(f"more than {MAX_PLAIN} edges: use the frontier")
    return Graph(np.concatenate([a, b]), np.concatenate([b, a]))


def _numbers(graph: Graph, edges: DataFrame, sources: DataFrame) -> np.ndarray:
    """Rising numbers of those ``sources`` (src) that are vertices: no more than the graph has."""
    held = sources.select(F.col("src").cast("long")).join(edges.select("src"), "src", "left_semi").distinct().toArrow()
    return np.sort(graph.find(held.column(0).to_numpy()))


def _each(spark: SparkSession, n: int, do: Callable[[int], Iterable[pa.RecordBatch]], schema: str, tasks: int = 16) -> DataFrame:
    """What ``do`` makes of each of the numbers 0 to n - 1, in as many as ``tasks`` tasks a core."""
    parts = max(1, min(n, tasks * spark.sparkContext.defaultParallelism))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from do(i)

    return spark.range(0, n, 1, parts).mapInArrow(work, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, keep: str = "all") -> DataFrame:
    """(src, node, dist) from ``sources`` (src) within ``max_depth`` hops, the source itself at 0.

    ``keep``: ``all`` pairs, or ``pairs`` of two sources with src < node.
    """
    graph = collect(edges)
    own = _numbers(graph, edges, sources)
    chunks = graph.chunks(own)
    shared = edges.sparkSession.sparkContext.broadcast((graph, own))
    pairs = keep == "pairs"

    def do(i: int) -> Iterator[pa.RecordBatch]:
        graph, own = shared.value
        part = own[slice(*chunks[i])]
        ids = graph.ids[part]
        if not pairs:
            yield _batch(src=ids, node=ids, dist=np.zeros(len(ids), np.int64))
        wanted = np.zeros(len(graph.ids) if pairs else 0, bool)
        wanted[own if pairs else []] = True
        for d, rows, fresh, whole in graph.levels(part, max_depth):
            if whole:
                continue
            kept = np.flatnonzero(wanted[rows]) if pairs else np.arange(len(rows))
            for some in np.array_split(kept, len(kept) * fresh.shape[1] // 4096 + 1):
                node, bit = np.nonzero(np.unpackbits(fresh[some].view(np.uint8), axis=1, bitorder="little"))
                src, nodes = ids[bit], graph.ids[rows[some]][node]
                if pairs:
                    src, nodes = src[src < nodes], nodes[src < nodes]
                if len(src):
                    yield _batch(src=src, node=nodes, dist=np.full(len(src), d, np.int64))

    found = _each(edges.sparkSession, len(chunks), do, "src long, node long, dist long")
    if pairs:
        return found
    lonely = sources.select(F.col("src").cast("long")).distinct().join(edges.select("src"), "src", "left_anti")
    return found.unionByName(lonely.filter("src IS NOT NULL").select("src", F.col("src").alias("node"), F.lit(0).cast("long").alias("dist")))


class Weighted:
    """A graph with weights, of which the part above a threshold can be had without sorting again."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        self.ids, codes = np.unique(np.concatenate([src, dst]), return_inverse=True)
        order = np.argsort(codes[: len(src)], kind="stable")
        self.start, self.next, self.weight = codes[: len(src)][order].astype(np.int32), codes[len(src) :][order].astype(np.int32), weight[order]

    def above(self, least: int) -> Graph:
        kept = self.weight > least
        graph = Graph.__new__(Graph)
        # numbered by id, and taken as one component: only the work grows
        graph.ordered, graph.ids, graph.known, graph.number = False, self.ids, self.ids, np.arange(len(self.ids), dtype=np.int32)
        graph.first = np.zeros(len(self.ids) + 1, np.int64)
        np.cumsum(np.bincount(self.start[kept], minlength=len(self.ids)), out=graph.first[1:])
        graph.next, graph.degree = self.next[kept], np.diff(graph.first)
        graph.starts, graph.sizes = np.zeros(1, np.int64), np.array([len(self.ids)])
        return graph


def load(edges: DataFrame):
    """Symmetric ``edges`` (src, dst, weight) as a broadcast Weighted, None if there are more than MAX_EDGES."""
    table = edges.select("src", "dst", "weight").limit(MAX_EDGES + 1).toArrow()
    if table.num_rows > MAX_EDGES:
        return None
    return edges.sparkSession.sparkContext.broadcast(Weighted(*(table.column(i).to_numpy() for i in range(3))))


def hops(shared, asked: DataFrame) -> DataFrame:
    """``asked`` (src, dst, least, depth) with ``dist`` where dst is within ``depth`` hops (null: any) of src over edges of a weight above ``least``.

    Only what is asked for leaves a task, and a chunk of sources stops at the level that met the last of its goals.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).fill_null(-1).to_numpy()] for b in batches if b.num_rows]
        if not held:
            return
        src, dst, least, depth = (np.concatenate(x) for x in zip(*held, strict=True))
        whole = shared.value
        for limit, far in np.unique(np.stack([least, depth], 1), axis=0).tolist():
            graph = whole.above(limit)
            own = np.flatnonzero((least == limit) & (depth == far))
            start, goal = graph.find(src[own]), graph.find(dst[own])
            own, start, goal = (x[(start >= 0) & (goal >= 0)] for x in (own, start, goal))
            sources, place = np.unique(start, return_inverse=True)
            for low, high in graph.chunks(sources):
                some = np.flatnonzero((place >= low) & (place < high))
                bit, at = place[some] - low, goal[some]
                found, open_ = np.full(len(some), -1, np.int64), np.arange(len(some))
                for d, base, reached, level in graph.levels(sources[low:high], None if far < 0 else far):
                    if level:
                        met = (reached[at[open_] - base, bit[open_] >> 6] >> (bit[open_] & 63).astype(np.uint64)) & np.uint64(1) == 1
                        found[open_[met]] = d
                        open_ = open_[~met]
                        if not len(open_):
                            break
                hit = np.flatnonzero(found >= 0)
                if len(hit):
                    yield _batch(src=src[own[some[hit]]], dst=dst[own[some[hit]]], least=np.full(len(hit), limit, np.int64), dist=found[hit])

    rows = asked.select(*(F.col(c).cast("long") for c in ("src", "dst", "least", "depth"))).filter("src IS NOT NULL AND dst IS NOT NULL")
    # they are few and short, but each means work
    dealt = rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), "least", "src")
    return dealt.mapInArrow(work, "src long, dst long, least long, dist long")


def histogram(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, dist, n): how many vertices lie at each distance of 1 or more from each of ``sources`` (src). A task's rows are final."""
    graph = collect(edges)
    own = _numbers(graph, edges, sources)
    chunks = graph.chunks(own)
    shared = edges.sparkSession.sparkContext.broadcast((graph, own))

    def do(i: int) -> Iterator[pa.RecordBatch]:
        graph, own = shared.value
        part = own[slice(*chunks[i])]
        for d, n in _profile(graph, part, max_depth):
            hit = np.flatnonzero(n)
            yield _batch(node=graph.ids[part[hit]], dist=np.full(len(hit), d, np.int64), n=n[hit])

    return _each(edges.sparkSession, len(chunks), do, "node long, dist long, n long")


def _profile(graph: Graph, part: np.ndarray, max_depth: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(distance, number of vertices there from each source of ``part``), from 1 on."""
    n = np.zeros(len(part), np.int64)
    for d, _, fresh, whole in graph.levels(part, max_depth):
        if whole and d:
            yield d, n
            n = np.zeros(len(part), np.int64)
        elif not whole:
            n += column_counts(fresh)[: len(part)]


def sums_from(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, met, known): how many of ``sources`` (src) each other vertex reaches, and the sum of their distances."""
    graph = collect(edges)
    own = _numbers(graph, edges, sources)
    chunks = graph.chunks(own)
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast((graph, own))
    tasks = max(1, min(len(chunks), 4 * spark.sparkContext.defaultParallelism))

    def do(i: int) -> Iterator[pa.RecordBatch]:
        graph, own = shared.value
        met, known = np.zeros(len(graph.ids), np.int64), np.zeros(len(graph.ids), np.int64)
        for low, high in chunks[i::tasks]:
            for d, rows, fresh, whole in graph.levels(own[low:high], None):
                if not whole:
                    n = np.bitwise_count(fresh).sum(1, dtype=np.int64)
                    met[rows] += n
                    known[rows] += d * n
        hit = np.flatnonzero(met)
        yield _batch(node=graph.ids[hit], met=met[hit], known=known[hit])

    parts = _each(spark, tasks if chunks else 0, do, "node long, met long, known long")
    return parts.groupBy("node").agg(F.sum("met").alias("met"), F.sum("known").alias("known"))


def central(r: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
    """As closeness.centrality: the same operations in the same order."""
    return np.where(s > 0, (r * r).astype(np.float64) / np.maximum(s, 1).astype(np.float64) / np.float64(max(size - 1, 1)), 0.0)


def most_central(spark: SparkSession, edges: pa.Table, asked: dict[str, tuple[int, int]]) -> DataFrame:
    """(name, node, r, s): the k most central vertices, ties by id, of each of the graphs in ``edges`` (name, src, dst; src <= dst).

    ``asked``: k and the number of members by name. Sums are exact for those whose bound may reach the k-th best value
    found; the vertices of a round, of all graphs together, are one job.
    """
    code = edges.column("name").combine_chunks().dictionary_encode()
    number, names = code.indices.to_numpy(zero_copy_only=False), code.dictionary.to_pylist()
    a, b = edges.column("src").to_numpy(), edges.column("dst").to_numpy()
    graphs = []
    for i in range(len(names)):
        own = np.flatnonzero(number == i)
        graphs.append(Graph(np.concatenate([a[own], b[own]]), np.concatenate([b[own], a[own]])))
    cores, shared = spark.sparkContext.defaultParallelism, spark.sparkContext.broadcast(graphs)
    state = []
    for name, graph in zip(names, graphs, strict=True):
        r, least = graph.least_sums()
        bound = central(r, least, asked[name][1])
        state.append({"order": np.lexsort((graph.ids, -bound)), "bound": bound, "r": r, "at": 0, "best": np.zeros(0)})
    out: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]] = []
    first = True
    while True:
        chunks: list[tuple[int, np.ndarray]] = []
        for i, x in enumerate(state):
            k = asked[names[i]][0]
            worst = x["best"][k - 1] if len(x["best"]) >= k > 0 else -1.0
            # ties go by id, so equal bounds are looked at too
            end = int(np.searchsorted(-x["bound"][x["order"]], -worst, side="right")) if k > 0 else 0
            end = min(end, x["at"] + max(4 * k, 64 * cores if first else 64 * MAX_WORDS * cores))
            own = np.sort(x["order"][x["at"] : end])
            x["at"] = max(x["at"], end)
            width = max(64, min(64 * MAX_WORDS, -(-len(own) // cores)))
            low = 0
            while low < len(own):
                high = min(len(own), low + width)
                high = min(high, low + graphs[i].width(own[low], own[high - 1]))
                chunks.append((i, own[low:high]))
                low = high
        if not chunks:
            break
        first = False
        todo = spark.sparkContext.broadcast(chunks)

        def do(j: int, todo=todo) -> Iterator[pa.RecordBatch]:
            i, part = todo.value[j]
            s = np.zeros(len(part), np.int64)
            for d, n in _profile(shared.value[i], part):
                s += d * n
            yield _batch(graph=np.full(len(part), i), vertex=part, s=s)

        found = _each(spark, len(chunks), do, "graph long, vertex long, s long").toArrow()
        graph_of, vertex, s = (found.column(c).to_numpy() for c in range(3))
        todo.unpersist()
        for i, x in enumerate(state):
            own = graph_of == i
            if own.any():
                r = x["r"][vertex[own]]
                k, size = asked[names[i]]
                values = np.concatenate([x["best"], central(r, s[own], size)])
                x["best"] = -np.sort(-values)[:k]
                out.append((names[i], graphs[i].ids[vertex[own]], r, s[own]))
    schema = "name string, node long, r long, s long"
    if not out:
        return spark.createDataFrame([], schema)
    # only those that may be among the first leave the driver
    rows = []
    for i, name in enumerate(names):
        mine = [x for x in out if x[0] == name]
        if mine:
            node, r, s = (np.concatenate([x[c] for x in mine]) for c in (1, 2, 3))
            k, size = asked[name]
            kept = np.lexsort((node, -central(r, s, size)))[:k]
            rows += [(name, *map(int, v)) for v in zip(node[kept], r[kept], s[kept], strict=True)]
    return spark.createDataFrame(rows, schema)
