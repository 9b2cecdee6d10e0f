"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles, as 64-bit hashes. Two permutations of 32-bit integers make all
signature coordinates: the first scatters the set, the second is shifted around its circle by another step for each
coordinate, and a coordinate is the least value over the set. Documents with equal sets become one class, which the
number of its first row stands for; classes that agree in any band of coordinates are candidates, and links are confirmed
on the full sets.

Buckets are not expanded into pairs. Each class is compared with its bucket's first class only, and confirmed links are
joined into components. What is left are classes of different components that share a first class: for each of them
its difference from that class is taken, and sizes of differences and of their overlaps give the exact intersection of
any two (common = first - lacking - lacking + overlap). This is worked out in blocks of bounded size, as sums over the
few shingles that differ, and only links that join components leave a block.

Cases: null, empty and wordless texts have empty sets and are linked with nothing: each is a component by itself, with its
own id (null or not), and stays; texts with fewer words than a shingle have the whole sequence as their one shingle;
repeated rows and ties have equal sets and one component. A component's id is its smallest one; a null id is larger than
any other, so that a row without an id goes where its component has a row with one, and a component without any id has a
null component_id and all its rows stay. Rows that share an id but not the text are judged each by its own text. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import NOT_SPACE, chunks, field, filter_over, join_hot, mixed, picked, pieces, token_hashes, tokens, written

BANDS, ROWS = 28, 4
#: Classes with one first class that a task holds against as many others (smaller blocks while they make MANY_BLOCKS parts
#: at most, which spreads a large group), and bytes of their differences, about.
BLOCK, SMALL_BLOCK, MANY_BLOCKS, BLOCK_BYTES = 600, 100, 32, 8 << 20
#: Rows of one first class that are joined with its set in one task, at least.
PART = 64
#: A shingle in more differences than this is counted by a matrix product, the others pair by pair.
DENSE = 48
_STEP = np.uint32(0x9E3779B1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text, its distinct shingles' hashes, sorted."""
    starts, ends, rows = tokens(data, offsets, NOT_SPACE)
    words = token_hashes(data, starts, ends)
    n = len(words)
    grams = np.zeros(n, np.uint64)
    for k in range(size):  # a void position (beyond the row) is overwritten below
        grams[: n - k] = mixed(grams[: n - k] * np.uint64(0x9E3779B97F4A7C15) + words[k:])
    out = []
    for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for w in words[a:b]:
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(whole ^ np.uint64(b - a))  # apart from shingles of another length
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of each set that is not empty: (sets, coordinates) of 32-bit integers."""
    out = np.empty((len(sets), coordinates), np.uint32)
    sizes = np.cumsum([0, *map(len, sets)])
    for a, b in chunks(sizes, 1 << 15):  # what fits a core's cache
        flat = np.concatenate(sets[a:b])
        first = (flat >> np.uint64(32)).astype(np.uint32)  # the first permutation: hashes are well mixed
        begin = sizes[a:b] - sizes[a]
        for k in range(coordinates):
            out[a:b, k] = np.minimum.reduceat(_permuted(first + np.uint32(k * int(_STEP) & 0xFFFFFFFF)), begin)
    return out


def set_digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def sets_of(docs: DataFrame, size: int, coordinates: int, held: list[str]) -> DataFrame:
    """row, id, text_hash, n (set size), set_key (a digest of the set; null where it is empty), signature, and ``held``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            sets = shingles(data, offsets, size)
            full = [s for s in sets if len(s)]
            made = iter(signatures(full, coordinates)) if full else iter(())
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(set_digest, sets)), pa.binary()), pa.array([next(made).tobytes() if len(s) else None for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["text_hash"], *columns, *(batch[c] for c in held)], names=["row", "id", "text_hash", "n", "set_key", "signature", *held])

    return docs.mapInArrow(run, f"row bigint, id {field(docs, 'id')}, text_hash bigint, n bigint, set_key binary, signature binary" + "".join(f", {c} {field(docs, c)}" for c in held))


def bands(classes: DataFrame, n_bands: int, n_rows: int) -> DataFrame:
    """bucket and rep: one row for each band of each class."""
    width = 4 * n_rows
    keys = [F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)) for i in range(n_bands)]
    return classes.select("rep", F.explode(F.array(*keys)).alias("bucket"))


def sets_needed(pairs: DataFrame, marked: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and set of every class in ``pairs`` (a, b).

    A filter over the hashes of the classes' first texts keeps the other documents back; a task hands each set on once,
    however many copies it reads.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    needed = written(marked.select("row", "text_hash", "set_key").join(nodes, "row", "left_semi"), "needed")
    wanted = filter_over(needed, "text_hash")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            some = batch.filter(pa.array(wanted(batch["text_hash"].to_numpy(zero_copy_only=False))))
            for data, offsets, _ in pieces([some]):
                own = {k: s for s in shingles(data, offsets, size) if (k := set_digest(s)) and k not in seen}
                seen.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([s.tobytes() for s in own.values()], pa.binary())], names=["set_key", "set"])

    found = docs.select("text", "text_hash").mapInArrow(sets, "set_key binary, set binary")
    # Another text with the same hash has another set, which no class in ``needed`` has.
    full = found.join(needed.select(F.col("row").alias("node"), "set_key"), "set_key").dropDuplicates(["node"]).select("node", "set")
    return written(full, "sets")


def with_sets(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...; written) with both sets, x and y.

    A first class that very many share is dealt out: its set goes to as many parts as its pairs need.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("pairs"))
    total = pairs.count()
    sizes = written(sizes.withColumn("split", F.ceil(F.col("pairs") / max(PART, total // 512)).cast("int")), "sizes")
    dealt = join_hot(pairs, sizes, "a", "pairs").withColumn("part", F.pmod(F.xxhash64("b"), F.col("split")).cast("int")).drop("pairs", "split")
    hubs = full.join(sizes, F.col("node") == F.col("a")).select("a", F.col("set").alias("x"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("part"))
    return dealt.join(full.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(hubs, ["a", "part"]).drop("part")


def confirmed(pairs: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough: 100 * common >= 100 * least * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * common >= round(100 * least) * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    kind = field(pairs, "a")
    # Sets whose sizes differ too much are not compared at all.
    sizes = F.octet_length("x"), F.octet_length("y")
    near = with_sets(pairs, full).where(F.least(*sizes) * 100 >= F.greatest(*sizes) * round(100 * least))
    return written(near.select("a", "b", "x", "y").mapInArrow(check, f"a {kind}, b {kind}"), "links")


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (a, b), by large and small stars.

    Each round ties every node's larger neighbours to its smallest one, then every node's smaller neighbours, until
    nothing changes; the distance to the smallest id falls by a power in each.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        new = written(tied, "edges")
        if new.count() == edges.count() and new.join(edges, ["u", "v"], "left_anti").isEmpty():
            break
        edges = new
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _overlaps(diffs: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two of the differences share: (n, n)."""
    n = len(diffs)
    out = np.zeros((n, n), np.float32)
    flat = np.concatenate(diffs) if diffs else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), [len(d) for d in diffs])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    cut = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(flat)))
    frequent = np.flatnonzero(size > DENSE)
    for k in range(0, len(frequent), 2000):
        part = frequent[k : k + 2000]
        held = np.zeros((n, len(part)), np.float32)
        held[row[np.concatenate([np.arange(cut[z], cut[z] + size[z]) for z in part])], np.repeat(np.arange(len(part)), size[part])] = 1
        out += held @ held.T
    for c in np.unique(size[(size > 1) & (size <= DENSE)]).tolist():
        rows = row[cut[size == c][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(c):
                if i != j:
                    np.add.at(out, (rows[:, i], rows[:, j]), 1)
    return out


def _leftover(stars: DataFrame, full: DataFrame, found: DataFrame, least: float, block: int) -> DataFrame:
    """Links (a, b) between classes of different components that share a first class (``stars``: a first, b other)."""
    known = stars.join(found.select(F.col("id").alias("b"), "component"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    known = written(known, "known")
    spans = known.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    open_ = written(join_hot(known, written(spans, "spans"), "a", "size").where("low != high").select("a", "b", "component"), "open")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, lacking, sizes, diffs = [], [], [], []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                diff = np.setxor1d(x, y, assume_unique=True)
                first.append(len(x))
                sizes.append(len(y))
                lacking.append((len(x) + len(diff) - len(y)) // 2)
                diffs.append(diff.tobytes())
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], batch["component"], pa.array(first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lacking, pa.int64()), pa.array(diffs, pa.binary())], names=["a", "b", "component", "first", "n", "lacking", "diff"])

    rows = with_sets(open_, full).select("a", "b", "component", "x", "y").mapInArrow(differences, "a bigint, b bigint, component bigint, first bigint, n bigint, lacking bigint, diff binary")
    rows = written(rows, "differences")
    # Classes of one component need no comparison: each of the group's largest component (main) meets those of the others
    # (rest) in a grid of two sides, and the rest meet each other in a triangle. Where few stand aside, as in most groups,
    # a class of the largest component is repeated once.
    parts = lambda m: F.least(F.ceil(m / min(block, SMALL_BLOCK)), F.greatest(F.lit(MANY_BLOCKS), F.ceil(m / block)))
    by = rows.groupBy("a", "component").agg(F.count("*").alias("m"), F.sum(F.octet_length("diff")).alias("bytes"))
    held = by.groupBy("a").agg(F.max_by(F.struct("component", "m", "bytes"), F.struct("m", -F.col("component"))).alias("most"), F.sum("m").alias("size"), F.sum("bytes").alias("bytes"))
    held = held.select("a", "size", F.col("most.component").alias("main"), F.col("most.m").alias("m"), F.col("most.bytes").alias("main_bytes"), (F.col("size") - F.col("most.m")).alias("rest"), (F.col("bytes") - F.col("most.bytes")).alias("rest_bytes"))
    heavy = lambda c: F.ceil(F.col(c) / BLOCK_BYTES)
    grids = {"main_parts": (parts(F.col("m")), "main_bytes"), "rest_parts": (F.ceil(F.col("rest") / block), "rest_bytes"), "own_parts": (parts(F.col("rest")), "rest_bytes")}
    held = written(held.select("a", "size", "main", *[F.greatest(n, heavy(c), F.lit(1)).cast("int").alias(name) for name, (n, c) in grids.items()]), "blocks")
    rows = join_hot(rows, held, "a", "size")
    place = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rows.withColumns({"is_main": F.col("component") == F.col("main"), "part": place("own_parts"), "main_at": place("main_parts"), "rest_at": place("rest_parts")})
    one = F.transform(upto("rest_parts"), lambda r: cell(1, F.col("main_at"), r))
    other = F.concat(F.transform(upto("main_parts"), lambda p: cell(1, p, F.col("rest_at"))), F.transform(upto("own_parts"), lambda o: cell(0, F.least(F.col("part"), o), F.greatest(F.col("part"), o))))
    rows = rows.withColumn("cell", F.explode(F.when(F.col("is_main"), one).otherwise(other)))
    rows = rows.select("a", "b", "component", "first", "n", "lacking", "diff", "is_main", "part", "cell.*")

    def compare(key, table):
        kind, i, j = (k.as_py() for k in key[1:])
        ids, names, part = table["b"].to_pylist(), table["component"].to_pylist(), table["part"].to_numpy()
        n, lacking, first = table["n"].to_numpy(), table["lacking"].to_numpy(), table["first"][0].as_py()
        common = first - lacking[:, None] - lacking[None, :] + _overlaps([np.frombuffer(d, np.uint64) for d in table["diff"].to_pylist()])
        linked = 100 * common >= round(100 * least) * (n[:, None] + n[None, :] - common)
        main = table["is_main"].to_numpy(zero_copy_only=False)
        linked &= main[:, None] & ~main[None, :] if kind else (part[:, None] == i) & (part[None, :] == j)
        root = {c: c for c in names}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for x, y in np.argwhere(linked).tolist():
            c, d = top(names[x]), top(names[y])
            if c != d:
                root[max(c, d)] = min(c, d)
                out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return pa.table({"a": pa.array([p[0] for p in out], table.schema.field("b").type), "b": pa.array([p[1] for p in out], table.schema.field("b").type)})

    return rows.groupBy("a", "kind", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, n_bands: int = BANDS, n_rows: int = ROWS, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, n_shingles, component_id (the smallest id reachable over links, its own included), kept; and ``carry``.

    ``carry`` names columns of ``docs`` that the result repeats.
    """
    held = {f"c{i}": c for i, c in enumerate(carry)}
    rows = picked(docs, id=id_col, text=text_col, **held).withColumn("text_hash", F.xxhash64("text"))
    # Row numbers hold from here on, since they are read back from what is written.
    marked = written(sets_of(rows.withColumn("row", F.monotonically_increasing_id()), size, n_bands * n_rows, list(held)), "marked")
    grouped = marked.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("rep"), F.min("id").alias("least_id"), F.count("*").alias("copies"), F.min("signature").alias("signature"))
    grouped = written(grouped, "classes")
    buckets = bands(grouped, n_bands, n_rows)
    first = buckets.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("size")).where("size > 1").select("bucket", "first")
    buckets = buckets.join(first, "bucket")
    stars = written(buckets.where("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    full = sets_needed(stars, marked, rows, size)
    links = confirmed(stars, full, least)
    found = written(components(links), "components")
    more = written(_leftover(stars, full, found, least, block), "leftover")
    if not more.isEmpty():
        found = written(components(links.unionByName(more)), "components")
    classes = grouped.select("set_key", "rep", "least_id", "copies").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = classes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = written(classes.join(named, "component").select("set_key", "copies", "component_id"), "facts")
    out = join_hot(marked.select("id", "n", "set_key", *held), facts, "set_key", "copies")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *[F.col(c).alias(name) for c, name in held.items()])
