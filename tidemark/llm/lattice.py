"""Near-duplicate vectors of a label by E8 lattice hashing.

In each of several tables a random projection takes a unit vector to eight numbers, whose nearest point of the E8 lattice is its cell. A
vector stands in its own cell and also looks into neighbouring cells, those whose points come next nearest. Pairs that meet are
compared by cosine in double precision.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release, shuffle_partitions
from tidemark.llm.components import components
from tidemark.llm.shingle_sets import mix

#: Tables, cells that a vector looks into besides its own, and the projections' scale (larger: smaller cells).
TABLES, PROBES, SCALE = 6, 16, 1.1
#: Signs of random projections that are compared before vectors are; pairs at the cosine sought differ in about SIGN_BITS * 0.12 of them.
SIGN_BITS = 128
#: Standard deviations that a pair's signs may differ beyond what the cosine sought lets expect.
SIGN_SLACK = 6.0
#: Vectors of a cell that one task compares with each other.
BLOCK = 2000
_U = np.uint64


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all entries of a half with an even number of signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) / 2 for v in product((1, -1), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(out)


_ROOTS = roots()


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: the nearer of the nearest whole point of even sum and the nearest such point moved by a half."""

    def even(x):
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cells(y: np.ndarray, probes: int) -> np.ndarray:
    """For each row the nearest lattice point and then ``probes`` others by distance: rows x (1 + probes) x 8."""
    own = nearest_e8(y)
    rest = y - own
    order = np.argsort(-(rest @ _ROOTS.T), axis=1, kind="stable")[:, :probes]  # all roots are equally long
    return np.concatenate([own[:, None], own[:, None] + _ROOTS[order]], axis=1)


def cell_keys(unit: np.ndarray, label: np.ndarray, tables: int, probes: int, scale: float, seed: int = 5) -> np.ndarray:
    """Keys of the cells of unit vectors: rows x tables x (1 + probes)."""
    random = np.random.default_rng(seed)
    d = unit.shape[1]
    weights = np.random.default_rng(99).integers(1, 1 << 62, 8, dtype=np.uint64) * _U(2) + _U(1)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        y = scale * (unit @ random.normal(size=(d, 8))) + random.uniform(0, 2, 8)
        at = np.rint(2 * cells(y, probes)).astype(np.int64).view(_U)
        key = (at * weights).sum(2, dtype=_U) + mix(label.astype(np.int64).view(_U) * _U(1000) + _U(t))[:, None]
        out[:, t] = mix(key).view(np.int64)
    return out


def signs(unit: np.ndarray, seed: int = 6) -> np.ndarray:
    """SIGN_BITS signs of random projections of each row, packed to 64-bit numbers."""
    return np.packbits(unit @ np.random.default_rng(seed).normal(size=(unit.shape[1], SIGN_BITS)) >= 0, axis=1).view(np.int64)


def most_signs(cosine: float) -> int:
    """Signs in which a pair of this cosine may differ."""
    p = np.arccos(min(1.0, cosine)) / np.pi
    return int(np.ceil(SIGN_BITS * p + SIGN_SLACK * np.sqrt(SIGN_BITS * p * (1 - p))))


def _vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, k1, k2, v: vectors as doubles with two hashes of them; v is null where a vector can't link."""

    def run(batches):
        for batch in batches:
            ids, label = batch.column(0), batch.column(2)
            keys1, keys2, packed = [], [], []
            for e, one, i in zip(batch.column(1), label, ids, strict=True):
                x = None if not e.is_valid or e.values.null_count else np.asarray(e.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                if x is None or not len(x) or not one.is_valid or not i.is_valid or not np.isfinite(x).all() or not x.any():
                    keys1.append(0), keys2.append(0), packed.append(None)
                    continue
                bits = (x + 0.0).view(_U)
                place = np.arange(1, len(x) + 1, dtype=np.uint64)
                h = np.array([mix(bits ^ mix(place)).sum(dtype=_U), mix(bits ^ mix(place * _U(77))).sum(dtype=_U)]).view(np.int64)
                keys1.append(int(h[0])), keys2.append(int(h[1])), packed.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), pa.array(packed, pa.binary())], names=["vec_id", "label", "k1", "k2", "v"])

    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    return plain.mapInArrow(run, "vec_id long, label long, k1 long, k2 long, v binary")


def _units(values: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(classes: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """cell, rep, looks (false: it stands there), s1, s2 of each class and cell."""

    def run(batches):
        for batch in batches:
            reps, labels, values = (batch.column(i).to_pylist() for i in range(3))
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(values):
                by_length.setdefault(len(v), []).append(i)
            for rows in by_length.values():
                for at in range(0, len(rows), 1000):
                    own = rows[at : at + 1000]
                    unit = _units([values[i] for i in own])
                    keys = cell_keys(unit, np.array([labels[i] for i in own]) * 4096 + unit.shape[1], tables, probes, scale)
                    n = keys.shape[1] * keys.shape[2]
                    looks = np.zeros(keys.shape, bool)
                    looks[:, :, 1:] = True
                    s = np.repeat(signs(unit), n, axis=0)
                    rep = np.repeat(np.array([reps[i] for i in own], np.int64), n)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(rep), pa.array(looks.reshape(-1)), pa.array(np.ascontiguousarray(s[:, 0])), pa.array(np.ascontiguousarray(s[:, 1]))], names=["cell", "rep", "looks", "s1", "s2"])

    return classes.select("rep", "label", "v").mapInArrow(run, "cell long, rep long, looks boolean, s1 long, s2 long")


def _meetings(entries: DataFrame, most: int, buckets: int) -> DataFrame:
    """Pairs a < b that meet in a cell where at least one of them stands, and whose signs differ little enough."""
    crowded = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.max(~F.col("looks")).alias("stands")).where("m > 1 and stands")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = entries.join(crowded, "cell").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    units = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j)))
    rows = rows.select("cell", F.explode(units).alias("unit"), "part", "rep", "looks", "s1", "s2")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("cell", "unit"), F.lit(buckets)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        cell, unit, part, rep, looks, s1, s2 = (table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("cell", "unit", "part", "rep", "looks", "s1", "s2"))
        s1, s2 = s1.view(_U), s2.view(_U)
        order = np.lexsort((looks, part, unit, cell))
        edge = np.concatenate([[0], np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(unit[order]) != 0)) + 1, [len(order)]])
        a, b = [], []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            at = order[i:j]
            split = np.searchsorted(part[at], part[at[0]], side="right")
            across = split < len(at)
            for x in range(split if across else len(at) - 1):
                rest = at[split:] if across else at[x + 1 :]
                if looks[at[x]]:
                    rest = rest[~looks[rest]]
                if len(rest):
                    near = np.bitwise_count(s1[rest] ^ s1[at[x]]).astype(np.int64) + np.bitwise_count(s2[rest] ^ s2[at[x]]) <= most
                    rest = rest[near]
                    a.append(np.full(len(rest), rep[at[x]]))
                    b.append(rep[rest])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return rows.groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def lattice_links(embeddings: DataFrame, cosine: float = 0.93, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept: the vectors linked with each one, and the smallest vec_id that links lead to.

    Vectors of equal label and dimension that meet in a cell link if their cosine, in double precision, is at least ``cosine``. Equal vectors of a
    label are one class: they link without being paired, and each counts as a link. Rows with a null label or id, and vectors that are
    null, empty, zero or hold null or non-finite components link with nothing; repeated rows of an id and vector count once.
    """
    spark = embeddings.sparkSession
    rows = cut(_vectors(embeddings))
    some = rows.where("v is not null")
    classes = some.groupBy("label", "k1", "k2", "vec_id").agg(F.first("v").alias("v"))
    classes = cut(classes.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    # An id with several vectors would name several classes; they are told apart by a number.
    named = cut(classes.withColumn("class", F.xxhash64("label", "k1", "k2")))
    n = named.count()
    buckets = max(shuffle_partitions(spark), -(-n * tables * (1 + probes) // 400_000))
    entries = cut(_entries(named.select(F.col("class").alias("rep"), "label", "v"), tables, probes, scale))
    pairs = cut(_meetings(entries, most_signs(cosine), buckets))
    release(spark)
    one = named.select(F.col("class").alias("a"), F.col("v").alias("va"), F.col("copies").alias("na"), F.col("rep").alias("ra"))
    two = named.select(F.col("class").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("nb"), F.col("rep").alias("rb"))

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _units(batch.column(4).to_pylist()), _units(batch.column(5).to_pylist())
            ok = (x * y).sum(1) >= cosine
            yield from pa.Table.from_batches([batch]).select(["ra", "rb", "na", "nb", "a", "b"]).filter(pa.array(ok)).to_batches()

    both = pairs.join(one, "a").join(two, "b").select("ra", "rb", "na", "nb", "va", "vb", "a", "b").where("length(va) = length(vb)")
    links = cut(both.mapInArrow(compare, "ra long, rb long, na long, nb long, a long, b long"))
    ends = links.select(F.col("a").alias("class"), F.col("nb").alias("k")).union(links.select(F.col("b").alias("class"), F.col("na").alias("k")))
    number = ends.groupBy("class").agg(F.sum("k").alias("k"))
    groups = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    known = named.join(number, "class", "left").join(groups, F.col("rep") == F.col("id"), "left")
    known = cut(known.select("label", "k1", "k2", (F.col("copies") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    out = some.join(known, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("v is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
