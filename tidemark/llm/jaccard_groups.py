"""Jaccard join of shingle sets by a token-group matrix, and the components of its links.

Documents with equal sets are one class. A set's tokens are ordered alike everywhere, frequent ones last, and only the first ones enter the
matrix: two sets that are similar enough share some of those. Classes that prove similar to a leader they share tokens with form groups. The
matrix then holds, for each token, the groups whose union has it; tokens that stand in just the same sets are one row with a weight. Where a
token stands in one group only, no query overlaps another group. Elsewhere sizes and parity maps tell which members could be alike; what a
query shares with the union of a group's members is counted before they are opened, and of a group that passes each member's own overlap.
Pairs that are left are compared set by set. Bounds never lose a pair: they follow from the threshold alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, release, shuffle_partitions, slices
from tidemark.llm.components import components
from tidemark.llm.shingle_sets import linked, parity_map, shingle_sets, signature

_U = np.uint64
#: Counters of the frequency sketch, and slices that it is summed in: its size doesn't depend on the input.
COUNTERS, SLICES = 1 << 22, 256
#: Matrix entries that one task sorts, and members of a token's group that one task compares with each other.
ENTRIES, BLOCK = 600_000, 1500
#: Matrix entries of opened groups that one task compares.
OPENED = 100_000
LEADERS = 3
#: Partners of a hub that one task compares it with.
PARTNERS = 64
#: Wanted texts, two for each pair, whose ids are broadcast at most; beyond that many, all texts are dealt by id.
WANTED = 1_000_000


def needed(n):
    """How many of the tokens in the matrix two similar sets share at least; n: the size of the smaller one."""
    return np.maximum(1, np.asarray(n) // 20)


def _read(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for part in slices(batch):
        ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
        yield from zip(ids, shingle_sets([t or "" for t in texts]), strict=True)


def _describe(docs: DataFrame) -> DataFrame:
    """A row for each document (its set's size, signature, parity map), and rows with slices of a count of all tokens."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "n", "sig_a", "sig_b", "parity", "slice"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        for batch in batches:
            rows = []
            for i, s in _read(batch):
                if len(s) and i is not None:
                    np.add.at(counts, (s & _U(COUNTERS - 1)).astype(np.int64), np.uint32(1))
                rows.append((i, len(s), *signature(s), parity_map(s), -1))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)
        if counts.any():
            pack = zstandard.ZstdCompressor(level=1).compress
            packed = [pack(p.tobytes()) for p in np.minimum(counts, 65535).astype("<u2").reshape(SLICES, -1)]
            none = [pa.nulls(SLICES, t) for t in types[:4]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(packed, pa.binary()), pa.array(range(SLICES), pa.int32())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig_a long, sig_b long, parity binary, slice int")


def _levels(described: DataFrame) -> np.ndarray:
    """How frequent the tokens of each counter are, in powers of two above a common token's; 0 for most. Always COUNTERS bytes."""
    total = described.where("slice < 0").agg(F.sum("n")).first()[0] or 0
    usual = max(8.0, 3.0 * total / COUNTERS)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(unpack(packed), "<u2").astype(np.uint64)
                sums[i] = sums[i] + part if i in sums else part
        level = [np.where(s > usual, 1 + np.log2(np.maximum(s, 1) / usual), 0).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], names=["slice", "level"])

    dealt = described.where("slice >= 0").select("slice", "parity").repartition("slice")
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for row in dealt.mapInArrow(add, "slice int, level binary").collect():
        out[row["slice"]] = np.frombuffer(row["level"], np.uint8)
    return out.reshape(-1)


def _entries(docs: DataFrame, levels, buckets: int) -> DataFrame:
    """The matrix' entries, dealt to buckets by token: of each set the first tokens, enough for ``needed`` shared ones.

    Frequent tokens are spread over as many buckets again, since no token of theirs can be alone. A task passes each set on once.
    """

    def run(batches):
        level = levels.value
        seen: set[int] = set()
        tokens, owners, sigs, sizes, waiting = [], [], [], [], 0

        def flush():
            t, o = np.concatenate(tokens), np.concatenate(owners)
            sig, size = np.array(sigs, np.int64), np.array(sizes, np.uint32)
            bucket = ((t >> _U(40)) % _U(buckets)).astype(np.int64)
            often = level[(t & _U(COUNTERS - 1)).astype(np.int64)] > 0
            group = np.where(often, buckets + (sig[o].view(_U) >> _U(7)).astype(np.int64) % buckets, bucket)
            order = np.argsort(group, kind="stable")
            edge = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1, [len(order)]])
            keys, packed = [], []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                at = order[a:b]
                own, inverse = np.unique(o[at], return_inverse=True)
                head = struct.pack("<II", len(own), len(at))
                parts = (head, sig[own].tobytes(), size[own].tobytes(), (t[at] & _U(0xFFFFFFFF)).astype("<u4").tobytes(), bucket[at].astype("<u4").tobytes() if group[at[0]] >= buckets else b"", inverse.astype("<u4" if len(own) > 65535 else "<u2").tobytes())
                keys.append(int(group[at[0]]))
                packed.append(b"".join(parts))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

        for batch in batches:
            for i, s in _read(batch):
                if not len(s) or i is None:
                    continue
                sig = signature(s)[0]
                if sig in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(sig)
                n = len(s)
                first = np.argsort(level[(s & _U(COUNTERS - 1)).astype(np.int64)], kind="stable")[: n - (3 * n + 3) // 4 + int(needed(n))]
                tokens.append(s[first])
                owners.append(np.full(len(first), len(sigs)))
                sigs.append(sig)
                sizes.append(n)
                waiting += len(first)
                if waiting >= 600_000:
                    yield flush()
                    tokens, owners, sigs, sizes, waiting = [], [], [], [], 0
        if waiting:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, packed binary")


def _shared_tokens(entries: DataFrame, buckets: int) -> DataFrame:
    """token, sig, n: the entries whose token at least two sets have."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("bucket")[0].as_py()
        token, sig, size = [], [], []
        for raw in table.column("packed"):
            data = raw.as_py()
            owners, n = struct.unpack_from("<II", data)
            at = 8
            own = np.frombuffer(data, "<i8", owners, at)
            own_size = np.frombuffer(data, "<u4", owners, at := at + 8 * owners)
            t = np.frombuffer(data, "<u4", n, at := at + 4 * owners).astype(np.int64)
            at += 4 * n
            if key >= buckets:
                t = t | (np.frombuffer(data, "<u4", n, at).astype(np.int64) << 32)
                at += 4 * n
            else:
                t = t | (key << 32)
            index = np.frombuffer(data, "<u4" if owners > 65535 else "<u2", n, at)
            token.append(t)
            sig.append(own[index])
            size.append(own_size[index].astype(np.int64))
        token, sig, size = np.concatenate(token), np.concatenate(sig), np.concatenate(size)
        order = np.lexsort((sig, token))
        token, sig, size = token[order], sig[order], size[order]
        new = np.concatenate([[True], (np.diff(token) != 0) | (np.diff(sig) != 0)])  # a set comes from several tasks
        token, sig, size = token[new], sig[new], size[new]
        if key < buckets:
            same = token[1:] == token[:-1]
            some = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            token, sig, size = token[some], sig[some], size[some]
        return pa.table({"token": token, "sig": sig, "n": size})

    return entries.groupBy("bucket").applyInArrow(run, "token long, sig long, n long")


def _rows_with_weights(shared: DataFrame) -> DataFrame:
    """token, sig, n, w: of the tokens that stand in just the same sets, told by a hash of those, one stays, for ``w`` of them."""
    rows = shared.groupBy("token").agg(F.bit_xor(F.xxhash64("sig")).alias("sets"), F.count(F.lit(1)).alias("m"))
    kept = rows.groupBy("sets", "m").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("w"))
    return shared.join(kept.select("token", "w"), "token")


def _differences(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many places each pair of parity maps differs."""
    if not len(a):
        return np.zeros(0, np.int64)
    x, y = (np.frombuffer(b"".join(v.to_pylist()), _U).reshape(len(v), -1) for v in (a, b))
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def _leader_pairs(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of a class and a leader: of the classes that share a token, those that come first in a few fixed orders lead."""
    masks = [0, -1, 0x5A5A5A5A5A5A5A5A, 0x3C96C3693C96C369][:LEADERS]
    leads = shared.groupBy("token").agg(*[F.min(F.col("sig").bitwiseXOR(F.lit(m))).alias(f"l{i}") for i, m in enumerate(masks)])
    leads = leads.select("token", F.array_distinct(F.array(*[F.col(f"l{i}").bitwiseXOR(F.lit(m)) for i, m in enumerate(masks)])).alias("leaders"))
    found = shared.join(leads, "token").select("sig", "w", F.explode("leaders").alias("leader")).where("sig <> leader")
    found = found.groupBy("sig", "leader").agg(F.sum("w").alias("k"))
    best = found.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "leader")), asc=False), 1, LEADERS).alias("best"))
    pairs = best.select("sig", F.explode("best.leader").alias("leader")).select(F.least("sig", "leader").alias("sig1"), F.greatest("sig", "leader").alias("sig2")).distinct()
    one = classes.select(F.col("sig_a").alias("sig1"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig_b").alias("ca"), F.col("parity").alias("pa"))
    two = classes.select(F.col("sig_a").alias("sig2"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig_b").alias("cb"), F.col("parity").alias("pb"))
    both = pairs.join(one, "sig1").where("na > 0").join(two, "sig2").where("4 * least(na, nb) >= 3 * greatest(na, nb)")

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            ok = 7 * _differences(batch.column(6), batch.column(7)) <= np.asarray(batch.column(4)) + np.asarray(batch.column(5))
            yield from t.select(["a", "b", "ca", "cb"]).filter(pa.array(ok)).to_batches()

    return both.select("a", "b", "ca", "cb", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long, ca long, cb long").distinct()


def _pairs_of_runs(edge: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs in runs of rows, a bounded number at a time; of a run with two parts only pairs across."""
    sizes = np.diff(edge)
    for m in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
        i, j = np.triu_indices(m, 1)
        starts = edge[:-1][sizes == m]
        step = max(1, 300_000 // len(i))
        for at in range(0, len(starts), step):
            own = starts[at : at + step, None]
            x, y = (own + i).ravel(), (own + j).ravel()
            split = np.repeat(part[own[:, 0]] != part[own[:, 0] + m - 1], len(i))
            keep = ~split | (part[x] != part[y])
            yield x[keep], y[keep]
    for start, end in zip(edge[:-1][sizes > 64], edge[1:][sizes > 64], strict=True):
        split = int(np.searchsorted(part[start:end], part[start], side="right")) + start
        for x in range(start, split if split < end else end - 1):
            y = np.arange(split if split < end else x + 1, end)
            yield np.full(len(y), x), y


def _group_pairs(shared: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of classes of different groups that the bounds let through, each pair once: at the first token that both have."""
    member = classes.join(groups, classes["rep"] == groups["id"], "left").select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("check"), "rep", "parity", F.coalesce("component", "rep").alias("grp"))
    matrix = cut(shared.join(member.select("sig", "check", "rep", "grp"), "sig"))
    rows = matrix.groupBy("token").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2"), F.count(F.lit(1)).alias("m")).where("g1 <> g2")
    part = F.ceil(F.col("m") / BLOCK).cast("int")
    open_ = cut(matrix.join(rows.select("token", "m"), "token"))
    buckets = max(24, -(-open_.count() // OPENED))
    tokens = open_.groupBy("rep", "check").agg(F.sort_array(F.collect_list(F.struct("token", "w"))).alias("t")).select("rep", "check", F.col("t.token").alias("tokens"), F.col("t.w").alias("weights"))
    lists = tokens.join(member.select("rep", "check", "parity"), ["rep", "check"])
    open_ = open_.withColumn("parts", part).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # Of a token with many sets, each pair of parts is one unit of work.
    units = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("part", j) * F.col("parts") + F.greatest("part", j)))
    open_ = open_.select("token", F.explode(units).alias("unit"), "part", "rep", "n", "grp", "check")
    open_ = open_.withColumn("bucket", F.pmod(F.xxhash64("token", "unit"), F.lit(buckets)).cast("int"))
    # A bucket gets each set's tokens and parity map once, however many of its tokens meet there.
    lists = open_.select("bucket", "rep", "check").distinct().join(lists, ["rep", "check"])
    both = open_.unionByName(lists, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        listed = pc.is_valid(table.column("parity"))
        own, table = table.filter(listed), table.filter(pc.invert(listed))
        names = list(zip(own.column("rep").to_pylist(), own.column("check").to_pylist(), strict=True))
        index = {k: i for i, k in enumerate(names)}
        maps = np.frombuffer(b"".join(own.column("parity").to_pylist()), _U).reshape(len(names), -1)
        lists, weights = own.column("tokens").combine_chunks(), own.column("weights").combine_chunks()
        start = lists.offsets.to_numpy()
        listed_tokens, listed_weights = lists.values.to_numpy(), weights.values.to_numpy()

        def tokens_of(i: int) -> np.ndarray:
            return listed_tokens[start[i] : start[i + 1]]

        def overlap(i: int, other: np.ndarray) -> int:
            return int(listed_weights[start[i] : start[i + 1]][np.isin(tokens_of(i), other, assume_unique=True)].sum())

        table = table.take(pa.array(np.lexsort([np.asarray(table.column(c).combine_chunks()) for c in ("part", "unit", "token")])))
        token, unit, part, n, grp = (np.asarray(table.column(c).combine_chunks()) for c in ("token", "unit", "part", "n", "grp"))
        place = np.array([index[k] for k in zip(table.column("rep").to_pylist(), table.column("check").to_pylist(), strict=True)], np.int64)
        size = np.zeros(len(names), np.int64)
        size[place] = n
        edge = np.concatenate([[0], np.flatnonzero((np.diff(token) != 0) | (np.diff(unit) != 0)) + 1, [len(token)]])
        met, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in _pairs_of_runs(edge, part):
            keep = np.flatnonzero((grp[x] != grp[y]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])))
            x, y = x[keep], y[keep]
            keep = np.flatnonzero(7 * np.bitwise_count(maps[place[x]] ^ maps[place[y]]).sum(1, dtype=np.int64) <= n[x] + n[y])
            x, y = x[keep], y[keep]
            i, j = np.minimum(place[x], place[y]), np.maximum(place[x], place[y])
            met.append(i * len(names) + j)
            at.append(token[x])
        met, at = np.concatenate(met), np.concatenate(at)
        order = np.lexsort((at, met))
        met, at = met[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(met) != 0])) if len(met) else np.zeros(0, np.int64)
        i, j, at = met[first] // len(names), met[first] % len(names), at[first]
        group = np.zeros(len(names), np.int64)
        group[place] = grp
        order = np.lexsort((j, group[j], i))
        i, j, at = i[order], j[order], at[order]
        edge = np.concatenate([[0], np.flatnonzero((np.diff(i) != 0) | (np.diff(group[j]) != 0)) + 1, [len(i)]]) if len(i) else np.zeros(1, np.int64)
        out = []
        for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            q, members = int(i[begin]), j[begin:end].tolist()
            least = int(needed(min(size[q], size[members].min())))
            # What the query shares with the union of these members bounds what it shares with each: if too little, none is opened.
            if len(members) > 1 and overlap(q, np.unique(np.concatenate([tokens_of(m) for m in members]))) < least:
                continue
            for m, t in zip(members, at[begin:end].tolist(), strict=True):
                shared_here = np.intersect1d(tokens_of(q), tokens_of(m), assume_unique=True)
                if t == shared_here[0] and overlap(q, shared_here) >= needed(min(size[q], size[m])):
                    out.append((*names[q], *names[m]) if names[q] <= names[m] else (*names[m], *names[q]))
        a, ca, b, cb = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table({k: pa.array(list(v), pa.int64()) for k, v in (("a", a), ("b", b), ("ca", ca), ("cb", cb))})

    return both.groupBy("bucket").applyInArrow(run, "a long, b long, ca long, cb long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose texts' sets are similar enough, set by set. ``pairs`` is a written table.

    Of a pair, the end with more partners is its hub. A hub's partners are dealt in blocks, and its text goes to each block once, so that
    texts move once a pair, and no hub's pairs are one task. If the texts asked for are few enough their ids are broadcast, so that other texts stay
    where they are; else texts are dealt by id.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("ca").alias("check")), F.struct(F.col("b").alias("id"), F.col("cb").alias("check")))).alias("e")).select("e.*")
    degree = cut(ends.groupBy("id", "check").agg(F.count(F.lit(1)).alias("k")))
    sides = pairs.join(degree.toDF("a", "ca", "ka"), ["a", "ca"]).join(degree.toDF("b", "cb", "kb"), ["b", "cb"])
    first = F.col("ka") >= F.col("kb")
    hub = F.when(first, F.struct("a", "ca", "ka")).otherwise(F.struct(F.col("b").alias("a"), F.col("cb").alias("ca"), F.col("kb").alias("ka")))
    other = F.when(first, F.struct(F.col("b").alias("id"), F.col("cb").alias("check"))).otherwise(F.struct(F.col("a").alias("id"), F.col("ca").alias("check")))
    sides = sides.select(hub.alias("h"), other.alias("o")).withColumn("part", F.pmod(F.xxhash64("o.id", "o.check"), F.ceil(F.col("h.ka") / PARTNERS)))
    asked = cut(sides.select("o.id", "o.check", F.col("h.a").alias("hub"), F.col("h.ca").alias("hub_check"), "part", F.lit(1).alias("side")))
    asked = asked.unionByName(asked.select(F.col("hub").alias("id"), F.col("hub_check").alias("check"), "hub", "hub_check", "part", F.lit(0).alias("side")).distinct())
    if pairs.count() <= WANTED // 2:
        asked = F.broadcast(asked)
    found = docs.join(asked, docs["doc_id"] == asked["id"]).select("hub", "hub_check", "part", "side", "id", "check", "text")
    dealt = found.repartition("hub", "hub_check", "part").sortWithinPartitions("hub", "hub_check", "part", "side", "id", "check")

    def run(batches):
        key, base, last = None, None, None
        for whole in batches:
            out = []
            for batch in slices(whole, 128):
                columns = [batch.column(i).to_pylist() for i in range(6)]
                for *block, side, i, check, s in zip(*columns, shingle_sets([t or "" for t in batch.column(6).to_pylist()]), strict=True):
                    if block != key:
                        key, base, last = block, None, None
                    if (base is not None if side == 0 else (base is None or (i, check) == last)) or signature(s)[1] != check:
                        continue  # another text of the id, or a repeated row
                    if side == 0:
                        base = s
                    else:
                        last = (i, check)
                        if linked(base, s):
                            out.append((min(i, key[0]), max(i, key[0])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: each document's set size, and the smallest id that links lead to.

    Two documents link if 100 * intersection >= 75 * union of their sets. Null and empty texts, and texts without words, have an empty set and
    link with nothing, as do rows without an id. Rows of equal id and text count as one document; if an id has several texts, each is compared, and a link of
    one is a link of the id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut(_describe(docs))
    levels = spark.sparkContext.broadcast(_levels(described))
    sets = described.where("slice < 0")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(12, shuffle_partitions(spark) // 4, -(-int(0.31 * total) // ENTRIES))
    shared = cut(_shared_tokens(_entries(docs, levels, buckets), buckets))
    release(spark)
    shared = cut(_rows_with_weights(shared))
    release(spark)
    classes = cut(sets.where("n > 0 and doc_id is not null").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.count(F.lit(1)).alias("rows")))
    links = cut(_verified(cut(_leader_pairs(shared, classes)), docs))
    release(spark)
    groups = cut(components(links))
    more = cut(_group_pairs(shared, classes, groups))
    release(spark)
    # A class of one row and no link needs no look-up: its component is that row's id.
    known = classes.select("sig_a", "sig_b", "rep", "rows").join(groups, F.col("rep") == F.col("id"), "left")
    known = known.select("sig_a", "sig_b", F.coalesce("component", "rep").alias("component"), ((F.col("rows") > 1) | F.col("component").isNotNull()).alias("some"))
    if not more.isEmpty():  # links of different groups join those: the rest is a graph of groups
        ends = _verified(more, docs)
        for end in ("a", "b"):
            ends = ends.join(groups.select(F.col("id").alias(end), F.col("component").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        joined = components(ends).select(F.col("id").alias("component"), F.col("component").alias("smallest"))
        known = known.join(joined, "component", "left").select("sig_a", "sig_b", F.coalesce("smallest", "component").alias("component"), (F.col("some") | F.col("smallest").isNotNull()).alias("some"))
    known = cut(known.where("some").select("sig_a", "sig_b", "component"))
    release(spark)
    out = sets.join(known, ["sig_a", "sig_b"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
