"""Bottom-k sketches of word shingles, made and compared with DataFrame functions only.

A sketch holds the k smallest hashes of a document's distinct shingles. Sketches of parts merge into the sketch of the whole; two sketches
estimate resemblance and containment, one sketch the number of distinct shingles. Below k shingles all of these are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions

SHINGLE, K = 5, 128
#: Bits of a hash; its text has a quarter as many hexadecimal digits.
BITS = 48
#: Buckets of neighbouring ids for each shuffle partition.
RANGES = 4
#: Quantiles of the ids that bound groups of ranges.
QUANTILES = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """Distinct hashes of ``size`` words in a row; with fewer words of the whole sequence; none without words."""
    def of(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - size)
        some = F.transform(starts, lambda i: F.shiftrightunsigned(F.xxhash64(*[h[i + j] for j in range(size)]), 64 - BITS))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(F.size(h) >= size, F.array_distinct(some)).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(shingle_hashes(text, size)), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group of rows, merged from theirs: hashes are counted once a group, and the k smallest kept by rank."""
    each = df.select(*by, F.explode_outer(column).alias("_h")).distinct()
    low = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_r") <= k)
    return low.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets: the share of the union's k smallest hashes that both hold. Two empty ones: 1."""
    joint = let(merged(a, b, k), lambda u: F.when(F.size(u) > 0, F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)).otherwise(F.lit(1.0)))
    return joint.cast("double")


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**BITS)) / F.element_at(a, k))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; 1 for an empty a."""
    size = let(merged(a, b, k), lambda u: distinct_shingles(u, k))
    return F.when(F.size(a) > 0, F.least(F.lit(1.0), resemblance(a, b, k) * size / distinct_shingles(a, k))).otherwise(F.lit(1.0))


def fingerprint(a: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def parse_fingerprint(text: Column) -> Column:
    """The sketch of a fingerprint."""
    n = BITS // 4
    places = F.sequence(F.lit(0), (F.length(text) / n).cast("int") - 1)
    return F.when(F.length(text) > 0, F.transform(places, lambda i: F.conv(F.substring(text, i * n + 1, F.lit(n)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<column>, taken from the row that follows in the order of doc_id (null ids last, ties by text); the first follows the last.

    Rows are dealt by ranges of ids whose bounds come from quantiles over all ids. The first row of each range is also dealt, as a copy, to
    the range before; the ranges' first ids, a few for each shuffle partition, are all that is shared.
    """
    spark = docs.sparkSession
    n = RANGES * shuffle_partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    m = min(n, QUANTILES)
    edges = ids.agg(F.percentile_approx("doc_id", F.lit([i / m for i in range(m + 1)]), F.lit(20 * m))).first()[0] or [0]  # m + 1 numbers
    edges = sorted(set(edges))
    edges = edges if len(edges) > 1 else edges * 2
    parts = -(-n // (len(edges) - 1))  # of equal width between two quantiles

    def tree(low: int, high: int) -> Column:
        if low == high:
            width = max(edges[low + 1] - edges[low], 1)
            part = F.floor((F.col("doc_id") - edges[low]).cast("double") / width * parts)
            return F.lit(low * parts) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))
        middle = (low + high) // 2
        return F.when(F.col("doc_id") <= edges[middle + 1], tree(low, middle)).otherwise(tree(middle + 1, high))

    bucket = F.when(F.col("doc_id").isNull(), F.lit(parts * len(edges))).otherwise(tree(0, len(edges) - 2)).cast("int")
    firsts = sorted((r["_bucket"], r["id"]) for r in ids.select(bucket.alias("_bucket"), "doc_id").groupBy("_bucket").agg(F.min("doc_id").alias("id")).collect())  # one row a range
    pairs = [(i, firsts[at - 1][0], at == 0) for at, (_, i) in enumerate(firsts)] or [(None, 0, True)]
    copies = spark.createDataFrame(pairs, "_first bigint, _before int, _wraps boolean")
    own = F.struct(bucket.alias("_bucket"), F.lit(0).alias("_copy"))
    also = F.struct(F.col("_before").alias("_bucket"), F.lit(1).alias("_copy"))
    dealt = docs.join(F.broadcast(copies), docs["doc_id"].eqNullSafe(F.col("_first")), "left")
    dealt = dealt.select(*docs.columns, F.explode(F.when(F.col("_before").isNotNull(), F.array(own, also)).otherwise(F.array(own))).alias("_to"))
    dealt = dealt.select(*docs.columns, "_to._bucket", "_to._copy")
    order = Window.partitionBy("_bucket").orderBy("_copy", F.col("doc_id").asc_nulls_last(), "text")
    return dealt.select(*docs.columns, "_copy", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_copy = 0").drop("_copy")


def fingerprint_documents(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text: the last quarter of the code points, rounded down, replaced by as many from the start of the next document's text, or
    all if it is shorter. Null texts are empty. Rows of an equal id follow each other by text; null ids come last. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimate), contained_in_next.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.select("doc_id", "text", sketch(F.col("text"), k).alias("sketch"))
    near = with_next(base, ["text", "sketch"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    made = near.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("text"))
    made = made.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2("text", 256).alias("edited_sha256"), F.explode(F.array(sketch(F.col("text"), k))).alias("edited"))
    a, b, c = F.col("sketch"), F.col("edited"), F.col("next_sketch")
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(a).alias("fingerprint"), fingerprint(b).alias("edited_fingerprint"), resemblance(a, b, k).alias("near_edited"),
        resemblance(a, c, k).alias("near_next"), distinct_shingles(a, k).alias("n_shingles"), containment(a, c, k).alias("contained_in_next"),
    )
