"""Document fingerprints by one-permutation MinHash.

All shingles of five words are hashed once; the top bits of a hash choose its bin and the least hash of each bin counts.
An empty bin borrows from the first non-empty bin in a probing order of its own (optimal densification), the same order
for every text. The low byte of each bin is stored, and the share of equal bytes is corrected for those that agree by chance.

Only DataFrame functions are used; a text's arrays live within its row. The bins are found by one sort of the hashes
together with one sentinel for each bin, which is the largest value that the bin can hold and so tells an empty bin.

Cases: a null text is empty; a text with fewer than five words has one shingle, its whole sequence; one without words has
an empty fingerprint, which is wholly like another empty one and not at all like any other; repeated rows and ties of id
are ordered by a hash of the text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, let, staged

BINS, WORDS, PROBES = 256, 5, 8
LOW = (1 << 56) - 1


def _rule(seed: int) -> list[int]:
    """256 numbers below 2**31 from a fixed multiplicative rule."""
    x, out = seed, []
    for _ in range(BINS):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 33)
    return out


#: Bin i probes the bins offset[i] + a * step[i] modulo BINS for a = 0, 1, ...; odd steps reach all of them. The inverse tells a from a bin.
OFFSET = [x % BINS for x in _rule(11)]
STEP = [x % BINS | 1 for x in _rule(23)]
INVERSE = [pow(s, -1, BINS) for s in STEP]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles of a text without nulls, in order, repeats kept; an empty array if it has no word."""
    tokens = F.filter(F.split(text, SPACE), lambda w: w != "")
    none = F.array().cast("array<bigint>")
    whole = lambda w: F.when(F.size(w) == 0, none).otherwise(F.array(F.xxhash64(w)))
    return let(tokens, lambda w: F.when(F.size(w) < words, whole(w)).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (words - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(words))))))


def fingerprint(text: Column) -> Column:
    """The stored bytes of a text (array<tinyint>, of BINS elements or none)."""
    sentinels = F.array(*[F.lit(((b - BINS // 2) << 56) | LOW) for b in range(BINS)])
    ints = lambda values: F.array(*[F.lit(v) for v in values])
    offset, step, inverse = ints(OFFSET), ints(STEP), ints(INVERSE)
    empty = lambda x: x.bitwiseAND(F.lit(LOW)) == F.lit(LOW)
    bin_of = lambda x: (F.shiftright(x, 56) + F.lit(BINS // 2)).cast("int")
    byte = lambda x: x.bitwiseAND(F.lit(255)).cast("int")

    def probe(found: Column, out: Column) -> Column:
        return let(found, lambda y: F.when(~empty(y), byte(y)).otherwise(out))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], 56)))

    def dense(bins: Column) -> Column:
        def borrow(full: Column, i: Column) -> Column:
            far = F.array_min(F.transform(full, lambda y: F.shiftleft(((bin_of(y) - offset[i]) * inverse[i]).bitwiseAND(F.lit(BINS - 1)), 8) + byte(y))).bitwiseAND(F.lit(255))
            out = far
            for a in range(PROBES - 1, -1, -1):
                out = probe(bins[(offset[i] + a * step[i]).bitwiseAND(F.lit(BINS - 1))], out)
            return out

        full = F.filter(bins, lambda x: ~empty(x))
        return let(full, lambda f: F.when(F.size(f) == BINS, F.transform(bins, lambda x: byte(x))).otherwise(F.transform(bins, lambda x, i: F.when(~empty(x), byte(x)).otherwise(borrow(f, i)))))

    hashes = shingle_hashes(text)
    none = F.array().cast("array<tinyint>")
    signed = lambda a: F.transform(a, lambda x: (x - 128).cast("tinyint"))
    packed = lambda h: signed(let(firsts_of(h), dense))
    firsts_of = lambda h: let(F.sort_array(F.concat(h, sentinels)), firsts)
    return let(hashes, lambda h: F.when(F.size(h) == 0, none).otherwise(packed(h)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for bytes that agree by chance."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    chance = 1 / 256
    estimate = (equal / F.lit(BINS) - chance) / (1 - chance)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate))).when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0))


def spell(bytes_: Column) -> Column:
    """A fingerprint as lower-case hex digits."""
    return F.lower(F.array_join(F.transform(bytes_, lambda x: F.lpad(F.hex(x.cast("int") + 128), 2, "0")), ""))


def range_bucket(df: DataFrame, id_col: str, tie: str, rows_a_bucket: int = 200, most: int = 1 << 16) -> Column:
    """A bucket number that falls as the id rises, of about equal rows whatever the spread of ids; rows without an id come last, dealt by tie.

    Approximate quantiles of the ids cut the range into up to 256 parts, each of which is divided evenly.
    """
    n, cuts = df.agg(F.count(F.lit(1)), F.percentile_approx(F.col(id_col).cast("long"), [i / 256 for i in range(257)], 10_000)).first()
    buckets = max(1, min(most, n // rows_a_bucket))
    cuts = sorted(set(cuts or [0]))
    parts = max(1, len(cuts) - 1)
    fine = max(1, -(-buckets // parts))
    id_ = F.col(id_col).cast("long")
    edges = F.array(*[F.lit(c) for c in cuts])
    part = F.greatest(F.lit(1), F.least(F.lit(parts), F.size(F.filter(edges, lambda c: c <= id_))))
    low, high = edges[part - 1], F.coalesce(F.get(edges, part), F.element_at(edges, -1))
    within = F.least(F.lit(fine - 1), F.floor((id_.cast("double") - low.cast("double")) / F.greatest(high.cast("double") - low.cast("double"), F.lit(1.0)) * fine))
    return F.when(id_.isNull(), F.lit(1 << 20) + F.conv(F.substring(tie, 1, 2), 16, 10).cast("long")).otherwise(-(part.cast("long") * fine + F.greatest(F.lit(0), within).cast("long")))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and their likeness to it and to the next document's (descending id, an integer).

    Texts are shuffled once, by ranges of the id, and meet the next text in their range. The last row of a range needs the first of the next
    range: a table with one row for each range says which, and the few texts it names are read once more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("k1"), F.md5(text.cast("binary")).alias("k2"), text.alias("t"))
    bucket = range_bucket(df.select(F.col(id_col).alias("k1")), "k1", "k2")
    place = F.struct(F.col("k1").isNull().alias("none"), F.bitwise_not(F.col("k1").cast("long")).alias("down"), F.col("k2").alias("k2"))
    base = base.withColumn("bucket", bucket).withColumn("place", place)
    order = [F.col("place"), F.col("k1")]
    docs = base.repartition("bucket").withColumn("f", fingerprint(F.col("t")))
    ahead = Window.partitionBy("bucket").orderBy(*order)
    inner = docs.select("k1", "t", "f", F.lead(F.struct("t", "f")).over(ahead).alias("next")).where("next is not null")
    ranges = base.groupBy("bucket").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    by_range = Window.orderBy("bucket")
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = staged(ranges.select(F.col("last").alias("here"), F.coalesce(F.lead("first").over(by_range), F.first("first").over(whole)).alias("there")), "ranges")
    wanted = ends.select(F.col("here").alias("w")).union(ends.select("there")).distinct()
    found = staged(base.select("place", "k1", "t").join(wanted, F.col("place") == F.col("w")).select("place", "k1", "t", fingerprint(F.col("t")).alias("f")).dropDuplicates(["place"]), "ends")
    other = found.select(F.col("place").alias("p"), F.struct("t", "f").alias("next"))
    outer = ends.join(found, F.col("here") == F.col("place")).join(other, F.col("there") == F.col("p")).select("k1", "t", "f", "next")
    rows = inner.unionByName(outer)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("t", F.lit(1), n - half), F.substring("next.t", F.lit(1), half)))
    rows = rows.withColumn("ef", fingerprint(F.col("edited")))
    return rows.select(
        F.col("k1").alias("id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spell(F.col("f")).alias("fingerprint"),
        spell(F.col("ef")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("ef")).alias("near_edited"),
        likeness(F.col("f"), F.col("next.f")).alias("near_next"),
    )
