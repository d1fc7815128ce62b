"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's weighted terms are its words, each with the word before it, weighted by how often they occur. For each of ``COORDINATES``
coordinates, every term draws four uniform numbers by hashing. Minus the logarithms of u1 and u2 are r * b and r * (1 - b), which makes r
Gamma(2, 1) and b uniform, and c = -ln(u3 * u4) is Gamma(2, 1). With t = floor(ln w / r + b), the term of least c * exp(-r * (t - b + 1))
is sampled, and the coordinate is a hash of that term and its t. So two texts agree in a coordinate with the probability of their generalised
Jaccard similarity: the sum of least over the sum of largest weights.

That score is exponentially distributed with rate w, so a text's least lies near 1 / (sum of its weights). A bound without logarithms
shows of most terms that their scores reach ``ENOUGH`` times that; only the others are scored. A sample below it is the least of all terms.
Texts with a coordinate that has none below it are sampled again with all terms scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: Coordinates of a fingerprint, and how many are put together in a row; UTF-8 bytes of text in a partition and keys in a range, on average.
COORDINATES, TOGETHER, PARTITION_BYTES, RANGE_ROWS = 64, 8, 4 << 20, 1_000_000
#: Terms that surely score ENOUGH / (sum of weights) or more wait; that a coordinate has no others has a chance of exp(-ENOUGH).
ENOUGH = 28.0
_GAPS, _SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
#: A document's key: whether it has a doc_id, its doc_id, and a hash of its text.
KEY = ["has", "kd", "kh"]


def with_terms(df: DataFrame, text: str, out: str, mark: int) -> DataFrame:
    """Add the array ``out``: a 63-bit hash of each word with the one before it and of the last with the end, then the bit ``mark``."""
    df = df.withColumn("_words", F.split(F.btrim(F.col(text), F.lit(_SPACES)), _GAPS))
    pair = lambda w, b: F.shiftleft(F.xxhash64(b, w), 1).bitwiseOR(F.lit(mark))
    return df.withColumn(out, F.zip_with("_words", F.concat(F.array(F.lit("")), "_words"), pair)).drop("_words")


def _bits(h: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1))


def _unit(h: Column) -> Column:
    """A uniform number between 0 and 1 from the upper half of ``h``."""
    return (_bits(h, 32, 32) + F.lit(0.5)) * F.lit(2.0**-32)


def drawn(weighted: DataFrame, weights: list[str], totals: list[str] | None = None) -> DataFrame:
    """``weighted`` with a row for each coordinate ``k``, and the hashes ``h`` and ``g`` that hold the drawn numbers.

    ``h`` holds u2 and the upper halves of 1 - u3 and 1 - u4, ``g`` u1 and the lower halves. As c is at least (1 - u3) + (1 - u4), a score is at
    least u2 * ((1 - u3) + (1 - u4)) at weight 1, and at least u1 / w times that at others. With ``totals``, rows are left out whose bounds reach
    ENOUGH / total for all of ``weights``.
    """
    each = F.explode(F.sequence(F.lit(0), F.lit(COORDINATES - 1))).alias("k")
    h, g = F.xxhash64("term", "k"), F.xxhash64("h")
    if totals is None:
        return weighted.select("*", each).withColumn("h", h).withColumn("g", g)

    def limit(which) -> Column:
        # a little wider than the limit of a score, as both are rounded
        most = [F.when(which(F.col(w)), F.col(w) * F.lit(1.001 * ENOUGH * 2.0**16) / F.col(n)) for w, n in zip(weights, totals, strict=True)]
        return F.coalesce(F.greatest(*most, F.lit(0.0)), F.lit(0.0))

    rows = weighted.select("*", limit(lambda w: w == 1).alias("once"), limit(lambda w: w > 1).alias("often"))
    rows = rows.select("*", each).withColumn("h", h)
    bound = _unit(F.col("h")) * (_bits(F.col("h"), 16, 16) + _bits(F.col("h"), 0, 16))
    rows = rows.where((bound < F.col("once")) | ((F.col("often") > 0) & (_unit(g) * bound < F.col("often"))))
    return rows.drop("once", "often").withColumn("g", g)


def samples(weighted: DataFrame, keys: list[str], weights: list[str], totals: list[str] | None = None) -> DataFrame:
    """(keys..., one fingerprint for each of ``weights``) from (keys..., term, weights...): four hex digits for each coordinate.

    A term draws once for a coordinate, whatever its weights. A null weight takes no part. A coordinate's sample is the smallest of one
    long: the score's fourth root in its upper half, a mark of the term and its t in the lower. A fingerprint is null if nothing took part.

    ``totals`` names, for each of ``weights``, a column with its sum over the keys' rows. Then only terms that may score below the limit are
    scored, and a fingerprint is also null if one of its coordinates has no sample below it; without totals there is no limit.
    """
    h, g = F.col("h"), F.col("g")
    less = lambda at, low: (_bits(h, at, 16) * F.lit(65536.0) + _bits(g, low, 16) + F.lit(0.5)) * F.lit(2.0**-32)

    def root(score: Column) -> Column:
        return (F.sqrt(F.sqrt(score)) * F.lit(2.0**29)).cast("long")  # a score is below 50

    def packed(score: Column, t: Column) -> Column:
        return F.shiftleft(root(score), 32).bitwiseOR((_bits(g, 0, 16) + t).bitwiseAND(F.lit(0xFFFF)))  # bits that hardly move the score

    def often(w: str) -> Column:
        rb, r = -F.log(_unit(g)), -F.log(_unit(g)) - F.log(_unit(h))
        t = F.floor((F.log(F.col(w).cast("double")) + rb) / r)
        return packed(F.col("c") * F.exp(rb - r * (t + F.lit(1.0))), t)

    group = [*keys, *(totals or []), "k"]
    rows = drawn(weighted.select(*keys, *(totals or []), "term", *weights), weights, totals)
    rows = rows.select(*group, *weights, "h", "g", (-F.log((F.lit(1.0) - less(16, 16)) * (F.lit(1.0) - less(0, 0)))).alias("c"))
    rows = rows.select("*", packed(F.col("c") * _unit(h), F.lit(0)).alias("once"))  # at weight 1, t is 0 and the score c * u2
    least = rows.groupBy(*group).agg(*(F.min(F.when(F.col(w) == 1, F.col("once")).when(F.col(w) > 1, often(w))).alias(w) for w in weights))
    for w, n in zip(weights, totals or [], strict=False):
        least = least.withColumn(w, F.when(F.col(w) < F.shiftleft(root(F.lit(ENOUGH) / F.col(n)), 32), F.col(w)))

    digits = lambda w: F.lpad(F.hex(F.col(w).bitwiseAND(F.lit(0xFFFF))), 4, "0")
    least = least.select(*keys, F.expr(f"k div {TOGETHER}").alias("part"), (F.col("k") % TOGETHER).alias("k"), *(digits(w).alias(w) for w in weights))
    joined = lambda at, n, w: F.concat(*(F.max(F.when(F.col(at) == k, F.col(w))) for k in range(n))).alias(w)
    least = least.groupBy(*keys, "part").agg(*(joined("k", TOGETHER, w) for w in weights))
    return least.groupBy(*keys).agg(*(joined("part", COORDINATES // TOGETHER, w) for w in weights))


def likeness(a: str, b: str) -> Column:
    """The share of equal coordinates."""
    same = " + ".join(f"int(substring({a}, {4 * k + 1}, 4) = substring({b}, {4 * k + 1}, 4))" for k in range(COORDINATES))
    return F.expr(f"({same}) / {COORDINATES}D")


def followers(keys: DataFrame, rows: int) -> DataFrame:
    """``keys`` (KEY, further columns) with the struct ``next`` of the KEY after it in order; after the last, the first.

    Keys are followed within ranges of them; of other ranges, only the first key matters, and one task orders those.
    """
    ranged = keys.repartitionByRange(max(1, rows // RANGE_ROWS), *KEY).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "fingerprint-keys")
    firsts = ranged.groupBy("range").agg(F.min(F.struct(*KEY)).alias("first"))
    after = F.coalesce(F.lead("first").over(Window.orderBy("range")), F.first("first").over(Window.orderBy("range")))
    inner = ranged.withColumn("inner", F.lead(F.struct(*KEY)).over(Window.partitionBy("range").orderBy(*KEY)))
    joined = inner.join(firsts.select("range", after.alias("after")), "range")
    return joined.select(*keys.columns, F.coalesce("inner", "after").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row of ``docs``.

    ``docs`` needs doc_id and text; further columns are not read. A document's edited text has its last floor(n_chars / 2) code
    points replaced by the first as many of the next document in order of doc_id (after the last, the first). Null is the empty
    text, and all texts without words have one fingerprint. Rows without doc_id come first; rows that share a doc_id are documents
    in the order of their texts' hashes, and a row that repeats follows on itself. An empty table gives an empty result.

    Keys alone are ordered. Texts are shuffled once by key, and the beginning that a document lends to the one before it once more.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kd = F.col("doc_id").cast("long")
    rows = docs.select(kd.isNotNull().cast("int").alias("has"), F.coalesce(kd, F.lit(0)).alias("kd"), F.xxhash64(text).alias("kh"), text.alias("text"))
    keys = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).alias("n"), F.max(F.octet_length("text")).alias("size"))
    keys = materialize(keys, "fingerprint-sizes")
    total, count, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    links = materialize(followers(keys, count), "fingerprint-links")

    parts = max(-(-total // PARTITION_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    one, two = ["fingerprint", "edited_fingerprint"], ["n0", "n1"]

    def paired(rows: DataFrame, links: DataFrame) -> DataFrame:
        """(KEY, again, text, edited) of the texts in ``links``."""
        held = rows.repartition(parts, *KEY)
        held = held.dropDuplicates(KEY) if n > count else held
        # who borrows from whom: the first of equal rows from the next text, the others from their own
        lent = links.select("next.*", F.struct(*KEY).alias("to"), F.expr("int(n div 2)").alias("half"), F.lit(0).alias("again"))
        if n > count:
            lent = lent.unionByName(links.where("copies > 1").select(*KEY, F.struct(*KEY).alias("to"), F.expr("int(n div 2)").alias("half"), F.lit(1).alias("again")))
        lent = held.join(lent, KEY).select("to.*", "again", F.expr("substring(text, 1, half)").alias("lent")).repartition(parts, *KEY)
        return held.join(lent, KEY).select(*KEY, "again", "text", F.expr("concat(substring(text, 1, length(text) - length(text) div 2), lent)").alias("edited"))

    def counted(both: DataFrame) -> DataFrame:
        """(KEY, again, n0, n1, term, weights in both texts), n0 and n1 being the sums of weights."""
        marked = with_terms(with_terms(both, "text", "x", 0), "edited", "y", 1)
        marked = marked.select(*KEY, "again", F.size("x").alias("n0"), F.size("y").alias("n1"), F.explode(F.concat("x", "y")).alias("x"))
        marked = marked.select(*KEY, "again", *two, F.shiftrightunsigned("x", 1).alias("term"), F.col("x").bitwiseAND(F.lit(1)).alias("mark"))
        weighted = marked.groupBy(*KEY, "again", *two, "term").agg(F.sum("mark").alias("w1"), F.count(F.lit(1)).alias("w0"))
        return weighted.select(*KEY, "again", *two, "term", F.expr("nullif(w0 - w1, 0)").alias(one[0]), F.expr("nullif(w1, 0)").alias(one[1]))

    both = paired(rows, links)
    hashes = both.select(*KEY, "again", F.sha2("edited", 256).alias("edited_sha256"))
    found = materialize(samples(counted(both), [*KEY, "again"], one, two).join(hashes, [*KEY, "again"], "right"), "fingerprint-found")
    lacking = found.where(F.col(one[0]).isNull() | F.col(one[1]).isNull())
    if not lacking.isEmpty():
        few = materialize(links.join(lacking.select(*KEY).distinct(), KEY, "semi"), "fingerprint-few")
        # written, so that its size is known: texts are only shuffled for it if it is large
        ends = materialize(few.select(*KEY).union(few.select("next.*")).distinct(), "fingerprint-ends")
        whole = samples(counted(paired(rows.join(ends, KEY, "semi"), few)), [*KEY, "again"], one)
        whole = lacking.drop(*one).join(whole, [*KEY, "again"]).select(found.columns)
        found = found.where(F.col(one[0]).isNotNull() & F.col(one[1]).isNotNull()).union(materialize(whole, "fingerprint-whole"))

    following = links.select(*KEY, "copies", "n", "next").join(
        found.where("again = 0").select(*(F.col(c).alias(f"n_{c}") for c in KEY), F.col("fingerprint").alias("next_fingerprint")),
        [F.col(f"next.{c}") == F.col(f"n_{c}") for c in KEY],
    )
    out = found.join(following.select(*KEY, "copies", "n", "next_fingerprint"), KEY)
    times = F.when(F.col("again") == 1, F.col("copies") - 1).otherwise(F.lit(1)).cast("int")
    out = out.withColumn("_", F.explode(F.array_repeat(F.lit(0), times)))
    near = F.when(F.col("again") == 1, F.lit(1.0)).otherwise(likeness("fingerprint", "next_fingerprint"))
    return out.select(
        F.when(F.col("has") == 1, F.col("kd")).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        near.alias("near_next"),
    )


def op9_cws_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
