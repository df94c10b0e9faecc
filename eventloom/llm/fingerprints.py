"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is hashed to a wide vector, and a document is the sum of the vectors of its paragraphs, each word of the sum
modulo a power of two. The sum does not depend on their order, and a paragraph is inserted or deleted by adding or
subtracting its vector. The words are

* 16 lanes of 32 bits, uniform, for equality;
* 20 words of three 20-bit counters: counter k counts the paragraphs whose hash has bit k set. Twice a counter less the number
  of paragraphs is a sum of random signs, so the mean square of the differences of two documents' counters estimates how
  many paragraphs they do not share (a tug-of-war sketch), which gives the likeness;
* one word with the number of paragraphs.

Everything is DataFrame expressions. Counters are exact for up to about a million paragraphs in a document; beyond that they
wrap, which leaves equality as it is and makes the likeness rougher.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

LANES, COUNTERS, BITS = 16, 20, 20
LOW32, LOW60 = (1 << 32) - 1, (1 << 60) - 1
ONE_IN_EACH = 1 | 1 << BITS | 1 << 2 * BITS
WIDTH = LANES + COUNTERS + 1

#: A paragraph ends at a line break; long lines are cut after sentences, so that an edit leaves the rest of the line alone.
BREAKS = r"[\n\r]+|(?<=[.!?])[ \t]+"


def paragraphs(text: Column, breaks: str = BREAKS) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), breaks), lambda p: F.trim(p) != "")


def vectors_of(paragraphs: Column) -> Column:
    """The vectors of an array of paragraphs. Each step feeds the next, so that a paragraph is digested once."""
    digests = F.transform(paragraphs, lambda p: F.sha2(p.cast("binary"), 256))
    hashes = F.transform(digests, lambda d: F.array(*[F.xxhash64(F.lit(i), d) for i in range(LANES + 1)]))

    def widen(h: Column) -> Column:
        lanes = F.transform(F.slice(h, 1, LANES), lambda x: x.bitwiseAND(F.lit(LOW32)))
        bits = [F.shiftrightunsigned(h[LANES], i).bitwiseAND(F.lit(ONE_IN_EACH)) for i in range(COUNTERS)]
        return F.concat(lanes, F.array(*bits, F.lit(1).cast("long")))

    return F.transform(hashes, widen)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), WIDTH)


def _reduce(vector: Column) -> Column:
    return F.transform(vector, lambda x, i: F.when(i < LANES, x.bitwiseAND(F.lit(LOW32))).otherwise(x.bitwiseAND(F.lit(LOW60))))


def insert(vector: Column, other: Column) -> Column:
    """The sum: ``other`` is the vector of a document or a paragraph to be added."""
    return _reduce(F.zip_with(vector, other, lambda a, b: a + b))


def delete(vector: Column, other: Column) -> Column:
    """The difference: what ``insert`` added is taken away."""
    return _reduce(F.zip_with(vector, other, lambda a, b: a - b))


def fingerprint(text: Column, breaks: str = BREAKS) -> Column:
    """The vector of a text: zero for null, empty and blank texts, the same for any order of its paragraphs."""
    low = F.lit(LOW60)  # 2^32 divides 2^60, so lanes may be reduced once, at the end
    add = lambda total, v: F.zip_with(total, v, lambda a, b: (a + b).bitwiseAND(low))
    return F.aggregate(vectors_of(paragraphs(text, breaks)), zero(), add, _reduce)


def as_text(vector: Column) -> Column:
    return F.array_join(F.transform(vector, lambda x, i: F.lpad(F.hex(x), F.when(i < LANES, 8).otherwise(15), "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """About the paragraphs shared over the paragraphs in either, 0 to 1; exactly 1 for equal vectors."""
    n, m = F.element_at(a, WIDTH), F.element_at(b, WIDTH)

    def signs(pair: Column) -> Column:
        parts = []
        for k in range(3):
            part = lambda v, k=k: F.shiftright(v, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
            difference = 2.0 * (part(pair["a"]) - part(pair["b"])) - (n - m)
            parts.append(difference * difference)
        return parts[0] + parts[1] + parts[2]

    # the counters of both, side by side
    at = lambda v: F.slice(v, LANES + 1, COUNTERS)
    pairs = F.zip_with(at(a), at(b), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    apart = F.aggregate(F.transform(pairs, signs), F.lit(0.0), lambda s, x: s + x) / (3 * COUNTERS)
    both = (n + m).cast("double")
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (both - apart) / (both + apart)))
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(near)


def with_next(docs: DataFrame, values: list[str], doc_id: str = "doc_id", order: tuple[str, ...] = ("text",), bits: int = 10) -> DataFrame:
    """``docs`` with ``next``: a struct of ``values`` of the next row in descending ``doc_id``; after the last comes the first.

    Rows without an id come last, repeated ids in the order of ``order``. Ids are cut into runs of 2^bits; each run is scanned by
    itself, and only the first row of each run is passed on to the run before it.
    """
    no_id = F.lit(-(1 << 60))
    docs = docs.drop("next").withColumn("__run", F.coalesce(F.shiftright(doc_id, bits), no_id))
    keys = [F.col(doc_id).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in order]]
    w = Window.partitionBy("__run").orderBy(*keys)
    docs = docs.withColumns({"__next": F.lead(F.struct(*values)).over(w), "__place": F.row_number().over(w)})

    # one row for each run: the run whose first row follows it; the first rows come from the scan above, whose shuffle is reused
    runs = docs.groupBy("__run").agg(F.count(F.lit(1)).alias("__n"))
    chain = Window.orderBy(F.col("__run").desc())
    runs = runs.withColumns({"__after": F.lead("__run").over(chain), "__top": F.first("__run").over(chain)})
    after = runs.select("__run", F.coalesce("__after", "__top").alias("__after"))
    heads = docs.filter("__place = 1").select(F.col("__run").alias("__after"), F.struct(*values).alias("__head"))
    heads = after.join(heads, "__after").select("__run", "__head")
    joined = docs.join(heads, "__run").withColumn("next", F.coalesce("__next", "__head"))
    return joined.drop("__run", "__next", "__place", "__head")


def op10_fingerprints(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("vector", fingerprint(F.col("text")))
    both = with_next(docs, ["text", "vector"]).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.length("text") - half)
    both = both.withColumn("edited", F.concat(kept, F.substring(F.col("next.text"), F.lit(1), half)))
    both = both.withColumn("edited_vector", fingerprint(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("vector")).alias("fingerprint"),
        as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next.vector")).alias("near_next"),
    )


QUERIES = {"op10_fingerprints": (op10_fingerprints, None)}
