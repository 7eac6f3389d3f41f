"""Document fingerprints by consistent weighted sampling.

A text is its words weighted by how often they occur. For each of ``SAMPLES`` positions, every term draws r and c from
Gamma(2, 1) and beta from U(0, 1), all decided by the term's hash; with weight S it gets the key
a = c exp(r (beta - 1 - t)), t = floor(ln S / r + beta), and the text's sample is the term (and t) with the least key.
Two texts agree at a position with a probability that is their generalised Jaccard similarity, sum of min over sum of
max of the weights. Everything is DataFrame functions; keys are compared in place of (term, t), which decide them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Positions of a fingerprint, and hex digits of each.
SAMPLES = 48
DIGITS = 6


def words(text: Column) -> Column:
    """The terms of a text: what white space parts. An empty text has one empty term."""
    return F.split(F.trim(text), r"\s+")


def _uniform(bits: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1))
    return (part.cast("double") + 0.5) * F.lit(2.0**-width)


def sample_keys(term: Column, logs: list[Column], k: int) -> list[Column]:
    """Position ``k``'s key of a hashed term under each of several weights, given as logarithms; null for none.

    No key stands in a branch, so that the draws are made once for all weights. A gamma draw is the negative logarithm of the
    product of two uniforms.
    """
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(_uniform(one, 0, 32) * _uniform(one, 32, 32))
    c = -F.ln(_uniform(two, 0, 21) * _uniform(two, 21, 21))
    beta = _uniform(two, 42, 22)
    return [c * F.exp(r * (beta - 1 - F.floor(log / r + beta))) for log in logs]


def fingerprint(samples: list[Column]) -> Column:
    """Fixed-width hex of the samples."""
    kept = [F.hash(s).bitwiseAND(F.lit((1 << 4 * DIGITS) - 1)) for s in samples]
    return F.concat(*(F.lpad(F.hex(x.cast("long")), DIGITS, "0") for x in kept))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of positions at which two fingerprints agree."""
    same = [(F.substring(a, i * DIGITS + 1, DIGITS) == F.substring(b, i * DIGITS + 1, DIGITS)).cast("int") for i in range(samples)]
    return reduce(lambda x, y: x + y, same) / F.lit(float(samples))


def fingerprint_texts(texts: DataFrame, keys: list[str], columns: list[str], samples: int = SAMPLES) -> DataFrame:
    """One row for each key with ``fp_<column>`` for each text column. Null: empty. ``keys`` must be unique.

    Terms are counted and sampled where the rows lie if these are already dealt by ``keys``.
    """
    split = texts.select(*keys, *(words(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns))
    ends, sizes = [], []
    for c in columns:
        sizes.append(F.size(c))
        ends.append(reduce(lambda x, y: x + y, sizes))
    rows = split.select(*keys, *(e.alias(f"__end{i}") for i, e in enumerate(ends)), F.posexplode(F.concat(*columns)).alias("__at", "__word"))
    term = rows.select(*keys, F.xxhash64("__word").alias("__term"), reduce(lambda x, y: x + y, [(F.col("__at") >= F.col(f"__end{i}")).cast("int") for i in range(len(columns))]).alias("__which"))
    counted = term.groupBy(*keys, "__term").agg(*(F.count(F.when(F.col("__which") == i, 1)).alias(f"__w{i}") for i in range(len(columns))))
    # the logarithm of 0 is null here, and a null key is no sample
    logs = [F.ln(F.when(F.col(f"__w{i}") > 0, F.col(f"__w{i}")).cast("double")).alias(f"__log{i}") for i in range(len(columns))]
    counted = counted.select(*keys, "__term", *logs)
    least = [F.min(x).alias(f"__s{i}_{k}") for k in range(samples) for i, x in enumerate(sample_keys(F.col("__term"), [F.col(f"__log{i}") for i in range(len(columns))], k))]
    best = counted.groupBy(*keys).agg(*least)
    return best.select(*keys, *(fingerprint([F.col(f"__s{i}_{k}") for k in range(samples)]).alias(f"fp_{c}") for i, c in enumerate(columns)))


def successors(ids: DataFrame, order: list[str]) -> DataFrame:
    """``ids`` with next_<column> of the row that follows in descending ``order``; the first follows the last.

    Rows are sorted as a whole by ranges, as many as the session's shuffles have partitions; inside a range each row sees the
    next, and only the ranges' heads, a row for each, are looked at together. ``order`` must be unique and not null.
    """
    whole, down = F.struct(*order), [F.desc(c) for c in order]
    rows = written(ids.repartitionByRange(*down).withColumn("__cell", F.spark_partition_id()), "ranges")
    ahead = rows.withColumn("__next", F.lead(whole).over(Window.partitionBy("__cell").orderBy(*down)))
    heads = rows.groupBy("__cell").agg(F.max(whole).alias("__head"))
    every = Window.partitionBy(F.lit(0)).orderBy(F.desc("__head"))  # a row for each range
    around = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("__cell", F.coalesce(F.lead("__head").over(every), F.max("__head").over(around)).alias("__after"))
    found = ahead.join(heads, "__cell").withColumn("__next", F.coalesce("__next", "__after"))
    return found.select(*ids.columns, *(F.col("__next")[c].alias(f"next_{c}") for c in order))


def op2(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, a row for each row of documents.

    Null text: empty. Rows with the same id follow each other by the hash of their text, the greater first; repeated rows
    follow each other, so the next document of all of them but the last is one of their own. Rows without an id come last.
    """
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("h", F.xxhash64(F.col("doc_id").isNull(), "text"))
    keys = ["doc", "h"]
    ids = docs.groupBy(*keys).agg(F.max("doc_id").alias("doc_id"), F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    links = written(successors(ids, keys), "links")
    docs = docs.drop("doc_id")
    take = F.floor(F.col("n_chars") / 2).cast("int").alias("take")
    wanted = links.select(F.col("next_doc").alias("doc"), F.col("next_h").alias("h"), F.col("doc").alias("to_doc"), F.col("h").alias("to_h"), take)
    head = F.expr("substring(text, 1, take)").alias("lent")
    lent = docs.join(wanted, keys).select(F.col("to_doc").alias("doc"), F.col("to_h").alias("h"), F.lit(False).alias("own"), head, "take")
    repeated = links.where("copies > 1").select(*keys, take)
    if repeated.limit(1).count():
        # a repeated row's text is edited twice: with its own beginning, and with that of what follows the last of them
        docs = docs.dropDuplicates(keys)
        again = docs.join(repeated, keys).select(*keys, F.lit(True).alias("own"), head, "take")
        lent = lent.dropDuplicates(keys).unionByName(again)
    both = docs.join(lent, keys).select(*keys, "own", "text", F.expr("concat(substring(text, 1, char_length(text) - take), lent)").alias("edited"))
    keyed = [*keys, "own"]
    marks = both.select(*keyed, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    prints = written(fingerprint_texts(both, keyed, ["text", "edited"]).join(marks, keyed), "prints")
    following = prints.where("not own").select(F.col("doc").alias("next_doc"), F.col("h").alias("next_h"), F.col("fp_text").alias("fp_next"))
    rows = links.join(prints, keys).join(following, ["next_doc", "next_h"])
    times = F.when(F.col("own"), F.col("copies") - 1).otherwise(1).cast("int")
    rows = rows.withColumn("__row", F.explode(F.sequence(F.lit(1), times)))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("fp_text").alias("fingerprint"),
        F.col("fp_edited").alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"),
        F.when(F.col("own"), 1.0).otherwise(likeness(F.col("fp_text"), F.col("fp_next"))).alias("near_next"),
    )
