"""Document fingerprints by I-Match over randomised lexicon subsets, in SQL functions alone.

Terms are lower-cased words. The lexicon holds every term whose document frequency lies in a band,
in `SLOTS` hash slots. A term stands in at least `RAREST` of the documents, so there are at most
1 / `RAREST` times as many terms as a document has on average, however many documents there are.
The lexicon is split by hash into subsets of falling rates, eight of each rate: of any text, short or long, some subsets keep a
few terms. A fingerprint is, for each subset, the hash of the text's sorted distinct terms in it;
the likeness of two texts is the share of equal hashes among the subsets that either text meets.

Null texts are empty. Texts without lexicon terms are fingerprinted whole and are like only equal
ones. Equal texts have equal fingerprints. An empty table gives an empty one. Other columns are not
read. Document ids may repeat; equal ids are taken in order of their text's hash, null ids last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quaymetrics.llm.text import require_columns
from quaymetrics.session import stored

SLOTS = 1 << 13
#: Band of the share of documents that a lexicon term stands in: idf from 1.2 to 6.9.
RAREST, COMMONEST = 0.001, 0.3
RATES, CELLS = 8, 8
#: Document ids are ordered in ranges of about so many documents, of which there are at most
#: MOST_RANGES; the table of their heads is thereby small enough to send to every task.
RANGE, MOST_RANGES = 1024, 1 << 16


def terms(text: Column) -> Column:
    """Hashes of the distinct words of a text."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    kept = F.filter(F.array_distinct(words), lambda w: w != "")
    return F.transform(kept, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """One row: the lexicon's term hashes of every slot."""
    n = docs.agg(F.count("*").alias("n")).first()["n"]
    counted = (
        docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"))
        .where((F.col("df") >= max(2, rarest * n)) & (F.col("df") <= max(2, commonest * n)))
    )
    slots = counted.groupBy(F.pmod("term", F.lit(SLOTS)).alias("slot")).agg(
        F.array_sort(F.collect_list("term")).alias("terms")
    )
    every = docs.sparkSession.range(SLOTS).join(slots, F.col("id") == F.col("slot"), "left")
    none = F.array().cast("array<bigint>")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("terms", none).alias("terms"))))
    return every.agg(F.transform(pairs, lambda p: p["terms"]).alias("slots"), F.lit(1).alias("one"))


def sign(df: DataFrame, words: DataFrame, text: str, signs: str, name: str) -> DataFrame:
    """Adds a text's signatures and fingerprint. The lexicon's one row goes to
    every task and is dropped again before anything moves."""
    with_words = df.withColumn("one", F.lit(1)).join(F.broadcast(words), "one")
    signed = with_words.withColumn(signs, signatures(F.col(text), F.col("slots"))).drop("one", "slots")
    return signed.withColumn(name, fingerprint(F.col(signs), F.col(text)))


def signatures(text: Column, slots: Column) -> Column:
    """A hash of the sorted lexicon terms of each subset, null where there is none."""
    kept = F.filter(
        terms(text),
        lambda h: F.array_contains(F.get(slots, F.pmod(h, F.lit(SLOTS)).cast("int")), h),
    )

    def draw(h: Column) -> Column:
        return F.shiftrightunsigned(h, 17).bitwiseAND(255)

    def cell(h: Column) -> Column:
        return F.shiftrightunsigned(h, 25).bitwiseAND(CELLS - 1)

    def subset(own: Column, c: int) -> Column:
        chosen = F.array_sort(F.filter(own, lambda h: cell(h) == c))
        return F.when(F.size(chosen) > 0, F.substring(F.md5(F.array_join(chosen, " ").cast("binary")), 1, 8))

    bands = F.array(
        *[
            F.struct(
                F.lit(0 if r == RATES - 1 else 1 << (7 - r)).alias("low"),
                F.lit((1 << (8 - r)) - 1).alias("high"),
            )
            for r in range(RATES)
        ]
    )
    rated = F.transform(
        F.array(kept),
        lambda k: F.transform(
            bands, lambda b: F.filter(k, lambda h: draw(h).between(b["low"], b["high"]))
        ),
    )[0]
    return F.flatten(
        F.transform(rated, lambda own: F.array(*[subset(own, c) for c in range(CELLS)]))
    )


def fingerprint(signs: Column, text: Column) -> Column:
    empty = F.forall(signs, lambda s: s.isNull())
    whole = F.concat(F.lit("whole:"), F.md5(text.cast("binary")))
    return F.when(empty, whole).otherwise(F.array_join(signs, ".", "-"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of equal hashes among the subsets that either text meets; `same`: equal fingerprints."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x)
    either = total(F.zip_with(a, b, lambda x, y: (x.isNotNull() | y.isNotNull()).cast("int")))
    equal = total(F.zip_with(a, b, lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))))
    return F.when(same, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(equal / either)


def with_next(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Each document with its signatures and the next document's text and signatures.

    Documents go in descending doc_id, the first follows the last. Ranges of ids are ordered
    separately; each also gets a copy of the first document of the range after it.
    """
    docs = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mark")
    )
    edges = docs.agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")
    ).first()
    ranges = max(1, min(MOST_RANGES, edges["n"] // RANGE))
    low = edges["low"] or 0
    width = ((edges["high"] or 0) - low) // ranges + 1
    placed = docs.withColumn(
        "range", F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(-1)).cast("long")
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("mark").desc()]
    first = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "mark"))
    heads = stored(
        placed.groupBy("range").agg(first.alias("head")).select("range", "head.doc_id", "head.mark"),
        "heads",
    )  # a row per range, MOST_RANGES + 1 at most
    around = Window.orderBy(F.col("range").desc())
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select(
        F.col("range").alias("to"),
        F.coalesce(
            F.lead(F.struct("doc_id", "mark")).over(around),
            F.first(F.struct("doc_id", "mark")).over(whole),
        ).alias("next"),
    ).select("to", F.col("next.doc_id").alias("_doc_id"), F.col("next.mark").alias("_mark"))
    copies = (
        placed.join(
            F.broadcast(after),
            placed["doc_id"].eqNullSafe(F.col("_doc_id")) & (F.col("mark") == F.col("_mark")),
        )
        .dropDuplicates(["to"])
        .select("doc_id", "text", "mark", F.col("to").alias("range"), F.lit(1).alias("copy"))
    )
    every = placed.withColumn("copy", F.lit(0)).unionByName(copies)
    near = Window.partitionBy("range").orderBy("copy", *order)
    # only texts move; signatures are made where the next text has come to stand
    paired = every.withColumn("next_text", F.lead("text").over(near))
    signed = sign(paired, words, "text", "signs", "print")
    return (
        signed.withColumn("next_signs", F.lead("signs").over(near))
        .withColumn("next_print", F.lead("print").over(near))
        .where("copy = 0")
        .drop("mark", "range", "copy")
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the start of the following text."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(
        F.substr(text, F.lit(1), F.length(text) - third), F.substr(following, F.lit(1), third)
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every document, and its likeness to its edited text and the next document."""
    require_columns(docs, "doc_id", "text")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = stored(lexicon(docs), "lexicon")
    paired = with_next(docs, words).withColumn("other", edited(F.col("text"), F.col("next_text")))
    signed = sign(paired, words, "other", "other_signs", "other_print")
    return signed.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("other", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("other_print").alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("other_signs"), F.col("print") == F.col("other_print")).alias(
            "near_edited"
        ),
        likeness(
            F.col("signs"), F.col("next_signs"), F.col("print") == F.col("next_print")
        ).alias("near_next"),
    )
