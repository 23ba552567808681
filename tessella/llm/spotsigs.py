"""SpotSigs document fingerprints, in DataFrame functions only.

Wherever a common word (an anchor) stands in a text, the anchor and the next two content words form a signature, a chain;
other anchors in between are skipped, however many.  Two spots are anchors without a word: the start of a text, and the end
of every ``STRETCH``-th content word in a row.  So lists, tables and short texts, which hold few common words, have chains
too, found by the same local rule at any length; at the end of a text one content word is chain enough.

A fingerprint is the whole set of a text's signatures: eight hexadecimal digits for each, in ascending order of the
hashes.  Likeness is the Jaccard similarity of two whole sets.

``near_pairs`` partitions sets by length and compares only those whose lengths and rarest signatures allow the threshold.

Defined results: null and empty texts, and those without letters or digits, have the empty fingerprint; equal fingerprints
have likeness 1, the empty one 0 with any other; a very long text is signed whole, by one task; rows of equal id stand by
text in descending order; repeated rows have a row each; a null id counts as the smallest; an empty table gives an empty
one; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

STRETCH = 4
MARK = "\u0001"
# Common words of four languages, the anchors.
ANCHORS = (
    "the of and to in is that for it as was with be by on this are at from or an a he his not have has but they you we will can all their which been"
    " der die das und den von zu mit ist des auf für nicht ein eine einer dem sich auch als es im sie wird aus bei nach"
    " le la les de et un une du en est que pour dans qui sur par au pas avec ce se plus son"
    " el los las y del con su para al lo como más no una por si sus o"
).split()


def word_list(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def spots(words: Column) -> Column:
    """A list of words as spots: each a run of anchors and the content words up to the next run, ``STRETCH`` at most.

    An anchor has a mark before it, a content word a blank, so a run of anchors is one stretch without blanks.
    """
    marked = F.array_join(F.transform(words, lambda w: F.concat(F.when(w.isin(*ANCHORS), MARK).otherwise(" "), w)), "")
    content = f"(?: [^{MARK} ]+)"
    stretched = F.regexp_replace(F.concat(F.lit(MARK), marked), f"({content}{{{STRETCH}}})(?= )", f"$1{MARK}")
    return F.regexp_extract_all(stretched, F.lit(f"({MARK}[^ ]*{content}{{1,{STRETCH}}})"), F.lit(1))


def signatures(found: Column) -> Column:
    """The distinct signature hashes of spots, ascending.  ``found`` is a column that exists: it is read several times."""
    word = lambda spot, i: F.split_part(spot, F.lit(" "), F.lit(i))
    after = F.concat(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.array(F.lit("")))

    def chain(spot: Column, following: Column) -> Column:
        # A spot has a content word at least; the second may be the first of the spot that follows.
        second = F.when(word(spot, 3) != "", word(spot, 3)).otherwise(word(following, 2))
        anchors = F.array_distinct(F.slice(F.split(word(spot, 1), MARK), 2, 1 << 30))
        return F.struct(anchors.alias("anchors"), F.xxhash64(word(spot, 2), second).alias("chain"))

    chains = F.zip_with(found, after, chain)
    hashed = F.flatten(F.transform(chains, lambda z: F.transform(z["anchors"], lambda a: F.xxhash64(a, z["chain"]))))
    return F.when(F.size(found) > 0, F.sort_array(F.array_distinct(hashed))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(hashes: Column) -> Column:
    """Eight hexadecimal digits, the low half, of each hash."""
    low = lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.array_join(F.transform(hashes, low), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def with_signatures(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the signature set of the column ``text``."""
    found = rows.withColumn("_spots", spots(word_list(F.col(text))))
    return found.withColumn(name, signatures(F.col("_spots"))).drop("_spots")


def with_next_text(docs: DataFrame, derived: str | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text that follows in descending order of ids; after the last, the first.

    With ``derived``, also the signature set of each text under that name, and of the next one under next_ and it.

    Ranges of ids are dealt to tasks; each range also gets the first row of the range that follows, so no window spans
    the table.  The bounds are a number per shuffle partition.
    """
    spark = docs.sparkSession
    n = C.shuffle_partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], min(max(10_000, 10 * n), 1_000_000)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    # Two steps through the bounds: blocks, then the bounds of one block.
    step = 256
    # As text, so that the plan holds one literal and not a node per bound.
    listed = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")
    every, blocks = listed(bounds), listed(bounds[::step])
    block = F.greatest(F.size(F.filter(blocks, lambda b: b <= F.col("key"))) - 1, F.lit(0))
    if len(bounds) > step:
        rows = rows.withColumn("block", block * step)
        rows = rows.withColumn("bucket", F.col("block") + F.size(F.filter(F.slice(every, F.col("block") + 1, step), lambda b: b <= F.col("key")))).drop("block")
    else:
        rows = rows.withColumn("bucket", F.size(F.filter(every, lambda b: b <= F.col("key"))))
    # Each range's guest: the first row of the range that follows, found by its key; a key and a number per range.
    largest = rows.groupBy("bucket").agg(F.max("key").alias("key"))
    down = Window.orderBy(F.desc("bucket"))
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = largest.select("bucket", F.coalesce(F.lead("key").over(down), F.first("key").over(whole)).alias("key"))
    guests = rows.select("key", "text").join(F.broadcast(wanted), "key").groupBy("bucket").agg(F.max("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("key"), "bucket", F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests).repartition(n, "bucket")
    columns = ["text"]
    if derived:
        dealt = with_signatures(dealt, "text", derived)
        columns.append(derived)
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("text"))
    led = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns))
    return led.where("not guest").select("doc_id", *columns, *(f"next_{c}" for c in columns))


def signature_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, s) of the texts that have signatures."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_signatures(texts, "text", "s").select("doc_id", "s").where("size(s) > 0")


def members(docs: DataFrame) -> DataFrame:
    """(id, doc_id) of texts whose signature set is that of a text of smaller id: the node of ``near_pairs`` and the text."""
    sets = signature_sets(docs)
    nodes = sets.groupBy("s").agg(F.min("doc_id").alias("id"))
    return sets.join(nodes, "s").where("NOT doc_id <=> id").select("id", "doc_id").distinct()


def near_pairs(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, likeness) of texts whose full signature sets are at least ``percent`` alike, a < b.

    Equal sets are one node, named by their smallest id (``members`` lists the others).  Sets are partitioned by length on
    a geometric scale: a partner is in the same partition or the next, and shares one of the rarest signatures of either.
    """
    nodes = signature_sets(docs).groupBy("s").agg(F.min("doc_id").alias("id"))
    ratio = F.log(F.lit(100.0 / percent))
    nodes = nodes.withColumn("n", F.size("s")).withColumn("part", F.floor(F.log("n") / ratio))
    tokens = nodes.select("id", "n", "part", F.explode("s").alias("t"))
    tokens = tokens.join(tokens.groupBy("t").agg(F.count("*").alias("df")), "t")
    # An n-gram's place in the rare-first order of its set.
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "t"))
    prefix = tokens.withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("df") > 1))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", "t")
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "t")
    pairs = left.join(right, ["part", "t"]).where("a <> b and least(na, nb) * 100 >= greatest(na, nb) * " + str(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = nodes.select("id", "s")
    joined = pairs.join(sides.toDF("a", "sa"), "a").join(sides.toDF("b", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    alike = both / (F.size("sa") + F.size("sb") - both)
    return joined.select("a", "b", alike.alias("likeness")).where(F.col("likeness") * 100 >= percent)


def op6_spotsigs(spark, sf_dir: str) -> DataFrame:
    pairs = with_next_text(C.documents(spark, sf_dir), "own")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    made = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    made = with_signatures(made, "edited", "of_edited")
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("of_edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("of_edited")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
