"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled to find what differs.

A paragraph is a line; of lines longer than PIECE code points, every PIECE of them. Its digest counts once for
each time that it stands in a text, so the digests of a text are a set. A sketch has GROUPS times WIDTH cells, and a
digest goes to one cell of each group: the cell counts it and adds it and its check hash by exclusive or. What
two versions share cancels when their cells are subtracted. A cell with one digest left gives that digest away;
it is taken out of its other cells, which may leave one digest there, and so on.

A sketch has one size, so fingerprints can be compared whatever their texts' lengths. Where peeling gets
stuck, both versions are sketched again in parts, by the first bits of their digests: the more digests
there are, the more parts. Parts that get stuck are parted further, until none is. Work is in proportion to
the digests, and only the counts of a part leave its row.

All is done with column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import checkpointed, let
from tarnflow.llm.tables import table
from tarnflow.operators.ranges import placed

PIECE = 256
GROUPS, WIDTH, ROUNDS = 3, 8, 12
#: Digests of both versions in a part, on average, when parts are first made.
PART = 8
KEY = ["id", "lacking", "hash"]


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits)


def digests(text: Column) -> Column:
    """The set of a text's paragraph digests; a paragraph's further occurrences have digests of their own."""

    def counted(all_: Column, different: Column) -> Column:
        def repeats(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
            times = lambda st: F.transform(st, lambda at, i: F.struct(F.get(s, at).alias("d"), (F.coalesce(F.get(st, i + 1), F.size(s)) - at).alias("n")))
            several = let(starts, lambda st: F.filter(times(st), lambda r: r["n"] > 1))
            return F.flatten(F.transform(several, lambda r: F.transform(F.sequence(F.lit(2), r["n"]), lambda o: F.xxhash64(r["d"], o))))

        return F.when(F.size(all_) == F.size(different), different).otherwise(F.concat(different, let(F.sort_array(all_), repeats)))

    return let(F.transform(F.regexp_extract_all(text, F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0)), lambda p: F.xxhash64(p)), lambda d: let(F.array_distinct(d), lambda different: counted(d, different)))


def check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(1)).bitwiseAND(0xFFFFFFFF)


def _cell(n: Column, digest: Column, proof: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), digest.alias("digest"), proof.alias("proof"))


def _stands(x: Column, i: Column) -> Column:
    """Whether digest x goes to cell i."""
    group = F.floor(i / WIDTH).cast("int")
    return _right(x, group * 5).bitwiseAND(WIDTH - 1) == i % WIDTH


def sketch(items: Column) -> Column:
    """Cells (n, digest, proof) of a set of digests."""
    empty = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    cell = lambda i: F.aggregate(F.filter(items, lambda x: _stands(x, i)), empty, lambda s, x: _cell(s["n"] + 1, s["digest"].bitwiseXOR(x), s["proof"].bitwiseXOR(check(x))))
    return F.transform(F.sequence(F.lit(0), F.lit(GROUPS * WIDTH - 1)), cell)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["digest"].bitwiseXOR(y["digest"]), x["proof"].bitwiseXOR(y["proof"])))


def peeled(cells: Column) -> Column:
    """(only_a, only_b): how many digests only the first, or only the second version has; null if cells are left that don't give theirs away."""

    def alone(cells: Column) -> Column:
        sure = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["proof"] == check(c["digest"])))
        return F.array_distinct(F.transform(sure, lambda c: F.struct(c["n"].alias("n"), c["digest"].alias("digest"))))

    def without(cells: Column, found: Column) -> Column:
        taken = lambda c, i: F.aggregate(F.filter(found, lambda y: _stands(y["digest"], i)), c, lambda s, y: _cell(s["n"] - y["n"], s["digest"].bitwiseXOR(y["digest"]), s["proof"].bitwiseXOR(check(y["digest"]))))
        return F.transform(cells, taken)

    def step(state: Column, _: Column) -> Column:
        number = lambda found, sign: F.size(F.filter(found, lambda y: y["n"] == sign))
        after = lambda found: F.when(F.size(found) == 0, state).otherwise(F.struct(without(state["cells"], found).alias("cells"), (state["only_a"] + number(found, 1)).alias("only_a"), (state["only_b"] + number(found, -1)).alias("only_b")))
        return let(alone(state["cells"]), after)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("only_a"), F.lit(0).alias("only_b"))
    clear = lambda s: ~F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["digest"] != 0) | (c["proof"] != 0))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return let(end, lambda s: F.when(clear(s), F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"))))


def fingerprint(cells: Column) -> Column:
    """A sketch as a text: n:digest:proof of each cell in hexadecimal, nothing for an empty cell, between points."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(F.concat_ws(":", F.hex(c["n"].cast("long")), F.hex(c["digest"]), F.hex(c["proof"])))), ".")


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, only_a, only_b) of pairs (pair, a, b): sizes of the differences of two sets of digests, by sketches."""
    first = checkpointed(pairs.withColumn("left", peeled(subtracted(sketch(F.col("a")), sketch(F.col("b"))))))
    done = first.where("left is not null").select("pair", "left.only_a", "left.only_b")
    both = F.concat(F.transform("a", lambda x: F.struct(x.alias("x"), F.lit(0).alias("side"))), F.transform("b", lambda x: F.struct(x.alias("x"), F.lit(1).alias("side"))))
    bits = F.least(F.lit(63), F.greatest(F.lit(2), F.ceil(F.log2((F.size("a") + F.size("b")) / PART)))).cast("int")
    stuck = first.where("left is null").select("pair", F.sort_array(both).alias("items"), bits.alias("bits"))
    while True:
        own = lambda side: F.transform(F.filter("items", lambda y: y["side"] == side), lambda y: y["x"])
        # Sorted digests with the same first bits stand together.
        part = lambda i: _right(F.get("items", i)["x"], 64 - F.col("bits"))
        starts = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda i: (i == 0) | (part(i) != part(F.greatest(i - 1, F.lit(0)))))
        cut = let(starts, lambda st: F.transform(st, lambda at, i: F.slice("items", at + 1, F.coalesce(F.get(st, i + 1), F.size("items")) - at)))
        parts = stuck.select("pair", "bits", F.explode(cut).alias("items")).withColumn("bits", F.least(F.col("bits") + 2, F.lit(63)))
        parts = checkpointed(parts.withColumn("left", peeled(subtracted(sketch(own(0)), sketch(own(1))))))
        done = done.unionByName(parts.where("left is not null").select("pair", "left.only_a", "left.only_b"))
        stuck = parts.where("left is null").drop("left")
        if stuck.isEmpty():
            return done.groupBy("pair").agg(F.sum("only_a").alias("only_a"), F.sum("only_b").alias("only_b"))


def likeness(a: Column, b: Column, only_a: Column, only_b: Column) -> Column:
    """Share of the digests of two sets that both have; 1 for two empty ones."""
    return F.coalesce(F.try_divide((a - only_a + b - only_b).cast("double"), a + b), F.lit(1.0))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    number = F.col(doc_id).cast("long")
    return docs.select(F.coalesce(number, F.lit(0)).alias("id"), number.isNull().alias("lacking"), F.xxhash64(whole).alias("hash"), whole.alias("text"))


def versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lacking, n, copies, edited_sha256, own, edited, next): digests of each text, its edited one and the next document's.

    The next document is found by the place in the order of all keys, which have no texts with them. Of rows with one id and one
    text, all but the last (copies of them in one row) are followed by the same text.
    """
    rows = _keyed(docs, doc_id, text)
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("m"), F.max(F.length("text")).alias("n"))
    keys = checkpointed(placed(keys, [], [(~F.col("lacking")), F.col("id"), F.col("hash")], "place", "size"))
    before = keys.select((F.col("place") % F.col("size") + 1).alias("place"), *[F.col(c).alias(f"before_{c}") for c in KEY], F.col("n").alias("before_n"))
    links = checkpointed(keys.join(before, "place").drop("place", "size"))
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text")).join(links, KEY)
    half = lambda n: F.floor(F.col(n) / 2).cast("int")
    own = texts.select(*KEY, "n", "m", F.left("text", F.col("n") - half("n")).alias("start"), digests(F.col("text")).alias("own"))
    after = texts.select(*[F.col(f"before_{c}").alias(c) for c in KEY], F.left("text", half("before_n")).alias("end"), digests(F.col("text")).alias("next"))
    both = own.join(after, KEY)
    kinds = F.array(F.struct(F.lit(1).cast("long").alias("copies"), F.col("end").alias("end"), F.col("next").alias("next")), F.struct((F.col("m") - 1).alias("copies"), F.left("start", half("n")).alias("end"), F.col("own").alias("next")))
    both = both.select("id", "lacking", "n", "own", "start", F.explode(F.filter(kinds, lambda k: k["copies"] > 0)).alias("k"))
    both = both.select("id", "lacking", "n", "own", "k.copies", "k.next", F.concat("start", "k.end").alias("text"))
    return both.select("id", "lacking", "n", "copies", F.sha2("text", 256).alias("edited_sha256"), "own", digests(F.col("text")).alias("edited"), "next")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs (columns as in op12_fingerprints).

    Null texts count as empty. Documents are in the order of their ids, null ones first, then of their texts' hashes; rows
    alike in both follow each other. A single document is followed by itself. Extra columns are left out; an empty table
    gives no rows. Likeness is the share of paragraphs that both texts have, whatever their order.
    """
    made = checkpointed(versions(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    pair = lambda which, b: F.struct((F.col("row") * 2 + which).alias("pair"), F.col("own").alias("a"), F.col(b).alias("b"))
    apart = differences(made.select(F.inline(F.array(pair(0, "edited"), pair(1, "next")))))
    of = lambda which, c: F.max(F.when(F.col("pair") % 2 == which, F.col(c))).alias(f"{c}{which}")
    apart = apart.groupBy(F.floor(F.col("pair") / 2).alias("row")).agg(*[of(w, c) for w in (0, 1) for c in ("only_a", "only_b")])
    near = lambda b, w: likeness(F.size("own"), F.size(b), F.col(f"only_a{w}"), F.col(f"only_b{w}"))
    out = made.join(apart, "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.when(~F.col("lacking"), F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256", fingerprint(sketch(F.col("own"))).alias("fingerprint"),
        fingerprint(sketch(F.col("edited"))).alias("edited_fingerprint"), near("edited", 0).alias("near_edited"), near("next", 1).alias("near_next"),
    )


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
