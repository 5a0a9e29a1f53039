"""Documents that hold passages of benchmark items, in built-in SQL functions only.

Spaced seeds: windows of tokens are hashed under fixed masks, each of which ignores some places, so
a seed still matches where a replaced word falls on an ignored place. Items and documents are hashed at
each place; equal hashes join. Items shorter than any mask have one seed, all of their tokens. Where items of up to MIN_TOKENS
tokens may have replaced ones, they are cut into one part more than that, of which one is always whole. Around a hit
the item's tokens are compared with the document's at the same offset: a document's hits are verified
together, in parts of bounded size, each on the slice of the document's tokens that it needs. Any stretch of which enough tokens are the item's counts as contamination;
the best-scored of them, at +1 for a kept and -2 for a replaced token, is reported.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import checkpointed, let
from tarnflow.llm.tables import table

#: Tokens of the longest window, and of the shortest item that masks are for. However the replaced tokens lie, a stretch of MIN_TOKENS kept ones and
#: MIN_SHARE holds a window that one of the masks accepts; a test walks through all stretches.
SPAN = 8
MASKS = ("1111101", "11001111", "10110111")
#: Tokens of an item that an overlap needs, or the whole item if it is shorter; the share of them within the overlap.
MIN_TOKENS, MIN_SHARE = 13, 0.8
#: Share of their tokens that op9 and the pipeline ask of items of SPAN to MIN_TOKENS tokens.
SHORT_SHARE = 0.8
#: Rows up to which a side is broadcast: at most 32 bytes each for seeds and candidates.
BROADCAST_ROWS = 200_000
#: Offsets in a document whose hits are verified in one row.
OFFSETS = 2048


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; an empty one may stand at the end."""
    return F.split(F.regexp_replace(F.lower(text), r"\A[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column) -> Column:
    """(at, h0, h1, ...) of each window of an array of word hashes; null under a mask that ends beyond it."""
    n, least = F.size(words), min(map(len, MASKS))

    def of(i: Column) -> Column:
        by_mask = [F.xxhash64(F.lit(m), *[F.get(words, i + o) for o, c in enumerate(mask) if c == "1"]) for m, mask in enumerate(MASKS)]
        whole = [h if len(mask) == least else F.when(i <= n - len(mask), h) for h, mask in zip(by_mask, MASKS)]
        return F.struct(i.alias("at"), *[h.alias(f"h{m}") for m, h in enumerate(whole)])

    return F.when(n >= least, F.transform(F.sequence(F.lit(0), n - least), of))


def _exploded(df: DataFrame, key: str) -> DataFrame:
    """(key, at, h): a row for each window and mask."""
    rows = df.select(key, F.inline(seeds(F.col("w"))))
    return rows.select(key, "at", F.explode(F.array(*[F.col(f"h{m}") for m in range(len(MASKS))])).alias("h")).where("h is not null")


def _whole(words: Column, n: int, at: int = 0) -> Column:
    """Hash of n tokens as one seed of an item."""
    return F.xxhash64(F.lit(f"whole {n}"), *[F.get(words, F.lit(at + i)) for i in range(n)])


def asked(n: int, short_share: float) -> int:
    """Tokens that an overlap has to keep of an item of n."""
    return n if n < SPAN else min(MIN_TOKENS, ceil(short_share * n - 1e-9)) if n <= MIN_TOKENS else MIN_TOKENS


def parts(n: int, short_share: float) -> list[tuple[int, int]]:
    """(place, length) of the parts of a short item, one of which any overlap keeps whole; all of the item where nothing may be replaced."""
    count = n - asked(n, short_share) + 1
    return [(i * (n // count), n // count) for i in range(count)]


def _runs(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, at, h): a row for each run of n tokens."""
    of = lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(f"whole {n}"), *[F.get("w", i + o) for o in range(n)]).alias("h"))
    return df.where(F.size("w") >= n).select(key, F.inline(F.transform(F.sequence(F.lit(0), F.size("w") - n), of)))


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few enough rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def best_stretch(same: Column) -> Column:
    """(from, to, kept) of the best-scored stretch of an array of booleans."""
    start = F.struct(*[F.lit(0).alias(x) for x in ("i", "now", "since", "kept", "best", "from", "to", "most")])

    def step(a: Column, x: Column) -> Column:
        fresh = a["now"] < 0
        score = F.when(fresh, F.lit(0)).otherwise(a["now"]) + F.when(x, 1).otherwise(-2)
        since = F.when(fresh, a["i"]).otherwise(a["since"])
        kept = F.when(fresh, F.lit(0)).otherwise(a["kept"]) + F.when(x, 1).otherwise(0)
        better = (score > a["best"]) | ((score == a["best"]) & (kept > a["most"]))
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(
            (a["i"] + 1).alias("i"), score.alias("now"), since.alias("since"), kept.alias("kept"),
            pick(score, a["best"]).alias("best"), pick(since, a["from"]).alias("from"), pick(a["i"] + 1, a["to"]).alias("to"), pick(kept, a["most"]).alias("most"),
        )

    return F.aggregate(same, start, step)


def least_kept(n: Column, short_share: float) -> Column:
    by_n = F.array(*[F.lit(asked(i, short_share)) for i in range(MIN_TOKENS + 1)])
    return F.coalesce(F.get(by_n, n), F.lit(MIN_TOKENS))


def enough(kept: Column, length: Column, least: Column) -> Column:
    """Whether a stretch is an overlap of an item that asks for so many tokens."""
    return (kept >= least) & (kept >= MIN_SHARE * length)


def best_overlap(same: Column, least: Column) -> Column:
    """(best, most, before, to) of the best-scored stretch that is enough, of all stretches; null if none is.

    A stretch that ends within a run of kept tokens is beaten by the one that takes in all of the run. So only stretches
    from the begin of a run to the end of one are compared.
    """
    kept = F.filter(F.transform(same, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())

    def of_runs(begins: Column, ends: Column) -> Column:
        def stretch(p: Column, first: Column, q: Column) -> Column:
            n, last = q["p"] - p + 1, q["at"]
            length = last - first + 1
            return F.when(enough(n, length, least), F.struct((3 * n - 2 * length).alias("best"), n.alias("most"), (-first).alias("before"), (last + 1).alias("to")))

        return F.array_max(F.transform(begins, lambda b: F.array_max(F.transform(F.filter(ends, lambda q: q["p"] >= b["p"] + least - 1), lambda q: stretch(b["p"], b["at"], q)))))

    def of(places: Column) -> Column:
        # Neighbouring kept tokens, each with its number among the kept ones, where one run ends or begins.
        numbered = F.transform(places, lambda at, p: F.struct(p.alias("p"), at.alias("at")))
        edge = lambda step: F.filter(numbered, lambda x: ~F.coalesce(F.get(places, x["p"] + step) == x["at"] + step, F.lit(False)))
        return let(edge(-1), lambda begins: let(edge(1), lambda ends: of_runs(begins, ends)))

    return F.when(F.size(kept) >= least, let(kept, of))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", short_share: float = 1.0) -> DataFrame:
    """(doc_id, item_id, token_start, token_end, n_kept, n_item_tokens): the best overlap of each document and item that share enough.

    An overlap is any stretch at one offset that is enough; of an offset's overlaps the best-scored counts, of all offsets' the one with the most tokens kept.

    Documents without an overlap have no row. Null and empty texts overlap nothing. Items of fewer than SPAN tokens
    are overlapped only by all of their tokens in a row, those of up to MIN_TOKENS by short_share of theirs, all unless another share is given; items without tokens by nothing. Repeated documents and
    items give one row together; of rows with one id and different texts, any may overlap. Null ids are ids like
    others, extra columns are left out, and either table may be empty. Of equally good overlaps the first in the
    document counts.
    """
    bench = items.select(F.col(item_id).alias("item_id"), F.filter(tokens(F.col(item_text)), lambda w: w != "").alias("w"))
    bench = _small(bench.where(F.size("w") > 0).select("item_id", hashed(F.col("w")).alias("w")).distinct())
    seeded = [i for i in range(1, MIN_TOKENS + 1) if i < SPAN or len(parts(i, short_share)) > 1]
    short = sorted(r.n for r in bench.select(F.size("w").alias("n")).where(F.col("n").isin(seeded)).distinct().collect())
    number = F.size("w").alias("n")
    marks = _exploded(bench.where(~F.size("w").isin(seeded)).withColumn("item", F.struct("item_id", number)), "item").select("h", "item", F.col("at").alias("place"))
    for n in short:
        for at, size in parts(n, short_share):
            marks = marks.unionByName(bench.where(F.size("w") == n).select(_whole(F.col("w"), size, at).alias("h"), F.struct("item_id", number).alias("item"), F.lit(at).alias("place")))
    marks = _small(marks.select("h", "item.item_id", "item.n", "place").distinct())

    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    words = read.select("doc_id", hashed(tokens(F.col("text"))).alias("w"))
    windows = _exploded(words, "doc_id")
    for size in sorted({size for n in short for _, size in parts(n, short_share)}):
        windows = windows.unionByName(_runs(words, "doc_id", size))
    hits = windows.join(marks, "h").select("doc_id", "item_id", "n", (F.col("at") - F.col("place")).alias("shift")).distinct()
    hits = hits.groupBy("doc_id", F.floor(F.col("shift") / OFFSETS).alias("part"), F.floor(F.xxhash64("item_id") % 64).alias("share")).agg(F.collect_list(F.struct("item_id", "n", "shift")).alias("hits"))
    hits = _small(hits.select(F.col("doc_id").alias("hit_id"), "hits"))

    # Exploding one row keeps the tokens from being hashed anew for each hit.
    met = read.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id"))).select("doc_id", "hits", F.explode(F.array(hashed(tokens(F.col("text"))))).alias("d"))
    lead = lambda h: F.greatest(-h["shift"], F.lit(0))
    own = lambda h: F.slice("d", F.greatest(h["shift"], F.lit(0)) + 1, F.greatest(h["n"] - lead(h), F.lit(0)))
    pairs = met.select("doc_id", F.inline(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["shift"].alias("shift"), lead(h).alias("lead"), own(h).alias("d")))))
    pairs = pairs.join(bench.select(F.col("item_id").alias("bench_id"), "w"), F.col("item_id").eqNullSafe(F.col("bench_id"))).drop("bench_id")
    same = F.transform("w", lambda x, i: F.coalesce(F.get("d", F.when(i >= F.col("lead"), i - F.col("lead"))) == x, F.lit(False)))
    pairs = pairs.select("doc_id", "item_id", "shift", F.size("w").alias("n_item_tokens"), same.alias("same"))
    found = pairs.select("*", best_stretch(F.col("same")).alias("s"))
    least = least_kept(F.col("n_item_tokens"), short_share)
    passes = enough(F.col("s.most"), F.col("s.to") - F.col("s.from"), least)
    first = F.struct(F.col("s.best").alias("best"), F.col("s.most").alias("most"), (-F.col("s.from")).alias("before"), F.col("s.to").alias("to"))
    # Where the best-scored stretch of all is too thin, a shorter one may still be enough.
    found = found.select("doc_id", "item_id", "shift", "n_item_tokens", F.when(passes, first).otherwise(best_overlap(F.col("same"), least)).alias("s"))
    found = found.where("s is not null").select(
        "doc_id", "item_id", F.struct(F.col("s.most").alias("n_kept"), (F.col("s.before") - F.col("shift")).alias("before"), (F.col("s.to") + F.col("shift")).alias("token_end"), "n_item_tokens").alias("o")
    )
    best = found.groupBy("doc_id", "item_id").agg(F.max("o").alias("o"))
    return best.select("doc_id", "item_id", (-F.col("o.before")).alias("token_start"), "o.token_end", "o.n_kept", "o.n_item_tokens")


def op9_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_share=SHORT_SHARE)
