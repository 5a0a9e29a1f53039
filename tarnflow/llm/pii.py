"""Personal data in texts, in built-in SQL functions only.

Regular expressions propose spans, checksums (Luhn, mod 97) and range tests confirm them, and words
near a span raise its score. Positions come from ``split`` and ``regexp_extract_all`` with one
pattern: gap and match lengths alternate and add up to the text, so a running sum gives each start.
Sums run over shares of MATCHES matches, so the work of a text grows with its matches, not with their
square. Offsets are code points, the end is exclusive.

Patterns use possessive quantifiers and fixed left bounds. They match what the plain greedy patterns
match, but Java neither recurses nor rescans on long runs of one class.

Defined results: a null text counts as empty and has no spans; repeated rows are repeated in the
output; a table without rows gives no rows; extra columns are kept, unless they are named like an
output column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.shared import let
from tarnflow.llm.tables import table

SPAN = "array<struct<kind:string,start:int,end:int,score:double,value:string>>"
SPAN_ITEM = "struct<kind:string,start:int,end:int,score:double,value:string>"


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    pattern proposes; needs is a cheap pattern that any text with a match has; words near a match add
    to base up to 1. A kind with needs_word keeps a match only with such a word near it.
    """

    name: str
    pattern: str
    needs: str
    words: str
    base: float
    needs_word: bool = False


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|write|@", 0.9),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", r"\bip\b|address|host|server|login", 0.6),
    # The longest run of digits with single blanks or hyphens between; only runs of 16 to 19 digits are proposed.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])", r"[0-9][\x20-]?[0-9]", r"card|visa|credit|debit|payment|karte|tarjeta|carte", 0.8),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|call|tel|mobile|fax|handy", 0.7),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", r"iban|account|konto|bank|cuenta|compte", 0.8),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"ssn|social|security", 0.5, True),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])", "[A-Za-z0-9+/_-]{20}", r"(?:token|secret|passw(?:or)?d|api.?key|access.?key|bearer)[\"']?\s*(?:[=:]\s*)?[\"']?$", 0.5, True),
)
BASE_KINDS = ("email", "ip", "card", "phone")
NEAR = 40
#: Matches of a text that are added up, or replaced, one after the other.
MATCHES = 128


def _shares(values: Column) -> Column:
    """Numbers of the shares of a list that isn't empty."""
    return F.sequence(F.lit(0), F.floor((F.size(values) - 1) / MATCHES).cast("int"))


def _share(values: Column, n: Column) -> Column:
    return F.slice(values, n * MATCHES + 1, F.lit(MATCHES))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def luhn_ok(number: Column) -> Column:
    """Whether the digits of a string pass the Luhn test."""
    d = F.reverse(_digits(number))
    value = lambda x: F.ascii(x) - 48
    doubled = F.transform(_chars(d), lambda x, i: F.when(i % 2 == 0, value(x)).otherwise((value(x) * 2) % 10 + F.when(value(x) >= 5, 1).otherwise(0)))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d) > 0, total % 10 == 0).otherwise(F.lit(False))


def mod97_ok(code: Column) -> Column:
    """Whether an account number passes the mod-97 test: first four characters to the end, letters to 10..35, remainder 1."""
    plain = F.regexp_replace(code, r"\x20", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        _chars(moved),
        F.lit(0),
        lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97),
    )
    return rest == 1


def _confirmed(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return n.between(16, 19) & luhn_ok(value)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34) & mod97_ok(value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def kind_spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind in a text, by start."""
    empty = F.array().cast(SPAN)
    word = F.lit("(?i)" + kind.words)
    plus = lambda a, x: a + x

    def steps(x: Column) -> Column:
        step = F.zip_with(x["found"], F.slice(x["gaps"], F.lit(1), F.size(x["found"])), lambda m, g: F.length(m) + F.length(g))
        return F.when(F.size(x["found"]) > 0, let(F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), step.alias("step")), sums)).otherwise(empty)

    def sums(x: Column) -> Column:
        by_share = F.transform(_shares(x["step"]), lambda n: F.aggregate(_share(x["step"], n), F.lit(0), plus))
        before = F.aggregate(by_share, F.array(F.lit(0)), lambda acc, s: F.array_append(acc, F.element_at(acc, -1) + s))
        return let(F.struct(x["gaps"].alias("gaps"), x["found"].alias("found"), x["step"].alias("step"), before.alias("before")), located)

    def located(x: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            at = F.get(x["before"], F.floor(i / MATCHES).cast("int")) + F.aggregate(F.slice(x["step"], i - i % MATCHES + 1, i % MATCHES), F.lit(0), plus)
            g, h = F.get(x["gaps"], i), F.get(x["gaps"], i + 1)
            near = F.regexp_like(F.right(g, F.lit(NEAR)), word) | F.regexp_like(F.substring(h, 1, NEAR // 2), word)
            score = F.when(near, F.lit(1.0)).otherwise(F.lit(kind.base))
            whole = lambda start: F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"), m.alias("value"))
            return let(at + F.length(g), whole)

        return F.filter(F.transform(x["found"], span), lambda s: _confirmed(kind.name, s["value"]) & (s["score"] >= 1.0 if kind.needs_word else F.lit(True)))

    cut = F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(kind.needs), let(cut, steps)).otherwise(empty)


def with_spans(df: DataFrame, text: str = "text", out: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """df with an array column of (kind, start, end, score, value), by kind as listed, then start.

    Kinds beyond the base ones keep a span only where it doesn't overlap a base span.
    """
    clean = F.coalesce(F.col(text), F.lit(""))
    base = [k for k in kinds if k.name in BASE_KINDS]
    more = [k for k in kinds if k.name not in BASE_KINDS]
    df = df.withColumn(out, F.concat(F.array().cast(SPAN), *[kind_spans(clean, k) for k in base]))
    if more:
        added = F.concat(F.array().cast(SPAN), *[kind_spans(clean, k) for k in more])
        free = F.filter(added, lambda s: ~F.exists(F.col(out), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        df = df.withColumn(out, F.concat(F.col(out), free))
    return df


def redact(df: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """df with each span replaced by <KIND>; overlapping spans become one, named after the first. A null text stays null."""
    tmp = "__pii"
    ordered = F.array_sort(F.transform(F.col(tmp), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def ends(spans: Column) -> Column:
        """Where the text is done before each share of the spans, and at the end."""
        last = F.transform(_shares(spans), lambda n: F.array_max(F.transform(_share(spans, n), lambda s: s["end"])))
        done = F.aggregate(last, F.array(F.lit(0)), lambda acc, e: F.array_append(acc, F.greatest(F.element_at(acc, -1), e)))
        return let(F.struct(spans.alias("spans"), done.alias("done")), whole)

    def whole(x: Column) -> Column:
        parts = F.transform(_shares(x["spans"]), lambda n: let(F.struct(F.get(x["done"], n).alias("at"), F.get(x["done"], n + 1).alias("to"), _share(x["spans"], n).alias("spans")), share))
        return F.concat(F.array_join(parts, ""), F.substr(F.col(text), F.element_at(x["done"], -1) + 1))

    def share(x: Column) -> Column:
        return let(F.struct(x["at"].alias("from"), F.substr(F.col(text), x["at"] + 1, x["to"] - x["at"]).alias("text"), x["spans"].alias("spans")), replaced)

    def replaced(x: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            put = F.array(F.substr(x["text"], acc["at"] - x["from"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            parts = F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(acc["parts"], put))
            return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), parts.alias("parts")))

        start = F.struct(x["from"].alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.array_join(F.aggregate(x["spans"], start, step)["parts"], "")

    made = with_spans(df, text, tmp, kinds)
    return made.withColumn(text, F.when(F.size(tmp) > 0, let(ordered, ends)).otherwise(F.col(text))).drop(tmp)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The exploded one-row form keeps the spans from being computed once for each column that reads them.
    found = with_spans(docs).select("doc_id", F.explode(F.array("pii")).alias("pii"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda s: s["score"])).alias("top_score"),
    )
