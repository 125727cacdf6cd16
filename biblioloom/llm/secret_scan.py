"""Operator 13, secrets by sliding-window entropy; DataFrame functions only.

Base spans follow fixed patterns and always stay: assignments to a name like ``token``, access key ids, runs of
lower-case hex digits. The method adds spans of kind ``entropy``: in every run of 20 or more characters of the
base64 alphabets (a candidate) a window of 20 characters slides one character at a time. Each step adds the
counts of the character that enters and takes away those of the one that leaves: the count of each
character, of digits, capitals and small letters, and the sum of n * log2(n) over the counts, from which Shannon's
entropy follows. The class of the window's characters (hex digits, letters of one case with digits, letters of
both cases with digits) sets the entropy and the numbers of digits and letters that it needs; hex digits are counted
without case. Windows that reach them and touch make one span. The sum is kept in integers, so the result of
a window does not depend on those before it.

Allow-list: candidates behind the name of a checksum, a commit or embedded data, behind an assignment (a base
span), identifiers of the UUID form, runs with a word for a placeholder or with an alphabet or a row of digits in order,
and spans that are words, names in camel case, paths or dates but for a quarter of their characters, unless letters
and digits meet in them as often as in random text.

Positions count code points. Defined results: null text counts as empty; empty tables give no rows; repeated rows
are judged each; a null doc_id stays null; other columns are not read. A text is searched in time that grows with its
length, whatever its longest run; nothing is cut off.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biblioloom.llm.pii import cuts, let, when_seen

KINDS = ("assign", "access", "hex", "entropy")
NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i)(?:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: What may stand before a candidate and settle it: an assignment, which is a base span, or a name of the allow-list.
BEFORE = (
    rf"""(?i:(?:{NAMES})["']?\x20*[:=]\x20*["']?"""
    r"""|(?:sha-?(?:1|224|256|384|512)|md5|crc32|checksum|digest|fingerprint|commit|revision|integrity|etag|build)["']?\x20*[:=(\x20-]\x20*["']?"""
    r"""|base64,\x20*)"""
)
RUN = "A-Za-z0-9+/_-"
WINDOW = 20
CANDIDATE = rf"(?:{BEFORE})?(?<![{RUN}])[{RUN}]{{{WINDOW},}}+"
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
PLACEHOLDERS = "(?i)example|sample|placeholder|change_?me|dummy|redacted|your_|xxxx|abcdefg|1234567|7654321|qwerty"
UUID = "^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Pieces of words, names, paths and dates, and the share of other characters that a secret has at least.
WORDS, OTHER = "[A-Z]?[a-z]{3,}+|[A-Z]{3,}+|[0-9]{1,4}+|[+/_-]", 0.25
#: Where a letter meets a digit, and how often that is so in a secret that may look like words.
MEETS, MIXED = "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]", 0.15
#: Entropy in bits, digits and letters that a window needs, by class.
HEX_BITS, ONE_CASE_BITS, BOTH_CASES_BITS = 2.9, 3.5, 3.7
HEX_NEEDS, ONE_CASE_NEEDS, BOTH_CASES_NEEDS = (3, 2), (4, 4), (2, 5)
UNIT = 1 << 20
SPAN = "array<struct<s:int,e:int>>"


def weight(n: int) -> int:
    """n * log2(n) in units of 2**-20."""
    return round(n * math.log2(n) * UNIT) if n else 0


def most(bits: float) -> int:
    """The greatest sum of weights with which a window has ``bits`` of entropy: H = log2(W) - sum / W."""
    return math.floor(WINDOW * (math.log2(WINDOW) - bits) * UNIT)


def windows(value: Column, is_hex: Column) -> Column:
    """Start and end of the stretches of ``value`` whose windows reach their class's entropy."""
    gain = F.array(*[F.lit(weight(n + 1) - weight(n)).cast("long") for n in range(WINDOW + 1)])  # of the n-th to the next
    folded = F.when(is_hex, F.lower(value)).otherwise(value)

    def slide(own: Column) -> Column:
        """``own``: place of each character in the alphabet, from 1."""
        at = lambda i: F.element_at(own, i)
        one = lambda c: c.cast("int")
        digit = lambda p: one(p.between(1, 10))
        upper = lambda p: one(p.between(11, 36))
        lower = lambda p: one(p.between(37, 62))

        def moved(acc: Column, new: Column, old: Column) -> Column:
            """The counts after ``new`` came and ``old`` (0: none) went."""
            came = acc["sum"] + F.get(gain, F.element_at(acc["counts"], new))
            left = F.element_at(acc["counts"], F.greatest(old, F.lit(1))) + one(new == old)
            return F.struct(
                F.transform(acc["counts"], lambda n, k: n + one(k + 1 == new) - one(k + 1 == old)).alias("counts"),
                F.when(old == 0, came).otherwise(came - F.get(gain, left - 1)).alias("sum"),
                (acc["digits"] + digit(new) - digit(old)).alias("digits"),
                (acc["upper"] + upper(new) - upper(old)).alias("upper"),
                (acc["lower"] + lower(new) - lower(old)).alias("lower"),
            )

        def dense(x: Column) -> Column:
            letters = x["upper"] + x["lower"]
            reaches = lambda bits, needs: (x["sum"] <= most(bits)) & (x["digits"] >= needs[0]) & (letters >= needs[1])
            both = (x["upper"] > 0) & (x["lower"] > 0)
            return F.when(is_hex, reaches(HEX_BITS, HEX_NEEDS)).when(both, reaches(BOTH_CASES_BITS, BOTH_CASES_NEEDS)).otherwise(reaches(ONE_CASE_BITS, ONE_CASE_NEEDS))

        def step(acc: Column, i: Column) -> Column:
            def noted(x: Column) -> Column:
                hit = (i >= WINDOW) & dense(x)
                apart = hit & (acc["to"] < i - WINDOW)
                return F.struct(
                    *[x[c].alias(c) for c in ("counts", "sum", "digits", "upper", "lower")],
                    F.when(apart | (hit & (acc["to"] == 0)), i - WINDOW).otherwise(acc["from"]).alias("from"),
                    F.when(hit, i).otherwise(acc["to"]).alias("to"),
                    F.when(apart & (acc["to"] > 0), F.concat(acc["out"], F.array(F.struct(acc["from"].alias("s"), acc["to"].alias("e"))))).otherwise(acc["out"]).alias("out"),
                )

            return let(moved(acc, at(i), F.when(i > WINDOW, at(i - WINDOW)).otherwise(F.lit(0))), noted)

        zero = F.lit(0)
        start = F.struct(
            F.array_repeat(zero, len(ALPHABET)).alias("counts"), F.lit(0).cast("long").alias("sum"), zero.alias("digits"), zero.alias("upper"), zero.alias("lower"),
            zero.alias("from"), zero.alias("to"), F.array().cast(SPAN).alias("out"),
        )
        last = lambda acc: F.when(acc["to"] > 0, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("s"), acc["to"].alias("e"))))).otherwise(acc["out"])
        return F.aggregate(F.sequence(F.lit(1), F.size(own)), start, step, last)

    return let(F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c)), slide)


def dense_spans(text: Column) -> Column:
    """Start and end of the spans that the windows add."""

    def open_(x: Column) -> Column:
        """Neither settled by what stands before, nor a base span, nor on the allow-list."""
        v = x["v"]
        settled = v.rlike(f"^(?:{BEFORE})") | v.rlike("^[0-9a-f]{24,}$") | v.rlike(rf"^{ACCESS}$")
        return ~settled & v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(UUID) & ~v.rlike(PLACEHOLDERS)

    def strange(v: Column) -> Column:
        """Whether enough of a span is neither a word nor a part of a path or date."""
        mixed = F.regexp_count(v, F.lit(MEETS)) >= MIXED * F.length(v)
        return v.rlike("^[0-9A-Fa-f]+$") | mixed | (F.length(F.regexp_replace(v, WORDS, "")) >= OTHER * F.length(v))

    def spans_of(x: Column) -> Column:
        found = windows(x["v"], x["v"].rlike("^[0-9A-Fa-f]+$"))
        own = F.filter(found, lambda w: strange(F.substring(x["v"], w["s"] + 1, w["e"] - w["s"])))
        return F.transform(own, lambda w: F.struct((x["s"] + w["s"]).alias("s"), (x["s"] + w["e"]).alias("e")))

    return F.flatten(F.transform(F.filter(when_seen(text.rlike(f"[{RUN}]{{{WINDOW}}}"), cuts(text, CANDIDATE)), open_), spans_of))


def with_spans(documents: DataFrame) -> DataFrame:
    """Adds ``_text``, the base spans ``_assign``, ``_access``, ``_hex``, and ``_base`` and ``_spans``: sorted structs of start, kind number and end."""
    text = F.col("_text")
    found = (
        documents.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("_assign", when_seen(text.rlike(f"(?i){NAMES}"), cuts(text, ASSIGN)))
        .withColumn("_access", when_seen(text.contains("AKIA"), cuts(text, ACCESS)))
        .withColumn("_hex", when_seen(text.rlike("[0-9a-f]{24}"), cuts(text, HEX)))
        .withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 1)) >= 6))
        .withColumn("_entropy", dense_spans(text))
    )
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    base = F.concat(*[F.transform(F.col(f"_{kind}"), span(k)) for k, kind in enumerate(KINDS[:3])])
    added = F.transform(F.col("_entropy"), span(3))
    return found.withColumn("_base", F.array_sort(base)).withColumn("_spans", F.array_sort(F.concat(F.col("_base"), added)))


def joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def findings(documents: DataFrame) -> DataFrame:
    """A row for each span: doc_id, kind, start, end, and the value masked but for its first four characters."""
    rows = with_spans(documents.select("doc_id", "text")).select("doc_id", "_text", F.explode("_spans").alias("x"))
    value = F.substring("_text", F.col("x.s") + 1, F.col("x.e") - F.col("x.s"))
    masked = F.concat(F.substring(value, 1, 4), F.repeat(F.lit("*"), F.length(value) - 4))
    return rows.select("doc_id", F.get(F.array(*map(F.lit, KINDS)), F.col("x.k")).alias("kind"), F.col("x.s").alias("start"), F.col("x.e").alias("end"), masked.alias("masked"))


def find(documents: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    return with_spans(documents.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_spans").alias("spans"),
    )
