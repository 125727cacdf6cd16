"""Operator 9, personal data by candidate gradient boosting; DataFrame functions only.

Base spans follow fixed patterns (e-mail, IPv4, Luhn-valid card, international phone) and always
stay. High-recall generators propose more, overlapping spans: whatever stands around an ``@`` or a
bracketed "at", and every run of digits and number marks, the latter as ip, as card and as phone. Boosted
trees score the format and the context of each proposal.

They are trained on texts made in code (``made_texts``), where what is personal data is known by
construction and not by the base patterns: national phone numbers, cards with other separators and
addresses without a dot or with words for their marks, among dates, ranges, prices, order numbers,
coordinates, ISBNs and package names. Two thirds train; on the others one threshold is calibrated for
each kind, the lowest score (even odds at least) whose proposals above it are right in at least
``PRECISION`` of the cases, or none. The trees become CASE expressions. A proposal that a base pattern decides is left to it.

Positions count code points. They come from the lengths of the pieces between matches, so a text
is searched by the JVM's own functions; long runs cannot make the patterns backtrack, as each
pattern can start a match only where a run starts.

Defined results: null text counts as empty (and stays null in ``redact``); empty tables give no rows;
repeated rows are judged each; a null doc_id stays null; other columns are not read by ``find`` and
pass through ``redact``, whatever their names.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MADE_TEXTS, SEED = 6000, 9
TREES, DEPTH, RATE, PRECISION, LEAST_CASES = 40, 3, 0.3, 0.98, 20

WORD = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{WORD})){WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
JOIN = "\x01"  # stands for one space or hyphen between two digits
CARD = rf"(?<![0-9{JOIN}])[0-9](?:{JOIN}?[0-9]){{13,18}}(?![0-9{JOIN}])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
AROUND_AT = r"(?<![^\s@])[^\s@]++@[^\s@]++"
NUMBERS = r"[+(]?[0-9][0-9 ().-]*[0-9]"
AT_WORDS = rf"(?<!{WORD}){WORD}++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++"
CUES = {
    "cue_phone": r"(?i)\b(?:tel|telephone|phone|cell|call|fax|mobile|reach|ring|whatsapp)\b",
    "cue_mail": r"(?i)\b(?:e-?mail|mail|write|contact|address|reach)\b",
    "cue_card": r"(?i)\b(?:card|visa|mastercard|amex|pay|charge)\b",
    "cue_other": r"(?i)\b(?:order|isbn|invoice|version|page|price|room|row|year|on|in|from|item|no|part|code|since|install|total|at)\b",
}

#: Matches whose positions are summed one by one.
BLOCK = 128
SPANS = "array<struct<s:int,e:int,v:string>>"
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "digits", "length", "dots", "joins", "parens", "plus", "luhn", "octets",
    "letter_before", "letter_after", "mark_before", *CUES, "host_parts", "host_digits", "at_words", "longest_run", "shortest_run",
    "groups", "zero_first", "year_first",
)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def cuts(text: Column, pattern: str) -> Column:
    """Start, end and value of every match of ``pattern``, from the gaps between matches.

    Starts are running sums over blocks of ``BLOCK`` matches, so very many matches in one text
    cost little more than linear time.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    size = lambda x: x["g"] + F.length(x["v"])

    def spans(block, start):
        def step(acc, x):
            at = acc["at"] + x["g"]
            span = F.struct(at.alias("s"), (at + F.length(x["v"])).alias("e"), x["v"].alias("v"))
            return F.struct(span["e"].alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])

    def by_blocks(both):
        count = F.ceil(F.size(both) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(both, b * BLOCK + 1, BLOCK))
        total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda a, x: a + f(x))

        def placed(bs):
            sums = F.transform(bs, lambda b: total(b, size))
            starts = let(sums, lambda own: F.transform(own, lambda _, i: total(F.slice(own, 1, i), lambda x: x)))
            return F.flatten(F.zip_with(bs, starts, spans))

        return F.when(F.size(both) <= BLOCK, spans(both, F.lit(0))).otherwise(let(blocks, placed))

    both = let(found, lambda vs: F.zip_with(F.slice(gaps, 1, F.size(vs)), vs, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v"))))
    return let(both, by_blocks)


def when_seen(guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(SPANS))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string (not empty, under 20 digits) passes the Luhn check."""
    back = F.reverse(digits)

    def add(acc, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    short = (F.length(digits) > 0) & (F.length(digits) < 20)
    return F.when(short, F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def with_base(documents: DataFrame) -> DataFrame:
    """Adds ``_text`` and the base spans ``_email``, ``_ip``, ``_card``, ``_phone``."""
    text = F.col("_text")
    joined = F.regexp_replace(F.translate(text, JOIN, "\x02"), "(?<=[0-9])[ -](?=[0-9])", JOIN)
    count = lambda x: F.length(digits_of(x["v"]))
    return (
        documents.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        .withColumn("_email", when_seen(text.contains("@"), cuts(text, EMAIL)))
        .withColumn("_ip", when_seen(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), cuts(text, IP)))
        .withColumn("_card", when_seen(text.rlike("[0-9](?:[ -]?[0-9]){13}"), cuts(joined, CARD)))
        .withColumn("_phone", when_seen(text.rlike(r"\+[0-9]"), cuts(text, PHONE)))
        .withColumn("_ip", F.filter("_ip", lambda x: x["v"].rlike(OCTETS)))
        .withColumn("_card", F.filter("_card", lambda x: luhn(digits_of(x["v"]))))
        .withColumn("_phone", F.filter("_phone", lambda x: (count(x) >= 10) & (count(x) <= 15)))
    )


def with_proposals(found: DataFrame) -> DataFrame:
    """Adds ``_proposals``: kind, span and features of each proposal that no base pattern decides."""
    text = F.col("_text")
    around = F.concat(when_seen(text.contains("@"), cuts(text, AROUND_AT)), when_seen(text.rlike(r"[\[(]at[\])]"), cuts(text, AT_WORDS)))
    runs = F.filter(when_seen(text.rlike("[0-9][0-9 ().-]{5}"), cuts(text, NUMBERS)), lambda x: F.length(digits_of(x["v"])) >= 6)

    def describe(p):
        v, s, e = p["x"]["v"], p["x"]["s"], p["x"]["e"]
        d = digits_of(v)
        before = F.substring(text, F.greatest(s - 19, F.lit(1)), F.least(s, F.lit(20)))
        last, after = F.substring(before, -1, 1), F.substring(text, e + 1, F.lit(1))
        flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
        number = p["k"] > 0
        parts = F.filter(F.split(v, "[^0-9]+"), lambda r: r != "")
        host = F.substring_index(v, "@", -1)
        values = {
            **{f"is_{kind}": flag(p["k"] == k) for k, kind in enumerate(KINDS)},
            "digits": F.length(d),
            "length": F.length(v),
            "dots": F.length(v) - F.length(F.replace(v, F.lit("."), F.lit(""))),
            "joins": F.length(v) - F.length(F.regexp_replace(v, "[ -]", "")),
            "parens": F.length(v) - F.length(F.regexp_replace(v, "[()]", "")),
            "plus": flag(v.startswith("+")),
            "luhn": flag(number & luhn(d)),
            "octets": flag(number & v.rlike(OCTETS)),
            "letter_before": flag(last.rlike(r"[\p{L}\p{N}]")),
            "letter_after": flag(after.rlike(r"[\p{L}\p{N}]")),
            "mark_before": flag(last.rlike(r"[=\"'/#:]")),
            **{cue: flag(before.rlike(pattern)) for cue, pattern in CUES.items()},
            "host_parts": F.when(number, F.lit(0)).otherwise(F.size(F.split(host, r"\.")) - 1),
            "host_digits": F.when(number, F.lit(0)).otherwise(F.length(digits_of(host))),
            "at_words": flag(~number & ~v.contains("@")),
            "longest_run": F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)),
            "shortest_run": F.coalesce(F.array_min(F.transform(parts, F.length)), F.lit(0)),
            "groups": F.size(parts),
            "zero_first": flag(number & d.startswith("0")),
            "year_first": flag(number & d.rlike("^(?:19|20)[0-9]{2}")),
        }
        return F.struct(
            p["k"].alias("k"), s.alias("s"), e.alias("e"), *[values[f].cast("double").alias(f) for f in FEATURES]
        )

    def open_(x):
        """Whether no base pattern decides a run of digits."""
        v, d = x["v"], digits_of(x["v"])
        card = v.rlike(r"^[0-9](?:[ -]?[0-9]){13,18}$") & luhn(d)
        return ~(v.rlike(rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9.])") | v.startswith("+") & F.length(d).between(10, 15) | card)

    around = F.filter(around, lambda x: ~x["v"].rlike(EMAIL))
    marks = F.transform(around, lambda x: F.array(F.struct(F.lit(0).alias("k"), x.alias("x"))))
    numbers = F.transform(F.filter(runs, open_), lambda x: F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x")) for k in (1, 2, 3)]))
    return found.withColumn("_all", F.flatten(F.concat(marks, numbers))).withColumn("_proposals", F.transform("_all", describe))


class Boosted:
    """Sum of small trees over FEATURES (logit), and a threshold for each kind."""

    def __init__(self, trees: list, thresholds: dict[int, float], bias: float = 0.0):
        self.trees, self.thresholds, self.bias = trees, thresholds, bias

    def sql(self, name: str) -> str:
        def branch(node) -> str:
            if isinstance(node, float):
                return repr(node) + "D"
            f, cut, low, high = node
            return f"CASE WHEN {name}.{FEATURES[f]} < {cut!r}D THEN {branch(low)} ELSE {branch(high)} END"

        return " + ".join([repr(self.bias) + "D", *map(branch, self.trees)])

    def accepts(self, name: str) -> str:
        kinds = " ".join(f"WHEN {k} THEN {t!r}D" for k, t in self.thresholds.items())
        return f"({self.sql(name)}) >= CASE {name}.k {kinds} END" if kinds else "false"


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree by exact greedy splits on gradient and hessian sums; leaves of 0 gain stay leaves."""
    leaf = float(RATE * g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 10:
        return leaf
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        if len(values) > 33:
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)))
        for cut in ((values[1:] + values[:-1]) / 2).tolist():
            low = x[:, f] < cut
            gl, hl = g[low].sum(), h[low].sum()
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if gain > best[0]:
                best = (gain, f, cut)
    _, f, cut = best
    if f is None:
        return leaf
    low = x[:, f] < cut
    return (f, float(cut), grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


def score(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] < cut, score(low, x), score(high, x))


def train(x: np.ndarray, y: np.ndarray, kinds: np.ndarray) -> Boosted:
    """Boosts on two thirds of the rows, calibrates on the others (every third row)."""
    held = np.arange(len(x)) % 3 == 2
    own, gold = x[~held], y[~held].astype(float)
    if len(own) < LEAST_CASES or gold.min() == gold.max():
        return Boosted([], {})
    trees, f = [], np.zeros(len(own))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        trees.append(grow(own, gold - p, p * (1 - p), DEPTH))
        f += score(trees[-1], own)
    out = sum((score(t, x[held]) for t in trees), np.zeros(held.sum()))
    thresholds = {}
    for k in range(len(KINDS)):
        mine = kinds[held] == k
        s, right = out[mine], y[held][mine].astype(float)
        order = np.argsort(-s, kind="stable")
        s, share = s[order], np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        ends = np.flatnonzero(np.append(s[1:] != s[:-1], True)) if len(s) else np.zeros(0, int)
        good = [i for i in ends.tolist() if i + 1 >= LEAST_CASES and share[i] >= PRECISION]
        if good:
            thresholds[k] = max(0.0, float(s[max(good)]) - 1e-9)
    return Boosted(trees, thresholds)


def made_texts(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with their personal data (kind number, start, end); most lines hold none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(2, 9)))
    name = lambda: word() + r.choice(["", ".", "_", "-"]) + word()

    def card() -> str:
        body = digits(15)
        total = sum(int(c) if i % 2 else (2 * int(c) if int(c) < 5 else 2 * int(c) - 9) for i, c in enumerate(body))
        whole = body + str(-total % 10)
        return r.choice([".", "  ", " - ", ". "]).join(whole[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        area, first, last = "0" + r.choice("123456789") + digits(r.randint(1, 3)), digits(3), digits(r.randint(3, 5))
        return r.choice([
            f"{area} {first}{last}", f"{area}-{first}{last}", f"({area}) {first} {last}", f"({r.randint(201, 989)}) {first}-{digits(4)}",
            f"{r.randint(201, 989)}-{first}-{digits(4)}", f"{r.randint(201, 989)}.{first}.{digits(4)}", f"00{r.randint(30, 99)} {area[1:]} {first} {last}",
        ])

    def address() -> str:
        host = r.choice(["localhost", "intranet", "mailhub", word()])
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), (" (at) ", ".")])
        return r.choice([f"{name()}@{host}", f"{name()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"])

    said = {
        0: (address, ["mail", "e-mail", "write to", "contact", "mail me:", "address"]),
        2: (card, ["card", "visa", "charge my card", "pay with", "card number", "mastercard"]),
        3: (phone, ["call", "tel.", "phone", "fax", "mobile", "reach me on", "phone:", "telephone", "my cell phone is"]),
    }
    year, y, m = lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 12):02d}", lambda: f"{r.randint(1, 28):02d}"
    plain = [
        lambda: ("on", f"{year()}-{y()}-{m()}"), lambda: ("on", f"{m()}.{y()}.{year()}"), lambda: ("from", f"{year()}-{year()}"), lambda: ("in", f"{year()} - {year()}"),
        lambda: ("price", f"{digits(1)}.{digits(3)}.{digits(3)}"), lambda: ("isbn", f"978-{r.randint(0, 9)}-{digits(2)}-{digits(6)}-{digits(1)}"),
        lambda: ("order", digits(r.randint(6, 18))), lambda: ("invoice no.", f"{digits(4)}-{digits(4)}-{digits(4)}"), lambda: ("version", f"{digits(1)}.{digits(2)}.{digits(4)}"),
        lambda: ("at", f"{r.randint(10, 89)}.{digits(4)} {r.randint(10, 89)}.{digits(4)}"), lambda: ("row", " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(4, 9)))),
        lambda: ("item", f"{digits(3)}-{digits(3)}-{digits(4)}"), lambda: ("page", f"{digits(3)}-{digits(3)}"), lambda: ("total", f"{digits(3)} {digits(3)} {digits(3)}"),
        lambda: ("install", f"{word()}@{digits(1)}.{digits(1)}.{digits(2)}"), lambda: ("at", f"{word()}@{digits(3)}"), lambda: (word(), digits(r.randint(6, 18))),
        lambda: (word(), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"), lambda: (word(), f"{digits(3)}-{digits(3)}-{digits(4)}"), lambda: ("since", f"{year()}. {digits(2)}"),
    ]
    out = []
    for _ in range(n):
        text, held = "", []
        for _ in range(r.randint(1, 4)):
            text += " ".join(word() for _ in range(r.randint(2, 8))) + " "
            if r.random() < 0.4:
                kind = r.choice(list(said))
                value, cues = said[kind]
                if r.random() < 0.9:
                    text += r.choice(cues) + " "
                found = value()
                held.append((kind, len(text), len(text) + len(found)))
            else:
                cue, found = r.choice(plain)()
                text += cue + " "
            text += found + r.choice([" ", ", ", "\n", "; "])
        out.append((text, held))
    return out


@cache
def _trained(application: str, texts: int, seed: int) -> Boosted:
    spark = SparkSession.active()
    made = made_texts(texts, seed)
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    rows = with_proposals(with_base(table)).select("doc_id", F.explode("_proposals").alias("p"))
    rows = rows.select("doc_id", "p.k", "p.s", "p.e", *[F.col(f"p.{f}") for f in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(r)[:4])
    truth = [any(r["k"] == k and r["s"] < e and s < r["e"] and abs(r["s"] - s) + abs(r["e"] - e) <= 2 for k, s, e in made[r["doc_id"]][1]) for r in rows]
    values = np.array([tuple(r)[4:] for r in rows], float)
    return train(values, np.array(truth, float), np.array([r["k"] for r in rows]))


def fit(documents: DataFrame, texts: int = MADE_TEXTS, seed: int = SEED) -> Boosted:
    """Trees and thresholds from ``texts`` made texts; ``documents`` only names the session."""
    return _trained(documents.sparkSession.sparkContext.applicationId, texts, seed)


def with_spans(documents: DataFrame, model: Boosted) -> DataFrame:
    """Adds ``_base`` and ``_spans``: sorted structs of start, kind number and end."""
    found = with_proposals(with_base(documents)).drop("_all")
    span = lambda k: lambda x: F.struct(x["s"].alias("s"), k.alias("k"), x["e"].alias("e"))
    base = F.concat(*[F.transform(F.col(f"_{kind}"), span(F.lit(k))) for k, kind in enumerate(KINDS)])
    added = F.transform(F.expr(f"filter(_proposals, p -> {model.accepts('p')})"), lambda p: span(p["k"])(p))
    return found.withColumn("_base", F.array_sort(base)).withColumn(
        "_spans", F.array_sort(F.concat(F.col("_base"), added))
    )


def joined(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(
        ",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string")))
    )


def find(documents: DataFrame, model: Boosted) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    return with_spans(documents.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined("_base"), 256).alias("base_sha256"),
        joined("_spans").alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones made one, named after the first, in linear time.

    The furthest end up to each span comes from running maxima over blocks, so no array grows step by step.
    """
    top = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def running(block: Column, start: Column) -> Column:
        def step(acc, x):
            at = F.greatest(acc["at"], x["e"])
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), top["out"].alias("out")), step, lambda acc: acc["out"])

    def ends_of(blocks: Column) -> Column:
        tops = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["e"])))
        before = let(tops, lambda own: F.transform(own, lambda _, i: F.coalesce(F.array_max(F.slice(own, 1, i)), F.lit(0))))
        return F.flatten(F.zip_with(blocks, before, running))

    def heads_of(both: Column) -> Column:
        """Spans that start a new group, with the place of each."""
        spans, ends = both["spans"], both["ends"]
        marked = F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["k"].alias("k"), i.alias("i"), ((i == 0) | (F.get(ends, i - 1) <= x["s"])).alias("new")))
        heads = F.filter(marked, lambda x: x["new"])
        stops = let(heads, lambda h: F.concat(F.transform(F.slice(h, 2, F.size(h)), lambda x: x["i"] - 1), F.array(F.size(spans) - 1)))
        return F.zip_with(heads, stops, lambda h, i: F.struct(h["s"].alias("s"), h["k"].alias("k"), F.get(ends, i).alias("e")))

    blocks = let(F.ceil(F.size(spans) / F.lit(BLOCK)).cast("int"), lambda n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(spans, b * BLOCK + 1, BLOCK)))
    whole = let(F.struct(spans.alias("spans"), let(blocks, ends_of).alias("ends")), heads_of)
    return F.when(F.size(spans) > 0, whole).otherwise(F.filter(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))), lambda x: F.lit(False)))


def redact(documents: DataFrame, model: Boosted) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets; ``n_chars`` follows the text.

    Overlapping spans become one, named after the first of them. A null text stays null. The rows travel
    as one struct, so no column name of theirs can meet one of this operator. The text is cut into a piece
    for each ``BLOCK`` spans first, so that very many spans cost little more than linear time.
    """
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("_row"), documents["text"].alias("text"))
    found = with_spans(rows, model).withColumn("_merged", _merged(F.col("_spans")))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(block: Column, start: Column, text: Column) -> Column:
        """The spans of a block replaced in its part of the text, which begins at ``start``."""
        ends = F.concat(F.array(start), F.transform(block, lambda x: x["e"]))
        made = F.zip_with(block, F.slice(ends, 1, F.size(block)), lambda x, at: F.concat(F.substring(text, at - start + 1, x["s"] - at), F.get(kinds, x["k"])))
        return F.array_join(made, "")

    def blocks_of(spans: Column) -> Column:
        n = F.ceil(F.size(spans) / F.lit(BLOCK)).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(spans, b * BLOCK + 1, BLOCK))

    def replaced(blocks: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(blocks, lambda b: F.element_at(b, -1)["e"]))
        cut = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda b, at: F.struct(b.alias("b"), at.alias("at"), F.substring(F.col("_text"), at + 1, F.element_at(b, -1)["e"] - at).alias("t")))
        made = F.transform(cut, lambda x: piece(x["b"], x["at"], x["t"]))
        return F.concat(F.array_join(made, ""), F.substring(F.col("_text"), F.element_at(starts, -1) + 1, F.length("_text")))

    text = F.when(F.size("_merged") > 0, let(let(F.col("_merged"), blocks_of), replaced)).otherwise(F.col("text"))
    out = found.select("_row", text.alias("_new"), (F.size("_merged") > 0).alias("_changed"))
    own = {"text": F.col("_new")}
    if "n_chars" in documents.columns:
        own["n_chars"] = F.when(F.col("_changed"), F.length("_new")).otherwise(F.col("_row.n_chars")).cast(documents.schema["n_chars"].dataType)
    return out.select([own.get(c, F.col("_row")[c]).alias(c) for c in documents.columns])
