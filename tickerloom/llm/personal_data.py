"""Personal data in texts: base patterns, high-recall generators, boosted trees over format and context, calibrated thresholds.

DataFrame and SQL functions only.  Matches are found inside the document's own row: the text is split at a pattern's matches, and the
lengths of the parts give the places.  Base spans always stand.  The other proposals are scored by gradient-boosted trees that learn from
the corpus itself (base matches that pass or fail their kind's check) and from the marked examples below; a generator's threshold is the
lowest score whose held-out precision is high enough.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.collections import with_once
from tickerloom.session import materialize

#: Kinds in the order of results; the first four are the base kinds.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
# Base patterns as the contract gives them, in a form that reads a text once: a match starts where a run of its characters
# starts (or where the last match ended), and runs are not given back.  A card's run is taken only with 13 to 19 digits.
_MAIL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Generators: (name, kind, what a text must hold for a match, pattern).  The first four are the base.
GENERATORS = [
    ("email", "email", "@", rf"(?:\G|(?<!{_MAIL})){_MAIL}++@{_LABEL}++(?:\.{_LABEL}++)++"),
    ("ip", "ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "card", "[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"),
    ("phone", "phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email_spoken", "email", r"(?i)@|[(\[{ ]at[)\]} ]", rf"(?i)(?<!{_MAIL}){_MAIL}++ ?(?:@|\(at\)|\[at\]|\{{at\}}| at ) ?{_LABEL}++(?: ?(?:\(dot\)|\[dot\]|\{{dot\}}| dot |\.) ?{_LABEL}++)++"),
    ("ip_v6", "ip", "[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("card_part", "card", "[0-9]{4}", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    ("phone_local", "phone", "[0-9]{3}", r"(?<![0-9A-Za-z.+-])(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|00[0-9][0-9 ().-]{7,18}[0-9]|0[0-9]{1,4}[ /.-][0-9]{3,4}[ .-]?[0-9]{3,5})(?![0-9A-Za-z-])"),
    ("iban", "iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", "ssn", "[0-9]{3}-[0-9]{2}-", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
]
BASE = 4
#: Code points of context on either side, up to the next proposal of the same generator.
CONTEXT = 24
#: Words shortly before a span that speak for a kind, and against personal data at all.
CUES = {
    "email": "mail|courriel|correo|contact|kontakt|write to|reach|reply",
    "ip": "ip|host|server|client|from|address|addr|peer",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|pay",
    "phone": "call|phone|tel|mobile|cell|fax|whatsapp|text me|sms|rufen|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
    "ssn": "ssn|social|security|taxpayer",
    "against": "version|page|pages|order|invoice|isbn|issue|figure|release|build|token|hash|key|serial|part|ticket|look|meet|arrive|stay",
}
#: Marked examples, «span», for generators without a base rule: these name a person.
NAMING = """
email_spoken: please write to «jane.doe (at) example (dot) org» soon
email_spoken: my mail is «j_smith at example dot com»
email_spoken: contact «help[at]example[dot]net» for this
email_spoken: correo: «maria {at} ejemplo {dot} es»
email_spoken: Kontakt «h.meier(at)beispiel.de»
email_spoken: reach me under «kim @ example . com»
ip_v6: the client ip «2001:0db8:0000:0000:0000:ff00:0042:8329» came
ip_v6: host «fe80:0:0:0:0:0:0:1» answered
ip_v6: seen from address «2001:db8:1:2:3:4:5:6»
card_part: pay by card «4111 1111 1111 1111»
card_part: visa «4012888888881881» expires soon
card_part: credit card no. «3714 496353 98431»
card_part: karte: «5555-5555-5555-4444»
phone_local: call me at «(555) 867-5309» tonight
phone_local: tel. «030/9018 2000»
phone_local: phone: «555-234-5678»
phone_local: mobile «0049 170 1234567»
phone_local: fax «555.234.9876» please
iban: my iban is «DE89 3704 0044 0532 0130 00»
iban: bank account «GB29NWBK60161331926819»
iban: transfer to «FR14 2004 1010 0505 0001 3M02 606»
ssn: ssn «536-90-4399» on file
ssn: social security number «219-09-9998»
ssn: her taxpayer id «457-55-5462»
"""
#: ... and these don't.
PLAIN = """
email_spoken: have a look «at at example.com» for more
email_spoken: we will «meet at home.Then» we go
email_spoken: they «arrive at noon.After» that
email_spoken: you can «stay at hotel.In» town
email_spoken: come and «look at this.It» is new
ip_v6: build hash «12:34:56:78:9a:bc:de:f0» done
ip_v6: serial «0:0:0:0:0:0:0:0» unset
card_part: order «1234567890123» shipped
card_part: tracking part «9400 1000 0000 0001» sent
card_part: token=«1234567812345678» x
card_part: isbn «9780306406158» sold
phone_local: invoice «123 456 7890» due
phone_local: see pages «100-200-3000»
phone_local: order «000-000-0000» void
phone_local: part «012-3456-789» out of stock
phone_local: version «555.123.4567» is out
iban: release «AB12 CDEF 3456» of the key
iban: serial «XK99ABCD1234EFGH5678»
iban: part «GB00 1234 ABCD 5678 90» missing
ssn: order «000-12-3456» shipped
ssn: part «666-45-6789» ticket
ssn: invoice «912-34-5678» paid
ssn: pages «123-00-4567»
"""
#: The model: trees, their depth, and the precision that a threshold must reach on held-out rows.
TREES, DEPTH, PRECISION = 20, 4, 0.95
FEATURES = [
    "f_gen", "f_check", "f_length", "f_digits", "f_letters", "f_blanks", "f_marks", "f_dots", "f_first", "f_last", "f_before", "f_after",
    *[f"f_{c}" for c in CUES],
]
_CHUNK = 256


def _no_spans(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _with_matches(df: DataFrame, text: str) -> DataFrame:
    """Add s0, s1, ...: for each generator its matches, structs of start, end, span, before and after, in order of the text.

    Each step takes time in proportion to the text: places are sums within chunks of matches, and over chunks.
    """
    n = range(len(GENERATORS))
    holds = [F.col(text).rlike(g[2]) for g in GENERATORS]
    df = with_once(df, **{f"t{k}": F.when(holds[k], F.col(text)) for k in n})
    df = with_once(
        df, **{f"h{k}": F.coalesce(F.regexp_extract_all(f"t{k}", F.lit(GENERATORS[k][3]), F.lit(0)), _no_spans("string")) for k in n},
        **{f"p{k}": F.split(f"t{k}", GENERATORS[k][3], -1) for k in n},
    )

    def sums(k: int) -> Column:
        steps = F.transform(f"h{k}", lambda h, i: F.length(F.get(F.col(f"p{k}"), i)).cast("long") + F.length(h))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(f"h{k}") - 1) / _CHUNK).cast("int")), lambda c: F.slice(steps, c * _CHUNK + 1, _CHUNK))
        some = F.transform(chunks, lambda c: F.aggregate(c, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)))
        return F.when(F.size(f"h{k}") > 0, some).otherwise(_no_spans("array<bigint>"))

    df = with_once(df, **{f"i{k}": sums(k) for k in n})
    df = with_once(df, **{f"c{k}": F.aggregate(f"i{k}", F.array(F.lit(0).cast("long")), lambda a, c: F.array_append(a, F.element_at(a, -1) + F.element_at(c, -1))) for k in n})

    def spans(k: int) -> Column:
        def one(h: Column, i: Column) -> Column:
            chunk = F.floor(i / _CHUNK).cast("int")
            gap, rest = F.get(F.col(f"p{k}"), i), F.get(F.col(f"p{k}"), i + 1)
            start = F.get(F.col(f"c{k}"), chunk) + F.get(F.get(F.col(f"i{k}"), chunk), i % _CHUNK) + F.length(gap)
            return F.struct(
                start.alias("start"), (start + F.length(h)).alias("end"), h.alias("span"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(rest, F.lit(CONTEXT)).alias("after")
            )

        return F.transform(f"h{k}", one)

    return with_once(df, **{f"s{k}": spans(k) for k in n}).drop(*[f"{x}{k}" for k in n for x in "thpic"])


def _luhn(digits: Column) -> Column:
    """A number of 13 to 19 digits whose Luhn sum is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def _iban(span: Column) -> Column:
    """The ISO 7064 remainder of a bank account number is 1."""
    plain = F.replace(span, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    total = F.aggregate(
        F.split(turned, "(?!^)(?=.)"), F.lit(0).cast("long"),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return total == 1


def passes(gen: int, span: Column) -> Column:
    """The check of a generator's kind on a match."""
    name = GENERATORS[gen][0]
    digits = F.regexp_replace(span, "[^0-9]", "")
    if name == "ip":
        return span.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$")
    if name in ("card", "card_part"):
        return _luhn(digits)
    if name in ("phone", "phone_local"):
        plausible = F.length(digits).between(9, 15)
        return plausible if name == "phone" else plausible & ~digits.rlike(r"^(?:000|(\d)\1*$)")
    if name == "email_spoken":
        return span.rlike(r"(?i)(?:[a-z]{2,})$") & ~span.rlike(r"\.[A-Z][a-z]*$")
    if name == "ip_v6":
        return ~span.rlike("^[0:]+$")
    if name == "iban":
        return _iban(span)
    if name == "ssn":
        return ~span.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def with_features(proposals: DataFrame) -> DataFrame:
    """Small whole numbers that describe the format and context of proposals (gen, span, before, after)."""
    def of(c: str) -> Column:  # noqa: E306
        return F.when(F.col(c) == "", 0).when(F.col(c).rlike(r"^\s$"), 1).when(F.col(c).rlike("^[A-Za-z]$"), 2).when(F.col(c).rlike("^[0-9]$"), 3).when(F.col(c).isin('"', "'", "=", "/", "#", "_"), 4).otherwise(5)

    def count(pattern: str, most: int) -> Column:
        return F.least(F.regexp_count("span", F.lit(pattern)), F.lit(most))

    check = F.lit(None).cast("boolean")
    for k in range(len(GENERATORS)):
        check = F.when(F.col("gen") == k, passes(k, F.col("span"))).otherwise(check)
    edges = {"one_before": F.right("before", F.lit(1)), "one_after": F.left("after", F.lit(1)), "one_first": F.left("span", F.lit(1)), "one_last": F.right("span", F.lit(1))}
    df = proposals.withColumns(edges | {"said": F.lower("before")})
    values = {
        "f_gen": F.col("gen"), "f_check": F.coalesce(check, F.lit(False)).cast("int"), "f_length": F.least(F.length("span"), F.lit(40)),
        "f_digits": count("[0-9]", 24), "f_letters": count("[A-Za-z]", 32), "f_blanks": count(" ", 8), "f_marks": count(r"[-()\[\]{}/:+@]", 12), "f_dots": count(r"\.", 6),
        "f_first": of("one_first"), "f_last": of("one_last"), "f_before": of("one_before"), "f_after": of("one_after"),
    } | {f"f_{c}": F.col("said").rlike(rf"(?<![a-z])(?:{words})").cast("int") for c, words in CUES.items()}
    return df.withColumns(values).drop(*edges, "said")


def example_rows() -> list[tuple[int, str, str, str, int]]:
    """(gen, span, before, after, label) of the marked examples."""
    names = [g[0] for g in GENERATORS]
    rows = []
    for label, lines in ((1, NAMING), (0, PLAIN)):
        for line in lines.strip().splitlines():
            name, text = line.split(": ", 1)
            before, span, after = re.fullmatch(r"(.*)«(.*)»(.*)", text).groups()
            rows.append((names.index(name), span, before[-CONTEXT:], after[:CONTEXT], label))
    return rows


class Model:
    """Boosted trees and a threshold for each generator."""

    def __init__(self, spark: SparkSession, counted: DataFrame):
        """``counted``: distinct features with label, held (boolean) and n, from the corpus."""
        rows = example_rows()
        given = with_features(spark.createDataFrame(rows, "gen int, span string, before string, after string, label int"))
        given = given.select(*FEATURES, "label", F.lit(1).cast("long").alias("n"))
        # The few examples serve both for fitting and for thresholds; of the corpus a fifth is held out.
        given = given.withColumn("held", F.lit(False)).unionByName(given.withColumn("held", F.lit(True)))
        together = counted.select(*FEATURES, "label", "n", "held").unionByName(given)
        # Every generator and label weighs the same, however common.
        even = Window.partitionBy("f_gen", "label", "held")
        together = together.withColumn("weight", 100.0 * F.col("n") / F.sum("n").over(even)).withColumn("y", F.col("label").cast("double"))
        # Rows are distinct features, few however large the corpus; two tasks read them.
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(materialize(together, "personal-patterns").coalesce(2))
        trees = GBTClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=11)
        self.fitted = trees.fit(assembled.where("NOT held").orderBy(*FEATURES, "label").coalesce(1))
        at = self._scored(assembled.where("held")).groupBy("f_gen", F.round("score", 4).alias("score")).agg(
            F.sum(F.col("weight") * F.col("y")).alias("good"), F.sum("weight").alias("all")
        )
        down = Window.partitionBy("f_gen").orderBy(F.desc("score"))
        fine = at.withColumn("precision", F.sum("good").over(down) / F.sum("all").over(down)).where(F.col("precision") >= PRECISION)
        self.thresholds = {r[0]: r[1] for r in fine.groupBy("f_gen").agg(F.min("score")).collect()}  # a row for each generator

    def _scored(self, assembled: DataFrame) -> DataFrame:
        return self.fitted.transform(assembled).withColumn("score", vector_to_array("probability")[1])

    def accepted(self, featured: DataFrame) -> DataFrame:
        """Rows with a score that reaches their generator's threshold."""
        least = F.lit(None).cast("double")
        for gen, t in self.thresholds.items():
            least = F.when(F.col("gen") == gen, F.lit(t)).otherwise(least)
        return self._scored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(featured)).where(F.round("score", 4) >= least)


def _joined(spans: Column) -> Column:
    """kind:start:end by kind, then start, of an array of structs (rank, start, end)."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with its spans, structs (rank, start, end), replaced by their kind in angle brackets; of overlapping ones the first."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["rank"].alias("rank"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), _no_spans("string").alias("out"))

    def step(a: Column, s: Column) -> Column:
        more = F.array_append(F.array_append(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int"))), F.get(names, s["rank"]))
        return F.when(s["start"] < a["at"], a).otherwise(F.struct((-s["far"]).alias("at"), more.alias("out")))

    return F.aggregate(by_start, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"].cast("int") + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and redacted text of every document; rows as in ``find``, a null text stays null."""
    return _found(docs, keep=True).select("doc_id", redacted(F.col("text"), F.concat("base", "added")).alias("text"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document.

    ``spans`` has all base spans and the accepted proposals that overlap neither a base span nor an earlier one.  Null and empty texts
    have none; null ids and repeated rows give a row each; an empty table gives none (and the model learns from the examples alone);
    other columns are not read.  Texts of any length are scanned whole; a document's spans meet in one row.
    """
    return _found(docs).select(
        "doc_id", *[f"n_{KINDS[k]}" for k in range(BASE)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def _found(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, counts, arrays of base and added spans, and with ``keep`` the text, of every document."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text, F.lit("")).alias("given"))
    kept = ["text"] if keep else []
    found = _with_matches(rows, "given").drop("given", *({"text"} - {*kept}))
    def checked(k: int, good: bool) -> Column:
        return F.filter(f"s{k}", lambda s: passes(k, s["span"]) == F.lit(good))

    found = with_once(found, **{f"b{k}": checked(k, True) for k in range(BASE)})
    found = materialize(found.withColumns({f"s{k}": checked(k, False) for k in range(BASE)}).withColumn("rid", F.monotonically_increasing_id()), "personal-matches")

    def proposals(columns: dict[str, int], label: int | None) -> DataFrame:
        def named(column: str, gen: int) -> Column:
            return F.transform(column, lambda s: F.struct(F.lit(gen).alias("gen"), *[s[c].alias(c) for c in ("start", "end", "span", "before", "after")]))

        every = F.flatten(F.array(*[named(c, g) for c, g in columns.items()]))
        held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
        out = found.select("rid", held.alias("held"), F.explode(every).alias("p")).select("rid", "held", "p.*")
        return with_features(out).withColumn("label", F.lit(label).cast("int"))

    known = proposals({f"b{k}": k for k in range(BASE)}, 1).unionByName(proposals({f"s{k}": k for k in range(BASE)}, 0))
    model = Model(spark, materialize(known.groupBy(*FEATURES, "label", "held").agg(F.count("*").alias("n")), "personal-labels"))
    rank = {k: KINDS.index(GENERATORS[k][1]) for k in range(len(GENERATORS))}
    ranks = F.get(F.array(*[F.lit(rank[k]) for k in range(len(GENERATORS))]), F.col("gen"))
    taken = model.accepted(proposals({f"s{k}": k for k in range(len(GENERATORS))}, None)).select("rid", ranks.alias("rank"), "start", "end", F.lit(0).alias("base"))
    taken = materialize(taken, "personal-accepted")

    def plain(k: int) -> Column:
        return F.transform(f"b{k}", lambda s: F.struct(F.lit(k).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))

    base_spans = F.flatten(F.array(*[plain(k) for k in range(BASE)]))
    # Proposals beside base spans of their document: in order of the text, none may reach into a base span or an earlier proposal.
    beside = found.select("rid", F.explode(base_spans).alias("p")).select("rid", "p.*", F.lit(1).alias("base")).join(taken.select("rid").distinct(), "rid", "left_semi")
    row = Window.partitionBy("rid").orderBy("start", F.desc("base"), F.desc("end"), "rank")
    past, ahead = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(1, Window.unboundedFollowing)
    free = taken.unionByName(beside).select(
        "*", F.max("end").over(past).alias("reached"), F.min(F.when(F.col("base") == 1, F.col("start"))).over(ahead).alias("next")
    ).where("base = 0 AND (reached IS NULL OR reached <= start) AND (next IS NULL OR next >= end)")
    added = free.groupBy("rid").agg(F.collect_list(F.struct("rank", "start", "end")).alias("added"))
    none = _no_spans("struct<rank:int,start:bigint,end:bigint>")
    counts = [F.size(f"b{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE)]
    whole = found.select("rid", "doc_id", *kept, base_spans.alias("base"), *counts).join(added, "rid", "left")
    return whole.withColumn("added", F.coalesce("added", none))
