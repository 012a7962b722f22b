"""Personal data in documents, by Spark's own expressions only.

Method.  Regular expressions propose spans; validators confirm them (Luhn for
cards, mod-97 for international bank account numbers, ranges for addresses and US
social security numbers, digit counts for telephones); words near a span, before or
after it, raise its score, and an added span without the score it needs goes.

A text is split by a pattern, and the pieces' lengths give each match's place in
code points, so nothing leaves the JVM.  A pattern runs only on texts that hold a
character it needs.  All loops over groups are possessive or are replaced by loops
over a character class, which Java runs without recursion, so very long texts do
not overflow the stack; a look-behind keeps a long run of candidate characters
from being tried at each of its places.  One pass, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
#: Three, two and four digits that stand alone; no number has 000, 666 or 9 at its begin, 00 or 0000.
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
#: One separator between two digits becomes this private character, any such in the text another.
_JOIN, _OTHER = "", ""
CARD = rf"[0-9{_JOIN}]{{2,}}+"
#: Words that make a span of a kind more likely when they stand within CONTEXT characters of it.
CONTEXT = 48
WORDS = {
    "email": "e-?mail|contact|mailto|write to|correo|courriel",
    "ip": "ip|address|host|server|client|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "iban": "iban|account|bank|konto|compte|cuenta|swift|bic",
    "ssn": "ssn|social security|social|taxpayer|tin|itin",
}
#: Score of a confirmed span in percent; a context word raises it to the middle between itself and 100.
PRIOR = {"email": 90, "ip": 60, "card": 80, "phone": 50, "iban": 90, "ssn": 40}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÉ", "abcdefghijklmnopqrstuvwxyzé"


def _matches(text: Column, pattern: str) -> Column:
    """Matches as (start, end, value) in code points: from the pieces between them."""
    pieces = F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(F.slice(pieces, 1, F.greatest(F.size(values), F.lit(0))).alias("piece"), values.alias("value"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["piece"])
        end = begin + F.char_length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    # In groups of 256, or a text of very many matches would be copied at each of them.
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(pairs) / 256).cast("int")), lambda g: F.aggregate(F.slice(pairs, g * 256 + 1, F.lit(256)), start, step))
    shifted = lambda acc, x: F.transform(x["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["value"].alias("value")))
    return F.aggregate(groups, start, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], shifted(acc, x)).alias("out")), lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<start:long,end:long,value:string>>")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)))
    doubled = F.transform(places, lambda i: F.substring(F.reverse(digits), i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces passes the mod-97 check."""
    turned = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 4))
    code = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55))
    rest = F.aggregate(code, F.lit(0), lambda a, x: F.when(x.isNull(), a).when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))
    return rest == 1


def _joined(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _JOIN, _OTHER), "(?<=[0-9])[ -](?=[0-9])", _JOIN)


def _parts_ok(value: Column) -> Column:
    return F.forall(F.split(value, "[.]"), lambda p: F.char_length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed spans of each kind in a text column that is not null."""
    number = text.rlike("[0-9]")
    n = lambda x: F.char_length(_digits(x["value"]))
    return {
        "email": F.when(text.contains("@"), _matches(text, EMAIL)).otherwise(_none()),
        "ip": F.when(number & text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(text, IP), lambda x: _parts_ok(x["value"]))).otherwise(_none()),
        "card": F.when(number & text.rlike("(?:[0-9][ -]?){12}[0-9]"), F.filter(_matches(_joined(text), CARD), lambda x: F.when(n(x).between(13, 19), luhn(_digits(x["value"]))).otherwise(False))).otherwise(_none()),
        "phone": F.when(text.contains("+"), F.filter(_matches(text, PHONE), lambda x: n(x).between(9, 15))).otherwise(_none()),
        "ssn": F.when(number & text.rlike("[0-9]-[0-9]{2}-[0-9]"), _matches(text, SSN)).otherwise(_none()),
        "iban": F.when(number & text.rlike("(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}"), F.filter(_matches(text, IBAN), lambda x: mod97(F.replace(x["value"], F.lit(" "), F.lit(""))))).otherwise(_none()),
    }


def find_personal_data(docs: DataFrame, least_score: float = 0.5, with_text: bool = True) -> DataFrame:
    """Personal data in every whole text.

    ``docs`` has ``doc_id`` and ``text``.  Spans are in code points, end
    exclusive.  ``email``, ``ip``, ``card`` and ``phone`` are the base kinds;
    ``iban`` and ``ssn`` spans come on top and never replace one.  A span's score is
    its kind's prior, raised to the middle between itself and 1 by a context word
    that stands within ``CONTEXT`` characters before or after it; added spans below
    ``least_score`` go, base spans stay.  Returns per row doc_id, n_email, n_ip,
    n_card, n_phone, base_sha256 (base spans as kind:start:end by kind as listed, then
    start, comma-joined), spans (all, joined likewise), scores (theirs in percent, in
    the same order), found (kind, start, end, score), and with ``with_text``
    clean_text, where the found values are masked by their kind.

    Nulls: a null text is the empty text, and stays null in clean_text; a null id
    stays null.  Empty texts have no spans.  Very long texts are searched whole.  Ties
    and repeats: of base and added spans that overlap the base one counts (a card
    excepted, which can be part of an account number); rows that repeat an id are
    judged each for itself.  No documents give no rows.  Other columns, whatever their
    names, are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("original"))
    rows = rows.withColumn("text", F.coalesce("original", F.lit("")))
    rows = rows.withColumns({f"m_{k}": v for k, v in proposals(F.col("text")).items()})

    def scored(kind: str) -> Column:
        low = lambda at, n: F.translate(F.substring(F.col("text"), at.cast("int"), n.cast("int")), _UPPER, _LOWER)
        told = lambda part: part.rlike(rf"(?<![a-z])(?:{WORDS[kind]})(?![a-z])")
        near = lambda x: told(low(F.greatest(x["start"] - CONTEXT + 1, F.lit(1)), F.least(x["start"], F.lit(CONTEXT)))) | told(low(x["end"] + 1, F.lit(CONTEXT)))
        score = lambda x: F.when(near(x), (100 + PRIOR[kind]) // 2).otherwise(PRIOR[kind]) / 100
        return F.transform(F.col(f"m_{kind}"), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))

    rows = rows.withColumn("base", F.concat(*(scored(k) for k in KINDS[:4])))
    free = lambda x: ~F.exists(F.filter("base", lambda b: b["kind"] != "card"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    extra = F.filter(F.concat(*(scored(k) for k in KINDS[4:])), lambda x: (x["score"] >= least_score) & free(x))
    rows = rows.withColumn("found", F.concat("base", extra))
    named = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = rows.select("doc_id", *(F.size(f"m_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(named("base"), 256).alias("base_sha256"), named("found").alias("spans"), F.array_join(F.transform("found", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",").alias("scores"), "found", *(["original"] if with_text else []))
    return out.withColumn("clean_text", _masked(F.col("original"), F.col("found"))).drop("original") if with_text else out


def _masked(text: Column, found: Column) -> Column:
    """The text with each found span, the earlier and then longer first, replaced by its kind."""
    spans = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["kind"].alias("k"))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    step = lambda acc, x: F.when(x["s"] >= acc["at"], F.struct((-x["e"]).alias("at"), F.concat(acc["out"], cut(acc["at"], x["s"]), F.lit("["), F.upper(x["k"]), F.lit("]")).alias("out"))).otherwise(F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), acc["out"].alias("out")))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], cut(acc["at"], F.char_length(text).cast("long"))))
