"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Offsets come from splitting a text at the matches of a pattern: the gaps
and the matches alternate, so their running lengths are the code-point offsets. The patterns are
linear in the text: possessive runs, and starts only at the head of a run or the end of the last
match, which finds the same leftmost matches as the plain forms. Spans are gathered in chunks, as
appending to an array copies it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import whole_text

# The contract's patterns, in possessive form.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposes the longest run from each possible start; starts may lie in one another's runs.
IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]*+))"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A long run of letters and digits: a key or token, if what is around it says so.
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,}+"
#: Characters of an IBAN by country, as registered; other codes have no fixed length.
IBAN_LENGTHS = dict(x.split(":") for x in "NO:15 BE:16 BI:27 DK:18 FO:18 FI:18 FK:18 GL:18 NL:18 SD:18 MK:19 SI:19 AT:20 BA:20 EE:20 KZ:20 LT:20 LU:20 MN:20 XK:20 CH:21 HR:21 LI:21 LV:21 BG:22 BH:22 CR:22 DE:22 GB:22 GE:22 IE:22 ME:22 RS:22 VA:22 AE:23 GI:23 IL:23 IQ:23 OM:23 SO:23 TL:23 AD:24 CZ:24 ES:24 MD:24 PK:24 RO:24 SA:24 SE:24 SK:24 TN:24 VG:24 LY:25 PT:25 ST:25 IS:26 TR:26 DJ:27 FR:27 GR:27 IT:27 MC:27 MR:27 SM:27 AL:28 AZ:28 BY:28 CY:28 DO:28 GT:28 HN:28 HU:28 LB:28 NI:28 PL:28 SV:28 BR:29 EG:29 PS:29 QA:29 UA:29 JO:30 KW:30 MU:30 YE:30 MT:31 SC:31 LC:32 RU:33".split())
#: Each part at most 255, leading zeros allowed.
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"


SPAN = "struct<start:bigint,finish:bigint,value:string,around:string>"
#: Spans that are gathered one by one.
CHUNK = 256
#: Code points on either side in which context words count; beyond the neighbouring match and the
#: text next to that none do.
CONTEXT = 40


def luhn(match: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(F.translate(match, " -", ""))
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + twice
    n = F.length(digits)
    return F.when(n.between(16, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def mod97(match: Column) -> Column:
    """ISO 7064: country and check digits to the end, letters as 10 to 35, remainder 1."""
    compact = F.translate(match, " ", "")
    turned = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))
    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97
    n = F.length(compact)
    return F.when(n.between(15, 34), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) == 1).otherwise(False)


def _iban_end(run: Column) -> Column:
    """The run up to the blank, or its end, where a registered length and mod-97 hold; for codes without
    a length the last end with mod-97. Empty where none does."""
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    registered = F.try_element_at(lengths, F.substring(run, 1, 2))

    def end(acc: Column, word: Column) -> Column:
        upto = F.when(acc["upto"] == "", word).otherwise(F.concat(acc["upto"], F.lit(" "), word))
        fits = F.coalesce(F.length(F.translate(upto, " ", "")) == registered.cast("int"), F.lit(True))
        return F.struct(upto.alias("upto"), F.when(fits & upto.rlike("^[A-Z0-9 ]+$") & mod97(upto), upto).otherwise(acc["best"]).alias("best"))

    return F.aggregate(F.split(run, " "), F.struct(F.lit("").alias("upto"), F.lit("").alias("best")), end, lambda acc: acc["best"])


def _ibans(text: Column) -> Column:
    """array<struct<start, finish, value>> of the confirmed IBANs, from left to right without overlap."""
    # a line break before the text keeps the first piece where a run begins at once
    pieces = F.split(F.concat(F.lit("\n"), text), IBAN, -1)
    runs = F.regexp_extract_all(text, F.lit(IBAN), F.lit(1))
    # a run is looked at, not taken: the piece after it begins with it
    beside = lambda p: F.transform(p["runs"], lambda r, i: F.struct(r.alias("run"), F.length(p["pieces"][i]).alias("gap"), F.right(p["pieces"][i], F.lit(CONTEXT)).alias("before"), F.substring(p["pieces"][i + 1], 1, CONTEXT + 40).alias("after")))
    gaps = _let(F.struct(pieces.alias("pieces"), runs.alias("runs")), beside)

    def place(state: Column, x: Column) -> tuple[Column, Column]:
        at = state["at"] + x["gap"]
        value = _iban_end(x["run"])
        finish = at + F.length(value)
        good = (value != "") & (at >= state["free"])
        around = F.concat(x["before"], F.lit(" "), F.substring(x["after"], F.length(value) + 1, F.lit(CONTEXT)))
        span = F.struct(at.alias("start"), finish.alias("finish"), value.alias("value"), around.alias("around"))
        return F.struct(at.alias("at"), F.when(good, finish).otherwise(state["free"]).alias("free")), F.when(good, F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

    return _gather(gaps, F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("free")), place)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body, or a loop in it, uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _gather(items: Column, state: Column, step) -> Column:
    """array<struct<start, finish, value>>: ``step(state, item)`` gives the state and the spans that it
    adds (an array of none or one). A chunk's spans are appended one by one, chunks as wholes, so each
    span is copied some ``CHUNK`` times at most, and once for every chunk after its own as a reference."""
    none = F.array().cast(f"array<{SPAN}>")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(x) - 1) / CHUNK).cast("int"), F.lit(0))), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK)))
    chunks = _let(items, cut)

    def inside(acc: Column, item: Column) -> Column:
        after, spans = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["spans"], spans).alias("spans"))

    def outside(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["state"].alias("state"), none.alias("spans")), inside)
        return F.struct(done["state"].alias("state"), F.concat(acc["chunks"], F.array(done["spans"])).alias("chunks"))

    start = F.struct(state.alias("state"), F.array().cast(f"array<array<{SPAN}>>").alias("chunks"))
    return F.aggregate(chunks, start, outside, lambda acc: F.flatten(acc["chunks"]))


def _digits_between(low: int, high: int):
    return lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(low, high)


@dataclass(frozen=True)
class Kind:
    """base: part of the contract's base spans, kept whatever the score. score: before context;
    needs: a character without which a text can't match; words: context that adds 0.3."""

    name: str
    pattern: str
    valid: object
    base: bool
    score: float
    needs: str
    words: str


KINDS = (
    Kind("email", EMAIL, lambda m: F.lit(True), True, 0.9, "@", r"(?i)mail|contact|correo|kontakt"),
    Kind("ip", IP, lambda m: m.rlike(IP_PARTS), True, 0.7, ".", r"(?i)\bip\b|server|host|address"),
    Kind("card", CARD, luhn, True, 0.8, "", r"(?i)card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", PHONE, _digits_between(8, 15), True, 0.7, "+", r"(?i)phone|call|tel|mobile|fax"),
    Kind("iban", IBAN, mod97, False, 0.8, "", r"(?i)iban|account|konto|compte|cuenta|bank"),
    Kind("secret", SECRET, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 8), False, 0.3, "", r"(?i)token|secret|passw|credential|\bkey\b|api[_-]?key|bearer"),
    Kind("ssn", SSN, lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), False, 0.3, "-", r"(?i)ssn|social security|tax id"),
)
#: Spans the method adds stay from this score on.
THRESHOLD = 0.5


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, finish, score>> of the confirmed spans, in order."""
    gaps = F.split(text, kind.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # what surrounds a match is taken from the pieces beside it: a place in a long text is slow to reach
    short = lambda c, n=CONTEXT: F.coalesce(F.substring(c, 1, n), F.lit(""))
    end = lambda c: F.coalesce(F.right(c, F.lit(CONTEXT)), F.lit(""))

    def beside(p: Column) -> Column:
        g, f = p["gaps"], p["found"]
        at = lambda c, i: F.get(c, i)
        before = lambda i: F.right(F.concat(end(at(g, i - 1)), end(at(f, i - 1)), end(g[i])), F.lit(CONTEXT))
        after = lambda i: short(F.concat(short(g[i + 1]), short(at(f, i + 1)), short(at(g, i + 2))))
        return F.transform(f, lambda m, i: F.struct(m.alias("value"), F.length(g[i]).alias("gap"), F.concat(before(i), F.lit(" "), after(i)).alias("around")))

    pairs = _let(F.struct(gaps.alias("gaps"), found.alias("found")), beside)

    def place(at: Column, x: Column) -> tuple[Column, Column]:
        start, finish = at + x["gap"], at + x["gap"] + F.length(x["value"])
        return finish, F.array(F.struct(start.alias("start"), finish.alias("finish"), x["value"].alias("value"), x["around"].alias("around")))

    # gap, match, gap, match, ...: each match starts after all lengths before it
    placed = _gather(pairs, F.lit(0).cast("long"), place)
    confirmed = _ibans(text) if kind.name == "iban" else F.filter(placed, lambda s: kind.valid(s["value"]))

    def scored(s: Column) -> Column:
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(s["around"].rlike(kind.words), 0.3).otherwise(0.0))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["finish"].alias("finish"), score.alias("score"))

    out = F.transform(confirmed, scored)
    out = out if kind.base else F.filter(out, lambda s: s["score"] >= THRESHOLD)
    none = F.array().cast("array<struct<kind:string,start:bigint,finish:bigint,score:double>>")
    gate = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(gate, out).otherwise(none)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: kind, start and finish (code points, finish exclusive) and score
    of every confirmed span, by kind in the order of KINDS, then start.

    A null or empty text has no spans; null ids and repeated rows are rows like any other; texts
    are read whole; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.select(F.col("id").alias(id_col), *[spans_of(F.col("text"), k).alias(k.name) for k in KINDS])


def personal_data_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts by kind and in all, base_sha256 and spans, as the contract of its query has them, for
    every row; nulls, empty texts and tables, repeated rows and other columns as in
    ``find_personal_data``."""
    found = find_personal_data(docs, id_col, text_col)
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["finish"].cast("string"))
    joined = lambda kinds: F.array_join(F.concat(*[F.transform(k.name, line) for k in kinds]), ",")
    counts = [F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS]
    every = sum((F.size(k.name) for k in KINDS[1:]), F.size(KINDS[0].name)).cast("long").alias("n_spans")
    return found.select(id_col, *counts, every, F.sha2(joined([k for k in KINDS if k.base]), 256).alias("base_sha256"), joined(KINDS).alias("spans"))
