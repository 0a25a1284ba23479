"""Personal data: format-preserving Feistel pseudonyms for validated numbers, dates and mail names.

One pattern finds candidates; a candidate counts after validation of its kind (Luhn sum, ranges of
octets and number groups, real calendar dates). Its variable parts become digits of a mixed-radix
number, and a keyed Feistel network permutes them: each round adds a hash of one half to the
other, part by part, modulo the part's radix. So every pseudonym has its original's format, the
mapping is one to one within a format, and equal values get equal pseudonyms in all documents
whatever separators they are written with. Cards get a new Luhn digit; dates walk until the
result is a date of the calendar range.

Groups of digits with single blanks or hyphens between them, 13 digits or more in all, are one
candidate: a run. From each group on, every kind and every card length is tried, and the leftmost
valid ones that do not overlap get pseudonyms, so no invalid number hides a valid one beside it.

All of it is one projection over the rows, without an exchange. Defined results: a NULL text
stays NULL, an empty one empty; texts without valid candidates stay as they are; rows are handled
each by itself, so repeated rows come out alike; other columns are passed through. Work columns
begin with ``_pii``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: Kind -> pattern. The mail pattern starts at the start of a run and never backs up, so long
#: runs without an @ cost one pass; it ends in the last letter of its domain.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?!\.)(?:(?:[0-9-]|\.(?!\.))*+[A-Za-z]++)++",
    "ip": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "date": _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})" + _END,
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?<![A-Za-z0-9+])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _END,
}
CARD_DIGITS = range(19, 12, -1)  # the longest first
#: A number with dots or strokes is no part of a run.
_OTHER = (
    r"(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
    r"|[0-9]{3}\.[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ -][0-9]{3}\.[0-9]{4})(?![A-Za-z0-9])"
)
RUN = _EDGE + rf"(?!{_OTHER})(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{_OTHER})[0-9]++(?![A-Za-z]))*+" + _END
#: Runs come before the kinds that may stand in them.
ALL = {"email": PATTERNS["email"], "ip": PATTERNS["ip"], "run": RUN} | {k: PATTERNS[k] for k in ("date", "ssn", "phone")}
ANY = "|".join(f"(?:{p})" for p in ALL.values())
_FIRST_DAY, _DAYS = "1900-01-01", 73_049  # to 2099-12-31
_DAY_RADIX = (271, 270)  # a little more than the days; results beyond them walk on


def _once(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(values: Column, radix: Column, key: str, kind: str, rounds: int = ROUNDS) -> Column:
    """Permute an array of parts, each below its radix (arrays of int of equal length)."""
    half = F.floor(F.size(values) / 2).cast("int")

    def add(part: Column, part_radix: Column, other: Column, turn: Column) -> Column:
        named = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), F.array_join(other.cast("array<string>"), ","))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(part) / 16).cast("int")),
            lambda b: F.sha2(F.concat_ws("|", named, b.cast("string")), 256),
        )
        # Sixteen bits of the hash for each part.
        return _once(
            blocks,
            lambda h: F.transform(
                F.arrays_zip(part.alias("v"), part_radix.alias("r")),
                lambda x, i: (
                    (x["v"] + F.conv(F.substring(F.get(h, F.floor(i / 16).cast("int")), i % 16 * 4 + 1, F.lit(4)), 16, 10).cast("int"))
                    % x["r"]
                ).cast("int"),
            ),
        )

    def run(bound: Column) -> Column:
        v, r, n = bound["v"], bound["r"], bound["n"]
        left_radix, right_radix = F.slice(r, F.lit(1), n), F.slice(r, n + 1, F.size(r) - n)
        start = F.struct(F.slice(v, F.lit(1), n).alias("a"), F.slice(v, n + 1, F.size(v) - n).alias("b"))

        def turn(acc: Column, i: Column) -> Column:
            return F.when(
                i % 2 == 0, F.struct(add(acc["a"], left_radix, acc["b"], i).alias("a"), acc["b"].alias("b"))
            ).otherwise(F.struct(acc["a"].alias("a"), add(acc["b"], right_radix, acc["a"], i).alias("b")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return _once(F.struct(values.alias("v"), radix.alias("r"), half.alias("n")), run)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _permuted_chars(text: Column, key: str, kind: str) -> Column:
    """Digits become digits, letters letters of the same case, the rest stays."""

    def parts(chars: Column) -> Column:
        code = lambda c: F.ascii(c)
        base = lambda c: (
            F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97)
        )
        open_ = F.filter(chars, lambda c: c.rlike("[A-Za-z0-9]"))
        values = F.transform(open_, lambda c: (code(c) - base(c)).cast("int"))
        radix = F.transform(open_, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26))

        def put_back(new: Column) -> Column:
            zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
            step = lambda acc, c: F.when(
                c.rlike("[A-Za-z0-9]"),
                F.struct(F.concat(acc["s"], F.char(base(c) + F.get(new, acc["k"]))).alias("s"), (acc["k"] + 1).alias("k")),
            ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
            return F.aggregate(chars, zero, step, lambda a: a["s"])

        return _once(feistel(values, radix, key, kind), put_back)

    return _once(_chars(text), parts)


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last one counted plain."""
    size = F.size(digits)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when((size - i) % 2 == 0, doubled(d)).otherwise(d)), F.lit(0), lambda a, d: a + d
    )


def _digits(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def _email(text: Column, key: str) -> Column:
    name, rest = F.regexp_extract(text, "^[^@]*", 0), F.regexp_extract(text, "@.*$", 0)
    return F.when(text.rlike("[A-Za-z]$"), F.concat(_permuted_chars(name, key, "email"), rest))


def _ip(text: Column, key: str) -> Column:
    def body(octets: Column) -> Column:
        new = feistel(octets, F.array_repeat(F.lit(256), 4), key, "ip")
        return F.when(F.forall(octets, lambda o: o <= 255), F.array_join(new.cast("array<string>"), "."))

    plain = ~text.rlike(r"(?:^|\.)0[0-9]")
    return F.when(plain, _once(F.split(text, r"\.").cast("array<int>"), body))


def _ssn(text: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""

    def body(n: Column) -> Column:
        area, group, serial = n[0], n[1], n[2]
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        values = F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1)
        new = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn")
        text_of = lambda v: F.concat_ws(
            "-", F.lpad((v[0] + F.when(v[0] > 664, 2).otherwise(1)).cast("string"), 3, "0"),
            F.lpad((v[1] + 1).cast("string"), 2, "0"), F.lpad((v[2] + 1).cast("string"), 4, "0"),
        )
        return F.when(valid, _once(new, text_of))

    return _once(F.split(text, "-").cast("array<int>"), body)


def _phone(text: Column, key: str) -> Column:
    """The country code stays; the ten digits after it are permuted."""
    code = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])[ .-]?", 0)
    return F.concat(code, _permuted_chars(F.substring(text, F.char_length(code) + 1, F.char_length(text)), key, "phone"))


def _card(text: Column, key: str) -> Column:
    """The first digit, which names the kind of card, stays; the last one is the new check digit."""

    def body(digits: Column) -> Column:
        size = F.size(digits)
        inner = F.slice(digits, F.lit(2), size - 2)
        new = F.concat(F.slice(digits, 1, 1), feistel(inner, F.array_repeat(F.lit(10), size - 2), key, "card"))

        def checked(front: Column) -> Column:
            check = (10 - luhn_sum(F.concat(front, F.array(F.lit(0)))) % 10) % 10
            return F.concat(front, F.array(check.cast("int")))

        def written(final: Column) -> Column:
            zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))
            step = lambda acc, c: F.when(
                c.rlike("[0-9]"),
                F.struct(F.concat(acc["s"], F.get(final, acc["k"]).cast("string")).alias("s"), (acc["k"] + 1).alias("k")),
            ).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))
            return F.aggregate(_chars(text), zero, step, lambda a: a["s"])

        return F.when(luhn_sum(digits) % 10 == 0, _once(_once(new, checked), written))

    return _once(_digits(text), body)


def _date(text: Column, key: str) -> Column:
    def walk(day: Column) -> Column:
        parts = lambda d: F.array(F.floor(d / _DAY_RADIX[1]).cast("int"), (d % _DAY_RADIX[1]).cast("int"))
        back = lambda v: v[0] * _DAY_RADIX[1] + v[1]
        radix = F.array(*[F.lit(r) for r in _DAY_RADIX])
        once = lambda d: _once(feistel(parts(d), radix, key, "date"), back)
        spare = _DAY_RADIX[0] * _DAY_RADIX[1] - _DAYS
        # A cycle can hold at most all of the spare numbers before it comes back to a day.
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(spare)), once(day), lambda d, _: F.when(d < _DAYS, d).otherwise(once(d))
        )

    first = F.lit(_FIRST_DAY).cast("date")

    def moved(form: str):
        def body(date: Column) -> Column:
            day = F.datediff(date, first)
            inside = (day >= 0) & (day < _DAYS)
            return F.when(inside, _once(walk(day), lambda d: F.date_format(F.date_add(first, d), form)))

        return body

    outcome = F.lit(None).cast("string")
    for shape, form in ((r"^....-", "yyyy-MM-dd"), (r"^..\.", "dd.MM.yyyy"), (r"^../", "MM/dd/yyyy")):
        found = F.try_to_timestamp(text, F.lit(form)).cast("date")
        outcome = F.when(text.rlike(shape), _once(found, moved(form))).otherwise(outcome)
    return outcome


def _in_run(run: Column, key: str) -> Column:
    """The run with its valid numbers replaced, and how many there are."""

    def at(pieces: Column, i: Column) -> Column:
        # The longest candidate has 19 groups; one more piece shows what follows it.
        rest = F.array_join(F.slice(pieces, i, 20), "")
        before = F.get(pieces, i - 2)
        found = lambda kind: F.regexp_extract(rest, "^" + PATTERNS[kind], 0)
        cards = F.array(*[F.regexp_extract(rest, rf"^[0-9](?:[ -]?[0-9]){{{n - 1}}}" + _END, 0) for n in CARD_DIGITS])
        card = F.get(F.filter(cards, lambda c: (c != "") & (luhn_sum(_digits(c)) % 10 == 0)), F.lit(0))
        tried = [F.when(found(kind) != "", F.struct(found(kind).alias("old"), make(found(kind), key).alias("new")))
                 for kind, make in (("date", _date), ("ssn", _ssn), ("phone", _phone))]
        tried.append(F.when(card.isNotNull(), F.struct(card.alias("old"), _card(card, key).alias("new"))))
        valid = F.get(F.filter(F.array(*tried), lambda t: t["new"].isNotNull()), F.lit(0))
        return F.struct(i.alias("at"), valid["old"].alias("old"), valid["new"].alias("new"))

    def body(pieces: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: at(pieces, i)), lambda c: c["new"].isNotNull())
        zero = F.struct(F.lit(1).alias("free"), F.lit("").alias("text"), F.lit(0).alias("n"))

        def step(acc: Column, c: Column) -> Column:
            after = c["at"] + F.size(F.split(c["old"], "[ -]"))
            gap = F.array_join(F.slice(pieces, acc["free"], F.greatest(c["at"] - acc["free"], F.lit(0))), "")
            mark = F.regexp_extract(F.get(pieces, after - 2), "[ -]$", 0)
            taken = F.struct(after.alias("free"), F.concat(acc["text"], gap, c["new"], mark).alias("text"), (acc["n"] + 1).alias("n"))
            return F.when(c["at"] >= acc["free"], taken).otherwise(acc)

        end = lambda a: F.struct(
            F.concat(a["text"], F.array_join(F.slice(pieces, a["free"], F.size(pieces)), "")).alias("text"), a["n"].alias("n")
        )
        return F.aggregate(found, zero, step, end)

    # Each piece is a group with the mark behind it.
    return _once(F.split(run, "(?<=[ -])"), body)


def pseudonym(match: Column, key: str) -> Column:
    """The text of one candidate with its pseudonyms, and their number."""
    kinds = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}
    chosen = F.lit(None).cast("string")
    for name in reversed(list(kinds)):
        chosen = F.when(match.rlike(f"^(?:{PATTERNS[name]})$"), kinds[name](match, key)).otherwise(chosen)
    alone = _once(chosen, lambda p: F.struct(F.coalesce(p, match).alias("text"), p.isNotNull().cast("int").alias("n")))
    return F.when(match.rlike(f"^(?:{RUN})$"), _in_run(match, key)).otherwise(alone)


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", count: str | None = None) -> DataFrame:
    """The rows with pseudonyms in the text; ``count`` names a column for the number of them."""
    text = F.col(text_column)
    staged = docs.withColumn("_pii_m", F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    staged = staged.withColumn("_pii_n", F.transform("_pii_m", lambda m: pseudonym(m, key)))
    pieces = F.split(text, ANY, -1)
    new = F.transform("_pii_n", lambda p: p["text"])
    joined = F.array_join(
        F.flatten(F.zip_with(pieces, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""
    )
    if count:
        staged = staged.withColumn(count, F.coalesce(F.aggregate("_pii_n", F.lit(0), lambda a, p: a + p["n"]), F.lit(0)).cast("long"))
    return staged.withColumn(text_column, F.when(F.size("_pii_m") > 0, joined).otherwise(text)).drop("_pii_m", "_pii_n")


#: The key of the registered query; a production run passes its own secret.
KEY = "example-key"


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, text, n_pseudonyms`` of the registered query."""
    return pseudonymise(docs.select("doc_id", "text"), KEY, "text", "n_pseudonyms").select("doc_id", "text", "n_pseudonyms")
