"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted within their format by a key.

A value is a list of places, each with its own number of possible symbols: ten for a digit, twenty-six for a letter,
256 for a byte of an address. A Feistel network works on it: in each round the places of one parity are moved by
amounts that a keyed hash draws from the places of the other parity. Every round can be undone, so different values
stay different, and equal values are equal in every document, whatever their separators or case. What is checked stays
valid: check digits are computed anew, and dates, addresses and number ranges are numbered first. A date keeps the
number of digits of day and month, stays within or without the years 1900 to 2099, and a day above 12 stays above, so
that no form of it can be read as another date; days that a month lacks are moved on until there is one. Values that fail their check are no personal data and stay as they are. Columns only: no Python runs
on the executors.
"""

from pyspark.sql import Column, DataFrame, functions as F

from fathomdoc.session import once

ROUNDS = 8
#: The formats, as regular expressions; bounded runs keep the search linear in the text.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})",
    "phone": r"(?:(?:\+1[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{7,15}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})",
}
_ANY = r"(?<![\w+@])(?<![0-9][.-])(?:" + "|".join(FORMATS.values()) + r")(?![\w@]|[.-][0-9])"
#: A permuted date that no calendar has is permuted again, so often at most. One in thirty is none, so none is left.
WALKS = 16


def _draw(key: Column, kind: str, round_: Column, place: Column, others: Column) -> Column:
    """A number below 2^48 from the key and all that the round may see."""
    seen = F.concat_ws("|", key, F.lit(kind), round_.cast("string"), place.cast("string"), others)
    return F.conv(F.substring(F.sha2(seen, 256), 1, 12), 16, 10).cast("long")


def _permute(values: Column, sizes: Column, key: Column, kind: str, tweak: Column | None = None) -> Column:
    """The values (array of long), each below its size, after all rounds."""
    def other(state: Column, r: Column) -> Column:
        seen = F.array_join(F.filter(state, lambda x, i: i % 2 != r % 2).cast("array<string>"), ",")
        return seen if tweak is None else F.concat_ws("#", tweak, seen)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values,
        lambda state, r: F.transform(state, lambda x, i: F.when(
            (i % 2 == r % 2) & (F.get(sizes, i) > 1), F.pmod(x + _draw(key, kind, r, i, other(state, r)), F.get(sizes, i))).otherwise(x)))


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))


def _permute_text(text: Column, key: Column, kind: str, tweak: Column | None = None) -> Column:
    """Digits and letters of a text, permuted as one value; all else, and upper or lower case, stays in its place."""
    alone = F.regexp_replace(text, "[^A-Za-z0-9]", "")
    codes = F.transform(_characters(F.lower(alone)), lambda c: F.ascii(c).cast("long"))
    sizes = F.transform(codes, lambda c: F.when(c < 58, F.lit(10)).otherwise(26).cast("long"))
    moved = _permute(F.transform(codes, lambda c: F.when(c < 58, c - 48).otherwise(c - 97)), sizes, key, kind, tweak)
    symbols = F.zip_with(moved, sizes, lambda v, s: F.when(s == 10, F.char(v + 48)).otherwise(F.char(v + 97)))
    return F.aggregate(_characters(text), F.struct(F.lit("").alias("out"), symbols.alias("left")), lambda a, c: F.when(
        c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["out"], F.when(c.rlike("[A-Z]"), F.upper(F.get(a["left"], F.lit(0)))).otherwise(
            F.get(a["left"], F.lit(0)))).alias("out"), F.slice(a["left"], F.lit(2), F.size(a["left"])).alias("left"))).otherwise(
                F.struct(F.concat(a["out"], c).alias("out"), a["left"].alias("left"))), lambda a: a["out"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and its digits added."""
    return F.aggregate(
        F.transform(F.reverse(_characters(digits)), lambda c, i: F.when(i % 2 == 1, F.lit(2)).otherwise(1) * c.cast("int")),
        F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _mod97(iban: Column) -> Column:
    """Remainder of an account number: its first four characters last, letters as 10 to 35."""
    return F.aggregate(_characters(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _fill(shape: Column, digits: Column) -> Column:
    """The shape with its digits, from left to right, replaced by these."""
    return F.aggregate(_characters(shape), F.struct(F.lit("").alias("out"), digits.alias("left")), lambda a, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(a["out"], F.substring(a["left"], 1, 1)).alias("out"), F.substring(a["left"], 2, 64).alias("left"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["left"].alias("left"))), lambda a: a["out"])


def _email(m: Column, key: Column) -> Column:
    """All but the last label, under that label."""
    last = F.regexp_extract(m, r"\.[A-Za-z]+$", 0)
    return F.concat(_permute_text(F.regexp_replace(m, r"\.[A-Za-z]+$", ""), key, "email", F.lower(last)), last)


def _iban(m: Column, key: Column) -> Column:
    alone = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(alone, 1, 2)
    account = _permute_text(F.substring(alone, 5, 40), key, "iban", country)
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    whole = F.concat(country, check, account)
    filled = F.aggregate(_characters(m), F.struct(F.lit("").alias("out"), whole.alias("left")), lambda a, c: F.when(
        c == " ", F.struct(F.concat(a["out"], c).alias("out"), a["left"].alias("left"))).otherwise(F.struct(
            F.concat(a["out"], F.substring(a["left"], 1, 1)).alias("out"), F.substring(a["left"], 2, 64).alias("left"))), lambda a: a["out"])
    return F.when((F.length(alone).between(15, 34)) & (_mod97(alone) == 1), filled)


def _ip(m: Column, key: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    moved = _permute(parts, F.transform(parts, lambda p: F.lit(256).cast("long")), key, "ip")
    return F.when(F.forall(parts, lambda p: p < 256), F.array_join(moved.cast("array<string>"), "."))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_date(year: Column, month: Column, day: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    days = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= days)


def _date(m: Column, key: Column) -> Column:
    """Days first unless written with slashes, where the first number is the month if it can be one."""
    def moved(parts: Column, v: Column) -> Column:
        year, month, day = v["year"], v["month"], v["day"]
        near = year.between(1900, 2099)
        least_month, least_day = F.when(month <= 9, 1).otherwise(10), F.when(day <= 9, 1).when(day <= 12, 10).otherwise(13)
        sizes = F.array(F.when(near, 200).otherwise(9799), F.when(month <= 9, 9).otherwise(3),
                        F.when(day <= 9, 9).when(day <= 12, 3).otherwise(19)).cast("array<long>")
        state = F.array(F.when(near, year - 1900).otherwise(F.when(year < 1900, year - 1).otherwise(year - 201)),
                        month - least_month, day - least_day)

        def read(state: Column) -> list[Column]:
            first = F.get(state, F.lit(0))
            years = F.when(near, first + 1900).otherwise(F.when(first < 1899, first + 1).otherwise(first + 201))
            return [years, F.get(state, F.lit(1)) + least_month, F.get(state, F.lit(2)) + least_day]

        def step(state: Column) -> Column:
            return _permute(state, sizes, key, "date", F.array_join(sizes.cast("array<string>"), ","))

        last = F.aggregate(F.sequence(F.lit(2), F.lit(WALKS)), step(state), lambda s, _: F.when(_is_date(*read(s)), s).otherwise(step(s)))
        out = _let(last, lambda s: F.call_function("array_join", F.transform(parts, lambda p, i: F.lpad(F.when(
            i == v["year_at"], read(s)[0]).when(i == v["month_at"], read(s)[1]).otherwise(read(s)[2]).cast("string"), F.length(p), F.lit("0"))),
            F.regexp_extract(m, "[-/.]", 0)))
        return F.when(_is_date(year, month, day), out)

    def places(parts: Column) -> Column:
        year_at = F.when(m.contains("-"), 0).otherwise(2)
        month_at = F.when(m.contains("/") & (F.get(parts, F.lit(0)).cast("int") <= 12), 0).otherwise(1)
        number = lambda i: F.get(parts, i).cast("long")
        return F.struct(year_at.alias("year_at"), month_at.alias("month_at"), number(year_at).alias("year"),
                        number(month_at).alias("month"), number(3 - year_at - month_at).alias("day"))

    return _let(F.split(m, "[-/.]"), lambda parts: _let(places(parts), lambda v: moved(parts, v)))


def _phone(m: Column, key: Column) -> Column:
    """All digits but the country code, which is the digits up to the first that is no part of it."""
    code = F.regexp_extract(m, r"^(\+(?:1|7|[0-9]{2}))?", 0)
    rest = F.substring(m, F.length(code) + 1, F.lit(64))
    numbers = F.transform(_characters(_digits(rest)), lambda c: c.cast("long"))
    moved = _permute(numbers, F.transform(numbers, lambda n: F.lit(10).cast("long")), key, "phone", F.when(code == "+1", F.lit("")).otherwise(code))
    return F.when(F.length(_digits(m)).between(7, 15), F.concat(code, _fill(rest, F.array_join(moved.cast("array<string>"), ""))))


def _ssn(m: Column, key: Column) -> Column:
    """Area 1 to 899 without 666, group from 1, serial from 1."""
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("long") for i in range(3))
    state = _permute(F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1),
                     F.array(*[F.lit(n).cast("long") for n in (898, 99, 9999)]), key, "ssn")
    moved = [F.get(state, F.lit(i)) + 1 for i in range(3)]
    moved[0] = F.when(moved[0] >= 666, moved[0] + 1).otherwise(moved[0])
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in zip(moved, (3, 2, 4))]))


def _card(m: Column, key: Column) -> Column:
    """All digits but the last, which is computed."""
    digits = _digits(m)
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    numbers = F.transform(_characters(body), lambda c: c.cast("long"))
    moved = F.array_join(_permute(numbers, F.transform(numbers, lambda n: F.lit(10).cast("long")), key, "card").cast("array<string>"), "")
    check = (10 - _luhn(F.concat(moved, F.lit("0"))) % 10) % 10
    return F.when((_luhn(digits) % 10 == 0) & (digits.cast("decimal(20,0)") > 0), _fill(m, F.concat(moved, check.cast("string"))))


_MOVES = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}


def pseudonymise(documents: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, values) for each row of (doc_id, text): the text with pseudonyms, and for each value that was
    replaced a struct (kind, pseudonym), in order. Other columns are ignored.

    Email addresses, account and card numbers, network addresses, dates, phone and social security numbers are
    replaced if they pass the check of their kind. A null text stays null with no values; texts of any length are
    searched whole; repeated rows are changed alike. The same key always gives the same pseudonyms.
    """
    secret = F.lit(key)
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    found = once(docs, found=F.coalesce(F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)), F.array().cast("array<string>")))

    def change(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(FORMATS.items()):
            kind = F.when(m.rlike(f"^{pattern}$"), F.lit(name)).otherwise(kind)
        return kind

    kinds = once(found, kinds=F.transform("found", change))
    moved = F.transform("found", lambda m, i: F.coalesce(*[F.when(F.get("kinds", i) == kind, move(m, secret)) for kind, move in _MOVES.items()]))
    moved = once(kinds, moved=F.when(F.size("found") > 0, moved).otherwise(F.array().cast("array<string>")))
    between = once(moved, between=F.when(F.size("found") > 0, F.split("text", _ANY, -1)))
    text = F.when(F.size("found") == 0, F.col("text")).otherwise(F.array_join(F.transform(
        "between", lambda b, i: F.concat(b, F.coalesce(F.get("moved", i), F.get("found", i), F.lit("")))), ""))
    values = F.filter(F.arrays_zip(F.col("kinds").alias("kind"), F.col("moved").alias("pseudonym")), lambda v: v["pseudonym"].isNotNull())
    return between.select("doc_id", text.alias("text"), values.alias("values"))
