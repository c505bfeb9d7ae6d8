"""Operator 3: format-preserving pseudonyms of personal numbers, dates and addresses. DataFrame functions only.

A keyed Feistel network permutes the values of each kind within their format, so equal values get equal pseudonyms
in every document (with no table of them), unequal ones unequal, and who has the key can turn them back. Only what
validates is a value: everything else stays byte for byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import bind

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Every repetition that a text can prolong is possessive: it neither recurses nor goes back, however long the run.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}+@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++(?!@)"
#: Kinds of numbers in order of preference where they could start at one place.
NUMBERS = {
    "ip": rf"(?:{OCTET}\.){{3}}{OCTET}(?!\d)(?!\.\d)",
    "date": r"(?:\d{4}([-/])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{4})(?!\d)(?![-./]\d)",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)",
}
KINDS = ("email", *NUMBERS)
#: Where a number may start: the first test fails at once on nearly every character.
START = r"(?=[0-9+(])(?<![A-Za-z0-9._%+@\x01\-])"
#: Stand around and between the groups of matches while a text is in pieces; a text that has them already is written
#: with each doubled by ESCAPE.
MARK, FIELD, ESCAPE = "\x01", "\x03", "\x02"
#: 400 years of days, 1800 to 2199, are 189 x 773 days: two halves without a rest.
EPOCH, LEFT, RIGHT = "1800-01-01", 189, 773
#: Social security numbers: 898 areas (not 000, 666, 900 and up) of 99 groups, and 9,999 serials.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def _turns(back: bool) -> Column:
    return F.array(*map(F.lit, range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)))


def _digest(key: str, tag: str, turn: Column, half: Column) -> Column:
    """One keyed digest for a round, of the half that stays: 128 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), half.cast("string")), 512)


def permute(text: Column, key: str, tag: str, back: bool = False) -> Column:
    """A string of 64 characters at most as another of the same length and character classes: a bijection for each key
    and tag. Letters move among letters of their case, digits among digits, other characters stay."""

    def turned(half: Column, other: Column, turn: Column) -> Column:
        def move(noise: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                n = F.conv(F.substr(noise, 4 * i + 1, F.lit(4)), 16, 10).cast("int") * (-1 if back else 1)
                out = c
                for low, size in (("a", 26), ("A", 26), ("0", 10)):
                    out = F.when(c.between(low, chr(ord(low) + size - 1)), F.char(F.lit(ord(low)) + F.pmod(F.ascii(c) - ord(low) + n, F.lit(size)))).otherwise(out)
                return out

            return F.array_join(F.transform(_chars(half), one), "")

        return bind(_digest(key, tag, turn, other), move)

    def turn(s: Column, k: Column) -> Column:
        if back:
            return F.struct(turned(s["r"], s["l"], k).alias("l"), s["l"].alias("r"))
        return F.struct(s["r"].alias("l"), turned(s["l"], s["r"], k).alias("r"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1).alias("r"))
    return F.aggregate(_turns(back), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permute_pair(left: Column, right: Column, sizes: tuple, key: str, tag: str, back: bool = False) -> Column:
    """A pair of numbers below ``sizes`` (numbers or columns) as another such pair (struct l, r): a Feistel network over
    unequal halves, which takes turns in moving one half by a digest of the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in sizes)

    def moved(half: Column, other: Column, size: Column, k: Column) -> Column:
        n = F.conv(F.substring(_digest(key, tag, k, other), 1, 12), 16, 10).cast("long") % size
        return F.pmod(half - n if back else half + n, size)

    def turn(s: Column, k: Column) -> Column:
        return F.when(k % 2 == 1, F.struct(moved(s["l"], s["r"], a, k).cast("long").alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), moved(s["r"], s["l"], b, k).cast("long").alias("r")))

    return F.aggregate(_turns(back), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permute_digits(digits: Column, key: str, tag: str, back: bool = False) -> Column:
    """A string of 2 to 19 digits as another of the same length."""

    def whole(x: Column) -> Column:
        n, half = F.length(x), F.floor(F.length(x) / 2).cast("int")
        rest = n - half
        sizes = (F.pow(F.lit(10), half).cast("long"), F.pow(F.lit(10), rest).cast("long"))
        new = permute_pair(F.substr(x, F.lit(1), half), F.substr(x, half + 1), sizes, key, f"{tag}", back)
        return bind(new, lambda p: F.concat(F.lpad(p["l"].cast("string"), half, F.lit("0")), F.lpad(p["r"].cast("string"), rest, F.lit("0"))))

    return bind(digits, whole)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _redigit(x: Column, digits: Column) -> Column:
    """``x`` with its digits replaced in order; everything between them stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(_chars(x), start, put, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """Of digits with the check digit last: divisible by ten in a valid number."""
    values = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _card(x: Column, key: str, back: bool) -> Column:
    """A number with a valid check digit becomes another such number of the same length; any other is no card."""

    def valid(d: Column) -> Column:
        head = permute_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card", back)
        checked = bind(head, lambda h: F.concat(h, F.pmod(-luhn_sum(F.concat(h, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, bind(checked, lambda c: _redigit(x, c)))

    return bind(_digits(x), valid)


def _ip(x: Column, key: str, back: bool) -> Column:
    def whole(o: Column) -> Column:
        new = permute_pair(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), (65536, 65536), key, "ip", back)
        return bind(new, lambda p: F.concat_ws(".", *(v.cast("string") for h in (p["l"], p["r"]) for v in (F.floor(h / 256), h % 256))))

    return bind(F.transform(F.split(x, r"\."), lambda p: p.cast("int")), whole)


def _date(x: Column, key: str, back: bool) -> Column:
    """A date of the calendar, 1800 to 2199, becomes another one in the same notation; anything else is no date. Day
    before month, unless only the other way round is a date."""

    def whole(parts: Column) -> Column:
        first, second, third = (F.get(parts, i) for i in range(3))
        iso = F.length(first) == 4
        swap = ~iso & (second.cast("int") > 12)  # month first
        year = F.when(iso, first).otherwise(third)
        month = F.when(iso, second).when(swap, first).otherwise(second)
        day = F.when(iso, third).when(swap, second).otherwise(first)
        n = F.datediff(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), F.lit(EPOCH).cast("date"))
        padded = F.when(iso, F.length(second) + F.length(third) == 4).otherwise(F.length(first) + F.length(second) == 4)
        sep = F.regexp_extract(x, r"^\d+([-./])", 1)

        def written(when: Column) -> Column:
            d, m = (F.when(padded, F.date_format(when, f * 2)).otherwise(F.date_format(when, f)) for f in ("d", "M"))
            y = F.date_format(when, "yyyy")
            return F.when(iso, F.concat(y, sep, m, sep, d)).when(swap, F.concat(m, sep, d, sep, y)).otherwise(F.concat(d, sep, m, sep, y))

        def moved(when: Column) -> Column:
            n = F.datediff(when, F.lit(EPOCH).cast("date"))
            new = permute_pair(F.floor(n / RIGHT), n % RIGHT, (LEFT, RIGHT), key, "date", back)
            return bind(new, lambda p: F.date_add(F.lit(EPOCH).cast("date"), (p["l"] * RIGHT + p["r"]).cast("int")))

        def again(when: Column, _: Column) -> Column:
            # on to the next date of the cycle until it is read the way it is written: 0.6**64 of chances are left
            plain = ~swap | (F.dayofmonth(when) > 12)
            short = padded | (F.dayofmonth(when) < 10) | (F.month(when) < 10)
            return F.when(plain & short, when).otherwise(moved(when))

        def dated(n: Column) -> Column:
            first = moved(F.date_add(F.lit(EPOCH).cast("date"), n))
            return bind(F.aggregate(F.sequence(F.lit(1), F.lit(64)), first, again), written)

        return bind(n, lambda n: F.when(n.between(0, LEFT * RIGHT - 1), dated(n)))

    return bind(F.split(x, r"[-./]"), whole)


def _phone(x: Column, key: str, back: bool) -> Column:
    """The country code stays; the last digits of the number, ten at most, are permuted. Numbers of 8 digits (with a
    code) or 10 to 15 (the longest that can be dialled) are phones."""

    def whole(d: Column) -> Column:
        plus = F.startswith(x, F.lit("+"))
        code = F.greatest(F.length(d) - 10, F.when(plus, F.length(_digits(F.regexp_extract(x, r"^\+\d{1,3}(?!\d)", 0)))).otherwise(0))
        new = F.concat(F.substr(d, F.lit(1), code), permute_digits(F.substr(d, code + 1), key, "phone", back))
        return F.when(F.length(d).between(F.when(plus, 8).otherwise(10), F.lit(15)), bind(new, lambda n: _redigit(x, n)))

    return bind(_digits(x), whole)


def _email(x: Column, key: str, back: bool) -> Column:
    """Letters and digits before the @ are permuted among letters of the same case and digits; the host stays. A host
    ends in a name of letters."""
    new = F.concat(permute(F.substring_index(x, "@", 1), key, "email", back), F.lit("@"), F.substring_index(x, "@", -1))
    return F.when(F.substring_index(x, ".", -1).rlike("^[A-Za-z]{2,63}$"), new)


def _ssn(x: Column, key: str, back: bool) -> Column:
    """Numbers that can be given out (area not 000, 666 or from 900, group not 00, serial not 0000) among themselves."""

    def whole(p: Column) -> Column:
        area, group, serial = (F.get(p, i) for i in range(3))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = area - F.when(area > 666, 2).otherwise(1)
        new = permute_pair(index * GROUPS + group - 1, serial - 1, (AREAS * GROUPS, SERIALS), key, "ssn", back)

        def written(n: Column) -> Column:
            a = F.floor(n["l"] / GROUPS)
            return F.concat_ws("-", F.lpad((a + F.when(a >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((n["l"] % GROUPS + 1).cast("string"), 2, "0"), F.lpad((n["r"] + 1).cast("string"), 4, "0"))

        return F.when(valid, bind(new, written))

    return bind(F.transform(F.split(x, "-"), lambda v: v.cast("int")), whole)


#: What makes the pseudonym of each kind; null if the value is not valid.
MAKERS = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}
#: Groups of the numbers' pattern in the order of NUMBERS; the groups inside dates hold separators.
_INNER = {"ip": 1, "date": 2, "phone": 5, "ssn": 6, "card": 7}


def _numbers() -> str:
    inner = NUMBERS | {"date": NUMBERS["date"].replace(r"\1", r"\3").replace(r"\2", r"\4"), "card": NUMBERS["card"].replace(r"\1", r"\8").replace(r"\2", r"\9")}
    return f"{START}(?:" + "|".join(f"({p})" for p in inner.values()) + r")(?![A-Za-z@])"


def _count(kinds: Column, kind: str) -> Column:
    return F.coalesce(F.size(F.filter(kinds, lambda k: k == kind)), F.lit(0))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None, back: bool = False) -> DataFrame:
    """All rows and columns; in ``text_col`` every validated address, number and date gets its pseudonym.

    Validated are e-mail addresses with a host and 64 characters before the @ at most, IPv4 addresses, dates of the
    calendar (1987-02-28, 1987/02/28, 28.2.1987, 28-02-1987, 2/28/1987) from 1800 to 2199, phone numbers by their
    number of digits, social security numbers that can be given out, and card numbers by their check digit. What doesn't validate
    stays byte for byte. ``found_col`` names a column for the counts by kind (a map of every kind; one of that name is
    replaced). ``back`` turns pseudonyms made with the same key into the values again. A narrow plan: no shuffle, no
    table of values. Nulls stay null and empty texts empty (with counts of 0); repeated rows are treated alike; other
    columns stay, whatever their names; an empty table gives none. Texts may be of any length: patterns don't recurse.
    """
    text = F.col(text_col)
    odd = text.rlike(f"[{MARK}{FIELD}{ESCAPE}]")
    held = text
    for c, sign in ((ESCAPE, "b"), (MARK, "a"), (FIELD, "c")):
        held = F.regexp_replace(held, c, ESCAPE + sign)
    held = F.when(odd, held).otherwise(text)
    mailed = F.when(text.contains("@"), F.regexp_replace(held, EMAIL, f"{MARK}email{FIELD}$0{MARK}")).otherwise(held)
    # each match is written as its groups, of which one is not empty, and so tells its kind
    fields = FIELD.join(f"${_INNER[k]}" for k in NUMBERS)
    marked = F.when(text.rlike("[0-9]"), F.regexp_replace(mailed, _numbers(), f"{MARK}{fields}{MARK}")).otherwise(mailed)

    def replaced(p: Column, i: Column) -> Column:
        """struct kind, out: of a match, its kind (null if not valid) and what takes its place."""

        def made(f: Column) -> Column:
            mail = F.get(f, 0) == "email"
            raw = F.when(mail, F.get(f, 1)).otherwise(F.array_join(f, ""))

            def chosen(x: Column) -> Column:
                kind, new = F.when(mail, F.lit("email")), F.when(mail, MAKERS["email"](x, key, back))
                for n, name in enumerate(NUMBERS):
                    kind, new = kind.when(F.get(f, n) != "", F.lit(name)), new.when(F.get(f, n) != "", MAKERS[name](x, key, back))
                return bind(new, lambda y: F.struct(F.when(y.isNotNull(), kind).alias("kind"), F.coalesce(y, x).alias("out")))

            return bind(raw, chosen)

        return F.when(i % 2 == 1, bind(F.split(p, FIELD), made)).otherwise(F.struct(F.lit(None).cast("string").alias("kind"), p.alias("out")))

    whole = bind(F.transform(F.split(marked, MARK), replaced), lambda r: F.struct(F.array_join(F.transform(r, lambda x: x["out"]), "").alias("text"), F.filter(F.transform(r, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds")))
    found = F.when(text.rlike("[0-9@]"), whole)
    made = "_pseudonyms"
    while made.lower() in {c.lower() for c in docs.columns}:
        made = f"_{made}"
    out = docs.withColumn(made, found)
    new = F.col(made)["text"]
    plain = F.when(odd, F.regexp_replace(F.regexp_replace(F.regexp_replace(new, ESCAPE + "c", FIELD), ESCAPE + "a", MARK), ESCAPE + "b", ESCAPE)).otherwise(new)
    columns = {text_col: F.when(F.col(made).isNull(), text).otherwise(plain)}
    if found_col:
        columns[found_col] = F.map_from_arrays(F.array(*map(F.lit, KINDS)), F.array(*(_count(F.col(made)["kinds"], k) for k in KINDS)))
    return out.withColumns(columns).drop(made)
