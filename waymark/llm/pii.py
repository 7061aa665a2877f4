"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Candidates are found by one pattern; each is validated (Luhn, octets, calendar, number ranges) and, if valid, replaced by a keyed
permutation of the valid values of its own format: a Feistel network of ROUNDS rounds over two numbers a and b, in turn
a := (a + F(round, b)) mod A and b := (b + F(round, a)) mod B, with F from SHA-256 under the key. Equal values get equal
pseudonyms in all documents, and different ones of a kind and format different pseudonyms. What does not validate stays as it is.

The key is the caller's. Only a digest of it stands in the plan, but whoever has that digest can undo the pseudonyms, so plans and
event logs are as secret as the key.

| kind | found | permuted over |
|-|-|-|
| card | 13 to 19 digits, single spaces or hyphens between, Luhn valid; whole groups of a longer or invalid run, from the left, the longest first | the digits but the last, which is computed again |
| phone | optional +country, area in brackets or with separators, 10 digits in all | the 10 digits, first digit of the area and of the rest aside |
| ssn | ddd-dd-dddd with a valid area, group and serial | all valid numbers |
| ip | four octets up to 255 | all addresses |
| date | yyyy-mm-dd, dd/mm/yyyy or mm/dd/yyyy (the first that is a date), dd.mm.yyyy; from 1800 to 2199 | all days of these 400 years; mm/dd/yyyy all with a day over 12, which are no dd/mm/yyyy |
| iban | two letters, two check digits, 11 to 30 letters or digits, valid modulo 97 | its digits from the fifth place on; check digits computed again |
| email | local part, @, domain | 48 bits of a keyed digest of the lower-cased address, in the domain mail.invalid |
| secret | 32 or more lower- or upper-case hexadecimal digits | a keyed digest of the same length and case |

E-mail addresses and secrets have no fixed number format; their pseudonyms are digests, equal for equal values.
"""

from __future__ import annotations

import hashlib
from calendar import monthrange
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KINDS = ("card", "phone", "ssn", "ip", "date", "iban", "email", "secret")

_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}))+"
SECRET = rf"{_EDGE}(?:(?=[0-9]*[a-f])[0-9a-f]{{32,128}}|(?=[0-9]*[A-F])[0-9A-F]{{32,128}}){_END}"
IBAN = rf"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{_END}"
IP = r"(?<![\p{L}\p{N}_.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}_]|\.[0-9])"
DATE = r"(?<![\p{L}\p{N}_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}_]|[./-][0-9])"
SSN = r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_]|-[0-9])"
PHONE = r"(?<![\p{L}\p{N}_+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}_]|-[0-9])"
#: A run of digit groups up to what is found as another kind; cards() searches it.
CARD = rf"(?<![\p{{L}}\p{{N}}_-])[0-9](?:(?:[ -](?!{DATE}|{SSN}|{PHONE}))?[0-9]){{12,255}}(?![\p{{L}}\p{{N}}_]|-[0-9])"
ANY = "|".join((EMAIL, SECRET, IBAN, IP, DATE, SSN, PHONE, CARD))
#: A text without any of these has no candidate.
HINT = "[0-9@]|[A-Fa-f]{32}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _number(digits: Column) -> Column:
    return F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).cast("long")


def _noise(key: str, tweak: Column, turn: Column, value: Column) -> Column:
    """48 bits of SHA-256 under the key."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(key: str, tweak: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b): the pair permuted among all pairs below size_a and size_b."""

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        new_a = F.when(even, (s["a"] + _noise(key, tweak, r, s["b"])) % size_a).otherwise(s["a"])
        new_b = F.when(even, s["b"]).otherwise((s["b"] + _noise(key, tweak, r, s["a"])) % size_b)
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits permuted among the strings of its length."""

    def run(d: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        right = F.length(d) - left
        made = feistel(key, F.concat(F.lit(kind), F.length(d).cast("string")), F.substr(d, F.lit(1), left).cast("long"), F.substr(d, left + 1, right).cast("long"), _ten_to(left), _ten_to(right))
        return _let(made, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0")))

    return _let(digits, run)


def refill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced in order."""
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn's sum of a digit string; double_last: the last digit is doubled (it stands left of the check digit)."""
    one = lambda s, c, : F.struct((s["sum"] + F.when(s["double"], F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int"))).alias("sum"), (~s["double"]).alias("double"))
    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("sum"), F.lit(double_last).alias("double")), one, lambda s: s["sum"])


def mod97(text: Column) -> Column:
    """Letters as two-digit numbers (A is 10), the whole modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: _let(value(c), lambda v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _card(key: str, m: Column, d: Column) -> Column:
    body = lambda b: F.concat(b, F.pmod(10 - luhn_sum(b, True) % 10, F.lit(10)).cast("string"))
    return refill(m, _let(permute_digits(key, "card", F.substr(d, F.lit(1), F.length(d) - 1)), body))


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & (luhn_sum(digits, False) % 10 == 0)


def cards(key: str, m: Column) -> Column:
    """struct(kind, text) of a run of digit groups with the cards among them replaced; kind has `card` for each, with commas between."""

    def search(pieces: Column) -> Column:
        part = lambda i, n: F.array_join(F.slice(pieces, i, n), "")
        bare = lambda t: F.regexp_replace(t, "[^0-9]", "")

        def step(s: Column, i: Column) -> Column:
            lengths = F.filter(F.sequence(F.least(F.size(pieces) - i + 1, F.lit(19)), F.lit(1), F.lit(-1)), lambda n: _let(bare(part(i, n)), _is_card))
            found = lambda n: F.when(n.isNull(), F.struct(F.concat(s["out"], part(i, F.lit(1))).alias("out"), (i + 1).alias("at"), s["n"].alias("n"))).otherwise(F.struct(F.concat(s["out"], _let(part(i, n), lambda t: _card(key, t, bare(t)))).alias("out"), (i + n).alias("at"), (s["n"] + 1).alias("n")))
            return F.when(i < s["at"], s).otherwise(_let(F.get(lengths, F.lit(0)), found))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(0).alias("n"))
        kind = lambda s: F.when(s["n"] > 0, F.array_join(F.array_repeat(F.lit("card"), s["n"]), ","))
        return F.aggregate(F.sequence(F.lit(1), F.size(pieces)), start, step, lambda s: F.struct(kind(s).alias("kind"), s["out"].alias("text")))

    return _let(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), search)


def _phone(key: str, m: Column, d: Column) -> Column:
    """The first digits of area and exchange stay in 2..9 if they are; other digits are permuted freely."""
    own = F.substr(d, F.length(d) - 9, F.lit(10))

    def run(t: Column) -> Column:
        first, fourth = F.substr(t, F.lit(1), F.lit(1)).cast("long"), F.substr(t, F.lit(4), F.lit(1)).cast("long")
        low_a, low_b = F.when(first >= 2, F.lit(2)).otherwise(F.lit(0)), F.when(fourth >= 2, F.lit(2)).otherwise(F.lit(0))
        size_a, size_b = F.when(first >= 2, F.lit(8)).otherwise(F.lit(2)), F.when(fourth >= 2, F.lit(8)).otherwise(F.lit(2))
        a = (first - low_a) * 100 + F.substr(t, F.lit(2), F.lit(2)).cast("long")
        b = (fourth - low_b) * 1000000 + F.substr(t, F.lit(5), F.lit(6)).cast("long")
        made = feistel(key, F.concat_ws("-", F.lit("phone"), size_a.cast("string"), size_b.cast("string")), a, b, (size_a * 100).cast("long"), (size_b * 1000000).cast("long"))
        return _let(made, lambda s: F.concat(F.lpad((s["a"] + low_a * 100).cast("string"), 3, "0"), F.lpad((s["b"] + low_b * 1000000).cast("string"), 7, "0")))

    return refill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), _let(own, run)))


def _ssn(key: str, m: Column, d: Column) -> Column:
    area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    made = feistel(key, F.lit("ssn"), area - 1 - (area > 666).cast("long"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    return _let(made, lambda s: F.concat_ws("-", F.lpad((s["a"] + 1 + (s["a"] >= 665).cast("long")).cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0")))


def _ip(key: str, m: Column) -> Column:
    def run(o: Column) -> Column:
        part = lambda k: F.get(o, F.lit(k)).cast("long")
        made = feistel(key, F.lit("ip"), part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
        return _let(made, lambda s: F.concat_ws(".", F.floor(s["a"] / 256).cast("string"), (s["a"] % 256).cast("string"), F.floor(s["b"] / 256).cast("string"), (s["b"] % 256).cast("string")))

    return _let(F.split(m, r"\."), run)


#: Month and day where the month comes first and the day is over 12, in a leap year.
_MONTH_FIRST = [f"{m:02}/{d:02}" for m in range(1, 13) for d in range(13, monthrange(2000, m)[1] + 1)]
#: Permutations in a row until a date comes: one in 293 is 02/29 of a year without it, so that fewer than one in 10^29 dates needs more.
WALK = 12

#: 400 years have 146097 days, which is 189 * 773.
_FIRST_DAY = "1800-01-01"


def _parsed_date(m: Column) -> Column:
    """struct(day, style) with the style's date_format pattern; null if it is no date of the years 1800 to 2199."""
    year_first = F.substr(m, F.lit(5), F.lit(1)) == "-"
    dot = F.substr(m, F.lit(3), F.lit(1)) == "."
    iso = F.try_to_date(m, "yyyy-MM-dd")
    dmy, mdy = F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy")
    day = F.when(year_first, iso).when(dot, F.try_to_date(m, "dd.MM.yyyy")).otherwise(F.coalesce(dmy, mdy))
    style = F.when(year_first, F.lit("ymd")).when(dot, F.lit("d.m.y")).when(dmy.isNotNull(), F.lit("d/m/y")).otherwise(F.lit("m/d/y"))
    return F.struct(day.alias("day"), style.alias("style"))


def _date(key: str, parsed: Column) -> Column:
    n = F.datediff(parsed["day"], F.lit(_FIRST_DAY).cast("date")).cast("long")
    tweak = F.concat(F.lit("date"), parsed["style"])

    def spell(s: Column) -> Column:
        day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (s["a"] * 773 + s["b"]).cast("int"))
        return F.when(parsed["style"] == "ymd", F.date_format(day, "yyyy-MM-dd")).when(parsed["style"] == "d.m.y", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))

    def month_first() -> Column:
        """Months and days permuted with the years; what comes out as 02/29 of a common year is permuted again, which keeps it a permutation."""
        pairs, february = F.array(*[F.lit(p) for p in _MONTH_FIRST]), _MONTH_FIRST.index("02/29")
        again = lambda s: feistel(key, tweak, s["a"], s["b"], F.lit(400), F.lit(len(_MONTH_FIRST)))
        leap = lambda a: (a % 4 == 0) & ((a % 100 != 0) | (a == 200))
        begun = F.struct((F.year(parsed["day"]) - 1800).cast("long").alias("a"), (F.array_position(pairs, F.date_format(parsed["day"], "MM/dd")) - 1).alias("b"))
        made = F.aggregate(F.sequence(F.lit(1), F.lit(WALK - 1)), again(begun), lambda s, _: F.when((s["b"] != february) | leap(s["a"]), s).otherwise(again(s)))
        return _let(made, lambda s: F.concat(F.element_at(pairs, (s["b"] + 1).cast("int")), F.lit("/"), (s["a"] + 1800).cast("string")))

    return F.when(parsed["style"] == "m/d/y", month_first()).otherwise(_let(feistel(key, tweak, F.floor(n / 773), n % 773, F.lit(189), F.lit(773)), spell))


def _iban(key: str, m: Column, bare: Column) -> Column:
    tail = F.substr(bare, F.lit(5), F.length(bare) - 4)
    digits = F.regexp_replace(tail, "[^0-9]", "")
    new_tail = F.when(F.length(digits) >= 2, refill(tail, permute_digits(key, "iban", digits))).otherwise(tail)
    check = lambda t: F.concat(F.lpad((98 - mod97(F.concat(t, F.substr(bare, F.lit(1), F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), t)

    def spread(t: Column) -> Column:
        """Check digits and tail put where the letters and digits of the found text stand, behind the country."""
        step = lambda s, c: F.when(c == " ", F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s["out"], F.substr(t, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.aggregate(F.split(F.substr(m, F.lit(3), F.length(m)), ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"]))

    return _let(_let(new_tail, check), spread)


def replacement(key: str, m: Column) -> Column:
    """struct(kind, text) for a found candidate; kind is null and the text unchanged if it does not validate."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    bare = F.replace(m, F.lit(" "), F.lit(""))

    def valid(kind: Column, text: Column) -> Column:
        return F.struct(kind.alias("kind"), text.alias("text"))

    none = valid(F.lit(None).cast("string"), m)
    octets = F.forall(F.split(m, r"\."), lambda o: (o.cast("int") <= 255) & ((F.length(o) == 1) | (F.substr(o, F.lit(1), F.lit(1)) != "0")))
    sha = F.sha2(F.concat(F.lit(f"{key}|secret|"), m), 512)
    secret = F.substr(sha, F.lit(1), F.length(m))
    email = F.concat(F.lit("user-"), F.substr(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), F.lit(1), F.lit(12)), F.lit("@mail.invalid"))
    is_ssn = m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    ssn_ok = ~m.rlike("^(000|666|9)|-00-|-0000$")
    dated = lambda p: F.when(p["day"].between(F.lit(_FIRST_DAY).cast("date"), F.lit("2199-12-31").cast("date")), valid(F.lit("date"), _date(key, p))).otherwise(none)
    return (
        F.when(m.contains("@"), valid(F.lit("email"), email))
        .when(m.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$"), F.when(octets, valid(F.lit("ip"), _ip(key, m))).otherwise(none))
        .when(m.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}[/.][0-9]{4})$"), _let(_parsed_date(m), dated))
        .when(is_ssn, F.when(ssn_ok, valid(F.lit("ssn"), _ssn(key, m, digits))).otherwise(none))
        .when(m.rlike(f"^{PHONE}$"), valid(F.lit("phone"), _phone(key, m, digits)))
        .when(m.rlike("^[0-9 -]+$"), F.when(_is_card(digits), valid(F.lit("card"), _card(key, m, digits))).otherwise(cards(key, m)))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]*$") & F.length(bare).between(15, 34), F.when(mod97(F.concat(F.substr(bare, F.lit(5), F.length(bare) - 4), F.substr(bare, F.lit(1), F.lit(4)))) == 1, valid(F.lit("iban"), _iban(key, m, bare))).otherwise(none))
        .when(m.rlike("^[0-9a-f]{32,128}$"), valid(F.lit("secret"), secret))
        .when(m.rlike("^[0-9A-F]{32,128}$"), valid(F.lit("secret"), F.upper(secret)))
        .otherwise(none)
    )


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with pseudonyms in text_col, and `__pii_kinds`, the kinds replaced in order of place (empty where none).

    Null texts stay null with no kinds; texts without valid data are returned byte for byte. The rows are worked on one by one,
    without a shuffle. Names that begin with `__pii_` are reserved.
    """
    text, key = F.col(text_col), hashlib.sha256(f"pseudonyms|{key}".encode()).hexdigest()
    # The text between candidates and the candidates, by the same pattern: together they are the text.
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = docs.withColumn("__pii_found", F.coalesce(found, F.array().cast("array<string>")))
    made = F.when(F.size("__pii_found") > 0, F.transform("__pii_found", lambda m: replacement(key, m)))
    marked = marked.withColumn("__pii_made", made)
    joined = lambda parts: F.array_join(F.zip_with(parts, F.transform("__pii_made", lambda r: r["text"]), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    changed = F.exists("__pii_made", lambda r: r["kind"].isNotNull())
    marked = marked.withColumn("__pii_kinds", F.coalesce(F.filter(F.split(F.array_join(F.transform("__pii_made", lambda r: r["kind"]), ","), ","), lambda k: k != ""), F.array().cast("array<string>")))
    return marked.withColumn(text_col, F.when(changed, joined(F.split(text, ANY, -1))).otherwise(text)).drop("__pii_found", "__pii_made")
