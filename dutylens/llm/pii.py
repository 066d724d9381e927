"""Format-preserving Feistel pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates; each is validated (Luhn sum, octets up to 255, existing dates, IBAN remainder, digit
counts) and, if valid, replaced by a keyed permutation within its own format. Equal values get equal pseudonyms in
every document, different values of a kind different ones, and a holder of the key can invert them.

* card: of a run of digit groups, the groups that form a valid number (unbroken or in a card's usual layout before
  others, then from the left the longest); the first digit stays, the inner digits are permuted, the check digit is computed anew;
* IPv4: the 32 bits as two halves; * phone: the digits after the country code;
* SSN: its digits, permuted again until it is one that can be given out;
* IBAN: country stays, the account's digits and letters are permuted, the check digits are computed anew;
* date: the day within its century is permuted on Z_a x Z_b with a*b days (92*397, or 75*487 with a leap
  century), so that dates stay dates; a date with slashes is month first if it can be, and one that can't is permuted again until
  it can't either, so that the two layouts don't meet;
* e-mail: letters and digits of the local part; * quoted hexadecimal secrets of 32 or more digits, as in `token = "..."`.

"Again until" goes up to WALK times; more than half of all values are right at each time, so that it ends long before.

Strings are permuted by an alternating Feistel network over two halves: each round adds digits of a SHA-256 of key,
round and other half to the characters of one half, each within its own class (digits, small, capital letters).

Cases: null texts stay null, empty and long texts go through whole; what is not valid stays as it is; other
columns are not touched, whatever their names; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutylens.llm.common import free_name

ROUNDS = 8
WALK = 64
DIGITS = "0123456789"
SMALL = "abcdefghijklmnopqrstuvwxyz"
LARGE = SMALL.upper()
HEX = "abcdef"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])|(?<![\w+.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
ISO_DATE = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])"
DOT_DATE = r"(?<![\w.])\d{2}\.\d{2}\.\d{4}(?!\w)"
SLASH_DATE = r"(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: Digit groups joined by single blanks and hyphens, up to where something else than a card starts.
GROUPS = r"\d{1,19}+(?:-\d{1,19}+)*+(?!\w|[.-]\d)"
CARD = r"(?<![\w.])(?=\d(?:[ -]?\d){12})" + GROUPS + "(?: (?!" + "|".join((ISO_DATE, SLASH_DATE, SSN, PHONE)) + ")" + GROUPS + ")*+"
SECRET = r"(?<=[\"'])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?=[\"'])"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IPV4, ISO_DATE, DOT_DATE, SLASH_DATE, SSN, PHONE, IBAN, CARD))


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _below(n: Column | int, digest: Column) -> Column:
    """A number from 0 to n - 1, from 60 bits of a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def _half(parts: list, digest: Column, half: Column) -> Column:
    """half with digits of the digest added to each character within its class."""

    def moved(j: Column) -> Column:
        c = F.substring(half, j, F.lit(1))
        by = F.conv(F.substring(digest, F.pmod((j - 1) * 2, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int") + j
        out = c
        for alphabet in parts:
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), F.pmod(at - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), moved), ""))


def permute(s: Column, key: str, kind: str, parts: list[str]) -> Column:
    """The keyed permutation of all strings with the classes of s, place by place."""
    cut = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))
    step = lambda x, i: F.struct(x["b"].alias("a"), _half(parts, _digest(key, F.lit(kind), i, F.length(x["a"]), x["b"]), x["a"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda x: F.concat(x["a"], x["b"]))


def _numbers(a: Column, b: Column, na: Column | int, nb: Column | int, key: str, kind: str) -> Column:
    """A permutation of Z_na x Z_nb: struct(a, b)."""
    wide = lambda n: n if isinstance(n, Column) else F.lit(n)

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        a = F.pmod(x["a"] + _below(wide(na), _digest(key, F.lit(kind), i, x["b"])), wide(na))
        b = F.pmod(x["b"] + _below(wide(nb), _digest(key, F.lit(kind), i, x["a"])), wide(nb))
        return F.struct(F.when(even, a).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(b).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(shape: Column, values: Column, pattern: str) -> Column:
    """shape with the characters that match pattern replaced by those of values, in order."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    step = lambda x, c: F.when(c.rlike(pattern), F.struct((x["n"] + 1).alias("n"), F.concat(x["s"], F.substring(values, x["n"] + 1, F.lit(1))).alias("s"))).otherwise(F.struct(x["n"].alias("n"), F.concat(x["s"], c).alias("s")))
    return F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("s")), step, lambda x: x["s"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits from the right, every second one doubled."""

    def add(total: Column, j: Column) -> Column:
        d = F.substring(digits, F.length(digits) - j, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(j % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        inner = permute(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", [DIGITS])
        body = F.concat(F.substring(d, 1, 1), inner)
        return _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return _let(_digits(m), lambda d: F.when(_is_card(d), _refill(m, made(d), "[0-9]")).otherwise(m))


def _is_card(digits: Column) -> Column:
    return F.when(F.length(digits).between(13, 19), luhn_sum(digits) % 10 == 0).otherwise(False)


#: Digits in the groups of cards as they are usually written.
LAYOUTS = r"^(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}(\2\d{3})?|\d{4}([ -])\d{6}\4\d{4,5})[ -]?$"


def _card_pieces(run: Column) -> Column:
    """A run of digit groups cut into cards and single groups, each with the separator after it."""

    def cut(groups: Column) -> Column:
        joined = lambda i, k: F.array_join(F.slice(groups, i, k), "")
        lengths = lambda i, most: F.sequence(F.lit(1), F.least(F.size(groups) - i + 1, F.lit(most)))
        usual = lambda i: F.coalesce(F.array_max(F.filter(lengths(i, 5), lambda k: joined(i, k).rlike(LAYOUTS) & _is_card(_digits(joined(i, k))))), F.lit(0))

        def walk(usuals: Column) -> Column:
            def step(x: Column, i: Column) -> Column:
                free = F.filter(lengths(i, 19), lambda k: ~F.exists(F.slice(usuals, i + 1, k - 1), lambda u: u > 0) & _is_card(_digits(joined(i, k))))
                best = F.coalesce(F.nullif(F.get(usuals, i - 1), F.lit(0)), F.array_max(free), F.lit(1))
                return F.when(i < x["next"], x).otherwise(_let(best, lambda k: F.struct((i + k).alias("next"), F.concat(x["out"], F.array(joined(i, k))).alias("out"))))

            return F.aggregate(F.sequence(F.lit(1), F.size(groups)), F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("out")), step, lambda x: x["out"])

        return _let(F.transform(F.sequence(F.lit(1), F.size(groups)), usual), walk)

    return _let(F.regexp_extract_all(run, F.lit("[0-9]+[ -]?"), F.lit(0)), cut)


def _ip(m: Column, key: str) -> Column:
    o = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("int")
    valid = (o(0) < 256) & (o(1) < 256) & (o(2) < 256) & (o(3) < 256)
    text = lambda x: F.concat_ws(".", *[v.cast("string") for v in (F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)])
    return F.when(valid, _let(_numbers(o(0) * 256 + o(1), o(2) * 256 + o(3), 65536, 65536, key, "ip"), text)).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-])|\+\d)", 1)
    rest = F.substring(m, F.length(head) + 1, F.length(m))
    n = F.length(_digits(m))
    return F.when((n >= 7) & (n <= 15), F.concat(head, _let(rest, lambda r: _refill(r, permute(_digits(r), key, "phone", [DIGITS]), "[0-9]")))).otherwise(m)


def _again(value: Column, moved, right) -> Column:
    """moved(value), and moved again until right(value): a permutation of the right values, if moved is one of more."""
    step = lambda x, i: F.when((i > 1) & right(x), x).otherwise(moved(x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), value, step)


def _ssn(m: Column, key: str) -> Column:
    valid = lambda d: ~d.rlike("^(000|666|9)|^.{3}00|0000$")
    return _let(_digits(m), lambda d: F.when(valid(d), _refill(m, _again(d, lambda x: permute(x, key, "ssn", [DIGITS]), valid), "[0-9]")).otherwise(m))


def _iban_rest(body: Column, country: Column) -> Column:
    """The check digits of an IBAN: 98 - the number that its letters and digits form, modulo 97."""
    chars = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda c: c != "")
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.lpad((F.lit(98) - F.aggregate(chars, F.lit(0), step)).cast("string"), 2, "0")


def _iban(m: Column, key: str) -> Column:
    def made(c: Column) -> Column:
        country, check, body = F.substring(c, 1, 2), F.substring(c, 3, 2), F.substring(c, F.lit(5), F.length(c))
        new = _let(permute(body, key, "iban", [DIGITS, LARGE]), lambda b: F.concat(country, _iban_rest(b, country), b))
        return F.when(_iban_rest(body, country) == check, _refill(m, new, "[0-9A-Z]")).otherwise(m)

    return _let(F.regexp_replace(m, " ", ""), made)


def _other_day(d: Column, key: str) -> Column:
    """The day of the same century that stands for d."""
    century = F.floor(F.year(d) / 100) * 100
    first = F.make_date(century.cast("int"), F.lit(1), F.lit(1))
    leap = F.pmod(century, F.lit(400)) == 0
    na, nb = F.when(leap, 75).otherwise(92).cast("long"), F.when(leap, 487).otherwise(397).cast("long")
    n = F.datediff(d, first)
    moved = _numbers(F.floor(n / nb), F.pmod(n.cast("long"), nb), na, nb, key, "date")
    return F.date_add(first, _let(moved, lambda x: (x["a"] * nb + x["b"]).cast("int")))


def _date(m: Column, key: str, layout: str, late: bool = False) -> Column:
    """layout: yyyy-MM-dd and the like; the years 1000 to 9999. late: only days after the 12th, and only for such."""
    day = F.try_to_timestamp(m, F.lit(layout)).cast("date")
    moved = (lambda d: _again(d, lambda x: _other_day(x, key), lambda x: F.dayofmonth(x) > 12)) if late else (lambda d: _other_day(d, key))
    valid = lambda d: d.isNotNull() & (F.year(d) >= 1000) & ((F.dayofmonth(d) > 12) | F.lit(not late))
    return _let(day, lambda d: F.when(valid(d), F.date_format(moved(d), layout)).otherwise(m))


def _email(m: Column, key: str) -> Column:
    local, rest = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    return F.concat(permute(local, key, "email", [DIGITS, SMALL, LARGE]), rest)


def _secret(m: Column, key: str) -> Column:
    return permute(m, key, "secret", [DIGITS, HEX, HEX.upper()])


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one candidate, or itself if it is not valid."""
    whole = lambda p: "^(?:" + p + ")$"
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), _secret(m, key))
        .when(m.rlike(whole(IPV4)), _ip(m, key))
        .when(m.rlike(whole(ISO_DATE)), _date(m, key, "yyyy-MM-dd"))
        .when(m.rlike(whole(DOT_DATE)), _date(m, key, "dd.MM.yyyy"))
        .when(m.rlike(whole(SLASH_DATE)), F.when(F.substring(m, 1, 2) > "12", _date(m, key, "dd/MM/yyyy", late=True)).otherwise(_date(m, key, "MM/dd/yyyy")))
        .when(m.rlike(whole(SSN)), _ssn(m, key))
        .when(m.rlike(whole(PHONE)), _phone(m, key))
        .when(m.rlike("^[A-Z]{2}"), _iban(m, key))
        .otherwise(_card(m, key))
    )


def pseudonyms(m: Column, key: str) -> Column:
    """array of struct(old, new): the pieces of one candidate, which is one value but for a run of digit groups."""
    run = m.rlike(r"^[0-9][0-9 -]*$") & (F.length(_digits(m)) >= 13) & ~m.rlike("^[0-9]{32,}$")
    both = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    return F.when(run, F.transform(_card_pieces(m), lambda c: both(c, _card(c, key)))).otherwise(F.array(both(m, pseudonym(m, key))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the texts' personal data replaced; found: name of a column to add, the number of values replaced."""
    name = next((c for c in docs.columns if c.lower() == text), None)
    if name is None:
        return docs
    t = F.col(f"`{name}`").cast("string")

    def made(x: Column) -> Column:
        new = F.transform(x["m"], lambda m: pseudonyms(m, key))
        return _let(new, lambda n: F.struct(
            F.concat(F.array_join(F.zip_with(F.slice(x["p"], F.lit(1), F.size(n)), n, lambda a, b: F.concat(a, F.array_join(F.transform(b, lambda v: v["new"]), ""))), ""), F.element_at(x["p"], -1)).alias("text"),
            F.size(F.filter(F.flatten(n), lambda v: v["old"] != v["new"])).cast("long").alias("n"),
        ))

    parts = F.struct(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias("m"), F.split(t, ANY, -1).alias("p"))
    hit = t.rlike("[0-9]") & t.rlike(ANY) | t.contains("@") & t.rlike(EMAIL)
    done = F.when(hit, _let(parts, made)).otherwise(F.struct(t.alias("text"), F.lit(0).cast("long").alias("n")))
    own = free_name(docs, "done")
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns], done.alias(own))
    cols = [F.col(f"{own}.text").alias(c) if c == name else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols, *([F.col(f"{own}.n").alias(found)] if found else []))
