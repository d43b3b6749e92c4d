"""PII: format-preserving Feistel pseudonyms, in built-in functions only.

Numbers that pass their own check (Luhn, mod 97, octet range, calendar) and dates are
replaced by a keyed permutation inside the same format: equal values get equal
pseudonyms in every document, different values different ones, and lengths,
separators, check digits and calendar validity stay. E-mail addresses and the
values of token assignments, which have no numeric domain, get keyed digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import free_name

ROUNDS = 10
#: Steps until a number is valid again: one in nine misses, so the chance of none in so many is below 1e-22.
WALK = 24
#: Days of a window of dates, as the sizes of a permutation's halves.
DATE_WINDOW = (50, 80)
#: What a candidate looks like. Every alternative starts at a boundary and has
#: bounded repeats, so that one very long word costs linear time.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET_NAME = r"(?:token|secret|passwd|password|api_key|apikey|TOKEN|SECRET|PASSWORD|API_KEY)\s{0,2}[=:]\s{0,2}[\"']?"
SECRET = rf"(?<![A-Za-z0-9]){SECRET_NAME}[A-Za-z0-9_+/-]{{16,128}}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE_ISO = r"(?<![\d/-])\d{4}(?:-\d{2}-|/\d{2}/)\d{2}(?![\d/-])"
DATE_DOTS = r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)"
DATE_US = r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
PHONE = r"\+\d{1,3}[ -]?(?:\(\d{2,4}\)|\d{2,4})[ -]\d{3}[ -]\d{4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)"
NUMBERS = "|".join([IPV4, DATE_ISO, DATE_DOTS, DATE_US, PHONE, SSN, CARD])
CANDIDATE = rf"(?=[0-9+(])(?:{NUMBERS})|(?=[A-Za-z0-9._%+-])(?:{EMAIL}|{SECRET}|{IBAN})"
#: every candidate holds one of these
SIGN = rf"@|[0-9][0-9 .()/-]{{1,3}}[0-9]|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]|{SECRET_NAME}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _power(k: Column) -> Column:
    return F.pow(F.lit(10.0), k).cast("bigint")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tag: Column) -> Column:
    """Keyed permutation of the pairs `left` in [0, left_size), `right` in [0, right_size).

    Each round adds a keyed digest of one half to the other, modulo its size, so the
    step can be undone and no value leaves its domain. Returns struct(l, r).
    """

    def digest(i: Column, x: Column) -> Column:
        text = F.concat_ws(":", F.lit(key), tag, i.cast("string"), x.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")

    def step(state: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0,
            F.struct(
                ((state["l"] + digest(i, state["r"]) % left_size) % left_size).alias("l"), state["r"].alias("r")
            ),
        ).otherwise(
            F.struct(
                state["l"].alias("l"), ((state["r"] + digest(i, state["l"]) % right_size) % right_size).alias("r")
            )
        )

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A digit string of 2 to 18 digits to another of the same length."""
    k = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - k
    state = feistel(
        F.substring(digits, F.lit(1), k),
        F.substring(digits, k + 1, rest),
        _power(k),
        _power(rest),
        key,
        F.concat(F.lit(f"{tag}"), F.length(digits).cast("string")),
    )
    return let(state, lambda s: F.concat(F.lpad(s["l"].cast("string"), k, "0"), F.lpad(s["r"].cast("string"), rest, "0")))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(pattern: Column, digits: Column) -> Column:
    """`pattern` with its digits replaced in order by `digits`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            (state["at"] + is_digit.cast("int")).alias("at"),
        )

    chars = F.filter(F.split(pattern, ""), lambda c: c != "")
    return F.aggregate(chars, start, step, lambda state: state["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; `doubled` is the parity, counted from the right from 0, of the doubled digits."""
    n = F.length(digits)
    chars = F.filter(F.split(digits, ""), lambda c: c != "")
    values = F.transform(
        chars,
        lambda c, i: let(
            c.cast("int") * F.when((n - 1 - i) % 2 == doubled, 2).otherwise(1),
            lambda v: F.when(v > 9, v - 9).otherwise(v),
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def mod_97(text: Column) -> Column:
    """Remainder of an account number with letters read as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(chars, F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        full = let(
            body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string"))
        )
        return F.when((luhn_sum(d, 1) % 10 == 0) & ~d.rlike("^0+$"), let(full, lambda f: refill(m, f))).otherwise(m)

    return let(_digits(m), replaced)


def _phone(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        head = F.greatest(F.length(d) - 10, F.lit(0))
        body = permute_digits(F.substring(d, head + 1, F.length(d) - head), key, "phone")
        return let(F.concat(F.substring(d, F.lit(1), head), body), lambda f: refill(m, f))

    return let(_digits(m), replaced)


def _ssn(m: Column, key: str) -> Column:
    """Permuted until the result is valid again: a permutation of the valid numbers."""
    unused = r"^(?:000|666|9)|^\d{3}00|0000$"

    def walked(d: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(WALK)),
            permute_digits(d, key, "ssn"),
            lambda x, _: F.when(x.rlike(unused), permute_digits(x, key, "ssn")).otherwise(x),
        )

    return let(
        _digits(m), lambda d: F.when(d.rlike(unused), m).otherwise(let(walked(d), lambda f: refill(m, f)))
    )


def _ipv4(m: Column, key: str) -> Column:
    """Octets written with zeros in front get their pseudonym's octet so, too."""

    def replaced(written: Column) -> Column:
        o = F.transform(written, lambda x: x.cast("int"))
        size = F.lit(65536).cast("bigint")
        state = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], size, size, key, F.lit("ipv4"))

        def octet(value: Column, i: int) -> Column:
            text = value.cast("string")
            return F.when(written[i].rlike("^0[0-9]"), F.lpad(text, 3, "0")).otherwise(text)

        masked = let(
            state,
            lambda s: F.concat_ws(
                ".",
                *[octet(x, i) for i, x in enumerate(y for h in (s["l"], s["r"]) for y in (F.floor(h / 256), h % 256))],
            ),
        )
        return F.when(F.forall(o, lambda x: x <= 255), masked).otherwise(m)

    return let(F.split(m, r"\."), replaced)


def _iban(m: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        head = F.length(d) - F.least(F.length(d), F.lit(18))
        return let(
            F.concat(
                F.substring(d, F.lit(1), head),
                permute_digits(F.substring(d, head + 1, F.least(F.length(d), F.lit(18))), key, "iban"),
            ),
            lambda f: let(refill(F.substring(m, F.lit(5), F.length(m)), f), with_check),
        )

    def with_check(body: Column) -> Column:
        country = F.substring(m, 1, 2)
        check = 98 - mod_97(F.concat(body, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)

    digits = _digits(F.substring(m, F.lit(5), F.length(m)))
    valid = (mod_97(F.concat(F.substring(m, F.lit(5), F.length(m)), F.substring(m, 1, 4))) == 1) & (F.length(digits) > 1)
    return F.when(valid, let(digits, replaced)).otherwise(m)


def _date(m: Column, key: str, pattern: str) -> Column:
    """Days of a window of 4,000 (about eleven years) are permuted, so a date stays in its window."""
    left, right = DATE_WINDOW

    def replaced(day: Column) -> Column:
        number = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
        window = F.floor(number / (left * right)).cast("bigint")
        index = number - window * (left * right)
        state = feistel(
            F.floor(index / right),
            index % right,
            F.lit(left).cast("bigint"),
            F.lit(right).cast("bigint"),
            key,
            F.concat(F.lit("date"), window.cast("string")),
        )
        masked = let(state, lambda s: F.date_add(day, (s["l"] * right + s["r"] - index).cast("int")))
        ok = day.isNotNull() & F.year(day).between(100, 9699)
        return F.when(ok, F.date_format(masked, pattern)).otherwise(m)

    return let(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), replaced)


def _pseudonym(m: Column, key: str) -> Column:
    def digest(n: Column) -> Column:
        return F.substring(F.repeat(F.sha2(F.concat(F.lit(key + ":text:"), m), 256), 2), F.lit(1), n)

    name = F.regexp_extract(m, rf"^{SECRET_NAME}(?=[A-Za-z0-9_+/-]{{16}})", 0)
    return (
        F.when(name != "", F.concat(name, digest(F.length(m) - F.length(name))))
        .when(m.contains("@"), F.concat(F.lit("user"), digest(F.lit(12)), F.lit("@example.invalid")))
        .when(m.rlike(_whole(IPV4)), _ipv4(m, key))
        .when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), _date(m, key, "yyyy-MM-dd"))
        .when(m.rlike(r"^\d{4}/\d{2}/\d{2}$"), _date(m, key, "yyyy/MM/dd"))
        .when(m.rlike(r"^\d{2}\.\d{2}\.\d{4}$"), _date(m, key, "dd.MM.yyyy"))
        .when(m.rlike(r"^\d{2}/\d{2}/\d{4}$"), _date(m, key, "MM/dd/yyyy"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(m.rlike(_whole(PHONE)), _phone(m, key))
        .when(m.rlike(r"^\d[\d -]{12,36}$"), _card(m, key))
        .when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), _iban(m, key))
        .otherwise(m)
    )


def pseudonymise(
    docs: DataFrame, key: str = "corpus", column: str = "text", count: str = "n_replaced"
) -> DataFrame:
    """All columns, with `column` masked and the number of replaced values added as `count` (bigint).

    A column that is called `count` keeps its name; the number then gets underscores before its own.
    Kept as they are: the country digits of a phone number, the first digits of an account
    number of more than 18, and dates before the year 100 or after 9699.
    Null stays null and an empty text empty, with 0 replaced. Candidates that fail
    their check stay as they are. The result of a row depends on its text and `key`
    alone, so repeated rows and values stay equal. `key` is the secret; the default
    is for tests.
    """
    count = free_name(docs.columns, count)
    text = F.col(column)
    found = F.when(text.rlike(SIGN), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))

    def masked(m: Column) -> Column:
        return let(
            F.transform(m, lambda x: _pseudonym(x, key)),
            lambda new: F.struct(
                F.array_join(
                    F.zip_with(
                        F.split(text, CANDIDATE, -1), new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
                    ),
                    "",
                ).alias("text"),
                F.aggregate(
                    F.zip_with(m, new, lambda a, b: (a != b).cast("bigint")),
                    F.lit(0).cast("bigint"),
                    lambda a, b: a + b,
                ).alias("n"),
            ),
        )

    result = let(found, lambda m: F.when(F.size(m) > 0, masked(m)))
    masked_text = free_name(docs.columns, "masked")
    out = docs.withColumn(masked_text, result)
    return out.select(
        *[
            F.coalesce(F.col(f"{masked_text}.text"), F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.coalesce(F.col(f"{masked_text}.n"), F.lit(0).cast("bigint")).alias(count),
    )
