"""Format-preserving Feistel pseudonyms for personal data (operator 1), in built-in functions only.

One pattern finds candidates; each is validated (Luhn, mod 97, calendar, octets, number ranges) and, if
valid, replaced by a keyed permutation of its value within its own format. The permutation depends on
the key and the kind alone, so equal values get equal pseudonyms in all documents and different values
different ones, and whoever holds the key can undo it. Invalid candidates stay as they are.

Spaces and signs inside a number, its country code and a trunk zero in brackets, and the case of an e-mail's
letters are layout: they stay where they are and do not change the value, so spellings of one number are
linked. An e-mail's domain stays as it is written.
Strings (e-mail local parts, phone, card and account numbers) go through a Feistel network over their
two halves: a character of one half is moved within its class (digits, letters) by a keyed hash of the
other half. Dates, IPv4 addresses and social security numbers go through one over two numbers whose
ranges multiply to exactly the number of valid values, so every result is valid again.

Dates keep whether the day is above 12, so that a day-first date still reads as one and all padded spellings of a
day are linked; dates with a one-digit part keep the number of digits of the month and the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "date", "ssn", "ip", "phone", "card")
#: Dates lie in a Gregorian cycle of 400 years.
FIRST_YEAR, YEARS = 1800, 400
_LEAP = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if y % 4 == 0 and (y % 100 or y % 400 == 0)]


def _days(months: range, days: range) -> list[str]:
    """The days (MM-dd) of a common year in these months and numbers."""
    return [f"{m:02}-{d:02}" for m in months for d in days if d <= (28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31)]


def _halves(n: int) -> tuple[int, int]:
    """The two factors of ``n`` that are closest to each other."""
    low = next(k for k in range(int(n**0.5), 0, -1) if n % k == 0)
    return low, n // low


#: Classes of dates: all with two digits, the day up to 12 or above; then with a one-digit part: month and day
#: below 10, month from 10 on, day from 10 on, and day-first ones.
_CLASSES = [_days(range(1, 13), range(1, 13)), _days(range(1, 13), range(13, 32)), _days(range(1, 10), range(1, 10)), _days(range(10, 13), range(1, 10)), _days(range(1, 10), range(10, 32)), _days(range(1, 10), range(13, 32))]
_LEAPS = [len(_LEAP) if "02-28" in c else 0 for c in _CLASSES]

#: Letters of the Latin, Greek and Cyrillic alphabets beyond ASCII, as ranges, which are tested faster than scripts.
_BEYOND = r"\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0370-\u03FF\u0400-\u052F\u1E00-\u1FFF"
#: A domain has no more than 126 labels besides the first (253 characters); of a longer one the rest
#: stays as it is, like all of the domain. Without that bound the pattern's stack would grow with the labels.
_EMAIL = rf"(?<![{_BEYOND}][._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+){{1,126}}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"
_DAYS = {s: f"[0-9]{{4}}{c}[0-9]{{2}}{c}[0-9]{{2}}|[0-9]{{1,2}}{c}[0-9]{{1,2}}{c}[0-9]{{4}}" for s, c in (("-", "-"), ("/", "/"), (".", "[.]"))}
_DATE = "|".join(_DAYS.values())
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
_IP = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: No digit, _, @ or letter of an alphabet whose words are set apart touches a value (in other scripts a value may
#: stand right beside a letter); so an address with such letters beyond ASCII stays as it is, as a whole. A sign with
#: a digit beyond it bars a value only where it could
#: carry on the same kind: 1.2.3.4:80, 1.2.3.4/24 and a date before T10:00 end there, 1.2.3.4.5 is no address.
_NEAR = f"A-Za-z0-9_@{_BEYOND}"
_HEAD, _TAIL = f"(?<![{_NEAR}])", f"(?![{_NEAR}])"


def _alone(signs: str, pattern: str, tail: str = _TAIL) -> str:
    """``pattern`` where no digit is joined to it by one of ``signs``."""
    return rf"(?<![0-9][{signs}])(?:{pattern}){tail}(?![{signs}][0-9])"


_DATES = "|".join(_alone(sign, days, f"(?![{_NEAR}&&[^Tt]])(?![Tt](?![0-9]{{2}}))") for sign, days in _DAYS.items())
_RIGID = rf"{_DATES}|{_alone('-', _SSN)}|{_alone('.', _IP)}"
#: What a number before it must not take in: other kinds, and for phones and IBANs digits laid out as a card.
_US_PHONE = r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
_CARD_LIKE = r"(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})(?![0-9])"
_NEXT = rf"(?!{_RIGID}|{_US_PHONE}(?![0-9])|{_CARD_LIKE})"
#: Lengths of IBANs by country, and of national phone numbers where a country has but one.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC"}
#: Country codes of one and two digits; all others have three.
PHONE_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
PHONE_LENGTHS = {8: "45 47 65 852", 9: "27 31 33 34 41 48 61 351 380 420", 10: "1 7 44 52 90 91", 11: "86"}


def _digits(n: int) -> str:
    return f"(?:[ .-]?[0-9]){{{n}}}"


def _phones() -> str:
    """Numbers of a country's length first; others of up to 15 digits, ended by what follows them."""
    by_length = "|".join(
        rf"[+](?:{codes.replace(' ', '|')})(?:(?:[ .-]?[(]0[)])?{_digits(n)}|{'|'.join(f'[ .-]?[(][0-9]{{{k}}}[)]{_digits(n - k)}' for k in range(1, 5))})" for n, codes in PHONE_LENGTHS.items()
    )
    step = f"(?:(?:[ .-]{_NEXT})?[0-9])"
    other = [rf"[+][0-9]{{1,3}}[ .-]?[(]0[)]{step}{{5,12}}", rf"[+][0-9]{{1,3}}[ .-]?[(][0-9]{{1,4}}[)]{step}{{3,8}}", rf"[+][0-9]{step}{{7,14}}", r"[(][0-9]{3}[)] ?[0-9]{3}[ .-][0-9]{4}", _US_PHONE]
    return "|".join(_alone(".-", x) for x in [by_length, *other])


def _ibans() -> str:
    by_length = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
    other = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?: {_NEXT})?[A-Z0-9]{{4}}){{2,7}}(?:(?: {_NEXT})?[A-Z0-9]{{1,4}})?"
    return rf"(?:{by_length}){_TAIL}|(?:{other}){_TAIL}"


#: All numbers joined by single spaces or hyphens that hold 13 digits or more: cards are sought in them.
_END = f"{_TAIL}(?![.][0-9])"
_RUN = rf"(?<![0-9][.-])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++{_END}(?:[ -](?!{_RIGID}|(?<= ){_US_PHONE}(?![0-9]))[0-9]++{_END})*+"
PATTERN = rf"{_HEAD}(?:{_EMAIL}|{_ibans()}|{_RIGID}|{_phones()}|{_RUN})"
#: Usual layouts of cards, preferred where several parts of a run have the right check digit.
_USUAL = r"[2-6][0-9]{3}(?:[0-9]{12}|( |-)[0-9]{4}[ -][0-9]{4}[ -][0-9]{4})|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|3[0689][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{4}"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _move(x: str, seed: str, sign: str) -> str:
    """``x`` with each character moved within its class by a keystream of ``seed``."""
    k = f"cast(conv(substring(sha2(concat({seed}, '|', cast(i div 16 as string)), 256), (i % 16) * 4 + 1, 4), 16, 10) as int)"
    cases = " ".join(f"WHEN c BETWEEN '{a}' AND '{z}' THEN char({ord(a)} + pmod(ascii(c) - {ord(a)} {sign} {k}, {n}))" for a, z, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)))
    return f"array_join(transform(split({x}, ''), (c, i) -> CASE {cases} ELSE c END), '')"


def _rounds(undo: bool) -> str:
    return f"sequence({ROUNDS}, 1)" if undo else f"sequence(1, {ROUNDS})"


def _string(x: str, key: str, kind: str, undo: bool) -> str:
    seed = lambda other: f"concat('{key}|{kind}|', cast(r as string), '|', {other})"
    sign = "-" if undo else "+"
    return (
        f"aggregate({_rounds(undo)}, named_struct('a', left({x}, length({x}) div 2), 'b', substring({x}, length({x}) div 2 + 1)), "
        f"(s, r) -> IF(r % 2 = 1, named_struct('a', {_move('s.a', seed('s.b'), sign)}, 'b', s.b), named_struct('a', s.a, 'b', {_move('s.b', seed('s.a'), sign)})), "
        f"s -> concat(s.a, s.b))"
    )


def _number(x: str, left: int | str, right: int | str, key: str, kind: str, undo: bool) -> str:
    """A permutation of 0 .. left * right - 1."""
    left, right, sign = f"cast({left} as bigint)", f"cast({right} as bigint)", "-" if undo else "+"
    f = lambda other: f"cast(conv(substring(sha2(concat('{key}|{kind}|', cast(r as string), '|', cast({other} as string)), 256), 1, 14), 16, 10) as bigint)"
    return (
        f"aggregate({_rounds(undo)}, named_struct('a', cast({x} as bigint) div {right}, 'b', cast({x} as bigint) % {right}), "
        f"(s, r) -> IF(r % 2 = 1, named_struct('a', pmod(s.a {sign} {f('s.b')}, {left}), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b {sign} {f('s.a')}, {right}))), "
        f"s -> s.a * {right} + s.b)"
    )


def _luhn(x: str) -> str:
    """The Luhn sum of the digits of ``x``, whose last digit counts once."""
    return f"aggregate(transform(split(reverse(regexp_replace({x}, '[^0-9]', '')), ''), (c, i) -> IF(i % 2 = 0, cast(c as int), cast(c as int) * 2 - IF(cast(c as int) > 4, 9, 0))), 0, (t, v) -> t + v)"


def _mod97(x: str) -> str:
    """``x`` modulo 97, letters counting from A = 10."""
    return f"aggregate(split(upper({x}), ''), 0, (t, c) -> IF(c BETWEEN '0' AND '9', (t * 10 + cast(c as int)) % 97, (t * 100 + ascii(c) - 55) % 97))"


def _laid(new: str, m: str) -> str:
    """The letters and digits ``new`` with the spaces and signs of ``m`` between them."""
    return f"aggregate(array({new}), '', (u, w) -> aggregate(split({m}, ''), named_struct('t', '', 'i', 1), (s, d) -> IF(d RLIKE '[A-Za-z0-9]', named_struct('t', concat(s.t, substring(w, s.i, 1)), 'i', s.i + 1), named_struct('t', concat(s.t, d), 'i', s.i)), s -> s.t))"


def _date(m: str, key: str, undo: bool) -> tuple[str, str]:
    """Whether ``m`` is a day of the cycle, and its pseudonym. The year may stand in front, the day (``30/1/2024``:
    only where it is above 12), or else the month. A date's number counts days of its class, then years; the
    29th of February comes last, by leap years."""
    of = lambda values: "CASE d.c " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
    days = of([f"split('{','.join(c)}', ',')" for c in _CLASSES])
    years = f"split('{','.join(map(str, _LEAP))}', ',')"
    common = of([YEARS * len(c) for c in _CLASSES])
    left, right = (of([_halves(YEARS * len(c) + n)[i] for c, n in zip(_CLASSES, _LEAPS, strict=True)]) for i in (0, 1))
    order = "CASE WHEN length(get(p, 0)) = 4 THEN 'y' WHEN try_cast(get(p, 0) as int) > 12 THEN 'd' ELSE 'm' END"
    part = lambda y, d, m: f"lpad(CASE o WHEN 'y' THEN get(p, {y}) WHEN 'd' THEN get(p, {d}) ELSE get(p, {m}) END, 2, '0')"
    month, day = part(1, 1, 0), part(2, 0, 1)
    kind = f"CASE WHEN length(get(p, 0)) > 1 AND length(get(p, 1)) > 1 THEN IF({day} <= '12', 0, 1) WHEN o = 'd' THEN 5 WHEN {month} >= '10' THEN 3 WHEN {day} >= '10' THEN 4 ELSE 2 END"
    struct = f"named_struct('y', try_cast(IF(o = 'y', get(p, 0), get(p, 2)) as int), 'md', concat({month}, '-', {day}), 'c', {kind})"
    leap, at = f"array_position({years}, cast(d.y as string))", f"array_position({days}, d.md)"
    number = f"CASE WHEN d.y NOT BETWEEN {FIRST_YEAR} AND {FIRST_YEAR + YEARS - 1} THEN NULL WHEN d.md = '02-29' THEN IF({leap} > 0, {common} + {leap} - 1, NULL) WHEN {at} > 0 THEN ({at} - 1) * {YEARS} + d.y - {FIRST_YEAR} END"
    bound = lambda body: _let("p", f"split({m}, '[-/.]')", _let("o", order, _let("d", struct, body)))
    new = f"IF(n < {common}, named_struct('y', cast({FIRST_YEAR} + n % {YEARS} as string), 'md', get({days}, cast(n div {YEARS} as int))), named_struct('y', get({years}, cast(n - {common} as int)), 'md', '02-29'))"
    m2, d2 = (lambda i: f"lpad(trim(LEADING '0' FROM left(e.md, 2)), length(get(p, {i})), '0')"), (lambda i: f"lpad(trim(LEADING '0' FROM right(e.md, 2)), length(get(p, {i})), '0')")
    sep = f"regexp_extract({m}, '[-/.]', 0)"
    text = f"CASE o WHEN 'y' THEN concat_ws({sep}, e.y, {m2(1)}, {d2(2)}) WHEN 'd' THEN concat_ws({sep}, {d2(0)}, {m2(1)}, e.y) ELSE concat_ws({sep}, {m2(0)}, {d2(1)}, e.y) END"
    moved = _number(number, left, right, key, "date", undo)
    return f"{bound(number)} IS NOT NULL", bound(_let("n", moved, _let("e", new, text)))


def _pseudonym(m: str, key: str, undo: bool = False) -> dict[str, tuple[str, str]]:
    """For each kind the SQL that tells if ``m`` is a valid value of it, and its pseudonym."""
    whole = lambda pattern: f"{m} RLIKE '^(?:{pattern})$'"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    bare = f"replace({m}, ' ', '')"
    at = f"instr({m}, '@')"
    local = _string(f"lower(left({m}, {at} - 1))", key, "email", undo)
    new_email = _let("u", local, f"concat(array_join(zip_with(split(u, ''), split(left({m}, {at} - 1), ''), (c, o) -> IF(o BETWEEN 'A' AND 'Z', upper(c), c)), ''), substring({m}, {at}))")
    is_date, new_date = _date(m, key, undo)
    octets = f"transform(split({m}, '[.]'), o -> cast(o as bigint))"
    ip = f"aggregate({octets}, 0L, (t, o) -> t * 256 + o)"
    new_ip = f"aggregate(array({_number(ip, 65536, 65536, key, 'ip', undo)}), '', (t, n) -> concat_ws('.', cast(n div 16777216 as string), cast(n div 65536 % 256 as string), cast(n div 256 % 256 as string), cast(n % 256 as string)))"
    area, group, serial = (f"cast(split({m}, '-')[{i}] as int)" for i in range(3))
    # 898 areas (001-899 without 666) by 99 groups, by 9,999 serials
    ssn = f"(({area} - IF({area} > 666, 2, 1)) * 99L + {group} - 1) * 9999L + {serial} - 1"
    new_ssn = f"aggregate(array({_number(ssn, 898 * 99, 9999, key, 'ssn', undo)}), '', (t, n) -> concat(lpad(cast(n div 989901 + IF(n div 989901 + 1 >= 666, 2, 1) as string), 3, '0'), '-', lpad(cast(n div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(n % 9999 + 1 as string), 4, '0')))"
    # the trunk zero of +44 (0)20 is layout, too
    trunk = f"replace({m}, '(0)', '(_)')"
    number = f"regexp_replace({trunk}, '[^0-9]', '')"
    code = f"IF({m} LIKE '+%', regexp_extract({number}, '^(?:{PHONE_CODES}|[0-9]{{3}})', 0), '')"
    phone = _let("h", f"named_struct('c', {code}, 'n', {number})", f"concat(h.c, {_string('substring(h.n, length(h.c) + 1)', key, 'phone', undo)})")
    new_phone = f"replace(aggregate(array({phone}), '', (t, c) -> {_laid('c', trunk)}), '(_)', '(0)')"
    card = f"concat(left({digits}, 1), {_string(f'substring({digits}, 2, length({digits}) - 2)', key, 'card', undo)})"
    checked = f"concat(c, cast((10 - {_luhn("concat(c, '0')")} % 10) % 10 as string))"
    new_card = f"aggregate(array({card}), '', (t, c) -> {_laid(checked, m)})"
    iban = _string(f"substring({bare}, 5)", key, "iban", undo)
    checked = f"concat(left({m}, 2), lpad(cast(98 - {_mod97(f"concat(c, left({m}, 2), '00')")} as string), 2, '0'), c)"
    new_iban = f"aggregate(array({iban}), '', (t, c) -> {_laid(checked, m)})"
    return {
        "email": (f"{at} > 0", new_email),
        "iban": (f"{whole(_IBAN)} AND length({bare}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substring({bare}, 5), left({bare}, 4))')} = 1", new_iban),
        "date": (f"{whole(_DATE)} AND {is_date}", new_date),
        "ssn": (f"{whole(_SSN)} AND {area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0", new_ssn),
        "ip": (f"{whole(_IP)} AND NOT exists({octets}, o -> o > 255)", new_ip),
        "phone": (f"({m} RLIKE '^[+(]' OR {whole(_US_PHONE)}) AND length({digits}) BETWEEN 8 AND 15", new_phone),
        "card": (f"{whole(_CARD)} AND {digits} NOT RLIKE '^0+$' AND {_luhn(m)} % 10 = 0", new_card),
    }


def _parts(m: str, key: str) -> str:
    """SQL for ``m`` cut into structs (m, k): values with their kind, and what lies between them with none.

    Most matches are one value. In others an IBAN may end at any group, and a card lie between any two
    groups of a run. Of overlapping valid ones the IBAN goes first, then cards in a usual layout, the whole, and
    then the leftmost and longest.
    """
    tests = {k: test for k, (test, _) in _pseudonym(m, key).items()}
    plain = "CASE " + " ".join(f"WHEN {tests[k]} THEN '{k}'" for k in KINDS if k not in ("iban", "card")) + " END"
    valid = {k: test for k, (test, _) in _pseudonym("c.v", key).items()}
    none = "cast(array() as array<struct<m:string,k:string>>)"
    kind = f"CASE WHEN c.i = 0 AND {valid['iban']} THEN 'iban' WHEN c.v RLIKE '^(?:{_CARD})$' AND {valid['card']} THEN 'card' END"
    text = lambda i, n: f"array_join(slice(g, {i} + 1, {n}), '')"
    at = f"transform(sequence(i, least(i + 18, size(g) - 1)), j -> named_struct('i', i, 'j', j, 'v', regexp_replace({text('i', 'j - i + 1')}, '[ -]$', '')))"
    rank = f"CASE WHEN c.v RLIKE '^[A-Z]' THEN 0 WHEN c.v RLIKE '^(?:{_USUAL})$' THEN 1 WHEN c.i = 0 AND c.j = size(g) - 1 THEN 2 ELSE 3 END"
    found = f"flatten(transform(sequence(0, size(g) - 1), i -> filter(transform({at}, c -> named_struct('r', {rank}, 'i', c.i, 'back', -c.j, 'v', c.v, 'k', {kind})), c -> c.k IS NOT NULL)))"
    taken = f"aggregate(array_sort({found}), filter({found}, c -> false), (t, c) -> IF(exists(t, x -> c.i <= -x.back AND -c.back >= x.i), t, array_append(t, c)))"
    ordered = f"array_sort({taken}, (x, y) -> x.i - y.i)"
    gap = lambda until: f"IF({until} > s.at, array(named_struct('m', {text('s.at', f'{until} - s.at')}, 'k', cast(null as string))), {none})"
    tail = f"substring({text('c.i', '1 - c.back - c.i')}, length(c.v) + 1)"
    cut = (
        f"aggregate({ordered}, named_struct('at', 0, 'p', {none}), (s, c) -> named_struct('at', 1 - c.back, 'p', concat(s.p, {gap('c.i')}, array(named_struct('m', c.v, 'k', c.k), named_struct('m', {tail}, 'k', cast(null as string))))), "
        f"s -> concat(s.p, {gap('size(g)')}))"
    )
    split = f"flatten(transform(array(split({m}, '(?<=[ -])')), g -> {cut}))"
    searched = f"{m} RLIKE '^[A-Z]{{2}}[0-9]{{2}}[^@]*$' OR {m} RLIKE '^{_CARD}' AND NOT {m} RLIKE '[./@]'"
    return f"flatten(transform(array({plain}), p -> IF(p IS NULL AND ({searched}), {split}, array(named_struct('m', {m}, 'k', p)))))"


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "tidemark", undo: bool = False) -> DataFrame:
    """id, ``text`` with pseudonyms, and the number of values replaced of each kind (``n_email`` ...).

    A projection: no shuffle, no Python. Texts without a digit or @ are not searched further. A null text
    comes out empty; all rows stay. IPv4 octets are written without leading zeros. ``key`` is secret; it
    must hold no quotes or backslashes. ``undo`` turns pseudonyms back into values: exactly, where the same
    values are found in the text as before; only in runs of numbers may another part look like a card.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key must not hold quotes or backslashes")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), found.alias("__found"))
    named = base.withColumn("__kinds", F.expr(f"transform(__found, m -> {_parts('m', key)})"))
    made = "CASE x.k " + " ".join(f"WHEN '{k}' THEN {new}" for k, (_, new) in _pseudonym("x.m", key, undo).items()) + " ELSE x.m END"
    new = F.when(F.size("__found") == 0, F.col("__text")).otherwise(
        F.array_join(F.zip_with(F.split("__text", PATTERN, -1), F.concat(F.expr(f"transform(__kinds, p -> array_join(transform(p, x -> {made}), ''))"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    )
    n = [F.expr(f"cast(size(filter(flatten(__kinds), h -> h.k = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return named.select(F.col("__id").alias(id_col), new.alias("text"), *n)


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per row of ``documents``: doc_id, the text with pseudonyms and the values replaced of each kind."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
