"""Personal data under format-preserving pseudonyms, with built-in expressions only.

Found values keep their format: digits are permuted by a keyed Feistel network over numbers of the same length,
card numbers and IBANs get new check digits, dates are permuted within the days of the calendar and written as they
were, social security numbers within the numbers that can be given out. E-mail addresses are one as lower and
upper case; their letters and digits are permuted place by place (the local part by host), and ``.invalid`` is
added. The key decides the pseudonym, so equal values stay equal in all documents, unequal ones unequal, and whoever
holds the key can undo it. Only credentials are hashed: they keep prefix and length, become hexadecimal, cannot be
undone, and short passwords may meet. Numbers count as found when they are valid (check digits,
calendar, ranges); the rest of the text is untouched. A document is handled as one row: it is split at the finds,
these are replaced one by one, and the pieces are joined again, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import whole

#: Stands in for the secret of a deployment.
KEY = "pseudonyms"
ROUNDS = 6

# Fixed formats, one alternative per kind. Order decides where two begin at the same place.
# Parts of an address are bounded (256 before the @, labels of 63, 127 labels: more than mail can have), so that neither a long
# word nor a long host costs more than its length times a bound.
_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,63}"
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})"
_IP = r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}"
_KEY_ID = "AKIA[0-9A-Z]{16}"
_HEX = "[0-9a-f]{32,128}"
_PASSWORD = "(?i:password|passwd|pwd)[=:][^ \t\n\r\"']+"
_SSN = r"\d{3}-\d{2}-\d{4}"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
_CARD = r"(?:\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})"
_PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}|\+\d{8,15}"
FOUND = rf"{_EMAIL}|{_PASSWORD}|(?<![\w.+-])(?:{_KEY_ID}(?!\w)|{_HEX}(?!\w)|{_IBAN}|{_DATE}(?![\w/-])|{_SSN}(?![\w-])|{_IP}(?!\.?\w)|{_CARD}(?![\w])|{_PHONE}(?!\w))|(?<![\w.+-])\((?:\d{{3}})\) ?\d{{3}}-\d{{4}}"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _round(half: str, n: str, i: int, key: str) -> str:
    """A keyed number below 10^14 from one half."""
    return f"cast(conv(substr(sha2(concat('{key}|{i}|', {n}, '|', {half}), 256), 1, 12), 16, 10) as bigint)"


def feistel(digits: str, key: str = KEY) -> str:
    """SQL of a keyed permutation of the strings of as many digits (2 to 36). Halves of a and b digits take turns: each
    round adds a keyed number made of one half to the other, modulo its own power of ten, so it can be undone."""
    a, b = f"length({digits}) div 2", f"(length({digits}) - length({digits}) div 2)"
    state = f"named_struct('l', cast(substr({digits}, 1, {a}) as bigint), 'r', cast(substr({digits}, {a} + 1) as bigint))"
    steps = "sequence(0, %d)" % (ROUNDS - 1)
    seed = f"sha2(concat('{key}|', s.i, '|', length({digits}), '|', if(s.i % 2 = 0, s.r, s.l)), 256)"
    number = f"cast(conv(substr({seed}, 1, 12), 16, 10) as bigint)"
    body = (f"named_struct('i', s.i + 1, 'l', if(s.i % 2 = 0, (s.l + {number}) % cast(pow(10, {a}) as bigint), s.l), "
            f"'r', if(s.i % 2 = 0, s.r, (s.r + {number}) % cast(pow(10, {b}) as bigint)))")
    start = f"named_struct('i', 0, 'l', {state}.l, 'r', {state}.r)"
    end = f"concat(lpad(cast(s.l as string), {a}, '0'), lpad(cast(s.r as string), {b}, '0'))"
    return f"aggregate({steps}, {start}, (s, k) -> {body}, s -> {end})"


def _permuted(x: str, key: str, tweak: str) -> str:
    """SQL of a keyed permutation of strings: letters stay letters of their case, digits digits, all else stays. Feistel
    with halves of characters: each round moves one half's within their kinds by a keyed amount made of the other half."""
    bits = f"sha2(concat('{key}|', s.i, '|', length(s.l), '|', length(s.r), '|', {tweak}, '|', if(s.i % 2 = 0, s.r, s.l)), 512)"
    amount = "cast(conv(substr(bits, 4 * (j % 32) + 1, 4), 16, 10) as int)"
    kind = lambda first, n: f"char({ord(first)} + (ascii(c) - {ord(first)} + {amount}) % {n})"
    moved = f"case when c between '0' and '9' then {kind('0', 10)} when c between 'a' and 'z' then {kind('a', 26)} when c between 'A' and 'Z' then {kind('A', 26)} else c end"
    move = f"element_at(transform(array({bits}), bits -> array_join(transform(split(if(s.i % 2 = 0, s.l, s.r), ''), (c, j) -> {moved}), '')), 1)"
    body = f"element_at(transform(array({move}), m -> named_struct('i', s.i + 1, 'l', if(s.i % 2 = 0, m, s.l), 'r', if(s.i % 2 = 0, s.r, m))), 1)"
    start = f"named_struct('i', 0, 'l', substr({x}, 1, length({x}) div 2), 'r', substr({x}, length({x}) div 2 + 1))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, k) -> {body}, s -> concat(s.l, s.r))"


def _mod97(x: str) -> str:
    """An IBAN's remainder: letters count as 10 to 35, the first four characters last; 1 for valid ones."""
    return f"aggregate(split(concat(substr({x}, 5), substr({x}, 1, 4)), ''), 0, (t, c) -> case when c = '' then t when c between '0' and '9' then (t * 10 + cast(c as int)) % 97 else (t * 100 + ascii(c) - 55) % 97 end)"


def _iban(x: str, key: str) -> str:
    """The find with its longest valid beginning (words in capitals may follow) replaced, spaces kept."""
    prefix = f"replace(substr({x}, 1, p), ' ', '')"
    cut = f"array_max(filter(sequence(1, length({x})), p -> p > 14 and substr({x}, p + 1, 1) in ('', ' ') and {_mod97(prefix)} = 1))"
    compact = f"replace(substr({x}, 1, n), ' ', '')"
    body = f"element_at(transform(array(substr({compact}, 5)), b -> {_permuted('b', key + '|iban', f'substr({x}, 1, 2)')}), 1)"
    unchecked = f"concat(substr({x}, 1, 2), '00', b)"
    whole = f"concat(substr({x}, 1, 2), lpad(cast(98 - {_mod97(unchecked)} as string), 2, '0'), b)"
    spaced = f"array_join(transform(sequence(1, n), p -> if(substr({x}, p, 1) = ' ', ' ', substr(w, length(replace(substr({x}, 1, p), ' ', '')), 1))), '')"
    new = f"element_at(transform(transform(array({body}), b -> {whole}), w -> {spaced}), 1)"
    return f"element_at(transform(array({cut}), n -> if(n is null, {x}, concat({new}, substr({x}, n + 1)))), 1)"


def _ssn_valid(d: str) -> str:
    return f"(substr({d}, 1, 3) not in ('000', '666') and substr({d}, 1, 1) <> '9' and substr({d}, 4, 2) <> '00' and substr({d}, 6) <> '0000')"


def _phone_valid(x: str, d: str) -> str:
    """International numbers with + (8 to 15 digits, no country code begins with 0), national ones that begin with 0
    (9 to 11 digits) or with an area code in brackets, and three, three and four digits of which the first two groups
    begin with 2 to 9. Other groups of digits are no telephone numbers."""
    international = f"({x} rlike '^[+][1-9]' and length({d}) between 8 and 15)"
    national = f"({x} rlike '^([(]0|0)[1-9]' and length({d}) between 9 and 11)"
    return f"({international} or {national} or {x} rlike '^[(][0-9]{{2,4}}[)]' or {x} rlike '^[2-9][0-9][0-9][ .-][2-9][0-9][0-9][ .-][0-9]{{4}}$')"


def _in_format(x: str, digits: str) -> str:
    """The digits of x replaced in order by other digits, everything else kept."""
    return f"array_join(transform(sequence(1, length({x})), p -> if(substr({x}, p, 1) between '0' and '9', substr({digits}, length({_digits(f'substr({x}, 1, p)')}), 1), substr({x}, p, 1))), '')"


def luhn_sum(digits: str) -> str:
    """Weighted digit sum; 0 modulo 10 for valid numbers."""
    d = f"cast(substr({digits}, length({digits}) - p, 1) as int)"
    return f"aggregate(transform(sequence(0, length({digits}) - 1), p -> if(p % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))), 0, (t, v) -> t + v)"


#: Days of the calendar that dates are permuted in: 1900-01-01 and the 73,049 days to 2099-12-31.
_FIRST_DAY, _DAYS = "1900-01-01", 73049


def _day_permuted(day: str, key: str) -> str:
    """A keyed permutation of 0 .. _DAYS - 1: Feistel over five digits, again while the result is no day (cycle
    walking; 40 steps leave one in 10^22 days, which then keeps its last value modulo the range)."""
    step = feistel("lpad(cast(d.v as string), 5, '0')", key + "|day")
    walk = f"aggregate(sequence(1, 40), named_struct('v', cast({day} as int), 'n', 0), (d, k) -> if(d.n > 0 and d.v < {_DAYS}, d, named_struct('v', cast({step} as int), 'n', d.n + 1)), d -> d.v % {_DAYS})"
    return walk


def pseudonym(x: str, key: str = KEY) -> str:
    """SQL of the pseudonym of a find, or of the find itself where it is not valid."""
    d = _digits(x)
    card = f"concat(c, cast((10 - ({luhn_sum('concat(c, ' + chr(39) + '0' + chr(39) + ')')} % 10)) % 10 as string))"
    card = f"element_at(transform(array({feistel(f'substr({d}, 1, length({d}) - 1)', key)}), c -> {card}), 1)"
    iso = f"{x} rlike '^[0-9]{{4}}-'"
    form = lambda first, second: f"concat('{first}', substr({x}, 3, 1), '{second}', substr({x}, 6, 1), 'yyyy')"
    form = f"case when {iso} then 'yyyy-MM-dd' when try_to_timestamp({x}, {form('dd', 'MM')}) is not null then {form('dd', 'MM')} else {form('MM', 'dd')} end"
    number = f"datediff(try_to_timestamp({x}, {form}), date'{_FIRST_DAY}')"
    date = f"coalesce(if({number} between 0 and {_DAYS - 1}, date_format(date_add(date'{_FIRST_DAY}', {_day_permuted(number, key)}), {form}), null), {x})"
    octets = (f"array_join(transform(split({x}, '[.]'), (o, i) -> cast((cast(o as int) + cast(conv(substr(sha2(concat('{key}|ip|', i, '|', array_join(slice(split({x}, '[.]'), 1, i), '.')), 256), 1, 8), 16, 10) as bigint)) % 256 as string)), '.')")
    secret = f"sha2(concat('{key}|secret|', regexp_replace({x}, '^[a-zA-Z]+[=:]', '')), 256)"
    parts = f"named_struct('user', lower(substring_index({x}, '@', 1)), 'host', lower(regexp_replace(substring_index({x}, '@', -1), '[.][^.]*$', '')), 'top', lower(substring_index({x}, '.', -1)))"
    mail = f"element_at(transform(array({parts}), m -> concat({_permuted('m.user', key + '|mail', 'm.host')}, '@', {_permuted('m.host', key + '|host', 'm.top')}, '.', m.top, '.invalid')), 1)"
    # Again while the result cannot be given out (cycle walking; 20 steps leave one in 10^19).
    ssn = f"aggregate(sequence(1, 20), named_struct('v', {d}, 'n', 0), (w, k) -> if(w.n > 0 and {_ssn_valid('w.v')}, w, named_struct('v', {feistel('w.v', key + '|ssn')}, 'n', w.n + 1)), w -> w.v)"
    ssn = f"if({_ssn_valid(d)}, element_at(transform(array({ssn}), v -> concat(substr(v, 1, 3), '-', substr(v, 4, 2), '-', substr(v, 6))), 1), {x})"
    plain = f"element_at(transform(array({x}), y -> {_in_format('y', feistel(_digits('y'), key))}), 1)"
    return f"""case
        when {x} rlike '^{_EMAIL.replace(chr(92), chr(92) * 2)}$' then {mail}
        when {x} rlike '^{_KEY_ID}$' then concat('AKIA', upper(substr({secret}, 1, 16)))
        when {x} rlike '^{_HEX}$' then substr(concat({secret}, sha2({secret}, 256)), 1, length({x}))
        when {x} rlike '^[a-zA-Z]+[=:]' then concat(regexp_substr({x}, '^[a-zA-Z]+[=:]'), substr(repeat({secret}, 1 + length({x}) div 64), 1, length({x}) - length(regexp_substr({x}, '^[a-zA-Z]+[=:]'))))
        when {x} rlike '^{_DATE}$' then {date}
        when {x} rlike '^{_IP}$' then if(forall(split({x}, '[.]'), o -> cast(o as int) < 256), {octets}, {x})
        when {x} rlike '^[A-Z][A-Z][0-9]' then {_iban(x, key)}
        when {x} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn}
        when length({d}) between 13 and 19 and {x} rlike '^[0-9]' and {luhn_sum(d)} % 10 = 0 then {_in_format(x, card)}
        when length({d}) between 13 and 19 and {x} rlike '^[0-9]' then {x}
        when length({d}) between 7 and 15 and {_phone_valid(x, d)} then {plain}
        else {x} end"""


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """All columns of ``docs`` with finds replaced in the text, ``n_found`` (finds that were replaced).

    A missing text stays missing with 0 finds; an empty one stays empty. Equal finds get equal pseudonyms in all
    rows, repeated or not. A column ``n_found`` of ``docs`` is replaced. An empty table gives an empty result."""
    finds = F.regexp_extract_all(whole(text), F.lit(FOUND), F.lit(0))
    out = docs.withColumn("__finds", finds)
    out = out.withColumn("__new", F.expr(f"transform(__finds, x -> {pseudonym('x', key)})"))
    gaps = F.split(whole(text), FOUND, -1)
    body = F.when(F.size("__finds") == 0, F.col(text)).otherwise(F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("__new")), "__new", lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1)))
    n = F.size(F.filter(F.zip_with("__finds", "__new", lambda a, b: a != b), lambda c: c)).cast("long")
    return out.withColumns({text: body, "n_found": n}).drop("__finds", "__new")
