"""Personal data replaced by format-preserving pseudonyms.

Found values are checked (card numbers by their check digit, account numbers by their remainder, dates by the calendar,
addresses by their ranges) and then permuted by a keyed Feistel network within their format: a valid card number becomes
another valid card number of the same length, a date another date in the same notation. Where numbers stand next to each
other, the card numbers among them are found by their check digits. The permutation depends on key
and kind alone, so equal values stay equal in all documents, and different values stay different. What fails its check
stays as it is. Everything is done by built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from .columns import free, others

_ROUNDS = 8
_BETWEEN = "(?!^)(?!$)"  # the places between two characters

#: kind: pattern of candidates, behind what must not stand in front of it
_LETTERS = {"email": ("[A-Za-z0-9._%+-]", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
            "account": ("[A-Za-z0-9]", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
            "secret": ("[A-Za-z0-9]", r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:password|token) ?= ?\"?[A-Za-z0-9]{12,}\"?")}
_DIGITS = {"ip": (r"[\d.]", r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
           "date": (r"[\d./-]", r"\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./-])\d{1,2}/\d{1,2}/\d{4}(?![\d/])|(?<![\d./-])\d{1,2}\.\d{1,2}\.\d{4}(?!\.?\d)"),
           "national": (r"[\d-]", r"\d{3}-\d{2}-\d{4}(?![\d-])"),
           "phone": (r"[\w+(-]", r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\.?\d)|(?<![\w+(-])\+(?!1[ .(-])\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\.?\d)|(?<![\w+(-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\.?\d)|(?<![\w+(-])\d{3}-\d{3}-\d{4}(?![\d-])"),
           "card": (r"[\d.-]", "")}
#: Leading digits that issuers have been given, with the lengths of their numbers.
ISSUED = ("4[0-9]{12}(?:[0-9]{3}){0,2}", "5[1-5][0-9]{14}", "2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}",
          "3[47][0-9]{13}", "3(?:0[0-5]|[689][0-9])[0-9]{11,16}", "35(?:2[89]|[3-8][0-9])[0-9]{12,15}",
          "6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15}", "62[0-9]{14,17}", "(?:5018|5020|5038|5893|6304|6759|676[1-3])[0-9]{9,15}")
PATTERNS = {k: f"(?<!{before}){pattern}" for k, (before, pattern) in (_LETTERS | _DIGITS).items()}


def _either(kinds: Iterable[str]) -> str:
    return "|".join(PATTERNS[k] for k in kinds)


# all blocks of digits in a row, up to what begins another kind; which of them are a card number is decided by _cards
_BLOCK = rf"(?!{_either(k for k in PATTERNS if k != 'card')})\d++"
PATTERNS["card"] += rf"(?=(?:\d[ -]?){{13}}){_BLOCK}(?:[ -]{_BLOCK})*+"

# at most places in a text two short looks show that nothing begins there: no digit or sign, and no start of a word
_ANY = f"(?=[0-9+(])(?:{_either(_DIGITS)})|(?<![A-Za-z0-9])(?=[A-Za-z0-9._%+-])(?:{_either(_LETTERS)})"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _number(key: str, kind: str, step: Column, value: Column) -> Column:
    """A round's pseudo-random number below 2^52."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def permuted_pair(key: str, kind: str, left: Column, right: Column, n_left: int, n_right: int) -> Column:
    """``struct(l, r)``: a keyed permutation of pairs with ``0 <= left < n_left`` and ``0 <= right < n_right``."""
    def round_of(pair: Column, step: Column) -> Column:
        moved_left = (pair["l"] + _number(key, kind, step, pair["r"])) % n_left
        moved_right = (pair["r"] + _number(key, kind, step, pair["l"])) % n_right
        return F.when(step % 2 == 0, F.struct(moved_left.alias("l"), pair["r"].alias("r"))).otherwise(
            F.struct(pair["l"].alias("l"), moved_right.alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, round_of)


def _shifted(char: Column, by: Column) -> Column:
    """Moves a digit, small or capital letter around its alphabet; other characters stay."""
    code = F.ascii(char)
    return (F.when(char.rlike("^[0-9]$"), F.char(48 + (code - 48 + by) % 10))
            .when(char.rlike("^[a-z]$"), F.char(97 + (code - 97 + by) % 26))
            .when(char.rlike("^[A-Z]$"), F.char(65 + (code - 65 + by) % 26)).otherwise(char))


def permuted_text(key: str, kind: str, value: Column) -> Column:
    """A keyed permutation of strings that keeps the length and the class of each character."""
    def moved(text: Column, other: Column, step: Column) -> Column:
        def shift(char: Column, digest: Column, i: Column) -> Column:
            return _shifted(char, F.conv(F.substring(digest, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int"))

        # one digest for every 16 characters
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / 16)), lambda b: _let(F.sha2(F.concat_ws(
            ":", F.lit(key), F.lit(kind), step.cast("string"), b.cast("string"), other), 256), lambda digest: F.array_join(F.transform(
                F.split(F.substring(text, (b * 16 + 1).cast("int"), F.lit(16)), _BETWEEN), lambda c, i: shift(c, digest, i)), "")))
        return F.when(F.length(text) > 0, F.array_join(blocks, "")).otherwise(text)

    def round_of(pair: Column, step: Column) -> Column:
        return F.when(step % 2 == 0, F.struct(moved(pair["l"], pair["r"], step).alias("l"), pair["r"].alias("r"))).otherwise(
            F.struct(pair["l"].alias("l"), moved(pair["r"], pair["l"], step).alias("r")))

    def whole(text: Column) -> Column:
        half = F.ceil(F.length(text) / 2).cast("int")
        start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), start, round_of, lambda pair: F.concat(pair["l"], pair["r"]))

    return _let(value, whole)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _laid_out(value: Column, filling: Column, pattern: str) -> Column:
    """``value`` with its characters that match ``pattern`` replaced, in order, by those of ``filling``."""
    def put(new: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
        return F.aggregate(F.split(value, _BETWEEN), start, lambda state, char: F.when(char.rlike(pattern), F.struct(
            F.concat(state["out"], F.substring(new, state["next"], F.lit(1))).alias("out"),
            (state["next"] + 1).alias("next"))).otherwise(F.struct(
                F.concat(state["out"], char).alias("out"), state["next"].alias("next"))), lambda state: state["out"])

    return _let(filling, put)


def check_digit(digits: Column) -> Column:
    """The digit that makes a card number of all digits before it valid."""
    def worth(d: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.floor(2 * d / 10).cast("int") + (2 * d) % 10).otherwise(d)

    numbers = F.transform(F.split(F.reverse(digits), _BETWEEN), lambda c, i: worth(F.ascii(c) - 48, i))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x, lambda total: ((10 - total % 10) % 10).cast("string"))


def _card(key: str, value: Column) -> Column:
    """Of a valid card number; the first digit, the length and the validity of the check digit stay."""
    def of(digits: Column) -> Column:
        body = F.substring(digits, F.lit(1), F.length(digits) - 1)
        new = F.concat(F.substring(body, F.lit(1), F.lit(1)), permuted_text(
            key, "card", F.substring(body, F.lit(2), F.length(body))))
        return _let(new, lambda n: _laid_out(value, F.concat(n, check_digit(n)), "^[0-9]$"))

    return _let(_digits(value), of)


_SPANS = "array<struct<first:int,last:int>>"


def _card_spans(blocks: Column) -> Column:
    """First and last block (from 0) of each card number: 13 to 19 digits in whole blocks, in an issuer's range, that pass the check digit.

    Unbroken numbers and the usual layouts go first, then any other run of the blocks that are left, the longest first.
    """
    def valid(i: Column, j: Column) -> Column:
        def of(digits: Column) -> Column:
            size = F.length(digits)
            return F.when(size.between(13, 19) & digits.rlike(f"^(?:{'|'.join(ISSUED)})$"), check_digit(F.substring(digits, F.lit(1), size - 1)) == F.substring(
                digits, size, F.lit(1))).otherwise(F.lit(False))

        return _let(F.array_join(F.slice(blocks, i + 1, j - i + 1), ""), of)

    def laid(i: Column, *sizes: int) -> Column:
        fits = F.lit(True)
        for k, n in enumerate(sizes):
            fits = fits & F.coalesce(F.length(F.get(blocks, i + k)) == n, F.lit(False))
        j = i + (len(sizes) - 1)
        return F.when(fits, F.when(valid(i, j), j))

    def usual(i: Column) -> Column:
        return F.coalesce(F.when(F.length(F.get(blocks, i)) >= 13, F.when(valid(i, i), i)), laid(i, 4, 4, 4, 4),
                          laid(i, 4, 4, 4, 4, 3), laid(i, 4, 6, 5), laid(i, 4, 6, 4))

    def state(spans: Column, free: Column, seen: Column) -> Column:
        return F.struct(spans.cast(_SPANS).alias("spans"), free.cast("int").alias("free"), seen.cast("int").alias("seen"))

    def take(s: Column, i: Column, last: Column, seen: Column) -> Column:
        return _let(last, lambda j: F.when(j.isNull(), s).otherwise(state(
            F.concat(s["spans"], F.array(F.struct(i.cast("int").alias("first"), j.cast("int").alias("last")))), j + 1, seen)))

    places = F.sequence(F.lit(0), F.size(blocks) - 1)
    none = state(F.array(), F.lit(0), F.lit(0))

    def rest(known: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            following = F.get(known, s["seen"])
            limit = F.least(F.coalesce(following["first"], F.size(blocks)) - 1, i + 18)
            longest = F.get(F.filter(F.sequence(limit, i, F.lit(-1)), lambda j: valid(i, j)), 0)
            return F.when(i < s["free"], s).when(F.coalesce(i == following["first"], F.lit(False)), take(
                s, i, following["last"], s["seen"] + 1)).otherwise(take(s, i, longest, s["seen"]))

        return F.aggregate(places, none, step, lambda s: s["spans"])

    return _let(F.aggregate(places, none, lambda s, i: F.when(i < s["free"], s).otherwise(
        take(s, i, usual(i), F.lit(0))), lambda s: s["spans"]), rest)


_PARTS = "array<struct<old:string,new:string>>"


def _cards(key: str, value: Column) -> Column:
    """``struct(new, parts)`` of a row of digit blocks: the row with its card numbers replaced, and each of them."""
    def of(tokens: Column) -> Column:
        def text(first: Column, last: Column) -> Column:
            return F.array_join(F.slice(tokens, first + 1, F.greatest(last - first + 1, F.lit(0))), "")

        def put(spans: Column) -> Column:
            def made(span: Column, k: Column) -> Column:
                gap = F.when(k > 0, F.get(spans, k - 1)["last"] + 1).otherwise(0)
                # the blank before a card number is no part of it
                whole = text(span["first"], span["last"])
                return F.struct(text(gap, span["first"] - 1).alias("gap"), F.regexp_extract(whole, "^([ -]?)", 1).alias("blank"),
                                F.regexp_replace(whole, "^[ -]", "").alias("old"))

            def done(cards: Column) -> Column:
                end = text(F.coalesce(F.element_at(spans, -1)["last"] + 1, F.lit(0)), F.size(tokens) - 1)
                new = F.concat(F.array_join(F.transform(cards, lambda c: F.concat(c["gap"], c["blank"], c["new"])), ""), end)
                return F.struct(new.alias("new"), F.transform(cards, lambda c: F.struct(
                    c["old"].alias("old"), c["new"].alias("new"))).cast(_PARTS).alias("parts"))

            cards = F.transform(F.transform(spans, made), lambda c: F.struct(
                c["gap"].alias("gap"), c["blank"].alias("blank"), c["old"].alias("old"), _card(key, c["old"]).alias("new")))
            return F.when(F.size(spans) > 0, _let(cards, done)).otherwise(F.struct(
                value.alias("new"), F.array().cast(_PARTS).alias("parts")))

        return _let(_let(F.transform(tokens, _digits), _card_spans), put)

    return _let(F.regexp_extract_all(value, F.lit("([ -]?[0-9]+)"), 1), of)


def _remainder(account: Column) -> Column:
    """Of an account number (without blanks) by 97, its first four characters moved behind the rest."""
    def of(plain: Column) -> Column:
        moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
        return F.aggregate(F.split(moved, _BETWEEN), F.lit(0), lambda rest, c: F.when(
            c.rlike("^[0-9]$"), (rest * 10 + (F.ascii(c) - 48)) % 97).otherwise((rest * 100 + (F.ascii(c) - 55)) % 97))

    return _let(account, of)


def _account(key: str, value: Column) -> Column:
    """The country stays, the check digits follow from the rest."""
    def of(plain: Column) -> Column:
        land = F.substring(plain, F.lit(1), F.lit(2))
        body = permuted_text(key, "account", F.substring(plain, F.lit(5), F.length(plain)))
        return F.when(_remainder(plain) == 1, _let(body, lambda b: _laid_out(value, F.concat(
            land, F.lpad((98 - _remainder(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0"), b), "^[A-Z0-9]$"))).otherwise(value)

    return _let(F.replace(value, F.lit(" "), F.lit("")), of)


def _phone(key: str, value: Column) -> Column:
    """Country code and the first digit of the rest stay; seven digits or more count as a number."""
    digits = _digits(value)
    fixed = F.when(value.startswith("+"), F.length(F.regexp_extract(value, r"^\+(\d{1,3}?)(?=[ .(-])", 1))).otherwise(0) + 1
    fixed = F.when(value.startswith("+") & (fixed == 1), 3).otherwise(fixed)
    new = F.concat(F.substring(digits, F.lit(1), fixed), permuted_text(
        key, "phone", F.substring(digits, fixed + 1, F.length(digits))))
    return F.when(F.length(digits).between(7, 15), _laid_out(value, new, "^[0-9]$")).otherwise(value)


def _ip(key: str, value: Column) -> Column:
    def of(part: Column) -> Column:
        pair = permuted_pair(key, "ip", F.get(part, 0) * 256 + F.get(part, 1), F.get(part, 2) * 256 + F.get(part, 3), 65536, 65536)
        return F.when(F.forall(part, lambda p: p <= 255), _let(pair, lambda p: F.concat_ws(
            ".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256))).otherwise(value)

    return _let(F.transform(F.split(value, r"\."), lambda p: p.try_cast("int")), of)


def _date(key: str, value: Column) -> Column:
    """Days of a cycle of 400 years (1800 to 2199): 146,097 = 189 x 773. A month comes first before ``/``."""
    iso, slash = value.contains("-"), value.contains("/")
    first = F.lit("1800-01-01").cast("date")

    def real(part: Column) -> Column:
        year = F.when(iso, F.get(part, 0)).otherwise(F.get(part, 2))
        month = F.when(iso | ~slash, F.get(part, 1)).otherwise(F.get(part, 0))
        day = F.when(iso, F.get(part, 2)).when(slash, F.get(part, 1)).otherwise(F.get(part, 0))
        return F.date_diff(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), first)

    def written(new: Column) -> Column:
        wide = F.length(value) == 10
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(
            slash, F.when(wide, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "M/d/yyyy"))).otherwise(
            F.when(wide, F.date_format(new, "dd.MM.yyyy")).otherwise(F.date_format(new, "d.M.yyyy")))

    def of(at: Column) -> Column:
        pair = permuted_pair(key, "date", F.floor(at / 773), at % 773, 189, 773)
        new = _let(pair, lambda p: F.date_add(first, (p["l"] * 773 + p["r"]).cast("int")))
        return F.when(F.coalesce(at.between(0, 146_096), F.lit(False)), _let(new, written)).otherwise(value)

    return _let(_let(F.split(value, "[-/.]"), real), of)


def _national(key: str, value: Column) -> Column:
    """Three groups: 001 to 899 without 666, 01 to 99, 0001 to 9999."""
    def new(p: Column) -> Column:
        return F.concat_ws("-", F.lpad((p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad(
            (F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))

    def of(part: Column) -> Column:
        area, group, serial = F.get(part, 0), F.get(part, 1), F.get(part, 2)
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        pair = permuted_pair(key, "national", area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 989_901)
        return F.when(valid, _let(pair, new)).otherwise(value)

    return _let(F.transform(F.split(value, "-"), lambda p: p.try_cast("int")), of)


def _email(key: str, value: Column) -> Column:
    """The part before ``@`` changes, the host stays."""
    local = F.substring_index(value, "@", 1)
    return F.concat(permuted_text(key, "email", local), F.substring(value, F.length(local) + 1, F.length(value)))


def _secret(key: str, value: Column) -> Column:
    head = F.regexp_extract(value, "^(AKIA|(?:password|token) ?= ?\"?)", 1)
    return F.concat(head, permuted_text(key, "secret", F.substring(value, F.length(head) + 1, F.length(value))))


_MAKERS: dict[str, Callable[[str, Column], Column]] = {
    "email": _email, "ip": _ip, "date": _date, "national": _national, "phone": _phone, "card": _cards, "account": _account,
    "secret": _secret,
}


def pseudonym(key: str, value: Column) -> Column:
    """``struct(kind, new, parts)`` of one found value; ``new`` equals the value, and no part differs, if that is not valid."""
    # evaluated for the first fitting kind only
    out = None
    for kind, make in _MAKERS.items():
        if kind == "card":
            fits, of = value.rlike(r"^[0-9][0-9 -]*$"), make(key, value)
        else:
            fits, of = value.rlike(rf"^(?:{PATTERNS[kind]})$"), _let(make(key, value), lambda new: F.struct(
                new.alias("new"), F.array(F.struct(value.alias("old"), new.alias("new"))).cast(_PARTS).alias("parts")))
        made = _let(of, lambda o: F.struct(F.lit(kind).alias("kind"), o["new"].alias("new"), o["parts"].alias("parts")))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out.otherwise(F.struct(F.lit("none").alias("kind"), value.alias("new"), F.array().cast(_PARTS).alias("parts")))


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str = "pii_found") -> DataFrame:
    """The rows with their ``text`` pseudonymised and a column of what was replaced (array of ``kind, old, new``).

    The text keeps its length, except that addresses and dates without leading zeros may become shorter or longer. A null
    text stays null and an empty one empty, with nothing found. A column that is already named ``found`` is
    replaced; all others, and repeated rows, stay. Whoever has ``key`` can undo the permutation.
    """
    kept = others(docs, found)
    hits_, made_ = free(docs, "__hits", "__made")
    hits = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(f"({_ANY})"), 1), F.array().cast("array<string>"))
    seen = docs.select(*kept, hits.alias(hits_))
    made = F.transform(hits_, lambda h: F.struct(h.alias("old"), pseudonym(key, h).alias("p")))
    known = seen.select(*kept, F.when(F.size(hits_) > 0, made).otherwise(F.array().cast(
        f"array<struct<old:string,p:struct<kind:string,new:string,parts:{_PARTS}>>>")).alias(made_))
    gaps = F.split(F.col(text), f"(?:{_ANY})", -1)
    rebuilt = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(made_, i)["p"]["new"], F.lit("")))), "")
    parts = F.flatten(F.transform(made_, lambda m: F.transform(m["p"]["parts"], lambda x: F.struct(
        m["p"]["kind"].alias("kind"), x["old"].alias("old"), x["new"].alias("new")))))
    changed = F.filter(parts, lambda x: x["old"] != x["new"])
    columns = [F.when(F.size(made_) > 0, rebuilt).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in kept]
    return known.select(*columns, changed.alias(found))
