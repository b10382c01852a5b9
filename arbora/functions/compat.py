"""Column functions with soft-error semantics: bad input gives NULL or a clamped value, never an exception.

Everything is composed of built-in expressions, so it stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT = (-(2**31), 2**31 - 1)
LONG = (-(2**63), 2**63 - 1)


def divide(a: Column, b: Column) -> Column:
    """``a / b`` as a double; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def int_divide(a: Column, b: Column) -> Column:
    """Cut towards zero; NULL for a zero divisor. Exact beyond the range in which doubles are."""
    wide = lambda x: x.cast("decimal(38,10)")
    return F.when(b != 0, F.call_function("div", wide(a), wide(b))).cast("long")


def modulo(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def shift_left(x: Column, n: Column) -> Column:
    """A shift by a negative number gives 0."""
    return F.when(n < 0, F.lit(0)).otherwise(F.call_function("shiftleft", x.cast("long"), n))


def shift_right(x: Column, n: Column) -> Column:
    """An arithmetic shift; by a negative number it gives 0."""
    return F.when(n < 0, F.lit(0)).otherwise(F.call_function("shiftright", x.cast("long"), n))


def unsigned(x: Column) -> Column:
    """A 64-bit pattern read as an unsigned number."""
    wide = x.cast("long").cast("decimal(20,0)")
    return F.when(x.cast("long") < 0, wide + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")


def log(x: Column, base: Column | float | None = None) -> Column:
    """NULL for an argument or a base that is not positive, and for base 1."""
    own = F.when(x > 0, F.ln(x))
    if base is None:
        return own
    base = base if isinstance(base, Column) else F.lit(base)
    return own / F.when((base > 0) & (base != 1), F.ln(base))


def coth(x: Column) -> Column:
    return F.when(x != 0, 1 / F.tanh(x))


def truncate(x: Column, digits: int) -> Column:
    """Cut towards zero after ``digits`` decimals."""
    power = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * power) / power


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def acot(x: Column) -> Column:
    return F.lit(3.141592653589793 / 2) - F.atan(x)


def least_strict(*xs: Column) -> Column:
    """The least of the arguments; NULL if any is."""
    return F.when(_all_there(xs), F.least(*xs))


def greatest_strict(*xs: Column) -> Column:
    return F.when(_all_there(xs), F.greatest(*xs))


def _all_there(xs) -> Column:
    out = xs[0].isNotNull()
    for x in xs[1:]:
        out &= x.isNotNull()
    return out


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """One-based, negative from the end. Start 0, a start outside the text and a length below 1 give an empty string."""
    none = (start == 0) | (F.abs(start) > F.char_length(s))
    if length is None:
        return F.when(none, F.lit("")).otherwise(F.substr(s, start))
    return F.when(length.isNotNull() & (none | (length <= 0)), F.lit("")).otherwise(F.substr(s, start, length))


def locate(needle: Column, s: Column, start: Column | None = None) -> Column:
    """One-based place of a text in another, from ``start`` on; 0 if it is not there or ``start`` is outside."""
    if start is None:
        return F.call_function("locate", needle, s)
    inside = (start >= 1) & (start <= F.char_length(s) + 1)
    return F.when(s.isNull() | needle.isNull() | start.isNull(), F.lit(None).cast("int")).when(~inside, F.lit(0)).when(needle == "", start.cast("int")).otherwise(F.call_function("locate", needle, s, start.cast("int")))


def lpad(s: Column, n: int, pad: str) -> Column:
    return _pad(F.lpad, s, n, pad)


def rpad(s: Column, n: int, pad: str) -> Column:
    return _pad(F.rpad, s, n, pad)


def _pad(own, s: Column, n: int, pad: str) -> Column:
    if n < 0:
        return F.when(s.isNotNull(), F.lit(""))
    return F.when(F.char_length(s) >= n, F.substring(s, 1, n)) if not pad else own(s, n, pad)


def elt(n: Column, *xs: Column) -> Column:
    """The n-th argument; NULL out of range."""
    return F.get(F.array(*xs), n - 1)


def field(needle: Column, *xs: Column) -> Column:
    """One-based place of a value among the arguments; 0 if it is not there or NULL."""
    return F.coalesce(F.array_position(F.array(*xs), needle), F.lit(0))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def export_set(bits: Column, on: str, off: str, separator: str = ",", n: int = 64) -> Column:
    """Bits as text, least significant first; at most 64 of them."""
    n = 64 if n < 0 else min(n, 64)
    if n == 0:
        return F.when(bits.isNotNull(), F.lit(""))
    one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.call_function("shiftright", bits.cast("long"), i).bitwiseAND(F.lit(1)) == 1, F.lit(on)).otherwise(F.lit(off)))
    return F.when(bits.isNotNull(), F.array_join(one, separator))


def inet_aton(address: Column) -> Column:
    """The number of a dotted address. With fewer than four parts the last is the lowest byte; a part over 255 gives NULL."""
    parts = F.split(address, r"\.")
    n = F.size(parts)
    byte = lambda i: F.get(parts, i).try_cast("int")
    front = lambda i, factor: F.when(n > i + 1, byte(F.lit(i)).cast("long") * factor).otherwise(F.lit(0))
    sound = address.rlike(r"^\d{1,3}(\.\d{1,3}){0,3}$") & ~F.exists(parts, lambda p: F.coalesce(p.try_cast("int") > 255, F.lit(True)))
    return F.when(sound, byte(n - 1).cast("long") + front(0, 1 << 24) + front(1, 1 << 16) + front(2, 1 << 8))


def conv(s: Column, from_base: int, to_base: int) -> Column:
    """A number's digits in another base. NULL for an empty text or a base outside 2 to 36, ``'0'`` for a wrong digit.

    With a positive ``to_base`` a negative number counts as unsigned, with a negative one it keeps its sign.
    """
    if not 2 <= from_base <= 36 or not 2 <= abs(to_base) <= 36:
        return F.lit(None).cast("string")
    allowed = "0-9" if from_base >= 10 else f"0-{from_base - 1}"
    allowed += f"a-{chr(ord('a') + from_base - 11)}" if from_base > 10 else ""
    whole = F.regexp_replace(s, r"\..*$", "")
    own = F.conv(whole, from_base, to_base)
    return F.when(s != "", F.when(whole.rlike(f"^(?i)[+-]?[{allowed}]+$"), own).otherwise(F.lit("0")))


def folded_key(key: Column, length: int = 16) -> Column:
    """A key's bytes, wrapped around into ``length`` bytes by exclusive or."""
    digits = F.hex(key.cast("binary"))
    byte = lambda i: F.conv(F.substr(digits, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    size = (F.length(digits) / 2).cast("int")
    at = lambda j: F.aggregate(F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: (i % length == j) & (i < size)), F.lit(0), lambda a, i: a.bitwiseXOR(byte(i)))
    return F.when(key.isNotNull(), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.lpad(F.hex(at(j)), 2, "0")), "")))


def aes_encrypt(value: Column, key: Column) -> Column:
    return F.aes_encrypt(value.cast("binary"), folded_key(key), F.lit("ECB"), F.lit("PKCS"))


def aes_decrypt(value: Column, key: Column) -> Column:
    """NULL where the key does not fit."""
    return F.try_aes_decrypt(value, folded_key(key), F.lit("ECB"), F.lit("PKCS"))


#: Words that an identifier must be quoted for.
RESERVED = frozenset(
    "all and any as asc between by case cast check column constraint create cross current_date current_time current_timestamp default delete desc distinct drop else end except exists false fetch for "
    "foreign from full grant group having in inner insert intersect into is join leading left like limit natural not null on or order outer primary references right select set some table then to "
    "trailing true union unique update user using values when where with".split()
)


def quote_ident(s: Column, quote: str = '"', force: bool = False) -> Column:
    """An identifier in quotes where it needs them: where it is no lower-case word, or a reserved one."""
    plain = s.rlike(r"^[a-z_][a-z0-9_$]*$") & ~s.isin(*sorted(RESERVED)) & F.lit(not force)
    return F.when(plain, s).otherwise(F.concat(F.lit(quote), F.replace(s, F.lit(quote), F.lit(quote * 2)), F.lit(quote)))


def text_to_int(s: Column, limits: tuple[int, int] = INT) -> Column:
    """The numeric prefix of a text, rounded half away from zero and clamped; 0 without one."""
    prefix = _prefix(s)
    exact, near = F.round(prefix.try_cast("decimal(38,10)")), prefix.try_cast("double")  # a decimal holds what doubles round
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in limits)
    value = F.when(prefix == "", F.lit(0).cast("decimal(38,0)")).when(exact.isNotNull(), exact.cast("decimal(38,0)")).when(near < 0, low).otherwise(high)
    return F.when(s.isNotNull(), F.greatest(F.least(value, high), low).cast("long"))


def text_to_double(s: Column) -> Column:
    """The numeric prefix of a text; 0 without one."""
    prefix = _prefix(s)
    return F.when(s.isNotNull(), F.when(prefix == "", F.lit(0.0)).otherwise(prefix.try_cast("double")))


def text_to_decimal(s: Column, precision: int, scale: int) -> Column:
    """The numeric prefix of a text, rounded to the scale and clamped to the precision; 0 without one."""
    prefix, most = _prefix(s), "9" * (precision - scale) + "." + "9" * scale if scale else "9" * precision
    kind = f"decimal({precision},{scale})"
    near = prefix.try_cast("double")
    value = F.when(prefix == "", F.lit("0")).otherwise(prefix).try_cast(kind)
    return F.when(s.isNotNull(), F.coalesce(value, F.when(near < 0, F.lit("-" + most)).otherwise(F.lit(most)).cast(kind)))


def text_to_date(s: Column) -> Column:
    """NULL for what is no date, zero dates included."""
    return s.try_cast("date")


def text_to_timestamp(s: Column) -> Column:
    return s.try_cast("timestamp")


def text_to_boolean(s: Column) -> Column:
    """True for ``true``-like words and for numbers other than 0."""
    return F.when(s.isNotNull(), F.coalesce(s.try_cast("boolean"), text_to_double(s) != 0))


def _prefix(s: Column) -> Column:
    return F.regexp_extract(s, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)


def double_to_int(x: Column, limits: tuple[int, int] = INT) -> Column:
    """Rounded by floor(x + 0.5) and clamped."""
    return clamp(F.floor(x + 0.5), limits).cast("long")


def clamp(x: Column, limits: tuple[int, int]) -> Column:
    """A whole number moved into a narrower type's range."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(limits[1])), F.lit(limits[0])))
