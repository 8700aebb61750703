"""Canonical JSON as column expressions: sorted keys, no blanks, shortest numbers, raw non-ASCII characters.

Texts become VARIANT values, whose objects are sorted and without repeated keys.  VARIANT would merge 1.0 and 1, so before
parsing every string gets the prefix 's' and every number becomes a string with the prefix 'n' and its shortest form; a typed
value therefore keeps all that the canonical text needs, and `written` takes the prefixes off again.  Nothing runs in Python.

Keys are ordered by UTF-16 units, which differs from code points only beyond U+FFFF.  Numbers of more than 15 significant
digits take the digits Java prints for the double."""

from __future__ import annotations

from pyspark.sql import functions as F

from crewgrid.functions.numeric import col

# Two characters that no valid JSON text holds stand for an escaped backslash and an escaped quote, so strings can be cut at quotes.
_MASKS = (("\\\\", "\u0003"), ('\\"', "\u0004"))
_TOKEN = r'"[^"]*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++|-'
_NUMBER = r"^-?[0-9]"
# Integers but -0, and reals of at most 15 digits that need no power and no other digits.
_PLAIN = r"-?[1-9][0-9]*+|0|-?0\.(?:0|0{0,3}[1-9](?:[0-9]{0,9}[1-9])?)|-?[1-9][0-9]{0,8}\.(?:0|[0-9]{0,5}[1-9])"


def once(c, f):
    """f of a column that is evaluated once a row, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _masked(c):
    for text, mark in _MASKS:
        c = F.replace(c, F.lit(text), F.lit(mark))
    return c


def _unmasked(c):
    for text, mark in reversed(_MASKS):
        c = F.replace(c, F.lit(mark), F.lit(text))
    return c


def _number_parts(t):
    """Sign, significant digits and decimal point of a number as written, or as the double prints beyond 15 digits."""
    digits = F.regexp_replace(F.regexp_replace(t, "[eE].*$", ""), "[-.]", "")
    long = F.length(F.ltrim(digits, F.lit("0"))) > 15
    double = t.try_cast("double")
    text = F.when(long, double.cast("string")).otherwise(t)
    whole = F.regexp_extract(text, r"^-?([0-9]+)", 1)
    part = F.regexp_extract(text, r"\.([0-9]+)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]\+?(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.struct(
        t.alias("t"), t.rlike("[.eE]").alias("real"), (double.isNull() | F.isnan(double) | (F.abs(double) == float("inf"))).alias("bad"),
        t.startswith("-").alias("minus"), F.concat(whole, part).alias("digits"), (F.length(whole) + power).alias("point"))


def _stripped(p):
    digits = F.ltrim(p["digits"], F.lit("0"))
    return F.struct(p["t"].alias("t"), p["real"].alias("real"), p["bad"].alias("bad"), p["minus"].alias("minus"),
                    F.rtrim(digits, F.lit("0")).alias("d"), (p["point"] - F.length(p["digits"]) + F.length(digits)).alias("point"))


def _shortest(p):
    d, point, n = p["d"], p["point"], F.length(p["d"])
    exponent = point - 1
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d))
        .when(point >= n, F.concat(d, F.repeat(F.lit("0"), point - n), F.lit(".0")))
        .otherwise(F.concat(F.substring(d, F.lit(1), point), F.lit("."), F.substring(d, point + 1, n))))
    power = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(""), F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    real = F.concat(F.when(p["minus"], "-").otherwise(""), F.when(d == "", "0.0").when((point > -4) & (point <= 16), plain).otherwise(power))
    return F.when(~p["real"], F.when(p["t"] == "-0", "0").otherwise(p["t"])).when(~p["bad"], real)


def typed(c):
    """VARIANT of a JSON text with typed strings; null for invalid JSON, repeated keys and numbers that are not finite.

    Texts without a backslash whose numbers stand in their shortest form already are marked by two regular expressions; only
    the others are cut into tokens."""
    c = col(c)
    text = F.regexp_replace(F.regexp_replace(c, '"([^"]*+)"', '"s$1"'), r'\G((?:[^"0-9-]++|"[^"]*+")*+)(-?[0-9][0-9.eE+-]*+)', '$1"n$2"')
    put = once(text, lambda t: F.when(c.rlike(r"\\") | t.rlike(f'"n(?!(?:{_PLAIN})")'), _tokens(c)).otherwise(t))
    return F.try_parse_json(F.when(F.try_parse_json(c).isNotNull(), put))


def _tokens(c):
    """The text with typed strings, token by token; null where a number is not finite."""
    one = lambda t: once(once(once(t, _number_parts), _stripped), _shortest)
    tokens = F.regexp_extract_all(_masked(c), F.lit(_TOKEN), F.lit(0))
    put = F.transform(tokens, lambda t: F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substring(t, F.lit(2), F.length(t)))).when(t.rlike(_NUMBER), F.concat(F.lit('"n'), one(t), F.lit('"'))).otherwise(t))
    whole = lambda x: F.when(~F.exists(x, lambda t: t.isNull()), F.array_join(x, ""))
    return _unmasked(once(put, whole))


def written(json):
    """Canonical text of what to_json gives for a typed value."""
    bare = lambda m: F.regexp_replace(m, '(")s|"n([^"]*+)"', "$1$2")

    def escaped(j):
        m = bare(_masked(j))
        for high in "01":
            for low in "ABCDEF":
                m = F.replace(m, F.lit(f"\\u00{high}{low}"), F.lit(f"\\u00{high}{low.lower()}"))
        return _unmasked(m)

    return once(json, lambda j: F.when(j.rlike(r"\\"), escaped(j)).otherwise(bare(j)))


def canonical(c):
    """Canonical text of a JSON text; null where `typed` is null."""
    return written(F.to_json(typed(c)))


def dumped(c):
    """Text of a canonical JSON with a blank after commas and colons and only ASCII characters."""
    tokens = F.regexp_extract_all(_masked(col(c)), F.lit('"[^"]*+"|[,:]|[^",:]++'), F.lit(0))
    text = _unmasked(F.array_join(F.transform(tokens, lambda t: F.when(t.isin(",", ":"), F.concat(t, F.lit(" "))).otherwise(t)), ""))
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, F.lit("0")))
    high, low = lambda n: F.lit(0xD800) + F.floor((n - 0x10000) / 0x400).cast("int"), lambda n: F.lit(0xDC00) + (n - 0x10000) % 0x400
    ascii_ = lambda ch: F.when(F.ascii(ch) < 128, ch).when(F.ascii(ch) < 0x10000, unit(F.ascii(ch))).otherwise(F.concat(unit(high(F.ascii(ch))), unit(low(F.ascii(ch)))))
    return F.when(text.rlike("[^\\x00-\\x7f]"), F.array_join(F.transform(F.split(text, ""), ascii_), "")).otherwise(text)


def members(value):
    """Top-level members of a typed object, sorted by key (prefix 's'); null for other values."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def written_without(value, keys):
    """Canonical text of a typed object without some top-level keys."""
    return written(F.to_json(F.map_filter(members(value), lambda k, _: ~k.isin(*[f"s{k}" for k in keys]))))


def written_only(value, keys):
    """Canonical text of a typed object with some top-level keys only."""
    return written(F.to_json(F.map_filter(members(value), lambda k, _: k.isin(*[f"s{k}" for k in keys]))))


def _path(names):
    return "$" + "".join(f"['s{n}']" for n in names)


def kind(value, *names):
    """object, array, string, number, boolean or null of a member; SQL null where nothing is there.

    Objects and arrays are told without their text, which takes long to write."""
    is_a = lambda what: F.try_variant_get(value, _path(names), what).isNotNull()
    text = F.try_variant_get(value, _path(names), "string")  # scalars begin with their prefix
    return (
        F.when(is_a("struct<>"), "object").when(is_a("array<variant>"), "array").when(text.startswith("s"), "string").when(text.startswith("n"), "number")
        .when(text.isNotNull(), "boolean").when(F.is_variant_null(F.try_variant_get(value, _path(names), "variant")), "null"))


def _unprefixed(value, names, prefix):
    text = F.try_variant_get(value, _path(names), "string")
    return F.when(text.startswith(prefix), F.substring(text, F.lit(2), F.length(text)))


def string(value, *names):
    """A string member; null for anything else."""
    return _unprefixed(value, names, "s")


def number(value, *names):
    """A number member as its shortest text; null for anything else."""
    return _unprefixed(value, names, "n")


def boolean(value, *names):
    return F.when(kind(value, *names) == "boolean", F.try_variant_get(value, _path(names), "boolean"))


def part(value, *names):
    """Canonical text of a member; null where nothing is there."""
    return written(F.to_json(F.try_variant_get(value, _path(names), "variant")))
