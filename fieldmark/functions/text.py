"""Text helpers as native Column expressions (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The characters Python's str.strip() removes (str.isspace()),
# written as a Java regex character class.  U+200B, U+FEFF and U+180E are not
# among them.
# ---------------------------------------------------------------------------
PY_WHITESPACE_CLASS = (
    "[\\x09\\x0a\\x0b\\x0c\\x0d\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0\\u1680"
    "\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
)
# The same 29 characters as a plain string, for Spark's set-based trim.
PY_WHITESPACE = (
    "\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (``trim`` with a character set: no regex)."""
    return F.trim(as_col(c), F.lit(PY_WHITESPACE))


def norm(c: Column | str) -> Column:
    """Normalisation of the exact scorer: ``str(x).lower().strip()``."""
    return py_strip(F.lower(as_col(c).cast("string")))


def is_empty(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Python falsiness of a nullable string or list: null, ``""`` or ``[]``."""
    c = as_col(c)
    if isinstance(dtype, T.ArrayType):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (F.length(c) == 0)


def list_text(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Text form a list is judged in: items joined by ``", "`` (order kept)."""
    c = as_col(c)
    if isinstance(dtype, T.ArrayType):
        return F.array_join(c, ", ")
    return c


def _repr_str(c: Column) -> Column:
    """Python ``repr`` of a non-null str, for text without unprintable characters
    other than tab, newline and carriage return (those are escaped)."""
    single, double = F.lit("'"), F.lit('"')
    has_double = F.instr(c, '"') > 0
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(esc, single, F.when(has_double, F.lit("\\'")).otherwise(single))
    for char, code in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(char), F.lit(code))
    quote = F.when((F.instr(c, "'") > 0) & ~has_double, double).otherwise(single)
    return F.concat(quote, esc, quote)


def py_repr(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """Python ``repr`` of a nullable string or list of strings (``None`` for null)."""
    c = as_col(c)
    if isinstance(dtype, T.ArrayType):
        items = F.transform(c, lambda x: F.coalesce(_repr_str(x), F.lit("None")))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    else:
        body = _repr_str(c.cast("string"))
    return F.when(c.isNull(), F.lit("None")).otherwise(body)


def mismatch_reason(e: Column | str, a: Column | str, dtype: T.DataType | None = None) -> Column:
    """``expected=<repr>, actual=<repr>``, the reason of a null/empty mismatch.

    Written as a ``transform`` of both values: Spark puts no such expression into the one method
    that it generates for a stage, which with the long ``repr`` of several fields would exceed
    the 8,000 bytes up to which the JVM compiles a method (a row then costs some ten times)."""
    e, a = as_col(e), as_col(a)
    if not isinstance(dtype, T.ArrayType):
        e, a = e.cast("string"), a.cast("string")
    both = F.transform(F.array(e, a), lambda x: py_repr(x, dtype))
    return F.concat(F.lit("expected="), F.array_join(both, ", actual="))


def format_2f(c: Column | str) -> Column:
    """Python ``f"{x:.2f}"`` for values in [0, 1000): ``format_number`` rounds the
    exact binary value half-even, like Python (``format_string`` does not)."""
    return F.format_number(as_col(c), 2)


def format_plain(c: Column | str, digits: int = 0, percent: bool = False,
                 signed: bool = False, grouped: bool = False) -> Column:
    """Python's ``f"{x:.<digits>f}"`` (``percent``: ``%``; ``signed``: ``+``;
    ``grouped``: ``,``) of a nullable number."""
    x = as_col(c).cast("double")
    text = F.format_number(x * F.lit(100.0) if percent else x, digits)
    if not grouped:
        text = F.replace(text, F.lit(","), F.lit(""))
    if percent:
        text = F.concat(text, F.lit("%"))
    return F.when(F.startswith(text, F.lit("-")), text).otherwise(
        F.concat(F.lit("+"), text)) if signed else text
