"""Deterministic ids and name functions, as Column expressions.

An id is a prefix and the first 12 hex digits of the SHA-1 of its parts, each lower-cased and trimmed,
joined by U+241F. Ids are therefore case-insensitive and need no coordination between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sign between the parts of an id.
SEPARATOR = "␟"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the characters that count as white space in ids.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


# The same as ranges of a character class, which a pattern tests faster than single signs.
_WHITE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.btrim(_col(text), F.lit(WHITE))


def digest(*parts: Column | str) -> Column:
    own = [strip(F.lower(F.coalesce(_col(p), F.lit("")))) for p in parts]
    return F.substring(F.sha1(F.encode(F.concat_ws(SEPARATOR, *own), "UTF-8")), 1, 12)


def squeeze(name: Column | str) -> Column:
    """Trimmed, inner white space collapsed."""
    return F.regexp_replace(strip(name), f"{_WHITE_CLASS}+", " ")


def canonical_name(name: Column | str, aliases: Column | None = None) -> Column:
    """Lower-cased and squeezed; if ``aliases`` (map of lower-cased alias to system) knows the first
    dotted segment, that segment is replaced."""
    n = F.lower(squeeze(name))
    if aliases is None:
        return n
    first = F.substring_index(n, ".", 1)
    system = F.try_element_at(aliases, first)
    rest = F.substring(n, F.length(first) + 1, F.length(n))
    return F.when(n.contains(".") & system.isNotNull(), F.concat(F.lower(squeeze(system)), rest)).otherwise(n)


def table_id(name: Column | str, aliases: Column | None = None) -> Column:
    return F.concat(F.lit("t_"), digest(canonical_name(name, aliases)))


def model_id(label: Column | str, files: Column | str) -> Column:
    """``files`` is an array; its order does not matter."""
    lowered = F.transform(F.array_sort(_col(files)), lambda f: strip(F.lower(f)))
    joined = F.concat_ws(SEPARATOR, strip(F.lower(_col(label))), lowered)
    return F.concat(F.lit("m_"), F.substring(F.sha1(F.encode(joined, "UTF-8")), 1, 12))


def table_edge_id(source: Column | str, target: Column | str, model: Column | str, kind: Column | str) -> Column:
    return F.concat(F.lit("te_"), digest(source, target, model, kind))


def column_edge_id(source: Column | str, target: Column | str, model: Column | str, kind: Column | str) -> Column:
    return F.concat(F.lit("ce_"), digest(source, target, model, kind))


def rule_id(element: Column | str, dimension: Column | str, statement: Column | str) -> Column:
    return F.concat(F.lit("dq_"), digest(element, dimension, statement))


def element_column(element: Column | str) -> Column:
    """What stands behind the last dot; all of it where there is none."""
    return F.substring_index(_col(element), ".", -1)


def element_table(element: Column | str, strict: bool = False) -> Column:
    """What stands before the last dot, or null. ``strict`` asks for a dot in that part, too. The element is named once, for
    the optimiser puts the expression behind it in each place that names it."""
    part = r"(?s)\A[^.]*\..*(?=\.[^.]*\z)" if strict else r"(?s)\A.+(?=\.[^.]*\z)"
    return F.try_element_at(F.regexp_extract_all(_col(element), F.lit(part), F.lit(0)), F.lit(1))


def source_system(name: Column | str) -> Column:
    """The first dotted segment, or null without a dot."""
    return F.when(_col(name).contains("."), F.substring_index(_col(name), ".", 1))


def path_stem(path: Column | str) -> Column:
    """The last path segment without its final suffix (a leading dot is no suffix)."""
    last = path_tail(path)
    return F.regexp_replace(last, r"(?<=[^.])\.[^.]*$", "")


def path_tail(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), r"[\\/]"), -1)


# Name shapes that suggest a key or a date.
ID_SHAPE = r"(?i)(?:^|_)(id|key|sk|pk|uuid)(?:$|_)"
DATE_SHAPE = r"(?i)(?:^|_)(date|dt|datetime|timestamp|ts|asof)(?:$|_)"


def looks_like_id(name: Column | str) -> Column:
    return _col(name).rlike(ID_SHAPE)


def looks_like_date(name: Column | str) -> Column:
    return _col(name).rlike(DATE_SHAPE)
