"""Column expressions over headers, file paths and object keys."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text trim removes (Unicode white space and
# the four ASCII separators).
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# File suffix -> category; any other suffix is "other".
FILE_CATEGORIES = {
    ".pdf": "pdf",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".gif": "image",
    ".bmp": "image",
    ".tiff": "image",
    ".csv": "csv",
    ".json": "json",
    ".txt": "text",
    ".log": "text",
    ".md": "text",
    ".docx": "docx",
    ".doc": "docx",
    ".xlsx": "excel",
    ".xls": "excel",
    ".pptx": "powerpoint",
    ".ppt": "powerpoint",
    ".xml": "xml",
    ".yaml": "yaml",
    ".yml": "yaml",
}


@dataclass(frozen=True)
class Scope:
    """Where the files of one scope go."""

    name: str
    bucket: str
    prefix: str


# The two scopes and their key prefixes. Bucket names are settings.
SCOPES = (
    Scope("mba", "mba-bucket", "mba/"),
    Scope("policy", "policy-bucket", "policy/"),
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def snake_case(c: Column | str) -> Column:
    """Header text to an identifier; empty text becomes ``col``."""
    c = _col(c)
    joined = F.btrim(F.regexp_replace(c, "[^0-9a-zA-Z]+", "_"), F.lit("_"))
    named = F.when(joined.rlike("^[0-9]"), F.concat(F.lit("c_"), joined)).otherwise(joined)
    return F.when(named == "", F.lit("col")).otherwise(F.lower(named))


def snake_name(header: str) -> str:
    """`snake_case` for one header on the driver, where columns are renamed."""
    words = re.findall("[0-9a-zA-Z]+", header)
    name = "_".join(words).lower() or "col"
    return f"c_{name}" if name[0].isdigit() else name


def snake_headers(headers: list[str]) -> list[str]:
    """Snake names of a header row; two headers with one name are an error."""
    names = [snake_name(h) for h in headers]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"headers share a column name: {', '.join(clashes)}")
    return names


def base_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """Lower-case last suffix with its dot; "" for dot files and trailing dots."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def table_name(key: Column | str) -> Column:
    """Base name without its last extension, in snake case."""
    return snake_case(F.regexp_replace(base_name(key), r"\.[^.]*$", ""))


def file_category(path: Column | str) -> Column:
    return F.coalesce(_lookup(FILE_CATEGORIES, suffix(path)), F.lit("other"))


def scope_of(path: Column | str, root: str) -> Column:
    """The scope named by the first component below ``root``, else by the
    nearest ancestor directory, even one above ``root``; NULL without either."""
    path = F.lower(_col(path))
    names = [F.lit(s.name) for s in SCOPES]
    base = root.rstrip("/").lower() + "/"
    below = F.when(path.startswith(base), path.substr(F.lit(len(base) + 1), F.length(path)))
    first = F.substring_index(below, "/", 1)
    parts = F.split(path, "/")
    ancestors = F.slice(parts, F.lit(1), F.size(parts) - 1)
    nearest = F.try_element_at(F.filter(ancestors, lambda p: p.isin(*names)), F.lit(-1))
    return F.when(first.isin(*names), first).otherwise(nearest)


def scope_bucket(scope: Column | str, scopes: tuple[Scope, ...] = SCOPES) -> Column:
    """Bucket of a scope (trimmed, any case); NULL for an unknown scope."""
    return _lookup({s.name: s.bucket for s in scopes}, F.lower(strip(scope)))


def scope_prefix(scope: Column | str, scopes: tuple[Scope, ...] = SCOPES) -> Column:
    return _lookup({s.name: s.prefix for s in scopes}, F.lower(strip(scope)))


def target_key(
    scope: Column | str,
    path: Column | str,
    prefix: Column | None = None,
    with_category: bool = True,
) -> Column:
    """``<prefix or scope/><category/><file name>``; directories are flattened,
    so files of one name share a key."""
    own = F.concat(_col(scope), F.lit("/"))
    start = own if prefix is None else F.coalesce(F.nullif(prefix, F.lit("")), own)
    start = F.when(start.endswith("/"), start).otherwise(F.concat(start, F.lit("/")))
    middle = [file_category(path), F.lit("/")] if with_category else []
    return F.concat(start, *middle, base_name(path))


def extension_list(text: Column | str) -> Column:
    """``"pdf, CSV,,.txt"`` -> ``[".pdf", ".csv", ".txt"]``, each once."""
    words = F.transform(F.split(_col(text), ","), lambda e: F.lower(strip(e)))
    kept = F.filter(words, lambda e: e != "")
    dotted = F.transform(kept, lambda e: F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))
    return F.array_distinct(dotted)


def parse_extensions(text: str) -> set[str]:
    """`extension_list` for one setting given on the driver."""
    words = (w.strip().lower() for w in (text or "").split(","))
    return {w if w.startswith(".") else f".{w}" for w in words if w}


def clean_etag(etag: Column | str) -> Column:
    return F.btrim(_col(etag), F.lit('"'))


def normal_network(c: Column | str) -> Column:
    return F.replace(F.lower(_col(c)), F.lit("-"), F.lit("_"))


def full_name(first: Column | str, last: Column | str) -> Column:
    """NULL when either part is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def megabytes(size: Column | str) -> Column:
    return _col(size) / F.lit(1048576.0)
