"""Column helpers for text: trimming, normalising, counting. Java's \\s and \\d are ASCII unless (?U) is set, so it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x1c-\x1f]+"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def trim_ws(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(WHITE))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x worked out once, however often body names it."""
    return F.transform(F.array(x), body)[0]


def squeeze_blanks(x: Column) -> Column:
    """Runs of blanks and tabs made single blanks; a blank that is one already is no match."""
    return F.regexp_replace(x, r"[ \t](?:[ \t]++|(?<=\t))", " ")


def unify_newlines(x: Column) -> Column:
    return F.regexp_replace(x, r"\r\n?", "\n")


def normalize(x: Column, squeeze_newlines: bool = True) -> Column:
    """Line ends unified, ideographic spaces and blank runs made single blanks, trimmed; three or more line ends become two."""
    x = squeeze_blanks(F.replace(unify_newlines(F.coalesce(x, F.lit(""))), F.lit("　"), F.lit(" ")))
    return trim_ws(F.regexp_replace(x, r"\n{3,}", "\n\n") if squeeze_newlines else x)


def shorten(x: Column, n: int) -> Column:
    """White space joined to single blanks, cut after n characters with three dots."""
    x = joined_line(x)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def joined_line(x: Column) -> Column:
    """White space of any kind joined to single blanks, trimmed."""
    return trim_ws(F.regexp_replace(F.coalesce(x, F.lit("")), rf"(?U){SPACES}", " "))


def nonblank(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def page_display(span: Column, num: Column) -> Column:
    """The first non-empty of page span and page number."""
    return F.coalesce(nonblank(span), nonblank(num.cast("string")), F.lit(""))


def page_label(num: Column, start: Column, end: Column) -> Column:
    spread = F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start, end))
    return F.coalesce(nonblank(num.cast("string")), spread, F.lit(""))


def doc_id(path: Column, name: Column) -> Column:
    return F.substring(F.md5(F.coalesce(nonblank(path), nonblank(name), F.lit("unknown_doc"))), 1, 12)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.format_string("%s_chunk_%04d", doc, index)


def doc_key(path: Column, name: Column) -> Column:
    return F.when(nonblank(path).isNotNull(), F.concat(F.lit("rel::"), path)).when(nonblank(name).isNotNull(), F.concat(F.lit("name::"), name)).otherwise(F.lit("unknown"))


def title(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/\\]*)\z", 1)
    return trim_ws(F.regexp_replace(base, r"(?i)\.pdf\z", ""))


def safe_name(x: Column, n: int = 180) -> Column:
    return F.substring(trim_ws(F.regexp_replace(F.regexp_replace(x, r'[\\/:*?"<>|]', "_"), rf"(?U){SPACES}", " ")), 1, n)


def safe_file_name(x: Column, n: int = 80) -> Column:
    x = F.regexp_replace(x, r"(?i)\.pdf\z", "")
    x = F.regexp_replace(F.regexp_replace(x, r'[\\/:*?"<>|]', "_"), rf"(?U){SPACES}", "_")
    x = F.btrim(F.regexp_replace(x, r"_+", "_"), F.lit("._ "))
    return F.coalesce(nonblank(F.btrim(F.substring(x, 1, n), F.lit("._ "))), F.lit("unknown_doc"))


def quoted(x: str) -> str:
    """x as a literal of Spark SQL."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(words: list[str]) -> Column:
    """Words as one array literal, in one call to the JVM however many they are."""
    return F.expr(f"array({', '.join(map(quoted, words))})") if words else F.array().cast("array<string>")


def map_of(names: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(quoted(x) for kv in names.items() for x in kv)})") if names else F.create_map().cast("map<string,string>")


#: Words from which on a list is looked through as one literal, so that generated code stays small.
MANY = 12


def contains_any(x: Column, words: list[str]) -> Column:
    if len(words) >= MANY:
        return let(x, lambda s: F.exists(array_of(words), lambda w: s.contains(w)))
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def count_hits(x: Column, words: list[str]) -> Column:
    return sum((x.contains(w).cast("int") for w in words), F.lit(0))


def label(key: Column, names: dict[str, str], default: Column | None = None) -> Column:
    """The display name of key; without one, the default, or key itself."""
    return F.coalesce(F.try_element_at(map_of(names), key), key if default is None else default)
