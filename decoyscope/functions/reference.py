"""References resolved against a base as RFC 3986, section 5.2, says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a reference: scheme, authority, path, query, fragment; the pattern is the RFC's (appendix B), with a scheme that begins with a letter.
PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HAS = {"authority": r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//", "query": r"^[^?#]*\?", "fragment": "#"}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parts(ref: Column) -> Column:
    """struct(scheme, authority, path, query, fragment); parts that aren't there are null, the path may be empty."""
    part = lambda i: F.regexp_extract(ref, PARTS, i)
    here = lambda name, i: F.when(ref.rlike(_HAS[name]), part(i))
    return F.struct(
        F.nullif(F.lower(part(1)), F.lit("")).alias("scheme"), here("authority", 2).alias("authority"), part(3).alias("path"),
        here("query", 4).alias("query"), here("fragment", 5).alias("fragment"))


def without_dots(path: Column) -> Column:
    """A path without its dot segments: a single dot is dropped, a double dot takes the segment before it away."""
    up = lambda out: F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.when(F.get(out, F.lit(0)) == "", F.least(F.size(out), F.lit(1))).otherwise(0)))
    step = lambda out, s: F.when(s == ".", out).when(s == "..", up(out)).otherwise(F.concat(out, F.array(s)))
    kept = lambda segments: F.aggregate(segments, F.array().cast("array<string>"), step)
    # a path that ends with a dot segment ends with a slash
    slash = lambda segments, keep: F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(keep) > 0), "/").otherwise("")
    return let(F.split(path, "/"), lambda ss: let(kept(ss), lambda keep: F.concat(F.array_join(keep, "/"), slash(ss, keep))))


def unparsed(p: Column) -> Column:
    """The reference that the parts make."""
    put = lambda before, c, after: F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))
    return F.concat(put("", p["scheme"], ":"), put("//", p["authority"], ""), p["path"], put("?", p["query"], ""), put("#", p["fragment"], ""))


def _merge(base: Column, path: Column) -> Column:
    """A relative path put after the last slash of the base's; after a slash of its own if the base has an authority and no path."""
    return F.when(base["authority"].isNotNull() & (base["path"] == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(F.regexp_extract(base["path"], r"^(.*/)", 1), path))


def resolved_parts(base: Column, ref: Column) -> Column:
    """The parts of the url that the parts `ref` name from the parts `base`."""
    own = ref["scheme"].isNotNull() | ref["authority"].isNotNull()
    empty = ref["path"] == ""
    path = F.when(~own & empty, base["path"]).otherwise(without_dots(F.when(own | ref["path"].startswith("/"), ref["path"]).otherwise(_merge(base, ref["path"]))))
    return F.struct(
        F.coalesce(ref["scheme"], base["scheme"]).alias("scheme"), F.when(own, ref["authority"]).otherwise(base["authority"]).alias("authority"), path.alias("path"),
        F.when(own | ~empty | ref["query"].isNotNull(), ref["query"]).otherwise(base["query"]).alias("query"), ref["fragment"].alias("fragment"))


def resolve_parts(base: Column, ref: Column) -> Column:
    """The url that `ref` names, given the parts of the base."""
    return let(parts(F.trim(ref)), lambda r: let(resolved_parts(base, r), unparsed))


def resolve(base: Column, ref: Column) -> Column:
    """The url that `ref` names on a page at `base`; null if either is."""
    return let(parts(base), lambda b: resolve_parts(b, ref))
