"""URL expressions.

The results are never NULL, which keeps Spark from deriving not-null filters:
those would repeat the whole expression below the projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(url: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))


def url_host(url: Column) -> Column:
    """Lower-case host (and port) of an http(s) URL, '' for anything else.

    '.' and '..' are no hosts; as folder names they would lead elsewhere.
    """
    return F.lower(_part(url, r"^(?i:https?)://(?!\.*(?:[/?#]|$))([^/?#]*)"))


def url_path(url: Column) -> Column:
    """Path of an http(s) URL, '' where it has none."""
    return _part(url, r"^(?i:https?)://[^/?#]*([^?#]*)")


def url_query(url: Column) -> Column:
    """Query with its '?', '' where there is none."""
    return _part(url, r"^[^?#]*(\?[^#]*)")


def trailing_slash(path: Column) -> Column:
    """End extension-less paths in '/', leave 'name.ext' alone."""
    leaf = F.substring_index(path, "/", -1)
    done = F.endswith(path, F.lit("/")) | F.contains(leaf, F.lit("."))
    return F.when(done, path).otherwise(F.concat(path, F.lit("/")))


def object_key(path: Column, index: str = "index.html") -> Column:
    """Storage key of a request path; directories get the index document."""
    key = F.when(F.startswith(path, F.lit("/")), F.substr(path, F.lit(2))).otherwise(path)
    folder = (path == "") | F.endswith(path, F.lit("/"))
    return F.when(folder, F.concat(key, F.lit(index))).otherwise(key)


def file_extension(path: Column) -> Column:
    """'.ext' at the end of a path, '' where there is none."""
    return F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
