"""Column expressions over routes, filenames, versions, origins and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDEX_FILENAME = "llms.txt"
DEFAULT_BRANCH_MIN_PAGES = 5
NOT_FOUND_ROUTE = "/404"
VERSION = r"^v\d+(\.\d+)*$"


def segments(route: Column) -> Column:
    return F.filter(F.split(F.coalesce(route, F.lit("")), "/"), lambda s: s != "")


def depth(route: Column) -> Column:
    return F.size(segments(route))


def ancestors(route: Column) -> Column:
    """``/`` and every prefix of the route on segment borders, itself included."""
    parts = segments(route)
    below = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    return F.concat(F.array(F.lit("/")), below)


def is_dynamic(route: Column, flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.coalesce(route.rlike("(^|/):"), F.lit(False))


def is_container(has_content: Column) -> Column:
    return has_content.eqNullSafe(F.lit(False))


def has_draft_segment(route: Column) -> Column:
    return F.exists(F.split(F.coalesce(route, F.lit("")), "/"), lambda s: s.startswith("_"))


def is_version_folder(name: Column) -> Column:
    return F.coalesce(name.rlike(VERSION), F.lit(False))


def in_version_folder(route: Column) -> Column:
    return F.exists(F.split(F.coalesce(route, F.lit("")), "/"), lambda s: s.rlike(VERSION))


def version_key(name: Column) -> Column:
    """Sorts version folders when ordered descending: newest first, ``v2.1`` before ``v2``."""
    return F.transform(F.split(F.substring(name, 2, 1 << 20), r"\."), lambda x: x.cast("int"))


def _strip(route: Column) -> Column:
    return F.regexp_replace(route, "^/+|/+$", "")


def markdown_filename(route: Column) -> Column:
    bare = _strip(F.coalesce(route, F.lit("")))
    return F.when(bare == "", F.lit("index.md")).otherwise(F.concat(bare, F.lit(".md")))


def markdown_filename_route(path: Column) -> Column:
    """The inverse; null if the path is not that of a page's markdown."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.md$", ""), "^/+", "")
    ok = path.endswith(".md") & (bare != "") & ~bare.endswith("/")
    return F.when(ok, F.when(bare == "index", F.lit("/")).otherwise(F.concat(F.lit("/"), bare)))


def branch_index_filename(route: Column) -> Column:
    bare = _strip(F.coalesce(route, F.lit("")))
    return F.when(bare == "", F.lit(INDEX_FILENAME)).otherwise(F.concat(bare, F.lit(f"/{INDEX_FILENAME}")))


def search_index_filename(locale: Column, default: Column) -> Column:
    own = locale.isNull() | (locale == "") | locale.eqNullSafe(default)
    return F.when(own, F.lit("search-index.json")).otherwise(F.concat(locale, F.lit("/search-index.json")))


def base_path(path: Column) -> Column:
    bare = _strip(F.coalesce(path, F.lit("")))
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.lit("/"), bare))


def normalize_exclude(routes: Column) -> Column:
    """Non-blank prefixes with a leading slash and none at the end."""
    tidy = F.transform(routes, lambda r: F.btrim(r))
    return F.transform(F.filter(tidy, lambda r: r.isNotNull() & (r != "")), lambda r: F.concat(F.lit("/"), _strip(r)))


def origin(url: Column) -> Column:
    """Scheme, host and port of an http(s) address in lower case, without a default port; else null."""
    found = F.regexp_extract(F.lower(F.btrim(url)), r"^(https?://(?:[^/?#@\s]*@)?[^/?#@\s]+)", 1)
    bare = F.regexp_replace(found, r"//[^/@]*@", "//")
    plain = F.regexp_replace(F.regexp_replace(bare, r"^(http://[^/]*?):80$", "$1"), r"^(https://[^/]*?):443$", "$1")
    return F.when(found != "", plain)


def expected_origins(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, origin), lambda o: o.isNotNull()))


def accepts_origin(expected: Column, value: Column, site_origins: Column) -> Column:
    own = origin(value)
    return (
        F.when(expected.isNull() | value.isNull() | (value == ""), F.lit(True))
        .when(own.isNull(), F.lit(False))
        .when(F.coalesce(F.array_contains(site_origins, own), F.lit(False)), F.lit(True))
        .otherwise(F.coalesce(F.array_contains(expected, own), F.lit(False)))
    )


def nav_route(route: Column, is_index: Column) -> Column:
    folder = F.regexp_replace(route, "/index$", "")
    return F.when(F.coalesce(is_index, F.lit(False)), F.when(folder == "", F.lit("/")).otherwise(folder)).otherwise(route)


def localized(route: Column, locale: Column, default: Column) -> Column:
    """The path of a route in a language: other languages than the default are prefixed."""
    prefixed = locale.isNotNull() & default.isNotNull() & (locale != default)
    bare = F.when(route == "/", F.lit("")).otherwise(route)
    path = F.when(prefixed, F.concat(F.lit("/"), locale, bare)).otherwise(bare)
    return F.when(path == "", F.lit("/")).otherwise(path)


def _on(address: Column, base: Column, path: Column) -> Column:
    rooted = F.when((path == "/") & (base_path(base) != ""), base_path(base)).otherwise(F.concat(base_path(base), path))
    return F.when(address.isNotNull(), F.concat(F.regexp_replace(address, "/+$", ""), path)).otherwise(rooted)


def page_url(path: Column, address: Column, base: Column, trailing_slash: Column, own_domain: Column | None = None) -> Column:
    """A page's address from its localized path; a language's own domain takes no slash."""
    slash = F.when(F.coalesce(trailing_slash, F.lit(False)) & (path != "/"), F.lit("/")).otherwise(F.lit(""))
    shared = F.concat(_on(address, base, path), slash)
    if own_domain is None:
        return shared
    return F.when(own_domain.isNotNull(), F.concat(F.regexp_replace(own_domain, "/+$", ""), path)).otherwise(shared)


def _parts_of(path: Column, locales: Column) -> tuple[Column, Column]:
    """The language prefix of a path (or nothing) and the path after it."""
    first = F.get(segments(path), F.lit(0))
    prefix = F.when(F.coalesce(F.array_contains(locales, first), F.lit(False)), F.concat(F.lit("/"), first)).otherwise(F.lit(""))
    return prefix, F.substring(path, F.length(prefix) + 1, F.length(path))


def markdown_path(path: Column, locales: Column) -> Column:
    """Where the markdown of a shown path is; ``locales`` are the languages that have a prefix."""
    prefix, rest = _parts_of(path, locales)
    return F.concat(prefix, F.lit("/"), markdown_filename(rest))


def page_path(path: Column, locales: Column) -> Column:
    """The inverse; null if the path is not that of a page's markdown."""
    prefix, rest = _parts_of(path, locales)
    route = markdown_filename_route(rest)
    return F.when((prefix != "") & (route == "/"), prefix).otherwise(F.concat(prefix, route))


def markdown_url(route: Column, locale: Column, default: Column, address: Column, base: Column, own_domain: Column | None = None) -> Column:
    """The address of a page's markdown; ``route`` is translated already. Relative to the host without an address."""
    bare = F.concat(F.lit("/"), markdown_filename(route))
    prefixed = locale.isNotNull() & default.isNotNull() & (locale != default)
    path = F.when(prefixed, F.concat(F.lit("/"), locale, bare)).otherwise(bare)
    shared = F.when(address.isNotNull(), F.concat(F.regexp_replace(address, "/+$", ""), path)).otherwise(F.concat(base_path(base), path))
    if own_domain is None:
        return shared
    return F.when(own_domain.isNotNull(), F.concat(F.regexp_replace(own_domain, "/+$", ""), bare)).otherwise(shared)


def record_route_base(route: Column) -> Column:
    """The route before its last segment if that is a parameter and no other one is."""
    base = F.regexp_replace(route, r"/:[^/]+$", "")
    ok = route.rlike(r"/:[^/]+$") & ~base.rlike("(^|/):")
    return F.when(ok, F.when(base == "", F.lit("/")).otherwise(base))


def encode_segment(value: Column) -> Column:
    """Percent-encoding of a path segment; ``! ' ( ) ~ *`` stay."""
    out = F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def fill_pattern(pattern: Column, handle: Column) -> Column:
    base = record_route_base(pattern)
    return F.concat(F.when(base == "/", F.lit("")).otherwise(base), F.lit("/"), encode_segment(F.nullif(handle, F.lit(""))))


def record_route(pattern: Column, own: Column, route: Column, slug: Column) -> Column:
    """A record's page: its filled pattern, else its own route, else the list's route and its slug."""
    below = F.concat(F.regexp_replace(route, "/+$", ""), F.lit("/"), slug)
    return F.when(pattern.isNotNull(), fill_pattern(pattern, slug)).when(own.isNotNull() & (own != ""), own).when(
        ~F.coalesce(route.rlike("(^|/):"), F.lit(False)), below
    )


def is_address(value: Column) -> Column:
    one = ~value.rlike(r"\s")
    return one & (value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | value.rlike("^(mailto|tel):") | value.rlike(r"^\.{0,2}/"))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
