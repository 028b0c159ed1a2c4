"""URL expressions. Inputs are string columns; a null URL gives null, one without a path has the path ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the crawl rules name.
DOC_ROOTS = ["docs", "doc", "documentation", "guide", "guides", "manual", "reference", "learn", "handbook", "api"]
SKIP_EXTENSIONS = (
    "png jpg jpeg gif svg webp ico bmp pdf zip tar gz bz2 xz 7z rar mp4 webm mp3 wav ogg mov avi "
    "woff woff2 ttf otf eot exe dmg msi deb rpm whl jar css js map"
).split()
NOT_DOCS = "blog|news|posts?|articles?|changelog|releases?|careers?|jobs|pricing|about|contact|team|events?|showcase|agencies|partners|sponsors|store|shop|legal|privacy|terms|press|community"
DOCSY = "docs?|documentation|guide|guides|manual|reference|api|learn|tutorial"
LOCALES = "ar bn cs da de el es fa fi fr he hi hu id it ja ko ms nl no pl pt ro ru sv th tr uk vi zh".split()
FORGES = ["github.com", "gitlab.com", "bitbucket.org", "sourceforge.net", "codeberg.org", "git.sr.ht", "githubusercontent.com"]

_VERSION = r"^[vV]?\d+(\.\d+)*$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    """Lower-case host name without user, port and brackets; '' where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?\[?([^\]/:?#]*)", 1))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def normalise(url: Column) -> Column:
    """Without fragment, and without one slash at the path's end unless the path is '/'; the query stays."""
    bare = F.regexp_replace(url, r"#.*$", "")
    return F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/[^?#]*[^?#/])/(\?|$)", "$1$2")


def without_dots(path: Column) -> Column:
    """An absolute path with its dot segments folded: ``..`` takes the segment before it, at the root nothing."""
    full = F.split(path, "/", -1)
    last = F.element_at(full, -1)

    def fold(stack: Column, segment: Column) -> Column:
        return F.when(segment == ".", stack).when(segment == "..", F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.array_append(stack, segment))

    stack = F.aggregate(full, F.array().cast("array<string>"), fold)
    joined = F.array_join(F.when(last.isin(".", ".."), F.array_append(stack, F.lit(""))).otherwise(stack), "/")
    folded = F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(path)


def resolve(link: Column, page: Column) -> Column:
    """``link`` as seen from ``page``; a link with a scheme or a host of its own stays as it is written.

    Of a relative link dot segments are folded and empty segments go; of one that begins at the root dot segments are folded.
    """
    folder = F.when(path(page) == "", "/").otherwise(F.regexp_extract(path(page), r"^(.*/)", 1))
    own, tail = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(page), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin(page), without_dots(own), tail))
        .when(link.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), link))
        .when(link.startswith("?"), F.concat(origin(page), path(page), link))
        .when(link == "", page)
        .otherwise(F.concat(origin(page), without_dots(F.regexp_replace(F.concat(folder, own), "/{2,}", "/")), tail))
    )


def _joined(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, "/").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/")))


def docs_scope(url: Column) -> Column:
    """The path prefix that a crawl from ``url`` stays inside."""
    parts = segments(url)
    lower = F.transform(parts, F.lower)
    at = F.array_position(F.transform(lower, lambda s: s.isin(DOC_ROOTS).cast("int")), 1).cast("int")
    version = F.array_position(F.transform(F.slice(parts, at + 1, 3), lambda s: s.rlike(_VERSION).cast("int")), 1).cast("int")
    last = F.element_at(parts, -1)
    folder = F.when((F.size(parts) > 1) | last.contains("."), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(F.size(parts) == 0, "/").when(at > 0, _joined(F.slice(parts, 1, at + version))).otherwise(_joined(folder))


def crawlable(link: Column, site: Column, prefix: Column) -> Column:
    p = path(link)
    asset = F.lower(p).rlike(r"\.(" + "|".join(SKIP_EXTENSIONS) + ")$")
    return scheme(link).isin("http", "https") & (host(link) == site) & ~asset & F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/"))).startswith(prefix)


def docsy(url: Column) -> Column:
    return F.lower(path(url)).rlike(f"/({DOCSY})(/|$)")


def marketing(url: Column) -> Column:
    return F.lower(path(url)).rlike(f"/({NOT_DOCS})(/|$)")


def locale(url: Column) -> Column:
    """The path's locale code: one of the curated list, ``en``, or ''."""
    code = F.regexp_extract(F.lower(path(url)), r"^/([a-z]{2})(?:-[a-z]{2})?(?:/|$)", 1)
    return F.when(code.isin([*LOCALES, "en"]), code).otherwise("")


def names_version(url: Column) -> Column:
    return F.exists(segments(url), lambda s: s.rlike(_VERSION))


def version_of(url: Column, as_of: Column) -> Column:
    """The first version segment (lower case), else the harvest's date."""
    found = F.filter(segments(url), lambda s: F.lower(s).rlike(r"^(v\d+(\.\d+)*|\d+(\.\d+)+|latest|stable|next|canary)$"))
    return F.coalesce(F.lower(F.get(found, 0)), F.date_format(as_of, "yyyy-MM-dd"))


def name_of(url: Column) -> Column:
    return F.split_part(F.regexp_replace(bare_host(url), r"^docs\.", ""), F.lit("."), F.lit(1))


def file_slug(url: Column) -> Column:
    """A file name: host and path, cleaned, 80 characters, and 8 of the URL's SHA-1."""
    text = F.regexp_replace(F.concat(host(url), path(url)), r"[^A-Za-z0-9._-]+", "-")
    return F.concat(F.left(F.regexp_replace(text, r"^-+|-+$", ""), F.lit(80)), F.lit("-"), F.left(F.sha1(url), F.lit(8)))


def key_slug(text: Column) -> Column:
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", ""), F.lit(64))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled"))


def anchor(heading: Column) -> Column:
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(heading), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(80))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("section"))


def clean_remote(url: Column) -> Column:
    """A git remote as a https URL, else ''."""
    text = F.trim(F.coalesce(url, F.lit("")))
    for pattern, to in ((r"^git\+", ""), (r"^git://", "https://"), (r"^ssh://git@", "https://"), (r"^git@([^:]+):", "https://$1/"), (r"\.git$", "")):
        text = F.regexp_replace(text, pattern, to)
    return F.when(text.startswith("http"), text).otherwise("")


def is_forge(url: Column) -> Column:
    h = bare_host(url)
    out = F.lit(False)
    for forge in FORGES:
        out = out | (h == forge) | h.endswith("." + forge)
    return out


def is_docs_host(url: Column) -> Column:
    h = bare_host(url)
    return h.rlike(r"^(docs|developer|devdocs)\.") | h.contains(".readthedocs.")


def looks_like_docs(url: Column) -> Column:
    h = bare_host(url)
    return h.startswith("docs.") | h.contains(".readthedocs.") | F.lower(path(url)).rlike("/docs|/documentation|/guide")


def owns_name(url: Column, slug: Column) -> Column:
    labels = F.split(bare_host(url), r"\.")
    return ~is_forge(url) & F.exists(labels, lambda label: (label == slug) | (F.replace(label, F.lit("-"), F.lit("")) == F.replace(slug, F.lit("-"), F.lit(""))))


def at_root(resolved: Column, url: Column) -> Column:
    return (resolved != url) & (F.length(F.regexp_replace(path(resolved), "[^/]", "")) == 1)


def admissible(url: Column) -> Column:
    """http or https, with a host that is no private, loopback, link-local, reserved or multicast address literal."""
    h = host(url)
    octet = lambda i: F.split_part(h, F.lit("."), F.lit(i)).cast("int")
    v4 = h.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    a, b = octet(1), octet(2)
    blocked = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    v6 = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?\[(::1?|[fF][eE][89abAB]|[fF][cCdDfF])")
    return scheme(url).isin("http", "https") & (h != "") & (h != "localhost") & ~v6 & F.when(v4, ~blocked).otherwise(True)
