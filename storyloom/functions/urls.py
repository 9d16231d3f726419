"""URL columns: parts, the canonical form, sites and repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.text import bind, strip

# RFC 3986, appendix B.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"

# Parameters that only track, by prefix and by exact name.
TRACKING_PREFIXES = r"^(utm_|mc_|pk_|_hs)"
TRACKING_NAMES = (
    "fbclid", "gclid", "dclid", "msclkid", "igshid", "mkt_tok", "ref", "ref_src", "referrer", "source",
    "cmpid", "ncid", "spm", "at_medium", "at_campaign", "sh", "share", "si",
)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, PARTS, group)


def without_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def domain(url: Column) -> Column:
    return without_www(part(url, 2))


def site(url: Column) -> Column:
    """The last two labels of the host, user and port left out."""
    host = F.regexp_replace(F.regexp_replace(part(url, 2), r"^.*@", ""), r":\d*$", "")
    labels = F.split(without_www(host), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.regexp_replace(text, r"\+", " "))


def _encoded(text: Column) -> Column:
    # Java keeps "*" and encodes "~"; query strings elsewhere do the reverse.
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), r"%7E", "~"), r"\*", "%2A")


def _query(raw: Column) -> Column:
    """Parameters without the tracking ones, sorted by name then value."""
    pairs = F.transform(
        F.filter(F.split(raw, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.split(p, "=", 2)[0]).alias("k"),
            _decoded(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit(""))).alias("v"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda kv: ~F.lower(kv["k"]).isin(*TRACKING_NAMES) & ~F.lower(kv["k"]).rlike(TRACKING_PREFIXES),
    )
    joined = F.transform(F.array_sort(kept), lambda kv: F.concat(_encoded(kv["k"]), F.lit("="), _encoded(kv["v"])))
    return F.array_join(joined, "&")


def _rebuilt(clean: Column) -> Column:
    scheme = F.lower(part(clean, 1))
    scheme = F.when(scheme.isin("http", "https", ""), F.lit("https")).otherwise(scheme)
    host = F.regexp_replace(F.regexp_replace(without_www(part(clean, 2)), ":80$", ""), ":443$", "")
    path = bind(F.regexp_replace(part(clean, 3), "/+$", ""), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    query = bind(_query(part(clean, 4)), lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)))
    return F.when(part(clean, 2) == "", clean).otherwise(F.concat(scheme, F.lit("://"), host, path, query))


def canonical(url: Column) -> Column:
    """One stable form per document; text without a host comes back trimmed."""
    return bind(strip(F.coalesce(url, F.lit(""))), _rebuilt)


def has_specific_path(url: Column) -> Column:
    """The URL names a page, not only a host."""
    return F.length(F.btrim(part(url, 3), F.lit("/"))) > 2


def clean_repo(name: Column) -> Column:
    """A repository name without what prose leaves on its end."""
    return F.regexp_replace(F.regexp_replace(name, r"""[.,);:'"]+$""", ""), r"\.git$", "")


def strip_version(paper: Column) -> Column:
    return F.regexp_replace(F.btrim(paper), r"v\d+$", "")


CODE_HOST = r"(?i)github\.com/([\p{L}\p{N}_.-]+)/([\p{L}\p{N}_.-]+)"


def repo_from(text: Column) -> Column:
    """``owner/name`` in lower case from a repository URL or a plain pair."""
    owner = F.lower(F.regexp_extract(text, CODE_HOST, 1))
    name = clean_repo(F.lower(F.regexp_extract(text, CODE_HOST, 2)))
    plain = F.split(F.lower(F.btrim(F.btrim(text), F.lit("/"))), "/")
    ok = (F.size(plain) == 2) & (F.get(plain, F.lit(0)) != "") & (F.get(plain, F.lit(1)) != "")
    return F.when(
        F.regexp_like(text, F.lit(CODE_HOST)), F.when(name != "", F.concat(owner, F.lit("/"), name))
    ).when(ok, F.concat(F.get(plain, F.lit(0)), F.lit("/"), clean_repo(F.get(plain, F.lit(1)))))


def looks_like_site(text: Column) -> Column:
    trimmed = F.btrim(text)
    shaped = F.regexp_like(trimmed, F.lit(r"(?iU)^(https?://)?[\w-]+(\.[\w-]+)+(/\S*)?$"))
    return shaped & ~F.contains(trimmed, F.lit(" "))


def resolve(base: Column, ref: Column) -> Column:
    """An http(s) reference resolved against its page, without dot segments."""
    scheme, host = F.lower(part(base, 1)), part(base, 2)
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme, F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("?")), F.concat(root, part(base, 3), ref))
        .otherwise(F.concat(root, without_dots(F.when(F.startswith(ref, F.lit("/")), ref).otherwise(F.concat(folder, ref)))))
    )


def without_dots(target: Column) -> Column:
    """A rooted path, with or without query, whose ``.`` and ``..`` steps are taken."""
    path = F.regexp_extract(target, "^[^?#]*", 0)
    steps = F.split(path, "/")
    last = F.element_at(steps, -1).isin(".", "..")
    taken = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
    )
    tidy = F.concat(F.lit("/"), F.array_join(taken, "/"), F.when(last & (F.size(taken) > 0), "/").otherwise(""))
    dotted = F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)"))
    return F.when(dotted, F.concat(tidy, F.substring(target, F.length(path) + 1, F.length(target)))).otherwise(target)
