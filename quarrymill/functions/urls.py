"""Column builders for URLs: all native, null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill import config as C
from quarrymill.functions import text as X


def host(u: Column) -> Column:
    return F.lower(F.try_parse_url(u, F.lit("HOST")))


def normalize(u: Column) -> Column:
    """Trimmed; a browser extension's wrapper is taken off."""
    u = F.regexp_replace(F.coalesce(u, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_extract(u, r"^chrome-extension://.*?https:/+(.*)$", 1)
    return F.when(u.rlike(r"^chrome-extension://.*https:/"), F.concat(F.lit("https://"), inner)).otherwise(u)


def fetchable(u: Column) -> Column:
    """A repository's page of a file becomes the raw file."""
    u = normalize(u)
    blob = r"^https://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/([^?#]+)"
    raw = F.concat(F.lit("https://raw.githubusercontent.com/"), F.concat_ws("/", *(F.regexp_extract(u, blob, i) for i in range(1, 5))))
    return F.when(u.rlike(blob), raw).otherwise(u)


def base(u: Column) -> Column:
    """Without query, fragment and trailing slashes; null stays null."""
    u = F.regexp_replace(u, r"[?#].*$", "")
    return F.regexp_replace(u, r"/+$", "")


def with_fragment(u: Column, fragment: Column) -> Column:
    return F.when(F.coalesce(fragment, F.lit("")) == "", u).otherwise(F.concat(F.split_part(u, F.lit("#"), F.lit(1)), F.lit("#"), fragment))


def tag_utm(u: Column, source: str) -> Column:
    """The campaign parameter replaced or appended; order, blanks and fragment are kept."""
    front = F.regexp_extract(u, r"^([^?#]*)", 1)
    query, fragment = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(u, r"(#.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^utm_source(=|$)"))
    code = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
    pairs = F.transform(kept, lambda p: F.concat(code(F.split_part(p, F.lit("="), F.lit(1))), F.lit("="), code(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))))
    return F.when(F.coalesce(u, F.lit("")) == "", u).otherwise(F.concat(front, F.lit("?"), F.array_join(F.array_append(pairs, F.lit(f"utm_source={source}")), "&"), fragment))


def query_param(u: Column, name: str) -> Column:
    return F.trim(F.coalesce(F.try_parse_url(u, F.lit("QUERY"), F.lit(name)), F.lit("")))


def in_domain(u: Column, domain: str) -> Column:
    h = F.regexp_replace(F.coalesce(host(u), F.lit("")), r"\.+$", "")
    return (h == domain) | h.endswith(f".{domain}")


def path_parts(u: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")


def is_root(u: Column, depth: int) -> Column:
    return F.size(path_parts(u)) == depth


def is_meaningful_link(u: Column, label: Column) -> Column:
    """A web address with a fragment, or with at least two telling words in its label."""
    words = X.without(X.tokens(label), C.LINK_STOPWORDS)
    return F.coalesce(u.rlike("^https?:"), F.lit(False)) & (F.coalesce(u, F.lit("")).rlike("#.") | (F.size(words) >= 2))


def product_of(title: Column, u: Column, doc_type: Column, keywords: Column, rules: list[tuple[str, list[str], list[str], list[str]]]) -> Column:
    """The first product whose words, domains or parts of a url are met, else the document type.

    ``rules`` are ``(product, words, domains, url parts)``, the most telling first.
    """
    said, kind = F.lower(F.concat_ws(" ", title, u, doc_type, keywords)), X.clean(doc_type)
    out = F.when(kind != "", kind).otherwise("Documentation")
    for product, words, domains, parts in reversed(rules):
        met = F.lit(False)
        for one in [*(said.contains(w) for w in words), *(in_domain(u, d) for d in domains), *(F.coalesce(u, F.lit("")).contains(p) for p in parts)]:
            met = met | one
        out = F.when(met, product).otherwise(out)
    return out


def service_url(u: Column, service: str) -> Column:
    """The same address at the service's host."""
    return F.regexp_replace(normalize(u), r"^https?://[^/?#]*", f"https://{service}")


def shown_url(u: Column, source: Column, host_name: str) -> Column:
    """A service's address as readers see it: the source's version in a documentation path, no revision parameter."""
    parts, own = path_parts(u), path_parts(normalize(source))
    version = F.when(F.size(own) >= 3, F.get(own, F.lit(2))).otherwise(F.get(parts, F.lit(2)))
    known = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "documentation")
    path = F.when(known, F.concat(F.slice(parts, 1, 2), F.array(version), F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))))).otherwise(parts)
    query = F.array_join(F.filter(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~p.rlike("^rev(=|$)")), "&")
    return F.concat(F.lit(f"https://{host_name}/"), F.array_join(path, "/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.regexp_extract(u, r"(#.*)$", 1))
