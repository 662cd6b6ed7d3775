"""URL functions.

Column expressions cover URLs whose paths carry no percent escapes; canonical() is exact for all, an Arrow UDF over
the standard library. The two agree where both apply.
"""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that name a campaign or a session, compared in lower case.
DROPPED_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "ysclid", "mc_cid", "mc_eid",
    "phpsessid", "jsessionid", "sessionid", "sid",
)
#: Endings of paths that are not pages.
ASSET_ENDINGS = (
    "pdf", "zip", "gz", "tar", "rar", "7z", "jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "tiff", "mp4", "webm", "avi", "mov", "mkv", "flv", "mp3",
    "ogg", "wav", "flac", "aac", "css", "js", "mjs", "map", "woff", "woff2", "ttf", "eot", "otf", "xml", "json", "rss", "atom", "doc", "docx", "xls", "xlsx",
    "ppt", "pptx", "exe", "dmg", "apk", "deb", "rpm",
)
#: Second-level labels under which a country's registrations lie one label deeper.
SHARED_LABELS = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Hosts no fetch may reach, whatever they resolve to.
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "metadata", "metadata.google.internal", "ip6-localhost", "ip6-loopback")
PORTS = {"http": 80, "https": 443}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dotless(path: str) -> str:
    """Without . and .. segments; .. never climbs above the root and the root's own slash stays."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if kept and kept[-1]:
                del kept[-1]
        elif part != ".":
            kept.append(part)
    joined = "/".join(kept)
    return joined if joined[:1] == "/" or path[:1] != "/" else f"/{joined}"


def canonical(url: str, aggressive: bool = True) -> str:
    """The form under which URLs are the same page.

    Scheme and host in lower case, no user, default port or path parameters; path unquoted, dots resolved, never empty. Aggressive: no
    fragment, no campaign or session parameters, the rest sorted by name (values of one name stay in order).
    Raises ValueError for what is no URL.
    """
    s = urlsplit(url)
    host, port = (s.hostname or "").lower(), s.port
    scheme = s.scheme.lower()
    path, mark, last = s.path.rpartition("/")
    path = path + mark + last.partition(";")[0]  # parameters of the last segment
    query = s.query
    if aggressive:
        pairs = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k.lower() not in DROPPED_PARAMS]
        query = urlencode(sorted(pairs, key=lambda p: p[0]))
    out = f"{scheme}:" if scheme else ""
    if host:
        out += f"//{host}" + (f":{port}" if port and port != PORTS.get(scheme) else "")
    out += dotless(unquote(path)) or "/"
    if query:
        out += f"?{query}"
    return out + (f"#{s.fragment}" if s.fragment and not aggressive else "")


@F.pandas_udf(T.StringType())
def canonical_url(url: pd.Series) -> pd.Series:
    """canonical(), null for what is no URL."""

    def one(u):
        try:
            return None if u is None else canonical(u)
        except ValueError:
            return None

    return url.map(one)


def scheme_guard(url: Column | str) -> Column:
    return F.lower(F.trim(_col(url))).rlike("^https?://")


def host(url: Column | str) -> Column:
    """Lower-case host of an absolute URL, '' without one."""
    return F.lower(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), r"^[^?#]*\?([^#]*)", 1)


def dotless_path(path: Column | str) -> Column:
    """dotless() as a fold over segments."""
    p = _col(path)
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(p, "/"), start,
        lambda acc, s: F.when(s == "..", F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ""), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(p.startswith("/") & ~joined.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)


def canonical_expr(url: Column | str) -> Column:
    """canonical() for URLs without escapes, JVM-side."""
    u = F.trim(_col(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    port = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)
    usual = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    path = F.regexp_replace(path_of(u), r";[^/]*$", "")
    path = dotless_path(path)
    pairs = F.filter(F.split(query_of(u), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p, i: F.struct(F.split(p, "=")[0].alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    kept = F.array_sort(F.filter(named, lambda x: ~F.lower(x["k"]).isin(*DROPPED_PARAMS)))
    query = F.array_join(F.transform(kept, lambda x: x["p"]), "&")
    return F.concat(
        scheme, F.lit("://"), host(u), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", F.lit("/")).otherwise(path), F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )


def same_domain(url: Column | str, base: Column | str) -> Column:
    """The base's host or one below it; a base may carry a port."""
    b = F.split(F.lower(F.lit(base) if isinstance(base, str) else base), ":")[0]
    h = host(url)
    return (h == b) | h.endswith(F.concat(F.lit("."), b))


def is_page(url: Column | str) -> Column:
    return ~F.lower(path_of(url)).rlike(rf"\.({'|'.join(ASSET_ENDINGS)})$")


def registered_domain(name: Column | str) -> Column:
    """The last two labels of a host, three below a country's shared label; null for none."""
    h = F.regexp_replace(F.lower(_col(name)), r"\.+$", "")
    parts = F.split(h, r"\.")
    n = F.size(parts)
    shared = (n >= 3) & F.try_element_at(parts, F.lit(-2)).isin(*SHARED_LABELS) & (F.length(F.element_at(parts, -1)) <= 3)
    last = lambda k: F.array_join(F.slice(parts, F.lit(-k), F.lit(k)), ".")
    return F.when(h == "", F.lit(None)).when(shared, last(3)).when(n >= 2, last(2)).otherwise(h)


def fold_key(url: Column | str) -> Column:
    """Host without www, path without trailing slashes, query: scheme, port and fragment do not tell pages apart."""
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.lit("|"), F.regexp_replace(path_of(url), "/+$", ""), F.lit("|"), query_of(url))


def is_trap(url: Column | str) -> Column:
    """More than four segments, one of them twice."""
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    return (F.size(parts) > 4) & (F.size(F.array_distinct(parts)) < F.size(parts))


def pattern_of(url: Column | str) -> Column:
    """The path with dates and numbers in its segments made {DATE} and {N}."""
    parts = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    masked = F.transform(parts, lambda s: F.when(s.rlike(r"^\d+$"), F.lit("{N}")).when(s.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.lit("{DATE}")).otherwise(s))
    return F.array_join(masked, "/")


def origin_allowed(origin: Column | str, allowed: list[str]) -> Column:
    """A listed host, or one under a listed *.domain (which allows the domain too)."""
    h = F.lower(F.when(_col(origin).contains("://"), host(origin)).otherwise(_col(origin)))
    out = F.lit(False)
    for a in allowed:
        a = a.lower()
        out = out | ((h == a[2:]) | h.endswith(a[1:]) if a.startswith("*.") else h == a)
    return out


def is_safe_host(name: str) -> bool:
    """Lexical half of a fetch guard: no blocked, private, local or all-numeric host."""
    h = name.strip("[]").rstrip(".").lower()
    if not h or h in BLOCKED_HOSTS or h.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        return ipaddress.ip_address(h).is_global and not ipaddress.ip_address(h).is_multicast
    except ValueError:
        return not all(part.isdigit() or part.startswith("0x") for part in h.split("."))


def is_safe_url(url: str | None) -> bool:
    try:
        s = urlsplit(url or "")
        return s.scheme.lower() in PORTS and s.username is None and s.password is None and is_safe_host(s.hostname or "")
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def safe_url(url: pd.Series) -> pd.Series:
    """is_safe_url(); what a name resolves to is for the fetcher to check."""
    return url.map(is_safe_url)
