"""URLs as identity keys: parsing, resolution and canonical form, all as native columns.

Supported: ASCII hosts, dotted-quad and bracketed hosts, ports, user info, dot segments,
percent-encoding and form-encoded queries. A host that needs punycode, or a numeric host in
another notation, gives null, which callers count as an unusable URL.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyledger.functions.steps import Getter, Stage, add_steps, map_steps
from storyledger.functions.text import web_trim

# Query parameters that name a campaign or a referrer, never a resource.
TRACKING_PARAMS = (
    "fbclid", "gclid", "dclid", "msclkid", "twclid", "igshid", "mc_cid", "mc_eid",
    "ref", "ref_src", "ref_url", "referrer", "source", "cmp", "ncid", "spm",
    "at_medium", "at_campaign", "at_custom1", "at_custom2",
    "__twitter_impression", "_ga", "_gl", "amp",
)
# Listed in mixed case next to the names above, but looked up in lower case,
# so they never match. ``strip_mixed_case`` turns them on.
MIXED_CASE_PARAMS = ("outputType", "feedType", "feedName")
# Prefixes of whole parameter families.
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_", "matomo_")
# Host prefixes that serve the same resource as the bare host.
HOST_PREFIXES = ("www.", "amp.", "m.")
AMP_CACHE_SUFFIX = ".cdn.ampproject.org"
# Groups: the marker of a secure origin, the page's host and path, its query.
AMP_CACHE = (
    r"^(?i:https?:/*(?:[^/?#@]*@)?[^/?#:@]+\.cdn\.ampproject\.org)(?::[0-9]*)?/+c/+(?!s/*(?:[?#]|$))"
    r"(s/+)?((?:[^/?#@]*@)?[!-~&&[^#/:<>?@\[\]\\^|%]]+(?::[0-9]{0,5})?(?:/[^?#]*)?)(?:(\?[^#]*)|[#]|$)"
)

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST = r"""^(?:[!"$&'()*+,.0-9;=_`a-z{}~\-]+|\[[0-9a-f:.]+\])$"""
NUMERIC_LAST_LABEL = r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DOTTED_QUAD = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
DOT_SEGMENT = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"
ONE_DOT = r"(?i)^(?:\.|%2e)$"
TWO_DOTS = r"(?i)^(?:\.|%2e){2}$"


def _after(text: Column, prefix: Column) -> Column:
    """What follows ``prefix`` at the start of ``text``."""
    return F.substr(text, F.char_length(prefix) + 1)


def _percent_encode(col: Column, unsafe: str) -> Column:
    """UTF-8 percent-encode each character in the class ``unsafe``; the rest is left alone."""
    runs = F.regexp_extract_all(col, F.lit(rf"([^{unsafe}]+|[{unsafe}])"), F.lit(1))
    encoded = F.transform(
        runs,
        lambda run: F.when(
            run.rlike(rf"^[{unsafe}]$"), F.regexp_replace(F.url_encode(run), r"\+", "%20")
        ).otherwise(run),
    )
    return F.when(col.rlike(f"[{unsafe}]"), F.array_join(encoded, "")).otherwise(col)


PATH_UNSAFE = r'\x00-\x20\x7F-\x{10FFFF}"<>`{}'
QUERY_UNSAFE = r"""\x00-\x20\x7F-\x{10FFFF}"<>'"""


def _fold_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.rlike(TWO_DOTS), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(part.rlike(ONE_DOT), acc)
        .otherwise(F.array_append(acc, part)),
    )
    tail = F.when(last.rlike(TWO_DOTS) | last.rlike(ONE_DOT), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(
        path.rlike(DOT_SEGMENT), F.regexp_replace(F.concat(joined, tail), r"^//$", "/")
    ).otherwise(path)


def parse_stages(source: str = "raw") -> list[Stage]:
    """Split the absolute URL in step ``source``. ``ok`` tells whether it is a usable http(s) URL."""
    return [
        {"flat": lambda g: F.regexp_replace(g(source), r"[\t\n\r]", "")},
        {"no_frag": lambda g: F.substring_index(g("flat"), "#", 1)},
        {
            "frag": lambda g: _after(g("flat"), g("no_frag")),
            "front": lambda g: F.substring_index(g("no_frag"), "?", 1),
        },
        {
            "query": lambda g: _after(g("no_frag"), g("front")),
            "scheme": lambda g: F.lower(F.regexp_extract(g("front"), SCHEME, 1)),
            "rest": lambda g: F.regexp_extract(
                F.translate(g("front"), "\\", "/"), r"(?s)^[^:]*:/*(.*)$", 1
            ),
        },
        {"authority": lambda g: F.substring_index(g("rest"), "/", 1)},
        {
            "raw_path": lambda g: _after(g("rest"), g("authority")),
            "user": lambda g: F.regexp_extract(g("authority"), r"^(.*@)", 1),
            "host_port": lambda g: F.substring_index(g("authority"), "@", -1),
        },
        {
            "host": lambda g: F.lower(F.regexp_extract(g("host_port"), r"^(\[[^\]]*\]|[^:]*)", 1)),
            "port_text": lambda g: F.regexp_extract(
                g("host_port"), r"^(?:\[[^\]]*\]|[^:]*)(?::(.*))?$", 1
            ),
            "safe_path": lambda g: F.when(g("raw_path") == "", F.lit("/")).otherwise(
                _percent_encode(g("raw_path"), PATH_UNSAFE)
            ),
        },
        {
            "path": lambda g: _fold_dots(g("safe_path")),
            "port_number": lambda g: F.when(
                g("port_text").rlike(r"^[0-9]{1,9}$"), g("port_text").try_cast("int")
            ),
        },
        {
            "ok": lambda g: F.coalesce(
                g("scheme").isin("http", "https")
                & g("host").rlike(HOST)
                & (~g("host").rlike(NUMERIC_LAST_LABEL) | g("host").rlike(DOTTED_QUAD))
                & ((g("port_text") == "") | (g("port_number") <= 65535)),
                F.lit(False),
            ),
            "port": lambda g: F.when(
                g("port_number").isNull()
                | ((g("scheme") == "http") & (g("port_number") == 80))
                | ((g("scheme") == "https") & (g("port_number") == 443)),
                F.lit(""),
            ).otherwise(F.concat(F.lit(":"), g("port_number").cast("string"))),
        },
    ]


def _absolute_text(col: Column) -> Column:
    """Trim; give protocol-relative and bare-host forms a scheme. Blank gives null."""
    text = web_trim(col)
    return (
        F.when(text == "", F.lit(None).cast("string"))
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(~text.rlike(SCHEME), F.concat(F.lit("https://"), text))
        .otherwise(text)
    )


def _unwrap_amp_cache(text: Column) -> Column:
    """``<x>.cdn.ampproject.org/c/[s/]host/path`` names the page it caches; keep the query."""
    scheme = F.when(F.regexp_extract(text, AMP_CACHE, 1) != "", F.lit("https://")).otherwise(
        F.lit("http://")
    )
    page = F.concat(scheme, F.regexp_extract(text, AMP_CACHE, 2), F.regexp_extract(text, AMP_CACHE, 3))
    return F.when(F.lower(text).contains(AMP_CACHE_SUFFIX) & text.rlike(AMP_CACHE), page).otherwise(text)


def _bare_host(host: Column) -> Column:
    """Strip one leading prefix, unless only a top-level domain would remain."""
    out = host
    for prefix in reversed(HOST_PREFIXES):
        rest = F.substr(host, F.lit(len(prefix) + 1))
        out = F.when(
            host.startswith(prefix), F.when(rest.contains("."), rest).otherwise(host)
        ).otherwise(out)
    return out


def _form_decode(col: Column) -> Column:
    """Form-decode; a stray percent sign stands for itself."""
    return F.try_url_decode(F.regexp_replace(col, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _kept_query(query: Column, strip_mixed_case: bool) -> Column:
    """Drop tracking parameters, sort the rest by key (stable) and serialise them again."""
    drop = list(TRACKING_PARAMS)
    if strip_mixed_case:
        drop += [name.lower() for name in MIXED_CASE_PARAMS]
    family = "^(?:" + "|".join(TRACKING_PREFIXES) + ")"
    pairs = F.transform(
        F.filter(F.split(F.substr(query, F.lit(2)), "&"), lambda p: p != ""),
        lambda p, i: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("key"),
            i.alias("at"),
            _form_decode(F.substr(p, F.char_length(F.substring_index(p, "=", 1)) + 2)).alias("value"),
        ),
    )
    kept = F.filter(
        pairs, lambda p: ~(F.lower(p["key"]).isin(drop) | F.lower(p["key"]).rlike(family))
    )
    text = F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"])),
        ),
        "&",
    )
    return F.when(F.char_length(query) <= 1, F.lit("")).otherwise(
        F.regexp_replace(F.concat(F.lit("?"), text), r"^\?$", "")
    )


def _kept_path(path: Column, lowercase: Column) -> Column:
    """Drop empty segments and one ``amp`` segment (last, else first)."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts)
    kept = (
        F.when(F.lower(F.get(parts, n - 1)) == "amp", F.slice(parts, 1, F.greatest(n - 1, F.lit(0))))
        .when(F.lower(F.get(parts, F.lit(0))) == "amp", F.slice(parts, 2, F.greatest(n - 1, F.lit(0))))
        .otherwise(parts)
    )
    simple = ~path.contains("//") & ~path.endswith("/") & ~path.rlike(r"(?i)/amp(?:/|$)")
    text = F.when(simple, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))
    return F.when(lowercase, F.lower(text)).otherwise(text)


@lru_cache
def canonical_stages(
    source: str = "input",
    *,
    keep_prefix: bool = False,
    lowercase: str | None = None,
    strip_mixed_case: bool = False,
) -> tuple[Stage, ...]:
    """From the text in step ``source`` to step ``url`` (null when unusable) and ``url_host``.

    ``lowercase`` names a boolean input step that asks for a lower-case path.
    """
    def lower_flag(g: Getter) -> Column:
        return g(lowercase) if lowercase else F.lit(False)

    return (
        {"raw": lambda g: _absolute_text(g(source))},
        {"page": lambda g: _unwrap_amp_cache(g("raw"))},
        *parse_stages("page"),
        {
            "url_host": lambda g: F.when(
                g("ok"), g("host") if keep_prefix else _bare_host(g("host"))
            ),
            "url_path": lambda g: _kept_path(g("path"), lower_flag(g)),
            "url_query": lambda g: _kept_query(g("query"), strip_mixed_case),
        },
        {
            "url": lambda g: F.when(
                g("ok"),
                F.concat(
                    g("scheme"), F.lit("://"), g("user"), g("url_host"), g("port"),
                    g("url_path"), g("url_query"),
                ),
            )
        },
    )


def with_canonical_url(
    df: DataFrame,
    url_col: str,
    *,
    out: str = "url",
    host_out: str | None = None,
    keep_prefix: bool = False,
    lowercase: Column | None = None,
    strip_mixed_case: bool = False,
) -> DataFrame:
    """Add the identity key of ``url_col`` (null when it is not a usable http(s) URL)."""
    inputs = {"input": F.col(url_col)}
    if lowercase is not None:
        inputs["lowercase"] = F.coalesce(lowercase, F.lit(False))
    outputs = {"url": out}
    if host_out:
        outputs["url_host"] = host_out
    stages = canonical_stages(
        keep_prefix=keep_prefix,
        lowercase="lowercase" if lowercase is not None else None,
        strip_mixed_case=strip_mixed_case,
    )
    return add_steps(df, stages, inputs, outputs)


@lru_cache
def canonical_urls(array: str) -> Column:
    """Canonical form of each URL of an ``array<string>`` column, with its host."""
    start = F.transform(F.col(array), lambda x: F.struct(x.alias("input")))
    done = map_steps(start, ["input"], canonical_stages())
    return F.transform(
        done, lambda x: F.struct(x["url"].alias("url"), x["url_host"].alias("host"))
    )


def host_of(col: Column) -> Column:
    """Host of an already canonical URL."""
    return F.lower(
        F.regexp_extract(col, r"^https?://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    )


def is_same_domain(host: Column, domain: Column) -> Column:
    """Whether a canonical host is ``domain`` or lies below it."""
    target = F.regexp_replace(F.lower(domain), r"^www\.", "")
    return F.coalesce((host == target) | host.endswith(F.concat(F.lit("."), target)), F.lit(False))


def with_budget_host(df: DataFrame, url_col: str, out: str = "host") -> DataFrame:
    """The host that polls are budgeted by: only ``www.`` is dropped; 'unknown' when unparseable."""
    return add_steps(df, _budget_stages(), {"input": F.col(url_col)}, {"budget": out})


@lru_cache
def _budget_stages() -> tuple[Stage, ...]:
    return (
        {"raw": lambda g: web_trim(g("input"))},
        *parse_stages("raw"),
        {
            "budget": lambda g: F.when(
                g("ok"), F.regexp_replace(g("host"), r"^www\.", "")
            ).otherwise(F.lit("unknown"))
        },
    )


# ---- relative references -------------------------------------------------------------


def base_parts(base: Column) -> Column:
    """The parts of an absolute page URL that relative references build on."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^https?://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.struct(
        F.regexp_extract(base, r"^(https?):", 1).alias("scheme"),
        origin.alias("origin"),
        path.alias("path"),
        F.regexp_extract(path, r"^(.*/)", 1).alias("folder"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )


def _joined(href: Column, base: Column) -> Column:
    head = F.concat(base["origin"], base["path"])
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.rlike(r"^[/\\]{2}"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.rlike(r"^[/\\]"), F.concat(base["origin"], href))
        .when(href.startswith("?"), F.concat(head, href))
        .when(href.startswith("#") | (href == ""), F.concat(head, base["query"], href))
        .otherwise(F.concat(base["origin"], base["folder"], href))
    )


@lru_cache
def resolve_stages(href: str, base: str, *, keep_fragment: bool = True) -> tuple[Stage, ...]:
    """Resolve step ``href`` against step ``base`` (see :func:`base_parts`) into step ``resolved``.

    Anything that is not http(s) after resolution gives null.
    """
    return (
        {"raw": lambda g: _joined(web_trim(g(href)), g(base))},
        *parse_stages("raw"),
        {
            "resolved": lambda g: F.when(
                g("ok"),
                F.concat(
                    g("scheme"), F.lit("://"), g("user"), g("host"), g("port"), g("path"),
                    _percent_encode(g("query"), QUERY_UNSAFE),
                    g("frag") if keep_fragment else F.lit(""),
                ),
            )
        },
    )


def with_resolved(
    df: DataFrame, href_col: str, base_col: str, out: str = "resolved", *, keep_fragment: bool = True
) -> DataFrame:
    """Resolve ``href_col`` against the page URL in ``base_col``."""
    return add_steps(
        df,
        resolve_stages("href", "base", keep_fragment=keep_fragment),
        {"href": F.col(href_col), "base": base_parts(F.col(base_col))},
        {"resolved": out},
    )
