"""URL canonicalization and resolution as Column expressions.

``canonical(url, base)`` gives a struct

    uri           canonical text, null when the URL is illegal
    scheme        lower case
    authority     userinfo@host:port, default port dropped
    path          percent-normalised, dot segments removed
    site          scheme://host[:port]
    fail_message  why there is no uri, else null

URLs that are already in normal form (the bulk of a crawl) are recognised by
one regular expression and skip the octet work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lang import joined, let, squeeze

# Query parameters that carry a session and are dropped.
SESSION_KEYS = ["jsessionid", "phpsessid", "aspsessionid"]

# Ports hidden in the canonical form, per scheme.
DEFAULT_PORTS = {
    "ftp": 21,
    "ssh": 22,
    "telnet": 23,
    "smtp": 25,
    "http": 80,
    "pop3": 110,
    "imap": 143,
    "ldap": 389,
    "https": 443,
}

BLANK_MESSAGE = "the URI string was missing or empty"

CANONICAL_TYPE = (
    "struct<uri:string,scheme:string,authority:string,path:string,site:string,fail_message:string>"
)

_PLAIN_PATH = r"(?:/(?!\.{1,2}(?:/|$))[A-Za-z0-9._~!$&'()*+,;=:@-]*+)*+"
_PLAIN_QUERY = (
    r"(?:\?(?!(?:" + "|".join(SESSION_KEYS) + r")(?:[=#]|$))"
    r"[A-Za-z0-9._~!$'()*,:@/?-]*+(?:=[A-Za-z0-9._~!$'()*,:@/?-]*+)?)?"
)
_PLAIN_ABSOLUTE = r"(?s)^(https?)://([a-z0-9._-]++)(" + _PLAIN_PATH + ")(" + _PLAIN_QUERY + r")(?:#.*+)?$"
_PLAIN_ROOTED = r"^(?=/(?!/))" + _PLAIN_PATH + r"$"
_SCHEME_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*+):(//[^/?#]*+)"

# RFC 3986 appendix B, with the delimiters kept so that "absent" differs from "empty".
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*+):)?(//[^/?#]*+)?([^?#]*+)(\?[^#]*+)?(?:#.*+)?$"

_AUTHORITY = r"(?s)^//(?:(.*)@)?(\[[^\]\[]*\]|[^:\[\]]*)(?::([0-9]*))?$"


def clean(url: Column) -> Column:
    """Encode spaces and drop line breaks."""
    return F.replace(F.translate(url, "\r\n", ""), F.lit(" "), F.lit("%20"))


# Characters that stay as they are in a path segment and in a query key or value.
_PATH_KEEP = r"A-Za-z0-9._~!$&'()*+,;=:@-"
_QUERY_KEEP = r"A-Za-z0-9._~!$'()*,:@/?-"


def _encoded(text: Column, keep: str, space: str) -> Column:
    """Percent-encode the runs of characters outside ``keep``."""

    def run(r: Column) -> Column:
        return F.when(r.rlike(f"^[{keep}]"), r).otherwise(
            F.replace(F.url_encode(r), F.lit("+"), F.lit(space))
        )

    runs = F.regexp_extract_all(text, F.lit(f"[{keep}]++|[^{keep}]++"), F.lit(0))
    return F.when(text.rlike(f"^[{keep}]*+$"), text).otherwise(joined(F.transform(runs, run)))


def encode_path(text: Column) -> Column:
    return _encoded(text, _PATH_KEEP, "%20")


def encode_query(text: Column) -> Column:
    return _encoded(text, _QUERY_KEEP, "+")


def _decode_path(text: Column) -> Column:
    return F.when(~F.contains(text, F.lit("%")), text).otherwise(
        F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    )


def _decode_query(text: Column) -> Column:
    return F.when(text.rlike("^[^%+]*+$"), text).otherwise(F.try_url_decode(text))


def normal_path(path: Column) -> Column:
    """Percent-normalise each segment; null when a ``%`` escape is malformed."""
    return F.when(path.rlike(r"^[A-Za-z0-9._~!$&'()*+,;=:@/-]*+$"), path).otherwise(
        let(
            F.transform(F.split(path, "/"), lambda s: encode_path(_decode_path(s))),
            # array_join skips nulls, so a failed segment is looked for first
            lambda segs: F.when(~F.exists(segs, lambda s: s.isNull()), joined(segs, "/")),
        )
    )


def remove_dots(path: Column) -> Column:
    """Collapse ``.`` and ``..`` segments of a path that starts with ``/``."""

    def step(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    def collapse(segs: Column) -> Column:
        kept = F.aggregate(segs, F.expr("cast(array() as array<string>)"), step)
        ends_open = F.element_at(segs, -1).isin(".", "..")
        return F.concat(
            F.lit("/"),
            let(
                kept,
                lambda k: F.concat(
                    joined(k, "/"),
                    F.when(ends_open & (F.size(k) > 0), F.lit("/")).otherwise(F.lit("")),
                ),
            ),
        )

    dotted = path.rlike(r"^/(?:.*/)?\.{1,2}(?:/|$)")
    return F.when(
        dotted, let(F.split(F.substring(path, 2, 2147483647), "/"), collapse)
    ).otherwise(path)


def normal_query(query: Column) -> Column:
    """``?a=1&b`` sorted by key, last duplicate kept, session keys dropped.

    ``''`` when nothing is left or there was no query, null when illegal: a
    malformed escape or a second ``=`` inside one parameter.
    """

    def parse(p: Column) -> Column:
        return let(
            F.transform(F.split(p, "="), _decode_query),
            lambda kv: F.struct(
                kv[0].alias("key"),
                (F.size(kv) > 1).alias("has_eq"),
                F.when(F.size(kv) > 1, kv[1]).otherwise(F.lit("")).alias("value"),
            ),
        )

    def render(ps: Column) -> Column:
        numbered = F.transform(
            ps,
            lambda p, i: F.struct(
                p["key"].alias("key"), i.alias("i"), p["has_eq"].alias("has_eq"),
                p["value"].alias("value"),
            ),
        )

        def last_of_key(s: Column) -> Column:
            return F.filter(
                s,
                lambda p, i: ~p["key"].isin(*SESSION_KEYS)
                & ~F.coalesce(F.get(s, i + 1)["key"] == p["key"], F.lit(False)),
            )

        return let(
            let(F.array_sort(numbered), last_of_key),
            lambda kept: F.when(F.size(kept) == 0, F.lit("")).otherwise(
                F.concat(
                    F.lit("?"),
                    joined(
                        F.transform(
                            kept,
                            lambda p: joined(
                                F.transform(
                                    F.when(p["has_eq"], F.array(p["key"], p["value"])).otherwise(
                                        F.array(p["key"])
                                    ),
                                    encode_query,
                                ),
                                "=",
                            ),
                        ),
                        "&",
                    ),
                )
            ),
        )

    body = F.substring(query, 2, 2147483647)
    illegal = query.rlike(r"=[^&]*=")
    return (
        F.when(query == "", query)
        .when(illegal, F.lit(None).cast("string"))
        .otherwise(
            let(
                F.transform(F.split(body, "&"), parse),
                lambda ps: F.when(
                    ~F.exists(ps, lambda p: p["key"].isNull() | p["value"].isNull()), render(ps)
                ),
            )
        )
    )


def _authority(raw: Column, scheme: Column) -> Column:
    """struct<authority, site> of ``//…``; fields are null when illegal."""
    ports = F.create_map(*[F.lit(x) for kv in DEFAULT_PORTS.items() for x in kv])

    def build(p: Column) -> Column:
        port = F.when(
            (p["port"] == "")
            | (F.try_element_at(ports, scheme).cast("string") == p["port"])
            | (p["port"] == "0"),
            F.lit(""),
        ).otherwise(F.concat(F.lit(":"), p["port"]))
        user = F.when(p["user"] == "", F.lit("")).otherwise(F.concat(p["user"], F.lit("@")))
        legal = (p["port"] == "") | F.coalesce(
            p["port"].try_cast("int") <= 65535, F.lit(False)
        )
        return F.when(
            legal,
            F.struct(
                F.concat(user, p["host"], port).alias("authority"),
                F.concat(scheme, F.lit("://"), p["host"], port).alias("site"),
            ),
        )

    parts = F.struct(
        F.regexp_extract(raw, _AUTHORITY, 1).alias("user"),
        let(
            F.lower(F.regexp_extract(raw, _AUTHORITY, 2)),
            lambda h: F.when(h.startswith("["), h).otherwise(normal_path(h)),
        ).alias("host"),
        F.regexp_replace(F.regexp_extract(raw, _AUTHORITY, 3), "^0+(?=[0-9])", "").alias("port"),
    )
    return F.when(raw.rlike(_AUTHORITY), let(parts, build))


def _split(url: Column) -> Column:
    return F.struct(
        F.lower(F.regexp_extract(url, _PARTS, 1)).alias("scheme"),
        F.regexp_extract(url, _PARTS, 2).alias("authority"),
        F.regexp_extract(url, _PARTS, 3).alias("path"),
        F.regexp_extract(url, _PARTS, 4).alias("query"),
    )


def _result(uri, scheme, authority, path, site, fail=None) -> Column:
    def text(c):
        return (c if isinstance(c, Column) else F.lit(c)).cast("string")

    return F.struct(
        text(uri).alias("uri"),
        text(scheme).alias("scheme"),
        text(authority).alias("authority"),
        text(path).alias("path"),
        text(site).alias("site"),
        text(fail).alias("fail_message"),
    )


def canonical(url: Column, base: Column | None = None) -> Column:
    """Canonical form of ``url``, resolved against the canonical URL ``base``."""
    if base is None:
        fail = F.format_string("illegal URI [%s]", url)
    else:
        fail = F.format_string("base[%s] relative[%s]", base, url)
    nothing = _result(None, None, None, None, None, fail)

    def resolve(r: Column) -> Column:
        """``r`` holds the split, percent-normalised parts of the reference."""
        if base is None:
            return r
        own = r["scheme"] != ""

        def against(b: Column) -> Column:
            net = r["authority"] != ""
            merged = (
                F.when(r["path"] == "", b["path"])
                .when(r["path"].startswith("/"), r["path"])
                .when(
                    (b["path"] == "") & (b["authority"] != ""), F.concat(F.lit("/"), r["path"])
                )
                .otherwise(F.concat(F.regexp_extract(b["path"], r"(?s)^(.*/)?", 0), r["path"]))
            )
            return F.struct(
                F.when(own, r["scheme"]).otherwise(b["scheme"]).alias("scheme"),
                F.when(own | net, r["authority"]).otherwise(b["authority"]).alias("authority"),
                F.when(own | net, r["path"]).otherwise(merged).alias("path"),
                F.when(own | net | (r["path"] != "") | (r["query"] != ""), r["query"])
                .otherwise(b["query"])
                .alias("query"),
            )

        return let(_split(base), against)

    def render(p: Column) -> Column:
        def final(path: Column, auth: Column) -> Column:
            has_net = p["authority"] != ""
            authority = F.when(has_net, auth["authority"]).otherwise(F.lit(""))
            text = F.concat(
                F.when(p["scheme"] == "", F.lit("")).otherwise(
                    F.concat(p["scheme"], F.lit(":"))
                ),
                F.when(has_net, F.concat(F.lit("//"), authority)).otherwise(F.lit("")),
                path,
                p["query"],
            )
            legal = text.isNotNull() & ~(
                p["scheme"].isin("http", "https") & (authority == "")
            )
            return F.when(
                legal,
                _result(
                    text,
                    p["scheme"],
                    authority,
                    path,
                    F.when(has_net & (p["scheme"] != ""), auth["site"]),
                ),
            ).otherwise(nothing)

        absolute = (p["scheme"] != "") & p["path"].startswith("/")
        return let(
            F.when(absolute, remove_dots(p["path"])).otherwise(p["path"]),
            lambda path: let(
                _authority(p["authority"], p["scheme"]), lambda auth: final(path, auth)
            ),
        )

    def normal(r: Column) -> Column:
        return F.struct(
            r["scheme"].alias("scheme"),
            r["authority"].alias("authority"),
            normal_path(r["path"]).alias("path"),
            normal_query(r["query"]).alias("query"),
        )

    def full(u: Column) -> Column:
        return F.when(u.rlike(r"[\x00-\x20\x7f]"), nothing).otherwise(
            let(_split(u), lambda r: let(normal(r), lambda n: let(resolve(n), render)))
        )

    def plain(p: Column) -> Column:
        site = F.concat(p["scheme"], F.lit("://"), p["host"])
        return _result(
            F.concat(site, p["path"], p["query"]), p["scheme"], p["host"], p["path"], site
        )

    plain_parts = F.struct(
        *[
            F.regexp_extract(url, _PLAIN_ABSOLUTE, i + 1).alias(name)
            for i, name in enumerate(["scheme", "host", "path", "query"])
        ]
    )
    out = F.when(
        url.isNull() | (squeeze(url) == ""),
        _result(None, None, None, None, None, BLANK_MESSAGE),
    ).when(url.rlike(_PLAIN_ABSOLUTE), let(plain_parts, plain))
    if base is not None:
        # the base is canonical, so its "scheme://authority" needs no further work
        root = F.regexp_extract(base, _SCHEME_AUTHORITY, 0)
        net = F.substring(F.regexp_extract(base, _SCHEME_AUTHORITY, 2), 3, 2147483647)
        scheme = F.regexp_extract(base, _SCHEME_AUTHORITY, 1)
        out = out.when(
            url.rlike(_PLAIN_ROOTED) & (root != ""),
            _result(
                F.concat(root, url),
                scheme,
                net,
                url,
                F.concat(scheme, F.lit("://"), F.regexp_replace(net, "^.*@", "")),
            ),
        )
    return out.otherwise(let(clean(url), full))
