"""URL functions as column expressions. Two normal forms differ on purpose: one names a page, one is fetched again."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import NEWS_DOMAINS, SOURCE_NAMES
from .text import text

#: Scheme, authority, path and query of any address; all may be empty.
_PARTS = "(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"
#: Addresses that stay as they are when they are made fetchable: a public name in small letters, a path, no query. Most are; telling so costs a hundredth of taking one apart.
_PLAIN = "^https?://(?:[a-z0-9-]+[.])+(?!(?:local|internal|localhost|localdomain|test|invalid)/)[a-z]+/[^?#\\s\x01]*\\z"
#: IPv4 networks that are not public, as first and last number.
RESERVED = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"), ("240.0.0.0", "255.255.255.255"),
]


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use`` of a value that is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(url: Column | str) -> Column:
    """array<string> of scheme, authority, path and query, by one match."""
    return F.split(F.regexp_replace(F.trim(F.translate(text(url), "\t\r\n\x01", "")), _PARTS, "$1\x01$2\x01$3\x01$4"), "\x01")


def part(url: Column | str, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.get(_parts(url), F.lit(n - 1))


def _host(authority: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), ":[^:]*$", "")


def host(url: Column | str) -> Column:
    return _host(part(url, 2))


def _query(query: Column, drop: tuple[str, ...], ordered: bool) -> Column:
    """Parts of a query but for tracking ones, decoded and encoded in one way; a part without ``=`` has an empty value."""

    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    split = lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("").alias("value"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), split)
    own = F.filter(pairs, lambda p: ~F.startswith(F.lower(p["key"]), F.lit("utm_")) & ~F.lower(p["key"]).isin(*drop))
    own = F.transform(own, lambda p: F.struct(plain(p["key"]).alias("key"), plain(p["value"]).alias("value")))
    each = F.transform(F.array_sort(own) if ordered else own, lambda p: F.concat(coded(p["key"]), F.lit("="), coded(p["value"])))
    return F.when(query == "", "").otherwise(F.array_join(each, "&"))


def page_key(url: Column | str) -> Column:
    """Host without www. and port, path without closing slash, sorted query without tracking: one page, one key."""

    def key(p: Column) -> Column:
        query = _query(F.get(p, F.lit(3)), ("spm", "from", "source"), True)
        bare = F.concat(F.regexp_replace(_host(F.get(p, F.lit(1))), "^www\\.", ""), F.regexp_replace(F.get(p, F.lit(2)), "/+$", ""))
        return _let(query, lambda q: F.concat(bare, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))

    return _let(_parts(url), key)


def _number(address: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    shape = address.rlike("^(0|[1-9][0-9]{0,2})(\\.(0|[1-9][0-9]{0,2})){3}$")
    octets = F.transform(F.split(address, "[.]"), lambda o: o.cast("long"))
    return F.when(shape & (F.array_max(octets) <= 255), F.aggregate(octets, F.lit(0).cast("long"), lambda n, o: n * 256 + o))


def _fetchable(p: Column) -> Column:
    authority, scheme = F.get(p, F.lit(1)), F.lower(F.get(p, F.lit(0)))
    port = F.regexp_extract(authority, ":([^:\\]]*)$", 1)
    parse = lambda a: sum(int(x) << (24 - 8 * i) for i, x in enumerate(a.split(".")))

    def public(h: Column) -> Column:
        inside = lambda n: F.exists(F.array(*[F.struct(F.lit(parse(a)).cast("long").alias("a"), F.lit(parse(b)).cast("long").alias("b")) for a, b in RESERVED]), lambda r: n.between(r["a"], r["b"]))
        named = ~h.rlike("\\.(local|internal|localhost|test|invalid)$") & (h != "localhost.localdomain")
        return F.contains(h, F.lit(".")) & ~F.contains(h, F.lit(":")) & named & ~F.coalesce(inside(_number(h)), F.lit(False))

    usual = port.rlike("^(0*(0|80|443))?$")
    return scheme.isin("http", "https") & ~F.contains(authority, F.lit("@")) & usual & _let(F.regexp_replace(_host(authority), "\\.+$", ""), public)


def fetchable(url: Column | str) -> Column:
    """Public http(s) address on a usual port, without user data; loopback, private and reserved names and numbers are not."""
    return _let(_parts(url), _fetchable)


def fetch_url(url: Column | str) -> Column:
    """Lower-case scheme and authority, path or ``/``, query in order without tracking, no fragment; empty if not fetchable."""

    def whole(p: Column) -> Column:
        path = F.when(F.get(p, F.lit(2)) == "", "/").otherwise(F.get(p, F.lit(2)))
        bare = F.concat(F.lower(F.get(p, F.lit(0))), F.lit("://"), F.lower(F.get(p, F.lit(1))), path)
        query = _query(F.get(p, F.lit(3)), ("spm", "from", "fbclid"), False)
        return F.when(_fetchable(p), _let(query, lambda q: F.concat(bare, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))).otherwise("")

    return F.when(text(url).rlike(_PLAIN), text(url)).otherwise(F.coalesce(_let(_parts(url), whole), F.lit("")))


def source_domain(url: Column | str, known: tuple[str, ...] = (*SOURCE_NAMES, *NEWS_DOMAINS)) -> Column:
    """First known domain, in list order, that the host is or lies under; else the host without www. and then without m."""

    def domain(h: Column) -> Column:
        under = F.filter(F.array(*map(F.lit, known)), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))
        return F.coalesce(F.get(under, F.lit(0)), F.regexp_replace(h, "^(www\\.)?(m\\.)?", ""))

    return _let(host(url), domain)


def uid(url: Column | str) -> Column:
    return F.substring(F.md5(text(url).cast("binary")), 1, 12)


def _argument(url: Column | str, name: str) -> Column:
    raw = F.regexp_extract(part(url, 4), f"(?:^|&){name}=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(raw), raw)


def unwrapped(url: Column | str, wrapper: str = "bing.com") -> Column:
    """Target of a search engine's redirect: a plain address, or ``a1`` and base64url; else the address itself."""
    raw = F.trim(text(url))
    value = F.coalesce(*[F.nullif(_argument(raw, k), F.lit("")) for k in ("u", "url", "target", "r", "redir")], F.lit(""))
    body = F.translate(F.substring(value, 3, 100_000), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    link = lambda c: F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))
    found = F.when(link(value), value).when(F.startswith(value, F.lit("a1")) & (F.length(value) > 3) & link(decoded), decoded).otherwise(raw)
    return F.when(F.contains(part(raw, 2), F.lit(wrapper)), found).otherwise(raw)


def account_article(url: Column | str, site: str = "mp.weixin.qq.com") -> Column:
    """Lasting address of an account's article by account, message, index and signature; empty without the first two."""
    keep = [F.when(_argument(url, k) != "", F.concat(F.lit(f"{k}="), F.url_encode(_argument(url, k)))) for k in ("__biz", "mid", "idx", "sn")]
    fits = F.contains(part(url, 2), F.lit(site)) & F.startswith(part(url, 3), F.lit("/s")) & (_argument(url, "__biz") != "") & (_argument(url, "mid") != "")
    return F.when(fits, F.concat(F.lit(f"https://{site}/s?"), F.concat_ws("&", *keep))).otherwise("")
