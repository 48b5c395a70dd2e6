"""URLs after the WHATWG rules, for the schemes a crawl meets: resolve, canonical form, host, origin."""

from __future__ import annotations

import re
from urllib.parse import quote

PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
#: Query keys that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "mc_cid", "mc_eid", "ref", "ref_src")

_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):")
_PATH_SAFE = "/%:@!$&'()*+,;=-._~[]|\\^"
_QUERY_SAFE = "/%:@!$&()*+,;=-._~?[]|\\^`{}"
_FRAGMENT_SAFE = "/%:@!$&'()*+,;=-._~?[]|\\^{}#"


class Url:
    """A parsed URL; for schemes other than those of PORTS only scheme and rest are kept."""

    __slots__ = ("scheme", "user", "host", "port", "path", "query", "fragment", "opaque")

    def __init__(self, scheme, user="", host="", port="", path="", query=None, fragment=None, opaque=None):
        self.scheme, self.user, self.host, self.port, self.path = scheme, user, host, port, path
        self.query, self.fragment, self.opaque = query, fragment, opaque

    def __str__(self) -> str:
        if self.opaque is not None:
            return f"{self.scheme}:{self.opaque}"
        tail = (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")
        return f"{self.scheme}://{self.user}{self.netloc}{self.path}{tail}"

    @property
    def netloc(self) -> str:
        return self.host + (f":{self.port}" if self.port else "")


def _dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        low = part.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _host(text: str) -> str | None:
    if text.startswith("["):
        return text.lower() if text.endswith("]") else None
    text = re.sub(r"%([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), text).lower()
    if not text.isascii():
        try:
            text = ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in re.split("[.。．｡]", text))
        except UnicodeError:
            return None
    return None if not text or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", text) else text


def _clean(text: str) -> str:
    return re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))


def _split(rest: str) -> tuple[str, str | None, str | None]:
    rest, hash_, fragment = rest.partition("#")
    path, mark, query = rest.partition("?")
    return path, quote(query, safe=_QUERY_SAFE) if mark else None, quote(fragment, safe=_FRAGMENT_SAFE) if hash_ else None


def _authority(scheme: str, rest: str) -> Url | None:
    m = re.match(r"[^/?#]*", rest)
    user, at, place = m[0].rpartition("@")
    pm = re.search(r":(\d*)\Z", place) if not place.endswith("]") else None
    port = pm[1].lstrip("0") or ("0" if pm[1] else "") if pm else ""
    host = _host(place[: pm.start()] if pm else place)
    if host is None or port and int(port) > 65535:
        return None
    path, query, fragment = _split(rest[m.end() :])
    return Url(scheme, quote(user, safe="%:!$&'()*+,;=-._~") + at, host, "" if port == PORTS[scheme] else port, _dots(quote(path or "/", safe=_PATH_SAFE)), query, fragment)


def parse(text: str, base: Url | None = None) -> Url | None:
    """The URL, against a base if it's relative; None if it's none."""
    text = _clean(text)
    if m := _SCHEME.match(text):
        scheme, rest = m[1].lower(), text[m.end() :]
        if scheme not in PORTS:
            return Url(scheme, opaque=rest)
        if base is None or base.scheme != scheme or rest[:2].replace("\\", "/") == "//":
            return _authority(scheme, _slashes(rest).lstrip("/"))
        text = rest
    if base is None or base.opaque is not None:
        return None
    text = _slashes(text)
    if text.startswith("//"):
        return _authority(base.scheme, text.lstrip("/"))
    path, query, fragment = _split(text)
    if not path:
        return Url(base.scheme, base.user, base.host, base.port, base.path, base.query if query is None else query, fragment)
    path = quote(path, safe=_PATH_SAFE)
    if not path.startswith("/"):
        path = base.path[: base.path.rindex("/") + 1] + path
    return Url(base.scheme, base.user, base.host, base.port, _dots(path), query, fragment)


def _slashes(text: str) -> str:
    at = re.search(r"[?#]|\Z", text).start()
    return text[:at].replace("\\", "/") + text[at:]


def resolve(base: str | None, href: str | None) -> str | None:
    """href against base; None if href is empty or no URL results."""
    return resolve_all(base, [href])[0]


def resolve_all(base: str | None, hrefs: list[str | None]) -> list[str | None]:
    """Each href against the one base, which is parsed once."""
    against = parse(base) if base and hrefs else None
    out = []
    for href in hrefs:
        found = parse(href, against) if href and href.strip() else None
        out.append(None if found is None else str(found))
    return out


_FORM_SAFE = "*-._"


def _form(text: str) -> str:
    return quote(text, safe=_FORM_SAFE + " ").replace("~", "%7E").replace(" ", "+")


def _pairs(query: str) -> list[tuple[str, str]]:
    from urllib.parse import unquote_plus

    return [(unquote_plus(k), unquote_plus(v)) for k, _, v in (p.partition("=") for p in query.split("&") if p)]


def form_encode(pairs: list[tuple[str, str]]) -> str:
    return "&".join(f"{_form(k)}={_form(v)}" for k, v in pairs)


def canonicalize(url: str | None) -> str | None:
    """Without fragment and tracking keys, query pairs sorted and encoded anew; None if it's no URL."""
    found = parse(url) if url else None
    if found is None or found.opaque is not None:
        return None if found is None else str(found).partition("#")[0]
    found.fragment = None
    if found.query is not None:
        pairs = sorted(p for p in _pairs(found.query) if p[0].lower() not in TRACKING)
        found.query = form_encode(pairs) if pairs else None
    return str(found)


def is_http(url: str | None) -> bool:
    found = parse(url) if url else None
    return found is not None and found.scheme in ("http", "https")


def host_of(url: str | None) -> str | None:
    """Host with a port other than the scheme's own."""
    found = parse(url) if url else None
    return found.netloc if found is not None and found.host else None


def origin_of(url: str | None) -> str | None:
    found = parse(url) if url else None
    return f"{found.scheme}://{found.netloc}" if found is not None and found.host else None
