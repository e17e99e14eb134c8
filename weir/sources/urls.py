"""Transport URLs: scheme://target?key=value&key=value."""

from __future__ import annotations

from dataclasses import dataclass

from weir.errors import UrlError

# The schemes that parse. shm and file have a table behind them; the others are grammar only.
SCHEMES = ("shm", "bus", "unix", "tcp", "file")


@dataclass(frozen=True)
class TransportUrl:
    scheme: str
    target: str
    query: tuple[tuple[str, str], ...] = ()

    @classmethod
    def parse(cls, text: str) -> TransportUrl:
        """UrlError.reason: empty, missing scheme, unsupported scheme, missing target, invalid port, invalid query."""
        if not text:
            raise UrlError("empty", text)
        scheme, sep, rest = text.partition("://")
        if not sep or not scheme:
            raise UrlError("missing scheme", text)
        if scheme not in SCHEMES:
            raise UrlError("unsupported scheme", text)
        target, _, query = rest.partition("?")
        if not target:
            raise UrlError("missing target", text)
        if scheme == "tcp":
            host, colon, port = target.partition("/")[0].rpartition(":")
            if not colon or not host or not (port.isascii() and port.isdigit()) or int(port) > 65535:
                raise UrlError("invalid port", text)
        pairs = []
        for part in filter(None, query.split("&")):
            key, eq, value = part.partition("=")
            if not eq or not key:
                raise UrlError("invalid query", text)
            pairs.append((key, value))
        return cls(scheme, target, tuple(pairs))

    def param(self, key: str) -> str | None:
        """The first value of key."""
        return next((v for k, v in self.query if k == key), None)

    @property
    def params(self) -> dict[str, str]:
        """First values by key."""
        return dict(reversed(self.query))

    def number(self, key: str, default: int) -> int:
        value = self.param(key)
        if value is None:
            return default
        if not value.isascii() or not value.isdigit() or int(value) < 1:
            raise UrlError(f"{key} is no number above 0", str(self))
        return int(value)

    def flag(self, key: str) -> bool:
        return (self.param(key) or "").lower() in ("1", "true", "yes")

    @property
    def label(self) -> str:
        return f"{self.scheme}:{self.target}"

    def __str__(self) -> str:
        query = "&".join(f"{k}={v}" for k, v in self.query)
        return f"{self.scheme}://{self.target}" + (f"?{query}" if query else "")


def parse_transport_url(text: str) -> tuple[str, str, dict[str, str]]:
    url = TransportUrl.parse(text)
    return url.scheme, url.target, url.params
