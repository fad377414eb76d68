"""Pages by key, with tokens bound to what they page."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidRequest
from .records import MAX_PAGE, Read, after, fingerprint, order_keys, record_fields, selected


class TokenCodec:
    """``kp1.<claims>.<signature>`` with HMAC-SHA-256; keys have 256 bits or more."""

    def __init__(self, key: bytes):
        if len(key) < 32:
            raise InvalidRequest("the key has at least 256 bits")
        self.key = key

    def encode(self, claims: dict) -> str:
        body = base64.urlsafe_b64encode(json.dumps(claims, sort_keys=True).encode()).decode()
        return f"kp1.{body}.{self._sign(body)}"

    def decode(self, token: str) -> dict:
        parts = token.split(".")
        if len(parts) != 3 or parts[0] != "kp1" or not hmac.compare_digest(parts[2], self._sign(parts[1])):
            raise InvalidRequest("the page token isn't valid")
        return json.loads(base64.urlsafe_b64decode(parts[1]))

    def _sign(self, body: str) -> str:
        return hmac.new(self.key, body.encode(), hashlib.sha256).hexdigest()


def page(records: DataFrame, read: Read, codec: TokenCodec, token: str | None = None, allowed=None, policy: str = "") -> tuple[list, str | None]:
    """One page (at most 1000 rows) and the next page's token; a token of other data, order or access is refused."""
    if not 1 <= read.limit <= MAX_PAGE:
        raise InvalidRequest(f"a page has 1 to {MAX_PAGE} rows")
    chosen = selected(records, read, allowed)
    snapshot = fingerprint(chosen, "id", "revision").first()["digest"]
    asked = hashlib.sha256(repr((sorted(read.kinds), read.predicate, read.order)).encode()).hexdigest()
    claims = {"snapshot": snapshot, "asked": asked, "policy": policy}
    rows = chosen
    if token:
        got = codec.decode(token)
        for k, v in claims.items():
            if got.get(k) != v:
                raise Conflict(f"the page token is stale: {k} differs")
        rows = rows.where(after(records, read.order, tuple(got["cursor"])))
    find = record_fields(records)
    keys = [find(n)[0].alias(f"_k{i}") for i, (n, _) in enumerate(read.order) if find(n)]
    found = rows.select("*", *keys).orderBy(*order_keys(records, read.order)).limit(read.limit + 1).collect()
    more = len(found) > read.limit
    found = found[: read.limit]
    if not more:
        return found, None
    last = found[-1]
    cursor = [last[f"_k{i}"] for i in range(len(keys))] + [last["id"]]
    return found, codec.encode(claims | {"cursor": cursor})


