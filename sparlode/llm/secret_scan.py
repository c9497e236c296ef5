"""Operator 9, secret scans with multipart credential linking.

A scope is one document. Three kinds of parts are found with their intervals: access identifiers (key ids, user or client
names that are assigned, mail addresses), secrets and endpoints (URLs, hosts with a port, addresses). A secret is strong
if its form or an assignment names it as one, weak if it is only a long random string. The interval join widens the
interval of each weak secret by ``window`` characters and pairs it with the nearest identifier and endpoint it then
overlaps; a weak candidate is reported only if an identifier is among them. Strong ones are reported always, with what
lies near. Scope and join key are the row itself, so the join is a sweep over sorted intervals inside each task: nothing
is shuffled, and a document with very many parts costs n log n.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, need, slices

#: Every part contains one of these, so most texts are done after one pass.
_some = re.compile(r"[=:@]|[A-Za-z0-9+/_-]{20}|-----BEGIN|xox[abprs]-|eyJ")
_access = re.compile(
    r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}\b"
    r"|(?i:\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key(?:_?id)?|key_?id)\b[\"']?\s*[=:]\s*[\"']?)(?P<v>[\w.@+-]{3,})"
)
#: What follows the at sign of a mail address; what precedes it is read backwards.
_mail = re.compile(r"(?<=[\w.+-])@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b")
_local = re.compile(r"[\w.+-]*")
#: A port behind a name; the name is read backwards.
_port = re.compile(r"(?<=[A-Za-z]):\d{2,5}\b")
_name = re.compile(r"[A-Za-z0-9.-]*")
_host = re.compile(r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}\Z")
_begin = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
_end = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: What follows the first line of a key block that has no end.
_body = re.compile(r"(?:\s+[A-Za-z0-9+/=]{16,}(?![^\s]))*")
_formed = re.compile(
    r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{35}|glpat-[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
    r"|(?i:(?:token|secret|passw(?:or)?d|pwd|api_?key|private_?key|auth_?key|secret_?(?:access_?)?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<v>[^\s\"'<>,;]{8,})"
    r"|(?i:(?P<n>[_-]key)\b[\"']?\s*[=:]\s*[\"']?)(?P<w>[^\s\"'<>,;=:&#]{16,})"
)
#: Names in _key whose values are no secrets; those of the others must look random.
_open = re.compile(r"(?i:access|public|primary|foreign|partition|sort)[_-]key\Z")
_rest = re.compile(r"[^\s\"'<>,;]*")
_random = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
_url = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{3,}")
_login = re.compile(r"://(?P<user>[^\s:/?#]*)(?P<pair>:(?P<password>[^\s/?#]*))?@")
#: Parts of a path, and the values of a query or fragment.
_piece = re.compile(r"(?<=[/?#&=;])[^/?#&=;]{20,}={0,2}(?=[/?#&;]|\Z)")
_word_piece = re.compile(r"[A-Za-z0-9_+]+={0,2}\Z")
_plain = re.compile(r"[A-Za-z0-9+_.~%-]+={0,2}\Z")
_endpoint = re.compile(
    r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?\b"
    r"|(?i:\b(?:host|endpoint|server)\b[\"']?\s*[=:]\s*[\"']?)(?P<v>[\w.-]{3,})"
)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _spans(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    named = "v" in pattern.groupindex
    return [m.span("v") if named and m.group("v") is not None else m.span() for m in pattern.finditer(text)]


def _before(text: str, run: re.Pattern, at: int, floor: int) -> int:
    """Where the run of characters that ends at ``at`` begins, not before ``floor``; in steps that double, so that its cost is its length."""
    step = 64
    while True:
        low = max(floor, at - step)
        tail = run.match(text[low:at][::-1]).end()
        if tail < at - low or low == floor:
            return at - tail
        step *= 2


def _mails(text: str) -> list[tuple[int, int]]:
    """Mail addresses, of any length."""
    out, floor = [], 0
    for m in _mail.finditer(text):
        a = _before(text, _local, m.start(), floor)
        while a < m.start() and not (text[a].isascii() and text[a].isalnum()):
            a += 1
        if a < m.start():
            out.append((a, m.end()))
        floor = m.end()
    return out


def _hosts(text: str) -> list[tuple[int, int]]:
    """Names with a port, of any length."""
    out, floor = [], 0
    for m in _port.finditer(text):
        a = _before(text, _name, m.start(), floor)
        name = text[a : m.start()]
        begin = name.rfind("..") + 1
        while begin < len(name) and not name[begin].isalnum():
            begin += 1
        if _host.match(name, begin):
            out.append((a + begin, m.end()))
        floor = m.end()
    return out


def _is_random(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.0


def _free(spans, taken):
    """Those of the spans that overlap none of the taken, which are sorted and disjoint."""
    starts = [a for a, _ in taken]
    out = []
    for a, b in spans:
        k = bisect_left(starts, b)
        if k == 0 or taken[k - 1][1] <= a:
            out.append((a, b))
    return out


def nearest(span: tuple[int, int], others: list[tuple[int, int]], starts: list[int], window: int) -> tuple[int, int] | None:
    """The one of the others (sorted, disjoint) with the least gap to the span, if the gap is within the window; of two, the left."""
    k = bisect_left(starts, span[0])
    best = None
    for j in (k - 1, k):
        if 0 <= j < len(others):
            gap = max(others[j][0] - span[1], span[0] - others[j][1], 0)
            if gap <= window and (best is None or gap < best[0]):
                best = (gap, others[j])
    return best and best[1]


def _blocks(text: str) -> list[tuple[int, int]]:
    """Private keys from BEGIN to END, of any length; those without an END, as far as their lines go on."""
    begins = list(_begin.finditer(text))
    ends = [m.end() for m in _end.finditer(text)] if begins else []
    out = []
    for m, later in zip(begins, [*(x.start() for x in begins), len(text)][1:], strict=True):
        k = bisect_left(ends, m.end())
        out.append((m.start(), ends[k] if k < len(ends) and ends[k] <= later else _body.match(text, m.end()).end()))
    return out


def _logins(text: str, urls: list[tuple[int, int]]) -> list[re.Match | None]:
    """User and password of each URL. The authority has no other place for an at sign, so the last one before the path ends them."""
    return [_login.match(text, text.index("://", a), b) for a, b in urls]


def _assigned(text: str, urls: list[tuple[int, int]], logins: list[re.Match | None]) -> list[tuple[int, int]]:
    """Secrets by form or by the name of their assignment; in a URL, a value ends with the login or at the next value."""
    out, at, starts = [], 0, [a for a, _ in urls]
    while m := _formed.search(text, at):
        kind = m.lastgroup and ("v" if m["v"] is not None else "w")
        a, b = m.span(kind or 0)
        at = b
        if kind == "w":
            if _open.search(text, max(0, m.start() - 9), m.start()) or not _is_random(m["w"]):
                continue
            b = at = _rest.match(text, b).end()
        if kind:
            k = bisect_left(starts, a) - 1
            if k >= 0 and a < urls[k][1]:
                cuts = [x for c in "&#" if (x := text.find(c, a, b)) >= 0]
                if logins[k] and a < logins[k].end():
                    cuts = [logins[k].end() - 1]
                b = at = max(a, min([b, *cuts]))
            if b - a < 8:
                continue
        out.append((a, b))
    return out


def _split(text: str, url: tuple[int, int], login: re.Match | None):
    """Of a URL: (user, password, a token in place of both, random pieces, the endpoint without any of them); spans, or None."""
    start, b = url
    user = password = token = None
    host = text.index("://", start) + 3
    if login:
        start = host = login.end()
        if login["pair"]:
            user, password = (login.span(x) if login[x] else None for x in ("user", "password"))
        elif len(login["user"]) >= 20 and _is_random(login["user"]):
            token = login.span("user")
        elif login["user"]:
            user = login.span("user")
    tail = min((x for c in "?#" if (x := text.find(c, host, b)) >= 0), default=b)
    path = text.find("/", host, tail)
    end, pieces = tail, []
    for p in _piece.finditer(text, path if path >= 0 else tail, b):
        if (_word_piece if p.start() < tail else _plain).match(p[0]) and _is_random(p[0]):
            pieces.append(p.span())
            end = min(end, p.start())
    return user, password, token, pieces, (start, end)


def _united(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(spans):
        out[-1:] = [(out[-1][0], max(out[-1][1], s[1]))] if out and s[0] < out[-1][1] else [*out[-1:], s]
    return out


def scan(text: str | None, window: int = 300) -> list[tuple[str, tuple[int, int], tuple[int, int] | None, tuple[int, int] | None]]:
    """(strength, secret's span, identifier's or None, endpoint's or None), in order of the text; offsets count characters.

    A URL is several parts: its user is an identifier, its password a strong secret, random pieces of its path and query are
    weak ones, and its endpoint is what is before the first of them.
    """
    if not text or not _some.search(text):
        return []
    urls = _spans(_url, text)
    blocks = _blocks(text)
    logins = _logins(text, urls)
    strong = sorted([*blocks, *_free(_assigned(text, urls, logins), blocks)])
    split = [_split(text, u, m) for u, m in zip(urls, logins, strict=True)]
    strong = sorted([*strong, *_free([x[1] for x in split if x[1]], strong)])
    tokens = [x[2] for x in split if x[2]]
    pieces = tokens + [p for x in split for p in x[3]]
    places = [x[4] for x in split]
    # An endpoint never shows a secret: it ends where one begins.
    places = [(a, min([b, *(s for s, _ in strong[bisect_left(strong, (a, 0)) : bisect_left(strong, (b, 0))])])) for a, b in places]
    endpoints = _free([p for p in places if p[1] > p[0]], strong)
    endpoints = sorted([*endpoints, *_free(_united([*_hosts(text), *_spans(_endpoint, text)]), _united([*urls, *strong]))])
    users = _free([x[0] for x in split if x[0]], strong)
    access = sorted([*users, *_free(_united([*_mails(text), *_spans(_access, text)]), _united([*strong, *users, *tokens]))])
    access = [s for k, s in enumerate(access) if not k or access[k - 1][1] <= s[0]]
    whole = _united([*strong, *access, *endpoints, *urls])
    inside = _free(pieces, _united([*strong, *access]))
    weak = sorted({*inside, *(s for s in _free(_spans(_random, text), whole) if _is_random(text[s[0] : s[1]]))})
    out = []
    a_at, e_at = [a for a, _ in access], [a for a, _ in endpoints]
    for strength, s in sorted([("strong", s) for s in strong] + [("weak", s) for s in weak], key=lambda x: x[1]):
        near = nearest(s, access, a_at, window)
        if strength == "strong" or near:
            out.append((strength, s, near, nearest(s, endpoints, e_at, window)))
    return out


def redact(text: str | None, window: int = 300, mark: str = "[SECRET]") -> str | None:
    """The text with the secrets of all findings, and the identifiers linked to them, put out; None stays None."""
    found = scan(text, window)
    if not found:
        return text
    spans = sorted({s for _, s, a, _ in found} | {a for _, _, a, _ in found if a})
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = 300) -> DataFrame:
    """One row for each finding: doc_id, strength, start, end, secret_sha256, access_start, access_id, endpoint_start, endpoint.

    The secret itself never leaves, only its digest. Null or empty text: no findings. Very long texts are scanned whole.
    Ties between two identifiers or endpoints at one distance: the left one. Repeated rows: findings for each. A null id is
    reported as null, an id of another kind as it is. Empty table: no rows. Extra columns don't matter.
    """
    need(docs, id, text)

    def run(batches):
        for b in slices(batches, "text"):
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                for strength, s, a, e in scan(t, window):
                    digest = hashlib.sha256(t[s[0] : s[1]].encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((i, strength, s[0], s[1], digest, a and a[0], t[a[0] : a[1]] if a else None, e and e[0], t[e[0] : e[1]] if e else None))
            ids = b.column(0).take(pa.array([r[0] for r in rows], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k + 1] for r in rows], type=ty) for k, ty in enumerate(types))], names=names)

    names = ["doc_id", "strength", "start", "end", "secret_sha256", "access_start", "access_id", "endpoint_start", "endpoint"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    narrow = docs.select(col(id).alias("id"), col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    return narrow.mapInArrow(run, f"doc_id {docs.schema[id].dataType.simpleString()}, strength string, start int, end int, secret_sha256 string, access_start int, access_id string, endpoint_start int, endpoint string")


def redact_secrets(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", window: int = 300) -> DataFrame:
    """All documents and columns, secrets put out; the column ``length``, if there, counts the characters of the new text."""
    need(docs, text)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for b in slices(batches, text):
            k = b.schema.get_field_index(text)
            old = b.column(k).to_pylist()
            new = [redact(t, window) for t in old]
            changed = [i for i, (x, y) in enumerate(zip(old, new, strict=True)) if x is not y]
            if changed:
                columns = list(b.columns)
                columns[k] = pa.array(new, type=b.schema.field(k).type)
                if length in names:
                    j = b.schema.get_field_index(length)
                    values = columns[j].to_pylist()
                    for i in changed:
                        values[i] = len(new[i])
                    columns[j] = pa.array(values, type=b.schema.field(j).type)
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.select(*(F.col("`" + n.replace("`", "``") + "`") for n in names)).mapInArrow(run, schema)
