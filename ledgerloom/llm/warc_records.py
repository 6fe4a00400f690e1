"""WARC 1.1 records as bytes, one gzip member each, and the URL keys of captures."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_URL = re.compile(r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", re.I | re.S)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, lower-cased, without scheme, ``www``, default port and fragment."""
    match = _URL.match(url or "")
    if not match:
        return (url or "").split("#")[0].lower()
    host, port, rest = match.groups()
    labels = [x for x in host.lower().split(".") if x]
    if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    port = f":{port}" if port and port not in ("80", "443") else ""
    return f"{','.join(reversed(labels))}{port}){(rest or '/').lower()}"


def captured(page_id: int | None) -> str:
    """Pages carry no date; a page counts as captured ``page_id`` seconds after the epoch of the archive."""
    return (EPOCH + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One compressed record. A revisit keeps the HTTP header, and so the size, but not the payload."""
    http = _HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Date", captured(page_id)),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
    ]
    if revisit:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", _PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream, step: int = 1 << 18) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, bytes) of each gzip member of a file, read forward."""
    rest, at = b"", 0
    while rest or (rest := stream.read(step)):
        unpacker, out, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            if not rest and not (rest := stream.read(step)):
                raise ValueError("the archive ends inside a record")
            out.append(unpacker.decompress(rest))
            used += len(rest) - len(unpacker.unused_data)
            rest = unpacker.unused_data
        yield at, used, b"".join(out)
        at += used


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_record(data: bytes) -> dict:
    """What a record says; the payload digest of a response is computed from its payload and must be the declared one."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = body[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != declared):
        raise ValueError("the payload is not the one that was written")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "captured": fields["WARC-Date"],
        "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": declared,
        "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload,
    }
