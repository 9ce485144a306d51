"""Parts of raw e-mail messages: headers, nested multiparts (closed or not), transfer encodings and charsets."""

from __future__ import annotations

import binascii
import codecs
import re
from html import unescape
from typing import NamedTuple

_HEADER = re.compile(r"^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*((?:[^\n]*)(?:\n[ \t][^\n]*)*)", re.I | re.M)
_PARAM = {name: re.compile(rf'\b{name}[ \t]*=[ \t]*(?:"([^"]*)"|([^\s;"]+))', re.I) for name in ("boundary", "charset")}
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")


class Part(NamedTuple):
    kind: str
    attached: bool
    text: str


def _param(value: str, name: str) -> str | None:
    m = _PARAM[name].search(value)
    return (m[1] if m[1] is not None else m[2]) if m else None


def _decoded(body: str, encoding: str, charset: str | None) -> str:
    """The text of a body. Cut-off base64 gives what is whole, unknown charsets are read as UTF-8, bad bytes are replaced."""
    if encoding == "base64":
        digits = _NOT_BASE64.sub("", body.split("=", 1)[0] if "=" in body.rstrip("=\n \t") else body)
        digits = digits[: len(digits) - (len(digits) % 4 == 1)]
        raw = binascii.a2b_base64(digits + "=" * (-len(digits) % 4))
    elif encoding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogateescape"))
    else:
        return body
    try:
        codec = codecs.lookup(charset or "utf-8").name
    except LookupError:
        codec = "utf-8"
    text = raw.decode(codec, "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _pieces(body: str, boundary: str) -> list[str]:
    """The parts between the delimiter lines of a multipart body; without a closing line the last part runs to the end."""
    text, mark = "\n" + body, f"\n--{boundary}"
    out: list[str] = []
    begin, at = -1, text.find(mark)
    while at >= 0:
        end = at + len(mark)
        closing = text.startswith("--", end)
        line_end = text.find("\n", end)
        line_end = len(text) if line_end < 0 else line_end
        if text[end + 2 * closing : line_end].strip(" \t"):
            at = text.find(mark, at + 1)  # a longer boundary, of a part inside
            continue
        if begin >= 0:
            out.append(text[begin:at])
        if closing:
            return out
        begin, at = line_end + 1, text.find(mark, line_end)
    if begin >= 0:
        out.append(text[begin:])
    return out


def text_parts(message: str | None) -> list[Part]:
    """All text parts of a message in their order, however deep, attachments and attached messages included; none for a null or empty
    message. What an attached message holds counts as attached."""
    out: list[Part] = []
    todo = [(message.replace("\r\n", "\n").replace("\r", "\n") if "\r" in message else message, False)] if message else []
    while todo:
        text, inside = todo.pop()
        if text.startswith("\n"):
            head, body = "", text[1:]
        else:
            head, _, body = text.partition("\n\n")
        fields = {m[1].lower(): m[2] for m in reversed(list(_HEADER.finditer(head)))}
        kind_field = fields.get("content-type", "text/plain")
        kind = kind_field.split(";", 1)[0].strip().lower() or "text/plain"
        boundary = _param(kind_field, "boundary")
        attached = inside or fields.get("content-disposition", "").strip().lower().startswith("attachment")
        encoding = fields.get("content-transfer-encoding", "").strip().lower()
        if kind.startswith("multipart/") and boundary:
            todo += [(piece, attached) for piece in reversed(_pieces(body, boundary))]
        elif kind == "message/rfc822":
            todo.append((_decoded(body, encoding, None), True))
        elif kind.startswith("text/"):
            out.append(Part(kind, attached, _decoded(body, encoding, _param(kind_field, "charset"))))
    return out


def plain_body(message: str | None) -> str | None:
    """The first text/plain part that is no attachment, or None."""
    return next((p.text for p in text_parts(message) if p.kind == "text/plain" and not p.attached), None)


_TAG_END = re.compile(r"(?is)<(style|script)\b.*?(</\1\s*>|$)")
_TAG = re.compile(r"<[^<>]*>")


def html_text(html: str) -> str:
    """The readable text of HTML: tags removed, entities resolved."""
    return unescape(_TAG.sub(lambda m: "" if re.match(r"</?(?:i|b|em|strong|u|span|font|a|tt|code)\b", m[0], re.I) else " ", _TAG_END.sub(" ", html)))
